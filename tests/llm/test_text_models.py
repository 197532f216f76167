"""Main text, language identification, token files, perplexity and decontamination."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from caselink.llm import decontam, kneser_ney, pieces, site_style, token_files, word_backoff
from caselink.llm.elias_fano import EliasFano
from caselink.llm.markup import Page
from caselink.llm.texts import slices

tokens = pytest.importorskip("public_tokenizers")
BPE = tokens.path("byte_bpe_50k.json")
WORDS = tokens.path("word_bpe_49k.json")


# --- main text ----------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "source, text",
    [
        (None, ""),
        ("", ""),
        ("plain &lt;text&gt;\n here", "plain <text> here"),
        ("<p>a<p>b<br>c</p>d", "a\nb c\nd"),
        ("<title>no</title><script>var t='</p>';</script><style>p{}</style><p>yes</p><!-- <p>no</p> -->", "yes"),
        ("<nav><ul><li>x</ul></nav><article><h1>T</h1><p>a <b>b</b>c</p></article><footer>f</footer>", "T\na bc"),
        ("<article><p>a</p><aside>n</aside><form>q</form><div class='ad'>buy</div><p>z</p></article>", "a\nz"),
        ("<article><p>text</p><section class=comments><article class=comment>me too</article></section></article>", "text"),
        ("<div class='cookie-notice'>ok?</div><header>Site</header><main><header>Title</header><p>x</main>", "Title\nx"),
        ("<body class='has sidebar'><div id=sidebar>s</div><div>main words</div></body>", "main words"),
        ("<article><table><tr><td>1<td>2<tr><td>3</table><ul><li>a<li>b</ul></article>", "1\n2\n3\na\nb"),
        ("<article>&eacute;&#233;&amp;amp;&nbsp; x</article>", "éé&amp; x"),
        ("<article><p>open <b>bold<p>next</b></article>tail", "open bold\nnext"),
        ("<p hidden>no</p><p style='display: none'>no</p><p>yes</p>", "yes"),
        ("<unclosed <p>a</p", "a</p"),
    ],
)
def test_text_of_one_page(source, text):
    assert site_style.Styled(source).text() == text


def test_pages_keep_order_and_parents():
    page = Page("<div><p>a</div><p>b")
    assert all(up < i for i, up in enumerate(page.parent) if i)


def test_the_tree_finds_what_no_label_names(spark):
    rows = [
        (i, f"http://h.org/{i}", f"<div class=q><p>Same on all pages</div><div class=z><p>Page {i} of {i * 7}</div>")
        for i in range(12)
    ]
    rows += [(100 + i, "http://other.org/x", "<div class=q><p>Same on all pages</div><div class=z>Only</div>") for i in range(3)]
    rows += [(200, None, None), (201, "not a url", ""), (202, None, "<p>no host</p>"), (202, None, "<p>no host</p>")]
    rows += [(300 + i, "https://copies.org/", "<div>One text</div><div>everywhere</div>") for i in range(9)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, text string")
    got = defaultdict(list)
    found = site_style.main_text(pages)
    for r in found.collect():
        assert r.n_chars == len(r.text) and r.row.text == "x"
        got[r.row.page_id].append(r.text)
    assert all(got[i] == [f"Page {i} of {i * 7}"] for i in range(12))
    assert got[100] == ["Same on all pages\nOnly"]
    assert got[200] == [""] and got[201] == [""] and got[202] == ["no host"] * 2
    assert got[300] == ["One text\neverywhere"]
    assert site_style.main_text(pages.limit(0)).count() == 0


def test_importance_equals_its_definition(spark):
    rows = [(i, "http://a.b/", f"<!-- {i} --><div><p>t{i % 3}</p>" + "<i></i>" * (i % 2) + "</div>") for i in range(8)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    importances = {round(r.importance, 9) for r in site_style.style_tree(pages).collect() if r.pages == 8}

    def entropy(counts, m):
        n = sum(counts)
        return -sum(c / n * math.log(c / n) for c in counts) / math.log(m)

    texts = Counter(f"t{i % 3}" for i in range(8))
    content = sum(n * (1 - math.log(n) / math.log(8)) for n in texts.values()) / 8
    assert round(0.1 * entropy([4, 4], 8) + 0.9 * content, 9) in importances
    assert round(0.1 * 0.0 + 0.9 * content, 9) in importances


def plain_main_text(rows, least=site_style.LEAST, enough=site_style.PAGES):
    """The method by its definition: trees as dictionaries of paths spelt out, one page after another."""
    trees = defaultdict(list)
    for url, source in dict.fromkeys((site_style.host_of(u), h) for u, h in rows):
        trees[url].append(source)

    def paths(page):
        out = [""]
        for i in range(1, len(page.parent)):
            names = "." + ".".join(sorted(site_style._names(page.attrs[i]))) if site_style._names(page.attrs[i]) else ""
            out.append(f"{out[page.parent[i]]}/{page.tag[i]}{names}")
        return out

    low = defaultdict(set)
    for host, sources in trees.items():
        seen, styles, features = Counter(), defaultdict(Counter), defaultdict(Counter)
        for source in sources:
            page = Page(source)
            path, kids, below = paths(page), defaultdict(list), defaultdict(set)
            for i in range(1, len(path)):
                up = page.parent[i]
                kids[up] += [page.tag[i]] if kids[up][-1:] != [page.tag[i]] else []
            for _, node, text in page.runs:
                while node and text.strip():
                    below[path[node]].add(" ".join(text.split()))
                    node = page.parent[node]
            seen.update(set(path[1:]))
            for p in set(path[1:]):
                styles[p].update({" ".join(kids[i]) for i in range(1, len(path)) if path[i] == p})
                features[p].update(below[p])
        for p, m in seen.items():
            def entropy(counts):
                return -sum(c / sum(counts) * math.log(c / sum(counts)) for c in counts) / math.log(m)

            if m >= enough:
                own = entropy(styles[p].values())
                words = [c for c in features[p].values()]
                content = 1 - sum(c * math.log(c) for c in words) / sum(words) / math.log(m) if words else own
                if site_style.OWN * own + (1 - site_style.OWN) * content < least:
                    low[host].add(p)
    out = []
    for url, source in rows:
        styled = site_style.Styled(source)
        page, path = styled.page, paths(styled.page)

        def text(bad):
            def gone(i):
                return i and (gone(page.parent[i]) or styled.furniture[i] or (path[i] in bad and not styled.article[i] and not styled.holds[i] and page.tag[i] not in ("html", "body")))

            def marked(i):
                return i and (marked(page.parent[i]) or styled.article[i])

            only = any(styled.article[i] and not gone(i) for i in range(1, len(path)))
            blocks = defaultdict(str)
            for block, node, t in page.runs:
                if not gone(node) and (marked(node) or not only):
                    blocks[block] += t
            return "\n".join(b for b in (" ".join(blocks[k].split()) for k in sorted(blocks)) if b)

        out.append(text(low[site_style.host_of(url)]) or text(set()))
    return out


def sites():
    """Hosts whose pages carry unlabelled lines of the site, within the marked article and around it."""
    rows = []
    for i in range(14):
        article = f"<article><h1>Title {i}</h1><div class=q>Read our letter every week</div><p>Words of page {i} and {i * 3}</p><p>More {i % 4}</p></article>"
        rows.append((f"http://a.org/{i}", f"<div class=top>The site</div>{article}<div class=z>Terms</div>"))
        rows.append((f"http://b.org/{i}", f"<div class=top>Other site</div><div><p>Plain page {i}</p><div class=q>Same line</div></div>"))
    rows += [("http://copies.org/", "<article><p>One article</p><p>in many copies</p></article>")] * 9
    rows += [(f"http://few.org/{i}", "<div>Few</div><p>pages</p>" + "x" * i) for i in range(3)]
    return [*rows, (None, None), (None, "<p>no host</p>"), ("nonsense", "")]


def test_the_tree_decides_inside_marked_articles(spark, monkeypatch):
    rows = sites()
    frame = spark.createDataFrame(rows, "url string, html string").repartition(3)
    got = Counter((r.row.url, r.text) for r in site_style.main_text(frame).collect())
    assert got == Counter((u, t) for (u, _), t in zip(rows, plain_main_text(rows)))
    texts = {u: t for u, t in got}
    assert texts["http://a.org/3"] == "Title 3\nWords of page 3 and 9\nMore 3"
    assert texts["http://b.org/3"] == "Plain page 3" and texts["http://copies.org/"] == "One article\nin many copies"
    without = {(r.row.url, r.text) for r in site_style.main_text(frame, least=-1.0).collect()}
    assert ("http://a.org/3", "Title 3\nRead our letter every week\nWords of page 3 and 9\nMore 3") in without


def test_a_table_of_pages_equals_a_plain_version(spark):
    import os

    folder = "/root/testdata/sf0.01/pages.parquet"
    if not os.path.exists(folder):
        pytest.skip("needs the test tables")
    pages = spark.read.parquet(folder)
    rows = [(r.url, r.html) for r in pages.select("url", "html").collect()]
    got = Counter((r.row.url, r.text) for r in site_style.main_text(pages).collect())
    assert got == Counter((u, t) for (u, _), t in zip(rows, plain_main_text(rows)))


@pytest.mark.parametrize("source", ["<a " * 200000, "<font>" * 100000, "<a ' \" " * 100000 + ">", "<font>" * 50000 + "</b>" * 90000, "<" * 500000, "<! " * 200000])
def test_malformed_pages_take_linear_time(source):
    import time

    started = time.process_time()
    styled = site_style.Styled(source)
    styled.text()
    assert len(styled.counts()) <= 3 * site_style.DEPTH
    assert time.process_time() - started < 4


# --- languages ----------------------------------------------------------------------------------


def test_languages_are_learnt_and_unknown_words_backed_off(docs):
    rng = random.Random(1)
    parts = {"aa": ["ka", "ri", "mo"], "bb": ["sch", "ung", "ein"], "cc": ["eaux", "ion", "que"]}
    rows = [
        (i, " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(30)), lang)
        for i, lang in enumerate(list(parts) * 20)
    ]
    model = word_backoff.train(docs(rows))
    asked = [
        (1, "kari mori kakakakaka"), (2, "ungschein scheinscheinschein"), (3, "ioneaux QUEIONQUEIONEAUX"), (4, None),
        (5, ""), (6, "123 !!"), (None, "rimo"), (7, "rimo"), (7, "rimo"), (8, "日本"), (9, "ka " * 20000),
    ]
    got = word_backoff.predict(docs(asked), model).collect()
    assert len(got) == len(asked)
    by = {(r.row.doc_id): r for r in got}
    assert [by[i].lang_pred for i in (1, 2, 3, 4, 5, 6, None, 7, 9)] == ["aa", "bb", "cc", "und", "und", "und", "aa", "aa", "aa"]
    assert by[8].lang_pred in parts
    assert all(0 <= r.score <= 1 for r in got) and by[4].score == 0
    # Longest known n-grams first, then shorter ones.
    known = model.grams
    word = "\x02zzka\x03"
    longest = max(n for n in range(1, 6) if any(word[i : i + n] in known[n - 1] for i in range(len(word) - n + 1)))
    rows_ = [known[longest - 1][word[i : i + longest]] for i in range(len(word) - longest + 1) if word[i : i + longest] in known[longest - 1]]
    assert np.allclose(model.unseen("zzka"), model.scores[rows_].mean(axis=0))


def test_word_scores_are_log_frequencies(docs):
    model = word_backoff.train(docs([(1, "a a b", "x"), (2, "b c c c", "y"), (3, "q", None), (4, None, "x")]))
    assert model.langs == ["x", "y"] and set(model.words) == {"a", "b", "c"}
    assert np.allclose(model.word("a"), [math.log(2.5 / 4.5), math.log(0.5 / 5.5)])


def test_nothing_to_learn_from(docs):
    empty = docs([(1, "text")]).limit(0)
    model = word_backoff.train(empty)
    assert [r.lang_pred for r in word_backoff.predict(docs([(1, "text")]), model).collect()] == ["und"]
    assert word_backoff.predict(empty, model).count() == 0


def test_identify_learns_from_every_word_and_equals_an_uncut_model(docs, odd):
    rng = random.Random(14)
    rows = [(i, " ".join("".join(rng.choices(p, k=rng.randint(1, 4))) for _ in range(40)), lang) for i in range(20) for lang, p in (("aa", ["ka", "ri"]), ("bb", ["schu", "ung"]))]
    # A hot language whose many words push the rare one of a small language out of a model cut by totals.
    rows += [(100 + i, " ".join(f"{rng.choice('aeiou')}{a}{b}xx" for a in "abcdefghij" for b in "klmnop"), "aa") for i in range(20)]
    rows += [(200, "xxq", "cc")]
    asked = [*odd, (30, "xxq"), (31, "xxq xxq"), (32, "karika zzz"), (33, "日本"), (34, "ka " * 3000), *[(40 + i, r[1]) for i, r in enumerate(rows)]]
    whole = word_backoff.train(docs(rows))
    want = Counter((str(r.row.doc_id), r.lang_pred, round(r.score, 4)) for r in word_backoff.predict(docs(asked), whole).collect())
    assert [{len(g) for g in grams} for grams in whole.grams] == [{1}, {2}, {3}, {4}, {5}]
    cut = word_backoff.train(docs(rows), words=3, grams=3)
    assert "xxq" not in cut.words
    got = word_backoff.identify(docs(rows), docs(asked)).collect()
    assert Counter((str(r.row.doc_id), r.lang_pred, round(r.score, 4)) for r in got) == want
    assert {r.lang_pred for r in got if r.row.doc_id in (30, 31)} == {"cc"}
    empty = docs(rows).limit(0)
    assert {r.lang_pred for r in word_backoff.identify(empty, docs(asked)).collect()} == {"und"}
    assert word_backoff.identify(docs(rows), empty).count() == 0


# --- token files --------------------------------------------------------------------------------


def test_elias_fano_round_trip():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 0), (3, 3), (100, 10**6), (999, 200), (64, 10**13)):
        values = np.sort(rng.integers(0, top + 1, n))
        coded = EliasFano.encode(values)
        assert coded.all().tolist() == values.tolist() == [coded.select(i) for i in range(n)]
        assert coded.nbytes <= n * (2 + max(0, math.log2((top + 1) / max(n, 1)))) / 8 + 24
        with pytest.raises(IndexError):
            coded.select(n)


@pytest.mark.parametrize("kind, path", [(pieces.PieceEncoder, BPE), (pieces.WordEncoder, WORDS)])
def test_pieces_encode_like_whole_texts(kind, path):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    parts = [
        " ", "  ", "\n", "\t", " \n ", "a", "the", "é", "É", "'s", "'ll", " 're", "ß", "12", " 7", "…", " ", "　", "日本",
        "!!", "***", "<|endoftext|>", "\x1c", "\x01", "don't", "à ", "🙂", " ", "×", "÷", "ª", "́",
    ]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    whole = Tokenizer.from_file(path)
    encoder = kind(path, table_pieces=3000)  # small, so that pieces are forgotten and met again
    for part in slices(pa.array(texts), 4000):
        ids, counts = encoder.encode(part)
        at = np.r_[0, np.cumsum(counts)]
        for k, row in enumerate(part.rows):
            assert ids[at[k] : at[k + 1]].tolist() == whole.encode(texts[row], add_special_tokens=False).ids


def test_token_file_round_trip(spark, docs, odd, tmp_path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(BPE)
    rows = [*odd, *((1000 - i, f"text {i} " * (i % 40)) for i in range(200)), (5000, "long " * 30000)]
    path = str(tmp_path / "tokens")
    token_files.write_tokens(docs(rows), path, BPE, block_ids=2000)
    got = token_files.read_index(spark, path).orderBy("start").collect()
    assert len(got) == len(rows)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)
    want = Counter()
    for i, text in rows:
        x = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want[i, len(x), zlib.crc32(x.tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    blocks = token_files.blocks_of(spark, path).select("n_docs", "low_bits", "low", "high", "n_ids").collect()
    assert len(blocks) > 1
    for b in blocks:
        ends = EliasFano(b.n_docs, b.low_bits, bytes(b.low), bytes(b.high))
        assert ends.select(b.n_docs - 1) == b.n_ids


def test_token_file_of_nothing(spark, docs, tmp_path):
    path = str(tmp_path / "none")
    token_files.write_tokens(docs([(1, "x")]).limit(0), path, BPE)
    assert token_files.read_index(spark, path).count() == 0


# --- perplexity ---------------------------------------------------------------------------------


def symbols(text):
    out = []
    for c in map(ord, text):
        out.append(128 + c % 32 if c > 255 else 48 if 48 <= c < 58 else 32 if (c < 32 and c != 10) or 127 <= c < 160 else c)
    return out


def brute_perplexities(texts, trusted):
    """Interpolated modified Kneser-Ney by its definition, over one language."""
    counts = {5: Counter()}
    for t in trusted:
        s = [0] * 4 + symbols(t)
        counts[5].update(tuple(s[k - 4 : k + 1]) for k in range(4, len(s)))
    for n in (4, 3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discounts = {
        n: kneser_ney.discounts_of(np.array([sum(v == c for v in counts[n].values()) for c in (1, 2, 3, 4)])) for n in counts
    }
    contexts = {n: defaultdict(lambda: [0, 0, 0, 0]) for n in counts}
    for n in counts:
        for g, v in counts[n].items():
            contexts[n][g[:-1]][0] += v
            contexts[n][g[:-1]][min(v, 3)] += 1

    def p(g):
        if not g:
            return 1 / 256
        low = p(g[1:])
        if g[:-1] not in contexts[len(g)]:
            return low
        c, v, d = contexts[len(g)][g[:-1]], counts[len(g)].get(g, 0), discounts[len(g)]
        return (v - (d[min(v, 3) - 1] if v else 0) + sum(d[k] * c[k + 1] for k in range(3)) * low) / c[0]

    out = []
    for t in texts:
        s = [0] * 4 + symbols(t or "")
        logs = [math.log(p(tuple(s[k - 4 : k + 1]))) for k in range(4, len(s))]
        out.append(math.exp(-sum(logs) / len(logs)) if logs else None)
    return out


def test_perplexities_equal_the_definition(spark, docs):
    rng = random.Random(6)
    rows = [(i, " ".join("".join(rng.choices("abcé1日\n", [9, 5, 3, 2, 1, 1, 1], k=rng.randint(1, 8))) for _ in range(rng.randint(1, 30)))) for i in range(40)]
    rows += [(40, None), (41, ""), (42, "zzz qqq"), (None, rows[3][1]), (5, rows[5][1])]
    rows += [(50, "andere Sprache", "de"), (51, "keine Sprache", None)]
    trusted = spark.createDataFrame([(i,) for i in range(0, 20)] + [(99,)], "doc_id bigint")
    got = kneser_ney.perplexities(docs(rows), trusted).collect()
    assert len(got) == len(rows)
    english = [r for r in rows if len(r) == 2]
    learnt = [t for i, t in english if i is not None and i < 20]
    want = brute_perplexities([t for _, t in english], learnt)
    left = sorted((str(i), round(x, 4) if x else -1) for (i, _), x in zip(english, want))
    right = sorted((str(r.doc_id), round(r.perplexity, 4) if r.perplexity else -1) for r in got if r.lang == "en")
    assert [x[0] for x in left] == [x[0] for x in right]
    assert np.allclose([x[1] for x in left], [x[1] for x in right], rtol=2e-4)
    assert all(r.perplexity is None for r in got if r.lang != "en")


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    grams, counts = np.unique(rng.integers(1, 9, (4000, 5)) @ (256 ** np.arange(5)), return_counts=True)
    table = kneser_ney.Table(grams.astype(np.uint64), counts)
    context = table.contexts[7]
    asked = (context << np.uint64(8)) | np.arange(256, dtype=np.uint64)
    p = table.probability(asked, np.full(256, 1 / 256), np.array([0.4, 0.9, 1.3]))
    assert abs(p.sum() - 1) < 1e-9


def test_thresholds_keep_clean_text_of_each_language(spark, docs):
    rng = random.Random(8)
    clean = lambda parts: " ".join("".join(rng.choices(parts, k=2)) for _ in range(60))
    rows = [(i, clean(["ka", "ri", "mo", "te"]), "aa") for i in range(120)] + [(200 + i, clean(["schu", "ung", "ein"]), "bb") for i in range(120)]
    rows += [(900, "".join(rng.choices("#$%&*!X9", k=300)), "aa"), (901, "", "aa"), (902, None, "bb"), (903, "words", "cc"), (904, "words", None)]
    trusted = spark.createDataFrame([(i,) for i in [*range(80), *range(200, 280)]], "doc_id bigint")
    got = {r.doc_id: r for r in kneser_ney.judge(docs(rows), trusted).collect()}
    assert len(got) == len(rows)
    assert not got[900].kept and not got[901].kept and not got[902].kept and got[903].kept and got[904].kept
    fresh = [*range(80, 120), *range(280, 320)]
    assert sum(got[i].kept for i in fresh) >= 0.9 * len(fresh)
    assert got[0].threshold != got[200].threshold
    assert kneser_ney.judge(docs(rows).limit(0), trusted).count() == 0


def test_thresholds_are_chosen_by_rejected_texts_and_length(spark):
    frame = "lang string, n_chars bigint, perplexity double, aside boolean, rejected boolean"
    rows = []
    for n_chars, spread in ((2000, 0.1), (100, 1.0)):
        rows += [("aa", n_chars, 5 + spread * i / 200, True, False) for i in range(200)]
        rows += [("aa", n_chars, 5 + spread * (0.943 + i / 200), False, True) for i in range(100)]
    rows += [("aa", 9000, 5.0, True, False)] + [("bb", 300, float(i), True, False) for i in range(1000)]
    got = {r.lang: r for r in kneser_ney.thresholds(spark.createDataFrame(rows, frame)).collect()}
    assert set(got["aa"].by_class) == {3, 5}  # too few texts of 9,000 characters for limits of their own
    for (n_chars, spread), k in (((2000, 0.1), 5), ((100, 1.0), 3)):
        limit = got["aa"].by_class[k]
        assert 5 + 0.89 * spread <= limit <= 5 + 0.95 * spread
        bad = [r[2] for r in rows if r[1] == n_chars and r[4]]
        assert sum(x > limit for x in bad) >= 0.95 * len(bad)
    # Nothing is known to be bad: the quantile that is given.
    assert got["bb"].common == got["bb"].by_class[4] == 994.0


def test_rejected_texts_near_trusted_ones_are_caught(spark, docs):
    rng = random.Random(13)
    text = lambda bad: " ".join("".join(rng.choices(["ka", "ri", "mo", "te", "zu"], k=2)) if not bad or rng.random() > 0.04 else "xqj" for _ in range(200))
    rows = [(i, text(i >= 600), "aa") for i in range(800)]
    trusted = spark.createDataFrame([(i,) for i in range(500)], "doc_id bigint")
    rejected = spark.createDataFrame([(i,) for i in [3, *range(600, 700)]], "doc_id bigint")
    got = {r.doc_id: r for r in kneser_ney.judge(docs(rows), trusted, rejected=rejected).collect()}
    assert sum(not got[i].kept for i in range(700, 800)) >= 95
    assert sum(got[i].kept for i in range(500, 600)) >= 85


# --- decontamination ----------------------------------------------------------------------------


def brute_score(a, b):
    best = 0
    above = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b, start=1):
            row.append(max(0, above[j - 1] + (2 if x == y else -1), above[j] - 1, row[-1] - 1))
            best = max(best, row[-1])
        above = row
    return best


def test_alignment_scores_equal_brute_force():
    rng = random.Random(3)
    items = [np.array([rng.randrange(5) for _ in range(rng.randint(1, 14))], np.uint32) for _ in range(80)]
    texts = [np.array([rng.randrange(5) for _ in range(rng.randint(1, 30))], np.uint32) for _ in range(80)]
    assert decontam.alignment_scores(items, texts).tolist() == [brute_score(a.tolist(), b.tolist()) for a, b in zip(items, texts)]


def test_copies_edits_and_clean_documents(spark, docs, odd):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(3000)]
    items = [" ".join(rng.choices(words, k=rng.randint(20, 60))) for _ in range(30)]
    filler = lambda n: " ".join(rng.choices(words, k=n))

    def edited(text):
        out = []
        for w in text.split():
            u = rng.random()
            out += [] if u < 0.06 else [w, "extra"] if u < 0.12 else ["other"] if u < 0.2 else [w.upper() + ","]
        return " ".join(out)

    rows, want = [*odd], set()
    for k in range(90):
        kind = k % 3
        item = k % 30
        inside = [items[item], edited(items[item]), ""][kind]
        rows.append((100 + k, f"{filler(rng.randint(0, 600))} {inside} {filler(rng.randint(0, 300))}"))
        if kind < 2:
            want.add((100 + k, item))
    rows += [rows[-2], (None, items[0])]
    bench = [(i, t) for i, t in enumerate(items)] + [(70, None), (71, ""), (72, "too short"), (None, items[1]), (80, items[2])]
    benchmark = spark.createDataFrame(bench, "item_id bigint, text string")
    got = decontam.contaminations(docs(rows), benchmark)
    pairs = {(r.doc_id, r.item_id) for r in got.collect()}
    for i, item in want:
        assert (i, item) in pairs, (i, item)
    for i, item in pairs:
        same = {2: {2, 80}, 80: {2, 80}, None: {1, None}, 1: {1, None}}.get(item, {item})
        assert (i is None and item == 0) or any((i, x) in want for x in same)
    table = docs(rows)
    clean = decontam.clean_rows(table, benchmark)
    assert clean.columns == table.columns
    assert Counter(r.doc_id for r in clean.collect()) == Counter(
        r[0] for r in rows if not any(i == r[0] for i, _ in want) and r[1] != items[0]
    )
    assert decontam.contaminations(table.limit(0), benchmark).count() == 0
    assert decontam.contaminations(table, benchmark.limit(0)).count() == 0
    assert decontam.clean_rows(table, benchmark.limit(0)).count() == len(rows)


def test_a_long_item_is_matched_by_parts(spark, docs):
    words = [f"v{k}" for k in range(1500)]
    benchmark = spark.createDataFrame([(1, " ".join(words)), (2, "q w e r t y u i o p")], "item_id bigint, text string")
    inside = " ".join(["x"] * 50 + words[400:1000] + ["y"] * 50)
    rows = [(10, inside), (11, " ".join(words[:60])), (12, " ".join(f"n{k}" for k in range(500)))]
    got = decontam.contaminations(docs(rows), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(10, 1)}


def test_templated_items_make_few_candidates(spark, docs, monkeypatch):
    """Items that differ in one word meet the documents that hold that word, not all of their template."""
    items = [(i, f"what is the capital city of x{i}x") for i in range(60)]
    rows = [(i, f"one asks what is the capital city of {'x%dx' % i if i < 10 else 'nowhere'} and so on") for i in range(80)]
    frames = {}
    kept = decontam.savepoint

    def noted(frame, name, *rest):
        frames[name] = kept(frame, name, *rest)
        return frames[name]

    monkeypatch.setattr(decontam, "savepoint", noted)
    got = decontam.contaminations(docs(rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i) for i in range(10)}
    assert frames["candidates"].count() < 200


def test_contaminations_against_all_pairs(spark, docs):
    """Edited copies of items of many lengths: what Smith-Waterman over all pairs finds, 0.95 is found."""
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [[rng.choice(vocabulary) for _ in range(rng.choice([4, 7, 8, 9, 12, 20, 40]))] for _ in range(60)]

    def edited(words):
        out = []
        for w in words:
            p = rng.random()
            out += [] if p < 0.05 else [w, rng.choice(vocabulary)] if p < 0.1 else [rng.choice(vocabulary)] if p < 0.17 else [w]
        return out

    rows = []
    for i in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 400))]
        if i % 2:
            item = items[rng.randrange(len(items))]
            at = rng.randrange(len(words))
            words[at:at] = item if i % 4 == 1 else edited(item)
        rows.append((i, " ".join(words)))
    codes = {w: k for k, w in enumerate(vocabulary)}
    want = set()
    for i, text in rows:
        words = np.array([codes[w] for w in text.split()])
        for k, item in enumerate(items):
            score = int(decontam.alignment_scores([np.array([codes[w] for w in item])], [words])[0])
            perfect = decontam.MATCH * len(item)
            if score >= max(decontam.SHARE * perfect, min(perfect, decontam.LEAST * decontam.MATCH)):
                want.add((i, k))
    table = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminations(docs(rows), table).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) > 40


def test_a_hot_shard_is_answered_in_blocks(spark, docs, monkeypatch):
    """The same perplexities, bit for bit, with each shard whole and in many blocks."""
    rng = random.Random(16)
    rows = [(i, "".join(rng.choices("abc de", k=rng.randint(0, 400))), "en" if i % 3 else "de") for i in range(60)]
    table = docs(rows).repartition(12)
    trusted = spark.createDataFrame([(i,) for i in range(0, 60, 2)], "doc_id bigint")

    def scores():
        return sorted((r.doc_id, r.lang, r.n_chars, r.perplexity or -1.0) for r in kneser_ney.perplexities(table, trusted).collect())

    seen = []
    dealt = kneser_ney._blocks
    monkeypatch.setattr(kneser_ney, "_blocks", lambda sent: seen.append(dealt(sent)) or seen[-1])
    whole = scores()
    monkeypatch.setattr(kneser_ney, "BLOCK", 500)
    assert scores() == whole and len(whole) == len(rows)
    assert {r.blocks for r in seen[0].collect()} == {1}
    assert max(r.blocks for r in seen[1].collect()) > 3


def test_repeated_rows_in_two_languages_keep_their_own_counts(spark, docs):
    """Rows in pairs, the same rows in several partitions, and packs of two languages at once."""
    english, german = "the quick brown fox and the lazy dog", "der schnelle braune Fuchs und der faule Hund"
    rows = [(1, english, "en"), (1, english, "en"), (2, german, "de"), (2, german, "de"), (3, "the dog", "en"), (4, "der Hund", "de")]
    trusted = spark.createDataFrame([(1,), (2,)], "doc_id bigint")
    for table in (docs(rows).coalesce(1), docs(rows).repartition(6), docs(rows * 2).repartition(2, "doc_id")):
        texts = [r for r in table.select("doc_id", "text", "lang").collect()]
        got = kneser_ney.perplexities(table, trusted).collect()
        assert len(got) == len(texts)
        for lang, learnt in (("en", 1), ("de", 2)):
            own = [r for r in texts if r.lang == lang]
            want = brute_perplexities([r.text for r in own], [r.text for r in own if r.doc_id == learnt])
            left = sorted((r.doc_id, p) for r, p in zip(own, want))
            right = sorted((r.doc_id, r.perplexity) for r in got if r.lang == lang)
            assert [i for i, _ in left] == [i for i, _ in right]
            assert np.allclose([p for _, p in left], [p for _, p in right], rtol=2e-4)
