"""Main text of pages by site style trees.

The pages of a host are merged into one tree whose nodes are element paths (tags with their classes).
Of every node the tree counts the pages that have it, its presentation styles (sequences of child
elements) and its content features (text blocks below it). A node's importance joins two entropies
over the m pages that have it: that of its presentation styles, and one minus the mean entropy of its
features, both to base m. Something that looks and reads the same on every page has importance 0.
Branches below ``LEAST`` are removed from each page, inside a marked article as well as around it. Equal
pages of a host count once, so that copies of one article do not pass for furniture. Nodes on fewer than
``PAGES`` different pages, and those more than ``DEPTH`` elements deep, are not judged by themselves. Where the
tree would leave nothing of a page, labels alone decide.

Labels are what is known beforehand: names of page furniture (menus, adverts, forms and so on) make a
branch unimportant, and if a page marks its article, only what is in it can be text. The element that
marks the article, and those around it, are not judged, only what they hold.

The counts are summed by task and by Spark; the unimportant nodes of the sites are written, and Spark
joins them to the pages by their true size. A null url is a host of its own, a null or empty page has
no text, repeated pages count as often as they occur, and an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselink.llm.markup import Page
from caselink.session import savepoint

PAGES = 5
LEAST = 0.2
#: Weight of a node's own presentation beside the content below it.
OWN = 0.1
DEPTH = 64
FLUSH = 150_000

#: Elements, roles and words in class names or ids that name page furniture.
FURNITURE_TAGS = set("nav footer aside form button select input label dialog menu head search object embed canvas audio video map".split())
FURNITURE_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
FURNITURE_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice notices alert popup modal "
    "overlay newsletter subscribe signup login share sharing social related recommended comment comments reply replies "
    "respond disqus widget toolbar pagination pager copyright search".split()
)
ARTICLE = {"article", "main"}
_NO_NAMES: frozenset[str] = frozenset()
_UNSIGNED = (1 << 64) - 1
_WORDS = re.compile(r"[a-z]+")
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", re.I)


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def _names(attrs: dict[str, str]) -> set[str]:
    return set(_WORDS.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()))


class Styled:
    """A page with the path, role and kind of each of its elements."""

    def __init__(self, source: str | None):
        page = self.page = Page(source)
        n = len(page.parent)
        # A path's hash is chained from its parent's, so that deep pages take no more than flat ones.
        self.path = [0] * n
        # The element itself, or its nearest ancestor that is not too deep to be judged.
        self.judged = [0] * n
        depth = [0] * n
        furniture, article = [False] * n, [False] * n
        inside = [False] * n
        for i in range(1, n):
            up, tag, attrs = page.parent[i], page.tag[i], page.attrs[i]
            names = _names(attrs) if attrs else _NO_NAMES
            depth[i] = depth[up] + 1
            own = f"{tag}.{'.'.join(sorted(names))}" if names else tag
            self.path[i] = xxhash.xxh64_intdigest(own, seed=self.path[up] & _UNSIGNED) - (1 << 63)
            self.judged[i] = i if depth[i] <= DEPTH else self.judged[up]
            inside[i] = inside[up] or article[up]
            words = names & FURNITURE_WORDS
            if inside[i]:
                words = words - {"header"}
            furniture[i] = bool(
                tag not in ("html", "body")
                and (
                    tag in FURNITURE_TAGS
                    or (tag == "header" and not inside[i])
                    or words
                    or attrs
                    and (
                        attrs.get("role", "").lower() in FURNITURE_ROLES
                        or "hidden" in attrs
                        or attrs.get("aria-hidden") == "true"
                        or "display:none" in attrs.get("style", "").replace(" ", "").lower()
                    )
                )
            )
            article[i] = (tag in ARTICLE or attrs.get("role") == "main" or attrs.get("itemprop") == "articleBody") and not (
                furniture[i]
            )
        # An element around an article is not furniture, whatever it is called, unless it is a comment.
        holds = [False] * n
        for i in range(n - 1, 0, -1):
            if article[i] or holds[i]:
                up = page.parent[i]
                if not _names(page.attrs[up]) & {"comment", "comments", "replies", "reply", "respond", "related"} and page.tag[
                    up
                ] not in ("aside", "nav", "footer", "form"):
                    holds[up] = True
        self.furniture = [f and not h for f, h in zip(furniture, holds)]
        self.article, self.holds = article, holds

    def text(self, unimportant: set[int] | None = None) -> str:
        """The text of the important branches; of the marked article alone if there is one."""
        page = self.page
        n = len(page.parent)
        gone, marked = [False] * n, [False] * n
        for i in range(1, n):
            up = page.parent[i]
            marked[i] = marked[up] or self.article[i]
            gone[i] = gone[up] or self.furniture[i] or (
                bool(unimportant)
                and not (self.article[i] or self.holds[i] or page.tag[i] in ("html", "body"))
                and self.judged[i] == i
                and self.path[i] in unimportant
            )
        only = any(self.article[i] and not gone[i] for i in range(n))
        blocks: list[str] = []
        last = None
        for block, node, text in page.runs:
            if gone[node] or (only and not marked[node]):
                continue
            if block == last:
                blocks[-1] += text
            else:
                blocks.append(text)
                last = block
        joined = (" ".join(b.split()) for b in blocks)
        return "\n".join(b for b in joined if b)

    def counts(self) -> set[tuple[int, int, int]]:
        """``(node, kind, feature)``: 0 the node itself, 1 a presentation style, 2 a text block."""
        page = self.page
        n = len(page.parent)
        children: list[list[str]] = [[] for _ in range(n)]
        for i in range(1, n):
            up = page.parent[i]
            if not children[up] or children[up][-1] != page.tag[i]:
                children[up].append(page.tag[i])
        out = set()
        for i in range(1, n):
            if self.judged[i] == i:
                out.add((self.path[i], 0, 0))
                out.add((self.path[i], 1, xxhash.xxh64_intdigest(" ".join(children[i])) - (1 << 63)))
        for _, node, text in page.runs:
            if not node or text.isspace():
                continue
            feature = xxhash.xxh64_intdigest(" ".join(text.split())) - (1 << 63)
            node = self.judged[node]
            while node:
                out.add((self.path[node], 2, feature))
                node = page.parent[node]
        return out


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: defaultdict = defaultdict(float)

    def flush() -> pa.RecordBatch:
        host, node, kind, feature = zip(*found)
        row = pa.RecordBatch.from_arrays(
            [
                pa.array(host, pa.string()),
                pa.array(node, pa.int64()),
                pa.array(kind, pa.int32()),
                pa.array(feature, pa.int64()),
                pa.array(list(found.values()), pa.float64()),
            ],
            names=["host", "node", "kind", "feature", "n"],
        )
        found.clear()
        return row

    for batch in batches:
        for url, source, copies in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist()):
            host = host_of(url.as_py())
            for x in Styled(source.as_py()).counts():
                found[(host, *x)] += 1.0 / copies
            if len(found) > FLUSH:
                yield flush()
    if found:
        yield flush()


def _host(url_col: str) -> Column:
    """The same in Spark, for joins before a page is read."""
    return F.lower(
        F.regexp_extract(
            F.coalesce(F.col(url_col).cast("string"), F.lit("")),
            r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)",
            1,
        )
    )


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, node, pages, importance`` of the merged trees of all hosts; ``pages`` counts different ones."""
    # Of equal pages of a host one counts: as many shares of one as there are copies.
    page = F.struct(_host(url_col).alias("host"), F.xxhash64(html_col).alias("page"))
    copies = savepoint(
        pages.groupBy(page.alias("of")).agg(F.count("*").alias("copies")).where("copies > 1").select("of.*", "copies"), "page_copies"
    )
    marked = pages.select(F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"), page.alias("of"))
    once = marked.join(copies, (F.col("of.host") == F.col("host")) & (F.col("of.page") == F.col("page")), "left")
    merged = (
        once.select("url", "html", F.coalesce("copies", F.lit(1)).alias("copies"))
        .mapInArrow(_merge, "host string, node bigint, kind int, feature bigint, n double")
        .groupBy("host", "node", "kind", "feature")
        .agg(F.sum("n").alias("n"))
    )
    n = F.col("n").cast("double")

    def part(kind: int, value):
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, value)), F.lit(0.0))

    sums = merged.groupBy("host", "node").agg(
        part(0, n).alias("pages"),
        part(1, n).alias("styles"),
        part(1, n * F.log(n)).alias("style_logs"),
        part(2, n).alias("features"),
        part(2, n * F.log(n)).alias("feature_logs"),
    )
    base = F.log("pages")
    style = F.when(
        (F.col("pages") > 1) & (F.col("styles") > 0),
        (F.log("styles") - F.col("style_logs") / F.col("styles")) / base,
    ).otherwise(1.0)
    content = F.when(
        (F.col("pages") > 1) & (F.col("features") > 0), 1 - F.col("feature_logs") / F.col("features") / base
    ).otherwise(style)
    importance = style * OWN + content * (1 - OWN)
    return sums.select("host", "node", F.round("pages").cast("bigint").alias("pages"), importance.alias("importance"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for source, nodes in zip(batch.column(0), batch.column(1)):
            unimportant = set(nodes.as_py()) if nodes.is_valid else None
            page = Styled(source.as_py())
            texts.append(page.text(unimportant) or page.text())
        yield pa.RecordBatch.from_arrays(
            [batch.column(2), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
            names=["row", "text", "n_chars"],
        )


def main_text(pages: DataFrame, least: float = LEAST, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``row, text, n_chars`` per page; ``row`` holds all columns of ``pages`` but the html."""
    tree = style_tree(pages, url_col, html_col)
    low = savepoint(
        tree.where((F.col("pages") >= PAGES) & (F.col("importance") < least))
        .groupBy("host")
        .agg(F.collect_list("node").alias("nodes")),
        "unimportant_nodes",
    )
    boxed = pages.select(
        _host(url_col).alias("host"),
        F.col(html_col).alias("html"),
        F.struct(*[F.col(f"`{c}`") for c in pages.columns if c != html_col]).alias("row"),
    )
    row = boxed.schema["row"].dataType.simpleString()
    return (
        boxed.join(low, "host", "left")
        .select("html", "nodes", "row")
        .mapInArrow(_extract, f"row {row}, text string, n_chars bigint")
    )
