"""The ten operators and the pipeline as queries, with SQL where SQL can express them."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselink.llm import decontam, divergence, kneser_ney, mixture, packing, rules, run_index, simhash, site_style, substring, token_files, whitening, word_backoff
from caselink.session import shared_dir, tune

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where it was not installed or submitted with the job."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    return spark


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(importable(tune(spark)), sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op9_quality_rules(spark, sf_dir):
    return rules.judge(_table(spark, sf_dir, "documents")).drop("failed_rules")


def _quality_sql() -> str:
    base = " OR ".join(f"NOT ({r.sql()})" for r in rules.BASE).replace("one", "1")
    ok = " AND ".join(f"({r.sql()})" for r in rules.RULES)
    stops = ", ".join(f"'{w}'" for w in sorted(set(rules.STOP_WORDS)))
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
l AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
x AS (
  SELECT r, i, list_slice(w, i, i + 7) AS s
  FROM (SELECT r, w, unnest(generate_series(1, len(w) - 7)) AS i FROM d WHERE len(w) >= 8)),
s AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM x) WHERE c > 1),
c AS (
  SELECT r, sum(least(8, coalesce(nxt - i, 8))) AS n_repeat_words
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM s) GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_exclamations,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
    CAST(len(list_filter(w, lambda y: y IN ({stops}))) AS BIGINT) AS n_stop_words,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN l USING (r) LEFT JOIN c USING (r))
SELECT *, ({base}) AS base_failed, (NOT ({base}) AND {ok}) AS kept FROM m"""


ORACLE["op9_quality_rules"] = _quality_sql()


@query
def op10_simhash_near_dedup(spark, sf_dir):
    found = simhash.classes(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op5_substring_dedup(spark, sf_dir):
    cut = substring.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("row.doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


@query
def op6_benchmark_decontamination(spark, sf_dir):
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return decontam.contaminations(docs, items).drop("key")


@query
def op7_best_fit_packing(spark, sf_dir):
    return packing.pack(packing.measured(_table(spark, sf_dir, "documents")))


@query
def op3_token_files(spark, sf_dir):
    import public_tokenizers

    path = f"{shared_dir(spark)}/tokens/{uuid.uuid4().hex}"
    docs = _table(spark, sf_dir, "documents")
    token_files.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_index(spark, path)


@query
def op2_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    # A null id has no remainder: it is not held out, and not learnt from either.
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    docs = docs.withColumn("held_out", held_out)
    learnt = docs.where(F.col("doc_id").isNotNull() & ~F.col("held_out"))
    found = word_backoff.identify(learnt, docs.select("doc_id", "held_out", "text"))
    return found.select("row.doc_id", "row.held_out", "lang_pred", "score")


@query
def op1_site_style_text(spark, sf_dir):
    found = site_style.main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("row.page_id", "row.url", "text", "n_chars")


@query
def op4_kneser_ney_quality(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = _table(spark, sf_dir, "labels")
    trusted = labels.where("quality = 1 AND toxic = 0").select("doc_id")
    rejected = labels.where("quality = 0 OR toxic = 1").select("doc_id")
    return kneser_ney.judge(docs, trusted, rejected=rejected)


@query
def op8_run_index_dedup(spark, sf_dir):
    cut = run_index.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select(
        "row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256")
    )


@query
def op13_mixture_packing(spark, sf_dir):
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    tokens = mixture.tokenised(docs, public_tokenizers.path("word_bpe_49k.json"))
    return mixture.pack_tokens(tokens).drop("ids")


@query
def op12_source_divergence(spark, sf_dir):
    return divergence.audit(_table(spark, sf_dir, "documents").select("text", "lang", "source"))


ORACLE["op12_source_divergence"] = divergence.audit_sql()


@query
def op11_embedding_whitening(spark, sf_dir):
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))
