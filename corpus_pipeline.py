"""The training-data pipeline: quality rules, near-dedup, substring dedup, decontamination, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as parquet and read
back as the next stage's documents. All stages but the last return the columns of documents.

* quality rules: documents that a rule rejects go;
* SimHash near-dedup: the document of the smallest id of each group of near copies stays;
* substring dedup: words of passages that occur more than once go; a document that loses none keeps
  its text as it is, another keeps its remaining words joined by spaces, and ``n_chars`` is theirs;
* benchmark decontamination: documents that hold a passage of a test item go;
* best-fit packing: one row for each piece of a document, with its bin and place.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselink.llm import decontam, packing, rules, simhash, substring
from caselink.llm.queries import importable
from caselink.session import shared_dir, tune


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.kept_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = substring.remove_repeats(docs)
    new = {
        "text": F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")),
        "n_chars": F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast("bigint")).otherwise(
            F.col("row.n_chars")
        ),
    }
    return cut.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.measured(docs))


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", best_fit),
]

#: SimHash needs XXH64 and packing a greedy search, which SQL lacks; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``, each written and read again before the next."""
    importable(tune(spark))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{root}/{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
