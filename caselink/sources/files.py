"""Readers for parquet tables, part-file folders, lookups and folders of result sheets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from caselink.functions import clean_names


def read_parquet(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    part_glob: str | None = None,
    schema: StructType | None = None,
) -> DataFrame:
    """Lazy scan of one parquet file or of every part file in a folder; nothing is cached."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if part_glob:
        reader = reader.option("pathGlobFilter", part_glob)
    df = reader.parquet(path)
    return df.select(*columns) if columns else df


def read_lookup(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Headed CSV lookup with a declared schema, so codes keep their leading zeros."""
    return spark.read.csv(path, header=True, schema=schema)


def read_wide_table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Headed CSV with free-form headers; all columns are text and get cleaned names."""
    return clean_names(spark.read.csv(path, header=True, sep=sep))


def read_tagged(spark: SparkSession, root: str, tag: str = "id", suffix: str = ".parquet") -> DataFrame:
    """All tables ``<root>/<sheet><suffix>`` as one, each row tagged with its sheet name."""
    pattern = r"/([^/]+)" + suffix.replace(".", r"\.")
    source = F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)
    df = spark.read.parquet(f"{root}/*{suffix}")
    return df.select(F.url_decode(source).alias(tag), *df.columns)
