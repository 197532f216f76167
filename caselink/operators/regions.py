"""Municipality codes: micro-region lookup and macro-region labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselink.config import StudyConfig
from caselink.functions import label_map

# The country has under 6,000 municipalities; a lookup beyond this is joined by shuffle.
BROADCAST_ROWS = 100_000


def region_lookup(mun_region: DataFrame) -> DataFrame:
    """Six-digit municipality code to micro-region."""
    code = F.nullif(F.regexp_extract("CD_GEOCODI", "[0-9]{6}", 0), F.lit(""))
    return mun_region.select(code.alias("cod_ibge"), "cod_rgi")


def region_lookup_join(
    df: DataFrame, mun_region: DataFrame, cfg: StudyConfig, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Left join on the municipality; unknown ones get the default micro-region.

    The lookup is counted first: a repeated code would multiply records and is an error, and only
    a lookup of checked size is broadcast.
    """
    lookup = region_lookup(mun_region)
    size = lookup.agg(
        F.count("cod_ibge").alias("rows"), F.count_distinct("cod_ibge").alias("codes")
    ).first()
    if size["rows"] != size["codes"]:
        raise ValueError("the region lookup has more than one row for a municipality code")
    if size["rows"] <= broadcast_rows:
        lookup = F.broadcast(lookup)
    return df.join(lookup, "cod_ibge", "left").withColumn(
        "cod_rgi", F.coalesce("cod_rgi", F.lit(cfg.default_micro_region))
    )


def region_codes(df: DataFrame, cfg: StudyConfig) -> DataFrame:
    """State code and macro-region label read off the municipality code."""
    return df.withColumns(
        {
            "uf": F.substring("cod_ibge", 1, 2),
            "macro_region": label_map(F.substring("cod_ibge", 1, 1), cfg.macro_regions),
        }
    )
