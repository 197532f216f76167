"""Lumping of rare category levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselink.session import shared_stage


def level_weights(df: DataFrame, column: str, weight: str | None = None) -> DataFrame:
    """Rows, or summed weight, per non-null level."""
    total = F.sum(weight) if weight else F.count("*")
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(total.alias("_w"))


def lump_levels(
    df: DataFrame, column: str, keep: int, other: str = "Other", weight: str | None = None
) -> DataFrame:
    """Keep the ``keep`` largest levels as text and lump the rest, ties by best rank.

    The cut-off is the weight of the ``keep``-th level, so every level tied with it stays. A single
    level below the cut-off is left alone. The weights are summed and written once; the cut-off, the
    levels below it and the join all read that table, so they agree also for inexact sums, and Spark
    joins the kept levels by their true size.
    """
    weights = shared_stage(level_weights(df, column, weight), "level_weights")
    text = F.col(column).cast("string")
    top = weights.orderBy(F.desc("_w")).take(keep)
    below = weights.where(F.col("_w") < top[-1]["_w"]).take(2) if top else []
    if len(below) < 2:
        return df.withColumn(column, text)
    kept = weights.where(F.col("_w") >= top[-1]["_w"])
    lumped = F.when(F.col("_w").isNotNull(), text).when(F.col(column).isNotNull(), other)
    return df.join(kept, column, "left").withColumn(column, lumped).select(*df.columns)
