"""Exact quantiles of many groups in memory that does not grow with the values.

A quantile is one or two order statistics. Those of all groups are narrowed down together: an approximate
summary cuts each bracket of values at about ``CUTS`` places, the rows at and between the cuts are
counted, and the value or gap that holds the rank becomes the next bracket. Common values are cuts of
their own, so a bracket shrinks by a large factor each round whatever the distribution, and ends as a
single value. A round is two grouped scans of a narrow table; a group's state is the summary.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caselink.session import savepoint

CUTS, ACCURACY = 100, 1000


def same_keys(keys: Sequence[str], prefix: str = "_") -> Column:
    """Rows of equal keys, nulls alike; the other side's have the prefix."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(prefix + k)) for k in keys], F.lit(True))


def exact_quantiles(df: DataFrame, keys: Sequence[str], column: str, points: Sequence[float]) -> DataFrame:
    """``keys, n, quantiles``: the number of known values and their interpolated quantiles, as an array.

    Null values do not count; groups without a known value have no row. Null keys are a group.
    """
    known = df.where(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("_x"))
    known = savepoint(known, "quantile_values")
    sizes = known.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    groups = savepoint(sizes.withColumn("_group", F.monotonically_increasing_id()), "quantile_groups")
    named = groups.select(*[F.col(k).alias("_" + k) for k in keys], "_group")
    rows = savepoint(known.join(named, same_keys(keys)).select("_group", "_x"), "quantile_rows") if keys else known.withColumn("_group", F.lit(0).cast("bigint"))
    if not keys:
        groups = savepoint(groups.where("n > 0").withColumn("_group", F.lit(0).cast("bigint")), "quantile_groups")

    place = [(F.col("n") - 1) * float(p) for p in points]
    wanted = F.array(*[F.struct(F.lit(i).alias("point"), F.lit(s).alias("side"), f(h).cast("bigint").alias("rank")) for i, h in enumerate(place) for s, f in ((0, F.floor), (1, F.ceil))])
    going = groups.select("_group", "lo", "hi", F.explode(wanted).alias("w")).select("_group", "lo", "hi", "w.*")
    probabilities = [i / CUTS for i in range(CUTS + 1)]
    found = None
    while True:
        going = savepoint(going, "open_quantiles")
        done = going.where("lo = hi").select("_group", "point", "side", F.col("lo").alias("value"))
        found = done if found is None else found.unionByName(done)
        going = going.where("lo < hi")
        if not going.take(1):
            break
        brackets = going.select("_group", "lo", "hi").distinct()
        inside = rows.join(brackets, "_group").where("_x BETWEEN lo AND hi")
        cuts = inside.groupBy("_group", "lo", "hi").agg(F.percentile_approx("_x", probabilities, ACCURACY).alias("cuts"))
        cuts = savepoint(cuts.withColumn("cuts", F.array_distinct("cuts")), "cuts")
        below = F.size(F.filter("cuts", lambda c: c < F.col("_x")))
        at = (2 * below + F.array_contains("cuts", F.col("_x")).cast("int")).alias("at")
        counted = (
            rows.join(cuts, "_group")
            .where("_x BETWEEN lo AND hi")
            .select("_group", "lo", "hi", "_x", at)
            .groupBy("_group", "lo", "hi", "at")
            .agg(F.count("*").alias("m"), F.min("_x").alias("least"), F.max("_x").alias("most"))
        )
        before = F.sum("m").over(Window.partitionBy("_group", "lo", "hi").orderBy("at")) - F.col("m")
        counted = savepoint(counted.withColumn("before", before), "bracket_counts")
        going = (
            going.join(counted, ["_group", "lo", "hi"])
            .where("rank >= before AND rank < before + m")
            .select("_group", F.col("least").alias("lo"), F.col("most").alias("hi"), "point", "side", (F.col("rank") - F.col("before")).alias("rank"))
        )
    # Below and above each place, weighted by their distance from it.
    ends = found.groupBy("_group", "point").agg(
        F.max(F.when(F.col("side") == 0, F.col("value"))).alias("low"), F.max(F.when(F.col("side") == 1, F.col("value"))).alias("high")
    )
    h = reduce(lambda a, b: a.when(F.col("point") == b[0], b[1]), enumerate(place[1:], 1), F.when(F.col("point") == 0, place[0]))
    part = h - F.floor(h)
    value = F.when(part == 0, F.col("low")).otherwise((1 - part) * F.col("low") + part * F.col("high"))
    each = ends.join(groups.select("_group", "n"), "_group").select("_group", "point", value.alias("value"))
    listed = each.groupBy("_group").agg(F.array_sort(F.collect_list(F.struct("point", "value"))).alias("v"))
    return groups.join(listed, "_group").select(*keys, "n", F.transform("v", lambda v: v["value"]).alias("quantiles"))
