"""Connected components of an edge list by alternating star contractions.

Every round is two group-by-minimum steps and two joins on node ids; the frames between rounds are
written to the shared folder, so lineage stays short and a lost executor costs a re-read. Minima are
written before they are joined, which leaves both join sides plain shuffles that adaptive execution
can split when one node has a large share of the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselink.session import savepoint


def _minima(pairs: DataFrame) -> DataFrame:
    """The smallest neighbour of each node, itself included."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return savepoint(least.select("u", F.least("u", "m").alias("m")), "minima")


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's minimum."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (
        both.join(_minima(both), "u")
        .where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to their minimum; edges run from larger to smaller."""
    joined = edges.join(_minima(edges), "u")
    return joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v")


def _state(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))
        ).first()
    )


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for all nodes of ``edges(a, b)``; the component is its smallest node.

    Loops and repeated edges are allowed, rows with a null end are ignored, and no edges give no rows.
    """
    now = savepoint(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    state = _state(now)
    while state[0]:
        now = savepoint(_small_star(_large_star(now)).distinct(), "edges")
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
