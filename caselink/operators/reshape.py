"""Projection, wide/long reshaping and unions."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselink.functions import any_not_null


def without(df: DataFrame, *columns: str) -> DataFrame:
    """All columns but these; unlike ``drop`` a missing name is an error."""
    unknown = set(columns) - set(df.columns)
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    return df.drop(*columns)


def map_columns(df: DataFrame, columns: Sequence[str], fn: Callable[[Column], Column]) -> DataFrame:
    """Apply one expression to many columns in a single projection."""
    return df.withColumns({c: fn(F.col(c)) for c in columns})


def row_sum(columns: Sequence[str]) -> Column:
    """Sum across columns; null as soon as one of them is null."""
    return reduce(lambda a, b: a + b, [F.col(c) for c in columns])


def wide_to_long(
    df: DataFrame,
    keys: Sequence[str],
    required: str,
    pattern: str = r"n(\d+)_(.+)",
    level: str = "level",
) -> DataFrame:
    """Repeating column groups to one row per occurrence, in a single pass over the input.

    ``pattern`` splits a column name into occurrence number and value name. Occurrences whose
    ``required`` value is null are dropped, and rows with none at all are filtered at the scan.
    """
    groups: dict[str, dict[str, str]] = {}
    for column in df.columns:
        match = re.fullmatch(pattern, column)
        if match and column not in keys:
            groups.setdefault(match.group(1), {})[match.group(2)] = column
    values = list(dict.fromkeys(name for group in groups.values() for name in group))
    types = {name: df.schema[group[name]].dataType for group in groups.values() for name in group}
    occurrences = [
        F.struct(
            F.lit(number).alias(level),
            *[
                (F.col(group[v]) if v in group else F.lit(None).cast(types[v])).alias(v)
                for v in values
            ],
        )
        for number, group in groups.items()
    ]
    present = any_not_null([group[required] for group in groups.values() if required in group])
    return (
        df.where(present)
        .select(*keys, F.inline(F.array(*occurrences)))
        .where(F.col(required).isNotNull())
    )


def doses_to_long(df: DataFrame, keys: Sequence[str], doses: Sequence[str]) -> DataFrame:
    """One row per person and dose, doses not given included (null date)."""
    return df.unpivot([*keys], [*doses], "dose", "data")


def stack_frames(*frames: DataFrame) -> DataFrame:
    """Row-bind by name; columns missing on one side become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def tagged_union(frames: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """Row-bind named frames, each row carrying the name of its frame."""
    return stack_frames(*[df.select(F.lit(name).alias(tag), *df.columns) for name, df in frames.items()])
