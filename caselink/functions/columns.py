"""Scalar column helpers: recodes, bands, day arithmetic, labels."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def label_map(value: Column | str, mapping: Mapping, default: Column | None = None) -> Column:
    """First matching entry of ``mapping``; unmatched and null values give ``default`` (null)."""
    value = as_col(value)
    items = list(mapping.items())
    chain = F.when(value == F.lit(items[0][0]), F.lit(items[0][1]))
    for key, label in items[1:]:
        chain = chain.when(value == F.lit(key), F.lit(label))
    return chain if default is None else chain.otherwise(default)


def recode(value: Column | str, mapping: Mapping) -> Column:
    """Like :func:`label_map`, but values outside the mapping stay as they are."""
    return label_map(value, mapping, as_col(value))


def age_band(age: Column | str, bands: Sequence[tuple[int | None, str]]) -> Column:
    """Left-closed bands; ages below the first bound are null unless that bound is None."""
    age = as_col(age)
    chain = None
    for low, label in reversed(bands):
        test = age.isNotNull() if low is None else age >= low
        chain = F.when(test, label) if chain is None else chain.when(test, label)
    return chain


def population_of(band: Column | str, population: Mapping[str, int]) -> Column:
    return label_map(band, population)


def days_between(later: Column | str, earlier: Column | str) -> Column:
    return F.datediff(as_col(later), as_col(earlier))


def paste(*parts: Column | str, sep: str = "_") -> Column:
    """Concatenate with null shown as the text ``NA``; ``concat_ws`` would skip it instead."""
    shown = [F.coalesce(as_col(part).cast("string"), F.lit("NA")) for part in parts]
    pieces = [shown[0]]
    for part in shown[1:]:
        pieces += [F.lit(sep), part] if sep else [part]
    return F.concat(*pieces)


def contains_flag(text: Column | str, keyword: str) -> Column:
    """1 if the text holds the keyword, 0 if not, null for null text."""
    return as_col(text).contains(keyword).cast("int")


def any_not_null(columns: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns])


def week_centre(value: Column | str, width: int = 7) -> Column:
    """Centre of the histogram bin holding a day number: bin edges lie half a width off zero."""
    return (F.floor((as_col(value) + F.lit(width / 2)) / width) * width).cast("int")


def month_start(text: Column | str, months: Mapping[str, int]) -> Column:
    """First day of the month written as ``<abbreviation> <year>``."""
    text = as_col(text)
    month = label_map(F.substring_index(text, " ", 1), months)
    year = F.substring_index(text, " ", -1).try_cast("int")
    return F.make_date(year, month, F.lit(1))


def bigint(value: Column | str) -> Column:
    return as_col(value).cast("bigint")


def rounded(value: Column | str, digits: int = 6) -> Column:
    return F.round(as_col(value).cast("double"), digits)
