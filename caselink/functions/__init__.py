"""Column helpers built on Spark SQL functions."""

from caselink.functions.columns import (
    age_band,
    any_not_null,
    bigint,
    contains_flag,
    days_between,
    label_map,
    month_start,
    paste,
    population_of,
    recode,
    rounded,
    week_centre,
)
from caselink.functions.names import clean_name, clean_names

__all__ = [
    "age_band",
    "any_not_null",
    "bigint",
    "clean_name",
    "clean_names",
    "contains_flag",
    "days_between",
    "label_map",
    "month_start",
    "paste",
    "population_of",
    "recode",
    "rounded",
    "week_centre",
]
