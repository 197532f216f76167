"""Scans, savepoint tables and the fixture relations."""

from caselink.sources.carriers import CARRIER_STUDY, CARRIERS, carrier
from caselink.sources.files import read_lookup, read_parquet, read_tagged, read_wide_table

__all__ = [
    "CARRIERS",
    "CARRIER_STUDY",
    "carrier",
    "read_lookup",
    "read_parquet",
    "read_tagged",
    "read_wide_table",
]
