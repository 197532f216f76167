"""Column-name cleaning for tables with free-form headers."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clean_name(name: str) -> str:
    """Lower-case ASCII words joined by underscores."""
    text = name.replace("%", " percent ").replace("#", " number ")
    text = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", text)
    text = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()
    text = re.sub(r"[^a-z0-9]+", "_", text).strip("_") or "x"
    return f"x{text}" if text[0].isdigit() else text


def clean_names(df: DataFrame) -> DataFrame:
    """One projection with cleaned headers; repeats get the suffix _2, _3, …"""
    seen: dict[str, int] = {}
    columns = []
    for name in df.columns:
        cleaned = clean_name(name)
        seen[cleaned] = seen.get(cleaned, 0) + 1
        if seen[cleaned] > 1:
            cleaned = f"{cleaned}_{seen[cleaned]}"
        columns.append(F.col(f"`{name}`").alias(cleaned))
    return df.select(*columns)
