"""Checks that stop a job early with a clear message."""

from __future__ import annotations

from pyspark.sql import DataFrame


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` reduced to ``names``; an absent name is an error that lists what exists."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}; available: {df.columns}")
    return df.select(*names)


def require_rows(df: DataFrame, what: str = "rows") -> DataFrame:
    """``df`` itself, or an error when it is empty (reads one row at most)."""
    if df.isEmpty():
        raise ValueError(f"no valid {what} available")
    return df
