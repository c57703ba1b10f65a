"""Column names."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

# Fixed value: what a normalised name may not contain.
_OTHER = re.compile("[^a-z0-9]+")


def snake_case(name: str) -> str:
    """Lower-case ``name``, with every run of other characters as one ``_``."""
    return _OTHER.sub("_", name.lower()).strip("_")


def snake_case_columns(df: DataFrame) -> DataFrame:
    """Rename all columns; two names that fall together are an error."""
    names = [snake_case(c) for c in df.columns]
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes:
        raise ValueError(f"columns that share one normalised name: {clashes}")
    return df.toDF(*names)


def drop_named(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop columns by normalised name; names that are absent are ignored."""
    unwanted = {snake_case(n) for n in names}
    return df.drop(*[c for c in df.columns if snake_case(c) in unwanted])
