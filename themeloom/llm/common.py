"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_RUN = r"[\x20\x09-\x0D]+"
SPACES = tuple(" \t\n\x0b\x0c\r")


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def bound_to(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body reads it.

    A lambda body is interpreted anew for each element, and an expression in it
    too. The variable of an outer lambda is computed already.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_count(text: str | Column) -> Column:
    """Words between runs of ASCII white space; 0 for null and blank texts."""
    whole = text_or_empty(text)
    outside = sum(F.substring(whole, at, 1).isin(*SPACES).cast("int") for at in (1, -1))
    return F.when(whole == "", F.lit(0)).otherwise(F.size(F.split(whole, SPACE_RUN)) - outside).cast("long")
