"""Columns that are computed once however often they are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluate_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a generator.

    Catalyst copies the expression of an ordinary column into every filter and projection above it.
    For a costly one, such as decoding a payload, that repeats the work many times per row; a
    generated column is a value by the time anything refers to it.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
