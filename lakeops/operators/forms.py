"""Form captures kept as one row per field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def forms_wide(captures: DataFrame, keys: list[str], field: str, value: str, order: list[str], fields: list[str]) -> DataFrame:
    """One row per document with the latest value of each known field.

    One aggregate for all fields: ``max_by`` folds captures before the shuffle, and the field list
    comes from the caller, so no pass is spent on finding it. Of captures at one place in the order the
    largest value counts.
    """
    newest: list[Column] = [
        F.max_by(F.when(F.col(field) == name, F.col(value)), F.when(F.col(field) == name, F.struct(*order, value))).alias(name)
        for name in fields
    ]
    return captures.groupBy(*keys).agg(*newest)


def union_systems(legacy: DataFrame, new: DataFrame) -> DataFrame:
    """Both systems in one table, columns by name, with the system a row came from."""
    return legacy.withColumn("origin", F.lit("legacy")).unionByName(
        new.withColumn("origin", F.lit("new")), allowMissingColumns=True
    )
