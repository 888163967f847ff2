"""Patient index, anonymization, cohort and interval extracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.operators.skew import lookup_join


def index_id(key: Column, salt: str) -> Column:
    """Study-wide id of a source key: the same key always gets the same id."""
    return F.sha2(F.concat(F.lit(salt), key.cast("string")), 256)


def build_index(sources: DataFrame, key: str, salt: str) -> DataFrame:
    """One row per distinct source key with its study-wide id."""
    return sources.select(key).where(F.col(key).isNotNull()).distinct().withColumn("index_id", index_id(F.col(key), salt))


def anonymize(df: DataFrame, index: DataFrame, key: str, drop: list[str], excluded: DataFrame | None = None) -> DataFrame:
    """Replace the patient key by its index id and drop identifying columns.

    A key the index does not know gets a null id, so the row count stays that of the source except
    for the patients listed in ``excluded``.
    """
    kept = df if excluded is None else lookup_join(df, excluded.select(key).distinct(), [key], "left_anti")
    return lookup_join(kept.drop(*drop), index.select(key, "index_id"), [key], "left").drop(key)


def restrict_to_cohort(df: DataFrame, cohort: DataFrame, key: str) -> DataFrame:
    """Rows of the participants; one participant may hold any share of the table."""
    return lookup_join(df, cohort.select(key).distinct(), [key], "left_semi")


def interval_extract(df: DataFrame, cohort: DataFrame, key: str, column: str, start: Column, end: Column) -> DataFrame:
    """Cohort rows of the half-open interval; the range test runs before the semi join."""
    return restrict_to_cohort(df.where((F.col(column) >= start) & (F.col(column) < end)), cohort, key)


def new_forms(data: DataFrame, configured: DataFrame, form: str) -> DataFrame:
    """Forms that occur in the data but not in the configuration."""
    return data.select(form).distinct().join(configured.select(form), form, "left_anti")
