"""Bringing datasets to a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Columns of ``schema`` in its order and types; absent ones are null, others are dropped.

    A value that does not fit its declared type fails the job instead of turning into a null. The error
    names the column, not the value, which may be personal.
    """
    def column(field):
        if field.name not in df.columns:
            return F.lit(None).cast(field.dataType).alias(field.name)
        c = F.col(field.name)
        if df.schema[field.name].dataType == field.dataType:
            return c
        cast = c.try_cast(field.dataType)
        problem = F.lit(f"a value of {field.name} cannot be {field.dataType.simpleString()}")
        return F.when(c.isNotNull() & cast.isNull(), F.raise_error(problem).cast(field.dataType)).otherwise(cast).alias(field.name)

    return df.select([column(f) for f in schema])
