"""Joining a large table to keyed rows when one key, or no key, may hold much of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

# Rows without a key are spread over this many join keys that nothing matches.
NULL_SPREAD = 1 << 16


def _digest(df: DataFrame, dim: DataFrame, keys: list[str]) -> Column:
    """Hash of the keys that both sides agree on: of the types that a union gives them."""
    common = df.select(*keys).limit(0).union(dim.select(*keys).limit(0)).schema
    parts = []
    for f in common:
        c = F.col(f.name).cast(f.dataType)
        parts.append(c + F.lit(0.0) if isinstance(f.dataType, (FloatType, DoubleType)) else c)  # both zeros are one key
    return F.xxhash64(*parts)


def lookup_join(df: DataFrame, dim: DataFrame, keys: list[str], how: str = "inner", salts: int = 1) -> DataFrame:
    """``df`` joined to ``dim``, whose keys are distinct; ``how`` is inner, left, left_semi or left_anti.

    No count and no hint: Spark broadcasts ``dim`` while its measured size allows, and shuffles both
    sides otherwise. Spark splits a skewed partition of that join only if both sides are shuffled for
    the join alone: not if a side arrives partitioned by the key, as an aggregate on it does, nor if
    an aggregate above relies on the partitioning of the join. So a hash of the keys is one more join
    key: no other operator partitions by it, and a hot key is always split. Rows with a null key match
    nothing; where they stay in the result (left, left_anti) each gets a hash of its own instead of
    meeting in one task. ``salts`` above 1 cuts every key into that many shares and repeats ``dim`` as
    often, for a cluster without adaptive execution.
    """
    digest = _digest(df, dim, keys)
    row = F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind])
    keyless = F.lit(False)
    for k in keys:
        keyless = keyless | F.col(k).isNull()
    share = F.pmod(row, F.lit(salts)) if salts > 1 else F.lit(0).cast("bigint")
    salted = df.withColumn("_salt", F.when(keyless, F.pmod(row, F.lit(NULL_SPREAD))).otherwise(digest.bitwiseXOR(share)))
    shares = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))) if salts > 1 else F.lit(0).cast("bigint")
    spread = dim.withColumn("_share", shares).withColumn("_salt", digest.bitwiseXOR(F.col("_share"))).drop("_share")
    return salted.join(spread, [*keys, "_salt"], how).drop("_salt")
