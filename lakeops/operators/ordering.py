"""Dense ordinals, latest rows and neighbours without gathering a whole key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeops.session import durable


def with_ordinals(df: DataFrame, order: list[Column], name: str = "ordinal") -> DataFrame:
    """Dense zero-based position in a global order.

    The sort leaves range partitions in order; a row's position is the size of the partitions before
    it plus its place in its own. Only one count per partition is gathered. The sorted rows are
    materialized first, because both reads must see the same partition bounds.
    """
    place = F.monotonically_increasing_id()
    ranged = durable(df.orderBy(*order).withColumn("_place", place))
    ranged = ranged.withColumn("_part", F.shiftright("_place", 33))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        ranged.join(offsets, "_part")
        .withColumn(name, F.col("_offset") + within)
        .drop("_part", "_place", "_offset")
    )


def first_appearance(df: DataFrame, key: str, order: str) -> DataFrame:
    """Each key once with the lowest ``order`` it was seen at, and its position among the keys.

    An aggregate rather than a window: repeats of a key are folded before the shuffle.
    """
    first = df.groupBy(key).agg(F.min(order).alias(order))
    return with_ordinals(first, [F.col(order), F.col(key)], "position")


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the highest ``order`` of each key, as a partial aggregate."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(newest).select(*keys, "_row.*").select(*df.columns)


def as_of(df: DataFrame, keys: list[str], ts: str, end: Column, tiebreak: str) -> DataFrame:
    """State of every key just before ``end``."""
    return latest_per_key(df.where(F.col(ts) < end), keys, [ts, tiebreak])


def _carry(local: DataFrame, carried: DataFrame, on: list[str], found: str) -> DataFrame:
    """Fill ``found`` from the per-bucket table where the bucket itself had no answer."""
    named = carried.select(*[F.col(c).alias(f"_on_{c}") for c in on], "_carried")
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_on_{c}"))  # rows without a key stay together too
    return (
        local.join(named, same)
        .withColumn(found, F.coalesce(F.col(found), F.col("_carried")))
        .drop("_carried", *[f"_on_{c}" for c in on])
    )


def _previous(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str, found: str) -> DataFrame:
    """``value`` of the preceding row of the key, boxed in ``found``, null for its first row.

    Rows are compared inside (key, bucket); the first row of a bucket takes its predecessor from the
    last row of the closest earlier bucket. The per-bucket table is what crosses a key, so a key with
    very many rows is spread over its buckets.
    """
    boxed = F.struct(F.col(value).alias("v"))
    inner = Window.partitionBy(*keys, bucket).orderBy(*order)
    local = df.withColumn(found, F.lag(boxed).over(inner))
    last = df.groupBy(*keys, bucket).agg(F.max_by(boxed, F.struct(*order)).alias("_last"))
    across = Window.partitionBy(*keys).orderBy(bucket)
    carried = last.select(*keys, bucket, F.lag("_last").over(across).alias("_carried"))
    return _carry(local, carried, [*keys, bucket], found)


def _next(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str, found: str) -> DataFrame:
    """``value`` of the following row of the key in ``found``; the mirror of ``_previous``."""
    inner = Window.partitionBy(*keys, bucket).orderBy(*order)
    local = df.withColumn(found, F.lead(value).over(inner))
    first = df.groupBy(*keys, bucket).agg(F.min_by(value, F.struct(*order)).alias("_first"))
    across = Window.partitionBy(*keys).orderBy(bucket)
    carried = first.select(*keys, bucket, F.lead("_first").over(across).alias("_carried"))
    return _carry(local, carried, [*keys, bucket], found)


def status_history(df: DataFrame, keys: list[str], ts: str, tiebreak: str, status: str, bucket: Column) -> DataFrame:
    """Rows where a key's status differs from the one before, with the span it was valid for.

    ``bucket`` must not decrease with ``ts``; choose it fine enough that one bucket of the busiest
    key fits a task.
    """
    order = [ts, tiebreak]
    rows = df.select(*keys, ts, tiebreak, status).withColumn("_bucket", bucket)
    seen = _previous(rows, keys, "_bucket", order, status, "_before")
    changed = seen.where(F.col("_before").isNull() | ~F.col("_before.v").eqNullSafe(F.col(status))).drop("_before")
    spans = _next(changed, keys, "_bucket", order, ts, "valid_to")
    return spans.select(*keys, status, F.col(ts).alias("valid_from"), "valid_to")
