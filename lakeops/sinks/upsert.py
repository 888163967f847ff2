"""Keyed upsert as a set operation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.operators.maintenance import finish_replacement, replace_data_files
from lakeops.operators.skew import lookup_join
from lakeops.sources.store import Store


class DuplicateKeys(ValueError):
    """The staging data names one target row more than once."""


def require_unique(staging: DataFrame, keys: list[str]) -> None:
    """Reject staging data with two rows for one key; a null in a key equals nothing."""
    doubled = staging.select(*keys).na.drop("any", subset=keys).groupBy(*keys).count().where("count > 1")
    example = doubled.limit(1).collect()
    if example:
        raise DuplicateKeys(f"several staging rows for key {example[0].asDict()}")


def upsert(target: DataFrame, staging: DataFrame, keys: list[str], excluded: list[str] | None = None) -> DataFrame:
    """Target after inserting new staging rows and updating matched ones.

    An insert takes every staging column. An update takes the staging columns that are neither key nor
    ``excluded``. Target columns that staging lacks keep their value, null on insert. When no column
    is left to update, existing rows stay as they are and the first row per key is inserted only by
    ``insert_ignore``. Keys with nulls never match and are inserted.

    Both sides are read once, by one full outer join on the keys; the check for two rows of one key
    reads the key columns of the staging side before it.
    """
    updates = [c for c in staging.columns if c not in keys and c not in (excluded or [])]
    if not updates:
        return insert_ignore(target, staging, keys, order=staging.columns)
    require_unique(staging, keys)
    return _merged(target, staging, keys, updates)


def upsert_files(
    spark: SparkSession, path: str, staging: DataFrame, keys: list[str], excluded: list[str] | None = None, partition: str | None = None,
) -> dict[str, int]:
    """``upsert`` into a parquet table in place, rewriting only the files that hold a matched key.

    The scan that looks for them reads the keys alone; files without a match keep their names and times.
    What replaces the others, with the rows that are new, is written aside and swapped in by a journal,
    which the next call completes if this one is stopped; readers wait meanwhile, as for any change in
    place. The driver holds the names of the files that change. Returns how many ``rewritten`` and
    ``written``.
    """
    store, path = Store(spark), path.rstrip("/")
    finish_replacement(store, path)
    require_unique(staging, keys)
    schema = spark.read.parquet(path).schema
    file = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    places = spark.read.schema(schema).parquet(path).select(*keys, file.alias("_file"))
    matched = lookup_join(places, staging.select(*keys), keys, "left_semi").select("_file").distinct()
    base = store.qualified(path)
    bare = lambda uri: uri.replace(":///", ":/", 1)  # noqa: E731  (local paths come with either)
    old = sorted(bare(r["_file"]).removeprefix(f"{bare(base)}/") for r in matched.collect())
    whole = spark.read.schema(schema).option("basePath", path)
    held = whole.parquet(*[f"{path}/{name}" for name in old]) if old else spark.createDataFrame([], schema)
    staged = f"{path}/_compacting/data"
    merged = upsert(held, staging, keys, excluded)
    (merged.write.partitionBy(partition) if partition else merged.write).parquet(staged)
    written = replace_data_files(store, path, old, staged)
    spark.catalog.refreshByPath(path)
    return {"rewritten": len(old), "written": written}


def insert_ignore(target: DataFrame, staging: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Target with the staging rows whose key is new; of several, the first in ``order``.

    Rows with a null in the key are all inserted.
    """
    rest = [c for c in staging.columns if c not in keys]
    # Rows without a whole key are groups of their own.
    own = F.when(_keyless(keys), F.monotonically_increasing_id())
    grouped = staging.withColumn("_own", own).groupBy(*keys, "_own")
    if rest:
        first = grouped.agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")
    else:
        first = grouped.agg(F.count(F.lit(1)).alias("_n")).select(*keys)
    return _merged(target, first, keys, [])


def _keyless(keys: list[str]):
    absent = F.lit(False)
    for k in keys:
        absent = absent | F.col(k).isNull()
    return absent


def _merged(target: DataFrame, staging: DataFrame, keys: list[str], updates: list[str]) -> DataFrame:
    new = staging.select(*[F.col(c).alias(f"_new_{c}") for c in staging.columns], F.lit(True).alias("_staged"))
    same = None
    for k in keys:
        same = (F.col(k) == F.col(f"_new_{k}")) if same is None else same & (F.col(k) == F.col(f"_new_{k}"))
    joined = target.withColumn("_stored", F.lit(True)).join(new, same, "full_outer")
    stored, staged = F.col("_stored").isNotNull(), F.col("_staged").isNotNull()

    def value(c: str):
        if c not in staging.columns:
            return F.col(c)
        newer = staged if c in updates else ~stored
        return F.when(newer, F.col(f"_new_{c}")).otherwise(F.col(c)).cast(target.schema[c].dataType).alias(c)

    return joined.select([value(c) for c in target.columns])
