"""Small-file compaction, version retention, orphan files."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeops.operators.skew import lookup_join
from lakeops.sources.store import Store

TARGET_BYTES = 256 * 1024 * 1024


def _fingerprint(df: DataFrame) -> tuple:
    """Row count and an order-free checksum, in one pass with no shuffle of rows."""
    row = df.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")
    ).first()
    return row.n, row.h


def finish_replacement(store: Store, path: str) -> None:
    """Complete a replacement of files that had written its journal, or drop what one without a journal left."""
    work = f"{path}/_compacting"
    if store.exists(f"{work}/journal"):
        plan = json.loads(store.read_text(f"{work}/journal"))
        for name in plan["new"]:
            if store.exists(f"{work}/data/{name}"):
                store.rename(f"{work}/data/{name}", f"{path}/{name}")
        for name in plan["old"]:
            store.delete(f"{path}/{name}")
    store.delete(work)


def _data_files(store: Store, folder: str, below: str = "") -> list[tuple[str, int]]:
    """Names below ``folder`` and sizes of the data files of one table."""
    found = []
    for e in store.children(f"{folder}/{below}".rstrip("/")):
        name = f"{below}/{e.name}".lstrip("/")
        if e.name.startswith(("_", ".")):
            continue
        found += _data_files(store, folder, name) if e.is_dir else [(name, e.size)]
    return found


def replace_data_files(store: Store, path: str, old: list[str], staged: str) -> int:
    """Put the data files below ``staged``, which lies in ``path/_compacting``, in the place of ``old``; how many came.

    A journal names what comes and what goes, and is carried out by renames; stopped at any point,
    ``finish_replacement`` completes it.
    """
    new = [name for name, _ in _data_files(store, staged)]
    store.write_text(f"{path}/_compacting/journal", json.dumps({"old": old, "new": new}))
    finish_replacement(store, path)
    return len(new)


def compact(spark: SparkSession, path: str, partition: str | None = None, target_bytes: int = TARGET_BYTES) -> int:
    """Rewrite the small files of a parquet table into files of about ``target_bytes``; returns how many were
    planned.

    Only files below half the target are read, in partitions that have several of them, and only those
    are compared with what replaces them; the others are not touched. Without a partition column whole
    files are packed into tasks, so no row is shuffled. With one, rows move to their partition and are
    salted over as many files as its small files call for.

    The new files are written aside. A journal then names what comes and what goes, and is carried out
    by renames; stopped at any point, the next call completes it. While it is carried out a reader may
    see rows twice, so readers wait for upkeep, as for any change in place.
    """
    store, path = Store(spark), path.rstrip("/")
    finish_replacement(store, path)
    small: dict[str, list[tuple[str, int]]] = {}
    for name, size in _data_files(store, path):
        if size < target_bytes / 2:
            small.setdefault(name.rpartition("/")[0], []).append((name, size))
    small = {folder: files for folder, files in small.items() if len(files) > 1}
    if not small:
        return 0
    wanted = {folder: math.ceil(sum(size for _, size in files) / target_bytes) for folder, files in small.items()}
    old = [name for files in small.values() for name, _ in files]
    schema = spark.read.parquet(path).schema
    df = spark.read.schema(schema).option("basePath", path).parquet(*[f"{path}/{name}" for name in old])
    staged = f"{path}/_compacting/data"
    if partition is None:
        df.coalesce(sum(wanted.values())).write.parquet(staged)
    else:
        folder = F.concat(F.lit(f"{partition}="), F.col(partition).cast("string"))
        files = spark.createDataFrame([(f, n) for f, n in wanted.items()], "_folder string, _files int")
        salt = F.pmod(F.xxhash64(*[c for c in df.columns if c != partition]), F.coalesce("_files", F.lit(1))).alias("_salt")
        salted = lookup_join(df.withColumn("_folder", folder), files, ["_folder"], "left").select(*df.columns, salt)
        salted.repartition(partition, "_salt").drop("_salt").write.partitionBy(partition).parquet(staged)
    if _fingerprint(df) != _fingerprint(spark.read.schema(schema).option("basePath", staged).parquet(staged)):
        store.delete(f"{path}/_compacting")
        raise RuntimeError(f"compaction of {path} would change its content")
    replace_data_files(store, path, old, staged)
    spark.catalog.refreshByPath(path)
    return sum(wanted.values())


def retained_versions(df: DataFrame, table: str, version: str, keep: int = 10, newest_age_days: int | None = None) -> DataFrame:
    """``(table, version, kept)``: the ``keep`` newest versions, or those younger than an age.

    The newest version of a table is always kept. Versions are made distinct before they are ranked.
    """
    versions = df.select(table, version).distinct()
    newest_first = Window.partitionBy(table).orderBy(F.col(version).desc())
    ranked = versions.withColumn("_rank", F.dense_rank().over(newest_first))
    if newest_age_days is None:
        kept = F.col("_rank") <= max(keep, 1)
    else:
        latest = F.max(version).over(Window.partitionBy(table))
        kept = (F.col("_rank") == 1) | (F.datediff(latest, F.col(version)) <= newest_age_days)
    return ranked.withColumn("kept", kept).drop("_rank")


def retention(df: DataFrame, table: str, version: str, keep: int = 10, newest_age_days: int | None = None) -> DataFrame:
    """Rows of the versions that stay."""
    gone = retained_versions(df, table, version, keep, newest_age_days).where(~F.col("kept"))
    return lookup_join(df, gone.select(table, version), [table, version], "left_anti")


def drop_old_versions(spark: SparkSession, path: str, version: str, keep: int = 10) -> list[str]:
    """Delete the folders of the versions beyond the ``keep`` newest; returns what was dropped."""
    store = Store(spark)
    dropped = store.partitions(path, version)[:-max(keep, 1)]
    for value in dropped:
        store.delete(f"{path.rstrip('/')}/{version}={value}")
    return dropped


def orphans(listing: DataFrame, manifest: DataFrame, key: str = "path") -> DataFrame:
    """Files in storage that no manifest names."""
    return listing.join(manifest.select(key), key, "left_anti")
