"""Window-scoped overwrite of a day-partitioned parquet table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lakeops.sources.store import Store
from lakeops.sources.tables import check_window, in_window, partitioned_table


def _check_schema(df: DataFrame, path: str, partition: str) -> None:
    target = partitioned_table(df.sparkSession, path, partition)
    new, old = dict(df.dtypes), dict(target.dtypes)
    if new != old:
        differing = sorted(set(new.items()) ^ set(old.items()))
        raise ValueError(f"the new data and {path} differ in columns: {differing}")


def overwrite_window(df: DataFrame, path: str, partition: str, start: str, end: str, rebalance: bool = False) -> int:
    """Replace exactly the rows of ``path`` whose partition lies in ``[start, end)``.

    Days of the window that the new data lacks disappear; days outside are untouched. Empty input and
    a schema that differs from the table's are errors, as is a row outside the window, which stops
    the write before anything is replaced. The input is evaluated once. Spark commits the new days
    when every task is done; stale days go afterwards, so a rerun repairs a crash in between. A table
    that does not exist yet is simply written.

    ``rebalance`` shuffles rows to their day first, splitting large days and joining small ones, for
    input that is not laid out by day and would otherwise leave a small file per task and day.
    """
    check_window(start, end)
    store = Store(df.sparkSession)
    exists = bool(store.children(path))
    before: dict[str, set[str]] = {}
    if exists:
        _check_schema(df, path, partition)
        for day in store.partitions(path, partition):
            if start <= day < end:
                before[day] = {e.name for e in store.children(f"{path}/{partition}={day}")}
        stray = F.concat(F.lit(f"row outside the window [{start}, {end}): "), F.coalesce(partition, F.lit("null")))
        inside = F.when(in_window(partition, start, end), F.col(partition)).otherwise(F.raise_error(stray).cast("string"))
        df = df.withColumn(partition, inside)
    if rebalance:
        df = df.hint("rebalance", partition)
    seen = Observation()
    (
        df.observe(seen, F.count(F.lit(1)).alias("rows"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    )
    rows = seen.get["rows"]
    if rows == 0:
        raise ValueError(f"nothing to write: window [{start}, {end}) would become empty")
    for day, files in before.items():
        folder = f"{path}/{partition}={day}"
        if files & {e.name for e in store.children(folder) if not e.name.startswith(("_", "."))}:
            store.delete(folder)  # not rewritten: the new data has no such day
    df.sparkSession.catalog.refreshByPath(path)
    return rows
