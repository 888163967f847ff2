"""Tables that a query writes on the way, in the folder that the cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.session import scratch_dir
from lakeops.sources.store import Store


def written(df: DataFrame, name: str, *partition_by: str, block_bytes: int | None = None) -> DataFrame:
    """``df`` as a compressed table below ``spark.checkpoint.dir``, read back with its schema.

    Cuts the lineage: when an executor is lost, later stages read files instead of computing again.
    ``block_bytes`` is for rows of megabytes: writers and readers hold a row group, which Parquet lets grow
    to a hundred rows before it looks at its size.
    """
    path = scratch_dir(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if block_bytes:
        writer = writer.option("parquet.block.size", block_bytes).option("parquet.page.size.row.check.min", 1)
    writer.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few_by_hash(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows of ``df``, those with the smallest hashes of ``key``.

    For bounded samples: a bound on the hash, from the number of rows, leaves a small multiple of
    ``rows`` in all tasks together before anything is ordered or sent.
    """
    share = min(1.0, 4 * rows / max(1, df.count()))
    h = F.xxhash64(key)
    return df.where(h <= min(int(share * 2**64) - 2**63, 2**63 - 1)).orderBy(h, key).limit(rows)


def drop_written(df: DataFrame) -> None:
    """Remove the files of a table from ``written`` that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        Store(df.sparkSession).delete(folder)
