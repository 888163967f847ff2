"""Full refresh of several tables that become visible together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeops.sources.versions import VersionedTables


def to_declared(df: DataFrame, schema: StructType) -> DataFrame:
    """Columns named by the source header, cast to the declared types; the others are null."""
    unknown = [c for c in df.columns if c not in schema.names]
    if unknown:
        raise ValueError(f"column(s) {unknown} are not part of the table: {schema.names}")
    return df.select([
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema
    ])


def refresh_tables(spark: SparkSession, root: str, tables: dict[str, DataFrame], keep: int = 2) -> VersionedTables:
    """Replace tables of the set below ``root`` by new content, all of them or none.

    Every table is written to a folder of its own. Only when the last write has succeeded does one small
    file make all of them the current ones; whatever stops the refresh before leaves every table as
    it was. Folders of the ``keep`` newest states stay for readers that have started.
    """
    versions = VersionedTables(spark, root)
    change = versions.begin()
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(versions.folder(change, name))
    versions.commit(change, list(tables))
    versions.prune(keep)
    return versions
