"""Registration of queries and access to the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from lakeops.session import scratch_dir
from lakeops.sources.store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Named common table expressions, in dependency order.
CTES: dict[str, str] = {}


def query(key: str, sql: str | None = None, using: tuple[str, ...] = ()):
    """Register a query; ``using`` names the expressions its SQL builds on."""

    def register(build):
        QUERIES[key] = build
        if sql is not None:
            named = ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in CTES if n in using)
            ORACLES[key] = f"WITH {named}\n{sql.strip()}" if named else sql.strip()
        return build

    return register


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One of the given tables; its schema is inferred once, as a metastore would know it."""
    path = f"{sf}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


_STAGED: dict[tuple[str, str, str], str] = {}


def staged(spark: SparkSession, sf: str, name: str, write: Callable[[str], None]) -> str:
    """Path of an input that a query reads from storage, written once per session and scale."""
    key = (spark.sparkContext.applicationId, sf, name)
    path = _STAGED.get(key)
    if path is None or not Store(spark).exists(path):
        path = scratch_dir(spark, name)
        write(path)
        _STAGED[key] = path
    return path
