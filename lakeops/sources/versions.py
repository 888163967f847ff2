"""Sets of tables that change together, on storage where only whole small files appear at once.

Each change writes its tables to folders of its own and then one small file that names, for every table
of the set, the folder it is read from. The newest such file is the state of the set. Nothing is
renamed, overwritten or missing in between: a change that stops before its last step has not
happened, and the next one starts from the state before it.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from lakeops.sources.store import Store


class VersionedTables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self._store = spark, root.rstrip("/"), Store(spark)

    def _states(self) -> list[str]:
        return [e.name for e in self._store.children(f"{self.root}/_states") if e.name.isdigit()]

    def _mapping(self) -> dict[str, str]:
        states = self._states()
        return json.loads(self._store.read_text(f"{self.root}/_states/{states[-1]}")) if states else {}

    def names(self) -> list[str]:
        return sorted(self._mapping())

    def path(self, name: str) -> str:
        """Where a table is read from now."""
        return f"{self.root}/{self._mapping()[name]}"

    def read(self, name: str, schema: StructType | None = None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(self.path(name))

    def begin(self) -> str:
        """A name for a change; its tables are written below ``folder(change, table)``."""
        used = [*self._states(), *(e.name for e in self._store.children(f"{self.root}/data"))]
        return f"{1 + max((int(u) for u in used if u.isdigit()), default=0):08d}"

    def folder(self, change: str, name: str) -> str:
        return f"{self.root}/data/{change}/{name}"

    def commit(self, change: str, names: list[str]) -> None:
        """Let the tables ``names`` of a change take effect, all at once; other tables stay as they are."""
        state = {**self._mapping(), **{n: f"data/{change}/{n}" for n in names}}
        self._store.write_text(f"{self.root}/_states/{change}", json.dumps(state, sort_keys=True))

    def prune(self, keep: int = 2) -> None:
        """Drop the folders that none of the ``keep`` newest states names, and the older states."""
        states = self._states()
        kept = states[-keep:]
        used = {path for s in kept for path in json.loads(self._store.read_text(f"{self.root}/_states/{s}")).values()}
        for s in states[:-keep]:
            self._store.delete(f"{self.root}/_states/{s}")
        for change in self._store.children(f"{self.root}/data"):
            for table in self._store.children(change.path):
                if f"data/{change.name}/{table.name}" not in used and change.name <= kept[-1]:
                    self._store.delete(table.path)
