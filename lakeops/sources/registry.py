"""Dataset registry: ids, the storage behind them, and wildcard selection."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Storage:
    id: str
    path: str  # base URI, any number of levels


@dataclass(frozen=True)
class Dataset:
    id: str
    storage: str
    path: str  # relative to the storage
    format: str = "parquet"
    options: dict = field(default_factory=dict, hash=False, compare=False)


class Registry:
    """An in-memory table of datasets; it holds names and paths, never data."""

    def __init__(self, storages: Iterable[Storage], datasets: Iterable[Dataset]):
        self._storages = {s.id: s for s in storages}
        self._datasets = {d.id: d for d in datasets}

    def select(self, wanted: Iterable[str]) -> list[Dataset]:
        """Datasets matching any id or wildcard, each once, in id order.

        Names that match nothing are ignored as long as one dataset is found.
        """
        wanted = sorted(set(wanted))
        tests = [re.compile(".*".join(map(re.escape, w.split("*")))) for w in wanted]
        chosen = [d for i, d in sorted(self._datasets.items()) if any(t.fullmatch(i) for t in tests)]
        if not chosen:
            raise LookupError(f"no dataset matches {wanted}")
        return chosen

    def storages_behind(self, datasets: Iterable[Dataset]) -> list[Storage]:
        return [self._storages[s] for s in sorted({d.storage for d in datasets})]

    def _storage_of(self, dataset_id: str) -> tuple[Dataset, Storage]:
        try:
            dataset = self._datasets[dataset_id]
            return dataset, self._storages[dataset.storage]
        except KeyError as missing:
            raise LookupError(f"{missing} is not registered") from None

    def bucket(self, dataset_id: str) -> str:
        _, storage = self._storage_of(dataset_id)
        return storage.path.partition("://")[2].split("/")[0]

    def uri(self, dataset_id: str, scheme: str | None = None) -> str:
        """Full address of a dataset, with exactly one slash between base and relative path."""
        dataset, storage = self._storage_of(dataset_id)
        base = storage.path
        if scheme and "://" in base:
            base = f"{scheme}://{base.partition('://')[2]}"
        return f"{base.rstrip('/')}/{dataset.path.lstrip('/')}"

    def bucket_of_resource(self, subzone: str, resource: str) -> str:
        """Bucket of the first dataset of a resource; ``ab`` never selects a dataset of ``abc``."""
        stem = f"{subzone}_{resource}"
        for dataset_id in sorted(self._datasets):
            if dataset_id == stem or dataset_id.startswith(f"{stem}_"):
                return self.bucket(dataset_id)
        raise LookupError(f"resource {resource} has no {subzone} dataset")


def read_dataset(spark: SparkSession, registry: Registry, dataset: Dataset) -> DataFrame:
    return spark.read.format(dataset.format).options(**dataset.options).load(registry.uri(dataset.id))


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_matching(spark: SparkSession, registry: Registry, wanted: Iterable[str]) -> DataFrame:
    """Union by name of every selected dataset, tagged with its id in ``_dataset``."""
    return union_by_name([
        read_dataset(spark, registry, d).withColumn("_dataset", F.lit(d.id)) for d in registry.select(wanted)
    ])
