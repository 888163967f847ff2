"""Index of scanned documents built from daily manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lakeops.operators.ordering import latest_per_key
from lakeops.operators.skew import lookup_join
from lakeops.sinks.upsert import upsert


def index_documents(manifests: DataFrame | None, types: DataFrame, key: str, type_key: str, order: list[str]) -> DataFrame | None:
    """One row per document with its type's name and barcode; unknown types stay, with nulls.

    A document listed several times, on one day or on different ones, keeps its latest line. Nothing
    comes out when there is no manifest.
    """
    if manifests is None:
        return None
    return lookup_join(latest_per_key(manifests, [key], order), types, [type_key], "left")


def update_index(target: DataFrame, fresh: DataFrame | None, key: str) -> DataFrame:
    """Target index after the manifests of a run."""
    return target if fresh is None else upsert(target, fresh, [key])
