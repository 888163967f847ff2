"""Publishing a project: its released tables, its dictionary and its search documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeops.operators.catalog import TIMES, Catalog, dictionary, expand_lineage, published_resource
from lakeops.operators.nested import ID_COLUMNS, resource_docs, table_docs, variable_docs
from lakeops.session import durable, forget
from lakeops.sinks.bulk import write_bulk
from lakeops.sinks.release import check_version, publish_dictionary, publish_release
from lakeops.sources.registry import Registry


def publish_project(
    spark: SparkSession, registry: Registry, cat: Catalog, base: str, code: str, version: str, out: str,
    default_bucket: str, include_dictionary: bool = True,
) -> DataFrame:
    """Publish a release and, unless left out, its dictionary; returns the plan of the tables."""
    if not code:
        raise ValueError("a resource code is required")
    plan = publish_release(spark, registry, base, code, check_version(version), out, default_bucket)
    if include_dictionary:
        buckets = [r.bucket for r in plan.select("bucket").distinct().collect()]
        publish_dictionary(dictionary(cat, code, folded=True), out, code, version, buckets, default_bucket, TIMES)
    return plan


def publish_search(cat: Catalog, code: str, out: str) -> list[str]:
    """Write the three kinds of search documents; nothing is written for a hidden dictionary.

    The documents cover the whole catalog, because a resource's documents name its neighbours.
    """
    if published_resource(cat, code).isEmpty():
        return []
    written = []
    lineage = durable(expand_lineage(cat))  # the costly part, common to all three kinds
    for kind, build in (("resource_centric", resource_docs), ("table_centric", table_docs), ("variable_centric", variable_docs)):
        path = f"{out.rstrip('/')}/{kind}"
        write_bulk(build(cat, lineage=lineage), path, ID_COLUMNS[kind])
        written.append(path)
    forget(lineage)
    return written
