"""Registered queries, each next to the SQL it is compared with."""

from lakeops.checks import (  # noqa: F401  (importing a module registers its queries)
    cleaning, dictionaries, documents, fixtures, forms_measures, history, imaging, quality, sinks, sources,
)
from lakeops.checks.base import ORACLES, QUERIES  # noqa: F401


def stage_inputs(spark, sf: str) -> None:
    """Write the inputs that queries read from storage, so that no query is the first to need them."""
    fixtures.obx_table(spark, sf)
    documents.parsed_path(spark, sf)
    fixtures.stored_objects(spark, sf)
    fixtures.cohort_file(spark, sf)
    imaging.study_facts(spark, sf)
    for fmt in ("parquet", "csv"):
        sources.split_parts(spark, sf, fmt)
    for key in ("s8_object_listing", "s10_manifest_index"):  # these write theirs themselves
        QUERIES[key](spark, sf)
