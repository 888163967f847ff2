"""Nested search documents: one per resource, table or variable.

Every source comes in parts, each a document of its own with the same header and a share of the nested
objects, so no array grows with its source and nothing is left out. The number of parts follows from
the number of nested objects by one rule; small sources have one. ``part`` is a field of every
document, and a bulk request names a document by source and part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.operators.catalog import Catalog, expand_lineage, index_counts, table_variable_counts
from lakeops.operators.skew import lookup_join
from lakeops.session import durable

# Nested objects that the index takes per document, and the id column of each index (fixed values).
RESOURCE_LIMIT = 135_000
TABLE_LIMIT = 50_000
VARIABLE_LIMIT = 50_000
ID_COLUMNS = {"resource_centric": "rs_id", "table_centric": "tab_id", "variable_centric": "var_id"}


def _parts(weights: DataFrame, key: str, limit: int) -> DataFrame:
    """Number of documents per key: one for each half ``limit`` of nested objects, begun or full. Objects go
    to parts by a hash, so a part holds half the limit on average."""
    total = weights.groupBy(key).agg(F.sum("weight").alias("_w"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("_w") * 2 / limit))
    return durable(total.select(key, parts.cast("int").alias("parts")))


def _part_of(item: Column) -> Column:
    return F.pmod(F.xxhash64(item), F.col("parts")).cast("int").alias("part")


def _nest(items: DataFrame, key: str, parts: DataFrame, item_id: str, shape: Column, name: str) -> DataFrame:
    """Arrays of ``shape`` by (key, part), sorted by their first field."""
    return (
        lookup_join(items, parts, [key])
        .select(key, _part_of(F.col(item_id)), shape.alias("_item"))
        .groupBy(key, "part").agg(F.sort_array(F.collect_list("_item")).alias(name))
    )


def _headers(df: DataFrame, key: str, parts: DataFrame) -> DataFrame:
    every = F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)
    return df.join(parts, key, "left").withColumn("part", F.explode(every)).drop("parts")


def _attach(headers: DataFrame, nested: DataFrame, key: str, name: str) -> DataFrame:
    joined = headers.join(nested, [key, "part"], "left")
    return joined.withColumn(name, F.coalesce(F.col(name), F.array().cast(joined.schema[name].dataType)))


def _lineage(cat: Catalog, lineage: DataFrame | None) -> DataFrame:
    """The expanded lineage, taken from the caller where several kinds of documents share it."""
    return expand_lineage(cat) if lineage is None else lineage


def _variables(cat: Catalog, lineage: DataFrame | None) -> DataFrame:
    owner = cat.dict_table.select(F.col("id").alias("tab_id"), F.col("resource_id").alias("rs_id"))
    labels = cat.variable.select(
        F.col("id").alias("var_id"), F.col("table_id").alias("tab_id"),
        F.col("label_fr").alias("var_label_fr"), F.col("label_en").alias("var_label_en"),
    )
    thin = F.transform("var_from_variables", lambda v: F.struct(v["var_id"].alias("var_id"), v["var_name"].alias("var_name"), v["published"].alias("published")))
    lineage = _lineage(cat, lineage).withColumn("var_from_variables", thin)
    whole = labels.join(owner, "tab_id").join(lineage, "var_id").withColumn(
        "weight", 1 + F.size("var_from_variables") + F.size("var_from_source_systems")
    )
    return durable(whole)  # read for the sizes of the documents and again for their content


_VARIABLE = ["var_id", "var_name", "var_label_fr", "var_label_en", "var_from_variables", "var_from_source_systems"]


def _resource_header(cat: Catalog) -> DataFrame:
    r = cat.resource
    keep = [
        ("id", "rs_id"), ("code", "rs_code"), ("name", "rs_name"), ("title", "rs_title"), ("resource_type", "rs_type"),
        ("description_en", "rs_description_en"), ("description_fr", "rs_description_fr"),
    ]
    more = [
        "system_collection_starting_year", "dict_current_version", "system_database_type", "project_creation_date",
        "project_completion_date", "last_update", "project_approval_date", "project_approved", "project_folder",
        "project_status", "project_erb_id",
    ]
    names = [F.col(a).alias(b) for a, b in keep if a in r.columns]
    names += [F.col(a).alias(f"rs_{a}") for a in more if a in r.columns]
    if "project_principal_investigator" in r.columns:
        names.append(F.col("project_principal_investigator").alias("rs_project_pi"))
    return r.select(*names, (F.col("resource_type") == "research_project").alias("rs_is_project"), "project_analyst_id")


def resource_docs(cat: Catalog, limit: int = RESOURCE_LIMIT, lineage: DataFrame | None = None) -> DataFrame:
    variables = _variables(cat, lineage)
    tables = cat.dict_table.select(
        F.col("resource_id").alias("rs_id"), F.col("id").alias("tab_id"), F.col("name").alias("tab_name"),
        F.col("label_fr").alias("tab_label_fr"), F.col("label_en").alias("tab_label_en"),
    )
    weights = variables.select("rs_id", "weight").unionByName(tables.select("rs_id", F.lit(1).alias("weight")))
    parts = _parts(weights, "rs_id", limit)
    counts = index_counts(cat)
    stats = counts.select("rs_id", F.struct(*[c for c in counts.columns if c != "rs_id"]).alias("stat_etl"))
    analysts = cat.analyst.select(
        F.col("id").alias("project_analyst_id"),
        F.struct(F.col("id").alias("analyst_id"), F.col("name").alias("analyst_name")).alias("rs_analyst"),
    )
    docs = _resource_header(cat).join(stats, "rs_id").join(analysts, "project_analyst_id", "left").drop("project_analyst_id")
    docs = _headers(docs, "rs_id", parts)
    docs = _attach(docs, _nest(variables, "rs_id", parts, "var_id", F.struct(*_VARIABLE), "variables"), "rs_id", "variables")
    shape = F.struct("tab_id", "tab_name", "tab_label_fr", "tab_label_en")
    return _attach(docs, _nest(tables, "rs_id", parts, "tab_id", shape, "tables"), "rs_id", "tables")


def _resource_struct(cat: Catalog) -> DataFrame:
    names = ["rs_id", "rs_code", "rs_is_project", "rs_description_en", "rs_description_fr", "rs_type", "rs_name", "rs_title"]
    header = _resource_header(cat)
    return header.select("rs_id", F.struct(*[n for n in names if n in header.columns]).alias("resource"))


def table_docs(cat: Catalog, limit: int = TABLE_LIMIT, lineage: DataFrame | None = None) -> DataFrame:
    variables = _variables(cat, lineage)
    parts = _parts(variables, "tab_id", limit)
    stats = table_variable_counts(cat).select("tab_id", F.struct("variable_count").alias("stat_etl"))
    extra = [c for c in ("created_at", "domain", "entity_type", "last_update", "row_filter") if c in cat.dict_table.columns]
    docs = cat.dict_table.select(
        F.col("id").alias("tab_id"), F.col("resource_id").alias("rs_id"), F.col("name").alias("tab_name"),
        F.col("label_en").alias("tab_label_en"), F.col("label_fr").alias("tab_label_fr"),
        *[F.col(c).alias(f"tab_{c}") for c in extra],
    ).join(_resource_struct(cat), "rs_id").drop("rs_id").join(stats, "tab_id")
    docs = _headers(docs, "tab_id", parts)
    return _attach(docs, _nest(variables, "tab_id", parts, "var_id", F.struct(*_VARIABLE), "variables"), "tab_id", "variables")


def variable_heads(cat: Catalog, limit: int = VARIABLE_LIMIT, lineage: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Variables with their owner and parents, and the parts of the value sets, which ``vs_id`` of both leads to."""
    codes = cat.value_set_code.select(F.col("value_set_id").alias("vs_id"), F.col("code").alias("vsval_code"),
                                      F.col("label_en").alias("vsval_label_en"), F.col("label_fr").alias("vsval_label_fr"))
    parts = _parts(codes.withColumn("weight", F.lit(1)), "vs_id", limit)
    shape = F.struct("vsval_code", "vsval_label_en", "vsval_label_fr")
    sets = _headers(
        cat.value_set.select(F.col("id").alias("vs_id"), F.col("name").alias("vs_name"),
                             *[F.col(c).alias(f"vs_{c}") for c in ("description_en", "description_fr") if c in cat.value_set.columns]),
        "vs_id", parts,
    )
    sets = _attach(sets, _nest(codes, "vs_id", parts, "vsval_code", shape, "values"), "vs_id", "values")
    value_set = F.struct(*[c for c in sets.columns if c != "part"]).alias("value_set")
    tables = cat.dict_table.select(
        F.col("id").alias("tab_id"), F.col("resource_id").alias("rs_id"),
        F.struct(F.col("id").alias("tab_id"), F.col("label_fr").alias("tab_label_fr"), F.col("label_en").alias("tab_label_en"),
                 F.col("name").alias("tab_name")).alias("table"),
    )
    extra = [c for c in ("last_update", "created_at", "derivation_algorithm", "notes", "value_type", "path") if c in cat.variable.columns]
    header = cat.variable.select(
        F.col("id").alias("var_id"), F.col("table_id").alias("tab_id"), F.col("value_set_id").alias("vs_id"),
        F.col("label_en").alias("var_label_en"), F.col("label_fr").alias("var_label_fr"),
        *([F.col("variable_status").alias("var_status")] if "variable_status" in cat.variable.columns else []),
        *[F.col(c).alias(f"var_{c}") for c in extra],
    )
    heads = header.join(tables, "tab_id").join(_resource_struct(cat), "rs_id").drop("tab_id", "rs_id").join(_lineage(cat, lineage), "var_id")
    return heads, sets.select("vs_id", "part", value_set)


def variable_docs(cat: Catalog, limit: int = VARIABLE_LIMIT, lineage: DataFrame | None = None) -> DataFrame:
    """Variables with their owner, parents and value set; the codes are what may need parts."""
    heads, sets = variable_heads(cat, limit, lineage)
    return heads.join(sets, "vs_id", "left").drop("vs_id").fillna(0, ["part"])
