"""Catalog queries."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lakeops.checks import fixtures as fx
from lakeops.checks.base import query, table
from lakeops.functions.text import fold_keyword
from lakeops.operators.catalog import (
    SHEETS, TIMES, Catalog, constraint_violations, dictionary, expand_lineage, index_counts, scan_metadata, table_variable_counts,
)
from lakeops.operators.nested import resource_docs, table_docs, variable_docs, variable_heads
from lakeops.plans.catalog_load import load_catalog
from lakeops.sources.registry import union_by_name
from lakeops.sources.versions import VersionedTables
from lakeops.session import durable, scratch_dir
from lakeops.sinks.bulk import Shared, fold_bulk, write_bulk
from lakeops.sinks.release import publish_dictionary, read_folded

CODE = "africa"
_ALL = ("resource", "analyst", "dict_table", "variable", "value_set", "value_set_code", "mapping")
_AFRICA = (*_ALL, "africa_tables", "africa_variables")
_LINEAGE = (*_ALL, "parents", "systems", "lineage", "counts")


def _sheet(name, columns):
    return lambda spark, sf: SHEETS[name](fx.catalog(spark, sf), CODE).select(*columns)


def _register(key, sheet, columns, sql):
    query(key, sql, _AFRICA)(_sheet(sheet, columns))


_register("j1_resource", "Resource", ["id", "code", "name", "resource_type", "publish_dictionary"], """
    SELECT id, code, name, resource_type, publish_dictionary FROM resource WHERE code = 'africa' AND publish_dictionary
""")
_register("j2_dict_tables", "Dict Tables", ["id", "resource_id", "name", "domain"],
          "SELECT id, resource_id, name, domain FROM africa_tables")
_register("j3_variables", "Variable", ["id", "table_id", "name", "path", "value_set_id"],
          "SELECT id, table_id, name, path, value_set_id FROM africa_variables")
_register("j4_value_sets", "Value Sets", ["id", "name"], """
    SELECT s.id, s.name FROM value_set s JOIN africa_variables v ON v.value_set_id = s.id
""")
_register("j5_value_set_codes", "Value Set Codes", ["id", "value_set_id", "code"], """
    SELECT c.id, c.value_set_id, c.code FROM value_set_code c JOIN africa_variables v ON v.value_set_id = c.value_set_id
""")
_register("j6_mappings", "Mappings", ["value_set_code_id", "original_value"], """
    SELECT m.value_set_code_id, m.original_value FROM mapping m
    JOIN value_set_code c ON c.id = m.value_set_code_id JOIN africa_variables v ON v.value_set_id = c.value_set_id
""")


def _told(name, first, second):
    return F.array_join(F.transform(name, lambda x: F.concat_ws(":", x[first], x[second], x["published"].cast("string"))), ",")


@query("j12_lineage_expand", "SELECT * FROM lineage", _LINEAGE)
def j12_lineage_expand(spark, sf):
    return expand_lineage(fx.catalog(spark, sf)).select(
        "var_id", "var_name", F.size("var_from_variables").cast("bigint").alias("n_parents"),
        _told("var_from_variables", "var_id", "var_name").alias("parents"),
        F.size("var_from_source_systems").cast("bigint").alias("n_systems"),
        _told("var_from_source_systems", "rs_id", "rs_code").alias("systems"),
    )


@query("g3_index_counts", """
    SELECT 'resource' AS kind, CAST(rs_id AS BIGINT) AS id, project_count, domain_count, source_system_count, variable_count, table_count FROM counts
    UNION ALL
    SELECT 'table', t.id, NULL, NULL, NULL, (SELECT count(*) FROM variable v WHERE v.table_id = t.id), NULL FROM dict_table t
""", _LINEAGE)
def g3_index_counts(spark, sf):
    cat = fx.catalog(spark, sf)
    resources = index_counts(cat).select(
        F.lit("resource").alias("kind"), F.col("rs_id").cast("bigint").alias("id"), "project_count", "domain_count",
        "source_system_count", "variable_count", "table_count",
    )
    tables = table_variable_counts(cat).select(F.lit("table").alias("kind"), F.col("tab_id").cast("bigint").alias("id"), "variable_count")
    return resources.unionByName(tables, allowMissingColumns=True)


def _array_facts(name, field):
    c = F.col(name)
    return (
        F.size(c).cast("bigint").alias(f"n_{name}"),
        F.get(c, F.lit(0))[field].alias(f"first_{name}"), F.get(c, F.size(c) - 1)[field].alias(f"last_{name}"),
    )


def _digest(items, name, *fields):
    """One text for all nested objects of a document, in their order."""
    texts = F.transform(items, lambda v: F.concat_ws(":", *[v[f].cast("string") for f in fields]))
    return F.md5(F.array_join(texts, ",")).alias(f"{name}_md5")


@query("d1_resource_centric", """
    SELECT coalesce(v.digest, md5('')) AS variables_md5, coalesce(t.digest, md5('')) AS tables_md5, r.id AS rs_id, 0 AS part, r.code AS rs_code, r.resource_type = 'research_project' AS rs_is_project,
           a.name AS analyst_name, c.project_count, c.variable_count, c.table_count,
           coalesce(v.n, 0) AS n_variables, v.first_var AS first_variables, v.last_var AS last_variables,
           coalesce(v.parents, 0) AS n_parents, coalesce(t.n, 0) AS n_tables, t.first_tab AS first_tables, t.last_tab AS last_tables
    FROM resource r LEFT JOIN analyst a ON a.id = r.project_analyst_id JOIN counts c ON c.rs_id = r.id
    LEFT JOIN (SELECT t.resource_id, count(*) AS n, min(v.id) AS first_var, max(v.id) AS last_var,
                      md5(string_agg(v.id || ':' || v.name, ',' ORDER BY v.id)) AS digest,
                      CAST(sum(l.n_parents) AS BIGINT) AS parents
               FROM variable v JOIN dict_table t ON t.id = v.table_id JOIN lineage l ON l.var_id = v.id GROUP BY 1) v ON v.resource_id = r.id
    LEFT JOIN (SELECT resource_id, count(*) AS n, min(id) AS first_tab, max(id) AS last_tab,
                      md5(string_agg(id || ':' || name, ',' ORDER BY id)) AS digest FROM dict_table GROUP BY 1) t
           ON t.resource_id = r.id
""", _LINEAGE)
def d1_resource_centric(spark, sf):
    parents = F.aggregate("variables", F.lit(0).cast("bigint"), lambda a, v: a + F.size(v["var_from_variables"]))
    return resource_docs(fx.catalog(spark, sf)).select(
        _digest("variables", "variables", "var_id", "var_name"), _digest("tables", "tables", "tab_id", "tab_name"), "rs_id", "part", "rs_code", "rs_is_project", "rs_analyst.analyst_name",
        "stat_etl.project_count", "stat_etl.variable_count", "stat_etl.table_count",
        *_array_facts("variables", "var_id"), parents.alias("n_parents"), *_array_facts("tables", "tab_id"),
    )


@query("d2_table_centric", """
    SELECT coalesce(v.digest, md5('')) AS variables_md5, t.id AS tab_id, 0 AS part, t.name AS tab_name, t.domain AS tab_domain, r.code AS rs_code,
           coalesce(v.n, 0) AS variable_count, coalesce(v.n, 0) AS n_variables, v.first_var AS first_variables,
           v.last_var AS last_variables, coalesce(v.systems, 0) AS n_systems
    FROM dict_table t JOIN resource r ON r.id = t.resource_id
    LEFT JOIN (SELECT v.table_id, count(*) AS n, min(v.id) AS first_var, max(v.id) AS last_var,
                      md5(string_agg(v.id || ':' || v.name, ',' ORDER BY v.id)) AS digest,
                      CAST(sum(l.n_systems) AS BIGINT) AS systems
               FROM variable v JOIN lineage l ON l.var_id = v.id GROUP BY 1) v ON v.table_id = t.id
""", _LINEAGE)
def d2_table_centric(spark, sf):
    systems = F.aggregate("variables", F.lit(0).cast("bigint"), lambda a, v: a + F.size(v["var_from_source_systems"]))
    return table_docs(fx.catalog(spark, sf)).select(
        _digest("variables", "variables", "var_id", "var_name"), "tab_id", "part", "tab_name", "tab_domain", "resource.rs_code", "stat_etl.variable_count",
        *_array_facts("variables", "var_id"), systems.alias("n_systems"),
    )


@query("d3_variable_centric", """
    SELECT c.digest AS codes_md5, v.id AS var_id, 0 AS part, v.name AS var_name, v.path AS var_path, t.name AS tab_name, r.code AS rs_code,
           l.n_parents, l.n_systems, s.name AS vs_name, c.n AS n_values, c.first_code AS first_values, c.last_code AS last_values
    FROM variable v JOIN dict_table t ON t.id = v.table_id JOIN resource r ON r.id = t.resource_id
    JOIN lineage l ON l.var_id = v.id LEFT JOIN value_set s ON s.id = v.value_set_id
    LEFT JOIN (SELECT value_set_id, count(*) AS n, min(code) AS first_code, max(code) AS last_code,
                      md5(string_agg(code, ',' ORDER BY code)) AS digest FROM value_set_code GROUP BY 1) c
           ON c.value_set_id = s.id
""", _LINEAGE)
def d3_variable_centric(spark, sf):
    docs = variable_docs(fx.catalog(spark, sf)).withColumn("values", F.col("value_set.values"))
    return docs.select(
        _digest("values", "codes", "vsval_code"), "var_id", "part", "var_name", "var_path", "table.tab_name", "resource.rs_code",
        F.size("var_from_variables").cast("bigint").alias("n_parents"),
        F.size("var_from_source_systems").cast("bigint").alias("n_systems"), "value_set.vs_name",
        *_array_facts("values", "vsval_code"),
    ).withColumn("n_values", F.when(F.col("n_values") >= 0, F.col("n_values")))


@query("k8_index_documents", """
    SELECT d.chunk, d.var_id, v.name AS var_name, count(*) AS n_documents, min(d.ordinal) AS first_ordinal,
           any_value(coalesce(c.n, 0)) AS n_codes, any_value(coalesce(c.digest, md5(''))) AS codes_md5
    FROM (SELECT var_id, row_number() OVER (ORDER BY var_id, part) - 1 AS ordinal, (row_number() OVER (ORDER BY var_id, part) - 1) // 30 AS chunk
          FROM (SELECT v.id AS var_id, unnest(range(CAST(greatest(1, ceil(coalesce(c.n, 0) * 2 / 8.0)) AS BIGINT))) AS part
                FROM variable v LEFT JOIN (SELECT value_set_id, count(*) AS n FROM value_set_code GROUP BY 1) c ON c.value_set_id = v.value_set_id)) d
    JOIN variable v ON v.id = d.var_id
    LEFT JOIN (SELECT value_set_id, count(*) AS n, md5(string_agg(code, ',' ORDER BY code)) AS digest FROM value_set_code GROUP BY 1) c
           ON c.value_set_id = v.value_set_id
    GROUP BY d.chunk, d.var_id, v.name
""", _ALL)
def k8_index_documents(spark, sf):
    """Documents are delivered as JSON lines and read back chunk by chunk, by their byte ranges. Small chunks and
    small parts show that chunks keep the order, and that no nested object is lost between documents. A value set
    is written once and set into the documents of every variable that refers to it as they are read."""
    path = scratch_dir(spark, "bulk")
    heads, sets = variable_heads(fx.catalog(spark, sf), limit=8)
    write_bulk(heads, path, "var_id", chunk=30, shared=Shared(sets, "vs_id"))
    return durable(fold_bulk(spark, path, _fold_variables, "chunk bigint, var_id bigint, var_name string, n_documents bigint, first_ordinal bigint, n_codes bigint, codes_md5 string"))


_SOURCE, _PART = b'"_source":', b',"part":'
#: Bytes of ends of documents that are remembered, and rows of a batch.
_REMEMBERED, _FOLDED_ROWS = 1 << 26, 20_000


def _fold_variables(blocks):
    """Documents by chunk and variable, and the codes of the variable's documents, which follow each other.

    All documents of a variable begin alike up to their part, and those of variables of one value set end alike. A
    beginning or end that is byte for byte that of the document before, or of the variable before, is not parsed again."""
    def told():
        nonlocal alike, n, digest
        if ends != alike:
            codes = [c for end in ends for c in end]
            alike, n, digest = ends, len(codes), hashlib.md5(",".join(sorted(c for c in codes if c is not None)).encode()).hexdigest()
        chunks, first, counts = np.unique(np.concatenate(places[0]), return_index=True, return_counts=True)
        size = len(chunks)
        return pa.RecordBatch.from_pydict({
            "chunk": pa.array(chunks), "var_id": pa.array([variable[0]] * size, pa.int64()), "var_name": pa.array([variable[1]] * size, pa.string()),
            "n_documents": pa.array(counts, pa.int64()), "first_ordinal": pa.array(np.concatenate(places[1])[first]),
            "n_codes": pa.array([n] * size, pa.int64()), "codes_md5": pa.array([digest] * size, pa.string())})

    begin, variable, ends, places = None, None, [], ([], [])
    alike, n, digest = None, 0, ""
    known, held, ready, rows = [], 0, [], 0
    for chunks, ordinal, text in blocks:
        at = since = 0
        for i in range(len(chunks)):
            source = text.index(_SOURCE, at)
            if begin is None or not text.startswith(begin, source):
                if begin is not None:
                    places[0].append(chunks[since:i])
                    places[1].append(np.arange(ordinal + since, ordinal + i))
                    ready.append(told())
                    rows += ready[-1].num_rows
                begin, since, ends, places = text[source:text.index(_PART, source) + len(_PART)], i, [], ([], [])
                whole = json.loads(text[at:].partition(b"\n")[0])["_source"]
                variable = whole["var_id"], whole["var_name"]
            part = source + len(begin)
            end, codes = known[len(ends)] if len(ends) < len(known) else (b"\n", ())
            at = part + len(end)
            if not (text.startswith(end, part) and (at >= len(text) or text[at] == 10)):
                at = text.find(b"\n", part)
                old, end = end, text[part:at if at >= 0 else len(text)]
                at = part + len(end)
                values = (json.loads(b'{"part":' + end[:-1])["value_set"] or {}).get("values")
                codes = tuple(v["vsval_code"] for v in values or ())
                if len(ends) < len(known):
                    known[len(ends)], held = (end, codes), held + len(end) - len(old)
                elif len(ends) == len(known) and held < _REMEMBERED:
                    known.append((end, codes))
                    held += len(end)
            at += 1
            ends.append(codes)
        places[0].append(chunks[since:])
        places[1].append(np.arange(ordinal + since, ordinal + len(chunks)))
        if rows >= _FOLDED_ROWS:
            yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
            ready, rows = [], 0
    if begin is not None:
        ready.append(told())
    if ready:
        yield from pa.Table.from_batches(ready).combine_chunks().to_batches()


# What tells the rows of each published sheet apart.
_SHEET_KEYS = {
    "Resource": ("id", "code"), "Dict Tables": ("id", "name"), "Variable": ("id", "path"), "Value Sets": ("id", "name"),
    "Value Set Codes": ("id", "code"), "Mappings": ("value_set_code_id", "original_value"),
}


@query("k7_publish_dictionary", """
    SELECT sheet, a || ':' || b AS content, count(*) AS n FROM (
        SELECT 'Resource' AS sheet, id AS a, code AS b FROM resource WHERE code = 'africa' AND publish_dictionary
        UNION ALL SELECT 'Dict Tables', id, name FROM africa_tables
        UNION ALL SELECT 'Variable', id, path FROM africa_variables
        UNION ALL SELECT 'Value Sets', s.id, s.name FROM value_set s JOIN africa_variables v ON v.value_set_id = s.id
        UNION ALL SELECT 'Value Set Codes', c.id, c.code FROM value_set_code c JOIN africa_variables v ON v.value_set_id = c.value_set_id
        UNION ALL SELECT 'Mappings', m.value_set_code_id, m.original_value
                  FROM mapping m JOIN value_set_code c ON c.id = m.value_set_code_id JOIN africa_variables v ON v.value_set_id = c.value_set_id
    ) AS sheets GROUP BY 1, 2
""", _AFRICA)
def k7_publish_dictionary(spark, sf):
    """The sheets are published and read back: every row, with its multiplicity. Copies are written out one by one,
    and counted where they are read."""
    sheets = dictionary(fx.catalog(spark, sf), CODE, folded=True)
    folder = publish_dictionary(sheets, scratch_dir(spark, "dictionary"), CODE, "2024-02-02", ["open-shelf", "published-clinical-shop"], "open-shelf", TIMES)
    found = []
    for sheet, (a, b) in _SHEET_KEYS.items():
        rows = read_folded(spark, f"{folder}/{sheet.lower().replace(' ', '_')}")
        found.append(rows.groupBy(F.concat_ws(":", a, b).alias("content")).agg(F.sum(TIMES).alias("n")).select(F.lit(sheet).alias("sheet"), "content", "n"))
    return union_by_name(found)


_SCANNED = {
    "benchmark": "item_id integer, text string",
    "conversations": "conv_id integer, turn integer, role string, text string",
    "labels": "doc_id integer, quality integer, toxic integer",
    "pages": "page_id integer, url string, html string",
    "customer": "c_custkey integer, c_name string, c_nationkey integer, c_acctbal decimal, c_mktsegment string",
    "documents": "doc_id integer, text string, lang string, source string, n_chars integer",
    "embeddings": "vec_id integer, embedding array, label integer",
    "events": "event_id integer, ts datetime, user_id integer, event_type string, value decimal, props string",
    "lineitem": "l_orderkey integer, l_partkey integer, l_suppkey integer, l_linenumber integer, l_quantity decimal, "
                "l_extendedprice decimal, l_discount decimal, l_tax decimal, l_returnflag string, l_linestatus string, l_shipdate datetime",
    "nation": "n_nationkey integer, n_name string, n_regionkey integer",
    "orders": "o_orderkey integer, o_custkey integer, o_orderstatus string, o_totalprice decimal, o_orderdate datetime, o_orderpriority string",
    "part": "p_partkey integer, p_name string, p_brand string, p_type string, p_size integer, p_retailprice decimal",
    "region": "r_regionkey integer, r_name string",
    "supplier": "s_suppkey integer, s_name string, s_nationkey integer, s_acctbal decimal",
}


def _scan_sql():
    lines = []
    for name, columns in _SCANNED.items():
        for column in columns.split(", "):
            c, kind = column.split()
            lines.append(
                f"SELECT 'shop' AS resource, '{name}' AS table_name, '{c}' AS name, 'shop.{name}.{c}' AS path, '{kind}' AS value_type, "
                f"'current' AS rolling_version, count({c}) AS n_values, count(DISTINCT {c}) AS n_distinct FROM {name}"
            )
    return "\nUNION ALL ".join(lines)


@query("m4_scan_metadata", _scan_sql())
def m4_scan_metadata(spark, sf):
    return scan_metadata(spark, "shop", {name: table(spark, sf, name) for name in _SCANNED})


_REFERENCES = {
    "analyst": [], "resource": [("project_analyst_id", "analyst")], "dict_table": [("resource_id", "resource")], "value_set": [],
    "value_set_code": [("value_set_id", "value_set")], "variable": [("table_id", "dict_table"), ("value_set_id", "value_set")],
    "mapping": [("value_set_code_id", "value_set_code")],
}


def _load_sql():
    lines = []
    for position, (name, references) in enumerate(_REFERENCES.items()):
        orphans = " + ".join(
            f"(SELECT count(*) FROM {name} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT id FROM {parent}))" for c, parent in references) or "0"
        new = "count(*) FILTER (value_set_code_id % 3 = 0)" if name == "mapping" else "0"
        ids = "CAST(NULL AS BIGINT)" if name == "mapping" else "CAST(sum(id) AS BIGINT)"
        changed = "count(*)" if name == "variable" else "0"
        lines.append(f"SELECT '{name}' AS table_name, {position} AS position, count(*) AS n_rows, CAST({new} AS BIGINT) AS n_new, "
                     f"CAST({orphans} AS BIGINT) AS n_orphans, {ids} AS id_sum, CAST({changed} AS BIGINT) AS n_changed FROM {name}")
    return "\nUNION ALL ".join(lines)


@query("m5_load_order", _load_sql(), _ALL)
def m5_load_order(spark, sf):
    """A second load brings the rows under other ids, new names of variables and mappings that the first
    lacked. Ids and the references to them stay those of the first load."""
    cat = fx.catalog(spark, sf)
    root = scratch_dir(spark, "catalog")
    load_catalog(spark, Catalog(**{**cat.__dict__, "mapping": cat.mapping.where("value_set_code_id % 3 <> 0")}), root)
    moved = {"analyst": 1000, "resource": 7, "value_set": 31, "value_set_code": 500_000}

    def renumbered(name):
        df = getattr(cat, name)
        shifts = {"id": moved.get(name, 0), **{c: moved.get(parent, 0) for c, parent in _REFERENCES[name]}}
        return df.withColumns({c: (F.col(c) + n).cast(df.schema[c].dataType) for c, n in shifts.items() if c in df.columns})

    later = {name: renumbered(name) for name in _REFERENCES}
    later["variable"] = later["variable"].withColumn("name", F.concat("name", F.lit("+")))
    summary = load_catalog(spark, Catalog(**later), root)
    tables = VersionedTables(spark, root)
    facts = []
    for name in _REFERENCES:
        df = tables.read(name)
        ids = F.sum("id").cast("bigint") if "id" in df.columns else F.lit(None).cast("bigint")
        changed = F.count_if(F.endswith("name", F.lit("+"))) if name == "variable" else F.lit(0).cast("bigint")
        facts.append(df.agg(ids.alias("id_sum"), changed.alias("n_changed")).select(F.lit(name).alias("table_name"), "id_sum", "n_changed"))
    return summary.join(union_by_name(facts), "table_name")


_RULES = {
    "analyst": ["not null name", "primary key id", "unique name"],
    "resource": [
        "not null code", "not null name", "not null resource_type", "not null description_en", "not null description_fr",
        "not null publish_dictionary", "not null publish_summary", "not null recurring", "allowed resource_type",
        "primary key id", "unique code", "reference project_analyst_id",
    ],
    "dict_table": [
        "not null resource_id", "not null name", "primary key id", "unique resource_id, name", "reference resource_id",
    ],
    "value_set": ["not null name", "primary key id", "unique name"],
    "value_set_code": [
        "not null value_set_id", "not null code", "not null label_fr", "not null label_en", "primary key id",
        "unique value_set_id, code", "reference value_set_id",
    ],
    "variable": [
        "not null table_id", "not null name", "not null path", "not null rolling_version", "allowed value_type",
        "allowed rolling_version", "primary key id", "unique path", "reference table_id",
    ],
    "mapping": ["not null original_value", "unique value_set_code_id, original_value"],
}
_HOLDING = ", ".join(f"('{t}', '{rule}', CAST(0 AS BIGINT))" for t, rules in _RULES.items() for rule in rules)


@query("m6_constraints", f"""
    SELECT * FROM (VALUES {_HOLDING}) v("table", rule, n)
    UNION ALL SELECT 'variable', 'reference value_set_id',
                     count(*) FROM variable WHERE value_set_id IS NOT NULL AND value_set_id NOT IN (SELECT id FROM value_set)
    UNION ALL SELECT 'mapping', 'not null value_set_code_id', count(*) FROM broken WHERE value_set_code_id IS NULL
    UNION ALL SELECT 'mapping', 'reference value_set_code_id',
                     count(*) FROM broken WHERE value_set_code_id NOT IN (SELECT id FROM value_set_code)
""", (*_ALL, "broken"))
def m6_constraints(spark, sf):
    """The mappings are damaged on purpose: some codes are unknown, some are missing."""
    cat = fx.catalog(spark, sf)
    code = F.col("value_set_code_id")
    damaged = F.when(F.col("original_value") == "3", code + 10_000_000).when(F.col("original_value") != "5", code)
    return constraint_violations(Catalog(**{**cat.__dict__, "mapping": cat.mapping.withColumn("value_set_code_id", damaged)}))


@query("p14_fold_keyword", "SELECT doc_id, md5(replace(strip_accents(lower(text)), 'ß', 'ss')) AS folded FROM documents")
def p14_fold_keyword(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(fold_keyword(F.col("text"))).alias("folded"))
