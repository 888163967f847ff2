"""The metadata catalog: dictionary joins, lineage, counts, scan and constraint checks."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeops.session import durable


@dataclass
class Catalog:
    resource: DataFrame
    dict_table: DataFrame
    variable: DataFrame
    value_set: DataFrame
    value_set_code: DataFrame
    mapping: DataFrame
    analyst: DataFrame


# Load order and natural key of each catalog table.
LOAD_ORDER = {
    "analyst": ["name"],
    "resource": ["code"],
    "dict_table": ["resource_id", "name"],
    "value_set": ["name"],
    "value_set_code": ["value_set_id", "code"],
    "variable": ["path"],
    "mapping": ["value_set_code_id", "original_value"],
}

# Foreign keys as (table, column, parent, mandatory), and columns that may not be null.
FOREIGN_KEYS = [
    ("resource", "project_analyst_id", "analyst", False),
    ("dict_table", "resource_id", "resource", True),
    ("variable", "table_id", "dict_table", True),
    ("variable", "value_set_id", "value_set", False),
    ("value_set_code", "value_set_id", "value_set", True),
    ("mapping", "value_set_code_id", "value_set_code", True),
]
NOT_NULL = {
    "analyst": ["name"],
    "resource": [
        "code", "name", "resource_type", "description_en", "description_fr",
        "publish_dictionary", "publish_summary", "recurring",
    ],
    "dict_table": ["resource_id", "name"],
    "variable": ["table_id", "name", "path", "rolling_version"],
    "value_set": ["name"],
    "value_set_code": ["value_set_id", "code", "label_fr", "label_en"],
    "mapping": ["value_set_code_id", "original_value"],
}

# Allowed values of enumerated columns.
ENUMS = {
    ("resource", "resource_type"): ["warehouse", "research_project", "eqp", "source_system"],
    ("variable", "value_type"): [
        "integer", "boolean", "string", "decimal", "date", "datetime", "array", "struct", "map",
    ],
    ("variable", "rolling_version"): ["obsolete", "current", "future"],
}


def published_resource(cat: Catalog, code: str) -> DataFrame:
    return cat.resource.where((F.col("code") == code) & F.col("publish_dictionary"))


def published_tables(cat: Catalog, code: str) -> DataFrame:
    owner = published_resource(cat, code).select(F.col("id").alias("resource_id"))
    return cat.dict_table.join(owner, "resource_id").select(*cat.dict_table.columns)


def published_variables(cat: Catalog, code: str) -> DataFrame:
    tables = published_tables(cat, code).select(F.col("id").alias("table_id"))
    return cat.variable.join(tables, "table_id").select(*cat.variable.columns)


def _references(cat: Catalog, code: str) -> DataFrame:
    """How many variables of the resource refer to each value set."""
    return (
        published_variables(cat, code).where(F.col("value_set_id").isNotNull())
        .groupBy("value_set_id").agg(F.count(F.lit(1)).alias(TIMES))
    )


#: Copies that one task makes, and the most that it makes of one row.
TASK_COPIES, ROW_COPIES = 1 << 24, 1 << 12

#: Column that tells how many copies a row of a folded sheet stands for.
TIMES = "_times"


def in_shares(rows: DataFrame, times: str, tasks: int) -> DataFrame:
    """Rows cut into shares of at most ``ROW_COPIES`` copies, dealt out evenly to ``tasks``."""
    last = F.floor((F.col(times) - 1) / ROW_COPIES)
    shares = rows.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    return shares.withColumn(times, F.least(F.lit(ROW_COPIES), F.col(times) - F.col("_share") * ROW_COPIES)).drop("_share").repartition(tasks)


def _repeat(df: DataFrame, columns: list[str], folded: bool = False) -> DataFrame:
    """Bag multiplicity as an explode at the very end, after all shuffles.

    Codes times variables outgrow the tables, and Spark sizes tasks by what they read. So the rows are
    counted with their copies, cut into shares of a bounded number of copies and dealt out evenly to as
    many tasks as the copies need. With ``folded``, rows come once, and ``TIMES`` tells how often they count.
    """
    if folded:
        return df.select(*columns, TIMES)
    rows = durable(df.select(*columns, TIMES))
    tasks = -(-(rows.agg(F.sum(TIMES)).first()[0] or 0) // TASK_COPIES)
    if tasks > 1:
        rows = in_shares(rows, TIMES, tasks)
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col(TIMES)))).select(*columns)


def published_value_sets(cat: Catalog, code: str, folded: bool = False) -> DataFrame:
    """Value sets once per variable that refers to them."""
    refs = _references(cat, code).withColumnRenamed("value_set_id", "id")
    return _repeat(cat.value_set.join(refs, "id"), cat.value_set.columns, folded)


def published_codes(cat: Catalog, code: str, folded: bool = False) -> DataFrame:
    """Codes once per variable that refers to their value set."""
    return _repeat(cat.value_set_code.join(_references(cat, code), "value_set_id"), cat.value_set_code.columns, folded)


def published_mappings(cat: Catalog, code: str, folded: bool = False) -> DataFrame:
    """Mappings with the multiplicity of the codes they belong to."""
    codes = cat.value_set_code.join(_references(cat, code), "value_set_id").select(
        F.col("id").alias("value_set_code_id"), TIMES
    )
    return _repeat(cat.mapping.join(codes, "value_set_code_id"), cat.mapping.columns, folded)


# Names of the published result sets, in order.
SHEETS = {
    "Resource": published_resource,
    "Dict Tables": published_tables,
    "Variable": published_variables,
    "Value Sets": published_value_sets,
    "Value Set Codes": published_codes,
    "Mappings": published_mappings,
}


# Sheets whose rows come once per variable that refers to them.
_BAGS = ("Value Sets", "Value Set Codes", "Mappings")


def dictionary(cat: Catalog, code: str, folded: bool = False) -> dict[str, DataFrame]:
    """The six published result sets of a resource; all empty unless its dictionary is published.

    With ``folded``, rows that come once per variable come once, with their number in ``TIMES``.
    """
    return {name: build(cat, code, folded=True) if folded and name in _BAGS else build(cat, code) for name, build in SHEETS.items()}


def expand_lineage(cat: Catalog) -> DataFrame:
    """Parents of every variable: ``var_from_variables`` and ``var_from_source_systems``.

    ``published`` tells whether the parent's own resource publishes its dictionary. Ids that lead
    nowhere are dropped; a variable without parents gets empty arrays.
    """
    owner = cat.dict_table.select(F.col("id").alias("table_id"), "resource_id", F.col("name").alias("tab_name"))
    systems = cat.resource.select(
        F.col("id").alias("rs_id"), F.col("code").alias("rs_code"), F.col("name").alias("rs_name"),
        F.col("publish_dictionary").alias("published"),
    )
    parents = (
        cat.variable.select(F.col("id").alias("parent_id"), F.col("name").alias("var_name"), "table_id")
        .join(owner, "table_id", "left")
        .join(systems, F.col("resource_id") == F.col("rs_id"), "left")
        .select(
            "parent_id", "var_name", F.coalesce("published", F.lit(False)).alias("published"),
            "rs_id", "rs_code", "rs_name", F.col("table_id").alias("tab_id"), "tab_name",
        )
    )
    from_variables = (
        cat.variable.select(F.col("id").alias("var_id"), F.explode("from_variable_id").alias("parent_id"))
        .join(parents, "parent_id")
        .groupBy("var_id").agg(F.sort_array(F.collect_list(F.struct(
            F.col("parent_id").alias("var_id"), "var_name", "published",
            F.struct("rs_id", "rs_name", "rs_code").alias("resource"),
            F.struct("tab_id", "tab_name").alias("table"),
        ))).alias("var_from_variables"))
    )
    from_systems = (
        cat.variable.select(F.col("id").alias("var_id"), F.explode("from_source_system_id").alias("rs_id"))
        .join(systems, "rs_id")
        .groupBy("var_id").agg(F.sort_array(F.collect_list(
            F.struct("rs_id", "rs_code", "rs_name", "published")
        )).alias("var_from_source_systems"))
    )
    whole = (
        cat.variable.select(F.col("id").alias("var_id"), F.col("name").alias("var_name"))
        .join(from_variables, "var_id", "left").join(from_systems, "var_id", "left")
    )
    empty = {c: F.coalesce(F.col(c), F.array().cast(whole.schema[c].dataType)) for c in
             ("var_from_variables", "var_from_source_systems")}
    return whole.withColumns(empty)


def index_counts(cat: Catalog) -> DataFrame:
    """Per resource: tables, domains, variables, source systems feeding it, projects fed by it.

    What is counted becomes one list of facts, folded by resource in a single aggregate.
    """
    owner = cat.dict_table.select(F.col("id").alias("table_id"), F.col("resource_id").alias("rs_id"))
    kinds = cat.resource.select(F.col("id").alias("rs_id"), "resource_type")
    owned = cat.variable.select("table_id", "from_source_system_id").join(owner, "table_id")
    links = owned.select("rs_id", F.explode("from_source_system_id").alias("source_id")).distinct()
    projects = links.join(kinds.where("resource_type = 'research_project'"), "rs_id", "left_semi")
    facts = {
        "project_count": projects.select(F.col("source_id").alias("rs_id")),
        "domain_count": cat.dict_table.where(F.col("domain").isNotNull()).select(F.col("resource_id").alias("rs_id"), "domain").distinct().select("rs_id"),
        "source_system_count": links.select("rs_id"),
        "variable_count": owned.select("rs_id"),
        "table_count": cat.dict_table.select(F.col("resource_id").alias("rs_id")),
    }
    listed = reduce(DataFrame.unionByName, [df.withColumn("fact", F.lit(name)) for name, df in facts.items()])
    counted = listed.groupBy("rs_id").agg(*[F.count_if(F.col("fact") == name).alias(name) for name in facts])
    return kinds.select("rs_id").join(counted, "rs_id", "left").fillna(0, list(facts)).select("rs_id", *facts)


def table_variable_counts(cat: Catalog) -> DataFrame:
    counted = cat.variable.groupBy(F.col("table_id").alias("tab_id")).agg(F.count(F.lit(1)).alias("variable_count"))
    return cat.dict_table.select(F.col("id").alias("tab_id")).join(counted, "tab_id", "left").fillna(0, ["variable_count"])


def value_type(kind: T.DataType) -> str:
    """Catalog type of a Spark type."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "decimal"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    named = {T.BooleanType: "boolean", T.DateType: "date", T.ArrayType: "array", T.StructType: "struct", T.MapType: "map"}
    return named.get(type(kind), "string")


def _fields(schema: T.StructType, prefix: str = "") -> list[tuple[str, T.DataType]]:
    found = []
    for f in schema:
        found.append((prefix + f.name, f.dataType))
        if isinstance(f.dataType, T.StructType):
            found += _fields(f.dataType, f"{prefix}{f.name}.")
    return found


def _comparable(c: Column, kind: T.DataType) -> Column:
    """A value with an equality that hashing respects."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return c + F.lit(0.0)  # both zeros are one value
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):  # a hash passes over nulls inside, and knows no maps
        return F.when(c.isNotNull(), F.to_json(F.struct(c), {"ignoreNullFields": "false"}))
    return c


def _sketched(df: DataFrame, first: int, fields: list, distinct: float | None) -> DataFrame:
    """Counts of one dataset in one aggregate, one row per task and dataset shuffled."""
    counts = []
    for i, (path, kind) in enumerate(fields):
        counts.append(F.count(F.col(path)).alias(f"n{i}"))
        if distinct is not None:
            counts.append(F.approx_count_distinct(_comparable(F.col(path), kind), distinct).alias(f"d{i}"))
    each = F.array(*[
        F.struct(F.lit(first + i).alias("i"), F.col(f"n{i}").alias("n_values"), *([F.col(f"d{i}").alias("n_distinct")] if distinct is not None else []))
        for i in range(len(fields))
    ])
    return df.agg(*counts).select(F.inline(each))


def _cells(df: DataFrame, first: int, fields: list) -> DataFrame:
    """``i, a, b`` per value that is not null: its column and 128 bits of hash."""
    values = [_comparable(F.col(path), kind) for path, kind in fields]
    each = F.array(*[
        F.struct(F.lit(first + i).alias("i"), F.when(v.isNotNull(), F.xxhash64(v)).alias("a"), F.xxhash64(F.lit(first + i), v).alias("b"))
        for i, v in enumerate(values)
    ])
    return df.select(F.inline(each)).where("a IS NOT NULL")


def scan_metadata(
    spark: SparkSession, resource: str, tables: dict[str, DataFrame], distinct: float | None = 0.0,
) -> DataFrame:
    """One row per column of a resource's datasets, nested fields included: catalog fields, the number of
    values that are not null and the number of different ones.

    Names and types come from the schemas. ``distinct`` is the relative error allowed. With 0, the
    default, counts are exact to 128 bits of hash: every scan of a dataset folds its values to distinct
    hashes in the tasks, these meet in one exchange for all datasets, and are counted where they meet.
    That shuffles 20 bytes per distinct value of a task, whatever the values' lengths: at most the cells
    of unique columns, next to nothing for the others. Above 0, a sketch per column in one aggregate per
    dataset; with none, no ``n_distinct``: both shuffle a row per task. Structs, arrays and maps are
    compared by their text.
    """
    known, scans = [], []
    for name, df in sorted(tables.items()):
        fields = _fields(df.schema)
        scans.append((df, len(known), fields))
        known += [(len(known) + i, name, path.split(".")[-1], f"{resource}.{name}.{path}", value_type(kind)) for i, (path, kind) in enumerate(fields)]
    if distinct == 0:
        values = reduce(DataFrame.unionByName, [_cells(*s) for s in scans]).groupBy("i", "a", "b").agg(F.count(F.lit(1)).alias("n"))
        counted = values.groupBy("i").agg(F.sum("n").alias("n_values"), F.count(F.lit(1)).alias("n_distinct"))
    else:
        counted = reduce(DataFrame.unionByName, [_sketched(*s, distinct) for s in scans])
    columns = spark.createDataFrame(known, "i int, table_name string, name string, path string, value_type string")
    numbers = ["n_values", *(["n_distinct"] if distinct is not None else [])]
    return columns.join(counted, "i", "left").fillna(0, numbers).select(
        F.lit(resource).alias("resource"), "table_name", "name", "path", "value_type", F.lit("current").alias("rolling_version"), *numbers)


def foreign_key_orphans(cat: Catalog, table: str, column: str, parent: str) -> DataFrame:
    """Rows whose reference points at no parent row."""
    child, known = getattr(cat, table), getattr(cat, parent).select(F.col("id").alias("_parent_id"))
    return child.where(F.col(column).isNotNull()).join(known, F.col(column) == F.col("_parent_id"), "left_anti")


def _violations(table: str, rule: str, counted: DataFrame) -> DataFrame:
    return counted.select(F.lit(table).alias("table"), F.lit(rule).alias("rule"), F.col("n").cast("bigint").alias("n"))


def constraint_violations(cat: Catalog, tables: Iterable[str] = tuple(LOAD_ORDER)) -> DataFrame:
    """``(table, rule, n)`` for every declared key, mandatory column, enumeration and reference.

    A rule that holds is listed with zero. Each table is read once for its column rules, once for its
    key, and each reference is an anti join on the parent's ids.
    """
    found = []
    for table in tables:
        df = getattr(cat, table)
        checks = [(f"not null {c}", F.count_if(F.col(c).isNull())) for c in NOT_NULL[table] if c in df.columns]
        checks += [
            (f"allowed {c}", F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(values)))
            for (t, c), values in ENUMS.items() if t == table and c in df.columns
        ]
        counted = df.agg(*[m.alias(f"n{i}") for i, (_, m) in enumerate(checks)])
        pairs = F.explode(F.array(*[
            F.struct(F.lit(rule).alias("rule"), F.col(f"n{i}").alias("n")) for i, (rule, _) in enumerate(checks)
        ])).alias("p")
        found.append(counted.select(pairs).select(F.lit(table).alias("table"), "p.rule", F.col("p.n").cast("bigint").alias("n")))
        for rule, keys in ((f"primary key id", ["id"]), (f"unique {', '.join(LOAD_ORDER[table])}", LOAD_ORDER[table])):
            if not set(keys) <= set(df.columns):
                continue
            # A null in a unique key never equals anything.
            doubled = df.select(*keys).na.drop("any").groupBy(*keys).count().where("count > 1")
            found.append(_violations(table, rule, doubled.agg(F.count(F.lit(1)).alias("n"))))
    for table, column, parent, _ in FOREIGN_KEYS:
        if table in tables and column in getattr(cat, table).columns:
            orphans = foreign_key_orphans(cat, table, column, parent)
            found.append(_violations(table, f"reference {column}", orphans.agg(F.count(F.lit(1)).alias("n"))))
    return reduce(DataFrame.unionByName, found)
