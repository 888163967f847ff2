"""Loading the metadata catalog in the order its references demand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.operators.catalog import FOREIGN_KEYS, LOAD_ORDER, Catalog, foreign_key_orphans
from lakeops.operators.ordering import with_ordinals
from lakeops.session import durable
from lakeops.sinks.upsert import require_unique, upsert
from lakeops.sources.registry import union_by_name
from lakeops.sources.versions import VersionedTables

# Columns an update leaves alone. A row keeps the id under which it was first loaded.
EXCLUDED = ["created_at", "id"]


def _translated(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """``df`` with a reference to a staged id replaced by the id the catalog knows the row by."""
    names = ids.select(F.col("staged_id").alias(column), "kept_id")
    return df.join(names, column, "left").withColumn(column, F.coalesce("kept_id", column)).drop("kept_id").select(*df.columns)


def _with_kept_ids(target: DataFrame, staging: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Staging rows under catalog ids, and the ``staged_id, kept_id`` of each.

    A row that the catalog has keeps its id there. New rows are numbered on from the highest id, in the
    order of their staged ids.
    """
    known = target.select(*keys, F.col("id").alias("_known"))
    matched = durable(staging.join(known, keys, "left"))
    highest = target.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("m"))
    new = with_ordinals(matched.where("_known IS NULL").select(F.col("id").alias("_staged")), [F.col("_staged")], "_n")
    new = new.select("_staged", (F.col("_n") + 1 + highest.scalar()).alias("_new"))
    # With a null in the key a row matches nothing, so several staged rows may be new under one key.
    ids = matched.join(new, F.col("id") == F.col("_staged"), "left").withColumn("_id", F.coalesce("_known", "_new"))
    ids = durable(ids.drop("_known", "_staged", "_new"))
    kind = target.schema["id"].dataType
    rows = ids.withColumn("id", F.col("_id").cast(kind)).select(*staging.columns)
    return rows, ids.select(F.col("id").alias("staged_id"), F.col("_id").cast(kind).alias("kept_id"))


def load_catalog(spark: SparkSession, staged: Catalog, root: str) -> DataFrame:
    """Upsert every staged table into the catalog below ``root``, parents before children.

    Rows are matched on natural keys. Ids are the catalog's own: a matched row keeps its id, a new one
    gets the next, and references among the staged tables are translated to match, before the natural
    keys they are part of are compared. All tables are written first and all references counted; one
    that leads nowhere stops the load, and then, as after a crash at any point, the catalog is what
    it was. Returns ``(table_name, position, n_rows, n_new, n_orphans)``.
    """
    versions = VersionedTables(spark, root)
    present, change = set(versions.names()), versions.begin()
    loaded: dict[str, DataFrame] = {}
    translations: dict[str, DataFrame] = {}
    before: dict[str, DataFrame] = {}
    for name, keys in LOAD_ORDER.items():
        new = getattr(staged, name)
        for table, column, parent, _ in FOREIGN_KEYS:
            if table == name and column in new.columns and parent in translations:
                new = _translated(new, column, translations[parent])
        if name in present:
            old = before[name] = versions.read(name)
            require_unique(new, keys)
            if "id" in new.columns:
                new, translations[name] = _with_kept_ids(old, new, keys)
            new = upsert(old, new, keys, EXCLUDED)
        new.write.mode("overwrite").parquet(versions.folder(change, name))
        loaded[name] = spark.read.schema(new.schema).parquet(versions.folder(change, name))
    catalog = Catalog(**loaded)
    # All references are followed in one job, and all tables counted in another.
    found = durable(union_by_name([
        foreign_key_orphans(catalog, table, column, parent).select(
            F.lit(table).alias("table_name"), F.lit(column).alias("reference"), F.col(column).cast("string").alias("value"))
        for table, column, parent, _ in FOREIGN_KEYS if column in loaded[table].columns
    ]))
    example = found.orderBy("table_name", "reference", "value").limit(1).collect()
    if example:
        name = example[0].table_name
        n = found.where(F.col("table_name") == name).count()
        raise ValueError(f"{n} references of {name} lead nowhere, such as {example[0].reference} {example[0].value}")
    counted = [loaded[name].agg(F.count(F.lit(1)).alias("n_rows"), F.lit(0).cast("bigint").alias("n_before")).select(F.lit(name).alias("table_name"), "*") for name in LOAD_ORDER]
    counted += [old.agg(F.lit(0).cast("bigint").alias("n_rows"), F.count(F.lit(1)).alias("n_before")).select(F.lit(name).alias("table_name"), "*") for name, old in before.items()]
    position = F.array_position(F.array(*[F.lit(name) for name in LOAD_ORDER]), F.col("table_name")).cast("int") - 1
    summary = durable(union_by_name(counted).groupBy("table_name").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_before").alias("n_before")).select(
        "table_name", position.alias("position"), "n_rows", (F.col("n_rows") - F.col("n_before")).alias("n_new"), F.lit(0).cast("bigint").alias("n_orphans")))
    versions.commit(change, list(LOAD_ORDER))
    versions.prune()
    return summary
