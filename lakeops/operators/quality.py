"""Data-quality checks; each returns one row per dataset: ``dataset, lhs, rhs, passed``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _counts(df: DataFrame, dataset: str, name: str) -> DataFrame:
    return df.groupBy(dataset).agg(F.count(F.lit(1)).alias(name))


def equal_counts(source: DataFrame, destination: DataFrame, dataset: str) -> DataFrame:
    """The destination has as many rows as the source."""
    both = _counts(destination, dataset, "lhs").join(_counts(source, dataset, "rhs"), dataset, "full")
    both = both.fillna(0, ["lhs", "rhs"])
    return both.select(F.col(dataset).alias("dataset"), "lhs", "rhs", (F.col("lhs") == F.col("rhs")).alias("passed"))


def partition_growth(df: DataFrame, dataset: str, partition: str, strict: bool) -> DataFrame:
    """The newest partition has more rows than the one before it, or at least as many.

    The counts are taken first; ordering then touches one row per partition. With a single partition
    there is nothing to compare and the check passes.
    """
    counts = df.groupBy(dataset, partition).agg(F.count(F.lit(1)).alias("n"))
    ranked = F.sort_array(F.collect_list(F.struct(partition, "n")), asc=False)
    newest = counts.groupBy(dataset).agg(ranked.alias("p")).select(
        F.col(dataset).alias("dataset"), F.col("p")[0]["n"].alias("lhs"), F.get("p", F.lit(1))["n"].alias("rhs")
    )
    grows = F.col("lhs") > F.col("rhs") if strict else F.col("lhs") >= F.col("rhs")
    return newest.withColumn("passed", F.coalesce(grows, F.lit(True)))


def greater_partition_counts(df: DataFrame, dataset: str, partition: str) -> DataFrame:
    return partition_growth(df, dataset, partition, strict=True)


def greater_or_equal_partition_counts(df: DataFrame, dataset: str, partition: str) -> DataFrame:
    return partition_growth(df, dataset, partition, strict=False)


def _null_counts(df: DataFrame, dataset: str, columns: list[str], name: str) -> DataFrame:
    counted = df.groupBy(dataset).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counted.unpivot(dataset, columns, "column", name)


def lower_or_equal_null_counts(source: DataFrame, destination: DataFrame, dataset: str) -> DataFrame:
    """No column the two share has more nulls in the destination; one pass over each side."""
    shared = [c for c in source.columns if c in destination.columns and c != dataset]
    both = _null_counts(destination, dataset, shared, "lhs").join(
        _null_counts(source, dataset, shared, "rhs"), [dataset, "column"], "full"
    ).fillna(0, ["lhs", "rhs"])
    return both.select(
        F.col(dataset).alias("dataset"), "column", "lhs", "rhs", (F.col("lhs") <= F.col("rhs")).alias("passed")
    )


def index_valid_mapping(index: DataFrame, key: str, index_id: str, name: str) -> DataFrame:
    """Source key and index id are one to one: as many pairs as keys and as ids.

    ``lhs`` counts keys with several ids, ``rhs`` ids with several keys.
    """
    pairs = index.select(key, index_id).distinct()
    keys = pairs.groupBy(key).count().select((F.col("count") > 1).alias("bad_key"), F.lit(False).alias("bad_id"))
    ids = pairs.groupBy(index_id).count().select(F.lit(False).alias("bad_key"), (F.col("count") > 1).alias("bad_id"))
    found = keys.unionByName(ids).agg(F.count_if("bad_key").alias("lhs"), F.count_if("bad_id").alias("rhs"))
    return found.select(F.lit(name).alias("dataset"), "lhs", "rhs", ((F.col("lhs") == 0) & (F.col("rhs") == 0)).alias("passed"))


def index_valid_occurrences(index: DataFrame, sources: DataFrame, key: str, name: str) -> DataFrame:
    """Every source key is in the index exactly once.

    ``lhs`` counts keys that occur zero or several times, ``rhs`` index rows without a source.
    """
    wanted = sources.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_wanted", F.lit(True))
    have = index.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    both = wanted.join(have, key, "full")
    return both.agg(
        F.count_if(F.col("_wanted") & (F.coalesce("_n", F.lit(0)) != 1)).alias("lhs"),
        F.count_if(F.col("_wanted").isNull()).alias("rhs"),
    ).select(F.lit(name).alias("dataset"), "lhs", "rhs", ((F.col("lhs") == 0) & (F.col("rhs") == 0)).alias("passed"))


def index_greater_or_equal(index: DataFrame, previous: DataFrame, name: str) -> DataFrame:
    """The new index has at least as many rows as the previous version."""
    sides = index.select(F.lit(1).alias("new")).unionByName(previous.select(F.lit(0).alias("new")))
    return sides.agg(F.count_if(F.col("new") == 1).alias("lhs"), F.count_if(F.col("new") == 0).alias("rhs")).select(
        F.lit(name).alias("dataset"), "lhs", "rhs", (F.col("lhs") >= F.col("rhs")).alias("passed")
    )
