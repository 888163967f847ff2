"""Connected components of a link table, without bringing links or labels to one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.llm.shared import drop_written, written
from lakeops.operators.skew import lookup_join


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links (a, b)`` (long) that is not the smallest of its component;
    ``root`` is the smallest.

    Alternates two steps until nothing changes: every node hands its larger neighbours to the smallest
    node it knows, then it and its smaller neighbours. Both are one aggregate (folded before the
    shuffle) and one join per step; a node with very many neighbours is a hot key of that join, which
    ``lookup_join`` lets Spark split. Each round is written to shared storage and the round before it dropped.
    """
    def pairs(a, b):
        return F.greatest(a, b).alias("a"), F.least(a, b).alias("b")

    edges = written(links.where("a <> b").select(*pairs("a", "b")).distinct(), "links")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("a"), F.min("b")).alias("m"))
        larger = lookup_join(both.where("b > a").select(F.col("a").alias("u"), "b"), least, ["u"]).select(F.col("b").alias("u"), F.col("m").alias("v"))
        least = larger.groupBy("u").agg(F.min("v").alias("m"))
        smaller = lookup_join(larger, least, ["u"])
        own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        rest = smaller.where("v <> m").select(*pairs("v", "m"))
        before, edges = edges, written(own.unionByName(rest).distinct(), "links")
        drop_written(before)
        last, state = state, _state(edges)
        if state == last:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _state(edges: DataFrame) -> tuple[int, int | None]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row.n, row.x
