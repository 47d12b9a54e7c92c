"""Intermediate tables in the shared folder, and connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubwell.functions.storage import fresh_path


def stored(df: DataFrame, label: str = "part") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read from there: it survives executors and is computed once."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """``node`` and ``component``, the smallest node that it is connected with, for every node of an edge.

    Alternating large and small stars (Kiveris et al., 2014): nodes are hung under their smallest neighbour until all
    stars are flat, in a number of rounds that grows with the logarithm of a component's size. A round aggregates minima
    (with partial sums) and joins them to the edges, so a node with most of the edges is a skewed join, which adaptive
    execution splits, and never a group in one task. Edges never leave the executors.
    """
    current = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).filter("u <> v").distinct()
    current = stored(current, "edges")
    before = None
    while (state := _state(current)) != before:
        before = state
        current = stored(_small_star(stored(_large_star(current), "edges")), "edges")
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(current.select("v", "v").distinct())


def _state(edges: DataFrame) -> tuple:
    digest = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(digest), F.sum(digest % 1_000_003)).first())


def _with_minimum(pairs: DataFrame) -> DataFrame:
    """Pairs (node, other) with the smallest of the node and all its others."""
    least = pairs.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("m"))
    return pairs.join(least, "node")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is hung under the smallest of the node and its neighbours."""
    both = edges.select(F.col("u").alias("node"), F.col("v").alias("other")).union(edges.select("v", "u"))
    hung = _with_minimum(both).filter("other > node")
    return hung.select(F.col("other").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are hung under the smallest of these."""
    down = edges.select(F.col("u").alias("node"), F.col("v").alias("other"))
    joined = _with_minimum(down)
    hung = joined.select(F.col("other").alias("u"), F.col("m").alias("v")).union(joined.select("node", "m"))
    return hung.filter("u <> v").distinct()
