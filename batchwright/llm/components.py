"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from batchwright.storage import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Tie the larger neighbours of each node to the smallest node of its neighbourhood."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Tie each node and its smaller neighbours to the smallest of them; edges have u > v."""
    smallest = edges.groupBy("u").agg(F.min("v").alias("m"))
    inner = edges.join(smallest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return inner.unionAll(smallest.select("u", F.col("m").alias("v")))


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge table (u, v): root is the component's smallest node.

    Each step aggregates by node before its exchange, and its edges are written to the shared
    folder with their checksum. The loop ends when a large-star step changes nothing: then
    every component is a star around its smallest node. Edges with a null end and loops are
    left out.
    """

    def settle(edges: DataFrame) -> tuple[DataFrame, dict]:
        seen = Observation()
        kept = edges.where("u <> v").distinct().observe(
            seen, F.count(F.lit(1)).alias("edges"), F.sum(F.shiftright(F.xxhash64("u", "v"), 24)).alias("mark")
        )
        return materialize(kept, "links"), seen.get

    edges, mark = settle(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    while mark["edges"]:
        before = mark
        edges, mark = settle(_large_star(edges))
        if mark == before:
            break
        edges, mark = settle(_small_star(edges))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
