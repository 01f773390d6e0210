"""Connected components of a graph in DataFrames: alternating large-star and small-star steps.

No vertex's links meet in one task (minima are pre-aggregated, joins back to links can be split by Spark where
they are skewed), nothing is collected, and each step is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize


def _least(edges: DataFrame) -> DataFrame:
    """Written, so that the join back to links has plain shuffles on both sides, of which Spark can split a hot vertex."""
    return materialize(edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "_u"), "least")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u > v) -> edges (u > v) that hang on smaller vertices."""
    e = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = _least(e)
    linked = e.join(least, F.col("u") == F.col("_u")).select("u", "v", F.least("u", "m").alias("m"))
    if large:  # neighbours above u are hung on the least neighbour
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("_u").alias("u"), F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Links between ids -> (id, component) for every linked id; component is the smallest id that links reach."""
    big, small = F.greatest(a, b), F.least(a, b)
    edges = materialize(links.select(big.cast("long").alias("u"), small.cast("long").alias("v")).where("u != v").distinct(), "links")
    print_of = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = print_of(edges)
    while seen[0]:
        edges = materialize(_star(_star(edges, True), False), "links")
        if (now := print_of(edges)) == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
