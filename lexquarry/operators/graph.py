"""Similarity graphs and their clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written
from . import retrieval


def transpose(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """dim, values: each dimension's values over all rows, in order of id (for moderate numbers of rows)."""
    rows = vectors.select(id_col, F.posexplode(vector).alias("dim", "value"))
    ordered = F.array_sort(F.collect_list(F.struct(id_col, "value")))
    return rows.groupBy("dim").agg(F.transform(ordered, lambda x: x["value"].cast("double")).alias("values"))


def nearest_dimensions(vectors: DataFrame, k: int, vector: str = "embedding") -> DataFrame:
    """id, neighbour, similarity, rank: the k dimensions nearest to each by cosine over all rows. Only sums of products, dimensions squared
    of them for each partition, leave a task. Components that are null or not finite count as 0; null vectors are left out; dimensions that
    are all 0 have no neighbours; ties go to the lesser dimension; an empty table gives no rows; vectors are of one length."""
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                x = np.nan_to_num(np.array(batch["v"].tolist(), "f8"), posinf=0, neginf=0)
                total = x.T @ x + (0 if total is None else total)
        if total is not None:
            i, j = np.indices(total.shape, "i4")
            yield pd.DataFrame({"id": i.ravel(), "neighbour": j.ravel(), "s": total.ravel()})

    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    gram = rows.mapInPandas(sums, "id int, neighbour int, s double").groupBy("id", "neighbour").agg(F.sum("s").alias("s"))
    square = F.when(F.col("id") == F.col("neighbour"), F.col("s"))
    norms = [F.sqrt(F.max(square).over(W.partitionBy(c))) for c in ("neighbour", "id")]
    cosine = gram.select("id", "neighbour", (F.col("s") / F.nullif(norms[0] * norms[1], F.lit(0.0))).alias("similarity"))
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("similarity"), "neighbour"))
    return cosine.where("id != neighbour and similarity is not null").withColumn("rank", rank).where(F.col("rank") <= k)


def knn_edges(vectors: DataFrame, k: int, threshold: float | None = None, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """src, dst, weight: links to the k nearest others of at least the threshold, both directions kept."""
    near = retrieval.knn(vectors, k, id_col=id_col, vector=vector)
    edges = near.select(F.col("id").alias("src"), F.col("neighbour").alias("dst"), F.col("similarity").alias("weight"))
    return edges if threshold is None else edges.where(F.col("weight") >= threshold)


def graph_stats(vertices: DataFrame, edges: DataFrame, id_col: str = "vec_id") -> DataFrame:
    v = vertices.agg(F.countDistinct(id_col).alias("vertices"))
    out = v.crossJoin(F.broadcast(edges.agg(F.count("*").alias("edges"))))  # one row each
    return out.withColumn("avg_degree", F.try_divide(2 * F.col("edges"), F.col("vertices")))


def clusters(vertices: DataFrame, edges: DataFrame, resolution: float = 0.0, rounds: int = 10, id_col: str = "vec_id") -> DataFrame:
    """id, cluster by label propagation over links of at least `resolution`, an approximation of modularity clustering: each round a
    vertex takes the label with the greatest weight around it (its own counts a little), ties to the smallest. Deterministic."""
    links = edges.where(F.col("weight") >= resolution).select("src", "dst", "weight")
    links = written(links.union(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")), "links")  # read in each round
    labels = vertices.select(F.col(id_col).alias("id"), F.col(id_col).alias("cluster"))
    for _ in range(rounds):
        votes = links.join(labels, F.col("dst") == F.col("id")).groupBy(F.col("src").alias("id"), "cluster").agg(F.sum("weight").alias("w"))
        votes = votes.union(labels.select("id", "cluster", F.lit(1e-6).alias("w")))
        votes = votes.groupBy("id", "cluster").agg(F.round(F.sum("w"), 9).alias("w"))
        labels = votes.groupBy("id").agg(F.min_by("cluster", F.struct(-F.col("w"), "cluster")).alias("cluster"))
        labels = written(labels, "labels")  # a round reads the last one twice
    return labels


def cluster_report(labels: DataFrame) -> DataFrame:
    sizes = labels.groupBy("cluster").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("clusters"), F.avg("n").alias("avg_size"), F.min("n").alias("min_size"), F.max("n").alias("max_size"))


def _links(edges: DataFrame) -> DataFrame:
    """src, dst, weight, n: each linked pair in both directions, once, without loops."""
    both = edges.select("src", "dst", "weight").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return both.where("src != dst").groupBy("src", "dst").agg(F.round(F.sum("weight"), 9).alias("weight"), F.count("*").alias("n"))


def communities(parts: DataFrame, links: DataFrame, resolution: float = 1.0, rounds: int = 12, levels: int = 5) -> DataFrame:
    """id, cluster: modularity with a resolution, by local moves and contraction, within each part by itself. parts: id, part; links: src, dst,
    weight, both directions. Clusters of one level are the vertices of the next, until a level joins none. Deterministic."""
    own = parts.select("id", "part")
    inner = links.join(own.select(F.col("id").alias("src"), "part"), "src").join(own.select(F.col("id").alias("dst"), F.col("part").alias("_q")), "dst")
    inner = written(inner.where("part = _q").select("src", "dst", "weight"), "links")
    degrees = inner.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("k"))
    nodes = written(own.join(degrees, "id", "left").select("id", "part", F.coalesce("k", F.lit(0.0)).alias("k")), "nodes")
    totals = written(nodes.groupBy("part").agg(F.sum("k").alias("total")), "totals")
    labels, n = nodes.select("id", F.col("id").alias("cluster")), nodes.count()
    for _ in range(levels):
        joined = _moves(nodes, inner, totals, resolution, rounds)
        labels = written(labels.withColumnRenamed("cluster", "_c").join(joined.withColumnRenamed("id", "_c"), "_c").select("id", "cluster"), "labels")
        nodes = written(nodes.join(joined, "id").groupBy(F.col("cluster").alias("id"), "part").agg(F.sum("k").alias("k")), "nodes")
        before, n = n, nodes.count()
        if n == before:
            break
        ends = lambda end: joined.select(F.col("id").alias(end), F.col("cluster").alias(f"_{end}"))  # noqa: B023, E731
        between = inner.join(ends("src"), "src").join(ends("dst"), "dst").where("_src != _dst")
        inner = written(between.groupBy(F.col("_src").alias("src"), F.col("_dst").alias("dst")).agg(F.round(F.sum("weight"), 9).alias("weight")), "links")
    return named(labels)


def _moves(nodes: DataFrame, links: DataFrame, totals: DataFrame, resolution: float, rounds: int) -> DataFrame:
    """id, cluster. nodes: id, part, k (degree). In a round the half of the nodes that a hash picks moves, each to the cluster with the
    greatest gain weight to it - resolution * own degree * the cluster's degree / the part's degree; ties go to the smallest. Every round is
    written, so it costs one join of the links and cuts the lineage. It ends after two rounds without a move."""
    labels, still = nodes.select("id", "part", F.col("id").alias("cluster"), "k"), 0
    for n in range(rounds):
        held = labels.groupBy("cluster").agg(F.sum("k").alias("held"))
        towards = links.join(labels.select(F.col("id").alias("dst"), "cluster"), "dst").groupBy(F.col("src").alias("id"), "cluster").agg(F.sum("weight").alias("w"))
        choices = towards.unionByName(labels.select("id", "cluster", F.lit(0.0).alias("w"))).groupBy("id", "cluster").agg(F.sum("w").alias("w"))
        scored = choices.join(held, "cluster").join(labels.select("id", "part", "k", F.col("cluster").alias("_own")), "id").join(totals, "part")
        others = F.col("held") - F.when(F.col("cluster") == F.col("_own"), F.col("k")).otherwise(0.0)
        gain = F.round(F.col("w") - resolution * F.coalesce(F.try_divide(F.col("k") * others, F.col("total")), F.lit(0.0)), 9)
        best = F.min_by("cluster", F.struct(-gain, F.col("cluster") != F.col("_own"), "cluster"))
        chosen = scored.groupBy("id", "part", "k", "_own").agg(best.alias("best"))
        turn = F.pmod(F.xxhash64("id", F.lit(n // 2)) + n, F.lit(2)) == 0
        cluster = F.when(turn, F.col("best")).otherwise(F.col("_own"))
        moved = written(chosen.select("id", "part", cluster.alias("cluster"), "k", (cluster != F.col("_own")).alias("moved")), "moves")
        still = 0 if moved.where("moved").limit(1).count() else still + 1
        labels = moved.drop("moved")
        if still == 2:
            break
    return labels.select("id", "cluster")


def named(labels: DataFrame) -> DataFrame:
    """id, cluster: clusters called by their smallest vertex, so that equal partitions have equal names."""
    names = labels.groupBy("cluster").agg(F.min("id").alias("_name"))
    return labels.join(names, "cluster").select("id", F.col("_name").alias("cluster"))


def balanced_clusters(vertices: DataFrame, edges: DataFrame, resolution: float = 1.5, least: int = 6, most: int = 75, factor: float = 1.3,
                      passes: int = 20, rounds: int = 12, id_col: str = "vec_id") -> DataFrame:
    """id, cluster: communities, of which those over `most` vertices are parted at resolution * factor and those under `least` join the
    cluster that most of their links lead to (ties: the smallest). Of two small clusters that choose each other the smaller joins. Ends
    when a pass changes nothing, when a partition comes back, or after `passes`. Clusters that cannot be parted, or have
    no links outwards, keep their size. Without edges every vertex is a cluster."""
    links = written(_links(edges), "graph")
    ids = vertices.select(F.col(id_col).alias("id")).distinct()
    labels = written(communities(ids.withColumn("part", F.lit(0)), links, resolution, rounds), "clusters")
    seen = set()
    for _ in range(passes):
        before = _mark(labels)
        sizes = labels.groupBy("cluster").agg(F.count("*").alias("size"))
        large = labels.join(sizes.where(F.col("size") > most), "cluster").select("id", F.col("cluster").alias("part"))
        if large.limit(1).count():
            finer = communities(large, links, resolution * factor, rounds)
            labels = written(labels.join(large, "id", "left_anti").unionByName(finer), "clusters")
            sizes = labels.groupBy("cluster").agg(F.count("*").alias("size"))
        labels = _merged(labels, sizes, links, least)
        after = _mark(labels)
        if after == before or after in seen:
            break  # a pass depends on the partition alone, so this one would only repeat what was seen
        seen.add(after)
    return labels


def _mark(labels: DataFrame) -> tuple:
    """A fingerprint of a partition, one row."""
    h = F.xxhash64("id", "cluster")
    return tuple(labels.agg(F.bit_xor(h), F.sum(h.cast("decimal(38,0)")), F.countDistinct("cluster")).first())


def _merged(labels: DataFrame, sizes: DataFrame, links: DataFrame, least: int) -> DataFrame:
    ends = labels.join(sizes, "cluster")
    there = ends.select(F.col("id").alias("dst"), F.col("cluster").alias("target"), F.col("size").alias("target_size"))
    out = links.join(ends.where(F.col("size") < least).withColumnRenamed("id", "src"), "src").join(there, "dst").where("cluster != target")
    votes = out.groupBy("cluster", "size", "target", "target_size").agg(F.sum("n").alias("n"))
    chosen = votes.groupBy("cluster", "size").agg(F.min_by(F.struct("target", "target_size"), F.struct(-F.col("n"), "target")).alias("t"))
    chosen = written(chosen.select("cluster", "size", "t.target", "t.target_size"), "chosen")
    back = chosen.select(F.col("cluster").alias("target"), F.col("target").alias("_back"))
    both = chosen.join(back, "target", "left")
    stays = (F.col("_back") == F.col("cluster")) & (F.struct("size", "cluster") > F.struct(F.col("target_size").alias("size"), F.col("target").alias("cluster")))
    joins = both.where(~F.coalesce(stays, F.lit(False))).select("cluster", "target")
    moved = labels.join(joins, "cluster", "left").select("id", F.coalesce("target", "cluster").alias("cluster"))
    return written(named(moved), "clusters")


def resolution_for(vertices: DataFrame, edges: DataFrame, wanted: int = 48, tolerance: int = 2, steps: int = 10, low: float = 0.5, high: float = 8.0,
                   id_col: str = "vec_id", **settings) -> tuple[float, DataFrame]:
    """(resolution, clusters): binary search for the resolution whose balanced clusters are about as many as wanted; the nearest if none is."""
    best = None
    for _ in range(steps):
        middle = (low + high) / 2
        labels = balanced_clusters(vertices, edges, middle, id_col=id_col, **settings)
        n = labels.agg(F.countDistinct("cluster")).first()[0]
        if best is None or abs(n - wanted) < best[0]:
            best = (abs(n - wanted), middle, labels)
        if abs(n - wanted) <= tolerance:
            break
        low, high = (middle, high) if n < wanted else (low, middle)
    return best[1], best[2]
