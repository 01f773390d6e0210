"""Exact join of shingle sets by their rarest shingles, for sets that a dense region holds and that are not linked yet.

Each set's shingles are sorted by one order of all shingles, rare ones first. A linked pair's first common shingle has so few others
before it, in either set, that the overlap can still reach the threshold; each place of a set so has a greatest size that a
linked set may have. Only places that allow a size are written, and sets meet at a shingle only where the sizes of either are
allowed at the other's place. No link is lost, whatever the order; only the work depends on it: sets with many
shingles of their own (edited copies of one page, unrelated rows with a common line) meet hardly any other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shingles
from ._common import frugal, materialize
from ._groups import Union, map_groups, number_of

#: Vertices whose shingles are counted for the order, and bits of a shingle that are counted.
SAMPLE, BITS = 4096, 16
#: Classes of sizes are of a ratio of e ** (1 / FINE).
FINE = 50


def _buckets(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - BITS)).astype("i8")


def order_of(texts: DataFrame, width: int) -> np.ndarray:
    """How often the shingles of a few texts fall in each of 2 ** BITS buckets."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(1 << BITS, "i8")
        for batch in batches:
            for text in batch["text"]:
                counts += np.bincount(_buckets(_shingles.shingle_sets([text], width)[0]), minlength=1 << BITS)
        if counts.any():
            yield pd.DataFrame({"counts": [zlib.compress(counts.tobytes())]})

    parts = texts.select("text").mapInPandas(frugal(run), "counts binary").collect()
    return sum((np.frombuffer(zlib.decompress(p.counts), "i8") for p in parts), np.zeros(1 << BITS, "i8"))


def places(values: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of one set at which a linked set can be met first, in order, and the greatest size of such a set."""
    n = len(values)
    ranked = values[np.lexsort((values, counts[_buckets(values)]))]
    most = (n - np.arange(n)) * (100 + percent) // percent - n  # links: overlap * (100 + percent) >= percent * (sum of both sizes)
    fits = 100 * most >= percent * n
    return ranked[fits], most[fits]


def prefixes(texts: DataFrame, width: int, percent: int, counts: np.ndarray) -> DataFrame:
    """texts: text, vertex, component. Rows (shingle, vertex, component, n, most): a set of n shingles meets others of at most `most` there."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text, vertex, component in zip(batch["text"], batch["vertex"], batch["component"]):
                values = _shingles.shingle_sets([text], width)[0]
                shingles, most = places(values, counts, percent)
                yield pd.DataFrame({"shingle": shingles.view("i8"), "vertex": vertex, "component": component, "n": len(values), "most": most})

    return texts.mapInPandas(frugal(run), "shingle long, vertex long, component long, n long, most long")


def meetings(rows: DataFrame, percent: int, cap: int) -> DataFrame:
    """rows: prefixes, written. Returns (cell, vertex): groups of vertices that may be linked and are of different components.

    At each shingle the shorter set of a pair stands in the class of its size, the longer one asks every class that has a size and a
    component for it. Those of a class's largest component are apart from the others, so that they don't ask each other.
    A class with more than cap / 2 rows on a side is dealt in blocks, of which every two meet."""
    key = ["shingle", "size", "inner"]
    size = F.floor(F.log("n") * FINE).cast("int").alias("size")
    held = rows.where("most >= n").select("*", size)  # no shorter than these are those they meet
    each = held.groupBy("shingle", "size", "component").agg(F.count("*").alias("c"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("most").alias("top"))
    each = materialize(each, "sizes")
    mains = each.groupBy("shingle", "size").agg(F.max(F.struct("c", "component")).alias("m")).select(F.col("shingle").alias("_s"), F.col("size").alias("_z"), F.col("m.component").alias("main"))
    mains = materialize(mains, "mains")
    of_main = lambda df: df.join(mains.hint("merge"), (F.col("shingle") == F.col("_s")) & (F.col("size") == F.col("_z"))).withColumn("inner", F.col("component") == F.col("main")).drop("_s", "_z", "main")
    classes = of_main(each).groupBy(*key).agg(F.sum("c").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("top").alias("top"), F.min("component").alias("a"), F.max("component").alias("z"))
    classes = materialize(classes.withColumnRenamed("shingle", "_s"), "classes")
    asks = (F.col("shingle") == F.col("_s")) & (F.least("n", "most") >= F.col("lo")) & (F.col("n") * percent <= F.col("hi") * 100) & (F.col("n") <= F.col("top")) & ((F.col("a") != F.col("z")) | (F.col("component") != F.col("a")))
    asking = materialize(rows.join(classes.hint("merge"), asks).select(*rows.columns, "size", "inner", "c"), "asking")
    open_ = asking.groupBy(*key).agg(F.count("*").alias("p"), F.first("c").alias("c"), F.min("n").alias("lo"), F.max(F.least("n", "most")).alias("hi"))
    open_ = materialize(open_.select(F.col("shingle").alias("_s"), F.col("size").alias("_z"), F.col("inner").alias("_i"), "p", "c", "lo", "hi"), "open")
    met = (F.col("shingle") == F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("inner") == F.col("_i"))
    asked = of_main(held).join(open_.hint("merge"), met & (F.col("most") >= F.col("lo")) & (F.col("n") <= F.col("hi"))).withColumn("asks", F.lit(False))
    asking = asking.drop("c").join(open_.hint("merge"), met).withColumn("asks", F.lit(True))
    half = max(1, cap // 2)
    blocks = lambda n: F.ceil(F.col(n) / half).cast("int")
    own = lambda n: F.pmod(F.xxhash64("vertex"), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    columns = [*rows.columns, "size", "inner", "asks"]
    dealt = asked.select(*columns, own("c").alias("i"), every("p").alias("j")).union(asking.select(*columns, every("c").alias("i"), own("p").alias("j")))

    def find(frame: pd.DataFrame, at: np.ndarray) -> pd.DataFrame:
        vertex, component, n, most = (frame[c].to_numpy("i8") for c in ("vertex", "component", "n", "most"))
        side, cells, members = frame["asks"].to_numpy(bool), [], []
        for a, b in zip(at, at[1:]):
            x, y = a + np.flatnonzero(side[a:b])[:, None], a + np.flatnonzero(~side[a:b])
            i, j = np.nonzero((n[x] >= n[y]) & (n[x] <= most[y]) & (n[y] <= most[x]) & (component[x] != component[y]))
            found = Union(b - a)
            for p, q in zip((x[i, 0] - a).tolist(), (y[j] - a).tolist()):
                found.join(p, q)
            root = np.array([found.root(k) for k in range(b - a)], "i8")
            for r in np.flatnonzero(np.bincount(root, minlength=1) > 1):
                own = np.unique(vertex[a:b][root == r])
                cells += [number_of(own)] * len(own)
                members.append(own)
        return pd.DataFrame({"cell": np.array(cells, "i8"), "vertex": np.concatenate(members) if members else np.zeros(0, "i8")})

    return map_groups(dealt, [*key, "i", "j"], find, "cell long, vertex long").distinct()
