"""MinHash near-duplicates with an LSH forest, confirmed on whole shingle sets.

1. Every text becomes its set of 5-word shingles (64-bit hashes). Equal sets are one vertex, named by
   their smallest doc_id, so copies are never compared.
2. A set's signature of TREES * DEPTH minhashes gives it a place in TREES sorted orders. In each order the rows
   with a common prefix of BASE values are a region. Regions of the same rows in several orders are one.
3. A region of at most CAP rows is compared whole. A denser one is walked in sorted order, in runs of at most CAP rows that are cut
   where neighbours share the shortest prefix: each row meets its neighbours of longest common prefix, at a depth that
   the region's density sets. Their links are confirmed, and linked rows contracted.
4. What is still apart in dense regions of several components is joined by its rarest shingles (`_prefixes`): sets meet only at a first common
   shingle that leaves enough of either for a link. So no link of a region is lost, and copies of one page, linked or not, and
   unrelated rows of one template cost linear work. Only sets that share so rare a shingle and yet stay apart are compared each with
   each: n * n / CAP copies of their places.
5. In step 3 the signatures' agreement picks groups of sets that may be similar enough (four standard deviations
   below the threshold still count); groups that several orders found are kept once. Step 4 is exact.
6. Only sets in groups are made again from whole texts, each group in a task; a group of more than BYTES of sets comes as
   pairs of blocks. Exact intersections of all its pairs come from matrix products, a group returns a spanning forest of its links, so
   the number of links returned is linear.
7. Components of these links are found in DataFrames.

Two sets of similarity 0.85 share no region with probability (1 - 0.85**3)**16 = 2e-7, at 0.8 with 1e-5,
however dense their regions are. In regions of at most CAP rows step 5 misses 7e-5 of the pairs at exactly 0.85 (binomial tail of 160 values at four
deviations), 1e-5 at 0.86, 2e-6 at 0.87; at 0.8 with a threshold of 0.8 6e-5.

Defined results: null text and text without words have an empty set and are linked with nothing; rows with null doc_id are linked with nothing
(component_id null, kept); rows with equal doc_id share a vertex; equal sets always share a component, ties between equal
sets fall to the smallest doc_id; very long texts are read whole, a few million characters of texts at a time; an
empty table gives no rows; other columns are not read (keep() returns them unchanged, whatever their names).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _prefixes, _shingles
from ._common import broadcast_if_small, frugal, materialize, table
from ._components import components
from ._groups import Union, map_groups, number_of
from ._regions import members

WIDTH = 5
#: Links have similarity >= PERCENT / 100.
PERCENT = 80
TREES, DEPTH, BASE = 16, 10, 3  # orders, values of each in a signature, values that a region shares
#: Rows of a region, run or block that are compared at once, and bytes of sets in a group or pair of blocks.
CAP, BYTES = 512, 64 << 20
#: Characters of texts that are turned into sets at once.
CHUNK = 1_000_000


def _chunks(texts: list) -> Iterator[slice]:
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK or i + 1 == len(texts):
            yield slice(begin, i + 1)
            begin, size = i + 1, 0


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, key (two longs, equal for equal sets), sig (minhashes), low (their lowest bytes)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for s in _chunks(texts):
                values, begin = _shingles.shingle_sets(texts[s], WIDTH)
                sig, keys = _shingles.signatures(values, begin, TREES * DEPTH), _shingles.set_keys(values, begin)
                yield pd.DataFrame({
                    "doc_id": batch["doc_id"][s].astype("Int64"), "n_shingles": np.diff(begin), "key_a": keys[:, 0], "key_b": keys[:, 1],
                    "sig": list(sig.view("i4")), "low": [r.tobytes() for r in sig.astype("u1")]})

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInPandas(frugal(run), "doc_id long, n_shingles long, key_a long, key_b long, sig array<int>, low binary")


def regions(sets: DataFrame) -> DataFrame:
    """sets: vertex, sig. Rows (region, n, tree, vertex): those of the n rows that share a prefix of BASE values in a tree.
    Only (vertex, tree, hash) is dealt by region. Of regions with the same rows one is kept."""
    of_tree = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.xxhash64(t, F.slice("sig", t * DEPTH + 1, BASE)))
    prefixes = sets.select("vertex", F.posexplode(of_tree).alias("tree", "region"))
    shared = prefixes.groupBy("region").agg(F.count("*").alias("n"), members().alias("m")).where("n > 1")
    once = shared.groupBy("n", "m").agg(F.min("region").alias("_r")).select("n", "_r")
    once = materialize(once, "shared")  # so that Spark can split the rows of a dense region in the join
    return materialize(prefixes.join(once.hint("merge"), F.col("region") == F.col("_r")).drop("_r"), "regions")


def _signed(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """rows with the signatures' lowest bytes (low) and the values of the row's order after the region's prefix (path)."""
    narrow = sets.select(F.col("vertex").alias("_v"), "low", "sig")
    path = F.slice("sig", F.col("tree") * DEPTH + BASE + 1, DEPTH - BASE).alias("path")
    return rows.join(narrow.hint("merge"), F.col("vertex") == F.col("_v")).select(*rows.columns, "low", path)


def _alike(low: np.ndarray, least: float) -> Iterator[np.ndarray]:
    """Groups (two rows or more) that are connected by signatures which agree in a share of `least` or more. A row that was
    reached is compared with those that were not reached yet, so a group of n copies takes n steps."""
    need = least * low.shape[1]
    left = np.arange(len(low))
    while len(left) > 1:
        group, queue, left = [left[0]], [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = (low[left] == low[i]).sum(1) >= need
            if near.any():
                found = left[near].tolist()
                group += found
                queue += found
                left = left[~near]
        if len(group) > 1:
            yield np.array(group)


def _cells(vertex: np.ndarray, lows: np.ndarray, at: np.ndarray, least: float) -> pd.DataFrame:
    """(cell, vertex) of the groups that are found between the bounds `at`."""
    cells, members = [], []
    for a, b in zip(at, at[1:]):
        low = np.frombuffer(b"".join(lows[a:b]), "u1").reshape(b - a, -1)
        for group in _alike(low, least):
            own = np.unique(vertex[a:b][group])
            if len(own) > 1:
                cells += [number_of(own)] * len(own)
                members.append(own)
    return pd.DataFrame({"cell": np.array(cells, "i8"), "vertex": np.concatenate(members) if members else np.zeros(0, "i8")})


def _least_agreement(percent: int) -> float:
    p = percent / 100
    return p - 4 * (p * (1 - p) / (TREES * DEPTH)) ** 0.5


def cut_order(region: np.ndarray, path: np.ndarray, cap: int) -> np.ndarray:
    """Bounds of runs of rows in sorted order: a run is of one region and has at most cap rows; a region of more is
    cut, in the second half of each run, where neighbours have the shortest common prefix."""
    same = np.logical_and.accumulate(path[1:] == path[:-1], 1).sum(1) if len(path) else np.zeros(0, "i8")
    common = np.where(region[1:] == region[:-1], same, -1)  # of each row with the next
    out, at = [0], 0
    ends = np.r_[np.flatnonzero(common < 0) + 1, len(region)]
    for end in ends:
        while end - at > cap:
            half = at + cap // 2
            at = half + int(np.argmin(common[half - 1 : at + cap])) if cap > 1 else at + 1
            out.append(at)
        at = int(end)
        out.append(at)
    return np.unique(out)


def candidates(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(cell, vertex): groups of sets that may be linked, each of at most CAP sets; from regions of at most CAP rows all, from
    denser ones those among neighbours in the order."""
    least = _least_agreement(percent)

    def whole(frame: pd.DataFrame, at: np.ndarray) -> pd.DataFrame:
        return _cells(frame["vertex"].to_numpy("i8"), frame["low"].to_numpy(), at, least)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carried = None
        for batch in batches:
            frame = batch if carried is None else pd.concat([carried, batch], ignore_index=True)
            carried = None
            if len(frame):
                at = cut_order(frame["region"].to_numpy(), np.array(frame["path"].tolist(), "i4"), CAP)
                carried = frame.iloc[at[-2] :]  # the last run may go on
                if len(at) > 2:
                    yield whole(frame, at[:-1])
        if carried is not None:
            yield whole(carried, np.array([0, len(carried)]))

    schema = "cell long, vertex long"
    found = map_groups(_signed(rows.where(F.col("n") <= CAP), sets).drop("path"), ["region"], whole, schema)
    dense = materialize(_signed(rows.where(F.col("n") > CAP), sets), "dense")  # written, as ranges are found in a pass before
    order = dense.repartitionByRange(_parts(rows), "region", "path", "vertex").sortWithinPartitions("region", "path", "vertex")
    return found.union(order.mapInPandas(frugal(walk), schema)).distinct()


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def apart_candidates(docs: DataFrame, rows: DataFrame, linked: DataFrame, percent: int) -> DataFrame:
    """(cell, vertex) for the rest of the dense regions: groups of rows that may be linked and are not in one component
    (id, component) yet. Rows of regions of several components are joined by their rarest shingles."""
    known = rows.where(F.col("n") > CAP).join(linked.hint("merge"), F.col("vertex") == F.col("id"), "left")
    known = materialize(known.select("region", "vertex", F.coalesce("component", "vertex").alias("component")), "contracted")
    open_ = known.groupBy("region").agg(F.min("component").alias("a"), F.max("component").alias("z")).where("a < z").select("region")
    left = materialize(known.join(open_.hint("merge"), "region").groupBy("vertex").agg(F.min("component").alias("component")), "apart")
    sample = F.broadcast(left.select("vertex").orderBy(F.xxhash64("vertex"), "vertex").limit(_prefixes.SAMPLE))
    counts = _prefixes.order_of(_texts(docs, sample), WIDTH)
    places = _prefixes.prefixes(_texts(docs, broadcast_if_small(left)), WIDTH, percent, counts)
    return _prefixes.meetings(materialize(places, "prefixes"), percent, CAP)


def _links(sets: list[np.ndarray], percent: int, own: np.ndarray, width: int = 4096) -> Iterator[tuple[int, int]]:
    """Pairs (i < j) of sets with 100 * intersection >= percent * union, exactly; of sets of two blocks (own), those of both."""
    n = np.array([len(s) for s in sets])
    if len(sets) <= 8:
        inter = np.zeros((len(sets), len(sets)))
        for i in range(len(sets)):
            for j in range(i + 1, len(sets)):
                if 100 * min(n[i], n[j]) >= percent * max(n[i], n[j]):
                    inter[i, j] = _shingles.overlap(sets[i], sets[j])
    else:
        names, column = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), n)
        often = np.bincount(column, minlength=len(names)) > 1  # others are in no intersection
        place = np.cumsum(often) - 1
        keep = often[column]
        row, column = row[keep], place[column[keep]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        inter = np.zeros((len(sets), len(sets)), "f4")
        for c in range(0, int(often.sum()), width):
            a, b = np.searchsorted(column, (c, c + width))
            m = np.zeros((len(sets), width), "f4")
            m[row[a:b], column[a:b] - c] = 1
            inter += m @ m.T
    linked = 100 * inter.astype("f8") >= percent * (n[:, None] + n[None, :] - inter.astype("f8"))
    if (own != own[0]).any():
        linked &= own[:, None] != own[None, :]
    i, j = np.nonzero(np.triu(linked, 1))
    yield from zip(i.tolist(), j.tolist())


def _texts(docs: DataFrame, vertices: DataFrame) -> DataFrame:
    """vertices (vertex, ...) with their texts."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.join(vertices, F.col("doc_id") == F.col("vertex")).select("text", *vertices.columns)


def links(docs: DataFrame, cells: DataFrame, sets: DataFrame, percent: int, few: bool = False) -> DataFrame:
    """Confirmed links (a, b) between vertices: for each cell a spanning forest of its links. Texts are shuffled to the
    cells' vertices; where `few` of them are expected the vertices are broadcast behind a count."""
    size = sets.select(F.col("vertex").alias("_v"), "n_shingles")
    sized = cells.join(size.hint("merge"), F.col("vertex") == F.col("_v"))
    blocks = sized.groupBy(F.col("cell").alias("_c")).agg(F.ceil(F.sum("n_shingles") * 16 / BYTES).cast("int").alias("blocks")).where("blocks > 1")
    dealt = cells.join(materialize(blocks, "blocks"), F.col("cell") == F.col("_c"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("vertex"), "blocks").cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))
    dealt = dealt.select("vertex", "cell", "own", F.explode(pair).alias("pair")).select("vertex", F.struct("cell", "own", "pair").alias("cell"))
    wanted = dealt.groupBy("vertex").agg(F.collect_list("cell").alias("cells"))  # a few: at most one a region and block
    texts = _texts(docs, broadcast_if_small(materialize(wanted, "wanted")) if few else wanted.hint("merge"))

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = batch["text"].tolist()
            for s in _chunks(found):
                values, begin = _shingles.shingle_sets(found[s], WIDTH)
                yield pd.DataFrame({"vertex": batch["vertex"][s], "cells": batch["cells"][s], "shingles": [values[a:b].tobytes() for a, b in zip(begin, begin[1:])]})

    made = texts.mapInPandas(frugal(again), f"vertex long, cells {wanted.schema['cells'].dataType.simpleString()}, shingles binary")
    made = made.select(F.explode("cells").alias("c"), "vertex", "shingles").select("c.cell", "c.own", "c.pair.i", "c.pair.j", "vertex", "shingles")

    def confirm(frame: pd.DataFrame, at: np.ndarray) -> pd.DataFrame:
        vertex, raw, block, out = frame["vertex"].to_numpy("i8"), frame["shingles"].to_numpy(), frame["own"].to_numpy(), []
        for a, b in zip(at, at[1:]):
            own, tree = [np.frombuffer(x, "u8") for x in raw[a:b]], Union(b - a)
            out += [(vertex[a + i], vertex[a + j]) for i, j in _links(own, percent, block[a:b]) if tree.join(i, j)]
        return pd.DataFrame(out, columns=["a", "b"], dtype="i8")

    return map_groups(made, ["cell", "i", "j"], confirm, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each document."""
    rows = materialize(sketches(docs), "sketches")
    named = rows.where("n_shingles > 0 and doc_id is not null")
    keys = ["key_a", "key_b"]
    first = F.min_by(F.struct("sig", "low", "n_shingles"), "doc_id")
    vertices = materialize(named.groupBy(*keys).agg(F.min("doc_id").alias("vertex"), first.alias("_")).select(*keys, "vertex", "_.*"), "sets")
    met = regions(vertices)
    near = materialize(links(docs, materialize(candidates(met, vertices, percent), "cells"), vertices, percent), "links")
    of_vertex = components(near, "a", "b")
    if met.where(F.col("n") > CAP).limit(1).count():
        rest = materialize(apart_candidates(docs, met, of_vertex, percent), "cells")
        if rest.limit(1).count():
            of_vertex = components(near.union(links(docs, rest, vertices, percent, few=True)), "a", "b")
    label = vertices.select(*keys, "vertex").join(of_vertex.hint("merge"), F.col("vertex") == F.col("id"), "left")
    label = label.select(F.col("key_a").alias("_a"), F.col("key_b").alias("_b"), F.coalesce("component", "vertex").alias("component"))
    same = (F.col("key_a") == F.col("_a")) & (F.col("key_b") == F.col("_b")) & (F.col("n_shingles") > 0)
    out = rows.select("doc_id", "n_shingles", *keys).join(label.hint("merge"), same, "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents that stay: one of each component, with their own columns. Of rows that repeat a doc_id one stays,
    that whose text has the least hash; rows without doc_id all stay."""
    gone = materialize(near_duplicates(docs, percent).where("not kept").select(F.col("doc_id").alias("_id")).distinct(), "gone")
    whole = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.struct(*docs.columns).alias("_row"))
    kept = whole.join(gone, F.col("_doc") == F.col("_id"), "left_anti")
    ids = docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.count("*").alias("_n"))
    twice = materialize(ids.where("_n > 1").select("_id"), "twice")
    if not twice.limit(1).count():
        return kept.select("_row.*")
    twice, on = broadcast_if_small(twice), F.col("_doc") == F.col("_id")
    one = kept.join(twice, on, "left_semi").groupBy("_doc").agg(F.min_by("_row", F.xxhash64("_row.text")).alias("_row"))
    return kept.join(twice, on, "left_anti").select("_row.*").unionByName(one.select("_row.*"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id::BIGINT AS doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingled AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sets AS (SELECT doc_id, len(s)::BIGINT AS n, s FROM shingled),
one AS (SELECT doc_id, n, unnest(s) AS x FROM sets),
link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM one a JOIN one b ON a.x = b.x AND a.doc_id != b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT a AS id, a AS other FROM link UNION SELECT r.id, l.b FROM reach r JOIN link l ON l.a = r.other),
component AS (SELECT id, min(other) AS c FROM reach GROUP BY id)
SELECT s.doc_id, s.n AS n_shingles, coalesce(c.c, s.doc_id) AS component_id, coalesce(s.doc_id = coalesce(c.c, s.doc_id), true) AS kept
FROM sets s LEFT JOIN component c ON c.id = s.doc_id
"""
