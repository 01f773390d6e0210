"""Near-duplicate vectors by cross-polytope hashing, with links confirmed in double precision.

A table of hashes rotates a vector at random, FUNCTIONS times over (three rounds of random signs and a fast Hadamard
transform each); a rotated vector's nearest axis, one of 2 d, is one part of its bucket. Multiprobe: a vector also enters the
buckets in which one part is its second-nearest axis. Vectors that meet in a bucket of any of TABLES tables are
compared, as a matrix product, in these steps:

1. Only ids and buckets' hashes are dealt out; of buckets with the same vectors one is kept. Equal vectors are collapsed before.
2. Buckets of the first EARLY tables are compared, those of more than CAP vectors in blocks; each returns a spanning forest of
   its links, and linked vectors are contracted to components.
3. Of all other buckets, and those that came in blocks, only vectors that are in different components still are shipped and
   compared, each with each: no pair that meets is left out, and near copies, which meet in most tables, are not compared again.
4. Links stand within components only. So their numbers come from one exact comparison of each component, in pairs of blocks:
   quadratic in the component, as counting the links of each of its vectors is; rows returned are not.

At cosine 0.93 in 64 dimensions a pair meets in a table with probability 0.47, in one of 24 with 1 - 2e-7.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and rows with null
label, are linked with nothing; vectors of different lengths are never linked; rows of equal vec_id are vectors of
their own that share a vertex; vectors of any length are padded to a power of two; ties between axes fall to the first; null vec_id
has null component and is kept; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import frugal, materialize, table
from ._components import components
from ._groups import map_groups
from ._regions import apart, members

COSINE = 0.93
TABLES, FUNCTIONS, EARLY = 24, 3, 8
#: Vectors that are compared at once.
CAP = 512
SEED = 11


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the number of columns is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x


def codes(unit: np.ndarray) -> np.ndarray:
    """Buckets of each row: rows x TABLES x (1 + FUNCTIONS) 32-bit numbers, the vector's own first, then the probes."""
    d = 1 << max(1, (unit.shape[1] - 1).bit_length())
    padded = np.zeros((len(unit), d), "f4")
    padded[:, : unit.shape[1]] = unit
    rng = np.random.default_rng(SEED)
    out = np.zeros((len(unit), TABLES, 1 + FUNCTIONS), "i8")
    rows = np.arange(len(unit))
    for t in range(TABLES):
        parts = []
        for _ in range(FUNCTIONS):
            x = padded
            for _ in range(3):
                x = hadamard(x * rng.choice(np.array([-1, 1], "f4"), d))
            size = np.abs(x)
            first = size.argmax(1)
            size[rows, first] = -1
            second = size.argmax(1)
            parts.append([2 * a + (x[rows, a] > 0) for a in (first, second)])
        for probe in range(1 + FUNCTIONS):
            code = np.zeros(len(unit), "i8")
            for k, (best, other) in enumerate(parts):
                code = code * (2 * d) + (other if probe == k + 1 else best)
            out[:, t, probe] = code
    return (out * np.int64(0x9E3779B1) >> np.int64(7) if 2 * d > 1290 else out).astype("i4")


def unit_rows(vectors: list) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Which vectors can be linked, and by length their (positions, unit vectors)."""
    by_length: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        if v is not None and len(v):
            by_length.setdefault(len(v), []).append(i)
    good, out = np.zeros(len(vectors), bool), {}
    for n, at in by_length.items():
        x = np.array([np.asarray(vectors[i], "f8") for i in at])
        with np.errstate(all="ignore"):
            top = np.abs(x).max(1, keepdims=True)
            ok = np.isfinite(top[:, 0]) & (top[:, 0] > 0)
            x = x[ok] / top[ok]
        at = np.array(at)[ok]
        good[at] = True
        out[n] = at, x / np.sqrt((x * x).sum(1, keepdims=True))
    return good, out


def hashed(vectors: DataFrame) -> DataFrame:
    """vec_id, label, dims (0: can't be linked), unit (binary doubles), buckets."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            _, by_length = unit_rows(batch["embedding"].tolist())
            dims = np.zeros(len(batch), "i4")
            unit, buckets = np.full(len(batch), None, object), np.full(len(batch), None, object)
            for n, (at, x) in by_length.items():
                dims[at] = n
                for i, v, c in zip(at, x, codes(x)):
                    unit[i], buckets[i] = v.tobytes(), c.tobytes()
            yield pd.DataFrame({"vec_id": batch["vec_id"].astype("Int64"), "label": batch["label"], "dims": dims, "unit": unit, "buckets": buckets})

    narrow = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return narrow.mapInPandas(frugal(run), "vec_id long, label string, dims int, unit binary, buckets binary")


def _entries(sets: DataFrame) -> DataFrame:
    """vertex, early (whether of the first tables) and region: the hash of each bucket (with label, dimensions and table) that it enters."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tab = np.repeat(np.arange(TABLES, dtype="i4"), 1 + FUNCTIONS)
        for batch in batches:
            if len(batch):
                own = np.frombuffer(b"".join(batch["buckets"]), "i4").reshape(len(batch), -1)
                each = {c: np.repeat(batch[c].to_numpy(), own.shape[1]) for c in ("vertex", "label", "dims")}
                yield pd.DataFrame({**each, "tab": np.tile(tab, len(batch)), "code": own.ravel()})

    rows = sets.select("vertex", "label", "dims", "buckets").mapInPandas(frugal(run), "vertex long, label string, dims int, tab int, code int")
    return rows.select("vertex", (F.col("tab") < EARLY).alias("early"), F.xxhash64("label", "dims", "tab", "code").alias("region"))


def buckets(sets: DataFrame) -> DataFrame:
    """(region, n, early, vertex): vectors that share a bucket with others, one bucket for the same vectors."""
    entries = _entries(sets)
    shared = entries.groupBy("region").agg(F.count("*").alias("n"), F.first("early").alias("early"), members().alias("m")).where("n > 1")
    once = shared.groupBy("n", "m").agg(F.max("early").alias("_early"), F.min(F.struct(~F.col("early"), "region"))["region"].alias("_r"))
    once = materialize(once.select("n", "_early", "_r"), "shared")
    met = entries.join(once.hint("merge"), F.col("region") == F.col("_r"))
    return materialize(met.select("region", "n", F.col("_early").alias("early"), "vertex"), "buckets")


def _least_labels(linked: np.ndarray) -> np.ndarray:
    """For a symmetric matrix of links: the least member of each row's component."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(1, initial=len(linked)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _units(frame: pd.DataFrame, a: int, b: int) -> np.ndarray:
    return np.frombuffer(b"".join(frame["unit"].iloc[a:b]), "f8").reshape(b - a, -1)


def _forest(rows: DataFrame, sets: DataFrame, cosine: float) -> DataFrame:
    """rows: (region, block, vertex, component) -> (a, b): a spanning forest of the links between components in each block."""
    def link(frame: pd.DataFrame, at: np.ndarray) -> pd.DataFrame:
        out, vertex, component = [], frame["vertex"].to_numpy("i8"), frame["component"].to_numpy("i8")
        for lo, hi in zip(at, at[1:]):
            unit, own = _units(frame, lo, hi), component[lo:hi]
            linked = (unit @ unit.T >= cosine) & (own[:, None] != own[None, :])
            if linked.any():
                least = _least_labels(linked)
                some = np.flatnonzero(least != np.arange(hi - lo))
                out.append(pd.DataFrame({"a": vertex[lo + some], "b": vertex[lo + least[some]]}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": []}).astype("i8")

    full = rows.join(sets.select(F.col("vertex").alias("_v"), "unit").hint("merge"), F.col("vertex") == F.col("_v")).drop("_v")
    return map_groups(full, ["region", "block"], link, "a long, b long")


def _counts(linked: DataFrame, sets: DataFrame, cosine: float) -> DataFrame:
    """(vertex, n): the number of vectors that each linked vertex is linked with, copies of them counted."""
    size = materialize(linked.groupBy(F.col("component").alias("_c")).agg(F.ceil(F.count("*") * 2 / CAP).cast("int").alias("blocks")), "sizes")
    dealt = linked.join(size, F.col("component") == F.col("_c")).withColumn("blocks", F.when(F.col("blocks") <= 2, 1).otherwise(F.col("blocks")))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))
    cells = dealt.select("component", "id", "own", F.explode(pair).alias("pair")).select("component", "id", "own", "pair.i", "pair.j")
    full = cells.join(sets.select("vertex", "copies", "unit").hint("merge"), F.col("id") == F.col("vertex")).drop("id")

    def count(frame: pd.DataFrame, at: np.ndarray) -> pd.DataFrame:
        out, vertex, copies, block = [], frame["vertex"].to_numpy("i8"), frame["copies"].to_numpy("i8"), frame["own"].to_numpy()
        for lo, hi in zip(at, at[1:]):
            unit, own = _units(frame, lo, hi), block[lo:hi]
            linked = unit @ unit.T >= cosine
            np.fill_diagonal(linked, False)
            if frame["i"].iloc[lo] != frame["j"].iloc[lo]:
                linked &= own[:, None] != own[None, :]
            out.append(pd.DataFrame({"vertex": vertex[lo:hi], "n": linked @ copies[lo:hi]}))
        return pd.concat(out) if out else pd.DataFrame({"vertex": [], "n": []}).astype("i8")

    found = map_groups(full, ["component", "i", "j"], count, "vertex long, n long")
    return found.groupBy("vertex").agg(F.sum("n").alias("n"))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each vector."""
    rows = materialize(hashed(vectors), "vectors")
    named = rows.where("dims > 0 and label is not null and vec_id is not null")
    same = [F.min("vec_id").alias("vertex"), F.count("*").alias("copies"), F.first("dims").alias("dims"), F.first("buckets").alias("buckets")]
    sets = materialize(named.groupBy("label", "unit").agg(*same), "sets")
    met = buckets(sets)
    early = met.where("early").withColumn("block", F.when(F.col("n") > CAP, F.pmod(F.xxhash64("vertex"), F.ceil(F.col("n") / CAP))).otherwise(0))
    found = materialize(_forest(early.select("region", "block", "vertex", F.col("vertex").alias("component")), sets, cosine), "found")
    linked = components(found, "a", "b")
    rest = apart(met.where(~F.col("early") | (F.col("n") > CAP)).drop("early"), linked, CAP)
    more = materialize(_forest(rest, sets, cosine), "found")
    if more.limit(1).count():
        linked = components(found.union(more), "a", "b")
    counts = _counts(linked, sets, cosine).withColumnRenamed("vertex", "_v")
    label = sets.select(F.col("label").alias("_label"), F.col("unit").alias("_unit"), "vertex", "copies")
    label = label.join(linked, F.col("vertex") == F.col("id"), "left").join(counts, F.col("vertex") == F.col("_v"), "left")
    n_links = (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    label = label.select("_label", "_unit", n_links, F.coalesce("component", "vertex").alias("component"))
    usable = (F.col("dims") > 0) & F.col("vec_id").isNotNull()
    out = rows.join(label, (F.col("label") == F.col("_label")) & (F.col("unit") == F.col("_unit")) & usable, "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id::BIGINT AS vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
good AS (
  SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x != 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id != b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT a AS id, a AS other FROM link UNION SELECT r.id, l.b FROM reach r JOIN link l ON l.a = r.other),
component AS (SELECT id, min(other) AS c FROM reach GROUP BY id),
degree AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT v.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, coalesce(c.c, v.vec_id) AS component_id, coalesce(v.vec_id = coalesce(c.c, v.vec_id), true) AS kept
FROM v LEFT JOIN component c ON c.id = v.vec_id LEFT JOIN degree d ON d.a = v.vec_id
"""
