"""Retrieval: vector, lexical and rule-based signals, fused and re-ranked.

Queries are few and chunks many: queries are broadcast in blocks of bounded size, chunks stay where they are and only the best
k of each partition travel. Order-dependent re-rankings run in applyInPandas by document or query, on candidates that
a top-k has bounded before.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import lexicon as L
from ..session import written
from ._groups import by_group
from ._nearest import Best, matrix, unit as _unit
from ..functions.text import availability_prior, inference_boost, repository_doi_prior, specific_score, word_tokens

#: BM25's parameters; query vectors that a broadcast may hold, more go in blocks.
K1, B = 1.5, 0.75
MOST_QUERIES = 20_000
#: Nearest of all rows: rows of a share at least, rows of a block at most, tasks at least where there are rows enough; rows of a batch that leaves.
BLOCK, STRIP, CELLS, OUT = 2048, 49_152, 48, 65_536
EPSILON = 1e-8
#: Tokens of lower-case texts, as word_tokens() finds them; terms that a worker may hold.
TOKEN = re.compile("[A-Za-z0-9_]+")
MOST_TERMS = 200_000
#: Labels whose best scores a task holds.
HELD = 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, in double precision; null if one has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def top(rows: DataFrame, k: int, by: list[str], score: str, tie: str) -> DataFrame:
    """The k best rows of each group with their rank, ties by id. WindowGroupLimit keeps k rows a partition before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.col(score).desc(), F.col(tie)))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def best_scores(hits: DataFrame, k: int, query: str = "query_id", id_col: str = "id", score: str = "score") -> DataFrame:
    """Each id once for each query, with its best score; the k best."""
    return top(hits.groupBy(query, id_col).agg(F.max(score).alias(score)), k, [query], score, id_col)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine", q: tuple[str, str] = ("query_id", "query"), v: tuple[str, str] = ("id", "vector")) -> DataFrame:
    """query_id, id, score, rank: the k nearest vectors for each query, by products of tiles. Queries are sent to each task once, at most
    MOST_QUERIES at a time: each further block is another pass over the vectors. A task keeps k rows for each query, whatever it reads."""
    kinds, rows = (dict(queries.dtypes)[q[0]], dict(vectors.dtypes)[v[0]]), queries.select(*q).toLocalIterator()
    found = _nearest(list(islice(rows, MOST_QUERIES)), kinds, vectors, k, metric, v)
    while block := list(islice(rows, MOST_QUERIES)):
        found = found.union(_nearest(block, kinds, vectors, k, metric, v))
    return top(found, k, ["query_id"], "score", "id")


def _nearest(rows: list, kinds: tuple[str, str], vectors: DataFrame, k: int, metric: str, v: tuple[str, str]) -> DataFrame:
    """query_id, id, score: for the queries of one block, the k nearest of each partition of vectors. There are as many partitions as keep the
    executors busy, since each of them gives k rows for every query."""
    names = [r[0] for r in rows]
    context = vectors.sparkSession.sparkContext
    shared = context.broadcast((names, np.array([r[1] for r in rows], "f8").reshape(len(rows), -1 if rows else 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, m = shared.value
        best = Best(np.arange(len(names)), m, k, metric)
        for batch in batches:
            if batch.num_rows and names:
                best.see(batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1)))
        i, ids, score = best.rows()
        for at in range(0, len(i), OUT):
            part = slice(at, at + OUT)
            yield pa.RecordBatch.from_arrays([pa.array([names[x] for x in i[part]], types[0]), pa.array(ids[part], types[1]), pa.array(score[part])], ["query_id", "id", "score"])

    schema = f"query_id {kinds[0]}, id {kinds[1]}, score double"
    types = _arrow(schema)
    some = vectors.where(F.col(v[1]).isNotNull()).select(F.col(v[0]).alias("id"), F.col(v[1]).alias("vector"))
    return some.coalesce(max(16, 2 * context.defaultParallelism)).mapInArrow(run, schema)


def _arrow(schema: str) -> list[pa.DataType]:
    return [to_arrow_type(f.dataType) for f in T.StructType.fromDDL(schema)]


def knn(vectors: DataFrame, k: int, include_self: bool = False, id_col: str = "vec_id", vector: str = "embedding", blocks: int | None = None) -> DataFrame:
    """id, neighbour, similarity, rank: the k nearest of all others by cosine. Exact, so quadratic in work, not in what is moved: a task has a
    block of rows (at most about STRIP) and a share of all others passes by it, and only the best k for each of its rows leave it. Null vectors are left out."""
    n = vectors.count()
    tiles = max(1, -(-n // BLOCK))
    blocks = blocks or max(-(-n // STRIP), min(4, tiles))
    shares = min(tiles, -(-CELLS // blocks))
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
    own, share = (F.pmod(F.xxhash64(F.lit(i), "id"), F.lit(m)).cast("int") for i, m in enumerate((blocks, shares)))
    to = lambda cell, passes: F.struct(cell.cast("int").alias("cell"), F.lit(passes).alias("passes"))
    cells = F.concat(F.transform(F.sequence(F.lit(0), F.lit(shares - 1)), lambda s: to(own * shares + s, False)), F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: to(b * shares + share, True)))
    dealt = rows.select("id", "v", F.explode(cells).alias("c")).select("c.*", "id", "v").repartitionById(blocks * shares, "cell").sortWithinPartitions("cell", "passes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, best = None, [], None

        def done() -> Iterator[pa.RecordBatch]:
            i, others, s = best.rows() if best is not None else ((), (), ())
            for at in range(0, len(i), OUT):
                part = slice(at, at + OUT)
                yield pa.RecordBatch.from_arrays([pa.array(best.ids[i[part]], types[0]), pa.array(others[part], types[1]), pa.array(s[part])], ["id", "neighbour", "similarity"])

        for batch in batches:
            where = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy(zero_copy_only=False)
            edges = [0, *(np.nonzero(np.diff(where))[0] + 1), len(where)] if len(where) else []
            for start, end in zip(edges, edges[1:]):
                piece = batch.slice(start, end - start)
                if where[start] // 2 != cell:
                    yield from done()
                    cell, held, best = where[start] // 2, [], None
                ids, x = piece.column(2).to_numpy(zero_copy_only=False), matrix(piece.column(3))
                if not where[start] % 2:
                    held.append((ids, x))
                elif held:
                    if best is None:
                        best = Best(*(np.concatenate(c) for c in zip(*held)), k, others=not include_self)
                    best.see(ids, x)
        yield from done()

    kind = dict(vectors.dtypes)[id_col]
    schema = f"id {kind}, neighbour {kind}, similarity double"
    types = _arrow(schema)
    return top(dealt.mapInArrow(run, schema), k, ["id"], "similarity", "neighbour")


def bm25_stats(chunks: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunk_id, term, tf, length), (term, df, idf), (n, avg_length): the corpus statistics."""
    tokens = chunks.select("chunk_id", word_tokens(text).alias("_t"))
    lengths = tokens.agg(F.count("*").alias("n"), F.avg(F.size("_t")).alias("avg_length"))
    terms = tokens.select("chunk_id", F.size("_t").alias("length"), F.explode("_t").alias("term")).groupBy("chunk_id", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))
    df = terms.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(lengths.select("n")))  # one row
    idf = F.log((F.col("n") - F.col("df") + F.lit(0.5).cast("double")) / (F.col("df") + F.lit(0.5).cast("double")) + F.lit(1e-12).cast("double"))
    return terms, df.select("term", "df", idf.alias("idf")), lengths


def _term_counts(chunks: DataFrame, terms: list[str], text: str, sizes: bool) -> DataFrame:
    """chunk_id, term, tf, length: how often a chunk has each of the terms, and with sizes a row without term for each chunk."""
    kind = dict(chunks.dtypes)["chunk_id"]
    schema = f"chunk_id {kind}, term string, tf double, length double"
    types, shared = _arrow(schema), chunks.sparkSession.sparkContext.broadcast(frozenset(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            out: list[tuple] = []
            for cid, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = TOKEN.findall(t or "")
                length = None if t is None else float(len(tokens))
                if sizes:
                    out.append((cid, None, None, length))
                out += [(cid, w, float(n), length) for w, n in Counter(w for w in tokens if w in wanted).items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), types)], ["chunk_id", "term", "tf", "length"])

    return chunks.select("chunk_id", F.lower(text).alias("t")).mapInArrow(run, schema)


def bm25(queries: DataFrame, chunks: DataFrame, k: int, text: str = "text") -> DataFrame:
    """query_id, chunk_id, score, rank. queries: query_id, text; repeated query terms count repeatedly. Only terms of queries
    are counted in the corpus, in one pass over it for each MOST_TERMS of them, so what is written and shuffled follows the matches."""
    wanted = queries.select("query_id", F.explode(word_tokens("text")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    terms = (r.term for r in wanted.select("term").distinct().toLocalIterator())
    counts = _term_counts(chunks, list(islice(terms, MOST_TERMS)), text, True)
    while block := list(islice(terms, MOST_TERMS)):
        counts = counts.union(_term_counts(chunks, block, text, False))
    counts = written(counts, "terms")
    corpus = counts.where("term is null").agg(F.count("*").cast("double").alias("n"), F.avg("length").alias("avg_length"))
    hits = counts.where("term is not null")
    d = lambda x: F.lit(float(x))
    df = hits.groupBy("term").agg(F.count("*").cast("double").alias("df"))
    scored = hits.join(df, "term").crossJoin(F.broadcast(corpus)).join(wanted, "term")  # corpus: one row
    idf = F.log((F.col("n") - F.col("df") + d(0.5)) / (F.col("df") + d(0.5)) + d(1e-12))
    part = idf * F.col("tf") * d(K1 + 1) / (F.col("tf") + d(K1) * (d(1 - B) + d(B) * F.col("length") / F.col("avg_length")))
    return top(scored.groupBy("query_id", "chunk_id").agg(F.sum(part * F.col("times")).alias("score")), k, ["query_id"], "score", "chunk_id")


def rank_fusion(rankings: DataFrame, k: int = 60) -> DataFrame:
    """rankings: query_id, list, id, rank (from 1) -> query_id, id, score = sum of 1 / (k + rank)."""
    return rankings.groupBy("query_id", "id").agg(F.sum(F.lit(1.0).cast("double") / (F.lit(k) + F.col("rank"))).alias("score"))


def minmax(value: str | Column, by: list[str]) -> Column:
    """A value scaled to 0..1 over its group; a constant group gives 0."""
    v = F.col(value) if isinstance(value, str) else value
    w = W.partitionBy(*by)
    low, high = F.min(v).over(w), F.max(v).over(w)
    return F.when(high <= low, 0.0).otherwise((v - low) / (high - low))


def neighbour_boost(ranked: DataFrame, value: str, by: list[str], rank: str = "rank") -> Column:
    """Capped share of the values of the rows next in rank."""
    w = W.partitionBy(*by).orderBy(rank)
    near = F.coalesce(F.lag(value).over(w), F.lit(0.0)) + F.coalesce(F.lead(value).over(w), F.lit(0.0))
    return F.least(near * L.NEIGHBOUR_STEP, F.lit(L.NEIGHBOUR_CAP))


def prototype_affinity(chunks: DataFrame, prototypes: list[list[float]], m: int = 1, vector: str = "embedding") -> Column:
    """Mean of a chunk's m greatest cosines with the prototypes (a small set, part of the expression)."""
    sims = F.array(*[cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in p])) for p in prototypes])
    best = F.slice(F.sort_array(sims, asc=False), 1, m)
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(best)


def stacked(queries: DataFrame, prototypes: DataFrame) -> DataFrame:
    """query_id, vector: the prototypes' vectors (prototype_id, vector) under the queries', as further queries."""
    return queries.select(F.col("query_id").cast("string").alias("query_id"), "vector").union(
        prototypes.select(F.concat(F.lit("prototype_"), F.col("prototype_id").cast("string")), "vector"))


def hybrid(queries: DataFrame, chunks: DataFrame, k: int = 25, per_signal: int | None = None, prototypes: list[list[float]] = (), m: int = 1) -> DataFrame:
    """queries: query_id, text, vector. chunks: chunk_id, text, vector. Candidates of BM25 and vectors are fused by rank, scored
    with the rule-based priors and boosts, and returned with their fused score and rank. With prototypes (a small, stated set) the chunks
    nearest to any of them are candidates too, and the mean of a candidate's m greatest cosines with them is part of its score."""
    n = per_signal or 3 * k
    sparse = bm25(queries, chunks, n).select("query_id", F.lit("sparse").alias("list"), F.col("chunk_id").alias("id"), "rank")
    dense = nearest(queries, chunks, n, q=("query_id", "vector"), v=("chunk_id", "vector")).select("query_id", F.lit("dense").alias("list"), "id", "rank")
    fused = rank_fusion(sparse.union(dense), max(5, n // 2))
    if prototypes:
        spark = queries.sparkSession
        liked = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(prototypes)], "prototype_id int, vector array<double>")
        pool = nearest(liked, chunks, n, q=("prototype_id", "vector"), v=("chunk_id", "vector")).select("id").distinct()  # n a prototype at most
        pairs = queries.select("query_id").crossJoin(F.broadcast(pool))
        fused = fused.join(pairs, ["query_id", "id"], "full").withColumn("score", F.coalesce("score", F.lit(0.0)))
    fused = written(fused.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))), "fused")
    # rules read a candidate's text once, however many queries it is a candidate of
    texts = chunks.select(F.col("chunk_id").alias("id"), "text", "vector").join(fused.select("id").distinct(), "id", "left_semi")
    affinity = prototype_affinity(chunks, prototypes, m, "vector") if prototypes else F.lit(0.0)
    rules = texts.select("id", affinity.alias("prototype"), availability_prior("text").alias("das"), specific_score("text").alias("regex"), repository_doi_prior("text").alias("doi_repo"), inference_boost("text").alias("boost"))
    rows = fused.join(rules.repartition("id"), "id").withColumn("rrf", minmax("score", ["query_id"]))
    rows = rows.withColumn("near", neighbour_boost(rows, "regex", ["query_id"]))
    total = sum((F.lit(L.FUSION[c]) * F.col(c) for c in ("prototype", "rrf", "das", "regex", "doi_repo")), F.col("near") + F.col("boost"))
    return top(rows.select("query_id", "id", total.alias("fused")), k, ["query_id"], "fused", "id")


def percentile_gate(rows: DataFrame, score: str, p: float = 0.7, by: list[str] | None = None) -> DataFrame:
    """Rows at or above the p-th percentile (linear) of their group's scores."""
    limit = rows.groupBy(*(by or [])).agg(F.percentile(score, F.lit(p)).alias("_limit"))
    joined = rows.join(limit, by) if by else rows.crossJoin(F.broadcast(limit))  # one row
    return joined.where(F.col(score) >= F.col("_limit")).drop("_limit")


def collapse_neighbours(ranked: DataFrame, by: str = "document_id") -> DataFrame:
    """Walk each document's chunks by rank and drop the direct neighbours of every kept one. Neighbours never cross documents.
    Only ids and ranks reach Python."""
    kind = dict(ranked.dtypes)

    def walk(rows: list[tuple]) -> list[tuple]:
        there, banned, keep = {r[1] for r in rows}, set(), []
        for doc, cid, _, before, after in rows:
            if cid not in banned:
                keep.append((doc, cid))
                banned |= {before, after} & there
        return keep

    ids = ranked.select(by, "chunk_id", "rank", "previous_chunk_id", "next_chunk_id")
    kept = by_group(ids, by, ["rank", "chunk_id"], walk, f"{by} {kind[by]}, chunk_id {kind['chunk_id']}")
    return ranked.join(kept, [by, "chunk_id"], "left_semi")


def mmr(candidates: DataFrame, k: int = 25, trade: float = 0.7, by: str = "query_id") -> DataFrame:
    """Greedy choice of relevant and different rows. candidates: query_id, id, query, vector (bounded by a top-k before) ->
    also mmr_rank for the k chosen."""
    def choose(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id").reset_index(drop=True)
        v = _unit(np.array(g["vector"].tolist(), "f8"))
        q = _unit(np.array(g["query"].iloc[0], "f8"))
        relevance, repeat, left, chosen = v @ q, np.zeros(len(g)), np.ones(len(g), bool), []
        for _ in range(min(k, len(g))):
            value = np.where(left, trade * relevance - (1 - trade) * repeat, -np.inf)
            i = int(value.argmax())
            chosen.append(i)
            left[i] = False
            similar = v @ v[i]
            repeat = similar if len(chosen) == 1 else np.maximum(repeat, similar)
        return g.iloc[chosen].assign(mmr_rank=range(1, len(chosen) + 1))

    return candidates.groupBy(by).applyInPandas(choose, T.StructType([*candidates.schema.fields, T.StructField("mmr_rank", T.IntegerType())]))


def expand_and_prune(ranked: DataFrame, k: int = 15, most_tokens: int = 1000, by: str = "document_id") -> DataFrame:
    """ranked: document_id, chunk_id, rank (null: not ranked, only a possible neighbour), previous_chunk_id, next_chunk_id, token_count.
    Takes ranked chunks and their neighbours up to k, then drops neighbours before anchors from the last rank up until the tokens fit."""
    def pick(rows: list[tuple]) -> list[tuple]:
        tokens = {r[1]: r[5] for r in rows}
        taken: list[str] = []
        groups = []
        for _, anchor, rank, before, after, _ in rows:
            if rank is None:
                continue
            if len(taken) >= k:
                break
            own = []
            for i, cid in enumerate((anchor, before, after)):
                if cid in tokens and cid not in taken and len(taken) < k:
                    taken.append(cid)
                    own += [cid] if i else []
            groups.append((anchor, own))
        total = sum(tokens[c] for c in taken)
        for anchor, own in reversed(groups):
            for cid in [*own, anchor]:
                if total > most_tokens and cid in taken:
                    taken.remove(cid)
                    total -= tokens[cid]
        return [(rows[0][0], cid, n) for n, cid in enumerate(taken, 1)]

    kind = dict(ranked.dtypes)
    narrow = ranked.select(by, "chunk_id", "rank", "previous_chunk_id", "next_chunk_id", "token_count")
    return by_group(narrow, by, ["rank", "chunk_id"], pick, f"{by} {kind[by]}, chunk_id {kind['chunk_id']}, position int")


def ordered_union(first: Column, then: Column, k: int) -> Column:
    return F.array_distinct(F.concat(first, F.slice(then, 1, k)))


def triplets(rows: DataFrame, by: str = "document_id", order: str = "ordinal", id_col: str = "chunk_id") -> DataFrame:
    w = W.partitionBy(by).orderBy(order)
    return rows.select(by, order, F.lag(id_col).over(w).alias("pre"), F.col(id_col).alias("anchor"), F.lead(id_col).over(w).alias("post"))


def merge_triplets(rows: DataFrame, by: str = "document_id", order: str = "ordinal") -> DataFrame:
    """Join triplets that share two ids with the first group that fits: document_id, group (from 0), chunk_ids (sorted), anchors (in order)."""
    def merge(triples: list[tuple]) -> list[tuple]:
        groups: list[tuple[set, list]] = []
        for _, _, pre, anchor, post in triples:
            ids = {x for x in (pre, anchor, post) if x}
            fit = next((g for g in groups if len(g[0] & ids) >= 2), None)
            if fit is None:
                groups.append((set(ids), [anchor]))
            else:
                fit[0].update(ids)
                fit[1].append(anchor)
        return [(triples[0][0], n, sorted(ids), anchors) for n, (ids, anchors) in enumerate(groups)]

    kind = dict(rows.dtypes)
    return by_group(rows.select(by, order, "pre", "anchor", "post"), by, [order], merge, f"{by} {kind[by]}, group int, chunk_ids array<{kind['anchor']}>, anchors array<{kind['anchor']}>")


def budget_groups(groups: DataFrame, tokens: DataFrame, most: int = 1000, by: str = "document_id") -> DataFrame:
    """Drop neighbours from the end, then anchors from the end, until a group's tokens fit. tokens: document_id, tokens (map id -> count)."""
    def fit(rows: list[tuple]) -> list[tuple]:
        out = []
        for doc, n, ids, anchors, counts in rows:
            ids, anchors, count = list(ids), set(anchors), dict(counts if counts is not None else {})
            left = set(ids)
            for c in [c for c in reversed(ids) if c not in anchors] + [c for c in reversed(ids) if c in anchors]:
                if sum(count.get(x, 0) for x in left) <= most:
                    break
                left.discard(c)
            out.append((doc, n, [c for c in ids if c in left]))
        return out

    kind = dict(groups.dtypes)
    joined = groups.join(tokens, by).select(by, "group", "chunk_ids", "anchors", "tokens")
    return by_group(joined, by, ["group"], fit, f"{by} {kind[by]}, group int, chunk_ids {kind['chunk_ids']}")


def result_stats(results: DataFrame, score: str = "score") -> DataFrame:
    """Median, greatest and mean score of results above 0."""
    good = results.where(F.col(score) > 0)
    return good.agg(F.median(score).alias("median_score"), F.max(score).alias("max_score"), F.avg(score).alias("avg_score"))


def hash_embedding(texts: DataFrame, key: str, text: str = "text", dims: int = 64) -> DataFrame:
    """key, dim, value: a deterministic embedding where no model is installed. Each token adds 1 or -1 to the dimension its md5 names."""
    tokens = texts.select(key, F.explode(word_tokens(text)).alias("t")).withColumn("h", F.md5(F.col("t").cast("binary")))
    dim = F.pmod(F.conv(F.substring("h", 1, 6), 16, 10).cast("int"), F.lit(dims)).alias("dim")
    sign = F.when(F.conv(F.substring("h", 7, 1), 16, 10).cast("int") < 8, 1.0).otherwise(-1.0)
    return tokens.groupBy(key, dim).agg(F.sum(sign).alias("value"))


def as_vectors(long: DataFrame, key: str, dims: int = 64) -> DataFrame:
    """key, embedding: long embeddings as arrays scaled to length 1."""
    entries = F.map_from_entries(F.collect_list(F.struct("dim", "value")))
    v = long.groupBy(key).agg(entries.alias("m")).select(key, F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("v"))
    return v.select(key, F.transform("v", lambda x: F.coalesce(F.try_divide(x, norm(F.col("v"))), F.lit(0.0))).alias("embedding"))


def embedding(text: str | Column, dims: int = 64) -> Column:
    """The vector of as_vectors(hash_embedding()), text by text, without a row for each token; null without tokens."""
    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        place: dict[str, int] = {}

        def one(t: str | None) -> np.ndarray | None:
            tokens = TOKEN.findall(t or "")
            if not tokens:
                return None
            if len(place) > MOST_TERMS:
                place.clear()
            for w in {w for w in tokens if w not in place}:
                h = hashlib.md5(w.encode()).hexdigest()
                place[w] = int(h[:6], 16) % dims + (0 if int(h[6], 16) < 8 else dims)
            n = np.bincount([place[w] for w in tokens], minlength=2 * dims)
            v = (n[:dims] - n[dims:]).astype("f8")
            return v / np.sqrt((v * v).sum()) if v.any() else v

        return texts.map(one)

    return of(F.lower(F.col(text) if isinstance(text, str) else text))


def with_vectors(texts: DataFrame, key: str, text: str = "text", dims: int = 64) -> DataFrame:
    """Every row of texts with its vector, a hash embedding; without tokens zeros."""
    zeros = F.array_repeat(F.lit(0.0).cast("double"), dims)
    return texts.withColumn("vector", F.coalesce(embedding(text, dims), zeros))


def _blocks(queries: DataFrame) -> Iterator[list]:
    rows = queries.toLocalIterator()
    while block := list(islice(rows, MOST_QUERIES)):
        yield block


def within_group(queries: DataFrame, vectors: DataFrame, k: int, by: str) -> DataFrame:
    """query_id, id, score, rank: the k nearest vectors of each query's own group, by tiles. A group is never gathered, and no pair becomes a row.
    Queries without a group find nothing."""
    kinds = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["id"]
    context, schema = vectors.sparkSession.sparkContext, f"query_id {kinds[0]}, id {kinds[1]}, score double"
    types = _arrow(schema)
    some = vectors.where(F.col("vector").isNotNull() & F.col(by).isNotNull()).select("id", "vector", by).coalesce(max(16, 2 * context.defaultParallelism))

    def of(block: list) -> DataFrame:
        groups: dict = {}
        for name, v, g in block:
            groups.setdefault(g, ([], []))[0].append(name)
            groups[g][1].append(v)
        shared = context.broadcast({g: (names, np.array(v, "f8")) for g, (names, v) in groups.items()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict = {}
            for batch in batches:
                for g, ids, x in _by_label(batch):
                    if g in shared.value:
                        if g not in held:
                            held[g] = Best(np.arange(len(shared.value[g][0])), shared.value[g][1], k)
                        held[g].see(ids, x)
            for g, best in held.items():
                i, ids, score = best.rows()
                yield pa.RecordBatch.from_arrays([pa.array([shared.value[g][0][n] for n in i], types[0]), pa.array(ids, types[1]), pa.array(score)], ["query_id", "id", "score"])

        return some.mapInArrow(run, schema)

    found = [of(block) for block in _blocks(queries.select("query_id", "query", by).where(F.col(by).isNotNull()))]
    empty = vectors.sparkSession.createDataFrame([], schema)
    return top(reduce(DataFrame.union, found, empty), k, ["query_id"], "score", "id")


def _by_label(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(label, ids, vectors) of a batch's columns id, vector and label."""
    if batch.num_rows:
        coded = batch.column(2).dictionary_encode(null_encoding="encode")
        codes, labels = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        ids, x = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1))
        for n, label in enumerate(labels):
            rows = np.nonzero(codes == n)[0]
            yield label, ids[rows], x[rows]


def best_labels(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, label, score, rank: the k labels whose best vector (id, vector, label) is nearest to each query, by tiles. A task holds the best of
    HELD labels at most; then it gives those that are among the query's k best of these (or tie), which no label of the result can fail to be."""
    kinds = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["label"]
    context, schema = vectors.sparkSession.sparkContext, f"query_id {kinds[0]}, label {kinds[1]}, score double"
    types = _arrow(schema)
    some = vectors.where(F.col("vector").isNotNull()).select("id", "vector", "label").coalesce(max(16, 2 * context.defaultParallelism))

    def of(block: list) -> DataFrame:
        shared = context.broadcast(([r[0] for r in block], np.array([r[1] for r in block], "f8")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, m = shared.value
            none, held = Best(np.arange(len(names)), m, 1), {}

            def given() -> Iterator[pa.RecordBatch]:
                labels = list(held)
                s = np.column_stack([held[x].score[:, 0] for x in labels]) if labels else np.zeros((0, 0))
                least = np.partition(s, -k, axis=1)[:, -k] if len(labels) > k else np.full(len(s), -np.inf)
                i, j = np.nonzero((s >= least[:, None]) & (s > -np.inf))
                yield pa.RecordBatch.from_arrays([pa.array([names[n] for n in i], types[0]), pa.array([labels[n] for n in j], types[1]), pa.array(s[i, j])], ["query_id", "label", "score"])

            for batch in batches:
                for label, ids, x in _by_label(batch):
                    if label not in held and len(held) == HELD:
                        yield from given()
                        held = {}
                    held.setdefault(label, none.again() if label not in held else None).see(ids, x)
            yield from given()

        return some.mapInArrow(run, schema)

    found = reduce(DataFrame.union, [of(block) for block in _blocks(queries.select("query_id", "query"))], vectors.sparkSession.createDataFrame([], schema))
    return best_scores(found, k, id_col="label")


def training_retrieval(queries: DataFrame, chunks: DataFrame, k: int = 3, boost: float = 0.15, fuse: bool = True) -> DataFrame:
    """query_id, id, score, rank. chunks: id, vector, text, cited. The 5 k nearest for each query, then cosine plus the
    boost of keywords; all queries in one join, so results stay with their keys."""
    from ..functions.text import training_boost

    near = nearest(queries, chunks, 5 * k)
    if not fuse:
        return near.where(F.col("rank") <= k)
    near = written(near, "near")
    rules = _candidates(near, chunks).select("id", training_boost("text", F.col("cited")).alias("_b"))
    joined = near.drop("rank").join(rules, "id")
    return top(joined.select("query_id", "id", (F.col("score") + F.lit(boost) * F.col("_b")).alias("score")), k, ["query_id"], "score", "id")


def _candidates(near: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks that are near to any query, each once: rules read a text once and no text is copied for each query."""
    return chunks.join(near.select("id").distinct(), "id", "left_semi")


def boosted_dense(queries: DataFrame, chunks: DataFrame, prototypes: DataFrame | None = None, k: int = 25, presence: float = 0.5) -> DataFrame:
    """query_id, id, score, rank: scaled cosine plus keyword boost, plus `presence` for chunks among the k nearest of a prototype."""
    near = written(nearest(queries, chunks, 5 * k), "near")
    rules = _candidates(near, chunks).select("id", inference_boost("text").alias("_b"))
    joined = near.withColumn("scaled", minmax("score", ["query_id"])).join(rules, "id")
    score = F.col("scaled") + F.col("_b")
    if prototypes is not None:
        liked = nearest(prototypes, chunks, k).select("id").distinct().withColumn("liked", F.lit(True))
        joined = joined.join(liked, "id", "left")
        score = score + F.when(F.col("liked"), presence).otherwise(0.0)
    return top(joined.select("query_id", "id", score.alias("score")), k, ["query_id"], "score", "id")


def _in_documents(queries: DataFrame, chunks: DataFrame, score: Callable[[Column], Column], k: int) -> DataFrame:
    """Every chunk for each query (a stated set, sent to all tasks), ranked within query and document; below rank k the rank is null."""
    q = queries.select("query_id", F.col("vector").alias("_q"))
    scored = chunks.crossJoin(F.broadcast(q)).withColumn("_s", score(F.col("_q")))
    rank = F.row_number().over(W.partitionBy("query_id", "document_id").orderBy(F.desc("_s"), "chunk_id"))
    ranked = scored.withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return ranked.withColumn("key", F.to_json(F.struct("query_id", "document_id")))


def _pruned(ranked: DataFrame, queries: DataFrame, chunks: DataFrame, k: int, most_tokens: int) -> DataFrame:
    out = expand_and_prune(ranked.select("key", "chunk_id", "rank", "previous_chunk_id", "next_chunk_id", "token_count"), k, most_tokens, by="key")
    kind = f"struct<query_id: {dict(queries.dtypes)['query_id']}, document_id: {dict(chunks.dtypes)['document_id']}>"
    return out.select(F.from_json("key", kind).alias("key"), "chunk_id", "position").select("key.*", "chunk_id", "position")


def _signal(q: Column) -> Column:
    return cosine(F.col("vector"), q) + availability_prior("text") + specific_score("text") + repository_doi_prior("text") + inference_boost("text")


def document_context(queries: DataFrame, chunks: DataFrame, k: int = 15, most_tokens: int = 1000) -> DataFrame:
    """query_id, document_id, chunk_id, position: chunks for each stated query (query_id, text, vector), chosen in each document. chunks: document_id,
    chunk_id, text, vector, previous_chunk_id, next_chunk_id, token_count. Hybrid ranks within documents, then neighbours, then the token budget."""
    return _pruned(_in_documents(queries, chunks, _signal, k), queries, chunks, k, most_tokens)


def two_pass_context(queries: DataFrame, chunks: DataFrame, embed: Callable[[DataFrame], DataFrame], k: int = 15, anchors: int = 3, most_tokens: int = 1000) -> DataFrame:
    """As document_context(), in two passes: the best `anchors` chunks of a document and their neighbours make a new query text, which
    embed (rows with key and text -> rows with key and vector) turns into a vector; chunks are ranked anew by scaled cosine and keywords, after the
    anchors and their neighbours, each once, and the token budget is held."""
    first = _in_documents(queries, chunks, _signal, k)
    near = F.array("chunk_id", "previous_chunk_id", "next_chunk_id")
    taken = first.where(F.col("rank") <= anchors).select("key", "rank", F.posexplode(near).alias("place", "chunk_id")).where("chunk_id is not null")
    taken = taken.groupBy("key", "chunk_id").agg(F.min(F.struct("rank", "place")).alias("first"))
    texts = first.select("key", "chunk_id", "text").join(taken, ["key", "chunk_id"])
    ordered = F.array_sort(F.collect_list(F.struct("first", "text")))  # 3 * anchors texts
    merged = embed(texts.groupBy("key").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text"))).select("key", F.col("vector").alias("_again"))
    again = first.join(merged, "key").withColumn("_c", cosine(F.col("vector"), F.col("_again")))
    again = again.withColumn("_s", minmax("_c", ["key"]) + inference_boost("text")).join(taken, ["key", "chunk_id"], "left")
    order = W.partitionBy("key").orderBy(F.col("first").asc_nulls_last(), F.desc("_s"), "chunk_id")
    ranked = again.withColumn("rank", F.row_number().over(order)).withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return _pruned(ranked, queries, chunks, k, most_tokens)


def corpus_context(queries: DataFrame, chunks: DataFrame, k: int = 200, percentile: float = 0.7) -> DataFrame:
    """query_id, document_id, pre, anchor, post, position: triplets around the chunks that each query ranks best over the whole corpus: hybrid
    scores, collapse of neighbours within query and document, percentile gate, diversity. Every anchor past the gate stays; position is its
    place by relevance and diversity."""
    ranked = hybrid(queries, chunks, k).withColumnRenamed("id", "chunk_id")
    info = ranked.join(chunks.select("chunk_id", "document_id", "vector", "previous_chunk_id", "next_chunk_id"), "chunk_id")
    info = written(info.withColumn("key", F.to_json(F.struct("query_id", "document_id"))), "ranked")  # k rows a query
    kept = collapse_neighbours(info.select("key", "document_id", "chunk_id", "rank", "fused", "query_id", "vector", "previous_chunk_id", "next_chunk_id"), by="key")
    gated = percentile_gate(kept, "fused", percentile, ["query_id"])
    wanted = gated.join(queries.select("query_id", F.col("vector").alias("query")), "query_id")
    chosen = mmr(wanted.select("query_id", F.col("chunk_id").alias("id"), "query", "vector"), k).select("query_id", F.col("id").alias("anchor"), F.col("mmr_rank").alias("position"))
    around = info.select("query_id", "document_id", F.col("chunk_id").alias("anchor"), F.col("previous_chunk_id").alias("pre"), F.col("next_chunk_id").alias("post"))
    return chosen.join(around.distinct(), ["query_id", "anchor"]).select("query_id", "document_id", "pre", "anchor", "post", "position")


def with_target(retrieved: DataFrame, targets: DataFrame, key: str = "dataset_id") -> DataFrame:
    """key, chunk_ids: retrieved ids with a dataset's own chunks and their neighbours, sorted."""
    empty = F.array().cast("array<string>")
    joined = retrieved.join(targets, key, "full")
    return joined.select(key, F.array_sort(F.array_union(F.coalesce("retrieved", empty), F.coalesce("targets", empty))).alias("chunk_ids"))


def step_order(needs: dict[str, list[str]]) -> list[str]:
    """Steps after those that they need, alphabetical among the ready ones."""
    left, out = {k: set(v) for k, v in needs.items()}, []
    while left:
        ready = sorted(k for k, v in left.items() if not v & left.keys())
        if not ready:
            raise ValueError("the steps need each other")
        out.append(ready[0])
        del left[ready[0]]
    return out
