"""Ranking, fusion and re-ranking."""

import math

import numpy as np
from pyspark.sql import functions as F

from lexquarry.operators import chunking, features, graph, models, retrieval


def test_knn_blocks_agree_with_brute_force(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {(r.id, r.neighbour) for r in retrieval.knn(df, 3, blocks=4).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    assert got == {(i, int(j)) for i in range(60) for j in np.argsort(-s[i])[:3]}


def test_bm25_counts_query_terms_and_may_be_negative(spark):
    docs = {"a": "x y y", "b": "x z", "c": "x"}
    chunks = spark.createDataFrame(list(docs.items()), "chunk_id string, text string")
    got = {r.chunk_id: r.score for r in retrieval.bm25(spark.createDataFrame([(1, "x Y y")], "query_id int, text string"), chunks, 5).collect()}
    n, al = 3, 2.0
    idf = lambda df: math.log((n - df + 0.5) / (df + 0.5) + 1e-12)
    part = lambda tf, length, df: idf(df) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / al))
    assert math.isclose(got["a"], part(1, 3, 3) + 2 * part(2, 3, 1)) and got["b"] < 0


def test_fusion_and_minmax(spark):
    df = spark.createDataFrame([(1, "p", "a", 1), (1, "q", "a", 2), (1, "q", "b", 1)], "query_id int, list string, id string, rank int")
    got = {r.id: r.score for r in retrieval.rank_fusion(df).collect()}
    assert math.isclose(got["a"], 1 / 61 + 1 / 62) and math.isclose(got["b"], 1 / 61)
    same = spark.createDataFrame([(1, 2.0), (1, 2.0)], "g int, s double")
    assert [r.m for r in same.select(retrieval.minmax("s", ["g"]).alias("m")).collect()] == [0.0, 0.0]


def test_gate_with_equal_scores(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(5)], "id int, s double")
    assert retrieval.percentile_gate(df, "s").count() == 5


def _ranked(spark):
    rows = [("d", f"c{i}", r, f"c{i - 1}" if i else None, f"c{i + 1}" if i < 4 else None, 10) for i, r in enumerate([2, 1, 4, None, 3])]
    return spark.createDataFrame(rows, "document_id string, chunk_id string, rank int, previous_chunk_id string, next_chunk_id string, token_count int")


def test_collapse_and_budget(spark):
    kept = {r.chunk_id for r in retrieval.collapse_neighbours(_ranked(spark).where("rank is not null")).collect()}
    assert kept == {"c1", "c4"}
    picked = [r.chunk_id for r in retrieval.expand_and_prune(_ranked(spark), 5, 30).orderBy("position").collect()]
    assert picked == ["c1", "c0", "c2"]


def test_mmr_starts_with_the_most_relevant(spark):
    rows = [(1, "a", [1.0, 0.0], [1.0, 0.0]), (1, "b", [1.0, 0.0], [0.99, 0.1]), (1, "c", [1.0, 0.0], [0.6, 0.8])]
    df = spark.createDataFrame(rows, "query_id int, id string, query array<double>, vector array<double>")
    assert [r.id for r in retrieval.mmr(df, 2, 0.3).orderBy("mmr_rank").collect()] == ["a", "c"]


def test_triplets_merge(spark):
    rows = spark.createDataFrame([("d", i, f"c{i}") for i in range(4)], "document_id string, ordinal int, chunk_id string")
    groups = retrieval.merge_triplets(retrieval.triplets(rows)).collect()
    assert [g.chunk_ids for g in groups] == [["c0", "c1", "c2", "c3"]]


def test_clusters_of_two_cliques(spark):
    edges = [(a, b, 1.0) for c in ((0, 1, 2), (5, 6, 7)) for a in c for b in c if a < b]
    e = spark.createDataFrame(edges, "src long, dst long, weight double")
    v = spark.createDataFrame([(i,) for i in (0, 1, 2, 5, 6, 7)], "vec_id long")
    got = {r.id: r.cluster for r in graph.clusters(v, e, rounds=5).collect()}
    assert len({got[i] for i in (0, 1, 2)}) == 1 and len({got[i] for i in (5, 6, 7)}) == 1 and got[0] != got[5]


def test_best_threshold_and_retention(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.7), (0, 0.1)], "y int, s double")
    assert features.best_threshold(df, "y", "s").first().threshold == 0.8
    chunks = spark.createDataFrame([(1, 5), (2, 3)], "doc_id long, token_count int")
    counts = spark.createDataFrame([(1, 4)], "doc_id long, n int")
    got = {r.doc_id: r.retention for r in features.chunking_results(chunks, counts, counts.limit(0), "doc_id").collect()}
    assert got == {1: 0.0, 2: None}


def test_every_stated_query_is_answered(spark, tmp_path, monkeypatch):
    from lexquarry.plans import corpus

    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist(), i % 3) for i in range(401)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    names = ("best_score_topk", "cosine_topk", "rrf_fusion", "mmr_rerank")
    whole = {n: sorted(corpus.QUERIES[n](spark, str(tmp_path)).collect()) for n in names}
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 2)
    for n in names:
        assert {r.query_id for r in whole[n]} == set(range(0, 401, 50))
        assert sorted(corpus.QUERIES[n](spark, str(tmp_path)).collect()) == whole[n]


def test_every_document_is_searched(spark, tmp_path):
    from lexquarry.plans import corpus, more

    docs = [(i, f"page{i} word{i} term{i}", "en", f"s{i % 2}", 9) for i in range(60)] + [(100, "", "en", "s0", 0), (150, None, "en", None, 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [1.0, float(i)], i % 2) for i in range(5)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(3, "page50 word50 term50"), (700, "page9 word9")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {(r.query_id, r.id) for r in corpus.hybrid_score(spark, str(tmp_path)).collect()}
    assert {q for q, _ in found} == {3, 700} and {i for _, i in found} - set(range(5))
    for f in (more.training_retrieval, more.boosted_dense):
        found = {(r.query_id, r.id) for r in f(spark, str(tmp_path)).collect()}
        assert (50, 50) in found and {q for q, _ in found} == {0, 50, 100, 150}


def _corpus(spark):
    rows = [(f"d{i // 6}", i, f"c{i}", f"text {i} " + ("data deposited in GEO GSE1234 " if i % 5 == 0 else "words ") * 3) for i in range(24)]
    df = spark.createDataFrame(rows, "document_id string, ordinal int, chunk_id string, text string")
    df = chunking.link(df, "document_id").withColumn("token_count", F.lit(100))
    return retrieval.with_vectors(df, "chunk_id")


def test_contexts_answer_every_query(spark):
    chunks = _corpus(spark)
    q = spark.createDataFrame([(1, "data deposited"), (2, "words text")], "query_id int, text string")
    queries = retrieval.with_vectors(q, "query_id")
    embed = lambda rows: retrieval.with_vectors(rows, "key")
    for found in (retrieval.document_context(queries, chunks, 4, 300), retrieval.two_pass_context(queries, chunks, embed, 4, 1, 300)):
        rows = found.collect()
        by = {}
        for r in rows:
            by.setdefault((r.query_id, r.document_id), []).append((r.position, r.chunk_id))
        assert set(by) == {(i, f"d{j}") for i in (1, 2) for j in range(4)}
        assert all(len(v) <= 3 and [p for p, _ in sorted(v)] == list(range(1, len(v) + 1)) for v in by.values())
    assert {r.query_id for r in retrieval.corpus_context(queries, chunks, 6).collect()} == {1, 2}


def test_prototypes_add_candidates_and_weight(spark):
    chunks = _corpus(spark)
    queries = retrieval.with_vectors(spark.createDataFrame([(1, "words")], "query_id int, text string"), "query_id")
    liked = chunks.where("chunk_id = 'c5'").first().vector
    plain, with_them = (retrieval.hybrid(queries, chunks, 3, 3, prototypes=p) for p in ([], [liked]))
    assert with_them.where("id = 'c5'").first()["rank"] == 1
    assert plain.count() == with_them.count() == 3


def test_correlation_p():
    from lexquarry.operators import features

    assert abs(features.correlation_p(0.5, 10) - 0.14111328125) < 1e-9  # t with 8 degrees of freedom has a closed form
    assert features.correlation_p(1.0, 10) == 0 and features.correlation_p(0.3, 2) is None and abs(features.correlation_p(0.0, 50) - 1) < 1e-12


def test_components_of_dimensions_and_shuffles(spark):
    import numpy as np

    from lexquarry.operators import models

    x = np.random.default_rng(0).normal(size=(30, 6))
    df = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "vec_id int, label int, embedding array<double>").repartition(3)
    for r in models.prototype_components(df, "label").collect():
        t = x[r.label :: 2].T
        u, s, _ = np.linalg.svd(t - t.mean(0), full_matrices=False)
        one = u[:, 0] * s[0]
        one = one if one[np.abs(one).argmax()] >= 0 else -one
        assert np.allclose(r.prototype, one)
    rows = spark.createDataFrame([(i, i * 10) for i in range(200)], "k int, v int")
    mixed = models.shuffled(rows, "v", "k", 1, 50).collect()
    assert sorted(r.k for r in mixed) == list(range(200)) and sorted(r.v for r in mixed) == [i * 10 for i in range(200)]
    assert sum(r.v == r.k * 10 for r in mixed) < 20
    assert models.projection(df, 2).columns[-2:] == ["PCA_1", "PCA_2"]


def test_nearest_dimensions(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 6)).round(3)
    x[:, 5] = 0
    rows = [(i, [float(v) for v in r], "c") for i, r in enumerate(x)] + [(None, None, None), (99, [None] * 6, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, neighbour string")
    got = {(r["id"], r["neighbour"]): r["similarity"] for r in graph.nearest_dimensions(df, 2).collect()}
    unit = x[:, :5] / np.linalg.norm(x[:, :5], axis=0)
    cosine = unit.T @ unit - 2 * np.eye(5)
    expected = {(i, j): cosine[i, j] for i in range(5) for j in np.argsort(-cosine[i])[:2].tolist()}
    assert got.keys() == expected.keys()
    assert all(abs(got[k] - expected[k]) < 1e-9 for k in got)
    assert graph.nearest_dimensions(df.where("vec_id < 0"), 2).count() == 0


def test_pca_agrees_with_singular_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 4)) * [5, 3, 2, 1]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["PCA_1"], r["PCA_2"]) for r in models.pca(df, 2).collect()}
    centred = x - x.mean(0)
    axes = np.linalg.svd(centred)[2][:2]
    axes *= np.sign(axes[np.arange(2), np.abs(axes).argmax(1)])[:, None]
    assert np.allclose([got[i] for i in range(40)], centred @ axes.T, atol=1e-6)
