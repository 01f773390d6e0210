"""Whole jobs on small tables."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lexquarry import schemas
from lexquarry.operators import features, graph, models, retrieval
from lexquarry.plans import jobs
from lexquarry.sources import readers


def test_chunking_keeps_or_repairs_citations(spark):
    text = " ".join(f"w{i}" for i in range(299)) + " GSE 12 34 " + " ".join(f"v{i}" for i in range(400))
    docs = spark.createDataFrame([("d", [text, "page two PXD000001"]), ("e", ["none"])], "document_id string, pages array<string>")
    cited = spark.createDataFrame([("d", "GSE1234"), ("d", "PXD000001"), ("e", "GSE9999")], "document_id string, citation string")
    chunks, results = jobs.chunking_pipeline(docs, cited)
    found = {c for r in chunks.collect() for c in r.citation_entities} | {c for r in chunks.where("chunk_id like '%fix%'").collect() for c in ["GSE1234"] if "GSE" in r.chunk_text}
    assert {"GSE1234", "PXD000001"} <= found
    assert {r.document_id: r.retention is not None for r in results.collect()} == {"d": True, "e": False}


def test_datasets_and_submission(spark):
    chunks = spark.createDataFrame([("c0", 0, "see GSE1 here", 4), ("c1", 1, "and more", 2)], "chunk_id string, ordinal int, chunk_text string, token_count int")
    got = jobs.construct_datasets(spark.createDataFrame([("GSE1", "d", ["c1", "c0"])], "dataset_id string, document_id string, chunk_ids array<string>"), chunks).first()
    assert got.text == "see <DATASET_ID> here and more" and got.total_tokens == 6
    rows = spark.createDataFrame([("a", str(i % 7), "Primary") for i in range(20)], schemas.LABELS)
    assert sorted((r.row_id, r.dataset_id) for r in jobs.submission(rows).collect()) == [(i, str(i)) for i in range(7)]


def test_audit_and_health(spark):
    labels = spark.createDataFrame([("d", "E-GEOD-1"), ("d", "GSE2"), ("d", "GSE3")], "document_id string, citation string")
    extracted = spark.createDataFrame([("d", "GSE 1"), ("d", "GSE2"), ("d", "X9")], "document_id string, citation string")
    tables = jobs.audit(labels, extracted)
    assert {r.citation: r.variant_hit for r in tables["missing"].collect()} == {"E-GEOD-1": True, "GSE3": False}
    assert tables["summary"].first().found == 1
    assert all(r.readable for r in jobs.health(spark, tables).collect())


def test_features_and_clusters(spark):
    v = spark.createDataFrame([(i, [float(i % 3), 1.0, float(i)]) for i in range(12)], "id long, embedding array<double>")
    names = {r.feature_name for r in jobs.dataset_features(v).collect()}
    assert {"PCA_1", "neighborhood_mean_similarity", "neighborhood_var_norm"} <= names
    assert jobs.feature_clusters(v.withColumnRenamed("id", "vec_id"), 2).count() == 3


def test_models(spark):
    rows = spark.range(120).select((F.col("id") % 10).cast("string").alias("g"), (F.col("id") % 2).cast("int").alias("target"), ((F.col("id") % 2) + F.col("id") % 3 / 10).alias("x"), F.col("id").cast("double").alias("z"))
    train, held = models.split_by_group(rows, "g")
    assert not {r.g for r in train.select("g").distinct().collect()} & {r.g for r in held.select("g").distinct().collect()}
    model = models.fit(train, ["x", "z"], numTrees=5, maxDepth=3)
    scored = model.transform(rows).withColumn("p", F.col("prediction").cast("int"))
    assert features.classification_metrics(scored, "target", "p").first().f1 > 0.9
    best, f1 = models.search(rows, ["x", "z"], {"numTrees": [3], "maxDepth": [2, 3]}, "g", tries=1, k=2)
    assert f1 > 0.8 and best["numTrees"] == 3
    importance = models.permutation_importance(model, rows, ["x", "z"], "g", repeats=1)
    assert importance["x"] > importance["z"]
    for method in ("sigmoid", "isotonic"):
        assert models.calibrate(rows, "x", "target", method).where("calibrated between 0 and 1").count() == 120
    matrix = models.correlation_matrix(rows, ["x", "z"])
    assert matrix[0][0] == pytest.approx(1) and matrix[0][1] == pytest.approx(matrix[1][0])


def test_office_files(spark, tmp_path):
    def zipped(name, parts):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            for k, v in parts.items():
                z.writestr(k, v)
        (tmp_path / name).write_bytes(buffer.getvalue())

    w = "xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'"
    zipped("a.docx", {"word/document.xml": f"<w:document {w}><w:body><w:p><w:r><w:t>Hello </w:t></w:r><w:r><w:t>there</w:t></w:r></w:p><w:p/></w:body></w:document>"})
    zipped("b.xlsx", {"xl/sharedStrings.xml": "<sst><si><t>name</t></si></sst>", "xl/worksheets/sheet1.xml": "<worksheet><sheetData><row><c t='s'><v>0</v></c><c><v>5</v></c></row></sheetData></worksheet>"})
    got = {r.path.rsplit("/", 1)[-1]: r.pages for r in readers.office(spark, str(tmp_path)).collect()}
    assert got == {"a.docx": ["Hello there\n"], "b.xlsx": ["name\t5"]}


def test_step_order():
    assert retrieval.step_order({"b": [], "a": ["b"], "c": ["b"], "d": ["a", "c"]}) == ["b", "a", "c", "d"]
    with pytest.raises(ValueError):
        retrieval.step_order({"a": ["b"], "b": ["a"]})


def test_balanced_clusters(spark):
    """Four cliques of eight in a ring, and a vertex without links."""
    pairs = [(c * 8 + i, c * 8 + j, 1.0) for c in range(4) for i in range(8) for j in range(i)] + [(c * 8, (c + 1) % 4 * 8 + 1, 1.0) for c in range(4)]
    edges, vertices = spark.createDataFrame(pairs, "src long, dst long, weight double"), spark.range(33).withColumnRenamed("id", "vec_id")
    got = {r.id: r.cluster for r in graph.balanced_clusters(vertices, edges, 1.0, least=3, most=10, rounds=8).collect()}
    assert got == {i: i // 8 * 8 for i in range(33)}
    parted = spark.createDataFrame([(i, 0) for i in range(32)], "id long, part int")
    whole = graph.communities(parted, graph._links(edges), 0.01, 8)
    assert whole.select("cluster").distinct().count() < 4
    small = graph._merged(spark.createDataFrame([(0, 0), (1, 0), (2, 2), (3, 3)], "id long, cluster long"),
                          spark.createDataFrame([(0, 2), (2, 1), (3, 1)], "cluster long, size long"),
                          graph._links(spark.createDataFrame([(2, 0, 1.0), (2, 1, 1.0), (2, 3, 5.0)], "src long, dst long, weight double")), 2)
    assert {r.id: r.cluster for r in small.collect()} == {0: 0, 1: 0, 2: 0, 3: 3}
    none = graph.balanced_clusters(vertices, edges.where("false"))
    assert none.where("id = cluster").count() == 33


def test_stratified_folds(spark):
    rows = spark.range(60).select(F.col("id").alias("g"), (F.col("id") < 13).cast("int").alias("y")).union(spark.range(1).select(F.lit(None).cast("long"), F.lit(0)))
    got = models.folds(rows, "g", 5, label="y").collect()
    assert len(got) == 61
    counts = {}
    for r in got:
        counts.setdefault(r.y, [0] * 5)[r.fold] += 1
    assert all(max(c) - min(c) <= 1 for c in counts.values())


def test_training_rows(spark):
    docs = spark.createDataFrame([(f"d{i}", [f"see GSE{100 + i} " + " ".join(f"w{(i * j) % 11}" for j in range(30))]) for i in range(12)], "document_id string, pages array<string>")
    cited = spark.createDataFrame([(f"d{i}", f"GSE{100 + i}") for i in range(12)], "document_id string, citation string")
    labels = spark.createDataFrame([(f"GSE{100 + i}", "Primary") for i in range(5)], "dataset_id string, type string")
    got = jobs.training_features(docs, cited, labels, dims=8, k=2, least=2, most=4)
    rows = got.collect()
    assert len(rows) == 12 and sum(r.target for r in rows) == 5
    assert any(c.startswith("LEIDEN_") for c in got.columns) and "PCA_1" in got.columns
    chunk = "chunk_id string, document_id string, token_count int, previous_chunk_id string, next_chunk_id string, citation_entities array<string>, embedding array<double>"
    chunks = spark.createDataFrame([("a", "d", 1, None, "b", [], [1.0, 2.0]), ("b", "d", 1, "a", "c", ["GSE1"], [0.0, 1.0]), ("c", "d", 1, "b", "e", [], None), ("e", "d", 1, "c", None, None, [])], chunk)
    got = {r.chunk_id: (r.target, r.emb_1) for r in jobs.chunk_relevance(chunks, 2).collect()}
    assert got == {"a": (1, 2.0), "b": (1, 1.0), "c": (1, None), "e": (0, None)}


def test_blank_pages_are_recognised():
    def broken(picture):
        raise OSError

    parser = readers.with_recognition(readers.form_feed_pages, lambda content, n: f"page {n}".encode(), [broken, lambda p: " ", lambda p: p.decode() if p != b"page 3" else ""])
    assert parser(b"one\f \fthree\f") == ["one", "page 1", "three", ""]
