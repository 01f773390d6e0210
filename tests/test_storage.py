"""Readers, versioned tables, upserts and the landing stream."""

import json

from pyspark.sql import functions as F

from lexquarry import schemas
from lexquarry.sources import readers, sinks
from lexquarry.streaming import landing


def test_versions_and_upserts(spark, tmp_path):
    t = sinks.Versioned(spark, str(tmp_path / "t"), schemas.MODELS)
    assert t.read().count() == 0
    row = lambda h, f: spark.createDataFrame([(h, None, f, "p")], schemas.MODELS)
    t.upsert(row("a", 0.1), ["model_hash"])
    t.upsert(row("b", 0.2).union(row("a", 0.3)), ["model_hash"])
    assert sorted((r.model_hash, r.best_f1) for r in t.read().collect()) == [("a", 0.3), ("b", 0.2)]


def test_update_keeps_created(spark):
    old = spark.createDataFrame([(1, "x", "old"), (2, "y", "old")], "k int, v string, created_at string")
    new = spark.createDataFrame([(2, "z", "new"), (3, "w", "new")], "k int, v string, created_at string")
    assert sorted(map(tuple, sinks.updated(old, new, ["k"]).collect())) == [(1, "x", "old"), (2, "z", "old"), (3, "w", "new")]
    assert sinks.without_like(spark.createDataFrame([("LEIDEN_1",), ("LEIDENX2",), (None,)], "f string"), "f", "LEIDEN_%").count() == 1


def test_files_and_pages(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one\ftwo")
    (tmp_path / "b.pdf").write_bytes(b"  ")

    def broken(content):
        raise ValueError("no")

    rows = {r.path.rsplit("/", 1)[-1]: r for r in readers.pages(spark, str(tmp_path), [broken, readers.form_feed_pages]).collect()}
    assert rows["a.pdf"].pages == ["one", "two"] and rows["a.pdf"].parser == 1
    assert rows["b.pdf"].pages is None and "empty" in rows["b.pdf"].error
    assert {r.stem for r in readers.files(spark, str(tmp_path), "*.pdf").collect()} == {"a", "b"}


def test_json_keeps_bad_rows_apart(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps([{"dataset_id": "d", "total_tokens": 3}, {"dataset_id": "e", "total_tokens": "many"}]))
    good, bad = readers.json_rows(spark, str(tmp_path / "x.json"), schemas.DATASETS)
    assert good.count() == 1 and bad.count() == 1


def test_csv(spark, tmp_path):
    (tmp_path / "l.csv").write_text("i,article_id,type\n0,a,Primary\n")
    assert readers.csv(spark, str(tmp_path / "l.csv"), index=True).columns == ["article_id", "type"]
    try:
        readers.csv(spark, str(tmp_path / "l.csv"), required=["dataset_id"])
        raise AssertionError
    except ValueError as e:
        assert "dataset_id" in str(e)


def test_xml(spark):
    x = "<TEI xmlns='http://www.tei-c.org/ns/1.0'><text><abstract>A</abstract><div type='methods'><head>M</head>body<div><head>N</head>inner</div></div></text></TEI>"
    df = spark.createDataFrame([(x,), ("<broken",), (None,)], "x string")
    rows = readers.xml_text(df, "x").collect()
    assert [r.format for r in rows] == ["TEI", "UNKNOWN", "ERROR"] and rows[0].text == "A M body N inner"
    first = df.select(readers.xml_sections("x").alias("s")).first().s
    assert [(s.kind, s.level) for s in first] == [("abstract", 1), ("methods", 1), ("N", 2)]


def test_stream_upserts_each_file_once(spark, tmp_path):
    land, target = str(tmp_path / "land"), sinks.Versioned(spark, str(tmp_path / "t"), schemas.LABELS)
    row = lambda kind: spark.createDataFrame([("a", "d", kind)], schemas.LABELS).coalesce(1)
    for kind in ("Primary", "Secondary"):
        row(kind).write.mode("append").parquet(land)
        landing.upsert_stream(spark, land, target, ["article_id", "dataset_id"], str(tmp_path / "c")).awaitTermination()
        assert [r.type for r in target.read().collect()] == [kind]


def test_export_and_patterns(spark, tmp_path):
    sinks.export(spark.range(3), str(tmp_path / "o"), "json")
    assert spark.read.json(str(tmp_path / "o")).count() == 3
    assert readers.pattern_table({"a": r"^GSE\d+$", "wide": r"^\w+$"}) == {"a": r"\bGSE\d+\b"}
    assert sinks.orphans(spark.range(3), spark.range(2), "id", "id").select(F.col("id")).first()[0] == 2
