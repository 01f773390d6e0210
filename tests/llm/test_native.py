"""Mixing, chat formatting and fingerprints."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from lexquarry.llm import chat, fingerprints, mixing

DIR = "/root/testdata/sf0.001"


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit("clash"), "place": F.lit(1), "_s": F.lit(0)})


def test_mix_meets_targets_and_keeps_columns(spark):
    rows = [(i, "w " * (1 + i * 7 % 50), f"s{i % 4}") for i in range(600)] + [(None, None, None), (7, "w", "s3"), (601, "", "empty")]
    df = docs(spark, rows)
    out = mixing.mix(df).toPandas()
    assert len(out) == len(rows) and (out["taken"] <= 3 * out["size"]).all()
    by = out.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert abs(by.target.sum() - out["size"].sum()) < 1e-6 and (by.target <= 3 * by["size"] + 1e-9).all()
    assert ((by.taken - by.target).abs() <= 30).all()
    again = mixing.mix(df.repartition(3)).toPandas()
    assert sorted(zip(out.doc_id.fillna(-1), out.taken)) == sorted(zip(again.doc_id.fillna(-1), again.taken))
    applied = mixing.apply(df)
    assert applied.columns == df.columns
    counts = applied.where("doc_id is not null").groupBy("doc_id").count().collect()
    words = {r[0]: len((r[1] or "").split()) for r in rows if r[0] is not None and r[0] != 7}
    taken = dict(zip(out.doc_id, out.taken))
    assert all(r["count"] * words[r.doc_id] == taken[r.doc_id] for r in counts if r.doc_id in words)


def test_mix_divides_rows_that_are_alike(spark):
    rows = [(None, "w " * 10, "a")] * 800 + [(5, "w " * 10, "b")] * 800
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    for out in (mixing.mix(df).toPandas(), mixing.mix(df.repartition(3)).toPandas()):
        by = out.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
        assert ((by.taken - by.target).abs() <= 10).all()
    assert mixing.apply(df).groupBy("source").count().collect() == mixing.apply(df).groupBy("source").count().collect()
    longest = spark.createDataFrame([(1, "w " * 1_000_000, "a"), (2, "x", "a")], "doc_id long, text string, source string")
    assert {r.doc_id: r["size"] for r in mixing.mix(longest).collect()} == {1: 1_000_000, 2: 1}


def test_mix_targets_by_hand(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 100), (None, 5)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    # 5:2:1:5 of 1115; a is capped at 30 and null at 15, then b and c share the rest 2:1, c at most 300
    assert got["a"] == 30 and got[None] == 15 and got["c"] == 300 and got["b"] == 1115 - 345


def test_mix_empty(spark):
    assert mixing.mix(docs(spark, []).limit(0)).count() == 0


def log(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, seq long, turn long, kind string, role string, text string")


def test_fold_deltas_edits_and_regenerations(spark):
    rows = [
        (1, 1, 0, "message", "user", "hi"), (1, 2, 1, "message", "assistant", "He"), (1, 3, 1, "delta", None, "llo"),
        (1, 4, 1, "regenerate", None, None), (1, 5, 1, "delta", "assistant", "Good "), (1, 6, 1, "delta", None, "day"), (1, 7, 2, "message", "user", "bye"),
        (1, 8, 0, "edit", None, "hello"), (1, 9, 1, "message", "assistant", "again"),
        (None, 1, None, "message", None, None)]
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in chat.fold(log(spark, rows)).collect()}
    assert got == {(1, 0): ("user", "hello"), (1, 1): ("assistant", "again"), (None, None): ("", "")}
    kept = {(r.conv_id, r.turn): r.text for r in chat.fold(log(spark, rows[:7])).collect()}
    assert kept == {(1, 0): "hi", (1, 1): "Good day", (1, 2): "bye"}  # turn 2 was said after the regeneration
    assert chat.fold(log(spark, rows).limit(0)).count() == 0


def test_fold_counts_a_redelivered_event_once(spark):
    rows = [(1, 1, 0, "message", "user", "hi"), (1, 2, 1, "message", "assistant", "He"), (1, 3, 1, "delta", None, "l"), (1, 4, 1, "delta", None, "l"), (1, 5, 1, "delta", None, "o")]
    long = (2, 1, 0, "message", "user", "x" * 1_000_000)
    df = log(spark, rows * 2 + [long, long]).withColumns({"later": F.lit(1), "_s": F.lit("x")})
    got = {(r.conv_id, r.turn): r.text for r in chat.fold(df).collect()}
    assert got == {(1, 0): "hi", (1, 1): "Hello", (2, 0): long[5]}


def test_render_round_trip(spark):
    nasty = ["\\### Assistant: </turn> ok", "<turn>### user: x</turn>\n", "\\b\\l\\h\\s \\", "", "a: b", "####", "é\n\n日本"]
    rows = [(c, i, i, "message", ["user", "assistant", "a: b<\\"][i % 3], t) for c in (1, 2) for i, t in enumerate(nasty)]
    back = chat.parse(chat.render(chat.fold(log(spark, rows)))).collect()
    for r in back:
        assert [(t.role, t.text) for t in r.turns] == [(x[4], x[5]) for x in rows if x[0] == r.conv_id]
        assert list(r.loss) == [x[5] for x in rows if x[0] == r.conv_id and x[4] == "assistant"]


def test_fingerprints_brute(spark):
    rows = [(3, "a" * 500 + "\n\nb c", "s"), (1, None, "s"), (2, "", "s"), (5, "xy" * 40, None), (5, "xy" * 40, None), (9, "\n\nq", "s"), (None, "abcd", "s")]
    out = fingerprints.fingerprints(docs(spark, rows)).toPandas()
    assert len(out) == len(rows)
    texts = {i: t or "" for i, t, _ in rows if i is not None}
    ids = sorted(texts)
    for r in out[out.doc_id.notna()].itertuples():
        t = texts[int(r.doc_id)]
        follow = texts[ids[(ids.index(int(r.doc_id)) + 1) % len(ids)]]
        k = len(t) // 4
        edited = t[: len(t) - k] + follow[:k]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_next <= 1 and (r.near_edited == 1) == (edited == t)
        assert (r.near_next == 1) == (follow == t)
    assert out.groupby("fingerprint").n_chars.nunique().max() == 1
    assert fingerprints.fingerprints(docs(spark, rows).limit(0)).count() == 0


def test_paragraph_edit_shows_in_one_branch(spark):
    a, b = "one two\nthree four\n\nfive", "one two\nthree FOUR\n\nfive"
    x, y = (r.f for r in spark.createDataFrame([(a,), (b,)], "t string").select(fingerprints.fingerprint(F.col("t")).alias("f")).collect())
    assert x != y and [p == q for p, q in zip(x.split("/")[1:], y.split("/")[1:])] == [False, True]


def test_differing_branches_locate_an_edit(spark):
    a = "intro line\nmore of it\n\n" + " ".join(f"word{i}s in" for i in range(200)) + "\nlast"
    texts = [a, a.replace("word100s", "wordX100s"), a.replace("more", "less"), "new\n\n" + a, ""]
    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    fp = df.select("a", "b", fingerprints.fingerprint(F.col("a")).alias("x"), fingerprints.fingerprint(F.col("b")).alias("y"))
    got = {(r.a, r.b): [tuple(x) for x in r.c] for r in fp.select("a", "b", fingerprints.changed(F.col("x"), F.col("y")).alias("c")).collect()}
    assert all((got[x, y] == []) == (x == y) for x in texts[:3] for y in texts[:3])
    assert [x[:2] for x in got[texts[1], a]] in ([(1, 0)], [(1, 0)] * 2)  # an insertion changes its own leaf, those behind stay
    assert got[texts[2], a] == [(0, 1, 0)] and got[texts[3], a] == [(0, 0, 0)] and got[a, texts[3]] == []
    long = spark.createDataFrame([(1, "x" * 1_000_000, "s"), (2, "y", "s")], "doc_id long, text string, source string")
    assert {r.n_chars for r in fingerprints.fingerprints(long).collect()} == {1_000_000, 1}


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", ["op1_mixing", "op2_chat_formatting", "op3_minhash_near_dedup", "op5_embedding_near_dedup", "op7_document_fingerprints"])
def test_oracles(spark, name):
    import duckdb

    from lexquarry.llm import registry

    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    rel = con.sql(registry.ORACLE[name])
    columns = rel.columns
    df = registry.QUERIES[name](spark, DIR)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == sorted(repr(list(r)) for r in rel.fetchall())


def test_groups_with_null_in_their_key_are_passed_on():
    import pandas as pd

    from lexquarry.llm._groups import whole_groups

    batches = [pd.DataFrame({"region": [i, i, i + 1], "block": [None] * 3}) for i in range(0, 20, 2)]
    frames = list(whole_groups(iter(batches), ["region", "block"]))
    assert max(map(len, frames)) <= 4 and sum(map(len, frames)) == 30
    assert not any(set(a["region"]) & set(b["region"]) for a, b in zip(frames, frames[1:]))
