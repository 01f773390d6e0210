"""Sliding windows, links and re-splits."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexquarry.operators import chunking


def restated(words, window, overlap):
    out, start = [], 0
    while start < len(words):
        part = words[start : start + window]
        if out and len(part) < 2 * overlap:
            out[-1] += " " + " ".join(part)
        else:
            out.append(" ".join(part))
        start += window - overlap
    return out


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 140), min_size=1, max_size=8), st.sampled_from([(30, 3), (10, 4), (7, 0), (5, 4)]))
def test_windows(spark, sizes, setting):
    window, overlap = setting
    texts = [" ".join(f"w{i}" for i in range(n)) for n in sizes]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in chunking.chunk(df, window=window, overlap=overlap).collect():
        got.setdefault(r.doc_id, {})[r.ordinal] = r.chunk_text
    for i, t in enumerate(texts):
        assert [got.get(i, {})[k] for k in sorted(got.get(i, {}))] == restated(t.split(), window, overlap)


def test_edges(spark):
    with pytest.raises(ValueError):
        chunking.windows(F.array(), 3, 3)
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a")], "doc_id long, text string")
    assert [(r.doc_id, r.chunk_text, r.token_count) for r in chunking.chunk(df).collect()] == [(3, "a", 1)]


def test_links_are_symmetric(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(200)))), (2, "x")], "doc_id long, text string")
    rows = {r.chunk_id: r for r in chunking.link(chunking.chunk(df, window=20, overlap=2)).collect()}
    for r in rows.values():
        assert r.next_chunk_id is None or rows[r.next_chunk_id].previous_chunk_id == r.chunk_id


def test_resplit_keeps_words(spark):
    df = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(400)))], "doc_id long, text string")
    parts = chunking.resplit(chunking.chunk(df), most=200, window=50, overlap=0).orderBy("ordinal").collect()
    assert [r.ordinal for r in parts] == list(range(len(parts))) and len(parts) > 2
    assert {w for r in parts for w in r.chunk_text.split()} == {f"word{i}" for i in range(400)}


def test_sections_and_merging(spark):
    df = spark.createDataFrame([(1, "a b\n\nc d e. f g\nh\n\nlonger sentence without end"), (2, None)], "doc_id long, text string")
    parts = [r.chunk_text for r in chunking.sections(df, 6).orderBy("ordinal").collect()]
    assert parts == ["a b", "c d e.", "f g", "h", "longer", "senten", "ce", "withou", "t end"]
    rows = spark.createDataFrame([("k", 2, [3], None), ("k", 1, [1, 2], None), ("k", 3, [4], "x")], "k string, part int, l array<int>, s string")
    merged = chunking.merge_results(rows, "k", ["l"], ["s"]).first()
    assert merged.l == [1, 2, 3, 4] and merged.s == "x"
