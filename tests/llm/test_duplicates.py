"""Near-duplicates of texts and vectors, and repeated strings, against brute force."""

import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexquarry.llm import _components, _prefixes, _suffixes, embeddings, minhash, suffix_dedup


def reach(ids, links):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def shingles(text):
    words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\n", " ").replace("\t", " ").split(" ") if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def variants(seed=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = [None, "", "  \n", "one two", "ONE  two", "one two three"]
    for family in range(6):
        base = rng.choices(words, k=rng.choice([6, 40, 150]))
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    return [(i, t) for i, t in enumerate(out)]


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.id: r.component for r in _components.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 160)}
    assert _components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


@pytest.mark.parametrize("percent, cap, size", [(80, 512, 64 << 20), (85, 512, 64 << 20), (80, 4, 20_000), (85, 4, 64 << 20)])
def test_minhash(spark, monkeypatch, percent, cap, size):
    monkeypatch.setattr(minhash, "CAP", cap)  # 4: regions are walked in sorted order, then compared in blocks
    monkeypatch.setattr(minhash, "BYTES", size)  # 20,000: groups come as pairs of blocks
    rows = variants()
    sets = {i: shingles(t) for i, t in rows}
    ids = list(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    expected = reach(ids, links)
    df = spark.createDataFrame([*rows, (None, "one two"), (3, "one two")], "doc_id long, text string").withColumns({"vertex": F.lit(0), "sig": F.lit("x"), "_gone": F.lit(1), "_id": F.lit(2)})
    out = minhash.near_duplicates(df, percent).collect()
    assert len(out) == len(rows) + 2
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), expected[r.doc_id], expected[r.doc_id] == r.doc_id)
    kept = minhash.keep(df, percent)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i in ids if expected[i] == i} | {None}
    assert kept.groupBy("doc_id").count().where("count > 1").count() == 0
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_suffix_arrays_by_brute_force(monkeypatch):
    rng = np.random.default_rng(1)
    for trial in range(300):
        monkeypatch.setattr(_suffixes, "LETTERS", (0, 2048)[trial % 2])  # ranks by doubling, and induces all the way down
        data = rng.integers(0, rng.choice([1, 2, 4, 256]), rng.integers(0, 50)).astype("u1")
        if trial % 3 == 0:
            data = np.tile(data, 3)
        raw = data.tobytes()
        order = sorted(range(len(raw)), key=lambda i: raw[i:])
        assert _suffixes.suffix_array(data).tolist() == order

        def common(a, b):
            n = 0
            while max(a, b) + n < len(raw) and raw[a + n] == raw[b + n]:
                n += 1
            return n

        assert _suffixes.common_prefixes(data, np.array(order, "i4")).tolist() == ([0] + [common(a, b) for a, b in zip(order, order[1:])])[: len(raw)]


@pytest.mark.parametrize("cap", [2048, 1, 3])
def test_repeated_strings(spark, monkeypatch, cap):
    monkeypatch.setattr(suffix_dedup, "CAP", cap)  # 1: every anchor with differing segments is divided by cores
    rng = random.Random(5)
    say = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    p, q = say(300), say(130)
    texts = [None, "", say(99), p, say(40) + p + say(50), q + p[50:220] + q, "z" * 400, p[:90] + say(20) + q[20:], p, say(10) + q[:99], q[:101] + say(5)]
    rows = list(enumerate(texts)) + [(3, p), (None, p), (50, say(10) + p), (50, q + say(3))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"spans": F.lit(1), "th": F.lit(2), "n_chars": F.length("text")})
    out = suffix_dedup.deduplicated(df).collect()
    assert len(out) == len(rows)
    seen, expected = set(), {}
    for i, t in sorted({(i, t or "") for i, t in rows if i is not None and i != 50}):
        raw = t.encode()
        gone = [False] * len(raw)
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                gone[s : s + 100] = [True] * 100
            seen.add(raw[s : s + 100])
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        expected[i] = (len(raw), sum(gone), sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    for r in out:
        if r.doc_id is not None and r.doc_id != 50:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == expected[r.doc_id], r.doc_id
    null = next(r for r in out if r.doc_id is None)
    assert null.n_removed == 0 and all(r.n_removed >= 130 for r in out if r.doc_id == 50)
    applied = suffix_dedup.apply(df)
    assert applied.columns == df.columns and applied.count() == len(rows)
    assert suffix_dedup.deduplicated(df.limit(0)).count() == 0


@pytest.mark.parametrize("cap", [512, 8])
def test_vectors(spark, monkeypatch, cap):
    monkeypatch.setattr(embeddings, "CAP", cap)  # 8: buckets are compared in pairs of blocks
    rng = np.random.default_rng(3)
    base = rng.normal(size=(8, 16))
    rows = [(i, (base[i % 8] + rng.normal(size=16) * rng.choice([0.05, 0.25, 1])).tolist(), i % 3) for i in range(150)]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 0), (202, rows[0][1], None), (203, None, 0), (204, [0.0] * 16, 0), (205, [float("nan")] * 16, 0), (206, [None] + [1.0] * 15, 0), (207, [1.0, 2.0], 0), (208, [], 0), (209, [1e300] * 16, 1)]
    df = spark.createDataFrame([*rows, (None, rows[0][1], 0)], "vec_id long, embedding array<double>, label int").withColumns({"unit": F.lit(1), "own": F.lit(2)})
    good = [(i, np.array(v) / max(map(abs, v)), l) for i, v, l in rows if l is not None and v and None not in v and np.isfinite(v).all() and any(v) and len(v) == 16]
    links = [(a, b) for a, x, l in good for b, y, m in good if a < b and l == m and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93]
    expected = reach([r[0] for r in rows], links)
    degree = {r[0]: sum(r[0] in pair for pair in links) for r in rows}
    for r in embeddings.near_duplicates(df).collect():
        if r.vec_id is None:
            assert r.component_id is None and r.kept and r.n_links == 0
        else:
            assert (r.n_links, r.component_id, r.kept) == (degree[r.vec_id], expected[r.vec_id], expected[r.vec_id] == r.vec_id), r
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_minhash_keeps_the_links_of_a_dense_region(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CAP", 8)
    rng = random.Random(11)
    page = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(page))]
    for i in range(1, 401):  # each is similar to the page only
        copy = list(page)
        for k in (0, 1, 2):
            copy[rng.randrange(5 + 65 * k, 60 + 65 * k)] = f"new{i}-{k}"
        rows.append((i, " ".join(copy)))
    sets = [shingles(t) for _, t in rows]
    assert all(len(s & sets[0]) >= 0.85 * len(s | sets[0]) for s in sets)
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    assert {r.component_id for r in out} == {0}


def copies_that_stay_apart(n):
    """Copies of one page, each similar to the page and to the others, but not enough for a link."""
    rng = random.Random(12)
    page = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(n):
        copy = list(page)
        for k in range(6):
            copy[rng.randrange(3 + 32 * k, 30 + 32 * k)] = f"new{i}-{k}"
        rows.append((i, " ".join(copy)))
    return rows


def test_rows_dealt_for_copies_that_stay_apart_grow_with_the_region(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CAP", 8)
    dealt = []

    def counted(df, key, f, schema):
        if len(key) > 1 and "cell" not in key:  # neither the small regions nor the confirmation
            dealt[-1] += df.count()
        return map_groups(df, key, f, schema)

    map_groups = minhash.map_groups
    for module in (minhash, _prefixes):
        monkeypatch.setattr(module, "map_groups", counted)
    for n in (60, 240):
        dealt.append(0)
        out = minhash.near_duplicates(spark.createDataFrame(copies_that_stay_apart(n), "doc_id long, text string"), 85)
        assert {r.doc_id for r in out.collect() if r.kept} == set(range(n))
    assert dealt[1] <= 6 * max(dealt[0], 60)


def test_sets_that_are_linked_meet_at_a_rare_shingle(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        text = list(words[: rng.choice([20, 40, 60])])
        for _ in range(rng.choice([0, 1, 2, 3])):
            text[rng.randrange(len(text))] = rng.choice(["x", f"y{i}"])
        rows.append((i, " ".join(text[rng.choice([0, 0, 2]) :]), i % 3))
    sets = [shingles(t) for _, t, _ in rows]
    texts = spark.createDataFrame(rows, "vertex long, text string, component long")
    for percent, cap, sample in [(85, 512, 4096), (85, 4, 4096), (80, 3, 0)]:  # blocks of two; an order that knows nothing
        counts = _prefixes.order_of(texts.limit(sample), 5)
        places = minhash.materialize(_prefixes.prefixes(texts, 5, percent, counts), "places")
        met = _prefixes.meetings(places, percent, cap).groupBy("cell").agg({"vertex": "collect_set"}).collect()
        pairs = {(a, b) for r in met for a in r[1] for b in r[1] if a < b}
        links = {(a, b) for a in range(150) for b in range(a) if rows[a][2] != rows[b][2] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
        assert links and {(b, a) for a, b in links} <= pairs


def test_orders_are_cut_where_neighbours_share_least():
    rng = np.random.default_rng(2)
    for cap in (1, 2, 5, 64):
        region = np.sort(rng.integers(0, 4, 300))
        path = rng.integers(0, 3, (300, 5))
        order = np.lexsort((*path.T[::-1], region))
        region, path = region[order], path[order]
        at = minhash.cut_order(region, path, cap)
        assert at[0] == 0 and at[-1] == 300 and (np.diff(at) <= cap).all() and (np.diff(at) > 0).all()
        assert all(len(set(region[a:b])) == 1 for a, b in zip(at, at[1:]))
    path = np.array([[0, 0], [0, 0], [0, 1], [1, 0], [1, 0], [1, 0]])
    assert minhash.cut_order(np.zeros(6, int), path, 4).tolist() == [0, 3, 6]


def brute_repeats(texts):
    seen, expected = set(), {}
    for i, t in sorted(texts.items()):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                gone[s : s + 100] = b"\x01" * 100
            seen.add(raw[s : s + 100])
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        expected[i] = (len(raw), sum(gone), sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return expected


def test_repeated_strings_of_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CAP", 8)
    rng = random.Random(9)
    say = lambda n: "".join(rng.choice("ab cdefgh") for _ in range(n))
    core, around = say(60), [say(60) for _ in range(6)]
    texts = {i: rng.choice(around)[-rng.randrange(61) :] + core + rng.choice(around)[: rng.randrange(61)] + say(rng.choice([0, 30])) for i in range(300)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicated(df).collect()}
    assert out == brute_repeats(texts)


def test_a_long_text_is_cut_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    rng = random.Random(4)
    passage = "".join(rng.choice("abc ") for _ in range(1500))
    texts = {1: passage, 2: "x" * 333 + passage + "y" * 50 + passage[200:900]}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicated(df).collect()}
    assert out == brute_repeats(texts)


def test_repeats_on_the_registered_query(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    out = suffix_dedup.op4_suffix_array_dedup(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == brute_repeats(texts)
