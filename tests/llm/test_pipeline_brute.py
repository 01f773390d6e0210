"""Every stage of the pipeline against a plain re-statement, on the stage's own input."""

import os

import pytest

import corpus_pipeline
from lexquarry.llm import mixing, packing, quality

from .test_duplicates import reach, shingles
from .test_models import brute_bfd

DIR = "/root/testdata/sf0.001"


def repeated_removed(rows):
    """doc_id -> text without the bytes of strings of 100 bytes that start earlier too."""
    seen, out = set(), {}
    for i, text in sorted(rows.items()):
        raw = text.encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                gone[s : s + 100] = b"\x01" * 100
            seen.add(raw[s : s + 100])
        out[i] = bytes(b for b, g in zip(raw, gone) if not g).decode("utf-8", "ignore")
    return out


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_stages(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    stages = dict(corpus_pipeline.STAGES)
    texts = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}

    good = corpus_pipeline.materialize(stages["quality_classifier"](spark, docs, DIR), "t")
    model = quality.train(docs, labels)
    assert texts(good) == {i: t for i, t in texts(docs).items() if quality.score([t], model)[0] >= quality.THRESHOLD}

    single = corpus_pipeline.materialize(stages["minhash_near_dedup"](spark, good, DIR), "t")
    sets = {i: shingles(t) for i, t in texts(good).items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    labelled = reach(list(sets), links)
    assert set(texts(single)) == {i for i in sets if labelled[i] == i}

    clean = corpus_pipeline.materialize(stages["suffix_array_dedup"](spark, single, DIR), "t")
    assert texts(clean) == {i: t for i, t in repeated_removed(texts(single)).items() if t}
    assert all(r.n_chars == len(r.text) for r in clean.collect())

    mix = corpus_pipeline.materialize(stages["mixing"](spark, clean, DIR), "t")
    taken = {r.doc_id: r.taken // r.size for r in mixing.mix(clean).collect() if r["size"]}
    times = {r.doc_id: r["count"] for r in mix.groupBy("doc_id").count().collect()}
    assert times == {i: n for i, n in taken.items() if n} and set(texts(mix).items()) <= set(texts(clean).items())

    pieces = stages["packing"](spark, mix, DIR).toPandas()
    room = sorted(packing.SIZE - pieces.groupby("sequence_id").length.sum())
    assert room == brute_bfd(pieces.length.tolist(), packing.SIZE)
    words = packing.WordIds(packing.default_tokenizer())
    assert pieces.length.sum() == sum(len(words.of(r.text)) // 4 + 1 for r in mix.collect())
