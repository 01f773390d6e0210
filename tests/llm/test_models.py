"""Language, quality, packing, extraction and the pipeline."""

import html
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexquarry.llm import html_text, langid, packing, quality

DIR = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def brute_bfd(lengths, size):
    room = []
    for n in sorted(lengths, reverse=True):
        fit = [(r, i) for i, r in enumerate(room) if r >= n]
        if fit:
            room[min(fit)[1]] -= n
        else:
            room.append(size - n)
    return sorted(room)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_plan_is_best_fit_decreasing(lengths):
    counts = Counter(lengths)
    runs, used = packing.plan(dict(counts), 64), {}
    for n, c in counts.items():
        for rank in range(c):
            run = runs[n][np.searchsorted(runs[n][:, 0], rank, "right") - 1]
            i = rank - run[0]
            used.setdefault(int(run[2] + i // run[1]), []).append((int(run[3] + i % run[1] * n), n))
    for pieces in used.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:]))
    assert sorted(64 - sum(n for _, n in p) for p in used.values()) == brute_bfd(lengths, 64)


def test_pack(spark):
    from tokenizers import Tokenizer

    rng = random.Random(0)
    texts = [None, "", "Hi!", "İstanbul J̌A ΣΑΣ don't 12 x2 日本 <|endoftext|>\tz", "é É ﬁ ẞ \x1c q"] + [" ".join(rng.choices(["alpha", "Beta,", "GAMMA***", "1999", "don't"], k=k)) for k in (3, 500, 3000)]
    df = spark.createDataFrame([*enumerate(texts), (None, "x"), (2, "Hi!")], "doc_id long, text string").withColumns({"length": F.lit("clash"), "part": F.lit(1)})
    out = packing.pack(df, keep_ids=True).toPandas()
    tok = Tokenizer.from_file(packing.default_tokenizer())
    for i, t in enumerate(texts):
        if i != 2:
            ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
            own = out[out.doc_id == i].sort_values("start")
            assert [x for p in own.ids for x in p] == ids and (own.doc_tokens == len(ids)).all()
            assert all(zlib.crc32(np.array(p, "<u4").tobytes()) == c and len(p) == n for p, c, n in zip(own.ids, own.ids_crc32, own.length))
    assert len(out[out.doc_id == 2]) == 2 and len(out[out.doc_id.isna()]) == 1
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048
    assert packing.pack(df.limit(0)).count() == 0


def test_html():
    page = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies</div>
    <main><article><h1>Title &amp; more</h1><p>First <b>bo</b>ld&nbsp;one. 1 < 2 &am</p><div class="advert"><p>Buy now</div><p>Second<!-- c --> one<aside>side</aside><ul><li>One<li>Two</ul>
    <form>a<input>b</form><script>var a="<p>x</p>"</script><style>p{}</style></article><section id="comments"><p>Reader says</p></section></main><div id=sidebar>links</div><footer>f</footer></body></html>"""
    assert html_text.extract(page) == "Title & more First bold one. 1 < 2 &am Second one One Two"
    assert [html_text.extract(x) for x in (None, "", "<p></p>", "<nav>x</nav>")] == [""] * 4
    plain = "<div class='nav'>a</div><div><p>" + "long text " * 30 + "</p><p>short</p></div><div class='footer'>c</div><div>d</div>"
    assert html_text.extract(plain) == ("long text " * 30).strip() + " short"
    assert html_text.extract("<main><p>kept</p><div class='userComments'>no</div><p class='shadow loadable'>too</p></main>") == "kept too"
    assert html_text.extract("<div class=ad>buy<article><p>kept</p></article>") == "kept"


def test_html_chooses_by_line_blocks():
    deep = "<article><p>A <span class='ad'>" + "<div>" * 9 + "x</span> kept text</article>"
    assert html_text.extract(deep) == "A kept text"
    parts = "<article><p>Intro</p><section class='discussion'><p>We find it.</p></section><div id='related-work'><p>Others did.</p></div><p>End</p></article>"
    assert html_text.extract(parts) == "Intro We find it. Others did. End"
    sums = "<article><header><h1>T</h1></header><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be.</p><div class=share><a href=x>Tweet this story</a></div></article>"
    assert html_text.extract(sums) == "T Let x=1 be."
    assert html_text.extract("<span class=ad>buy <span>x</span> now</span><p>kept") == "kept"
    long = "long words here " * 20
    teasers = f"<article><p>{long}</p></article><article><p>teaser</p></article>"
    assert html_text.extract(teasers) == long.strip()
    assert html_text.extract(teasers, share=0) == long + "teaser"  # without the distribution the teaser stays
    blurb = f"<article><p>teaser</p></article><div><p>{long}</p><div class=ad>buy</div><p>short</p></div>"
    assert html_text.extract(blurb) == long + "short"
    assert html_text.extract("<div>" * 5000 + "x" + "<p>y" * 5000) == "x " + " ".join(["y"] * 5000)


def test_html_on_annotated_pages(spark):
    """The registered query against the pages' own articles, cut out plainly."""
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    for r in html_text.op6_html_extraction(spark, "/root/testdata/sf0.001").collect():
        article = re.search(r"<article>(.*?)(?:</article>|<footer|$)", pages[r.page_id] or "", re.S)
        blocks = re.split(r"</?(?:p|h1|h2|ul|li|div)>", article[1]) if article else []
        plain = [" ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", b)).split()) for b in blocks]
        assert (r.text, r.n_chars) == (" ".join(b for b in plain if b), len(r.text))


def test_html_rows(spark):
    df = spark.createDataFrame([(1, None, None), (1, "u", "<p>a b"), (None, "v", "x" * 100_000)], "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = sorted(((r.page_id or 0, r.text, r.n_chars) for r in html_text.texts(df).collect()), key=lambda x: (x[0], x[2]))
    assert got == [(0, "x" * 100_000, 100_000), (1, "", 0), (1, "a b", 3)]
    assert html_text.texts(df.limit(0)).count() == 0


def test_viterbi_blocks():
    rng = np.random.default_rng(0)
    for _ in range(40):
        lengths, k = rng.integers(0, 40, 5), rng.integers(1, 5)
        scores = rng.normal(size=(lengths.sum(), k)) * 3
        at = 0
        for block in (3, 192):
            path, at = langid.viterbi(scores, lengths, 2.0, block), 0
            for n in lengths:
                if n:
                    own, s = path[at : at + n], scores[at : at + n]
                    best = s[0].copy()
                    for t in range(1, n):
                        best = np.maximum(best, best.max() - 2.0) + s[t]
                    assert abs(s[np.arange(n), own].sum() - 2.0 * (np.diff(own) != 0).sum() - best.max()) < 1e-9
                at += n


def test_every_language_is_learned_and_refits_agree(spark):
    rows = [(i, f"aa{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} " * 5, f"lang{i % 120:03}") for i in range(1440)]
    df = spark.createDataFrame(rows + rows[:50], "doc_id long, text string, lang string").withColumns({"n": F.lit(1), "_id": F.lit(2), "_lang": F.lit(3)})
    model = langid.train(df)
    assert len(model["names"]) == 120 and model == langid.train(df.repartition(5))
    one = langid.identify(df.limit(1).withColumn("text", F.repeat(F.lit("aaab "), 300_000)), model).collect()
    assert len(one) == 1


def test_language_edges(spark):
    rows = [(i, t, l) for i, (t, l) in enumerate([("the cat of and the", "en"), ("der hund und die", "de"), ("и кот это она", "ru")] * 8)]
    df = spark.createDataFrame([*rows, (None, "the of", None), (90, None, "en"), (91, "12 !", "de"), (92, "кот", None), (93, "the " * 30 + "und der die " * 30, None)], "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    model = langid.train(df)
    got = {r.doc_id: r for r in langid.identify(df, model, spans=True).collect()}
    assert got[90].lang_pred == got[91].lang_pred == "und" and got[91].score == 0
    assert got[None].lang_pred == "en" and got[92].lang_pred == "ru" and [s.lang for s in got[93].spans] == ["en", "de"]
    assert all(0 <= r.score <= 1 for r in got.values())
    none = langid.train(df.limit(0))
    assert langid.identify(df, none).first().lang_pred == "und" and langid.identify(df.limit(0), model).count() == 0


def test_chain_marginals_by_brute_force():
    from itertools import product

    rng = np.random.default_rng(2)
    lines, edge = np.array([3, 1, 5]), rng.normal(size=(2, 2))
    node = rng.normal(size=lines.sum())
    p, pairs = quality.marginals(node, lines, edge)
    at, seen = 0, np.zeros((2, 2))
    for n in lines:
        paths = list(product((0, 1), repeat=n))
        w = np.array([np.exp(sum(node[at + i] * y for i, y in enumerate(s)) + sum(edge[a, b] for a, b in zip(s, s[1:]))) for s in paths])
        w /= w.sum()
        assert np.allclose(p[at : at + n], [sum(x for x, s in zip(w, paths) if s[i]) for i in range(n)])
        for x, s in zip(w, paths):
            for a, b in zip(s, s[1:]):
                seen[a, b] += x
        at += n
    assert np.allclose(pairs, seen)


def test_quality_edges(spark):
    df = spark.createDataFrame([(1, None), (1, ""), (None, "x\n\ny"), (3, "w " * 50_000)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.classify(df, quality.train(df, labels)).collect()} == {0.5}
    model = quality.fit(["good line here\nmore text", "!! %% ## $$\n*** &&&"] * 10, np.array([1, 0] * 10), rounds=30)
    out = quality.classify(df, model).collect()
    assert len(out) == 4 and all(0 <= r.score <= 1 for r in out)
    assert quality.classify(df.limit(0), model).count() == 0
    assert quality.scored(df.drop("score"), model).select("_row.*").columns == ["doc_id", "text"]


@tables
def test_held_out_quality_and_language(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.op10_quality_classifier(spark, DIR).where("held_out").join(labels, "doc_id").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95
    lang = langid.op9_language_id(spark, DIR).where("held_out").join(docs.where("lang is not null").select("doc_id", "lang"), "doc_id").toPandas()
    assert (lang.lang_pred == lang.lang).mean() > 0.97


@tables
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, DIR)
        assert docs.columns == before.columns
        docs = corpus_pipeline.materialize(docs, name)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, DIR).toPandas()
    assert out.groupby("sequence_id").length.sum().max() <= 2048
    whole = out.groupby("doc_id").apply(lambda g: g.length.sum() / g.doc_tokens.iloc[0])
    assert (whole % 1 == 0).all() and set(out.doc_id) == {r.doc_id for r in docs.select("doc_id").distinct().collect()}
