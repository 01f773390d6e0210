"""Text functions against plain re-statements of their rules."""

import os
import re

import pytest
from pyspark.sql import functions as F

from lexquarry.functions import citations as C
from lexquarry.functions import text as X


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("raw,expected", [("exam-\n ple", "example"), ("a­b  c\n", "ab c"), ("ﬁve ﬄ", "five ffl"), ("well - known", "well known"), ("", ""), (None, None)])
def test_clean_page(spark, raw, expected):
    assert one(spark, X.clean_page("t"), t=raw) == expected


@pytest.mark.parametrize("raw,expected", [("https://doi.org/10.5061/dryad.X1.v2", "105061dryadx1"), ("10.1/a/t3", "101a"), (None, ""), ("GSE 12", "gse12")])
def test_normalise_id(spark, raw, expected):
    assert one(spark, X.normalise_id("t"), t=raw) == expected


def test_masking_quotes_ids_and_ignores_case(spark):
    got = one(spark, X.mask_ids("t", F.col("ids")), t="GSE1 gse1, gse12 and a.b axb", ids=["gse1", "a.b"])
    assert got == "<DATASET_ID> <DATASET_ID>, gse12 and <DATASET_ID> axb"
    assert one(spark, X.mask_ids("t", F.col("ids")), t="x", ids=[]) == "x"


VARIANTS = {
    "E-GEOD-123": ["E-GEOD-123", "GSE123"], "PXD000123": ["PXD000123", "PXD-000123", "PXD 000123", "PXD000-123", "PXD000 123"], "EPROT12": ["EPROT12", "E-PROT-12", "E PROT 12"],
    "ENSG0001": ["ENSG0001", "ENS-G-0001", "ENS G 0001", "ENSG0-001", "ENSG0 001"], "AB123": ["AB123", "AB-123", "AB 123"], "x": ["x"],
    "https://doi.org/10.5061/dryad.7.v2": ["https://doi.org/10.5061/dryad.7.v2", "/10.5061/dryad.7.v2", "/10.5061/dryad.7", "/10.5061/dryad"]}


def test_variants(spark):
    for raw in VARIANTS:
        assert set(one(spark, X.id_variants("t"), t=raw)) == set(VARIANTS[raw])


def test_ranges(spark):
    rows = one(spark, X.expand_range(F.col("t"), "MK"), t="MK838495–MK838499, MK838495-99, MK20–10 and MK300-200")
    assert [(r.low, r.high) for r in rows] == [(838495, 838499), (838495, 838499), (200, 300)]


@pytest.mark.parametrize("citation,text,n", [
    ("GSE123", "in GSE 1-2 3 and GSE123", 2), ("MK838497", "MK838495–MK838499", 1), ("CCDC 1951652", "CCDC 1951650, 1951651 and 1951652", 1),
    ("CCDC 1951653", "CCDC 1951650. 1951653", 0), ("https://doi.org/10.5061/dryad.ab", "see 10.5061/dryad . ab", 1), ("GSE9", "nothing", 0), ("", "x", 0), ("GSE9", None, 0)])
def test_match_count(spark, citation, text, n):
    df = spark.createDataFrame([(citation, text)], "c string, t string")
    assert df.select(C.matches("c", "t")).first()[0] == n


def test_prefilter_keeps_every_match(spark):
    pairs = [("GSE123", "GSE 1 23"), ("MK838497", "MK838495–99"), ("CCDC 1951652", "CCDC 1951650, 1951652"), ("zz1", "none")]
    df = spark.createDataFrame(pairs, "c string, t string").select("c", "t", C.could_match(F.col("c"), F.col("t")).alias("could"), C.matches("c", "t").alias("n"))
    assert all(r.could or not r.n for r in df.collect())


def test_codec_and_priors(spark):
    row = spark.range(1).select(X.encode_citation(F.lit("c"), F.lit("d"), F.array(F.lit(1), F.lit(2)), F.array(F.lit("e1"), F.lit("e2"))).alias("s"))
    assert row.first().s == "c|d|1,2|e1,e2"
    back = row.select(X.decode_citation("s").alias("b")).first().b
    assert (back.citation, back.document, back.pages, back.evidence) == ("c", "d", [1, 2], ["e1", "e2"])
    assert one(spark, X.repository_doi_prior("t"), t="https://doi.org/10.17632/x") == 0.6
    assert one(spark, X.repository_doi_prior("t"), t="https://doi.org/10.5281/zenodo.1") == 1.0
    assert one(spark, X.specific_score("t"), t="GSE1 SRR2 PXD3 IPR000001") == 1.0
    assert one(spark, X.guess_section("t"), t="Materials and Methods") == "methods"


def test_plausible(spark):
    rows = [("GSE1", True), ("a", False), ("10.1234/own", False), ("JX312727", False), ("a\tb1", False), ("CCDC 123", True), ("two words 1", False), ("none", False)]
    df = spark.createDataFrame(rows, "c string, ok boolean")
    assert all(r.ok == r.got for r in df.select("ok", C.plausible(F.col("c"), F.lit("10.1234/own")).alias("got")).collect())


def test_tokens(spark):
    t = "Äb_1 c-d  E"
    assert one(spark, X.word_tokens("t"), t=t) == re.findall(r"[A-Za-z0-9_]+", t.lower())
    assert one(spark, X.approx_tokens("t"), t="") == 1 and one(spark, X.approx_tokens("t"), t="12345") == 2


def test_entities_and_tokens(spark):
    rows = spark.createDataFrame([("GSE123456; xGSE1234, gse999 and A12345 (phs000001.v1.p2) EPI_ISL_402124.",), ("",), (None,)], "t string")
    got = [None if r.e is None else {tuple(x) for x in r.e} for r in rows.select(X.entities("t").alias("e")).collect()]
    assert {("GEO_Series", "GSE123456"), ("GEO_Series", "gse999"), ("UniProt", "A12345"), ("GISAID", "EPI_ISL_402124")} <= got[0]
    assert not any("1234" == e[-4:] and e.startswith("GSE1234") for _, e in got[0] if len(e) == 7) and got[1:] == [set(), None]
    path = "/opt/tokenizers/word_bpe_49k.json"
    if os.path.exists(path):
        from tokenizers import Tokenizer

        n = len(Tokenizer.from_file(path).encode(rows.first().t, add_special_tokens=False).ids)
        assert [r.n for r in rows.select(X.bpe_tokens("t", path).alias("n")).collect()] == [n, 0, None]
