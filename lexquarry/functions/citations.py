"""Tolerant citation matching as expressions: a citation becomes patterns (from the families of identifiers), a text its readings,
and evidence is counted inside the JVM, from the strictest kind to the loosest. Only normalisation of Unicode is left to Python."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lexicon as L
from .text import alnum, expand_range, id_variants, normalise, preprocess, without_doi_hosts

_FLAGS = "(?iU)"


@F.pandas_udf(T.StringType())
def nfkd(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKD", t))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _spaced(word: Column) -> Column:
    return F.array_join(F.regexp_extract_all(word, F.lit("(?s)."), F.lit(0)), L.SOFT)


def pattern(spelling: Column) -> Column:
    """A pattern for one spelling that allows for blanks, dashes and points inside it, as the first family says that it fits."""
    s = F.trim(spelling)

    def piece(shape: str, x: str | tuple[str, int]) -> Column:
        if isinstance(x, str):
            return F.lit(x)
        value = F.regexp_extract(s, shape, x[1])
        return _spaced(value) if x[0] == "letters" else F.concat(F.lit(rf"(?:\d{L.SOFT}){{"), F.length(value).cast("string"), F.lit("}"))

    families = [F.when(s.rlike(shape), F.concat(F.lit(r"\b"), *[piece(shape, x) for x in parts], F.lit(r"\b"))) for shape, _, parts in L.FAMILIES if parts]
    plain = F.trim(without_doi_hosts(spelling))
    tokens = F.filter(F.split(plain, r"[-_/:.\s]+"), lambda t: t != "")
    quoted = F.transform(F.when(F.size(tokens) > 0, tokens).otherwise(F.array(plain)), lambda t: F.regexp_replace(t, r"([^\p{L}\p{N}_])", r"\\$1"))
    loose = F.array_join(quoted, L.BETWEEN)
    edge = F.when(spelling.rlike(r"(?i)^[A-Z]{1,6}\d+[A-Z0-9]*$"), r"\b").otherwise("")
    return F.concat(F.lit(_FLAGS), F.coalesce(*families, F.concat(edge, loose, edge)))


def readings(text: Column) -> Column:
    """A text in four readings, from plain to without punctuation."""
    flat = normalise(text)
    return F.array(text, flat, preprocess(text), preprocess(flat))


def _first_count(patterns: Column, seen: Column) -> Column:
    """Matches of the first pattern, in the first reading, that has any."""
    first = lambda n, then: F.when(n > 0, n).otherwise(then)
    over = lambda p: F.aggregate(seen, F.lit(0), lambda n, t: first(n, F.regexp_count(t, p)))
    return F.aggregate(patterns, F.lit(0), lambda n, p: first(n, over(p)))


def in_series(citation: Column, seen: Column) -> Column:
    """Whether a hyphenated range such as MK838495-99, or a list under one prefix such as CCDC 1951650, 1951651 and 1951653,
    holds the citation's number; seen: array of texts."""
    bare = without_doi_hosts(citation)
    prefix, digits = (F.regexp_extract(bare, L.HEADED, g) for g in (1, 2))
    number, spaced = digits.try_cast("long"), _spaced(F.upper(prefix))
    ranges = lambda t: expand_range(t, spaced, L.SOFT, L.SOFT)
    item = F.concat(F.lit(_FLAGS + r"\b"), spaced, F.lit(rf"{L.SOFT}(\d{{3,}})\b(?=((?s).{{0,{L.LIST_REACH}}}))"))
    follows = lambda t: F.exists(F.regexp_extract_all(t, item, F.lit(2)), lambda tail: F.rlike(F.split(tail, L.LIST_END)[0], F.concat(F.lit(r"\b"), digits, F.lit(r"\b"))))
    leads = lambda t: F.array_contains(F.regexp_extract_all(t, item, F.lit(1)), digits)
    held = F.exists(seen, lambda t: F.exists(ranges(t), lambda r: (r["low"] <= number) & (number <= r["high"])) | leads(t) | follows(t))
    return F.when(digits != "", F.coalesce(held, F.lit(False))).otherwise(False)


def direct(citation: Column, texts: Column) -> Column:
    """Plain occurrences over several texts."""
    c = F.lower(without_doi_hosts(citation))
    count = lambda t: ((F.length(t) - F.length(F.replace(t, c, F.lit("")))) / F.length(c)).cast("int")
    return F.when(F.length(c) > 0, F.aggregate(texts, F.lit(0), lambda n, t: n + count(F.lower(t)))).otherwise(0)


def collapsed(citation: Column, text: Column) -> Column:
    """Whether the text without blanks and marks holds the citation, with or without its host."""
    forms = F.array(alnum(citation), alnum(F.regexp_replace(citation, r"(?i)^https?://(?:dx\.)?doi\.org/", "")))
    return _let(alnum(text), lambda t: F.exists(forms, lambda f: (f != "") & F.contains(t, f)))


def matches(citation: str | Column, text: str | Column) -> Column:
    """Matches of a citation in a text, by the first kind of evidence that finds any: tolerant spellings, series, plain
    occurrences, collapsed text. Null or blank citations and texts: 0."""
    c, t = (F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")) for x in (citation, text))
    patterns = F.transform(id_variants(c), pattern)
    kinds = lambda seen: [
        _first_count(patterns, seen), in_series(c, F.slice(seen, 1, 2)).cast("int"), direct(c, F.slice(seen, 1, 3)), collapsed(c, F.get(seen, F.lit(0))).cast("int")]
    found = lambda seen: reduce(lambda later, kind: F.when(kind > 0, kind).otherwise(later), reversed(kinds(seen)), F.lit(0))
    return F.when((F.trim(c) == "") | (t == ""), 0).otherwise(_let(readings(t), found)).cast("int")


def could_match(citation: Column, text: Column) -> Column:
    """A test that no match fails: the collapsed text holds the citation's last three letters or digits, or a digit follows
    a prefix of it (ranges and lists need no more)."""
    c = alnum(citation)
    return F.contains(alnum(text), F.substring(c, -3, 3)) | F.contains(alnum(text), F.regexp_extract(c, "^[a-z]{2,10}", 0)) & (F.regexp_extract(c, "^[a-z]{2,10}", 0) != "")


def cited(chunks: DataFrame, citations: DataFrame) -> DataFrame:
    """Chunks with the citations of their document that they contain: document_id, chunk_id, citation, n.
    An equi-join by document, then the test; never a cross join."""
    pairs = chunks.join(citations, "document_id").where(could_match(F.col("citation"), F.col("text")))
    return pairs.withColumn("n", matches("citation", "text")).where("n > 0").select("document_id", "chunk_id", "citation", "n")


def lost(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts by (document_id, citation) before and after chunking: those of which fewer are left."""
    count = lambda df, name: df.groupBy("document_id", "citation").agg(F.sum("n").alias(name))
    joined = count(before, "count_pre").join(count(after, "count_post"), ["document_id", "citation"], "left").na.fill(0, ["count_post"])
    return joined.where("count_post < count_pre")


def snippets(citation: Column, text: Column, around: int = 60) -> Column:
    """What stands around each match of the first spelling that is in the raw text."""
    wanted = F.filter(F.transform(id_variants(citation), pattern), lambda p: F.regexp_count(text, p) > 0)

    def cut(p: Column) -> Column:
        between, hits = F.split(text, p, -1), F.regexp_extract_all(text, p, F.lit(0))
        size = lambda parts, n: F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0), lambda s, x: s + F.length(x))
        begin = lambda k: size(between, k + 1) + size(hits, k)
        return F.transform(hits, lambda h, k: _let(begin(k), lambda at: F.substr(
            text, F.greatest(F.lit(0), at - around) + 1, F.least(at, F.lit(around)) + F.length(h) + around)))

    return F.coalesce(_let(F.get(wanted, F.lit(0)), lambda p: F.when(p.isNotNull(), cut(p))), F.array().cast("array<string>"))


def repairs(documents: DataFrame, missing: DataFrame, around: int = 60) -> DataFrame:
    """Snippet chunks for lost citations: document_id, chunk_id, text. Offsets are those of the raw text."""
    rows = documents.join(missing, "document_id").select("document_id", "citation", F.posexplode(snippets(F.col("citation"), F.col("text"), around)).alias("k", "text"))
    return rows.select("document_id", F.concat_ws("_", "document_id", F.lit("fix"), "citation", "k").alias("chunk_id"), "text")


def plausible(citation: Column, document_id: Column, examples: list[str] = L.EXAMPLE_CITATIONS) -> Column:
    """Whether an extracted citation may stay: not the paper itself, not an example (of a prompt: patterns have none), no list, spaces only
    in known families."""
    c = F.trim(citation)
    bare = F.regexp_extract(document_id, r"(?i)\b10\.\d{4,9}/\S+\b", 0)
    own = F.array(bare, F.concat(F.lit("https://doi.org/"), bare), F.concat(F.lit("http://dx.doi.org/"), bare), F.concat(F.lit("doi:"), bare))
    spaced = c.rlike(r"(?i)^(?:CCDC|E-?PROT|EPROT|PXD|SRR|ERR)\s+\d+$") | c.rlike(r"(?i)^ENS[A-Z]+\s+\d+$")
    return (F.length(c) >= 2) & ~((bare != "") & F.array_contains(own, c)) & ~c.isin(examples) & ~c.rlike(r"[\n\t,]") & (~F.contains(c, F.lit(" ")) | spaced) & (c.rlike(r"\d") | c.startswith("10."))
