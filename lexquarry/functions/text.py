"""Scalar text functions as Column -> Column, all inside the JVM.

Regular expressions use [\\p{L}\\p{N}_] for word characters where Unicode matters, since Java's \\w is ASCII.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sub(c: Column, *pairs: tuple[str, str]) -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, p[0], p[1]), pairs, c)


def clean_page(text: str | Column, light: bool = True) -> Column:
    """Text of a page without traces of its layout: hyphens at line ends, soft hyphens, ligatures, line ends, runs
    of blanks. light also joins what a dash and blanks part inside a token. Compatibility normalisation
    (for text that is not ASCII) is nfkd() of lexquarry.functions.citations."""
    c = _sub(_col(text), (r"-\s*\n\s*", ""), ("\u00ad", ""))
    for ligature, letters in (("\ufb00", "ff"), ("\ufb01", "fi"), ("\ufb02", "fl"), ("\ufb03", "ffi"), ("\ufb04", "ffl")):
        c = F.replace(c, F.lit(ligature), F.lit(letters))
    c = _sub(c, (r"[\r\n]+", " "))
    if light:
        c = _sub(c, (r"-\s+(?=[\p{L}\p{N}_])", ""), (r"(?<=-)\s+(?=[\p{L}\p{N}_])", ""))
    return F.trim(_sub(c, ("[ \\t\u00a0]{2,}", " ")))


def without_doi_hosts(text: str | Column) -> Column:
    """Text without the four DOI hosts, and with 'doi. org' mended. A dot in a host stands for any character."""
    c = _sub(_col(text), *[(f"{s}://{h}", "") for s, h in (("https", "doi.org"), ("https", "dx.doi.org"), ("http", "dx.doi.org"), ("http", "doi.org"))])
    return _sub(c, (r"dx\.doi\.\s+org", "dx.doi.org"), (r"doi\.\s+org", "doi.org"))


def normalise(text: str | Column) -> Column:
    return without_doi_hosts(F.replace(F.replace(_col(text), F.lit("-\n"), F.lit("")), F.lit("\n"), F.lit(" ")))


def preprocess(text: str | Column) -> Column:
    """Without punctuation, lower-cased, in one line."""
    return F.replace(F.lower(F.regexp_replace(_col(text), r"[^\p{L}\p{N}_\s]", "")), F.lit("\n"), F.lit(" "))


def alnum(text: str | Column) -> Column:
    """Lower-cased ASCII letters and digits, all else gone."""
    return F.regexp_replace(F.lower(_col(text)), "[^a-z0-9]", "")


def normalise_id(raw: str | Column) -> Column:
    """An identifier without DOI host, version and table suffix, collapsed; null gives ''."""
    return alnum(_sub(F.coalesce(_col(raw), F.lit("")), (r"(?i)^https?://(?:dx\.)?doi\.org/", ""), (r"(?i)\.v\d+$", ""), (r"(?i)/t\d+$", ""), (r"\s+", "")))


def word_tokens(text: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(r"[A-Za-z0-9_]+"), F.lit(0))


def words(text: str | Column) -> Column:
    return F.regexp_extract_all(_col(text), F.lit(r"\S+"), F.lit(0))


def approx_tokens(text: str | Column) -> Column:
    """Tokens estimated from bytes, where no vocabulary is at hand: a quarter, rounded up, at least 1."""
    return F.greatest(F.lit(1), F.floor((F.octet_length(_col(text)) + 3) / 4)).cast("int")


def occurrences(text: Column, word: str) -> Column:
    """Occurrences of a word that do not overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("int")


def _has(text: Column, word_list: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in word_list])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row, however often body names it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def _number_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [c.cast("int") for c in conditions])


def availability_features(text: str | Column) -> Column:
    """Struct of hits, unique and density of availability cues."""
    def of(t: Column) -> Column:
        there = [F.contains(t, F.lit(w)) for w in L.AVAILABILITY_CUES]
        hits = reduce(lambda a, b: a + b, [F.when(c, occurrences(t, w)).otherwise(0) for c, w in zip(there, L.AVAILABILITY_CUES)]).cast("double")
        return F.struct(hits.alias("hits"), _number_of(there).cast("double").alias("unique"), F.length(t).alias("length"))

    return _let(_let(F.lower(_col(text)), of), lambda x: F.struct(x["hits"].alias("hits"), x["unique"].alias("unique"), (x["hits"] / F.greatest(x["length"], F.lit(1))).alias("density")))


def guess_section(text: str | Column) -> Column:
    head = F.lower(F.substring(_col(text), 1, 800))
    out = F.lit(None).cast("string")
    for name, cues in reversed(L.SECTION_CUES.items()):
        out = F.when(_has(head, cues), F.lit(name)).otherwise(out)
    return out


def availability_prior(text: str | Column) -> Column:
    return _let(F.lower(_col(text)), lambda t: F.least(F.lit(1.0), _number_of([F.contains(t, F.lit(w)) for w in L.AVAILABILITY_CUES]) / F.lit(4.0)))


def specific_score(text: str | Column) -> Column:
    """How many tight identifier patterns occur, at most three, over three. No pattern spans white space, and all but one need a
    digit, so they are tried on the few words that could match."""
    likely = F.array_join(F.filter(F.split(_col(text), r"\s+"), lambda w: w.rlike(r"\d|(?i:CVCL_)")), " ")
    hits = _let(likely, lambda t: F.when(t == "", F.lit(0)).otherwise(_number_of([t.rlike("(?i)" + p) for p in L.SPECIFIC.values()])))
    return F.least(F.lit(L.SPECIFIC_ENOUGH), hits) / F.lit(float(L.SPECIFIC_ENOUGH))


def repository_doi_prior(text: str | Column) -> Column:
    def of(t: Column) -> Column:
        doi = reduce(lambda a, b: a | b, [t.rlike(p) for p in L.REPOSITORY_DOIS.values()])
        named = _has(t, L.REPOSITORY_NAMES) | _has(t, L.AVAILABILITY_CUES)
        return F.when(~F.contains(t, F.lit("doi.org/10.")) | ~doi, 0.0).when(named, 1.0).otherwise(0.6)

    return _let(F.lower(_col(text)), of)


def accession_counts(text: str | Column) -> dict[str, Column]:
    return {k: F.regexp_count(_col(text), F.lit("(?i)" + p)) for k, p in L.ACCESSIONS.items()}


def _boost(text: Column, keywords: dict[str, list[str]]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(_has(text, w), F.lit(L.CATEGORY_WEIGHTS[k])).otherwise(0.0) for k, w in keywords.items()])


def training_boost(text: str | Column, cited: Column | None = None) -> Column:
    score = _let(preprocess(text), lambda t: _boost(t, L.TRAINING_KEYWORDS))
    if cited is not None:
        score = score + F.when(cited, L.TRAINING_CITED).otherwise(0.0)
    return F.least(F.lit(L.TRAINING_CAP), score)


def inference_boost(text: str | Column) -> Column:
    return F.least(F.lit(L.INFERENCE_CAP), _let(F.lower(_col(text)), lambda t: _boost(t, L.INFERENCE_KEYWORDS)))


def fused_score(distance: Column, symbolic: Column, boost: float = 0.15) -> Column:
    return (F.lit(1.0) - distance) + F.lit(boost) * symbolic


def quote(text: str | Column) -> Column:
    """The text as a regular expression that matches it."""
    return F.regexp_replace(_col(text), r"([\\.\[\]{}()*+\-?^$|])", r"\\$1")


def mask_ids(text: str | Column, ids: Column, token: str = "<DATASET_ID>") -> Column:
    """Replace whole-word occurrences of any id of the array, in any case."""
    pattern = F.concat(F.lit(r"(?i)\b("), F.array_join(F.transform(ids, lambda x: quote(x)), "|"), F.lit(r")\b"))
    return F.when(F.size(ids) > 0, F.regexp_replace(_col(text), pattern, F.lit(token))).otherwise(_col(text))


def preview(text: str | Column, n: int = 100) -> Column:
    return F.when(F.length(_col(text)) > n, F.concat(F.substring(_col(text), 1, n), F.lit("..."))).otherwise(_col(text))


def strip_markup(html: str | Column) -> Column:
    """Text nodes, stripped, joined by a blank."""
    return F.trim(_sub(_col(html), (r"(?s)<[^>]*>", " "), (r"\s+", " ")))


def xml_format(xml: str | Column) -> Column:
    head = F.substring(_col(xml), 1, 4000)
    return (
        F.when(head.rlike(r"xmlns(?::\w+)?=[\"'][^\"']*(jats\.nlm\.nih\.gov|/JATS)"), "JATS")
        .when(head.rlike(r"xmlns(?::\w+)?=[\"'][^\"']*tei-c\.org"), "TEI")
        .when(head.rlike(r"^\s*(?:<[?!][^>]*>\s*)*<(?:\w+:)?\w*TEI[\s>]"), "TEI")
        .when(head.rlike(r"^\s*(?:<[?!][^>]*>\s*)*<(?:\w+:)?\w*article[\s>]"), "JATS")
        .when(head.rlike(r"^\s*(?:<[?!][^>]*>\s*)*<\w"), "UNKNOWN")
        .otherwise("ERROR")
    )


def section_type(title: str | Column) -> Column:
    """Canonical section of a type or title."""
    t = F.trim(F.lower(_col(title)))
    out = F.lit("other")
    for name, pattern in reversed(L.TITLE_PATTERNS.items()):
        out = F.when(t.rlike("(?i)" + pattern), F.lit(name)).otherwise(out)
    table = F.create_map(*[F.lit(x) for kv in L.SECTION_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, t), out)


def chunk_type(text: str | Column, section: Column) -> Column:
    t = F.lower(_col(text))
    return F.when(_has(t, L.CAPTION_WORDS), "caption").when(F.trim(t).endswith(":") & (F.size(words(t)) < 15), "header").when(section == "data_availability", "data_statement").otherwise("body")


def encode_citation(citation: Column, document: Column, pages: Column, evidence: Column) -> Column:
    """citation|document|p1,p2|ev1,ev2; a compatibility format: evidence with a comma does not come back whole."""
    return F.concat_ws("|", citation, document, F.array_join(F.transform(F.coalesce(pages, F.array().cast("array<int>")), lambda p: p.cast("string")), ","), F.array_join(F.coalesce(evidence, F.array().cast("array<string>")), ","))


def decode_citation(text: str | Column) -> Column:
    parts = F.split(_col(text), r"\|", 4)
    listed = lambda c: F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ","))
    return F.struct(parts[0].alias("citation"), parts[1].alias("document"), F.transform(listed(parts[2]), lambda p: p.cast("int")).alias("pages"), listed(parts[3]).alias("evidence"))


def query_text(instruction: bool = True) -> str:
    """The stated query for data citations."""
    return L.QUERY_INSTRUCTION * instruction + " ".join(sorted(set(L.AVAILABILITY_CUES + L.QUERY_ACCESSIONS)))


def expand_range(text: Column, prefix: str | Column, soft: str = r"[\s_,.\-]*", around: str = r"\s*") -> Column:
    """Array of (low, high) of hyphenated number ranges after a prefix; a short right side takes the left side's head.
    soft may stand between prefix and number, around on both sides of the dash."""
    head = F.lit(prefix) if isinstance(prefix, str) else prefix
    parts = [r"(?i)\b", head, soft + r"(\d{3,})" + around + r"[\-\u2010-\u2015]" + around + "(?:", head, soft + r")?(\d+)\b"]
    pattern = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    left, right = (F.regexp_extract_all(text, pattern, F.lit(g)) for g in (1, 2))
    number = lambda c: c.try_cast("decimal(38,0)")
    full = lambda a, b: number(F.when(F.length(b) < F.length(a), F.concat(F.substr(a, F.lit(1), F.length(a) - F.length(b)), b)).otherwise(b))
    return F.zip_with(left, right, lambda a, b: F.struct(F.least(number(a), full(a, b)).cast("long").alias("low"), F.greatest(number(a), full(a, b)).cast("long").alias("high")))


def id_variants(raw: str | Column) -> Column:
    """Spellings of an identifier, in a fixed order, each once."""
    r = F.trim(_col(raw))
    shorter = [r, without_doi_hosts(r)]
    for tail in (r"(?i)^https?://(?:dx\.)?doi\.org/", r"(?i)\.v\d+$", r"(?i)/t\d+$", r"\.(\d+)$"):
        shorter.append(F.regexp_replace(shorter[-1], tail, ""))
    named = lambda shape: F.upper(r) if any(x in shape for x in ("PXD", "PROT", "ENS")) else r
    other = [F.when(r.rlike(shape), F.regexp_replace(named(shape), shape, form)) for shape, forms, _ in L.FAMILIES for form in forms]
    return F.filter(F.array_distinct(F.array(*shorter, *other)), lambda x: x.isNotNull() & (x != ""))


#: Words that are never taken for an identifier.
STOP_WORDS = ["the", "and", "for", "with", "from", "this", "that", "data", "table", "figure"]


def entity_like(token: str | Column) -> Column:
    """Whether a token may be an identifier: it holds a digit, is no year and no stop word."""
    t = _col(token)
    return t.rlike(r"\d") & ~t.rlike(r"^(19|20)\d{2}$") & ~F.lower(t).isin(STOP_WORDS) & (F.length(t) >= 3)


def without_controls(text: str | Column) -> Column:
    return F.regexp_replace(_col(text), r"\p{C}", "")


def section_text(sections: Column) -> Column:
    """An array of (ordinal, kind, text) as '## kind' and the text, sections parted by blank lines."""
    return F.array_join(F.transform(F.array_sort(sections), lambda s: F.concat(F.lit("## "), s["kind"], F.lit("\n"), s["text"])), "\n\n")


def numeric_suffix(chunk_id: str | Column) -> Column:
    """The number at the end of an id; ids without one come last."""
    return F.coalesce(F.regexp_extract(_col(chunk_id), r"(\d+)$", 1).try_cast("long"), F.lit(1_000_000_000).cast("long"))


def accession_list(text: str | Column) -> Column:
    """Array of (kind, citation) of all accession numbers in a text, each once: the offline extractor of citations."""
    def found(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(_col(text), F.lit("(?i)" + pattern), F.lit(0)), lambda c: F.struct(F.lit(kind).alias("kind"), c.alias("citation")))

    return F.array_distinct(F.concat(*[found(k, p) for k, p in L.ACCESSIONS.items()]))


def matched_keywords(text: str | Column, keywords: dict[str, list[str]]) -> Column:
    """Array of (category, keyword) that occur in a text."""
    t = F.lower(_col(text))
    each = F.array(*[F.struct(F.lit(k).alias("category"), F.lit(w).alias("keyword"), F.contains(t, F.lit(w)).alias("there")) for k, ws in keywords.items() for w in ws])
    return F.transform(F.filter(each, lambda x: x["there"]), lambda x: x.dropFields("there"))


def entities(text: str | Column, kinds: dict[str, str] = L.ENTITIES) -> Column:
    """Array of (kind, entity) of all texts of a known form that stand alone, each once, in order of kinds; null for a null text."""
    def found(kind: str, pattern: str) -> Column:
        hits = F.regexp_extract_all(_col(text), F.lit(f"(?i)(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"), F.lit(0))
        return F.transform(hits, lambda c: F.struct(F.lit(kind).alias("kind"), c.alias("entity")))

    return F.array_distinct(F.concat(*[found(k, p) for k, p in kinds.items()]))


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def bpe_tokens(text: str | Column, vocabulary: str) -> Column:
    """Tokens by a tokenizer's file, whole texts, no special tokens; null for a null text. The file must lie at that path on every executor.
    Encoding has no form in SQL, so this runs in Arrow batches; approx_tokens stays inside the JVM."""
    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        encode = _tokenizer(vocabulary).encode
        return texts.map(lambda t: None if t is None else len(encode(t, add_special_tokens=False).ids)).astype("Int32")

    return count(_col(text))
