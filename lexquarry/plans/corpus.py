"""Queries over documents, pages, conversations, labels and vectors, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import citations as C
from ..functions import lexicon as L
from ..functions import text as X
from ..operators import chunking, features, graph, quality, retrieval
from ..session import table, written
from ..sources import readers

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _cited() -> Column:
    """Texts with a computed sentence on data, since invented prose has none."""
    n = F.col("doc_id")
    tail = (
        F.when(n % 4 == 0, F.concat(F.lit(" Data availability: deposited in GEO GSE"), n * 37, F.lit(" and PXD00"), n, F.lit(".")))
        .when(n % 4 == 1, F.concat(F.lit(" Methods. See https://doi.org/10.5281/zenodo."), n, F.lit(" and SRR"), n * 11, F.lit(".")))
        .when(n % 4 == 2, F.concat(F.lit(" See https://doi.org/10.17632/"), n, F.lit(" or E-GEOD-"), n, F.lit(", EPI_ISL_"), n, F.lit(".")))
        .otherwise("")
    )
    return F.concat("text", tail)


CITED = """(SELECT doc_id, text || CASE doc_id % 4
  WHEN 0 THEN ' Data availability: deposited in GEO GSE' || (doc_id * 37) || ' and PXD00' || doc_id || '.'
  WHEN 1 THEN ' Methods. See https://doi.org/10.5281/zenodo.' || doc_id || ' and SRR' || (doc_id * 11) || '.'
  WHEN 2 THEN ' See https://doi.org/10.17632/' || doc_id || ' or E-GEOD-' || doc_id || ', EPI_ISL_' || doc_id || '.' ELSE '' END AS text FROM documents)"""


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {_sql_text(w)})" for w in words) + ")"


def _unique(column: str, words: list[str]) -> str:
    return " + ".join(f"contains({column}, {_sql_text(w)})::INT" for w in words)


def _boost_sql(column: str, keywords: dict, cap: float, extra: str = "") -> str:
    parts = " + ".join(f"CASE WHEN {_any(column, w)} THEN {L.CATEGORY_WEIGHTS[k]}::DOUBLE ELSE 0::DOUBLE END" for k, w in keywords.items())
    return f"round(least({cap}::DOUBLE, {parts}{extra}), 6)"


# --- scalar text ------------------------------------------------------------------------------------------


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(text || chr(10) || 'exam-' || chr(10) || 'ple  of', '-\s*\n\s*', '', 'g'), chr(173), '', 'g'), '[\r\n]+', ' ', 'g'), '-\s+([\p{L}\p{N}_])', '\1', 'g'), '-\s+([\p{L}\p{N}_])', '-\1', 'g'),
  '[ \t' || chr(160) || ']{2,}', ' ', 'g')) AS cleaned FROM documents""")
def clean_page(spark, d):
    return _docs(spark, d).select("doc_id", X.clean_page(F.concat("text", F.lit("\nexam-\nple  of"))).alias("cleaned"))


@query(r"""SELECT doc_id, replace(lower(regexp_replace(text, '[^\p{L}\p{N}_\s]', '', 'g')), chr(10), ' ') AS prep FROM documents""")
def preprocess_text(spark, d):
    return _docs(spark, d).select("doc_id", X.preprocess("text").alias("prep"))


@query("SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS collapsed FROM documents")
def alnum_collapse(spark, d):
    return _docs(spark, d).select("doc_id", X.alnum("text").alias("collapsed"))


@query(r"""SELECT item_id, regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  'https://doi.org/10.5061/dryad.' || item_id || '.v2/t' || item_id, '^(?i:https?://(dx\.)?doi\.org/)', ''), '(?i)\.v\d+$', ''), '(?i)/t\d+$', ''), '\s+', '', 'g')), '[^a-z0-9]', '', 'g') AS norm_id FROM benchmark""")
def normalise_id(spark, d):
    raw = F.concat(F.lit("https://doi.org/10.5061/dryad."), "item_id", F.lit(".v2/t"), "item_id")
    return table(spark, d, "benchmark").select("item_id", X.normalise_id(raw).alias("norm_id"))


@query(r"""SELECT doc_id, replace(replace(replace(replace(text || ' https://doi.org/10.1/x http://dx.doi. org/y', 'https://doi.org', ''), 'https://dx.doi.org', ''), 'http://dx.doi.org', ''), 'http://doi.org', '')
  .regexp_replace('doi\.\s+org', 'doi.org', 'g') AS bare FROM documents""")
def doi_hosts(spark, d):
    return _docs(spark, d).select("doc_id", X.without_doi_hosts(F.concat("text", F.lit(" https://doi.org/10.1/x http://dx.doi. org/y"))).alias("bare"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[A-Za-z0-9_]+'))::INT AS n_tokens, len(list_distinct(regexp_extract_all(lower(text), '[A-Za-z0-9_]+')))::INT AS n_distinct FROM documents")
def word_tokens(spark, d):
    t = X.word_tokens("text")
    return _docs(spark, d).select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"))


@query("SELECT doc_id, greatest(1, floor((octet_length(encode(text)) + 3) / 4))::INT AS n_tokens FROM documents")
def token_count(spark, d):
    return _docs(spark, d).select("doc_id", X.approx_tokens("text").alias("n_tokens"))


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS preview FROM documents")
def text_preview(spark, d):
    return _docs(spark, d).select("doc_id", X.preview("text", 100).alias("preview"))


@query(f"""SELECT doc_id, hits, uniq, round(hits / greatest(1, length(t)), 9) AS density FROM (SELECT doc_id, t,
  ({' + '.join(f"(length(t) - length(replace(t, {_sql_text(w)}, ''))) // {len(w)}" for w in L.AVAILABILITY_CUES)})::DOUBLE AS hits, ({_unique('t', L.AVAILABILITY_CUES)})::DOUBLE AS uniq FROM (SELECT doc_id, lower(text) AS t FROM {CITED}))""")
def das_features(spark, d):
    f = _docs(spark, d).select("doc_id", X.availability_features(_cited()).alias("f"))
    return f.select("doc_id", "f.hits", F.col("f.unique").alias("uniq"), F.round("f.density", 9).alias("density"))


@query(f"""SELECT doc_id, CASE {' '.join(f"WHEN {_any('t', cues)} THEN {_sql_text(name)}" for name, cues in L.SECTION_CUES.items())} END AS section FROM (SELECT doc_id, lower(substr(text, 1, 800)) AS t FROM {CITED})""")
def guess_section(spark, d):
    return _docs(spark, d).select("doc_id", X.guess_section(_cited()).alias("section"))


@query(f"SELECT doc_id, least(1.0::DOUBLE, ({_unique('t', L.AVAILABILITY_CUES)}) / 4.0::DOUBLE) AS prior FROM (SELECT doc_id, lower(text) AS t FROM {CITED})")
def das_prior(spark, d):
    return _docs(spark, d).select("doc_id", X.availability_prior(_cited()).alias("prior"))


@query(f"""SELECT doc_id, round(least(3, {' + '.join(f"regexp_matches(text, {_sql_text('(?i)' + p)})::INT" for p in L.SPECIFIC.values())}) / 3.0::DOUBLE, 9) AS score FROM {CITED}""")
def regex_specific(spark, d):
    return _docs(spark, d).select("doc_id", F.round(X.specific_score(_cited()), 9).alias("score"))


@query(f"""SELECT doc_id, {', '.join(f"len(regexp_extract_all(text, {_sql_text('(?i)' + p)}))::INT AS {k}" for k, p in L.ACCESSIONS.items())} FROM {CITED}""")
def accession_counts(spark, d):
    return _docs(spark, d).select("doc_id", _cited().alias("text")).select("doc_id", *[c.alias(k) for k, c in X.accession_counts("text").items()])


@query(f"""SELECT doc_id, CASE WHEN NOT ({' OR '.join(f"regexp_matches(t, {_sql_text(p)})" for p in L.REPOSITORY_DOIS.values())}) THEN 0.0::DOUBLE
  WHEN {_any('t', L.REPOSITORY_NAMES)} OR {_any('t', L.AVAILABILITY_CUES)} THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END AS prior FROM (SELECT doc_id, lower(text) AS t FROM {CITED})""")
def doi_repo_prior(spark, d):
    return _docs(spark, d).select("doc_id", X.repository_doi_prior(_cited()).alias("prior"))


@query(rf"""SELECT doc_id, {_boost_sql('t', L.TRAINING_KEYWORDS, L.TRAINING_CAP, ' + CASE WHEN doc_id % 4 < 3 THEN 0.2::DOUBLE ELSE 0::DOUBLE END')} AS boost
  FROM (SELECT doc_id, replace(lower(regexp_replace(text, '[^\p{{L}}\p{{N}}_\s]', '', 'g')), chr(10), ' ') AS t FROM {CITED})""")
def keyword_boost_train(spark, d):
    return _docs(spark, d).select("doc_id", F.round(X.training_boost(_cited(), F.col("doc_id") % 4 < 3), 6).alias("boost"))


@query(f"SELECT doc_id, {_boost_sql('t', L.INFERENCE_KEYWORDS, L.INFERENCE_CAP)} AS boost FROM (SELECT doc_id, lower(text) AS t FROM {CITED})")
def keyword_boost_infer(spark, d):
    return _docs(spark, d).select("doc_id", F.round(X.inference_boost(_cited()), 6).alias("boost"))


@query(f"""SELECT doc_id, regexp_replace(text, '(?i)\\b(gse' || (doc_id * 37) || '|' || 'E\\-GEOD\\-' || doc_id || ')\\b', '<DATASET_ID>', 'g') AS masked FROM {CITED}""")
def mask_ids(spark, d):
    ids = F.array(F.concat(F.lit("gse"), F.col("doc_id") * 37), F.concat(F.lit("E-GEOD-"), "doc_id"))
    return _docs(spark, d).select("doc_id", X.mask_ids(_cited(), ids).alias("masked"))


@query("""SELECT doc_id, list_aggregate(list_sort(list_distinct(['E-GEOD-' || doc_id, 'GSE' || doc_id])), 'string_agg', '|') AS geo,
  list_aggregate(list_sort(list_distinct(['PXD00' || doc_id, 'PXD-00' || doc_id, 'PXD 00' || doc_id, regexp_replace('PXD00' || doc_id, '^([A-Z0-9]{2,6})(\\d{3,})$', '\\1-\\2'), regexp_replace('PXD00' || doc_id, '^([A-Z0-9]{2,6})(\\d{3,})$', '\\1 \\2')])), 'string_agg', '|') AS pxd FROM documents""")
def id_variants(spark, d):
    listed = lambda raw: F.array_join(F.array_sort(X.id_variants(raw)), "|")
    rows = _docs(spark, d)
    return rows.select("doc_id", listed(F.concat(F.lit("E-GEOD-"), "doc_id")).alias("geo"), listed(F.concat(F.lit("PXD00"), "doc_id")).alias("pxd"))


@query("SELECT doc_id, (100000 + doc_id)::BIGINT AS low, CASE WHEN doc_id % 100 <= 95 THEN (100000 + doc_id) // 100 * 100 + 95 ELSE 100000 + doc_id END::BIGINT AS high, doc_id % 100 <= 95 AS ordered FROM documents WHERE doc_id % 100 <= 95 UNION ALL SELECT doc_id, ((100000 + doc_id) // 100 * 100 + 95)::BIGINT, (100000 + doc_id)::BIGINT, false FROM documents WHERE doc_id % 100 > 95")
def range_expand(spark, d):
    text = F.concat(F.lit("see MK"), F.col("doc_id") + 100000, F.lit("–95 there"))
    rows = _docs(spark, d).select("doc_id", F.explode(X.expand_range(text, "MK")).alias("r"))
    return rows.select("doc_id", "r.low", "r.high", (F.col("doc_id") % 100 <= 95).alias("ordered"))


_TITLES = ["Abstract", "Materials and Methods", "2. Results", "Data availability", "References", "Competing interests", "Something else", "summary", "Authors", "Appendix A"]


@query(f"""SELECT doc_id, coalesce(CASE lower(title) {' '.join(f"WHEN {_sql_text(k)} THEN {_sql_text(v)}" for k, v in L.SECTION_TYPES.items())} END,
  CASE {' '.join(f"WHEN regexp_matches(lower(title), {_sql_text(p)}) THEN {_sql_text(k)}" for k, p in L.TITLE_PATTERNS.items())} ELSE 'other' END) AS section
  FROM (SELECT doc_id, [{', '.join(map(_sql_text, _TITLES))}][(doc_id % {len(_TITLES)} + 1)] AS title FROM documents)""")
def section_map(spark, d):
    title = F.element_at(F.array(*map(F.lit, _TITLES)), (F.col("doc_id") % len(_TITLES) + 1).cast("int"))
    return _docs(spark, d).select("doc_id", X.section_type(title).alias("section"))


@query(f"""SELECT doc_id, CASE WHEN {_any('lower(text)', L.CAPTION_WORDS)} THEN 'caption' WHEN doc_id % 3 = 0 THEN 'data_statement' ELSE 'body' END AS kind FROM documents""")
def chunk_type(spark, d):
    return _docs(spark, d).select("doc_id", X.chunk_type("text", F.when(F.col("doc_id") % 3 == 0, "data_availability").otherwise("methods")).alias("kind"))


@query("""SELECT item_id, 'GSE' || item_id || '|' || item_id || '|1,' || item_id || '|' || replace(text, '|', ' ') AS coded, 'GSE' || item_id AS citation, len(string_split(replace(text, '|', ' '), ','))::INT AS n_evidence FROM benchmark""")
def citation_codec(spark, d):
    e = F.array(F.replace("text", F.lit("|"), F.lit(" ")))
    rows = table(spark, d, "benchmark").select("item_id", X.encode_citation(F.concat(F.lit("GSE"), "item_id"), F.col("item_id").cast("string"), F.array(F.lit(1), F.col("item_id").cast("int")), e).alias("coded"))
    return rows.select("item_id", "coded", X.decode_citation("coded")["citation"].alias("citation"), F.size(X.decode_citation("coded")["evidence"]).alias("n_evidence"))


@query("SELECT doc_id, n FROM (SELECT doc_id, len(regexp_extract_all(text, '\\b[0-9][A-Za-z0-9]{3}\\b'))::INT AS n FROM documents) WHERE n > 0")
def pattern_inventory(spark, d):
    return quality.pattern_inventory(_docs(spark, d), {"pdb": r"\b[0-9][A-Za-z0-9]{3}\b"}, ["doc_id"]).select("doc_id", "n")


# --- markup ------------------------------------------------------------------------------------------------


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def xml_text(spark, d):
    return table(spark, d, "pages").select("page_id", X.strip_markup("html").alias("text"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'TEI' WHEN 1 THEN 'JATS' ELSE 'UNKNOWN' END AS format FROM pages")
def xml_format(spark, d):
    head = F.when(F.col("page_id") % 3 == 0, '<?xml version="1.0"?><TEI xmlns="http://www.tei-c.org/ns/1.0">').when(F.col("page_id") % 3 == 1, "<article>").otherwise("")
    return table(spark, d, "pages").select("page_id", X.xml_format(F.concat(head, F.regexp_replace("html", "<!DOCTYPE html>", ""))).alias("format"))


_PROSE = r"trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[^\x21-\x25\x27-\x3B\x3D-\x7E]+', ' ', 'g'))"


@query(f"""WITH p AS (SELECT page_id, {_PROSE} AS body FROM pages)
SELECT page_id, 0::INT AS ordinal, 1::INT AS level, 'abstract' AS kind, '' AS title, body AS text FROM p
UNION ALL SELECT page_id, 1, 1, 'methods', 'Methods', url FROM (SELECT page_id, regexp_replace(url, '[&<]', ' ', 'g') AS url FROM pages)
UNION ALL SELECT page_id, 2, 2, 'Inner', 'Inner', body FROM p""")
def xml_sections(spark, d):
    """Articles whose abstract and nested section hold the words of the whole page."""
    body = F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"[^\x21-\x25\x27-\x3B\x3D-\x7E]+", " ")
    url = F.regexp_replace("url", "[&<]", " ")
    parts = ["<article><abstract><p>", body, "</p></abstract><sec sec-type='methods'><title>Methods</title><p>", url, "</p><sec><title>Inner</title><p>", body, "</p></sec></sec></article>"]
    xml = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    rows = table(spark, d, "pages").select("page_id", F.explode(readers.xml_sections(xml)).alias("s"))
    return rows.select("page_id", "s.*")


#: Whole texts as pages of 300 characters, and what makes a page a candidate.
_PAGES = "SELECT doc_id, list_transform(range(1, length(coalesce(text, '')) + 1, 300), lambda s: substr(text, s, 300)) AS pages FROM documents"
_CANDIDATE = "(?i)data|table"


def _paged(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    starts = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(300))).otherwise(F.array().cast("array<int>"))
    return _docs(spark, d).select("doc_id", F.transform(starts, lambda s: F.substr(F.col("text"), s, F.lit(300))).alias("pages"))


@query(f"""WITH p AS ({_PAGES}), e AS (SELECT doc_id, len(pages) AS n, unnest(pages) AS page_text, unnest(range(0, len(pages))) AS i FROM p)
SELECT doc_id, (i + 1)::INT AS page FROM e WHERE trim(page_text) <> '' AND (i >= floor(n * 0.65::DOUBLE) OR regexp_matches(page_text, '{_CANDIDATE}'))""")
def candidate_pages(spark, d):
    return readers.candidate_pages(_paged(spark, d), "doc_id", "pages", _CANDIDATE)


@query(f"""WITH p AS ({_PAGES}), e AS (SELECT doc_id, unnest(pages) AS page_text, unnest(range(1, len(pages) + 1)) AS i, len(pages) AS n FROM p)
SELECT doc_id, md5(string_agg(CASE WHEN regexp_matches(page_text, '{_CANDIDATE}') THEN page_text || '*' ELSE page_text END, '|' ORDER BY i)) AS spliced FROM e WHERE i < n GROUP BY doc_id""")
def page_splice(spark, d):
    """The second reading marks its pages and lacks the last one."""
    marked = F.transform("pages", lambda x: F.concat(x, F.lit("*")))
    chosen = F.filter(F.transform("pages", lambda x, i: F.when(x.rlike(_CANDIDATE), i + 1)), lambda i: i.isNotNull())
    rows = _paged(spark, d).where(F.size("pages") > 1).select("doc_id", "pages", F.slice(marked, F.lit(1), F.size("pages") - 1).alias("other"), chosen.alias("candidates"))
    return rows.select("doc_id", F.md5(F.array_join(readers.splice_pages("pages", "other", "candidates"), "|").cast("binary")).alias("spliced"))


# --- chunks ------------------------------------------------------------------------------------------------

_CHUNKS = r"""w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\S+') AS words FROM documents),
starts AS (SELECT doc_id, words, len(words) AS n, unnest(range(0, len(words), 270)) AS s FROM w WHERE len(words) > 0),
parts AS (SELECT doc_id, s, s = 0 OR least(300, n - s) >= 60 AS kept, array_to_string(words[s + 1 : s + 300], ' ') AS part FROM starts),
lead AS (SELECT doc_id, s, kept, part, max(CASE WHEN kept THEN s END) OVER (PARTITION BY doc_id ORDER BY s) AS own FROM parts),
chunks AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY own) - 1)::INT AS ordinal, string_agg(part, ' ' ORDER BY s) AS chunk_text FROM lead GROUP BY doc_id, own),
ck AS (SELECT *, doc_id || '_' || ordinal AS chunk_id, greatest(1, floor((octet_length(encode(chunk_text)) + 3) / 4))::INT AS token_count FROM chunks)"""


@query(f"WITH {_CHUNKS} SELECT doc_id, ordinal, chunk_id, md5(chunk_text) AS chunk_md5, token_count FROM ck")
def sliding_chunks(spark, d):
    return chunking.chunk(_docs(spark, d)).select("doc_id", "ordinal", "chunk_id", F.md5(F.col("chunk_text").cast("binary")).alias("chunk_md5"), "token_count")


@query(f"WITH {_CHUNKS} SELECT doc_id, count(*)::BIGINT AS total_chunks, sum(token_count)::BIGINT AS total_tokens, round(sum(token_count) / count(*), 6) AS avg_tokens FROM ck GROUP BY doc_id")
def chunk_stats(spark, d):
    return chunking.document_stats(chunking.chunk(_docs(spark, d))).withColumn("avg_tokens", F.round("avg_tokens", 6))


@query(f"WITH {_CHUNKS} SELECT doc_id, chunk_id, lag(chunk_id) OVER o AS previous_chunk_id, lead(chunk_id) OVER o AS next_chunk_id FROM ck WINDOW o AS (PARTITION BY doc_id ORDER BY ordinal)")
def chunk_links(spark, d):
    return chunking.link(chunking.chunk(_docs(spark, d)).select("doc_id", "ordinal", "chunk_id")).drop("ordinal")


@query(f"""WITH {_CHUNKS} SELECT a.chunk_id, b.chunk_id AS neighbour FROM ck a JOIN ck b ON a.doc_id = b.doc_id AND abs(a.ordinal - b.ordinal) = 1""")
def chunk_neighbours(spark, d):
    linked = chunking.link(chunking.chunk(_docs(spark, d)).select("doc_id", "ordinal", "chunk_id"))
    both = F.explode(F.filter(F.array("previous_chunk_id", "next_chunk_id"), lambda x: x.isNotNull())).alias("neighbour")
    return linked.select("chunk_id", both)


@query("""WITH c AS (SELECT doc_id, unnest(range(1, length(text) + 1, 450)) AS s, text FROM documents WHERE length(text) > 0)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::INT AS ordinal, md5(substr(text, s, 500)) AS chunk_md5 FROM c""")
def char_chunks(spark, d):
    return chunking.characters(_docs(spark, d), 500, 50).select("doc_id", "ordinal", F.md5(F.col("chunk_text").cast("binary")).alias("chunk_md5"))


@query(rf"""WITH {_CHUNKS}, cw AS (SELECT doc_id, ordinal AS o, token_count > 400 AS big, chunk_text, regexp_extract_all(chunk_text, '\S+') AS words FROM ck),
again AS (SELECT doc_id, o, words, len(words) AS n, unnest(range(0, len(words), 80)) AS s FROM cw WHERE big),
pieces AS (SELECT doc_id, o, s, s = 0 OR least(100, n - s) >= 40 AS kept, array_to_string(words[s + 1 : s + 100], ' ') AS part FROM again),
owned AS (SELECT *, max(CASE WHEN kept THEN s END) OVER (PARTITION BY doc_id, o ORDER BY s) AS own FROM pieces),
every AS (SELECT doc_id, o, own, string_agg(part, ' ' ORDER BY s) AS t FROM owned GROUP BY doc_id, o, own
  UNION ALL SELECT doc_id, o, 0, chunk_text FROM cw WHERE NOT big),
numbered AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY o, own) - 1)::INT AS ordinal, t FROM every)
SELECT doc_id, ordinal, doc_id || '_' || ordinal AS chunk_id, greatest(1, floor((octet_length(encode(t)) + 3) / 4))::INT AS token_count FROM numbered""")
def oversize_resplit(spark, d):
    return chunking.resplit(chunking.chunk(_docs(spark, d)), 400, 100, 20).select("doc_id", "ordinal", "chunk_id", "token_count")


@query()
def section_chunks(spark, d):
    return chunking.sections(_docs(spark, d), 600).select("doc_id", "ordinal", F.length("chunk_text").alias("n_chars"))


@query("""SELECT conv_id, turn, lag(conv_id || '_' || turn) OVER o AS previous_chunk_id, lead(conv_id || '_' || turn) OVER o AS next_chunk_id FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)""")
def turn_links(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.concat_ws("_", "conv_id", "turn").alias("chunk_id"))
    return chunking.link(rows, "conv_id", "turn").drop("chunk_id")


@query("""SELECT conv_id, turn, lag(turn) OVER o AS pre, turn AS anchor, lead(turn) OVER o AS post FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)""")
def triplets(spark, d):
    return retrieval.triplets(table(spark, d, "conversations"), "conv_id", "turn", "turn")


@query("""SELECT conv_id, md5(string_agg(text, ' ' ORDER BY turn)) AS text_md5, sum(greatest(1, floor((octet_length(encode(text)) + 3) / 4)))::BIGINT AS total_tokens,
  (sum(length(text)) + count(*) - 1)::INT AS total_char_length FROM conversations GROUP BY conv_id""")
def dataset_aggregate(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("ordinal"), "text", X.approx_tokens("text").alias("token_count"))
    out = features.build_datasets(rows, ["conv_id"])
    return out.select("conv_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "total_tokens", "total_char_length")


@query(r"""WITH j AS (SELECT conv_id, string_agg(regexp_replace(text, '(?i)\b(the|de)\b', '<DATASET_ID>', 'g'), chr(10) || chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id)
SELECT conv_id, md5(t) AS text_md5, greatest(1, floor((octet_length(encode(t)) + 3) / 4))::BIGINT AS total_tokens, length(t)::INT AS clean_text_length FROM j""")
def dataset_aggregate_infer(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("ordinal"), "text", X.approx_tokens("text").alias("token_count"), F.array(F.lit("the"), F.lit("de")).alias("ids"))
    out = features.build_datasets(rows, ["conv_id"], "ids", "\n\n", mask_each=True)
    return out.select("conv_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "total_tokens", "clean_text_length")


@query("SELECT conv_id, count(*)::INT AS n_pages, sum(length(text))::BIGINT AS total_char_length, sum(greatest(1, floor((octet_length(encode(text)) + 3) / 4)))::BIGINT AS total_tokens FROM conversations GROUP BY conv_id")
def document_page_stats(spark, d):
    pages = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list("text").alias("pages"))
    return features.page_stats(pages, "conv_id", "pages")


@query("""SELECT doc_id, (doc_id % 4 = 0)::INT AS n FROM documents""")
def citation_matches(spark, d):
    """Tolerant matches of each document's own accession, written with a gap, found in its text."""
    docs = _docs(spark, d).select(F.col("doc_id"), _cited().alias("text"), F.concat(F.lit("GSE-"), F.col("doc_id") * 37).alias("citation"))
    likely = C.could_match(F.col("citation"), F.col("text")) & F.contains(X.alnum("text"), X.alnum("citation"))
    counted = docs.where(likely).select("doc_id", C.matches("citation", "text").alias("n"))
    return docs.select("doc_id").join(counted, "doc_id", "left").na.fill(0, ["n"])


@query()
def citation_repairs(spark, d):
    docs = _docs(spark, d).select(F.col("doc_id").alias("document_id"), _cited().alias("text"))
    return C.repairs(docs, docs.select("document_id", F.concat(F.lit("GSE"), F.col("document_id") * 37).alias("citation")))


@query("""SELECT doc_id, kind FROM (SELECT doc_id, unnest(['ok', 'plain']) AS kind FROM documents) WHERE kind = 'ok'""")
def plausible_citations(spark, d):
    rows = _docs(spark, d).select("doc_id", F.explode(F.array(F.struct(F.lit("ok").alias("kind"), F.concat(F.lit("GSE"), "doc_id").alias("c")), F.struct(F.lit("plain").alias("kind"), F.lit("no number").alias("c")))).alias("x"))
    return rows.where(C.plausible(F.col("x.c"), F.col("doc_id").cast("string"))).select("doc_id", "x.kind")


# --- retrieval ---------------------------------------------------------------------------------------------

_V = "SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings"
_NEAR = f"""v AS ({_V}), q AS (SELECT vec_id AS query_id, e AS qe FROM v WHERE vec_id % 50 = 0),
near AS (SELECT query_id, vec_id AS id, list_cosine_similarity(e, qe) AS score FROM v, q)"""


def _stated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The stated query vectors (ids divisible by 50) and all vectors."""
    v = table(spark, d, "embeddings")
    return v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@query(f"WITH {_NEAR} SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM near) WHERE rank <= 10")
def cosine_topk(spark, d):
    q, v = _stated(spark, d)
    return retrieval.nearest(q, v, 10).withColumn("score", F.round("score", 6))


@query(f"WITH {_NEAR} SELECT query_id, label, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label)::INT AS rank FROM (SELECT query_id, label, max(score) AS score FROM near JOIN v ON v.vec_id = near.id GROUP BY ALL)) WHERE rank <= 5")
def best_score_topk(spark, d):
    q, _ = _stated(spark, d)
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return retrieval.best_labels(q, v, 5).withColumn("score", F.round("score", 6))


@query(f"""WITH v AS ({_V}), p AS (SELECT vec_id AS p_id, e AS pe FROM v WHERE vec_id < 3),
s AS (SELECT vec_id, list_sort(list(list_cosine_similarity(e, pe)), 'DESC') AS l FROM v, p GROUP BY vec_id) SELECT vec_id, round((l[1] + l[2]) / 2, 6) AS affinity FROM s""")
def prototype_affinity(spark, d):
    v = table(spark, d, "embeddings")
    prototypes = [r[0] for r in v.where("vec_id < 3").orderBy("vec_id").select("embedding").collect()]
    return v.select("vec_id", F.round(retrieval.prototype_affinity(v, prototypes, 2), 6).alias("affinity"))


_BM25 = """tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[A-Za-z0-9_]+') AS t FROM documents),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS al FROM tok),
tf AS (SELECT doc_id, term, count(*)::DOUBLE AS tf, any_value(l)::DOUBLE AS l FROM (SELECT doc_id, len(t) AS l, unnest(t) AS term FROM tok) GROUP BY doc_id, term),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term),
qt AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_]+')) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT item_id AS query_id, doc_id, sum(times * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1e-12::DOUBLE) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / al))) AS score
  FROM qt JOIN tf USING (term) JOIN df USING (term), st GROUP BY ALL)"""


def _bm25(spark: SparkSession, d: str, k: int) -> DataFrame:
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.bm25(queries, _docs(spark, d).select(F.col("doc_id").alias("chunk_id"), "text"), k)


@query(f"WITH {_BM25} SELECT query_id, round(max(score), 5) AS best FROM sc GROUP BY query_id")
def bm25_topk(spark, d):
    return _bm25(spark, d, 5).groupBy("query_id").agg(F.round(F.max("score"), 5).alias("best"))


@query(f"WITH {_BM25} SELECT term, df::BIGINT AS df, round(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1e-12::DOUBLE), 6) AS idf FROM df, st")
def bm25_stats(spark, d):
    _, terms, _ = retrieval.bm25_stats(_docs(spark, d).select(F.col("doc_id").alias("chunk_id"), "text"))
    return terms.withColumn("idf", F.round("idf", 6))


_TWO = f"""WITH {_NEAR}, l1 AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM near),
l2 AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY (id * 7919) % 1009, id)::INT AS rank FROM near),
f AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT * FROM l1 WHERE rank <= 20 UNION ALL SELECT * FROM l2 WHERE rank <= 20) GROUP BY ALL)"""


def _fused(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    q, v = _stated(spark, d)
    first = retrieval.nearest(q, v, 20).select("query_id", "id", "rank")
    order = (F.col("id") * 7919) % 1009, F.col("id")
    same = v.select("id").orderBy(*order).limit(20).withColumn("rank", F.row_number().over(W.orderBy(*order)))  # for every query
    second = q.select("query_id").join(F.broadcast(same)).select("query_id", "id", "rank")
    return retrieval.rank_fusion(first.union(second))


@query(f"{_TWO} SELECT query_id, id, round(score, 9) AS score FROM f")
def rrf_fusion(spark, d):
    return _fused(spark, d).withColumn("score", F.round("score", 9))


@query(f"{_TWO} SELECT query_id, id, round(CASE WHEN max(score) OVER o <= min(score) OVER o THEN 0 ELSE (score - min(score) OVER o) / (max(score) OVER o - min(score) OVER o) END, 6) AS scaled FROM f WINDOW o AS (PARTITION BY query_id)")
def minmax_pool(spark, d):
    return _fused(spark, d).select("query_id", "id", F.round(retrieval.minmax("score", ["query_id"]), 6).alias("scaled"))


@query(f"""WITH {_NEAR}, r AS (SELECT query_id, id, (id % 10) / 10.0::DOUBLE AS value, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM near)
SELECT query_id, id, round(least(0.05::DOUBLE, 0.02::DOUBLE * (coalesce(lag(value) OVER o, 0) + coalesce(lead(value) OVER o, 0))), 9) AS boost FROM r WHERE rank <= 10 WINDOW o AS (PARTITION BY query_id ORDER BY rank)""")
def rank_neighbour_boost(spark, d):
    q, v = _stated(spark, d)
    ranked = retrieval.nearest(q, v, 10).withColumn("value", (F.col("id") % 10) / 10.0)
    return ranked.select("query_id", "id", F.round(retrieval.neighbour_boost(ranked, "value", ["query_id"]), 9).alias("boost"))


@query()
def hybrid_score(spark, d):
    from ..operators import retrieval as r

    chunks = written(r.with_vectors(_docs(spark, d).select(F.col("doc_id").alias("chunk_id"), _cited().alias("text")), "chunk_id"), "texts")
    q = r.with_vectors(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), "query_id")
    return r.hybrid(q, chunks, 10)


@query()
def mmr_rerank(spark, d):
    q, v = _stated(spark, d)
    candidates = retrieval.nearest(q, v, 30).join(v, "id").join(q, "query_id").select("query_id", "id", "query", "vector")
    return retrieval.mmr(candidates, 10).select("query_id", "id", "mmr_rank")


def _ranked_chunks(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    linked = chunking.link(chunking.chunk(_docs(spark, d)).drop("chunk_text")).withColumnRenamed("doc_id", "document_id")
    return linked.withColumn("rank", F.row_number().over(W.partitionBy("document_id").orderBy(F.md5(F.col("chunk_id").cast("binary")), "chunk_id")))


_RANKED = f"""{_CHUNKS}, ranked AS (SELECT doc_id AS document_id, chunk_id, token_count, lag(chunk_id) OVER o AS before, lead(chunk_id) OVER o AS after,
  row_number() OVER (PARTITION BY doc_id ORDER BY md5(chunk_id), chunk_id)::INT AS rank FROM ck WINDOW o AS (PARTITION BY doc_id ORDER BY ordinal))"""


@query(f"""WITH RECURSIVE {_RANKED}, walk AS (
  SELECT document_id, chunk_id, rank, true AS kept, [before, after] AS banned FROM ranked WHERE rank = 1
  UNION ALL SELECT r.document_id, r.chunk_id, r.rank, NOT list_contains(w.banned, r.chunk_id),
    CASE WHEN list_contains(w.banned, r.chunk_id) THEN w.banned ELSE list_concat(w.banned, [r.before, r.after]) END
  FROM walk w JOIN ranked r ON r.document_id = w.document_id AND r.rank = w.rank + 1)
SELECT document_id, chunk_id, rank FROM walk WHERE kept""")
def neighbour_collapse(spark, d):
    return retrieval.collapse_neighbours(_ranked_chunks(spark, d).select("document_id", "chunk_id", "rank", "previous_chunk_id", "next_chunk_id")).select("document_id", "chunk_id", "rank")


@query(f"""WITH {_RANKED},
listed AS (SELECT document_id, rank, unnest([chunk_id, before, after]) AS c, unnest([0, 1, 2]) AS pos FROM ranked),
met AS (SELECT document_id, c, min(rank * 3 + pos) AS seen FROM listed WHERE c IS NOT NULL GROUP BY ALL),
taken AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY seen) AS nth FROM met) WHERE nth <= 15),
used AS (SELECT r.document_id, r.rank, r.chunk_id FROM ranked r WHERE (SELECT count(*) FROM met m WHERE m.document_id = r.document_id AND m.seen < r.rank * 3) < 15),
leaving AS (SELECT document_id, c, min(turn) AS turn FROM (
  SELECT document_id, c, (seen % 3) - (seen // 3) * 10 AS turn FROM taken WHERE seen % 3 > 0
  UNION ALL SELECT document_id, chunk_id, 3 - rank * 10 FROM used) GROUP BY ALL),
sized AS (SELECT t.document_id, t.c, t.nth, k.token_count, l.turn FROM taken t JOIN leaving l USING (document_id, c) JOIN ck k ON k.chunk_id = t.c),
summed AS (SELECT *, sum(token_count) OVER (PARTITION BY document_id ORDER BY turn DESC) AS rest FROM sized)
SELECT document_id, c AS chunk_id, row_number() OVER (PARTITION BY document_id ORDER BY nth)::INT AS position FROM summed WHERE rest <= 1000""")
def token_budget(spark, d):
    return retrieval.expand_and_prune(_ranked_chunks(spark, d).select("document_id", "chunk_id", "rank", "previous_chunk_id", "next_chunk_id", "token_count"))


#: The triplets of a whole document overlap in two ids each, so they are one group.
@query(f"""WITH {_CHUNKS} SELECT doc_id AS document_id, 0::INT AS "group", list(chunk_id ORDER BY chunk_id) AS chunk_ids, list(chunk_id ORDER BY ordinal) AS anchors FROM ck GROUP BY doc_id""")
def merge_triples(spark, d):
    chunks = chunking.chunk(_docs(spark, d)).select(F.col("doc_id").alias("document_id"), "ordinal", "chunk_id")
    return retrieval.merge_triplets(retrieval.triplets(chunks))


@query(f"""WITH {_CHUNKS}, s AS (SELECT doc_id, chunk_id, sum(token_count) OVER (PARTITION BY doc_id ORDER BY chunk_id) AS n FROM ck)
SELECT doc_id AS document_id, 0::INT AS "group", coalesce(list(chunk_id ORDER BY chunk_id) FILTER (WHERE n <= 1000), []) AS chunk_ids FROM s GROUP BY doc_id""")
def group_budget(spark, d):
    chunks = chunking.chunk(_docs(spark, d)).withColumnRenamed("doc_id", "document_id")
    tokens = chunks.groupBy("document_id").agg(F.map_from_entries(F.collect_list(F.struct("chunk_id", "token_count"))).alias("tokens"))
    return retrieval.budget_groups(retrieval.merge_triplets(retrieval.triplets(chunks.select("document_id", "ordinal", "chunk_id"))), tokens)


@query("SELECT event_id, event_type FROM events JOIN (SELECT event_type, quantile_cont(value, 0.7) AS q FROM events GROUP BY event_type) USING (event_type) WHERE value >= q")
def percentile_gate(spark, d):
    return retrieval.percentile_gate(table(spark, d, "events"), "value", 0.7, ["event_type"]).select("event_id", "event_type")


@query("SELECT round(median(value), 9) AS median_score, round(max(value), 9) AS max_score, round(avg(value), 6) AS avg_score FROM events WHERE value > 0")
def result_stats(spark, d):
    out = retrieval.result_stats(table(spark, d, "events"), "value")
    return out.select(F.round("median_score", 9).alias("median_score"), F.round("max_score", 9).alias("max_score"), F.round("avg_score", 6).alias("avg_score"))


_KNN = f"""v AS ({_V}), near AS (SELECT a.vec_id AS id, b.vec_id AS neighbour, list_cosine_similarity(a.e, b.e) AS s FROM v a, v b WHERE a.vec_id <> b.vec_id),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, neighbour)::INT AS rank FROM near) WHERE rank <= 5)"""


@query(f"WITH {_KNN} SELECT id AS src, neighbour AS dst, round(s, 6) AS weight FROM k")
def knn_graph(spark, d):
    return graph.knn_edges(table(spark, d, "embeddings"), 5).withColumn("weight", F.round("weight", 6))


@query(f"""WITH {_KNN}, n AS (SELECT vec_id, sqrt(list_dot_product(e, e)) AS norm FROM v)
SELECT id, round(avg(s), 6) AS mean_s, round(max(s), 6) AS max_s, round(var_pop(s), 6) AS var_s, round(avg(norm), 6) AS mean_n, round(max(norm), 6) AS max_n FROM k JOIN n ON n.vec_id = k.neighbour GROUP BY id""")
def neighbourhood_stats(spark, d):
    v = table(spark, d, "embeddings")
    out = features.neighbourhood(retrieval.knn(v, 5), v.select(F.col("vec_id").alias("id"), retrieval.norm(F.col("embedding")).alias("norm")))
    r = lambda c, name: F.round(f"neighborhood_{c}", 6).alias(name)
    return out.select("id", r("mean_similarity", "mean_s"), r("max_similarity", "max_s"), r("var_similarity", "var_s"), r("mean_norm", "mean_n"), r("max_norm", "max_n"))


@query(f"WITH {_KNN} SELECT round(quantile_cont(s, 0.9), 6) AS threshold FROM k WHERE s < 1")
def similarity_threshold(spark, d):
    return features.similarity_threshold(retrieval.knn(table(spark, d, "embeddings"), 5), "percentile_90").withColumn("threshold", F.round("threshold", 6))


@query(f"WITH {_KNN}, s AS (SELECT s, lead(s) OVER (ORDER BY s DESC) AS nx FROM k WHERE s < 1) SELECT round(max_by(s, s - nx), 6) AS threshold FROM s WHERE nx IS NOT NULL")
def similarity_gap(spark, d):
    return features.similarity_threshold(retrieval.knn(table(spark, d, "embeddings"), 5), "elbow_method").withColumn("threshold", F.round("threshold", 6))


@query(f"WITH {_KNN} SELECT (SELECT count(*) FROM v)::BIGINT AS vertices, count(*)::BIGINT AS edges, 2.0 * count(*) / (SELECT count(*) FROM v) AS avg_degree FROM k")
def graph_stats(spark, d):
    v = table(spark, d, "embeddings")
    return graph.graph_stats(v, graph.knn_edges(v, 5))


@query()
def graph_clusters(spark, d):
    v = table(spark, d, "embeddings")
    return graph.cluster_report(graph.clusters(v, graph.knn_edges(v, 5).withColumn("weight", F.round("weight", 9)), rounds=4))


@query("""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding)))::INT AS dim FROM embeddings),
g AS (SELECT a.dim AS id, b.dim AS neighbour, sum(a.x * b.x) AS s FROM e a JOIN e b USING (vec_id) GROUP BY ALL),
n AS (SELECT id, sqrt(s) AS norm FROM g WHERE id = neighbour),
c AS (SELECT g.id, g.neighbour, g.s / (a.norm * b.norm) AS similarity FROM g JOIN n a ON a.id = g.id JOIN n b ON b.id = g.neighbour WHERE g.id <> g.neighbour)
SELECT id, neighbour, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, neighbour) AS r FROM c) WHERE r <= 4""")
def dimension_clusters(spark, d):
    """The graph among vector dimensions: each dimension's nearest by cosine over all rows."""
    out = graph.nearest_dimensions(table(spark, d, "embeddings"), 4)
    return out.select("id", "neighbour", F.round("similarity", 6).alias("similarity"))


@query()
def global_pca(spark, d):
    from ..operators import models

    out = models.pca(table(spark, d, "embeddings"), 2)
    return out.select("vec_id", F.round("PCA_1", 6).alias("PCA_1"), F.round("PCA_2", 6).alias("PCA_2"))


@query("SELECT label, idx::INT AS dim, round(avg(x), 6) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS idx FROM embeddings) GROUP BY ALL")
def prototype_means(spark, d):
    from ..operators import models

    p = models.prototypes(table(spark, d, "embeddings"), "label")
    return p.select("label", F.posexplode("prototype").alias("dim", "x")).withColumn("x", F.round("x", 6))
