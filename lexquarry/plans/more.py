"""Further queries: text guards, keyword counts, embeddings without a model, retrieval by group and whole jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X
from ..operators import chunking, features, graph, models, quality, retrieval
from ..session import table, written
from . import jobs
from .corpus import _KNN, CITED, _cited, _docs, _sql_text, _stated

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(r"SELECT doc_id, md5(regexp_replace(text, '\p{C}', '', 'g')) AS text_md5 FROM documents WHERE length(text) >= 500")
def minimum_length(spark, d):
    rows = _docs(spark, d).where(F.length("text") >= 500)
    return rows.select("doc_id", F.md5(X.without_controls("text").cast("binary")).alias("text_md5"))


@query(f"""SELECT t AS token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_]+')) AS t FROM {CITED})
  WHERE regexp_matches(t, '\\d') AND NOT regexp_full_match(t, '(19|20)\\d{{2}}') AND length(t) >= 3 AND t NOT IN ({', '.join(map(_sql_text, X.STOP_WORDS))}) GROUP BY t""")
def lexical_guard(spark, d):
    tokens = _docs(spark, d).select(F.explode(X.word_tokens(_cited())).alias("token"))
    return tokens.where(X.entity_like("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("SELECT conv_id, md5(string_agg('## ' || role || chr(10) || text, chr(10) || chr(10) ORDER BY turn)) AS text_md5 FROM conversations GROUP BY conv_id")
def section_assembly(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", F.col("role").alias("kind"), "text")).alias("s"))
    return rows.select("conv_id", F.md5(X.section_text(F.col("s")).cast("binary")).alias("text_md5"))


@query("SELECT conv_id, string_agg(id, ',' ORDER BY turn) AS ids FROM (SELECT conv_id, turn, conv_id || '_chunk_' || turn AS id FROM conversations) GROUP BY conv_id")
def suffix_order(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", F.concat_ws("_", "conv_id", F.lit("chunk"), "turn").alias("id"))
    ordered = F.array_sort(F.collect_list(F.struct(X.numeric_suffix("id").alias("n"), "id")))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["id"]), ",").alias("ids"))


_WORDS = ", ".join(f"({_sql_text(k)}, {_sql_text(w)})" for k, ws in L.TRAINING_KEYWORDS.items() for w in ws)


@query(f"SELECT category, keyword, count(*) AS n FROM {CITED} d, (VALUES {_WORDS}) w(category, keyword) WHERE contains(lower(d.text), keyword) GROUP BY ALL ORDER BY n DESC, category, keyword LIMIT 10")
def keyword_frequency(spark, d):
    """The ten keywords that most texts hold."""
    hits = _docs(spark, d).select(F.explode(X.matched_keywords(_cited(), L.TRAINING_KEYWORDS)).alias("k")).select("k.*")
    return hits.groupBy("category", "keyword").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category", "keyword").limit(10)


@query(f"""SELECT doc_id AS document_id, kind, citation FROM ({' UNION '.join(f"SELECT doc_id, {_sql_text(k)} AS kind, unnest(regexp_extract_all(text, {_sql_text('(?i)' + p)})) AS citation FROM {CITED}" for k, p in L.ACCESSIONS.items())})
  WHERE NOT contains(citation, ' ') AND NOT regexp_matches(citation, '[\\n\\t,]') AND regexp_matches(citation, '\\d')""")
def extract_citations(spark, d):
    return jobs.extract_citations(_docs(spark, d).select(F.col("doc_id").alias("document_id"), _cited().alias("text")))


@query("""SELECT doc_id, dim, sum(CASE WHEN s < 8 THEN 1.0 ELSE -1.0 END)::DOUBLE AS value FROM (SELECT doc_id, (('0x' || substr(md5(t), 1, 6))::INT % 64)::INT AS dim, ('0x' || substr(md5(t), 7, 1))::INT AS s
  FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_]+')) AS t FROM documents)) GROUP BY ALL""")
def hash_embedding(spark, d):
    return retrieval.hash_embedding(_docs(spark, d), "doc_id")


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings), n AS (SELECT a.vec_id AS query_id, b.vec_id AS id, list_cosine_similarity(a.e, b.e) AS score FROM v a JOIN v b ON a.label = b.label WHERE a.vec_id % 50 = 0)
SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM n) WHERE rank <= 5""")
def within_group_topk(spark, d):
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), "label")
    out = retrieval.within_group(q, v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label"), 5, "label")
    return out.withColumn("score", F.round("score", 6))


def _text_vectors(spark, d):
    """The stated queries (documents with ids divisible by 50) and all documents, each with a vector of its text."""
    texts = _docs(spark, d).select(F.col("doc_id").alias("id"), _cited().alias("text"), (F.col("doc_id") % 4 < 3).alias("cited"), "source")
    chunks = written(retrieval.with_vectors(texts, "id"), "texts")  # read for queries, prototypes, neighbours and texts
    return chunks.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query")), chunks


@query()
def training_retrieval(spark, d):
    q, chunks = _text_vectors(spark, d)
    return retrieval.training_retrieval(q, chunks, 3).withColumn("score", F.round("score", 6))


@query()
def boosted_dense(spark, d):
    q, chunks = _text_vectors(spark, d)
    prototypes = models.prototypes(chunks, "source", "vector").select(F.col("source").alias("query_id"), F.col("prototype").alias("query"))
    return retrieval.boosted_dense(q, chunks, prototypes, 10).withColumn("score", F.round("score", 6))


def _embedded(spark, d):
    chunks = chunking.link(chunking.chunk(_docs(spark, d).select("doc_id", _cited().alias("text")))).withColumnRenamed("doc_id", "document_id")
    return written(jobs.embed_chunks(chunks).withColumnRenamed("chunk_text", "text").withColumnRenamed("embedding", "vector"), "chunks")


def _one_query(spark):
    q = spark.range(1).select(F.col("id").alias("query_id"), F.lit(X.query_text(False)).alias("text"))
    return q.join(retrieval.as_vectors(retrieval.hash_embedding(q, "query_id"), "query_id"), "query_id").withColumnRenamed("embedding", "vector")


@query()
def document_context(spark, d):
    return retrieval.document_context(_one_query(spark), _embedded(spark, d))


@query()
def two_pass_context(spark, d):
    embed = lambda rows: retrieval.with_vectors(rows, "key")
    return retrieval.two_pass_context(_one_query(spark), _embedded(spark, d), embed)


@query("SELECT 'q' || vec_id AS query_id, len(embedding)::INTEGER AS dims FROM embeddings WHERE vec_id % 50 = 0 UNION ALL SELECT 'prototype_' || label, 64 FROM (SELECT DISTINCT label FROM embeddings WHERE label IS NOT NULL)")
def stacked_queries(spark, d):
    """The stated queries, and the clusters' prototypes under them."""
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    queries = rows.where("vec_id % 50 = 0").select(F.concat(F.lit("q"), "vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    protos = models.prototype_components(rows.where("label is not null"), "label").select(F.col("label").alias("prototype_id"), F.col("prototype").alias("vector"))
    return retrieval.stacked(queries, protos).select("query_id", F.size("vector").alias("dims"))


@query("""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(0, len(embedding))) AS i FROM embeddings),
  c AS (SELECT vec_id, i, v - avg(v) OVER (PARTITION BY vec_id) AS v FROM x)
  SELECT round(sum(v * v), 3) AS total_variance, 64::BIGINT AS dims, true AS ordered FROM c""")
def dimension_decomposition(spark, d):
    """Components of the transposed matrix: all of them together hold its whole variance, the first more than the second."""
    parts = models.dimension_components(table(spark, d, "embeddings"), 64)
    squares = parts.agg(*[F.sum(F.col(f"PCA_{i + 1}") ** 2).alias(f"s{i}") for i in range(64)], F.count("*").alias("dims"))
    return squares.select(F.round(sum(F.col(f"s{i}") for i in range(64)), 3).alias("total_variance"), "dims", (F.col("s0") >= F.col("s1")).alias("ordered"))


@query()
def corpus_context(spark, d):
    return retrieval.corpus_context(_one_query(spark), _embedded(spark, d), 50)


@query("""SELECT conv_id AS dataset_id, string_agg(DISTINCT id, ',' ORDER BY id) AS chunk_ids FROM (SELECT conv_id, turn::VARCHAR AS id FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id, turn::VARCHAR FROM conversations WHERE turn = 0) GROUP BY conv_id""")
def target_union(spark, d):
    c = table(spark, d, "conversations").withColumn("id", F.col("turn").cast("string")).withColumnRenamed("conv_id", "dataset_id")
    listed = lambda rows, name: rows.groupBy("dataset_id").agg(F.collect_list("id").alias(name))
    out = retrieval.with_target(listed(c.where("role = 'user'"), "retrieved"), listed(c.where("turn = 0"), "targets"))
    return out.select("dataset_id", F.array_join("chunk_ids", ",").alias("chunk_ids"))


@query("""WITH a AS (SELECT 'p_size' AS feature, corr(p_size, p_retailprice) AS r FROM part UNION ALL SELECT 'p_partkey', corr(p_partkey, p_retailprice) FROM part),
b AS (SELECT 'p_size' AS feature, corr(p_size, p_retailprice) AS r FROM part WHERE p_size > 25 UNION ALL SELECT 'p_partkey', corr(p_partkey, p_retailprice) FROM part WHERE p_size > 25)
SELECT feature, round(a.r, 6) AS r_all, round(b.r, 6) AS r_large, round(abs(a.r - b.r), 6) AS difference FROM a JOIN b USING (feature)""")
def correlation_merge(spark, d):
    part = table(spark, d, "part")
    a, b = (features.pearson(p, ["p_size", "p_partkey"], "p_retailprice").select("feature", F.col("r").alias(n)) for p, n in ((part, "r_all"), (part.where("p_size > 25"), "r_large")))
    out = a.join(b, "feature").withColumn("difference", F.abs(F.col("r_all") - F.col("r_large")))
    return out.select("feature", *[F.round(c, 6).alias(c) for c in ("r_all", "r_large", "difference")])


@query("""SELECT doc_id AS dataset_id, CASE WHEN quality = 1 THEN 'PRIMARY' WHEN quality = 0 THEN 'SECONDARY' ELSE 'NONE' END AS dataset_type FROM documents LEFT JOIN (SELECT doc_id, quality FROM labels) USING (doc_id)""")
def import_labels(spark, d):
    sets = _docs(spark, d).select(F.col("doc_id").alias("dataset_id"), F.lit("NONE").alias("dataset_type"))
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("dataset_id"), F.when(F.col("quality") == 1, "Primary").otherwise("Secondary").alias("type"))
    return jobs.import_labels(sets, labels)


@query("SELECT (row_number() OVER (ORDER BY article_id, dataset_id, type) - 1) AS row_id, * FROM (SELECT DISTINCT source AS article_id, lang AS dataset_id, 'Primary' AS type FROM documents)")
def submission_rows(spark, d):
    return jobs.submission(_docs(spark, d).select(F.col("source").alias("article_id"), F.col("lang").alias("dataset_id"), F.lit("Primary").alias("type")))


@query("SELECT unnest(['rows', 'keys', 'items', 'kinds', 'null_items']) AS measure, unnest([count(*), count(DISTINCT source), count(DISTINCT text), count(DISTINCT lang), count(*) FILTER (text IS NULL)])::DOUBLE AS value FROM documents")
def explore_labels(spark, d):
    return jobs.explore(_docs(spark, d), "source", "lang", "text")


@query("SELECT doc_id AS document_id, 100.0::DOUBLE AS retention FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id, NULL FROM documents WHERE doc_id % 4 <> 0")
def chunk_retention(spark, d):
    """Citations before and after chunking, by document: all are kept."""
    docs = _docs(spark, d).select(F.col("doc_id").alias("document_id"), F.array(_cited()).alias("pages"))
    citations = _docs(spark, d).select(F.col("doc_id").alias("document_id"), F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("GSE"), F.col("doc_id") * 37)).alias("citation")).where("citation is not null")
    _, results = jobs.chunking_pipeline(docs, citations)
    return results.select("document_id", "retention")


@query(f"WITH {_KNN} SELECT round(avg(m), 6) AS mean_of_means FROM (SELECT avg(s) AS m FROM k GROUP BY id)")
def neighbourhood_report(spark, d):
    v = table(spark, d, "embeddings")
    return retrieval.knn(v, 5).groupBy("id").agg(F.avg("similarity").alias("m")).agg(F.round(F.avg("m"), 6).alias("mean_of_means"))


@query("SELECT lang, count(*) AS n, count(*) FILTER (n_chars > 1000) AS long_texts, count(*) FILTER (source = 'src0') AS from_src0 FROM documents GROUP BY lang")
def status_aggregate(spark, d):
    n = lambda c: F.count(F.when(c, 1))
    return _docs(spark, d).groupBy("lang").agg(F.count("*").alias("n"), n(F.col("n_chars") > 1000).alias("long_texts"), n(F.col("source") == "src0").alias("from_src0"))


@query("SELECT count(DISTINCT l.doc_id) AS retained, (SELECT count(DISTINCT doc_id) FROM documents) AS expected, count(DISTINCT l.doc_id) / (SELECT count(DISTINCT doc_id) FROM documents) AS retention FROM labels l")
def corpus_retention(spark, d):
    chunks = table(spark, d, "labels").select(F.array("doc_id").alias("citation_entities"))
    return features.corpus_retention(chunks, _docs(spark, d).select(F.col("doc_id").alias("citation")))


@query("SELECT count(*) AS documents, sum(c)::BIGINT AS total_chunks, sum(t)::BIGINT AS total_tokens, true AS success, round(avg(100.0::DOUBLE), 6) AS avg_retention, '' AS errors FROM (SELECT source, count(*) AS c, sum(n_chars) AS t FROM documents GROUP BY source)")
def run_summary(spark, d):
    rows = _docs(spark, d).groupBy("source").agg(F.count("*").alias("total_chunks"), F.sum("n_chars").alias("total_tokens"))
    return chunking.run_summary(rows.withColumns({"success": F.lit(True), "retention": F.lit(100.0), "error": F.lit(None).cast("string")}))


@query("SELECT doc_id FROM documents SEMI JOIN labels USING (doc_id)")
def documents_with_labels(spark, d):
    return _docs(spark, d).select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")


@query("WITH m AS (SELECT lang, source FROM (SELECT DISTINCT lang, source FROM documents)) SELECT lang, count(*) AS missing FROM (SELECT m.* FROM m ANTI JOIN (SELECT DISTINCT lang, source FROM documents JOIN labels USING (doc_id)) x USING (lang, source)) GROUP BY lang")
def missing_by_document(spark, d):
    every = _docs(spark, d).select("doc_id", "lang", "source")
    labelled = every.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    return quality.missing_by(quality.missing(every.select("lang", "source"), labelled.select("lang", "source"), ["lang", "source"]), "lang").withColumnRenamed("n", "missing")


_ALONE = " UNION ALL ".join(f"SELECT {_sql_text(k)} AS kind, count(*) AS documents FROM {CITED} WHERE regexp_matches(text, {_sql_text(f'(?i)(^|[^A-Za-z0-9_])(?:{p})($|[^A-Za-z0-9_])')})" for k, p in L.ENTITIES.items())


@query(f"SELECT * FROM ({_ALONE}) WHERE documents > 0")
def entity_patterns(spark, d):
    """Documents that hold an entity, by kind."""
    hits = _docs(spark, d).select("doc_id", F.explode(X.entities(_cited())).alias("e")).select("doc_id", "e.kind").distinct()
    return hits.groupBy("kind").agg(F.count("*").alias("documents"))


@query("""WITH r AS (SELECT conv_id, turn, turn % 7 = 3 AS seed FROM conversations), n AS (SELECT *, coalesce(lag(seed) OVER o, false) OR coalesce(lead(seed) OVER o, false) OR seed AS near FROM r WINDOW o AS (PARTITION BY conv_id ORDER BY turn))
  SELECT conv_id || '_' || turn AS chunk_id, conv_id AS document_id, near::INT AS target, CASE WHEN near THEN 'RELEVANT' ELSE 'NOT RELEVANT' END AS target_str, 68 AS columns FROM n""")
def chunk_relevance(spark, d):
    """Turns as chunks; those next to one with a citation are relevant too."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.concat_ws("_", "conv_id", "turn").alias("chunk_id"), "text")
    linked = chunking.link(rows, "conv_id", "turn").withColumnRenamed("conv_id", "document_id").withColumn("token_count", X.approx_tokens("text"))
    cited = linked.withColumn("citation_entities", F.when(F.col("turn") % 7 == 3, F.array(F.lit("GSE1"))).otherwise(F.array().cast("array<string>")))
    out = jobs.chunk_relevance(retrieval.with_vectors(cited, "chunk_id"), vector="vector")
    return out.select("chunk_id", "document_id", "target", "target_str", F.lit(len(out.columns) - 1).alias("columns"))


@query("""SELECT quality AS label, count(*) AS n, count(DISTINCT doc_id) AS documents, 5::BIGINT AS folds, true AS even FROM labels GROUP BY quality""")
def stratified_folds(spark, d):
    """Labelled documents dealt to five folds: those of each label evenly."""
    labels = table(spark, d, "labels")
    dealt = models.folds(labels, "doc_id", 5, label="quality").groupBy(F.col("quality").alias("label"), "fold").agg(F.count("*").alias("c"), F.countDistinct("doc_id").alias("g"))
    even = F.max("g") - F.min("g") <= 1 + F.sum("g") / 5000
    return dealt.groupBy("label").agg(F.sum("c").alias("n"), F.sum("g").alias("documents"), F.count("*").alias("folds"), even.alias("even"))


@query()
def balanced_clusters(spark, d):
    """Vectors by clusters of stated sizes in the graph of their nearest neighbours."""
    v = table(spark, d, "embeddings")
    edges = graph.knn_edges(v, 5).withColumn("weight", F.round("weight", 9))
    return graph.balanced_clusters(v, edges, least=6, most=75)


@query()
def training_features(spark, d):
    """From all documents, their citations and labels to training rows."""
    docs = _docs(spark, d).select(F.col("doc_id").alias("document_id"), F.array(_cited()).alias("pages"))
    citations = _docs(spark, d).where("doc_id % 4 = 0").select(F.col("doc_id").alias("document_id"), F.concat(F.lit("GSE"), F.col("doc_id") * 37).alias("citation"))
    kind = F.when(F.col("quality") == 1, "Primary").otherwise("Secondary").alias("type")
    labels = table(spark, d, "labels").select(F.concat(F.lit("GSE"), F.col("doc_id") * 37).alias("dataset_id"), kind)
    return jobs.training_features(docs, citations, labels)
