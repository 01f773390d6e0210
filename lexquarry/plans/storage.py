"""Queries over readers, sinks and whole jobs: tables are written to the shared folder in some format and read back by the reader in question."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import citations as C
from ..functions import text as X
from ..operators import chunking, features, models, retrieval
from ..session import scratch, table
from ..sources import readers, sinks
from . import jobs
from .corpus import CITED, _cited, _docs

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def _text_files(rows: DataFrame, key: str, text: str) -> str:
    """A folder with one text file for each key, in a folder key=value of its own."""
    path = _folder(rows.sparkSession, "files")
    rows.select(F.col(key).alias("key"), F.col(text).alias("value")).repartition("key").write.partitionBy("key").text(path)
    return path


def _key(path: str = "path"):
    return F.regexp_extract(path, "key=([^/]+)", 1).cast("long")


@query("SELECT doc_id, md5(text) AS text_md5, lang, source FROM documents")
def table_scan(spark, d):
    rows = readers.table(spark, f"{d}/documents.parquet")
    return rows.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "lang", "source")


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, lang LIMIT 100")
def adhoc_sql(spark, d):
    """The caller's SQL over a view, with the default limit."""
    return readers.query(spark, "SELECT lang, count(*) AS n FROM docs_view GROUP BY lang ORDER BY n DESC, lang", docs_view=_docs(spark, d))


@query("SELECT c_custkey, c_name, c_custkey % 5 != 0 AS good FROM (SELECT CASE WHEN c_custkey % 5 != 0 THEN c_custkey END AS c_custkey, CASE WHEN c_custkey % 5 != 0 THEN c_name END AS c_name FROM customer) WHERE c_custkey IS NOT NULL UNION ALL SELECT NULL, NULL, false FROM customer WHERE c_custkey % 5 = 0")
def json_documents(spark, d):
    """JSON arrays of customers, a file a nation; each fifth key is no number, and its row is kept apart."""
    rows = table(spark, d, "customer").select("c_nationkey", "c_name", F.when(F.col("c_custkey") % 5 == 0, F.lit("none")).otherwise(F.col("c_custkey").cast("string")).alias("k"))
    item = F.concat(F.lit('{"c_name":"'), F.col("c_name"), F.lit('","c_custkey":'), F.when(F.col("k") == "none", F.lit('"none"')).otherwise(F.col("k")), F.lit("}"))
    arrays = rows.groupBy("c_nationkey").agg(F.concat(F.lit("["), F.array_join(F.collect_list(item), ","), F.lit("]")).alias("json"))
    schema = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType())])
    good, bad = readers.json_rows(spark, _text_files(arrays, "c_nationkey", "json"), schema)
    return good.withColumn("good", F.lit(True)).unionByName(bad.select(F.lit(None).cast("long").alias("c_custkey"), F.lit(None).cast("string").alias("c_name"), F.lit(False).alias("good")))


@query("SELECT doc_id, quality, toxic FROM labels")
def csv_labels(spark, d):
    """A CSV with an index column, which is dropped, and required columns."""
    path = _folder(spark, "labels")
    sinks.export(table(spark, d, "labels").select(F.lit(0).alias("i"), "doc_id", "quality", "toxic"), path, "csv")
    rows = readers.csv(spark, path, required=["doc_id", "quality"], index=True)
    return rows.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"), F.col("toxic").cast("int"))


@query("SELECT vec_id, embedding[1]::DOUBLE AS x1, embedding[64]::DOUBLE AS x64, len(embedding)::INTEGER AS dims FROM embeddings")
def wide_vector_file(spark, d):
    """Vectors as a file of one column a dimension, read back as arrays."""
    path = _folder(spark, "wide")
    rows = table(spark, d, "embeddings")
    rows.select(F.col("vec_id").alias("dataset_id"), *[F.col("embedding")[i].alias(f"d{i}") for i in range(64)]).write.parquet(path)
    back = readers.wide_vectors(spark, path)
    return back.select(F.col("dataset_id").alias("vec_id"), F.col("embedding")[0].cast("double").alias("x1"), F.col("embedding")[63].cast("double").alias("x64"), F.size("embedding").alias("dims"))


@query("SELECT vec_id, len(embedding)::INTEGER AS dims FROM embeddings WHERE label = 3")
def vector_store(spark, d):
    """Vectors with metadata, loaded by a value of it."""
    path = _folder(spark, "vectors")
    table(spark, d, "embeddings").select("vec_id", "embedding", F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata")).write.parquet(path)
    return readers.vectors(spark, path, {"label": "3"}).select("vec_id", F.size("embedding").alias("dims"))


@query("SELECT n_nationkey, (length(n_name) + 1)::BIGINT AS length FROM nation")
def file_inventory(spark, d):
    """Files of a folder without their contents."""
    rows = readers.files(spark, _text_files(table(spark, d, "nation"), "n_nationkey", "n_name"), "*.txt")
    return rows.select(_key().alias("n_nationkey"), "length")


@query("SELECT n_nationkey, md5(n_name || chr(10)) AS file_hash, sha256(n_name || chr(10)) AS sha256 FROM nation")
def file_hashes(spark, d):
    rows = readers.file_hashes(spark, _text_files(table(spark, d, "nation"), "n_nationkey", "n_name"))
    return rows.select(_key().alias("n_nationkey"), "file_hash", "sha256")


def _broken(content: bytes) -> list[str]:
    raise ValueError("this parser reads nothing")


@query("SELECT conv_id, count(*)::INTEGER AS n_pages, 1 AS parser, '0: this parser reads nothing' AS error FROM conversations GROUP BY conv_id")
def parser_chain(spark, d):
    """A file a conversation, a page a turn; the first parser fails on all files, the second reads them."""
    texts = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.collect_list(F.concat("role", F.lit(" "), F.replace(F.coalesce("text", F.lit("")), F.lit("\f"), F.lit(" ")))), "\f").alias("t"))
    rows = readers.pages(spark, _text_files(texts, "conv_id", "t"), [_broken, readers.form_feed_pages], "*.txt")
    return rows.select(_key().alias("conv_id"), F.size("pages").alias("n_pages"), "parser", "error")


@query("""SELECT conv_id, count(*)::INTEGER AS n_pages, md5(string_agg(page, chr(12) ORDER BY p)) AS pages_md5 FROM
  (SELECT conv_id, turn // 2 AS p, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS page FROM conversations GROUP BY conv_id, turn // 2) GROUP BY conv_id""")
def element_pages(spark, d):
    """Elements (turns) joined to pages of two."""
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("path"), F.floor(F.col("turn") / 2).alias("page"), F.col("turn").alias("ordinal"), "text")
    back = readers.element_pages(rows)
    return back.select(F.col("path").alias("conv_id"), F.size("pages").alias("n_pages"), F.md5(F.array_join("pages", "\f").cast("binary")).alias("pages_md5"))


@query(f"SELECT doc_id, len(regexp_extract_all(text, '\\bGSE\\d+\\b'))::INTEGER AS geo, len(regexp_extract_all(text, '\\bSRR\\d+\\b'))::INTEGER AS sra FROM {CITED}")
def registry_patterns(spark, d):
    """Patterns of a registry file: anchored ones become word-bounded, one that is too broad is dropped."""
    path = _folder(spark, "registry")
    entry = '{"geo": {"pattern": "^GSE\\\\d+$"}, "sra": {"pattern": "^SRR\\\\d+$"}, "wide": {"pattern": "^\\\\w+$"}, "none": {}}'
    spark.createDataFrame([(entry,)], "value string").coalesce(1).write.text(path)
    patterns = readers.registry(spark, path)
    return _docs(spark, d).select("doc_id", *[F.regexp_count(_cited(), F.lit(p)).alias(k) for k, p in sorted(patterns.items())])


@query("SELECT kind, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer, (VALUES ('csv'), ('json'), ('orc'), ('parquet')) k(kind) GROUP BY kind")
def export_formats(spark, d):
    """Customers exported in each format and read back."""
    rows, out = table(spark, d, "customer").select("c_custkey", "c_name"), None
    for kind in ("csv", "json", "orc", "parquet"):
        path = _folder(spark, kind)
        sinks.export(rows, path, kind)
        back = spark.read.schema(rows.schema).option("header", True).format(kind).load(path)
        one = back.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))
        out = one if out is None else out.union(one)
    return out


@query("SELECT count(*) AS n, count(DISTINCT vec_id) AS ids, true AS bounded FROM embeddings")
def vector_upsert_batches(spark, d):
    """Vectors written in files of at most 4,000 rows."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    store = sinks.Versioned(spark, _folder(spark, "store"), rows.schema)
    store.write(rows, most_rows=4000)
    back = store.read().withColumn("file", F.input_file_name()).groupBy("file").agg(F.count("*").alias("c"), F.collect_set("vec_id").alias("ids"))
    return back.agg(F.sum("c").alias("n"), F.sum(F.size("ids")).cast("long").alias("ids"), F.coalesce(F.max("c") <= 4000, F.lit(True)).alias("bounded"))


@query("""SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM labels) AS citations,
  (SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)) AS linked_documents""")
def migration(spark, d):
    """Documents and citations written as tables, and verified."""
    documents = _docs(spark, d).select(F.col("doc_id").cast("string").alias("doi"), F.array("text").alias("full_text"))
    cited = table(spark, d, "labels").select(F.concat(F.lit("c"), F.col("doc_id")).alias("data_citation"), F.col("doc_id").cast("string").alias("document_id"))
    kinds = {"documents": documents.schema, "citations": cited.schema}
    return sinks.migrate(spark, documents, cited, _folder(spark, "migrated"), kinds)


@query("SELECT sha256(n_name || chr(10)) AS model_hash, 0.5::DOUBLE AS best_f1 FROM nation")
def model_registry(spark, d):
    """Model files keyed by the hash of their content; registering them again adds nothing."""
    files = spark.read.format("binaryFile").load(_text_files(table(spark, d, "nation"), "n_nationkey", "n_name")).select("path", "content")
    none = spark.createDataFrame([], schemas.MODELS)
    once = sinks.register_model(none, files, 0.1)
    return sinks.register_model(once.select(*none.columns), files, 0.5).select("model_hash", F.col("best_f1").cast("double").alias("best_f1"))


@query("SELECT n_nationkey, upper(n_name) || '!' AS n_name FROM nation")
def versioned_publish(spark, d):
    """Readers see the last whole version of a table."""
    rows = table(spark, d, "nation").select("n_nationkey", "n_name")
    store = sinks.Versioned(spark, _folder(spark, "nations"), rows.schema)
    store.write(rows)
    store.write(rows.withColumn("n_name", F.concat(F.upper("n_name"), F.lit("!"))))
    return store.read()


@query("""SELECT r.r_regionkey, CASE WHEN r_regionkey % 2 = 0 THEN 'new ' || r_name ELSE r_name END AS r_name, count(n.n_nationkey) AS children
  FROM region r LEFT JOIN nation n ON n.n_regionkey = r.r_regionkey GROUP BY ALL""")
def update_keeps_children(spark, d):
    """Parents updated in place: none of their children is lost."""
    regions, nations = table(spark, d, "region").select("r_regionkey", "r_name"), table(spark, d, "nation")
    changed = regions.where("r_regionkey % 2 = 0").select("r_regionkey", F.concat(F.lit("new "), "r_name").alias("r_name"))
    parents = sinks.patched(regions, changed, ["r_regionkey"])
    lost = sinks.orphans(nations, parents, "n_regionkey", "r_regionkey").agg(F.count("*").alias("lost"))
    children = nations.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("children"))
    joined = parents.join(children, "r_regionkey", "left").crossJoin(F.broadcast(lost))  # one row
    return joined.select("r_regionkey", "r_name", (F.coalesce("children", F.lit(0)) - F.col("lost")).alias("children"))


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_orderkey % 7 = 0)")
def delete_ordered_parts(spark, d):
    doomed = table(spark, d, "lineitem").where("l_orderkey % 7 = 0").select(F.col("l_partkey").alias("p_partkey"))
    return sinks.without_keys(table(spark, d, "part").select("p_partkey"), doomed, ["p_partkey"])


@query("""SELECT feature, round(mean, 6) AS mean FROM (UNPIVOT (SELECT avg(p_partkey) AS p_partkey, avg(p_size)::DOUBLE AS p_size, avg(p_retailprice) AS p_retailprice FROM part)
  ON p_partkey, p_size, p_retailprice INTO NAME feature VALUE mean)""")
def numeric_features(spark, d):
    """Means of the columns that are numbers."""
    rows = table(spark, d, "part")
    columns = features.numeric_columns(rows)
    return rows.agg(*[F.avg(c).alias(c) for c in columns]).unpivot([], columns, "feature", "mean").select("feature", F.round("mean", 6).alias("mean"))


@query("SELECT p_partkey, p_name, p_size FROM part")
def prefixed_features(spark, d):
    rows = table(spark, d, "part")
    return rows.select(*features.prefixed_columns(rows, ("p_na", "p_si"), ["p_partkey"]))


@query("""SELECT l_orderkey AS document_id, l_partkey % 10 AS citation, sum(n)::BIGINT AS count_pre, coalesce(sum(n) FILTER (l_returnflag != 'R'), 0)::BIGINT AS count_post
  FROM (SELECT *, l_quantity::BIGINT AS n FROM lineitem) GROUP BY ALL HAVING coalesce(sum(n) FILTER (l_returnflag != 'R'), 0) < sum(n)""")
def lost_citations(spark, d):
    """Counts by document and citation, before and after: where fewer are left."""
    before = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), (F.col("l_partkey") % 10).alias("citation"), F.col("l_quantity").cast("long").alias("n"), "l_returnflag")
    return C.lost(before, before.where("l_returnflag != 'R'"))


@query("SELECT doc_id, len(embedding)::INTEGER AS dims FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def chunk_embeddings(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.size("embedding").alias("dims"))
    return _docs(spark, d).select("doc_id").join(vectors, "doc_id", "left")


@query(f"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, '-' || chr(10), ''), chr(10), ' '),
  'https://doi.org', '', 'g'), 'https://dx.doi.org', '', 'g'), 'http://dx.doi.org', '', 'g'), 'http://doi.org', '', 'g')) AS text_md5 FROM {CITED}""")
def normalise_text(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(X.normalise(_cited()).cast("binary")).alias("text_md5"))


@query("SELECT vec_id, (1 - (0.25 * label)) + 0.15 * (label % 2) AS score FROM (SELECT vec_id, label::DOUBLE AS label FROM embeddings)")
def fused_scores(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("double").alias("label"))
    return rows.select("vec_id", X.fused_score(F.lit(0.25) * F.col("label"), F.col("label") % 2).alias("score"))


@query("""SELECT doc_id, lo <= n AND n <= hi AS in_range, n % 3 != 1 AS in_list FROM
  (SELECT doc_id, 100000 + doc_id * 7 AS n, 100000 + doc_id * 7 - 5 + doc_id % 11 AS lo, 100000 + doc_id * 7 + 3 + doc_id % 11 AS hi FROM documents)""")
def citation_series(spark, d):
    """Numbers within hyphenated ranges, and in lists under one prefix, of which some end before the number."""
    n = F.lit(100000) + F.col("doc_id") * 7
    low = n - 5 + F.col("doc_id") % 11
    ranges = F.concat(F.lit("see MK"), low, F.lit("–MK"), low + 8, F.lit(" here"))
    listed = F.concat(F.lit("CCDC 999, 98, "), F.when(n % 3 == 1, F.lit("and 12. ")).otherwise(""), n, F.lit(" and others"))
    held = lambda prefix, text: C.in_series(F.concat(F.lit(prefix), n), F.array(text))
    return _docs(spark, d).select("doc_id", held("MK", ranges).alias("in_range"), held("CCDC ", listed).alias("in_list"))


@query(f"""SELECT doc_id, ((length(t) - length(replace(t, c, ''))) // length(c) + (length(u) - length(replace(u, c, ''))) // length(c))::INTEGER AS n
  FROM (SELECT doc_id, lower(text) AS t, lower(replace(replace(text, '-' || chr(10), ''), chr(10), ' ')) AS u, 'gse' || (doc_id * 37) AS c FROM {CITED})""")
def direct_matches(spark, d):
    """Plain occurrences of a document's accession over its text and the normalised text."""
    rows = _docs(spark, d).select("doc_id", _cited().alias("t"), F.concat(F.lit("GSE"), F.col("doc_id") * 37).alias("c"))
    flat = F.replace(F.replace("t", F.lit("-\n"), F.lit("")), F.lit("\n"), F.lit(" "))
    return rows.select("doc_id", C.direct(F.col("c"), F.array("t", flat)).alias("n"))


@query("SELECT conv_id, md5(string_agg(text, chr(12) ORDER BY turn)) AS texts_md5, arg_min(role, turn) AS role FROM conversations GROUP BY conv_id")
def merged_results(spark, d):
    """Batch results (turns) merged for each conversation."""
    parts = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("part"), F.array("text").alias("texts"), "role")
    return chunking.merge_results(parts, "conv_id", ["texts"], ["role"]).select("conv_id", F.md5(F.array_join("texts", "\f").cast("binary")).alias("texts_md5"), "role")


@query("SELECT conv_id, (ceil(max(len(string_split(text, ' '))) / 100.0) * 100 + 20)::INTEGER AS win FROM conversations GROUP BY conv_id")
def adjusted_windows(spark, d):
    longest = table(spark, d, "conversations").groupBy("conv_id").agg(F.max(F.size(F.split("text", " "))).alias("n"))
    return longest.select("conv_id", chunking.adjusted_window(F.col("n"), 20).alias("win"))


@query("""SELECT conv_id, string_agg(DISTINCT role, ',' ORDER BY role) AS both_roles, string_agg(role, ',' ORDER BY first) AS in_order FROM
  (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY conv_id, role) GROUP BY conv_id""")
def anchors_then_retrieved(spark, d):
    """Ordered union: the first turn's role, then all roles in order, each once."""
    roles = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("r"))
    union = retrieval.ordered_union(F.slice("r", 1, 1), F.col("r"), 1_000_000)
    return roles.select("conv_id", F.array_join(F.array_sort(F.array_distinct("r")), ",").alias("both_roles"), F.array_join(union, ",").alias("in_order"))


@query("SELECT * FROM (VALUES (0, 'read'), (1, 'chunk'), (2, 'embed'), (3, 'label'), (4, 'join')) t(position, step)")
def step_order(spark, d):
    steps = retrieval.step_order({"join": ["embed", "label"], "embed": ["chunk"], "chunk": ["read"], "label": ["read"], "read": []})
    return spark.createDataFrame(list(enumerate(steps)), "position int, step string")


@query("""SELECT name, n AS columns, true AS readable FROM (VALUES ('region', 2), ('labels', 3)) t(name, n) UNION ALL SELECT 'gone', 0, false""")
def health_check(spark, d):
    lacking = spark.range(1).select(F.raise_error(F.lit("no such table")).alias("x"))
    return jobs.health(spark, {"region": table(spark, d, "region").select("r_regionkey", "r_name"), "labels": table(spark, d, "labels").select("doc_id", "quality", "toxic"), "gone": lacking})


@query("""SELECT doc_id AS dataset_id, md5(t) AS text_md5, length(t)::BIGINT AS clean_text_length FROM (SELECT doc_id, regexp_replace(text, '(?i)\\bGSE' || (doc_id * 37) || '\\b', '<DATASET_ID>', 'g') AS t
  FROM """ + CITED + ")")
def constructed_datasets(spark, d):
    """A dataset a document, of its only chunk, with its own accession masked."""
    docs = _docs(spark, d).select("doc_id", _cited().alias("chunk_text"))
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.lit(0).alias("ordinal"), "chunk_text", X.approx_tokens("chunk_text").alias("token_count"))
    wanted = docs.select(F.concat(F.lit("GSE"), F.col("doc_id") * 37).alias("dataset_id"), F.col("doc_id").alias("document_id"), F.array("doc_id").alias("chunk_ids"))
    out = jobs.construct_datasets(wanted, chunks)
    return out.select(F.col("document_id").alias("dataset_id"), F.md5(F.col("text").cast("binary")).alias("text_md5"), F.col("clean_text_length").cast("long"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE label = 0),
  s AS (SELECT list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.vec_id < b.vec_id)
  SELECT round(min(s), 9) AS threshold FROM (SELECT s FROM s ORDER BY s DESC LIMIT (SELECT 4 * count(*) // 2 + 1 FROM v))""")
def similarity_degree_target(spark, d):
    """The similarity that gives the vectors of one label a mean degree of 4."""
    v = table(spark, d, "embeddings").where("label = 0").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    pairs = v.join(v.select(F.col("vec_id").alias("other"), F.col("e").alias("f")), F.col("vec_id") < F.col("other"))
    rows = pairs.select(retrieval.cosine(F.col("e"), F.col("f")).alias("similarity"))
    return features.similarity_threshold(rows, "degree_target", 4, v.count()).select(F.round("threshold", 9).alias("threshold"))


@query("SELECT a, b, round(CASE WHEN a = b THEN 1 WHEN a || b IN ('p_sizep_retailprice', 'p_retailpricep_size') THEN r1 ELSE r2 END, 6) AS r FROM (SELECT corr(p_size, p_retailprice) AS r1, corr(p_partkey, p_size) AS r2 FROM part), (VALUES ('p_size', 'p_size'), ('p_size', 'p_retailprice'), ('p_retailprice', 'p_size'), ('p_retailprice', 'p_retailprice')) t(a, b)")
def correlations(spark, d):
    columns = ["p_size", "p_retailprice"]
    m = models.correlation_matrix(table(spark, d, "part").select(*[F.col(c).cast("double").alias(c) for c in columns]), columns)
    return spark.createDataFrame([(a, b, round(m[i][j], 6)) for i, a in enumerate(columns) for j, b in enumerate(columns)], "a string, b string, r double")


@query("SELECT count(*) AS n, 0::BIGINT AS shared_groups, true AS near_share FROM orders")
def group_holdout(spark, d):
    """A split by group: all rows are in one part, no group in both, and the share is about that asked for."""
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    train, held = models.split_by_group(rows, "o_custkey", 0.2)
    both = train.withColumn("h", F.lit(0)).union(held.withColumn("h", F.lit(1)))
    groups = both.groupBy("o_custkey").agg(F.count("*").alias("n"), F.countDistinct("h").alias("parts"), F.max("h").alias("held"))
    return groups.agg(F.sum("n").alias("n"), F.count(F.when(F.col("parts") > 1, 1)).alias("shared_groups"), F.avg("held").between(0.1, 0.3).alias("near_share"))


@query("SELECT count(*) AS n, 5::BIGINT AS folds, 0::BIGINT AS shared_groups FROM orders")
def group_folds(spark, d):
    rows = models.folds(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", 5)
    groups = rows.groupBy("o_custkey").agg(F.count("*").alias("n"), F.collect_set("fold").alias("f"))
    return groups.agg(F.sum("n").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_set("f")))).cast("long").alias("folds"), F.count(F.when(F.size("f") > 1, 1)).alias("shared_groups"))


@query("SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 2 = 0")
def stacked_updates(spark, d):
    """Upserts one after another: labels written in two parts, the odd ones deleted."""
    rows = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    store = sinks.Versioned(spark, _folder(spark, "labels"), rows.schema)
    store.upsert(rows.where("doc_id % 2 = 1"), ["doc_id"])
    store.upsert(rows, ["doc_id"])
    store.write(sinks.without_keys(store.read(), rows.where("doc_id % 2 = 1"), ["doc_id"]))
    return store.read()


@query("SELECT doc_id, quality FROM labels WHERE quality IN (0, 1)")
def import_by_stream(spark, d):
    """A landing folder that a stream takes in, each file once."""
    from ..streaming import landing

    rows = table(spark, d, "labels").where("quality in (0, 1)").select(F.col("doc_id").cast("string").alias("article_id"), F.lit("d").alias("dataset_id"), F.col("quality").cast("string").alias("type"))
    land, store = _folder(spark, "landing"), sinks.Versioned(spark, _folder(spark, "landed"), schemas.LABELS)
    rows.write.parquet(land)
    landing.upsert_stream(spark, land, store, ["article_id", "dataset_id"], _folder(spark, "progress")).awaitTermination()
    return store.read().select(F.col("article_id").cast("long").alias("doc_id"), F.col("type").cast("int").alias("quality"))
