"""Queries over keyed tables: counts, audits, joins, upserts, features and models, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, quality
from ..session import table
from ..sources import sinks
from ..streaming import landing

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- scans, filters, counts ----------------------------------------------------------------------------------


@query("""SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM labels) AS labels, (SELECT count(*) FROM benchmark) AS benchmark,
  (SELECT count(*) FROM embeddings) AS embeddings, (SELECT count(*) FROM conversations) AS conversations""")
def db_stats(spark, d):
    return quality.table_counts({n: table(spark, d, n) for n in ("documents", "labels", "benchmark", "embeddings", "conversations")})


@query("SELECT doc_id, lang, source FROM documents WHERE source IN ('src1', 'src3') AND lang = 'en'")
def doc_scan_filter_in(spark, d):
    return table(spark, d, "documents").where(F.col("source").isin("src1", "src3") & (F.col("lang") == "en")).select("doc_id", "lang", "source")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem l WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_custkey = l.l_suppkey)")
def composite_key_semi(spark, d):
    keys = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("l_suppkey"))
    return table(spark, d, "lineitem").join(keys, ["l_orderkey", "l_suppkey"], "left_semi").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT doc_id, upper(kind) AS kind FROM (SELECT doc_id, CASE quality WHEN 1 THEN 'Primary' WHEN 0 THEN 'Secondary' ELSE 'Missing' END AS kind FROM labels) WHERE kind <> 'Missing' AND doc_id IS NOT NULL")
def label_validity(spark, d):
    kinds = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "Primary").when(F.col("quality") == 0, "Secondary").otherwise("Missing").alias("kind"))
    return quality.valid_labels(kinds, "kind", "doc_id")


@query("SELECT quality, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM labels GROUP BY quality")
def class_distribution(spark, d):
    return quality.distribution(table(spark, d, "labels"), "quality")


@query("""WITH a AS (SELECT lang, count(*) AS n, count(*) / (SELECT count(*) FROM documents) AS share FROM documents GROUP BY lang),
e AS (SELECT * FROM (VALUES ('en', 0.6::DOUBLE), ('fr', 0.05::DOUBLE), ('de', 0.3::DOUBLE), ('es', 0.1::DOUBLE)) t(lang, expected))
SELECT lang, expected, coalesce(n, 0) AS n, coalesce(share, 0) AS share, CASE WHEN abs(coalesce(share, 0) - expected) < 0.05 THEN 'OK' WHEN abs(coalesce(share, 0) - expected) < 0.10 THEN 'WARNING' ELSE 'CRITICAL' END AS status FROM e LEFT JOIN a USING (lang)""")
def expected_vs_actual(spark, d):
    return quality.against_expected(table(spark, d, "documents"), "lang", {"en": 0.6, "fr": 0.05, "de": 0.3, "es": 0.1})


@query("""SELECT conv_id, count(*) AS n, string_agg(DISTINCT role, ',' ORDER BY role) AS kinds, bool_or(role = 'user') AS has_user, bool_or(role = 'assistant') AS has_assistant, bool_or(role = 'system') AS has_system, count(DISTINCT text) AS items FROM conversations GROUP BY conv_id""")
def article_label_summary(spark, d):
    return quality.label_summary(table(spark, d, "conversations"), "conv_id", "role", "text", ["user", "assistant", "system"])


@query("""WITH h AS (SELECT conv_id, max((role = 'user')::INT) AS u, max((role = 'assistant')::INT) AS a, max((role = 'system')::INT) AS s FROM conversations GROUP BY conv_id)
SELECT sum((u = 1 AND u + a + s = 1)::BIGINT)::BIGINT AS only_user, sum((a = 1 AND u + a + s = 1)::BIGINT)::BIGINT AS only_assistant, sum((s = 1 AND u + a + s = 1)::BIGINT)::BIGINT AS only_system, sum((u + a + s > 1)::BIGINT)::BIGINT AS several FROM h""")
def label_combinations(spark, d):
    return quality.combinations(table(spark, d, "conversations"), "conv_id", "role", ["user", "assistant", "system"])


@query("""SELECT (SELECT count(*) FROM documents) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS duplicate_rows, (SELECT count(*) FROM documents) - (SELECT count(DISTINCT text) FROM documents) AS duplicate_keys""")
def duplicate_check(spark, d):
    return quality.duplicates(table(spark, d, "documents").select("text", "lang"), ["text"])


@query("SELECT count(*) FILTER (event_id IS NULL) AS event_id, count(*) FILTER (user_id IS NULL) AS user_id, count(*) FILTER (value IS NULL) AS value, count(*) FILTER (props IS NULL) AS props FROM events")
def null_counts(spark, d):
    return quality.null_counts(table(spark, d, "events").select("event_id", "user_id", "value", "props"))


@query("""SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'left_only' ELSE 'both' END AS status, CASE WHEN l.doc_id IS NULL THEN 2 ELSE 1 END AS priority FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)""")
def availability_status(spark, d):
    return quality.availability(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'left_only' ELSE 'both' END AS status FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)) GROUP BY status")
def priority_by_status(spark, d):
    return availability_status(spark, d).groupBy("status").agg(F.count("*").alias("n"))


def _audit(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Labelled and extracted (doc_id, kind) pairs."""
    labelled = table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("kind"))
    extracted = table(spark, d, "documents").select("doc_id", F.when(F.length("text") > 500, "1").otherwise("0").alias("kind"))
    return labelled, extracted


_AUDIT = "l AS (SELECT DISTINCT doc_id, quality::VARCHAR AS kind FROM labels), e AS (SELECT DISTINCT doc_id, CASE WHEN length(text) > 500 THEN '1' ELSE '0' END AS kind FROM documents)"


@query(f"WITH {_AUDIT} SELECT doc_id, kind FROM l SEMI JOIN e USING (doc_id, kind)")
def audit_found(spark, d):
    return quality.found(*_audit(spark, d), ["doc_id", "kind"])


@query(f"WITH {_AUDIT} SELECT doc_id, kind FROM l ANTI JOIN e USING (doc_id, kind)")
def audit_missing(spark, d):
    return quality.missing(*_audit(spark, d), ["doc_id", "kind"])


@query(f"WITH {_AUDIT} SELECT doc_id, kind FROM e ANTI JOIN l USING (doc_id, kind)")
def audit_extras(spark, d):
    return quality.extras(*_audit(spark, d), ["doc_id", "kind"])


@query(f"WITH {_AUDIT} SELECT kind, count(*) AS n FROM (SELECT doc_id, kind FROM l ANTI JOIN e USING (doc_id, kind)) GROUP BY kind")
def missing_by_type(spark, d):
    return quality.missing_by(quality.missing(*_audit(spark, d), ["doc_id", "kind"]), "kind")


@query(f"""WITH {_AUDIT} SELECT (SELECT count(*) FROM l) AS labelled, (SELECT count(*) FROM e) AS extracted, (SELECT count(*) FROM l SEMI JOIN e USING (doc_id, kind)) AS found,
  (SELECT count(*) FROM l ANTI JOIN e USING (doc_id, kind)) AS missing, (SELECT count(*) FROM e ANTI JOIN l USING (doc_id, kind)) AS extra, (SELECT count(*) FROM l SEMI JOIN e USING (doc_id, kind)) / (SELECT count(*) FROM l) AS coverage""")
def audit_summary(spark, d):
    return quality.audit_summary(*_audit(spark, d), ["doc_id", "kind"])


@query("SELECT doc_id, 'GSE' || doc_id AS item FROM labels")
def variant_hit(spark, d):
    """Labels spelled E-GEOD-n are found among extracted GSEn."""
    rows = table(spark, d, "labels").select("doc_id", F.concat(F.lit("E-GEOD-"), "doc_id").alias("item"))
    known = table(spark, d, "documents").select("doc_id", F.concat(F.lit("gse "), "doc_id").alias("item"))
    hits = quality.variant_hits(rows, known, "doc_id", "item").where("variant_hit")
    return hits.select("doc_id", F.regexp_replace("item", "E-GEOD-", "GSE").alias("item"))


@query("SELECT count(*) AS candidates, count(quality) AS covered, count(quality) / count(*) AS coverage, count(quality) / count(*) < 0.9 AS alert FROM documents LEFT JOIN labels USING (doc_id)")
def coverage_kpi(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return quality.coverage(rows, F.col("quality").isNotNull())


@query("""SELECT count(*) AS documents, count(*) FILTER (length(text) > 1000) AS has_methods, count(*) FILTER (text LIKE '%.%') AS has_results, count(*) FILTER (length(text) > 1000 AND text LIKE '%.%') AS complete,
  count(*) FILTER (length(text) > 1000 AND text LIKE '%.%') / count(*) AS success_rate, count(*) FILTER (length(text) > 1000 AND text LIKE '%.%') / count(*) >= 0.9 AS passed FROM documents""")
def corpus_validation(spark, d):
    return quality.corpus_validation(table(spark, d, "documents"), {"methods": F.length("text") > 1000, "results": F.contains("text", F.lit("."))})


@query("SELECT round(sum(total), 3) AS total, round(avg(total), 3) AS mean, max_by(event_type, total) AS longest, min_by(event_type, total) AS shortest FROM (SELECT event_type, sum(value) AS total FROM events GROUP BY event_type)")
def step_summary(spark, d):
    steps = table(spark, d, "events").groupBy("event_type").agg(F.sum("value").alias("total"))
    out = quality.step_summary(steps, "event_type", "total")
    return out.withColumns({"total": F.round("total", 3), "mean": F.round("mean", 3)})


@query("SELECT o_custkey, max_by(o_orderkey, o_orderkey) AS o_orderkey, max_by(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey")
def last_duplicate_wins(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return quality.distinct_last(rows.withColumn("k", F.col("o_orderkey")), "o_custkey", "k").select("o_custkey", "o_orderkey", "o_orderstatus")


# --- joins and sets ------------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_mktsegment, count(o_orderkey) AS n_orders, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment")
def orders_customer_left(spark, d):
    orders = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("total"))
    joined = table(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", "c_mktsegment", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"))


@query("SELECT count(DISTINCT c_custkey) AS parents FROM customer JOIN orders ON o_custkey = c_custkey")
def parent_child_distinct(spark, d):
    children = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(children, "c_custkey", "left_semi").agg(F.countDistinct("c_custkey").alias("parents"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O')")
def resume_anti_join(spark, d):
    lines = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return quality.resume(table(spark, d, "orders").select("o_orderkey"), lines.where("l_returnflag = 'R'"), lines.where("l_linestatus = 'O'"), "o_orderkey")


@query("SELECT count(*) AS orphans FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def orphan_check(spark, d):
    return sinks.orphans(table(spark, d, "orders"), table(spark, d, "customer"), "o_custkey", "c_custkey").agg(F.count("*").alias("orphans"))


@query("(SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer) EXCEPT (SELECT s_nationkey FROM supplier INTERSECT SELECT n_nationkey FROM nation WHERE n_regionkey = 0)")
def set_operations(spark, d):
    s, c = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")), table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    n = table(spark, d, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("k"))
    return s.union(c).distinct().subtract(s.intersect(n))


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 100")
def bounded_subset(spark, d):
    """A sample that reruns give again: the 100 documents with the least hashes."""
    return table(spark, d, "documents").select("doc_id").orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(100)


@query("SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY ALL")
def json_extract(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_events(spark, d):
    out = landing.windowed_counts(table(spark, d, "events"), "ts", "event_type", "value")
    return out.withColumn("total", F.round("total", 4))


# --- upserts -------------------------------------------------------------------------------------------------


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", F.lit("old").alias("created_at"))
    return c.where("c_acctbal > 0"), c.where("c_acctbal > 5000 OR c_acctbal <= 0").withColumns({"c_acctbal": F.lit(-1.0), "created_at": F.lit("new")})


_VERSIONS = """c AS (SELECT c_custkey, c_name, c_acctbal, 'old' AS created_at FROM customer), t AS (SELECT * FROM c WHERE c_acctbal > 0), s AS (SELECT c_custkey, c_name, -1.0::DOUBLE AS c_acctbal, 'new' AS created_at FROM c WHERE c_acctbal > 5000 OR c_acctbal <= 0)"""


@query(f"WITH {_VERSIONS} SELECT * FROM t ANTI JOIN s USING (c_custkey) UNION ALL SELECT * FROM s")
def upsert_replace(spark, d):
    return sinks.replaced(*_versions(spark, d), ["c_custkey"])


@query(f"WITH {_VERSIONS} SELECT * FROM t ANTI JOIN s USING (c_custkey) UNION ALL SELECT s.c_custkey, s.c_name, s.c_acctbal, coalesce(t.created_at, s.created_at) FROM s LEFT JOIN t USING (c_custkey)")
def upsert_keep_created(spark, d):
    return sinks.updated(*_versions(spark, d), ["c_custkey"])


@query(f"WITH {_VERSIONS} SELECT t.c_custkey, t.c_name, coalesce(s.c_acctbal, t.c_acctbal) AS c_acctbal, coalesce(s.created_at, t.created_at) AS created_at FROM t LEFT JOIN s USING (c_custkey)")
def keyed_update(spark, d):
    return sinks.patched(*_versions(spark, d), ["c_custkey"])


@query("SELECT p_partkey, p_type FROM part WHERE p_type NOT LIKE 'S_%'")
def delete_like(spark, d):
    return sinks.without_like(table(spark, d, "part").select("p_partkey", "p_type"), "p_type", "S_%")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def delete_keys(spark, d):
    doomed = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return sinks.without_keys(table(spark, d, "part").select("p_partkey"), doomed, ["p_partkey"])


# --- features ------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, unnest(['p_size', 'p_retailprice', 'p_none']) AS feature_name, unnest([p_size::DOUBLE, p_retailprice::DOUBLE, NULL]) AS feature_value FROM part""")
def eav_unpivot(spark, d):
    return features.to_long(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", F.lit(None).cast("double").alias("p_none")), ["p_partkey"])


_KINDS = ["click", "view", "purchase", "signup", "error"]


def _long_events(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("feature_name")).agg(F.round(F.sum("value"), 4).alias("feature_value"))
    return rows


@query(f"SELECT user_id, {', '.join(f'round(sum(value) FILTER (event_type = {k!r}), 4) AS {k}' for k in _KINDS)} FROM events GROUP BY user_id")
def eav_pivot(spark, d):
    return features.to_wide(_long_events(spark, d), ["user_id"], _KINDS)


@query(f"""SELECT u.user_id, u.dataset_type, {', '.join(f'coalesce(round(sum(value) FILTER (event_type = {k!r}), 4), 0) AS {k}' for k in _KINDS)}, CASE WHEN u.dataset_type = 'Primary' THEN 1 ELSE 0 END AS target
  FROM (SELECT DISTINCT user_id, CASE WHEN user_id % 2 = 0 THEN 'Primary' ELSE 'Secondary' END AS dataset_type FROM events) u JOIN events e ON e.user_id = u.user_id GROUP BY ALL""")
def training_table(spark, d):
    base = table(spark, d, "events").select("user_id", F.when(F.col("user_id") % 2 == 0, "Primary").otherwise("Secondary").alias("dataset_type")).distinct()
    return features.training_table(base, _long_events(spark, d), ["user_id"], _KINDS)


@query("SELECT round(var_samp(p_size), 4) AS p_size, round(var_samp(p_retailprice), 4) AS p_retailprice, 0.0::DOUBLE AS one FROM part")
def zero_variance(spark, d):
    rows = table(spark, d, "part").withColumn("one", F.lit(1.0))
    return features.variances(rows, ["p_size", "p_retailprice", "one"]).select(F.round("p_size", 4).alias("p_size"), F.round("p_retailprice", 4).alias("p_retailprice"), "one")


@query("SELECT 'p_size' AS feature, round(corr(p_size, p_retailprice), 6) AS r FROM part UNION ALL SELECT 'p_partkey', round(corr(p_partkey, p_retailprice), 6) FROM part")
def feature_correlation(spark, d):
    return features.pearson(table(spark, d, "part"), ["p_size", "p_partkey"], "p_retailprice").select("feature", F.round("r", 6).alias("r"))


@query("""WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b FROM part)
SELECT 'p_size' AS feature, round(corr(a::DOUBLE, b::DOUBLE), 6) AS r FROM r""")
def spearman(spark, d):
    return features.spearman(table(spark, d, "part"), ["p_size"], "p_retailprice").withColumn("r", F.round("r", 6))


@query("SELECT quality, count(*) AS n, (SELECT count(*) FROM labels) / (2.0::DOUBLE * count(*)) AS weight FROM labels GROUP BY quality")
def class_weights(spark, d):
    return features.class_weights(table(spark, d, "labels"), "quality")


_SCORED = "(SELECT quality, round((doc_id * 7919 % 1000) / 2000.0::DOUBLE + quality * 0.3::DOUBLE, 4) AS score FROM labels)"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select("quality", F.round((F.col("doc_id") * 7919 % 1000) / 2000.0 + F.col("quality") * F.lit(0.3), 4).alias("score"))


@query(f"""WITH b AS (SELECT score AS threshold, sum(quality) AS pos, count(*) AS n FROM {_SCORED} GROUP BY score),
c AS (SELECT threshold, sum(pos) OVER (ORDER BY threshold DESC)::DOUBLE AS tp, sum(n) OVER (ORDER BY threshold DESC)::DOUBLE AS m, sum(pos) OVER ()::DOUBLE AS a FROM b)
SELECT threshold, round(tp / m, 9) AS precision, round(tp / a, 9) AS recall, round(coalesce(1.25 * (tp / m) * (tp / a) / nullif(0.25 * (tp / m) + tp / a, 0), 0), 9) AS f FROM c""")
def pr_curve_f05(spark, d):
    out = features.precision_recall(_scored(spark, d), "quality", "score")
    return out.select("threshold", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f")])


@query(f"""WITH m AS (SELECT count(*) FILTER (quality = 1 AND score >= 0.4) AS tp, count(*) FILTER (quality = 0 AND score >= 0.4) AS fp, count(*) FILTER (quality = 1 AND score < 0.4) AS fn, count(*) FILTER (quality = 0 AND score < 0.4) AS tn FROM {_SCORED})
SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, (tp + tn) / (tp + fp + fn + tn) AS accuracy FROM m""")
def classification_metrics(spark, d):
    rows = _scored(spark, d).withColumn("predicted", (F.col("score") >= 0.4).cast("int"))
    return features.classification_metrics(rows, "quality", "predicted")


@query("SELECT p_partkey, coalesce(v, (SELECT median(p_size) FROM part WHERE p_partkey % 7 <> 0))::DOUBLE AS v FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN p_size::DOUBLE END AS v FROM part)")
def impute_median(spark, d):
    from ..operators import models

    rows = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 != 0, F.col("p_size").cast("double")).alias("v"))
    return models.impute(rows, ["v"])


@query()
def cluster_pca(spark, d):
    from ..operators import models

    wide = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    out = models.cluster_components(wide, {"a": ["p_size", "p_retailprice"], "b": ["p_size"]})
    return out.select("p_partkey", F.round("LEIDEN_1", 4).alias("LEIDEN_1"), F.round("LEIDEN_2", 4).alias("LEIDEN_2"))


@query()
def rf_metrics(spark, d):
    """A forest on vectors and labels of documents, judged on hold-out groups."""
    from ..operators import models

    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    rows = docs.select(
        "source", F.col("quality").alias("target"), F.length("text").cast("double").alias("n_chars"), (F.regexp_count("text", F.lit("[.]")) / F.greatest(F.length("text"), F.lit(1))).alias("points"),
        (F.regexp_count("text", F.lit("[%&$#*!|]")) / F.greatest(F.length("text"), F.lit(1))).alias("marks"))
    train, held = models.split_by_group(rows, "source")
    model = models.fit(train, ["n_chars", "points", "marks"], numTrees=20)
    return features.classification_metrics(model.transform(held).withColumn("prediction", F.col("prediction").cast("int")), "target", "prediction")
