"""Datasets from chunks, and features for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import approx_tokens, mask_ids
from ..session import written


def build_datasets(chunks: DataFrame, ids: list[str], mask: str | None = None, separator: str = " ", mask_each: bool = False) -> DataFrame:
    """Chunks (ids..., ordinal, text, token_count) -> one text for each dataset, with its lengths and tokens. mask names an
    array column of ids to hide; mask_each hides them chunk by chunk, and tokens are then those of the masked text."""
    text = mask_ids("text", F.col(mask)) if mask and mask_each else F.col("text")
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", text.alias("text"))))
    joined = F.array_join(F.transform(ordered, lambda x: x["text"]), separator)
    out = chunks.groupBy(*ids).agg(joined.alias("raw"), F.sum("token_count").cast("long").alias("total_tokens"), (F.sum("token_count") / F.count("*")).alias("avg_tokens_per_chunk"), *([F.first(mask).alias("_ids")] if mask else []))
    masked = mask_ids("raw", F.col("_ids")) if mask and not mask_each else F.col("raw")
    out = out.withColumn("text", masked)
    tokens = approx_tokens("text").cast("long") if mask_each else F.col("total_tokens")
    return out.select(*ids, "text", tokens.alias("total_tokens"), "avg_tokens_per_chunk", F.length("raw").alias("total_char_length"), F.length("text").alias("clean_text_length"))


def page_stats(documents: DataFrame, key: str, pages: str) -> DataFrame:
    """Characters and tokens summed over an array of pages."""
    add = lambda f: F.aggregate(F.col(pages), F.lit(0).cast("long"), lambda s, p: s + f(p))
    return documents.select(key, F.size(pages).alias("n_pages"), add(lambda p: F.length(p).cast("long")).alias("total_char_length"), add(lambda p: approx_tokens(p).cast("long")).alias("total_tokens"))


def chunking_results(chunks: DataFrame, before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """For each document: chunks, tokens, their mean, and retention in percent of the citations counted before (null where there were none)."""
    stats = chunks.groupBy(key).agg(F.count("*").alias("total_chunks"), F.sum("token_count").cast("long").alias("total_tokens"), (F.sum("token_count") / F.count("*")).alias("avg_tokens"))
    n = lambda df, name: df.groupBy(key).agg(F.sum("n").alias(name))
    joined = stats.join(n(before, "pre"), key, "left").join(n(after, "post"), key, "left")
    return joined.select(key, "total_chunks", "total_tokens", "avg_tokens", (F.try_divide(F.coalesce("post", F.lit(0)), F.col("pre")) * 100).alias("retention"))


def corpus_retention(chunks: DataFrame, citations: DataFrame, cited: str = "citation_entities", citation: str = "citation") -> DataFrame:
    """One row: distinct ids in chunks over distinct citations."""
    kept = chunks.select(F.explode(cited).alias("c")).agg(F.countDistinct("c").alias("retained"))
    return kept.crossJoin(F.broadcast(citations.agg(F.countDistinct(citation).alias("expected")))).withColumn("retention", F.try_divide("retained", "expected"))  # one row each


def to_long(wide: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each feature of each record, nulls included."""
    rest = [c for c in wide.columns if c not in keys]
    return wide.select(*keys, *[F.col(c).cast("double") for c in rest]).unpivot(keys, rest, "feature_name", "feature_value")


def to_wide(long: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Features as columns; names are stated, so the schema does not hang on the data. Of repeated keys the least value counts."""
    return long.groupBy(*keys).pivot("feature_name", names).agg(F.min("feature_value"))


def training_table(datasets: DataFrame, long: DataFrame, keys: list[str], names: list[str], kind: str = "dataset_type", positive: str = "PRIMARY") -> DataFrame:
    wide = to_wide(long, keys, names)
    return datasets.join(wide, keys, "left").na.fill(0.0, names).withColumn("target", F.when(F.upper(kind) == positive, 1).otherwise(0))


def variances(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.agg(*[F.var_samp(c).alias(c) for c in columns])


def varied(rows: DataFrame, columns: list[str]) -> list[str]:
    """Columns whose sample variance is not 0; one pass, one row back."""
    first = variances(rows, columns).first()
    return [c for c in columns if first[c] not in (None, 0.0)]


def numeric_columns(rows: DataFrame) -> list[str]:
    return [c for c, t in rows.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")]


def prefixed_columns(rows: DataFrame, prefixes: tuple[str, ...], also: list[str]) -> list[str]:
    return [c for c in rows.columns if c in also or c.startswith(prefixes)]


def neighbourhood(neighbours: DataFrame, norms: DataFrame) -> DataFrame:
    """neighbours: id, neighbour, similarity; norms: id, norm -> mean, max and population variance of similarity and of neighbours' norms."""
    joined = neighbours.join(norms.select(F.col("id").alias("neighbour"), "norm"), "neighbour")
    out = [f(c).alias(f"neighborhood_{name}_{c}") for c in ("similarity", "norm") for name, f in (("mean", F.avg), ("max", F.max), ("var", F.var_pop))]
    return joined.groupBy("id").agg(*out)


def similarity_threshold(similarities: DataFrame, method: str = "degree_target", degree: int = 15, nodes: int | None = None, column: str = "similarity") -> DataFrame:
    """One row, threshold: the similarity that gives nodes a mean degree, the 90th percentile, or the upper side of the widest gap.
    Similarities of 1 or more (a row with itself) do not count. No row is ranked on one task: degree_target reads the
    n-th greatest from a top-n, the gap method from gaps within and between ranges."""
    s = similarities.where(F.col(column) < 1.0).select(F.col(column).alias("s"))
    if method == "percentile_90":
        return s.agg(F.percentile("s", F.lit(0.9)).alias("threshold"))
    if method == "degree_target":
        wanted = degree * nodes // 2
        return s.orderBy(F.desc("s")).limit(wanted + 1).agg(F.min("s").alias("threshold"))
    if method == "elbow_method":
        from pyspark.sql import Window as W

        bucket = F.floor(F.col("s") * 1000)
        within = s.withColumn("b", bucket).withColumn("next", F.lead("s").over(W.partitionBy("b").orderBy(F.desc("s"))))
        edges = within.groupBy("b").agg(F.min("s").alias("low"), F.max("s").alias("high"))  # at most 2001 rows
        between = edges.select(F.col("low").alias("s"), F.lead("high").over(W.partitionBy().orderBy(F.desc("b"))).alias("next"))
        gaps = within.select("s", "next").union(between).where("next is not null")
        return gaps.agg(F.max_by("s", F.struct(F.col("s") - F.col("next"), "s")).alias("threshold"))
    raise ValueError(f"unknown method {method}")


def _beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz)."""
    from math import exp, lgamma, log

    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    least, c = 1e-300, 1.0
    d = 1 / ((1 - (a + b) * x / (a + 1)) or least)
    total = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + step * d) or least)
            c = (1 + step / c) or least
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def correlation_p(r: float | None, n: int) -> float | None:
    """The two-sided p of a correlation of n pairs, from Student's t; for ranks the usual approximation."""
    if r is None or n < 3:
        return None
    return 0.0 if abs(r) >= 1 else _beta_share((n - 2) / 2, 0.5, 1 - r * r)


def pearson(rows: DataFrame, columns: list[str], target: str) -> DataFrame:
    """feature, r, p: correlation of each column with the target, one pass; pairs with a null do not count."""
    both = lambda c: F.col(c).isNotNull() & F.col(target).isNotNull()
    first = rows.agg(*[F.count(F.when(both(c), 1)).alias(f"n_{c}") for c in columns], *[F.corr(c, target).alias(c) for c in columns]).first()
    return rows.sparkSession.createDataFrame([(c, first[c], correlation_p(first[c], first[f"n_{c}"])) for c in columns], "feature string, r double, p double")


def running(counted: DataFrame, key: str, sums: list[str]) -> DataFrame:
    """counted (a row for each value of key) with upto_<c>: the sum of c over rows up to its own, ascending. Values are summed up by
    range: only a row for each partition is looked at across ranges."""
    from pyspark.sql import Window as W

    parts = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(counted.repartitionByRange(parts, key).withColumn("_b", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    earlier = W.partitionBy().orderBy("_b").rowsBetween(W.unboundedPreceding, -1)  # a row a partition
    before = totals.select(F.col("_b").alias("_p"), *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_before_{c}") for c in sums])
    within = W.partitionBy("_b").orderBy(key).rowsBetween(W.unboundedPreceding, 0)
    rows = ranged.select("*", *[F.sum(c).over(within).alias(f"_w_{c}") for c in sums]).join(before, F.col("_b") == F.col("_p"))
    return rows.select(*counted.columns, *[(F.col(f"_w_{c}") + F.col(f"_before_{c}")).alias(f"upto_{c}") for c in sums])


def average_ranks(rows: DataFrame, column: str) -> DataFrame:
    """value -> average rank, by counts of distinct values."""
    counted = rows.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n")).where("v is not null")
    return running(counted, "v", ["n"]).select("v", (F.col("upto_n") - (F.col("n") - 1) / 2.0).alias("rank"))


def spearman_p(rows: DataFrame, columns: list[str], target: str) -> DataFrame:
    """feature, r, p of spearman()."""
    n = rows.agg(*[F.count(F.when(F.col(c).isNotNull() & F.col(target).isNotNull(), 1)).alias(c) for c in columns]).first()
    found = [(x["feature"], x["r"], correlation_p(x["r"], n[x["feature"]])) for x in spearman(rows, columns, target).collect()]  # a row a column
    return rows.sparkSession.createDataFrame(found, "feature string, r double, p double")


def spearman(rows: DataFrame, columns: list[str], target: str) -> DataFrame:
    """feature, r: correlation of average ranks."""
    out = None
    t = average_ranks(rows, target)
    for c in columns:
        ranked = rows.select(c, target).join(average_ranks(rows, c).select(F.col("v").alias(c), F.col("rank").alias("_a")), c).join(t.select(F.col("v").alias(target), F.col("rank").alias("_b")), target)
        one = ranked.agg(F.lit(c).alias("feature"), F.corr("_a", "_b").alias("r"))
        out = one if out is None else out.union(one)
    return out


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """label, n, weight = all / (classes * n)."""
    from pyspark.sql import Window as W

    counted = rows.groupBy(label).agg(F.count("*").alias("n"))
    return counted.withColumn("weight", F.sum("n").over(W.partitionBy()) / (F.count("*").over(W.partitionBy()) * F.col("n")))  # a row a class


def classification_metrics(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall, f1, accuracy."""
    n = lambda a, b: F.count(F.when((F.col(label) == a) & (F.col(predicted) == b), 1))
    out = rows.agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return out.select("*", p.alias("precision"), r.alias("recall"), F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"), F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("accuracy"))


def precision_recall(rows: DataFrame, label: str, score: str, digits: int | None = None, beta: float = 0.5) -> DataFrame:
    """threshold, precision, recall, f for each distinct score (rounded, if digits are given): counts by score are cumulated, not rows."""
    threshold = F.col(score) if digits is None else F.round(score, digits)
    by = rows.groupBy(threshold.alias("threshold")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n"))
    by = written(by, "scores")
    whole = by.agg(F.sum("pos").alias("all"), F.sum("n").alias("rows"))  # one row
    out = running(by, "threshold", ["pos", "n"]).crossJoin(F.broadcast(whole))
    tp, marked = F.col("all") - F.col("upto_pos") + F.col("pos"), F.col("rows") - F.col("upto_n") + F.col("n")
    p, r = tp / marked, F.try_divide(tp, F.col("all"))
    return out.select("threshold", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide((1 + beta * beta) * p * r, beta * beta * p + r), F.lit(0.0)).alias("f"))


def best_threshold(rows: DataFrame, label: str, score: str, digits: int | None = None, beta: float = 0.5) -> DataFrame:
    curve = precision_recall(rows, label, score, digits, beta)
    return curve.agg(F.max_by("threshold", F.struct("f", "threshold")).alias("threshold"), F.max("f").alias("f"))


def target(kind: Column) -> Column:
    return F.when(F.upper(kind) == "PRIMARY", 1).otherwise(0)
