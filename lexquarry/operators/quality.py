"""Counts, checks and audits over tables of documents, labels and citations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalise_id


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: a count for each table. Aggregates of one row each are put side by side."""
    counts = [df.agg(F.count("*").alias(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), counts)  # one row each


def valid_labels(labels: DataFrame, kind: str, id_col: str) -> DataFrame:
    """Rows with a kind and an id, neither 'Missing'; kind in capitals, PRIMARY or SECONDARY only."""
    good = labels.where(F.col(kind).isNotNull() & F.col(id_col).isNotNull() & (F.col(kind) != "Missing") & (F.col(id_col).cast("string") != "Missing"))
    return good.withColumn(kind, F.upper(kind)).where(F.col(kind).isin("PRIMARY", "SECONDARY"))


def label_summary(labels: DataFrame, key: str, kind: str, item: str, kinds: list[str]) -> DataFrame:
    """For each key: rows, distinct kinds (sorted), a flag for each kind, distinct items other than 'Missing'."""
    flags = [F.max((F.col(kind) == k).cast("int")).cast("boolean").alias(f"has_{k.lower()}") for k in kinds]
    return labels.groupBy(key).agg(
        F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("kinds"), *flags,
        F.countDistinct(F.when(F.col(item).cast("string") != "Missing", F.col(item))).alias("items"))


def distribution(rows: DataFrame, kind: str) -> DataFrame:
    """Count and share of each value."""
    counted = rows.groupBy(kind).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))  # as many rows as values


def against_expected(rows: DataFrame, kind: str, expected: dict) -> DataFrame:
    """Actual against expected shares; off by under 5 % is OK, under 10 % a warning."""
    kind_type = rows.schema[kind].dataType
    stated = rows.sparkSession.createDataFrame(list(expected.items()), f"{kind} {kind_type.simpleString()}, expected double")
    joined = stated.join(distribution(rows, kind), kind, "left").na.fill({"n": 0, "share": 0.0})
    off = F.abs(F.col("share") - F.col("expected"))
    return joined.withColumn("status", F.when(off < 0.05, "OK").when(off < 0.10, "WARNING").otherwise("CRITICAL"))


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row: full rows and keys beyond their first occurrence. Distinct counts are pre-aggregated, no rows are gathered."""
    whole = rows.groupBy(*rows.columns).agg(F.count("*").alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))
    keyed = rows.groupBy(*key).agg(F.count("*").alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_keys"))
    return whole.crossJoin(F.broadcast(keyed))  # one row each


def null_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in rows.columns])


def availability(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Presence of each key in either table: status and priority."""
    both = left.select(key, F.lit(True).alias("in_left")).distinct().join(right.select(key, F.lit(True).alias("in_right")).distinct(), key, "full")
    a, b = F.coalesce("in_left", F.lit(False)), F.coalesce("in_right", F.lit(False))
    status = F.when(a & b, "both").when(a, "left_only").when(b, "right_only").otherwise("neither")
    return both.select(key, status.alias("status"), F.when(a & b, 1).when(a, 2).otherwise(3).alias("priority"))


def combinations(rows: DataFrame, key: str, kind: str, kinds: list[str]) -> DataFrame:
    """One row: keys with only one of the kinds, and with several."""
    have = rows.groupBy(key).agg(*[F.max((F.col(kind) == k).cast("int")).alias(k) for k in kinds])
    several = reduce(lambda a, b: a + b, [F.col(k) for k in kinds])
    return have.agg(*[F.sum(((F.col(k) == 1) & (several == 1)).cast("long")).alias(f"only_{k}") for k in kinds], F.sum((several > 1).cast("long")).alias("several"))


def found(labels: DataFrame, extracted: DataFrame, on: list[str]) -> DataFrame:
    return labels.dropDuplicates(on).join(extracted.select(*on).distinct(), on, "left_semi")


def missing(labels: DataFrame, extracted: DataFrame, on: list[str]) -> DataFrame:
    return labels.dropDuplicates(on).join(extracted.select(*on).distinct(), on, "left_anti")


def extras(labels: DataFrame, extracted: DataFrame, on: list[str]) -> DataFrame:
    return missing(extracted, labels, on)


def missing_by(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by)


def audit_summary(labels: DataFrame, extracted: DataFrame, on: list[str]) -> DataFrame:
    """One row: labelled, extracted, found, missing, extra pairs, and the share found."""
    left, right = labels.select(*on).distinct().withColumn("_l", F.lit(1)), extracted.select(*on).distinct().withColumn("_e", F.lit(1))
    both = left.join(right, on, "full")
    n = lambda c: F.count(F.when(c, 1))
    out = both.agg(F.count("_l").alias("labelled"), F.count("_e").alias("extracted"), n(F.col("_l").isNotNull() & F.col("_e").isNotNull()).alias("found"), n(F.col("_e").isNull()).alias("missing"), n(F.col("_l").isNull()).alias("extra"))
    return out.withColumn("coverage", F.try_divide("found", "labelled"))


def variant_hits(missing_labels: DataFrame, extracted: DataFrame, document: str, item: str) -> DataFrame:
    """Missing labels with a flag: whether one of five spellings, normalised, was extracted from the document."""
    raw = F.col(item)
    host = F.regexp_replace(raw, r"(?i)^https?://(?:dx\.)?doi\.org/", "")
    version = F.regexp_replace(host, r"(?i)\.v\d+$", "")
    forms = F.array(raw, host, version, F.regexp_replace(version, r"(?i)/t\d+$", ""), F.when(raw.rlike(r"(?i)^E-GEOD-\d+$"), F.regexp_replace(raw, "(?i)^E-GEOD-", "GSE")))
    spelled = missing_labels.select(document, item, F.explode(F.array_distinct(F.transform(F.filter(forms, lambda f: f.isNotNull()), normalise_id))).alias("norm"))
    known = extracted.select(document, normalise_id(item).alias("norm")).distinct()
    hits = spelled.join(known, [document, "norm"], "left_semi").select(document, item).distinct().withColumn("variant_hit", F.lit(True))
    return missing_labels.join(hits, [document, item], "left").na.fill(False, ["variant_hit"])


def resume(candidates: DataFrame, done: DataFrame, started: DataFrame, key: str) -> DataFrame:
    """Candidates that are neither done nor started."""
    return candidates.join(done.select(key).distinct(), key, "left_anti").join(started.select(key).distinct(), key, "left_anti")


def coverage(rows: DataFrame, covered: Column, alert: float = 0.90) -> DataFrame:
    out = rows.agg(F.count("*").alias("candidates"), F.count(F.when(covered, 1)).alias("covered"))
    share = F.try_divide("covered", "candidates")
    return out.withColumn("coverage", share).withColumn("alert", share < alert)


def pattern_inventory(texts: DataFrame, patterns: dict[str, str], keys: list[str], text: str = "text") -> DataFrame:
    """Occurrences of each pattern in each text, where there are any; the pattern table is a literal array, no join."""
    counts = F.array(*[F.struct(F.lit(k).alias("pattern"), F.regexp_count(text, F.lit(p)).alias("n")) for k, p in patterns.items()])
    return texts.select(*keys, F.explode(counts).alias("_c")).select(*keys, "_c.pattern", "_c.n").where("n > 0")


def step_summary(steps: DataFrame, step: str, seconds: str) -> DataFrame:
    return steps.agg(F.sum(seconds).alias("total"), F.avg(seconds).alias("mean"), F.max_by(step, seconds).alias("longest"), F.min_by(step, seconds).alias("shortest"))


def corpus_validation(documents: DataFrame, flags: dict[str, Column], target: float = 0.9) -> DataFrame:
    """One row: documents, how many have each section, and whether the share with all reaches the target."""
    every = reduce(lambda a, b: a & b, flags.values())
    out = documents.agg(F.count("*").alias("documents"), *[F.count(F.when(c, 1)).alias(f"has_{k}") for k, c in flags.items()], F.count(F.when(every, 1)).alias("complete"))
    return out.withColumn("success_rate", F.try_divide("complete", "documents")).withColumn("passed", F.try_divide("complete", "documents") >= target)


def distinct_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the last by `order`, as a dictionary filled in that order would hold."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("_r")).select(key, "_r.*")
