"""Mixing sources to target weights by hash-threshold histograms.

Every source gets a target number of words. A document's place in its source is a hash of its id and text. Sums of
words by (source, hash bucket) show in which bucket a source's budget ends; only that bucket is summed again
by finer buckets, LEVELS times, until the threshold is a single hash value. A row is then taken by comparing
its hash with its source's threshold: nothing is sorted and no rows of a source meet in one task.

Rows alike in id, text and source are told apart by their number among such rows, which is part of the hash. Only
rows whose id comes more than once are numbered: within each partition of the written rows, the partitions'
counts giving where each begins; so a group of a third of all rows is numbered by all tasks together.

Defined results: null text has size 0; null source is a source of its own, last in order; rows with equal
or no doc_id are documents of their own, of rows alike in id, text and source any may be taken, the same number at every run;
a source of size 0 has target 0; very long texts count whole; an empty table gives an empty table. Columns other than the
three named ones are not read by plan() and are kept by apply(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import WORD, broadcast_if_small, materialize, table, text_or_empty

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
#: Hash bits by level; LEVELS levels give hashes of 36 bits.
BITS, LEVELS = 12, 3


def word_count(text: str | Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def place(doc_id: Column, text_md5: Column, nth: Column) -> Column:
    """The first 36 bits of the md5 of the id as text, the text's md5 and the row's number among its like; the same in any engine."""
    key = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), text_md5, nth.cast("string"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 9), 16, 10).cast("long")


def placed(docs: DataFrame, *others: Column) -> DataFrame:
    """doc_id, source, place and the other columns of each row."""
    text_md5 = F.md5(text_or_empty("text").cast("binary"))
    ids = docs.groupBy(F.col("doc_id").alias("_twice")).agg(F.count("*").alias("_c")).where("_c > 1").select("_twice")
    twice = materialize(ids, "twice")
    one = place(F.col("doc_id"), text_md5, F.lit(1)).alias("place")
    if not twice.limit(1).count():
        return docs.select("doc_id", "source", one, *others)
    same = F.col("doc_id").eqNullSafe(F.col("_twice"))
    small = broadcast_if_small(twice)
    again = docs.join(small, same, "left_semi").select("doc_id", "source", text_md5.alias("_text"), F.struct(*others).alias("_others"))
    again = materialize(again.withColumn("_part", F.spark_partition_id()), "again")  # written, so that partitions keep their numbers
    key = ["doc_id", "source", "_text"]
    own = W.partitionBy(*key, "_part").orderBy(F.lit(1))
    counts = again.groupBy(*key, "_part").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(W.partitionBy(*key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    first = counts.withColumn("_before", F.coalesce(before, F.lit(0))).select(*[F.col(k).alias("_" + k) for k in key], F.col("_part").alias("_p"), "_before")
    on = [F.col(k).eqNullSafe(F.col("_" + k)) for k in key] + [F.col("_part") == F.col("_p")]
    numbered = again.withColumn("_nth", F.row_number().over(own)).join(first, on)
    numbered = numbered.select("doc_id", "source", place(F.col("doc_id"), F.col("_text"), F.col("_nth") + F.col("_before")).alias("place"), "_others.*")
    return docs.join(small, same, "left_anti").select("doc_id", "source", one, *others).unionByName(numbered)


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size) -> also target: a share of all words by weight, at most max_repeat times source_size,
    the excess going to the others by weight. Sorted by max_repeat * size / weight, the capped sources come
    first, so one cumulative pass over the sources (not the documents) settles all rounds of resharing."""
    everything = W.partitionBy()
    cap = F.lit(max_repeat) * F.col("source_size")
    ordered = W.partitionBy().orderBy(F.col("source").asc_nulls_last())
    rise = W.partitionBy().orderBy(cap / F.col("weight"), "rank")
    before = rise.rowsBetween(W.unboundedPreceding, -1)
    level = lambda: (F.col("left_words") * F.col("weight")).cast("double") / F.col("left_weight").cast("double")
    return (
        by_source.withColumn("rank", F.row_number().over(ordered))
        .withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
        .withColumn("left_words", F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("capped", cap.cast("double") <= level())
        .withColumn("first_free", F.min(F.when(~F.col("capped"), F.struct(cap / F.col("weight"), "rank", "left_words", "left_weight"))).over(everything))
        .withColumn(
            "target",
            F.when(F.col("capped") | F.col("first_free").isNull(), cap.cast("double")).otherwise(
                (F.col("first_free.left_words") * F.col("weight")).cast("double") / F.col("first_free.left_weight").cast("double")
            ),
        )
        .select("source", "source_size", "target")
    )


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """rows: (source, size, place), cheap to read more than once. Returns a row for each source: source,
    source_size, target, whole (times that every document is taken) and threshold (documents whose place is
    not above it are taken once more)."""
    state = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeat)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = state.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    state = materialize(state.select("*", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("base"), F.col("source_size").alias("held")), "mix")
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        s = broadcast_if_small(state.select(F.col("source").alias("s"), F.col("prefix").alias("p")))
        inside = rows.join(s, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("place", shift + BITS) == F.col("p")))
        hist = inside.groupBy(F.col("source").alias("s"), F.shiftright("place", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        hist = hist.withColumn("upto", F.sum("words").over(W.partitionBy("s").orderBy("bucket")))
        joined = state.join(hist, F.col("source").eqNullSafe(F.col("s")), "left")
        at = (F.col("base") + F.col("upto") > F.col("budget")) & (F.col("base") + F.col("upto") - F.col("words") <= F.col("budget"))
        edge = F.min(F.when(at, F.struct("bucket", (F.col("base") + F.col("upto") - F.col("words")).alias("base"), F.col("words").alias("held"))))
        keys = ["source", "source_size", "target", "whole", "budget"]
        state = joined.groupBy(*keys).agg(edge.alias("edge"))  # no edge: the budget holds the whole source
        state = state.select(*keys, F.col("edge.bucket").alias("prefix"), F.col("edge.base").alias("base"), F.col("edge.held").alias("held"))
        state = materialize(state, "mix")
    nearer = F.col("base") + F.col("held") - F.col("budget") < F.col("budget") - F.col("base")
    threshold = F.when(F.col("prefix").isNull(), 1 << (BITS * LEVELS)).when(nearer, F.col("prefix")).otherwise(F.col("prefix") - 1)
    return state.select("source", "source_size", "target", "whole", threshold.cast("long").alias("threshold"))


def sizes(docs: DataFrame) -> DataFrame:
    """The narrow columns that plan() reads again and again, written once."""
    return materialize(placed(docs, word_count("text").alias("size")), "sizes")


def _decided(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    t = broadcast_if_small(thresholds.withColumnRenamed("source", "_s"))
    return rows.join(t, F.col("source").eqNullSafe(F.col("_s"))).withColumn("times", F.col("whole") + (F.col("place") <= F.col("threshold")).cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, taken (words, repeats counted)."""
    rows = sizes(docs)
    out = _decided(rows, materialize(plan(rows, weights, max_repeat), "mix"))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def apply(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The mixed documents themselves: each row as many times as it is taken, its columns unchanged."""
    thresholds = materialize(plan(sizes(docs), weights, max_repeat), "mix")
    out = _decided(placed(docs, F.struct(*docs.columns).alias("_row")).select("source", "place", "_row"), thresholds)
    out = out.withColumn("_n", F.explode(F.sequence(F.lit(1), F.greatest("times", F.lit(1)).cast("int")))).where("times > 0")
    return out.select("_row.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) || ':'
           || row_number() OVER (PARTITION BY doc_id, text, source)), 1, 9))::BIGINT AS place
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source ASC NULLS LAST) AS rk
  FROM sized GROUP BY source),
wt AS (SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS w FROM src),
cum AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER o, 0))::BIGINT AS lw,
         (sum(w) OVER () - coalesce(sum(w) OVER o, 0))::BIGINT AS lwt
  FROM wt WINDOW o AS (ORDER BY (3 * source_size)::DOUBLE / w::DOUBLE, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cap AS (SELECT *, (3 * source_size)::DOUBLE <= (lw * w)::DOUBLE / lwt::DOUBLE AS capped FROM cum),
free AS (SELECT lw AS flw, lwt AS flwt FROM cap WHERE NOT capped ORDER BY (3 * source_size)::DOUBLE / w::DOUBLE, rk LIMIT 1),
tgt AS (
  SELECT source, source_size,
         CASE WHEN capped OR flw IS NULL THEN (3 * source_size)::DOUBLE ELSE (flw * w)::DOUBLE / flwt::DOUBLE END AS target
  FROM cap LEFT JOIN free ON true),
bud AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM tgt),
places AS (SELECT source, place, sum(size)::BIGINT AS held FROM sized GROUP BY source, place),
ends AS (
  SELECT p.source, p.place, p.held, sum(p.held) OVER (PARTITION BY p.source ORDER BY p.place)::BIGINT AS upto,
         b.target - b.whole * b.source_size AS budget
  FROM places p JOIN bud b ON p.source IS NOT DISTINCT FROM b.source),
pick AS (
  SELECT source, place, upto <= budget OR (upto - held <= budget AND upto - budget < budget - (upto - held)) AS more FROM ends)
SELECT s.doc_id, s.size, b.source_size, b.target, (s.size * (b.whole + CASE WHEN k.more THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized s JOIN bud b ON s.source IS NOT DISTINCT FROM b.source
JOIN pick k ON s.source IS NOT DISTINCT FROM k.source AND s.place = k.place
"""
