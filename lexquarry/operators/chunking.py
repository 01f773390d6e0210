"""Documents into linked, overlapping chunks of words, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import approx_tokens, words

#: Words in a window and shared by neighbours; tokens above which a chunk is cut again.
WINDOW, OVERLAP, MOST_TOKENS = 300, 30, 1500


def windows(word_array: Column, window: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """Array of chunk texts. A window starts every window - overlap words; windows of fewer than 2 * overlap words, which can only
    come last, are appended to the one before. No words, no chunk."""
    if not 0 <= overlap < window:
        raise ValueError("overlap must be at least 0 and less than window")
    step, n = window - overlap, F.size(word_array)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    long_enough = lambda s: (s == 0) | (F.least(F.lit(window), n - s) >= 2 * overlap)
    text = lambda s: F.array_join(F.slice(word_array, s + 1, F.lit(window)), " ")
    kept, short = F.filter(starts, long_enough), F.filter(starts, lambda s: ~long_enough(s))
    tail = F.array_join(F.transform(short, lambda s: F.concat(F.lit(" "), text(s))), "")
    return F.transform(kept, lambda s, i: F.when(i == F.size(kept) - 1, F.concat(text(s), tail)).otherwise(text(s)))


def chunk(documents: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """key, ordinal (from 0), chunk_id, chunk_text, token_count for each chunk."""
    split = documents.select(key, words(F.coalesce(F.col(text), F.lit(""))).alias("_w"))
    rows = split.select(key, F.posexplode(windows(F.col("_w"), window, overlap)).alias("ordinal", "chunk_text"))
    return rows.select(key, "ordinal", F.concat_ws("_", key, "ordinal").alias("chunk_id"), "chunk_text", approx_tokens("chunk_text").alias("token_count"))


def link(rows: DataFrame, by: str = "doc_id", order: str = "ordinal", id_col: str = "chunk_id") -> DataFrame:
    """Rows with the ids before and after them."""
    w = W.partitionBy(by).orderBy(order)
    return rows.withColumns({"previous_chunk_id": F.lag(id_col).over(w), "next_chunk_id": F.lead(id_col).over(w)})


def resplit(chunks: DataFrame, most: int = MOST_TOKENS, window: int = WINDOW, overlap: int = OVERLAP, key: str = "doc_id") -> DataFrame:
    """Chunks with those of more than `most` tokens cut again in place; ordinals are counted anew."""
    parts = F.when(F.col("token_count") > most, windows(words("chunk_text"), window, overlap)).otherwise(F.array("chunk_text"))
    rows = chunks.select(key, "ordinal", F.posexplode(parts).alias("_part", "chunk_text"))
    nth = (F.row_number().over(W.partitionBy(key).orderBy("ordinal", "_part")) - 1).cast("int")
    return rows.withColumn("n", nth).select(key, F.col("n").alias("ordinal"), F.concat_ws("_", key, "n").alias("chunk_id"), "chunk_text", approx_tokens("chunk_text").alias("token_count"))


def characters(documents: DataFrame, size: int, overlap: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Chunks of `size` characters, neighbours sharing `overlap`."""
    n = F.length(text)
    starts = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return documents.select(key, F.posexplode(F.transform(starts, lambda s: F.substr(F.col(text), s, F.lit(size)))).alias("ordinal", "chunk_text"))


def sections(documents: DataFrame, most: int = 2000, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Splits at the coarsest separator that gives pieces of at most `most` characters: blank lines, lines, sentences,
    and, where a sentence is longer, runs of whole words."""
    def finer(pieces: Column, sep: str) -> Column:
        cut = lambda x: F.filter(F.split(x, sep), lambda y: F.trim(y) != "")
        return F.flatten(F.transform(pieces, lambda x: F.when(F.length(x) > most, cut(x)).otherwise(F.array(x))))

    fine = F.array(F.col(text))
    for sep in (r"\n\s*\n", r"\n", r"(?<=[.!?])\s+"):
        fine = finer(fine, sep)
    runs = F.lit(rf"(?s)\S.{{0,{most - 1}}}(?=\s|$)|\S{{1,{most}}}")
    fine = F.flatten(F.transform(fine, lambda x: F.when(F.length(x) > most, F.regexp_extract_all(x, runs, F.lit(0))).otherwise(F.array(x))))
    return documents.where(F.col(text).isNotNull()).select(key, F.posexplode(fine).alias("ordinal", "chunk_text"))


def document_stats(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks, tokens and their mean for each document."""
    return chunks.groupBy(key).agg(
        F.count("*").alias("total_chunks"), F.sum("token_count").cast("long").alias("total_tokens"),
        (F.sum("token_count") / F.count("*")).alias("avg_tokens"))


def run_summary(results: DataFrame) -> DataFrame:
    """One row over document results: totals, whether all succeeded, mean retention, errors."""
    return results.agg(
        F.count("*").alias("documents"), F.sum("total_chunks").alias("total_chunks"), F.sum("total_tokens").alias("total_tokens"),
        F.bool_and("success").alias("success"), F.avg("retention").alias("avg_retention"),
        F.array_join(F.array_sort(F.collect_list("error")), "; ").alias("errors"))


def merge_results(parts: DataFrame, key: str, lists: list[str], scalars: list[str]) -> DataFrame:
    """Batch results into one for each key: lists joined in order of `part`, scalars the first that is not null."""
    ordered = F.array_sort(F.collect_list(F.struct("part", *lists)))

    def joined(name: str) -> Column:
        return F.flatten(F.transform(ordered, lambda x: x[name])).alias(name)

    return parts.groupBy(key).agg(*[joined(c) for c in lists], *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("part"))).alias(c) for c in scalars])


def adjusted_window(longest_sentence: Column, buffer: int = 0) -> Column:
    return (F.ceil(longest_sentence / 100) * 100 + buffer).cast("int")
