"""Incremental runs: files that land in a folder are upserted batch by batch, each once, from a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.sinks import Versioned


def upsert_stream(spark: SparkSession, landing: str, target: Versioned, keys: list[str], checkpoint: str, schema: T.StructType | None = None) -> StreamingQuery:
    """Parquet files in landing -> target, available now; call again for files that came since."""
    stream = spark.readStream.schema(schema or target.schema).parquet(landing)
    return stream.writeStream.foreachBatch(lambda df, _: target.upsert(df, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, kind: str, value: str, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by window and kind, with a watermark for late rows; for streams and tables."""
    return (
        events.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), kind)
        .agg(F.count("*").alias("n"), F.sum(value).alias("total"))
        .select(F.col("w.start").alias("window_start"), kind, "n", "total")
    )
