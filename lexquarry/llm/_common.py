"""What the corpus operators share: tables, written intermediate results, size-checked broadcasts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A broadcast side may have this many rows at most; beyond it joins are shuffled.
BROADCAST_ROWS = 50_000

#: Words of the contracts: runs of anything but space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's part of the cluster's shared folder, spark.checkpoint.dir. Where that is unset, a folder of this machine
    serves a local master (tests); on a cluster executors would not see it, so that is an error."""
    if not (d := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = f"file://{tempfile.mkdtemp(prefix='lexquarry-')}"
        spark.conf.set("spark.checkpoint.dir", d)
    return f"{d.rstrip('/')}/lexquarry-{spark.sparkContext.applicationId}"


def forget(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder; DataFrames that read it can't be used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if df (cheap to count: a written table) has few rows, else df, joined by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def small_batches(spark: SparkSession, size: int = 16 << 20) -> None:
    """Batches for Python workers hold `size` bytes at most (or one row), where the session doesn't say otherwise. By rows alone a batch
    of 10,000 long texts has no bound, and it lies in the JVM's direct memory and in the worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(size))


def frugal(f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """f for mapInPandas; at a task's end its worker, which Spark keeps for others, gives freed memory back to the system: that of
    Arrow's pool and that of the C library."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return run


def text_or_empty(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
