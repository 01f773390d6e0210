"""Session defaults and the two ways of naming tables that every module shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that the engine relies on; none of them sizes the job for one machine.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build(master: str | None = None, app: str = "lexquarry", **conf: str) -> SparkSession:
    """A session with DEFAULTS; keyword settings use '__' for '.', e.g. spark__ui__enabled='false'."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def scratch(spark: SparkSession) -> str:
    """This application's part of the shared folder spark.checkpoint.dir; a folder of this machine serves a local master where it is unset."""
    if not (d := spark.conf.get("spark.checkpoint.dir", None)):
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = f"file://{tempfile.mkdtemp(prefix='lexquarry-')}"
        spark.conf.set("spark.checkpoint.dir", d)
    return f"{d.rstrip('/')}/lexquarry-{spark.sparkContext.applicationId}/tables"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: its rows keep their partitions' numbers, and lineage is cut."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; lazily read, so filters and columns reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
