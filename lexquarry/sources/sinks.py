"""Writers. Tables are folders of versions: an upsert reads the last version, writes the next and then moves the pointer, so a
reader never sees half a table and a lost job loses nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def replaced(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """target with the rows of source in place of those of equal key; of equal keys in source one stays."""
    return target.join(source.select(*keys), keys, "left_anti").unionByName(source.dropDuplicates(keys), allowMissingColumns=True)


def updated(target: DataFrame, source: DataFrame, keys: list[str], keep: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """As replaced(), but columns in `keep` stay as they were in target."""
    t, s = target.alias("t"), source.dropDuplicates(keys).alias("s")
    on = [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys]
    joined = t.join(s.withColumn("_new", F.lit(True)).alias("s"), on, "full")

    def column(c: str) -> Column:
        if c not in source.columns:
            return F.col(f"t.{c}")
        if c in keep or c in keys:
            return F.coalesce(F.col(f"t.{c}"), F.col(f"s.{c}"))
        return F.when(F.col("s._new"), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}"))

    return joined.select(*[column(c).alias(c) for c in target.columns])


def patched(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """target with source's columns where they are not null; rows only in source are not added, children of target are not touched."""
    given = [c for c in source.columns if c not in keys]
    s = source.dropDuplicates(keys).select(*keys, *[F.col(c).alias(f"_new_{c}") for c in given])
    joined = target.join(s, keys, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in given else F.col(c) for c in target.columns])


def without_like(target: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose column does not match a LIKE pattern ('_' stands for any character); nulls stay."""
    return target.where(~F.coalesce(F.col(column).like(pattern), F.lit(False)))


def without_keys(target: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    return target.join(doomed.select(*keys).distinct(), keys, "left_anti")


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children without a parent: the check in place of a foreign key."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


class Versioned:
    """A table in a folder: parquet versions beside a one-row pointer table."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def read(self) -> DataFrame:
        if not self._exists(f"{self.path}/pointer"):
            return self.spark.createDataFrame([], self.schema)
        last = self.spark.read.parquet(f"{self.path}/pointer").agg(F.max_by("version", "at")).first()[0]
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{last}")

    def write(self, df: DataFrame, partition_by: list[str] = (), most_rows: int = 0) -> None:
        version = uuid.uuid4().hex
        writer = df.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        if most_rows:
            writer = writer.option("maxRecordsPerFile", most_rows)
        writer.parquet(f"{self.path}/{version}")
        row = self.spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("at"))
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/pointer")

    def upsert(self, source: DataFrame, keys: list[str]) -> None:
        self.write(replaced(self.read(), source, keys))


def export(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    if kind == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    elif kind in ("parquet", "json", "orc"):
        getattr(writer, kind)(path)
    else:
        raise ValueError(f"unknown kind {kind}")


def migrate(spark: SparkSession, documents: DataFrame, citations: DataFrame, folder: str, schemas: dict[str, T.StructType]) -> DataFrame:
    """Both tables written, then one row that verifies them: counts, and citations whose document is there."""
    for name, df in (("documents", documents), ("citations", citations)):
        lacking = {f.name: F.lit(None).cast(f.dataType) for f in schemas[name] if f.name not in df.columns}
        Versioned(spark, f"{folder}/{name}", schemas[name]).write(df.withColumns(lacking) if lacking else df)
    d, c = (Versioned(spark, f"{folder}/{n}", schemas[n]).read() for n in ("documents", "citations"))
    linked = c.join(d.select(F.col("doi").alias("document_id")), "document_id", "left_semi").agg(F.countDistinct("document_id").alias("linked_documents"))
    return d.agg(F.count("*").alias("documents")).crossJoin(F.broadcast(c.agg(F.count("*").alias("citations")))).crossJoin(F.broadcast(linked))  # one row each


def register_model(models: DataFrame, path_content: DataFrame, best_f1: float) -> DataFrame:
    """models with a row for a model file (path, content), keyed by the sha256 of its content."""
    row = path_content.select(F.sha2("content", 256).alias("model_hash"), F.current_timestamp().alias("trained_at"), F.lit(best_f1).alias("best_f1"), "path")
    return replaced(models, row, ["model_hash"])
