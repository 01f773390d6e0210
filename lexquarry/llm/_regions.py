"""Regions (groups of vertices to compare) once some of their vertices are linked already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize


def members() -> Column:
    """A number that regions of the same vertices share."""
    return F.sum(F.xxhash64("vertex").cast("decimal(38,0)"))


def apart(rows: DataFrame, linked: DataFrame, cap: int) -> DataFrame:
    """rows: (region, n, vertex, ...), n rows a region; linked: (id, component). Returns rows with component and block
    such that every two vertices of a region that are in different components meet in a block of about `cap` rows at most.

    A region of one component is dropped. One of more than `cap` rows is dealt in blocks: vertices outside of its largest component
    meet each other in pairs of blocks, and those in it, which need not meet again, block by block."""
    columns = [c for c in rows.columns if c != "n"]
    known = rows.join(linked.hint("merge"), F.col("vertex") == F.col("id"), "left")
    known = materialize(known.select(*columns, F.coalesce("component", "vertex").alias("component")), "contracted")
    sizes = known.groupBy("region", "component").agg(F.count("*").alias("c"))
    open_ = sizes.groupBy("region").agg(F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("n")).where("n > top.c")
    open_ = open_.select(F.col("region").alias("_r"), F.col("top.component").alias("main"), F.col("top.c").alias("held"), "n")
    met = known.join(materialize(open_, "open"), F.col("region") == F.col("_r")).withColumn("inner", F.col("component") == F.col("main"))
    half = max(1, cap // 2)
    met = met.withColumns({"s": F.ceil(F.col("held") / half).cast("int"), "a": F.ceil((F.col("n") - F.col("held")) / half).cast("int")})
    met = met.withColumn("own", F.pmod(F.xxhash64("vertex"), F.when(F.col("inner"), F.col("s")).otherwise(F.col("a"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    name = lambda kind, x, y: F.concat_ws("-", F.lit(kind), x, y)
    of_inner = F.transform(upto("a"), lambda j: name("in", F.col("own"), j))
    of_outer = F.concat(F.transform(upto("s"), lambda j: name("in", j, F.col("own"))), F.transform(upto("a"), lambda j: name("out", F.least("own", j), F.greatest("own", j))))
    blocks = F.when(F.col("n") <= cap, F.array(F.lit("all"))).when(F.col("inner"), of_inner).otherwise(of_outer)
    return met.select(*columns, "component", F.explode(blocks).alias("block"))
