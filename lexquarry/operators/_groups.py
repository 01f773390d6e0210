"""Order-dependent work by group in mapInPandas: rows are dealt and sorted by key, and groups are cut from batches as plain lists, since
a call by group with frames costs more than the work in it. Groups must be bounded in size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def by_group(df: DataFrame, key: str, order: list[str], f: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """f gets a group's rows (tuples in the order of df's columns, sorted by `order`) and returns rows of the schema."""
    at, names = df.columns.index(key), [c.strip().split(" ")[0] for c in _fields(schema)]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for row in batch.astype(object).where(batch.notna(), None).itertuples(index=False, name=None):
                if group and row[at] != group[0][at]:
                    out += f(group)
                    group = []
                group.append(row)
            if out:  # Arrow can't tell arrays in a frame without rows
                yield pd.DataFrame(out, columns=names)
        if group and (out := f(group)):
            yield pd.DataFrame(out, columns=names)

    return df.repartition(parts, key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def _fields(schema: str) -> list[str]:
    """Top-level fields of a DDL schema."""
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out
