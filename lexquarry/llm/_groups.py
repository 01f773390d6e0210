"""Groups of rows in mapInPandas: rows dealt and sorted by a key arrive in batches; a group is passed on when it is whole."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ._common import frugal


def whole_groups(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of whole groups, several at a time; only a group that batches divide is carried over."""
    carried: pd.DataFrame | None = None
    for batch in batches:
        if carried is not None:
            batch = pd.concat([carried, batch], ignore_index=True)
        if not len(batch):
            continue
        last = np.ones(len(batch), bool)
        for k in key:
            end = batch[k].iloc[-1]
            last &= (batch[k].isna() if pd.isna(end) else batch[k] == end).to_numpy()  # null is a group
        cut = int(np.argmax(last))
        carried = batch.iloc[cut:].reset_index(drop=True)
        if cut:
            yield batch.iloc[:cut]
    if carried is not None:
        yield carried


def bounds(frame: pd.DataFrame, key: list[str]) -> np.ndarray:
    """Where each group of a sorted frame begins; one more: its length."""
    new = np.zeros(len(frame), bool)
    for k in key:
        v = frame[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    new[:1] = True
    return np.r_[np.flatnonzero(new), len(frame)]


def map_groups(df: DataFrame, key: list[str], f: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """f gets frames of whole groups and their bounds. Groups must be bounded in size."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, key):
            yield f(frame, bounds(frame, key))

    return df.repartition(parts, *key).sortWithinPartitions(*key).mapInPandas(frugal(run), schema)


def number_of(ids: np.ndarray) -> int:
    """A 64-bit number that groups of the same ids (ascending) share."""
    return int.from_bytes(hashlib.blake2b(ids.tobytes(), digest_size=8).digest(), "big", signed=True)


class Union:
    """Union-find over 0..n-1; the root of a set is its least member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True
