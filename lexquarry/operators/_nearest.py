"""The k best partners of each vector of a block, exactly, while others pass by in tiles of bounded size.

Products in single precision only choose candidates: what may still be among the k best, by the bound of their error, is scored in doubles.
A pair's score is summed up component by component, so it depends on the pair alone, and equal vectors have equal scores."""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa

#: Rows of the block and of those passing by that are multiplied at once; pairs that are scored at once.
ROWS, COLUMNS, PAIRS = 1024, 2048, 1 << 19


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(-1, keepdims=True)), 1e-300)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype("f8", copy=False).reshape(len(column), -1)


def _squares(columns: np.ndarray) -> np.ndarray:
    total = np.zeros(columns.shape[1])
    for c in columns:
        total += c * c
    return total


class Best:
    """ids, x: the block. see() takes the vectors that pass by; rows() gives index in the block, id and score, k for each at most, ties to
    the lesser id. metric: cosine (0 for vectors of no length), or 1 - squared distance. others: a row's own id is no partner of it."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, metric: str = "cosine", others: bool = False):
        self.ids, self.k, self.others, self.cosine = ids, k, others, metric == "cosine"
        self.columns = np.ascontiguousarray(x.T)
        self.squares = _squares(self.columns)
        self.approximate = unit(x).astype("f4") if self.cosine else x
        self.low = np.full(len(x), -np.inf, self.approximate.dtype)  # a score below it is not among the k best
        self.score, self.best = np.full((len(x), k), -np.inf), None
        self.room = np.empty(ROWS * COLUMNS, self.approximate.dtype)

    def again(self) -> Best:
        """The same block without partners yet; what does not change is shared."""
        new = copy.copy(self)
        new.low, new.score, new.best = np.full_like(self.low, -np.inf), np.full_like(self.score, -np.inf), None
        return new

    def see(self, ids: np.ndarray, y: np.ndarray) -> None:
        if self.best is None:
            self.best = np.zeros((len(self.low), self.k), ids.dtype)
        for at in range(0, len(ids), COLUMNS):
            self._tile(ids[at : at + COLUMNS], y[at : at + COLUMNS])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j = np.nonzero(self.score > -np.inf)
        return i, self.best[i, j] if self.best is not None else i, self.score[i, j]

    def _tile(self, ids: np.ndarray, y: np.ndarray) -> None:
        columns = np.ascontiguousarray(y.T)
        squares = _squares(columns)
        near = unit(y).astype("f4") if self.cosine else y
        if self.cosine:
            slack = (len(columns) + 16) * 2.0**-23
        else:
            slack = (len(columns) + 16) * 2.0**-50 * (1 + self.squares.max(initial=0) + squares.max(initial=0))
        order = np.argsort(ids, kind="stable") if self.others else None
        near = near.T
        for at in range(0, len(self.low), ROWS):
            part = slice(at, at + ROWS)
            left = self.approximate[part]
            s = np.matmul(left, near, out=self.room[: len(left) * len(ids)].reshape(len(left), len(ids)))
            if not self.cosine:
                s = 1 - (self.squares[part][:, None] + squares[None] - 2 * s)
            if self.others:
                own, there = self.ids[part], ids[order]
                first, last = np.searchsorted(there, own, "left"), np.searchsorted(there, own, "right")
                for i in np.nonzero(first < last)[0]:
                    s[i, order[first[i] : last[i]]] = -np.inf
            low = self.low[part]
            new = np.nonzero(low == -np.inf)[0]
            if len(new) and len(ids) > self.k:  # the tile's own k best bound what can be of use
                low[new] = np.partition(s[new], -self.k, axis=1)[:, -self.k] - 2 * slack
            some = np.flatnonzero(s.max(axis=1, initial=-np.inf) >= low)
            if len(some):
                i, j = np.divmod(np.flatnonzero(s[some] >= low[some, None]), len(ids))
                there = s[some[i], j] > -np.inf
                self._keep(some[i[there]] + at, j[there], ids, columns, squares, slack)

    def _scores(self, i: np.ndarray, j: np.ndarray, columns: np.ndarray, squares: np.ndarray) -> np.ndarray:
        out = []
        for at in range(0, len(i), PAIRS):
            a, b = i[at : at + PAIRS], j[at : at + PAIRS]
            total = np.zeros(len(a))
            for x, y in zip(self.columns, columns):
                d = x[a] * y[b] if self.cosine else (x[a] - y[b]) ** 2
                total += d
            if self.cosine:
                scale = np.sqrt(self.squares[a] * squares[b])
                total = np.clip(np.divide(total, scale, out=np.zeros(len(a)), where=scale > 0), -1.0, 1.0)
            out.append(total if self.cosine else 1 - total)
        return np.concatenate(out) if out else np.zeros(0)

    def _keep(self, i: np.ndarray, j: np.ndarray, ids: np.ndarray, columns: np.ndarray, squares: np.ndarray, slack: float) -> None:
        score = self._scores(i, j, columns, squares)
        rows = np.unique(i)
        held = np.nonzero(self.score[rows] > -np.inf)
        row = np.concatenate([rows[held[0]], i])
        score = np.concatenate([self.score[rows][held], score])
        other = np.concatenate([self.best[rows][held], ids[j]])
        order = np.lexsort((other, -score, row))
        row, score, other = row[order], score[order], other[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        row, score, other, place = (c[place < self.k] for c in (row, score, other, place))
        self.score[row, place], self.best[row, place] = score, other
        self.low[rows] = np.maximum(self.low[rows], self.score[rows, -1] - slack)
