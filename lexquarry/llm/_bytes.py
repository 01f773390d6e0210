"""Whole batches of texts as one array of bytes, so that numpy works on all of them at once."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

_rng = np.random.default_rng(20_240_607)
#: A random number for each byte value, and an odd base with its inverse modulo 2**64, for hashes of any span.
_OF_BYTE = _rng.integers(1, 2**63, 256, dtype="u8") * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def join(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as UTF-8, each followed by a newline, and where each starts (one more: the end)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    starts = np.zeros(len(raw) + 1, "i8")
    np.cumsum([len(r) + 1 for r in raw], out=starts[1:])
    return np.frombuffer(b"".join(x for r in raw for x in (r, b"\n")), "u1"), starts


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of unsigned 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, "u8")
    p[:1] = 1
    return np.multiply.accumulate(p)


def prefix_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """sums and inverse powers with which spans() hashes any spans of data."""
    sums = np.zeros(len(data) + 1, "u8")
    np.cumsum(_OF_BYTE[data] * _powers(_BASE, len(data)), out=sums[1:])
    return sums, _powers(_INVERSE, len(data) + 1)


def spans(hashes: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for arrays of starts and ends; equal spans have equal hashes."""
    sums, back = hashes
    return mixed((sums[end] - sums[start]) * back[start])


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of anything but space and \\t \\n \\v \\f \\r."""
    inside = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    return edges[::2], edges[1::2]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z."""
    return np.where((data >= 65) & (data <= 90), data | 32, data).astype("u1")
