"""Word shingles of whole texts as sorted sets of 64-bit hashes, and their minhash signatures."""

from __future__ import annotations

import numpy as np

from . import _bytes

_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[str | None], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct `width`-word shingles of each text, ascending within a text, and where each text's
    begin (one more: the end). A text of fewer words has its whole sequence as its only shingle; without words, none.
    Words are runs of anything but space and \\t \\n \\v \\f \\r; A-Z count as a-z."""
    data, starts = _bytes.join(texts)
    data = _bytes.lowered(data)
    ws, we = _bytes.words(data)
    h = _bytes.spans(_bytes.prefix_hashes(data), ws, we)
    first = np.searchsorted(ws, starts)  # of each text's words; one more
    n = np.diff(first)
    rolled = np.zeros(max(0, len(h) - width + 1), "u8")
    for k in range(width):
        rolled = _bytes.mixed(rolled * _STEP + h[k : k + len(rolled)])
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    text_of = np.repeat(np.arange(len(texts)), count)
    begin = np.r_[0, np.cumsum(count)]
    at = np.arange(begin[-1]) - begin[:-1][text_of] + first[:-1][text_of]
    values = np.zeros(len(at), "u8")
    full = (n >= width)[text_of]
    values[full] = rolled[at[full]]
    for i in np.flatnonzero((n > 0) & (n < width)):
        v = np.array([n[i]], "u8")
        for x in h[first[i] : first[i + 1]]:
            v = _bytes.mixed(v * _STEP + x)
        values[begin[i]] = v[0]
    order = np.lexsort((values, text_of))
    values = values[order]
    new = np.r_[True, (values[1:] != values[:-1]) | (text_of[1:] != text_of[:-1])][: len(values)]
    return values[new], np.r_[0, np.cumsum(np.bincount(text_of[new], minlength=len(texts)))].astype("i8")


def signatures(values: np.ndarray, begin: np.ndarray, size: int) -> np.ndarray:
    """Minhash signatures, a row of `size` unsigned 32-bit numbers for each set; those of empty sets are all ones."""
    out = np.full((len(begin) - 1, size), 0xFFFFFFFF, "u4")
    some = np.flatnonzero(np.diff(begin))
    if not len(some):
        return out
    draw = np.random.default_rng(7)
    a, b = draw.integers(0, 2**31, (2, size), dtype="u4") * np.uint32(2) + np.uint32(1)
    x = (values >> np.uint64(32)).astype("u4")
    y = np.empty_like(x)
    for k in range(size):
        np.multiply(x, a[k], out=y)
        y += b[k]
        y ^= y >> np.uint32(15)
        out[some, k] = np.minimum.reduceat(y * np.uint32(0x2C1B3C6D), begin[:-1][some])
    return out


def set_keys(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Two 64-bit numbers for each set, equal for equal sets."""
    sums = np.zeros((2, len(values) + 1), "u8")
    np.cumsum(_bytes.mixed(values), out=sums[0, 1:])
    np.cumsum(_bytes.mixed(values ^ _STEP), out=sums[1, 1:])
    return (sums[:, begin[1:]] - sums[:, begin[:-1]]).view("i8").T


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two ascending sets."""
    return int((np.take(b, np.searchsorted(b, a), mode="clip") == a).sum()) if len(a) and len(b) else 0
