"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Suffixes are classified as S (smaller than the next suffix) or L. Leftmost S suffixes (LMS) are placed at their
buckets' ends, from which L and then S suffixes are induced bucket by bucket; that sorts the LMS substrings. Their
names form a shorter text whose suffix array (the recursion) orders the LMS suffixes, and a second induction gives the
array. A bucket's suffixes are induced all at once, only runs of one letter take a step each. So a
recursion with more than LETTERS names, whose buckets would be tiny, ranks by doubling instead.
"""

from __future__ import annotations

import numpy as np

LETTERS = 2048


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is S; text ends with a unique least letter."""
    n = len(text)
    edge = np.r_[np.flatnonzero(text[1:] != text[:-1]), n - 1]  # ends of runs of one letter
    smaller = np.r_[text[edge[:-1]] < text[edge[:-1] + 1], True]
    return np.repeat(smaller, np.diff(np.r_[-1, edge]))


def _spread(found: np.ndarray, letters: np.ndarray, at: np.ndarray, out: np.ndarray, step: int) -> None:
    """Put suffixes into their letters' buckets, in order; at: next free place of each bucket."""
    order = np.argsort(letters, kind="stable")
    sorted_letters = letters[order]
    first = np.r_[True, sorted_letters[1:] != sorted_letters[:-1]]
    begin = np.flatnonzero(first)
    size = np.diff(np.r_[begin, len(order)])
    nth = np.arange(len(order)) - np.repeat(begin, size)
    out[at[sorted_letters] + step * nth] = found[order]
    at[sorted_letters[begin]] += step * size


def _induce(text: np.ndarray, is_s: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Suffix array in which LMS suffixes stand in the given order within their buckets."""
    n, letters = len(text), len(sizes)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    out = np.full(n, -1, "i4")
    seeds = np.full(n, -1, "i4")
    tail = ends - 1
    _spread(lms[::-1], text[lms[::-1]], tail.copy(), seeds, -1)
    n_seeds = np.bincount(text[lms], minlength=letters)
    head = begins.copy()
    for c in range(letters):
        if not sizes[c]:
            continue
        done = begins[c]
        while done < head[c]:  # L suffixes, also those that this bucket gives to itself
            part = out[done : head[c]]
            done = head[c]
            before = part[part > 0] - 1
            before = before[~is_s[before]]
            if len(before):
                _spread(before, text[before], head, out, 1)
        if n_seeds[c]:
            before = seeds[ends[c] - n_seeds[c] : ends[c]]
            before = before[before > 0] - 1
            before = before[~is_s[before]]
            if len(before):
                _spread(before, text[before], head, out, 1)
    out[0] = n - 1  # the end, which no suffix induces
    tail = ends - 1
    tail[0] = -1
    for c in range(letters - 1, -1, -1):
        if not sizes[c]:
            continue
        done = ends[c] - 1
        while done > tail[c]:  # S suffixes, also those that this bucket gives to itself
            part = out[tail[c] + 1 : done + 1][::-1]
            done = tail[c]
            before = part[part > 0] - 1
            before = before[is_s[before]]
            if len(before):
                _spread(before, text[before], tail, out, -1)
        part = out[begins[c] : head[c]][::-1]
        before = part[part > 0] - 1
        before = before[is_s[before]]
        if len(before):
            _spread(before, text[before], tail, out, -1)
    return out


def _doubling(names: np.ndarray) -> np.ndarray:
    """Suffix array of a text of many letters, by sorting ranks of ever longer prefixes."""
    n, rank, k = len(names), names.astype("i8"), 1
    while True:
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1 if n > k else 0
        order = np.argsort(key, kind="stable")
        new = np.empty(n, "i8")
        new[order] = np.cumsum(np.r_[0, key[order][1:] != key[order][:-1]])
        if new[order[-1]] == n - 1 or k >= n:
            return order
        rank, k = new, 2 * k


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of data (bytes), in order."""
    return _sorted(data.astype("i4")) if len(data) else np.zeros(0, "i4")


def _sorted(data: np.ndarray) -> np.ndarray:
    """Suffix array of a text of numbers from 0."""
    text = np.r_[data + 1, 0].astype("i4")
    is_s = _types(text)
    sizes = np.bincount(text)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    if len(lms) > 1:
        order = _induce(text, is_s, lms.astype("i4"), sizes)
        marked = np.zeros(len(text), bool)
        marked[lms] = True
        by_substring = order[marked[order]]
        ending = np.full(len(text), len(text) - 1, "i8")  # of each LMS substring
        ending[lms[:-1]] = lms[1:]
        a, b = by_substring[:-1], by_substring[1:]
        length = ending[a] - a
        same = (length == ending[b] - b) & (b != len(text) - 1) & (a != len(text) - 1)
        left, k = np.flatnonzero(same), 0
        while len(left):  # compare neighbours letter by letter, those still equal
            equal = text[a[left] + k] == text[b[left] + k]
            same[left[~equal]] = False
            left = left[equal]
            left = left[length[left] > k]
            k += 1
        name = np.zeros(len(text), "i4")
        name[by_substring] = np.r_[0, np.cumsum(~same)]
        names = name[lms]
        if names.max() + 1 < len(lms):
            names -= names.min()
            lms = lms[_sorted(names) if names.max() < LETTERS else _doubling(names)]
        else:
            lms = by_substring
    return _induce(text, is_s, lms.astype("i4"), sizes)[1:]


def common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place of the suffix array, the length of the prefix common with the place before (0 at the first).
    Computed in text order: where the letters before a suffix and its predecessor agree, the value is that of
    the position before less one; only the others are compared, letter by letter."""
    n = len(data)
    if not n:
        return np.zeros(0, "i4")
    before = np.full(n, -1, "i8")
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    follows = np.zeros(n, bool)
    ok = (at > 0) & (before > 0)
    follows[ok] = data[at[ok] - 1] == data[before[ok] - 1]
    value = np.zeros(n, "i4")
    left, k = np.flatnonzero(~follows & (before >= 0)), 0
    while len(left):
        left = left[np.maximum(left, before[left]) + k < n]
        left = left[data[left + k] == data[before[left] + k]]
        value[left] += 1
        k += 1
    source = np.maximum.accumulate(np.where(follows, -1, at))
    permuted = value[source] - (at - source)
    return np.maximum(permuted, 0)[order].astype("i4")
