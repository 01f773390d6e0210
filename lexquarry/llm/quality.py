"""Document quality from a linear-chain conditional random field over lines.

A line has numeric features (shares of letters, capitals, symbols, repeated words, ...); its node potential
reads its own features and those of the lines before and after. Two states, good and bad, are linked by learned
transitions. Forward-backward gives each line's probability of being good; the mean of these, weighted by line
length, is a document's raw quality, and a logistic curve fitted on the training documents makes it a score.

Labels mark documents, not lines: lines start with their document's label, and lines of bad documents that a first
fit finds good are taken as good for the second. The fit reads at most SAMPLE labelled documents, chosen by a
hash of their ids, with whole texts; scoring covers all rows and reads nothing but the text.

Defined results: null and empty text are one empty line and get a score as any other; rows with equal or null
doc_id are scored one by one (null is not held out); an empty table gives no rows; without training rows of both
labels every score is the share of label 1 (0.5 if there is none); a null quality is no label; very long texts are
scored whole; equal texts have equal scores; scored() and accepted() keep all columns, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _bytes
from ._common import frugal, materialize, table, text_or_empty

#: Labelled documents that the fit reads at most.
SAMPLE = 2500
HELD_OUT_MOD, HELD_OUT = 5, 0
THRESHOLD = 0.3

_CLASS = np.zeros((256, 7), "f4")  # letters, capitals, digits, points, marks, symbols, bars
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = [_b >= 128 or _c.isalpha(), "A" <= _c <= "Z", _c.isdigit(), _c in ".,;:'\"-()?", _c == "!", _b < 128 and not _c.isalnum() and not _c.isspace() and _c not in ".,;:'\"-()?!|", _c == "|"]


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, its length, number of lines of each text)."""
    data, starts = _bytes.join(texts)
    ends = np.flatnonzero(data == 10)
    begins = np.r_[0, ends[:-1] + 1]
    lines = np.searchsorted(begins, starts[1:]) - np.searchsorted(begins, starts[:-1])
    length = (ends - begins).astype("f8")
    counts = np.empty((len(ends), 7))
    for k in range(7):
        sums = np.r_[0, np.cumsum(_CLASS[data, k], dtype="f8")]
        counts[:, k] = sums[ends] - sums[begins]
    ws, we = _bytes.words(data)
    hashes = _bytes.prefix_hashes(_bytes.lowered(data))
    wh = _bytes.spans(hashes, ws, we)
    same = np.r_[False, wh[1:] == wh[:-1]] if len(wh) else np.zeros(0, bool)
    same2 = np.r_[False, False, wh[2:] == wh[:-2]][: len(wh)] if len(wh) > 1 else np.zeros(len(wh), bool)
    line_of = np.searchsorted(ends, ws)
    n_words = np.bincount(line_of, minlength=len(ends)).astype("f8")
    repeated = np.bincount(line_of, same | same2, minlength=len(ends))
    long = np.bincount(line_of, (we - ws) > 14, minlength=len(ends))
    capital = np.bincount(line_of, (data[ws] >= 65) & (data[ws] <= 90), minlength=len(ends))
    noisy = np.bincount(line_of, _CLASS[data[np.maximum(we, 1) - 1], 5] > 0, minlength=len(ends))
    lh = _bytes.spans(hashes, begins, ends)
    doc_of = np.repeat(np.arange(len(texts)), lines)
    order = np.lexsort((lh, doc_of))
    twin = (lh[order][1:] == lh[order][:-1]) & (doc_of[order][1:] == doc_of[order][:-1])
    again = np.zeros(len(ends))
    again[order] = np.r_[False, twin] | np.r_[twin, False]
    chars, many = np.maximum(length, 1), np.maximum(n_words, 1)
    own = np.column_stack([
        counts / chars[:, None], repeated / many, long / many, capital / many, noisy / many, n_words / chars, again * (length > 0), length == 0,
        np.log1p(length) / 8, counts[:, 1] > 0.5 * chars, counts[:, 5] > 0.04 * chars, counts[:, 6] > 0.02 * chars, repeated > 0.5 * many, counts[:, 3] / many])
    first, last = np.zeros(len(ends), bool), np.zeros(len(ends), bool)
    at = np.cumsum(lines)
    first[np.r_[0, at[:-1]]], last[at - 1] = True, True
    before = np.where(first[:, None], 0, np.roll(own, 1, 0))
    after = np.where(last[:, None], 0, np.roll(own, -1, 0))
    return np.column_stack([own, before, after, first, last, np.ones(len(ends))]), np.maximum(length, 1), lines


def marginals(node: np.ndarray, lines: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """node: log-odds of good for each line; edge: 2 x 2 log potentials. Returns the probability of good for each
    line and the expected counts of the transitions. All documents advance together, line by line."""
    order = np.argsort(-lines, kind="stable")
    start = np.r_[0, np.cumsum(lines)][:-1][order]
    longest = int(lines.max(initial=0))
    active = np.searchsorted(-lines[order], -np.arange(longest), "left")  # documents with more than t lines
    step = np.exp(edge - edge.max())
    odds = np.clip(node, -30, 30)
    psi = np.column_stack([1 / (1 + np.exp(odds)), 1 / (1 + np.exp(-odds))])
    alpha, beta, pairs = np.empty((len(node), 2)), np.ones((len(node), 2)), np.zeros((2, 2))
    for t in range(longest):
        at = start[: active[t]] + t
        a = psi[at] if t == 0 else (alpha[at - 1] @ step) * psi[at]
        alpha[at] = a / a.sum(1, keepdims=True)
    for t in range(longest - 2, -1, -1):
        at = start[: active[t + 1]] + t
        b = (beta[at + 1] * psi[at + 1]) @ step.T
        beta[at] = b / b.sum(1, keepdims=True)
        p = alpha[at][:, :, None] * step * (beta[at + 1] * psi[at + 1])[:, None, :]
        pairs += (p / p.sum((1, 2), keepdims=True)).sum(0)
    good = alpha * beta
    return good[:, 1] / good.sum(1), pairs


def _pair_counts(y: np.ndarray, lines: np.ndarray) -> np.ndarray:
    inner = np.ones(len(y), bool)
    inner[np.r_[0, np.cumsum(lines)[:-1]]] = False
    at = np.flatnonzero(inner)
    a, b, out = y[at - 1], y[at], np.empty((2, 2))
    out[1, 1], out[1, 0], out[0, 1], out[0, 0] = (a * b).sum(), (a * (1 - b)).sum(), ((1 - a) * b).sum(), ((1 - a) * (1 - b)).sum()
    return out


def _fit_chain(x: np.ndarray, y: np.ndarray, weight: np.ndarray, lines: np.ndarray, rounds: int, w=None, edge=None):
    """Adam on the conditional likelihood; weight: of each line."""
    w, edge = (np.zeros(x.shape[1]), np.zeros((2, 2))) if w is None else (w, edge)
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(edge), np.zeros_like(edge)]
    seen, total = _pair_counts(y, lines), max(1.0, weight.sum())
    for k in range(1, rounds + 1):
        p, pairs = marginals(x @ w, lines, edge)
        grads = [x.T @ ((y - p) * weight) / total - 1e-4 * w, (seen - pairs) / max(1, len(y)) - 1e-3 * edge]
        for i, (param, g) in enumerate(zip((w, edge), grads)):
            m, v = moments[2 * i], moments[2 * i + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            param += 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
    return w, edge


def _doc_mean(p: np.ndarray, length: np.ndarray, lines: np.ndarray) -> np.ndarray:
    at = np.r_[0, np.cumsum(lines)[:-1]]
    return np.add.reduceat(p * length, at) / np.add.reduceat(length, at)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(texts: list[str | None], quality: np.ndarray, rounds: int = 120) -> dict:
    """Labelled documents -> a model for score(); see the module's text."""
    label = np.asarray(quality, "f8")
    prior = float(label.mean()) if len(label) else 0.5
    if len(np.unique(label)) < 2:
        return {"prior": prior}
    x, length, lines = features(texts)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    mean[-1], scale[-1] = 0, 1
    x = (x - mean) / scale
    y = np.repeat(label, lines)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w, edge = _fit_chain(x, y, weight, lines, rounds)
    p, _ = marginals(x @ w, lines, edge)
    y = np.where((y == 0) & (p > 0.8), 1.0, y)
    w, edge = _fit_chain(x, y, weight, lines, rounds, w, edge)
    q = _doc_mean(marginals(x @ w, lines, edge)[0], length, lines)
    z, c = np.column_stack([q, np.ones(len(q))]), np.zeros(2)
    for _ in range(50):  # Newton steps of a logistic curve, held down a little
        s = _sigmoid(z @ c)
        c += np.linalg.solve((z * (s * (1 - s))[:, None]).T @ z + 0.05 * np.eye(2), z.T @ (label - s) - 0.05 * c)
    return {"prior": prior, "mean": mean, "scale": scale, "w": w, "edge": edge, "curve": c}


def score(texts: list[str | None], model: dict) -> np.ndarray:
    if "w" not in model or not texts:
        return np.full(len(texts), model["prior"])
    x, length, lines = features(texts)
    p, _ = marginals((x - model["mean"]) / model["scale"] @ model["w"], lines, model["edge"])
    q = _doc_mean(p, length, lines)
    return _sigmoid(np.column_stack([q, np.ones(len(q))]) @ model["curve"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Fit on at most `sample` labelled documents that are not held out. Of an id's labels the least counts, of its rows the one with
    the least text, so that every run fits the same rows."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    known = labels.where("quality is not null and doc_id is not null").select("doc_id", "quality").where(crc % HELD_OUT_MOD != HELD_OUT)
    single = known.groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("quality"))
    chosen = materialize(single.orderBy(F.md5(F.col("_id").cast("string").cast("binary")), "_id").limit(sample), "chosen")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))  # `sample` rows at most
    rows = rows.groupBy("doc_id", "quality").agg(F.min(text_or_empty("text")).alias("text")).collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]))
    return fit([r["text"] for r in rows], np.array([r["quality"] for r in rows]))


def _chunks(texts: list, most: int = 2_000_000) -> Iterator[slice]:
    """Slices of texts with about that many characters, so that arrays of features stay small."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= most:
            yield slice(begin, i + 1)
            begin, size = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def scored(docs: DataFrame, model: dict, column: str = "score") -> DataFrame:
    """docs with a column of scores; other columns are kept as they are."""
    rows = docs.select(F.col("text").cast("string").alias("_text"), F.struct(*docs.columns).alias("_row"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["_text"].tolist()
            got = [score(texts[s], model) for s in _chunks(texts)]
            batch[column] = np.concatenate(got) if got else np.zeros(0)
            yield batch.drop(columns="_text")

    schema = T.StructType([*rows.drop("_text").schema.fields, T.StructField(column, T.DoubleType())])
    return rows.mapInPandas(frugal(run), schema)


def classify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            got = [score(texts[s], model) for s in _chunks(texts)]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": np.concatenate(got) if got else np.zeros(0)})

    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    out = narrow.mapInPandas(frugal(run), "doc_id long, score double")
    return out.select("doc_id", F.coalesce(crc % HELD_OUT_MOD == HELD_OUT, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, with their own columns."""
    narrow = scored(docs, train(docs, labels))
    return narrow.where(F.col("score") >= THRESHOLD).select("_row.*")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(docs, table(spark, sf_dir, "labels")))
