"""Language identification with spans of mixed-language text.

The script of a word's letters (Unicode ranges) narrows the candidate languages to those seen with it. Each
word has a log-probability for each candidate, from the whole word if it was seen in training and from its
character trigrams else. Viterbi over the words with a penalty for switching labels spans; the
language with the most letters in its spans is predicted, and its share of letters, tempered by how far ahead it is,
is the score.

The fit reads at most SAMPLE labelled documents a language, chosen by a hash of their ids, with whole texts;
prediction covers all rows and reads nothing but the text. Words are runs of letters, lower-cased.

Defined results: null text or text without a letter is ``und`` with score 0; without any training rows every text
is ``und``; letters of a script that no language was trained on leave all languages as candidates; rows with
equal or null doc_id are labelled one by one (null is not held out); languages with equal letters: the first in
alphabetical order; very long texts are read whole, Viterbi in blocks that join exactly; other columns are not read,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import broadcast_if_small, frugal, materialize, table, text_or_empty

#: Labelled documents of each language that the fit reads at most; every language is fitted.
SAMPLE = 250
HELD_OUT_MOD, HELD_OUT = 3, 1
#: Log-probability that a change of language costs.
SWITCH = 6.0
UNDETERMINED = "und"
REMEMBERED = 400_000

#: First code points of script ranges and the scripts' names, after Unicode's blocks.
SCRIPTS = [
    (0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"),
    (0x900, "devanagari"), (0x980, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"),
    (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han")]
_STARTS = np.array([s for s, _ in SCRIPTS])
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def script(letter: str) -> str:
    return SCRIPTS[max(0, int(np.searchsorted(_STARTS, ord(letter), "right")) - 1)][1]


def words_of(text: str | None) -> list[str]:
    """The runs of letters, lower-cased."""
    low = (text or "").lower()
    if low.isascii():
        return low.translate(_ASCII).split()
    return _WORD.findall(low)


_ASCII = {i: chr(i) if chr(i).isalpha() else " " for i in range(128)}


def _grams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + 3] for i in range(max(1, len(w) - 2))]


def fit(texts: list[str | None], langs: list[str]) -> dict:
    """Labelled texts -> word and trigram log-probabilities, and the languages seen with each script."""
    names = sorted(set(langs))
    at = {n: i for i, n in enumerate(names)}
    n_words, n_grams = [Counter() for _ in names], [Counter() for _ in names]
    scripts: dict[str, Counter] = {}
    for text, lang in zip(texts, langs):
        n_words[at[lang]].update(words_of(text))
    for lang, own in zip(names, n_words):
        for word, n in own.items():
            scripts.setdefault(script(word[0]), Counter())[lang] += n
            for g in _grams(word):
                n_grams[at[lang]][g] += n
    kinds = len(set().union(*n_grams)) + 1 if names else 1
    totals = [sum(c.values()) + 0.5 * kinds for c in n_grams]
    grams = {g: [math.log((c[g] + 0.5) / t) for c, t in zip(n_grams, totals)] for g in set().union(*n_grams)} if names else {}
    sums = [sum(c.values()) or 1 for c in n_words]
    counts = Counter()
    for c in n_words:
        counts.update(c)
    whole = {w: [math.log((c[w] / s * 1e4 + 0.05)) for c, s in zip(n_words, sums)] for w, n in counts.items() if n >= 20}
    seen = {s: sorted(at[x] for x, n in c.items() if n >= max(1, 0.001 * sums[at[x]])) for s, c in scripts.items()}
    return {"names": names, "grams": grams, "unseen": [math.log(0.5 / t) for t in totals], "whole": whole, "scripts": seen}


class Scores(dict):
    """word -> row of a matrix of log-probabilities by language; words come back often."""

    def __init__(self, model: dict):
        self.model, self.rows, self.n = model, np.zeros((1024, len(model["names"]))), 0

    def __missing__(self, word: str) -> int:
        m, low = self.model, -12.0
        if (row := m["whole"].get(word)) is None:
            grams, unseen = m["grams"], m["unseen"]
            row = [sum(x) for x in zip(*[grams.get(g, unseen) for g in _grams(word)])]
        top = max(row)
        row = [max(x - top, low) for x in row]
        if not word.isascii():
            held = m["scripts"].get(script(word[0]))
            if held and len(held) < len(row):  # the script leaves few languages
                row = [x if i in held else -60.0 for i, x in enumerate(row)]
        if self.n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[self.n], self[word] = row, self.n
        self.n += 1
        return self.n - 1

    def forget(self) -> None:
        if self.n > REMEMBERED:
            self.clear()
            self.n = 0


def _advance(scores: np.ndarray, lengths: np.ndarray, init: np.ndarray, switch: float, ends: np.ndarray | None = None) -> np.ndarray:
    """All sequences advance together from init (sequences x ... x languages). Without ends: the best sums at
    their ends; with ends, a language for each sequence: the best path to it, a language for each word."""
    order = np.argsort(-lengths, kind="stable")
    start = np.r_[0, np.cumsum(lengths)][:-1][order]
    longest = int(lengths.max(initial=0))
    active = np.searchsorted(-lengths[order], -np.arange(longest), "left")
    best = init[order]
    shape = (-1, *[1] * (best.ndim - 2), best.shape[-1])
    if ends is not None:
        came, kept, out = np.zeros(len(scores), "i2"), np.ones((len(scores), best.shape[-1]), bool), np.zeros(len(scores), "i2")
    for t in range(longest):
        n = active[t]
        at, b = start[:n] + t, best[:n]
        jump = b.max(-1, keepdims=True) - switch
        if ends is not None:
            came[at], kept[at] = b.argmax(-1), b >= jump
        np.maximum(b, jump, out=b)
        b += scores[at].reshape(shape)
    if ends is None:
        back = np.empty_like(best)
        back[order] = best
        return back
    state = ends[order]
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at, s = start[:n] + t, state[:n]
        out[at] = s
        state[:n] = np.where(kept[at, s], s, came[at])
    return out


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH, block: int = 192) -> np.ndarray:
    """scores: words x languages of many texts one after another. The best language of each word: staying is
    free, a change costs `switch`. Long texts are cut into blocks; a block's best sums from each language before it
    to each at its end join the blocks exactly, so a very long text takes no longer loop than a short one."""
    k = scores.shape[1]
    n_blocks = -(-lengths // block)
    total = int(n_blocks.sum())
    first = np.r_[0, np.cumsum(n_blocks)]
    text_of = np.repeat(np.arange(len(lengths)), n_blocks)
    nth = np.arange(total) - first[text_of]
    size = np.minimum(block, lengths[text_of] - nth * block)
    none = np.full((k, k), -1e30)
    np.fill_diagonal(none, 0)
    sums = _advance(scores, size, np.broadcast_to(none, (total, k, k)).copy(), switch)
    best, came = np.zeros((len(lengths), k)), np.zeros((total, k), "i2")
    for j in range(int(n_blocks.max(initial=0))):
        on = np.flatnonzero(n_blocks > j)
        ways = best[on][:, :, None] + sums[first[on] + j]
        came[first[on] + j] = ways.argmax(1)
        best[on] = ways.max(1)
    state, ends, init = best.argmax(1), np.zeros(total, "i8"), np.full((total, k), -1e30)
    for j in range(int(n_blocks.max(initial=0)) - 1, -1, -1):
        on = np.flatnonzero(n_blocks > j)
        at = first[on] + j
        ends[at] = state[on]
        state[on] = came[at, state[on]]
        init[at, state[on]] = 0
    return _advance(scores, size, init, switch, ends)


def label(texts: list[str | None], scores: Scores, spans: bool = False) -> tuple[list[str], np.ndarray, list]:
    """(language, score, spans) of each text; a span is (first word, words, language)."""
    names = scores.model["names"]
    found = [words_of(t) for t in texts]
    lengths = np.array([len(w) for w in found], "i8")
    if not len(names) or not lengths.sum():
        return [UNDETERMINED] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
    rows = np.fromiter(map(scores.__getitem__, (w for ws in found for w in ws)), "i8", int(lengths.sum()))
    path = viterbi(scores.rows[rows], lengths)
    letters = np.fromiter(map(len, (w for ws in found for w in ws)), "i8", len(rows))
    text_of = np.repeat(np.arange(len(texts)), lengths)
    shares = np.bincount(text_of * len(names) + path, letters, len(texts) * len(names)).reshape(-1, len(names))
    total = shares.sum(1)
    top = shares.argmax(1)
    each = scores.rows[rows]
    lead = np.bincount(text_of, each[np.arange(len(rows)), top[text_of]] - each.mean(1), len(texts))
    sure = 1 - 0.5 * np.exp(-np.maximum(lead, 0))
    out = np.where(total > 0, shares.max(1) / np.maximum(total, 1) * sure, 0.0)
    runs: list = [[] for _ in texts]
    if spans:
        at = np.r_[0, np.cumsum(lengths)]
        for i in range(len(texts)):
            own = path[at[i] : at[i + 1]]
            cuts = np.r_[np.flatnonzero(np.diff(own, prepend=-1)), len(own)]
            runs[i] = [(int(a), int(b - a), names[own[a]]) for a, b in zip(cuts, cuts[1:])]
    return [names[k] if n else UNDETERMINED for k, n in zip(top, total)], np.clip(out, 0, 1), runs


def train(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """Fit on at most `sample` documents of each language, of those that are not held out. Of rows alike in id and
    language the one with the least text counts, so that every run fits the same rows."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    known = docs.select("doc_id", "lang").where("lang is not null and doc_id is not null").where(crc % HELD_OUT_MOD != HELD_OUT)
    langs = known.groupBy("lang").agg(F.count("*").alias("n"))
    place = F.md5(F.col("doc_id").cast("string").cast("binary"))
    # about 4 * sample rows of each language reach the window that takes the first `sample`
    near = F.conv(F.substring(place, 1, 8), 16, 10).cast("double") / 2.0**32 < F.lit(4.0 * sample) / F.col("n")
    nth = F.row_number().over(W.partitionBy("lang").orderBy(place, "doc_id"))
    few = broadcast_if_small(materialize(langs.withColumnRenamed("lang", "_lang"), "langs"))  # a row a language
    first = known.join(few, F.col("lang") == F.col("_lang")).where(near).distinct()
    chosen = first.withColumn("nth", nth).where(F.col("nth") <= sample).select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"))
    chosen = broadcast_if_small(materialize(chosen, "chosen"))  # `sample` rows a language
    rows = docs.select("doc_id", "lang", "text").join(chosen, (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")))
    rows = rows.groupBy("doc_id", "lang").agg(F.min(text_or_empty("text")).alias("text")).collect()
    rows = sorted((r["lang"], r["text"]) for r in rows)
    marks, texts = [r[0] for r in rows], [r[1] for r in rows]
    return fit(texts, marks)


def identify(docs: DataFrame, model: dict, spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score for each document, and spans (first word, words, language) if asked for."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = Scores(model)
        for batch in batches:
            texts, langs, values, runs, begin, size = batch["text"].tolist(), [], [], [], 0, 0
            for i, t in enumerate(texts):  # a few million characters at a time
                size += len(t or "")
                if size > 4_000_000 or i + 1 == len(texts):
                    a, b, c = label(texts[begin : i + 1], scores, spans)
                    langs, values, runs = langs + a, [*values, b], runs + c
                    begin, size = i + 1, 0
                    scores.forget()
            out = pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "lang_pred": langs, "score": np.concatenate(values) if values else np.zeros(0)})
            yield out.assign(spans=runs) if spans else out

    schema = "doc_id long, lang_pred string, score double" + ", spans array<struct<first:int,words:int,lang:string>>" * spans
    return narrow.mapInPandas(frugal(run), schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    out = identify(docs, train(docs))
    return out.select("doc_id", F.coalesce(crc % HELD_OUT_MOD == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")
