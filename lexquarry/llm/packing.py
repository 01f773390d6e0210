"""Packing documents into fixed token windows by best-fit decreasing.

A document's ids are cut into full windows first; what is left is one shorter piece. Best-fit decreasing puts
the longest piece into the open window with the least room that still takes it, and a segment tree over
remaining capacities finds that window. Pieces of equal length are alike, so the walk needs only how many pieces
there are of each length (at most ``size`` numbers, whatever the corpus): whole groups of pieces are put into
whole groups of windows at once, which gives the same packing as one piece after another. The plan is a
bounded list of runs; a piece finds its window from its length and its rank among the pieces of that length.
Ranks come from counts by (partition, length), so nothing is sorted and no piece passes through the driver.

Windows are padded to ``size`` tokens, except those that end at a power of two.

Defined results: null or empty text has the one id ``eos``; rows with equal or null doc_id are documents of
their own; very long texts are cut like others; pieces of equal length are alike to the plan, and take their windows by partition
and order there; an empty table gives no pieces; other columns are not read, whatever their names.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import frugal, materialize, table

SIZE, EOS = 2048, 1
#: Words whose ids a worker remembers; it starts anew when there are more.
REMEMBERED = 500_000
#: What often trails a word; the tokenizer splits before it.
TRAILING = ".,*%&$#!|?;:"
#: Texts by which a tokenizer shows whether it lower-cases, and splits at spaces, line ends and marks.
PROBES = ["The Cat sat, on THE mat.", " two  spaces\nand\n\nlines ", "x1 22 a-b don't [e-mail] end!?", "Größe ÉTÉ ΣΑΣ naïve 日本 語", "\tTab a\tb ...;: %% $5"]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> str:
    """The letter that byte-level BPE writes for each byte: printable bytes stand for themselves, others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return "".join(chr(b) if b in plain else chr(next(others)) for b in range(256))


class WordIds(dict):
    """word -> its ids as little-endian uint32 bytes. The default tokenizer never joins across a space or newline, so a
    text's ids are those of its words, one after another; words come back often and are encoded once. A tokenizer
    that handles PROBES otherwise encodes whole texts instead."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        plain = self.tokenizer.encode("ab ba", add_special_tokens=False).ids
        self.direct = plain == [t.id for w in ("ab", "ba") for t in self.tokenizer.model.tokenize(w)]
        self.by_word = True
        self.by_word = all(self.of(t) == self.whole(t) for t in PROBES)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        stem = word.rstrip(TRAILING)
        if stem and stem != word and stem.isalpha():
            ids = self[stem] + self[word[len(stem) :]]
        elif self.direct and word.isalpha() and word.islower() and unicodedata.is_normalized("NFC", word):
            letters = word.encode().decode("latin-1").translate(self.letters)
            ids = np.array([t.id for t in self.tokenizer.model.tokenize(letters)], "<u4").tobytes()
        else:
            ids = self.whole(word)
        self[word] = ids
        return ids

    def of(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_word:
            return self.whole(text)
        low = text.lower()  # the tokenizer lower-cases too, letter by letter
        if "Σ" in text or not unicodedata.is_normalized("NFC", low):
            low = text
        if len(self) > REMEMBERED:
            self.clear()
        return b"".join(map(self.__getitem__, low.replace("\n", " ").split(" ")))


def cut(docs: DataFrame, size: int = SIZE, eos: int = EOS, tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Documents -> pieces: doc_id, start, length, ids_crc32, doc_tokens, part and nth (the piece's partition,
    and its rank there among pieces of its length); with keep_ids also ids, an array."""
    path = tokenizer or default_tokenizer()
    end = np.array([eos], "<u4").tobytes()

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, seen = WordIds(path), defaultdict(int)
        part = TaskContext.get().partitionId()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = words.of(text) + end
                total = len(ids) // 4
                for start in range(0, total, size):
                    piece = ids[4 * start : 4 * (start + size)]
                    length = len(piece) // 4
                    out.append((doc_id, start, length, zlib.crc32(piece), total, part, seen[length], *[np.frombuffer(piece, "<u4").astype("i4")] * keep_ids))
                    seen[length] += 1
            frame = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth", *["ids"] * keep_ids])
            yield frame.astype({"doc_id": "Int64"})

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(frugal(pieces), schema)


class OpenWindows:
    """Open windows by remaining capacity, with a segment tree over capacities that knows which are not empty."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.some = np.zeros(2 * self.leaves, bool)
        self.ranges: dict[int, list[list[int]]] = defaultdict(list)

    def _mark(self, room: int) -> None:
        i, self.some[self.leaves + room] = self.leaves + room, bool(self.ranges[room])
        while i := i // 2:
            self.some[i] = self.some[2 * i] or self.some[2 * i + 1]

    def add(self, room: int, first: int, n: int) -> None:
        if n and room:
            self.ranges[room].append([first, n])
            self._mark(room)

    def tightest(self, need: int) -> int | None:
        """The least capacity of an open window that is at least need."""
        i = self.leaves + need
        if not self.some[i]:
            while i > 1 and (i % 2 or not self.some[i + 1]):
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i + (not self.some[2 * i])
        return i - self.leaves

    def take(self, room: int, most: int) -> tuple[int, int]:
        """Remove up to most windows of one range: (first, number)."""
        own = self.ranges[room]
        first, n = own[-1]
        if n <= most:
            own.pop()
            self._mark(room)
            return first, n
        own[-1] = [first + most, n - most]
        return first, most


def plan(counts: dict[int, int], size: int = SIZE) -> dict[int, np.ndarray]:
    """length -> runs (first rank, pieces a window, first window, offset): the piece of rank r in a run goes to
    window first + (r - rank) // per at offset + (r - rank) % per * length."""
    windows, opened, out = OpenWindows(size), 0, {}
    for length in sorted(counts, reverse=True):
        left, rank, runs = counts[length], 0, []
        while left:
            room = windows.tightest(length)
            if room is None:
                room, per = size, size // length
                first, n = opened, -(-left // per)
                opened += n
            else:
                per = room // length
                first, n = windows.take(room, -(-left // per))
            runs.append((rank, per, first, size - room))
            full = min(n, left // per)
            windows.add(room - per * length, first, full)
            if full < n:  # the last window gets what is left
                windows.add(room - (left - full * per) * length, first + full, 1)
            placed = min(left, n * per)
            rank, left = rank + placed, left - placed
        out[length] = np.array(runs, "i8")
    return out


def pack(docs: DataFrame, size: int = SIZE, eos: int = EOS, tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Documents -> a row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for."""
    pieces = materialize(cut(docs, size, eos, tokenizer, keep_ids), "pieces")
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    by_part = materialize(by_part.withColumn("before", F.coalesce(before, F.lit(0))), "ranks")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    runs = plan(counts, size)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), (batch["nth"] + batch["before"]).to_numpy()
            window, offset = np.zeros(len(batch), "i8"), np.zeros(len(batch), "i8")
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                run = runs[int(n)][np.searchsorted(runs[int(n)][:, 0], rank[at], "right") - 1]
                i = rank[at] - run[:, 0]
                window[at], offset[at] = run[:, 2] + i // run[:, 1], run[:, 3] + i % run[:, 1] * n
            yield batch[columns].astype({"doc_id": "Int64"}).assign(sequence_id=window, offset=offset)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids + ", sequence_id long, offset long"
    # sorted, not broadcast: ranks grow with the number of partitions
    return pieces.join(by_part.drop("n").hint("merge"), ["part", "length"]).select(*columns, "nth", "before").mapInPandas(frugal(place), schema)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
