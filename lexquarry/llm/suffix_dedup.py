"""Removal of repeated byte strings with sharded suffix arrays.

A byte is removed if it is covered by a string of WINDOW bytes that also starts earlier (smaller doc_id, or the same
document and an earlier start). Documents are whole UTF-8 texts; strings never cross documents and are judged on the input.

1. Every window is given to its anchor: the one of its GRAM-byte strings with the least hash, leftmost. Equal windows
   have equal anchors, so windows need only be compared within an anchor. Neighbouring windows with the
   same anchor are one run; its bytes (all windows of the run) are its segment.
2. Runs meet by anchor hash, as packed arrays. Anchors seen once end here. Equal segments need no sorting: all but
   the first are removed whole. Copies within one batch of texts are settled before anything is shuffled.
3. Anchors with differing segments (copies that begin, end or were edited near) are dealt out as shards, each segment
   once. A shard's suffix array comes from induced sorting and its common prefixes in permuted order; suffixes linked by
   common prefixes of WINDOW bytes start equal windows, and all but the first of them are removed.
4. An anchor with more than CAP differing segments would be too much for a shard. Its windows are divided by how many bytes
   they have before the anchor; the bytes that all windows of a division share (its core: the anchor at first, longer with each
   halving) deal it out as sub-shards. Equal windows have equal cores, so they meet; equal segments of a sub-shard
   are settled, one that is still too large is divided again. A division of one place has whole windows as cores, so this ends.
5. Removed spans go back to the documents by doc_id.

Defined results: null text is empty; rows with null doc_id lose nothing and remove nothing; rows with equal doc_id and equal
text are one document (both lose the same bytes), with differing texts they are ordered by a hash of the text;
of windows that start at the same place of such rows none is earlier; very long texts are cut into runs a piece at a time;
an empty table gives no rows; apply() keeps other columns, whatever their names, and decodes what is left, dropping a
character of which a byte was removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _bytes, _suffixes
from ._common import broadcast_if_small, frugal, materialize, small_batches, table, text_or_empty
from ._groups import map_groups

WINDOW, GRAM = 100, 32
#: Bytes of texts that are cut into runs at once, and differing segments of an anchor that a shard takes.
CHUNK, CAP = 1_000_000, 2048
#: Window starts of a very long text that are handled at once.
PIECE = 1 << 21
#: Packed runs: anchor (48 bits in two parts), segment, document (id, hash), start, windows (+128: settled already).
RUN = [("a0", "<u4"), ("a1", "<u2"), ("seg", "<u8"), ("doc", "<i8"), ("th", "<i8"), ("start", "<u4"), ("n", "u1")]


def runs(data: np.ndarray, starts: np.ndarray, ends_at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts as joined bytes -> (text, first window, number of windows, anchor hash, segment hash) of each run."""
    n = len(data)
    if n > PIECE + WINDOW:  # places take 24 bits: window starts in pieces; a run that a piece cuts is two runs
        out = []
        for a in range(0, n - WINDOW + 1, PIECE):
            inside = np.clip(starts, a, min(n, a + PIECE + WINDOW - 1)) - a
            piece = runs(data[a : a + PIECE + WINDOW - 1], inside, starts - a)
            out.append((piece[0], piece[1] + a, *piece[2:]))
        return tuple(np.concatenate(x) for x in zip(*out))
    real = starts if ends_at is None else ends_at
    hashes = _bytes.prefix_hashes(data)
    grams = np.arange(max(0, n - GRAM + 1))
    h = _bytes.spans(hashes, grams, grams + GRAM)
    least = (h & ~np.uint64(0xFFFFFF)) | grams.astype("u8")  # 40 bits of the hash, then the place
    reach = WINDOW - GRAM + 1
    width = 1
    while 2 * width <= reach:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    rest = reach - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    at = (least & np.uint64(0xFFFFFF)).astype("i8")
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[: len(at)]
    valid = np.arange(len(at)) + WINDOW <= np.minimum(real[text + 1] - 1, n) if len(at) else np.zeros(0, bool)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new & valid)
    stops = np.flatnonzero(np.r_[new[1:] | ~valid[1:], True] & valid) + 1 if len(at) else first
    size = stops - first
    return text[first], first, size, h[at[first]], _bytes.spans(hashes, first, first + size + WINDOW - 1)


def _packed(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket, runs (packed, several for each batch of texts)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, ids, ths = batch["text"].tolist(), batch["doc_id"].to_numpy("i8"), batch["th"].to_numpy("i8")
            begin = size = 0
            for i, t in enumerate(texts):
                size += len(t) * (1 if t.isascii() else 2) + 1
                if size < CHUNK and i + 1 < len(texts):
                    continue
                data, starts = _bytes.join(texts[begin : i + 1])
                text, first, n, anchor, seg = runs(data, starts)
                out = np.zeros(len(text), RUN)
                out["a0"], out["a1"] = anchor & np.uint64(0xFFFFFFFF), (anchor >> np.uint64(32)) & np.uint64(0xFFFF)
                out["seg"], out["doc"], out["th"], out["start"], out["n"] = seg, ids[begin : i + 1][text], ths[begin : i + 1][text], first - starts[text], n
                order = np.lexsort((out["start"], out["th"], out["doc"], out["seg"], out["a1"], out["a0"]))
                out = out[order]
                twin = np.r_[False, (out["seg"][1:] == out["seg"][:-1]) & (out["a0"][1:] == out["a0"][:-1]) & (out["a1"][1:] == out["a1"][:-1])]
                lead = np.maximum.accumulate(np.where(~twin, np.arange(len(out)), 0))
                later = twin & ((out["doc"] != out["doc"][lead]) | (out["th"] != out["th"][lead]) | (out["start"] != out["start"][lead]))
                out["n"][later] |= 128
                key = (out["a0"].astype("u8") ^ (out["a1"].astype("u8") << np.uint64(32))) % np.uint64(buckets)
                key[later] = (out["doc"][later].astype("u8") + out["start"][later] // np.uint64(4096)) % np.uint64(buckets)
                order = np.argsort(key, kind="stable")
                key, out = key[order], out[order]
                cut = np.r_[np.flatnonzero(np.diff(key.astype("i8"), prepend=-1)), len(key)]
                parts = [b"".join(np.ascontiguousarray(out[name][a:b]).tobytes() for name, _ in RUN) for a, b in zip(cut, cut[1:])]
                yield pd.DataFrame({"bucket": key[cut[:-1]].astype("i8"), "runs": parts})
                begin, size = i + 1, 0

    return docs.mapInPandas(frugal(run), "bucket long, runs binary")


def _unpack(parts: list[bytes]) -> dict[str, np.ndarray]:
    one = sum(np.dtype(t).itemsize for _, t in RUN)
    out: dict[str, list] = {name: [] for name, _ in RUN}
    for p in parts:
        n, at = len(p) // one, 0
        for name, kind in RUN:
            out[name].append(np.frombuffer(p, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return {k: np.concatenate(v) for k, v in out.items()}


def _settle(frame: pd.DataFrame, at: np.ndarray) -> pd.DataFrame:
    """Runs of whole buckets -> removed spans (kind 0) and runs of anchors with differing segments (1: shard, 2: hot)."""
    done = []
    parts = frame["runs"].tolist()
    for a, b in zip(at, at[1:]):
        r = _unpack(parts[a:b])
        settled = r["n"] >= 128
        length = (r["n"] & 127).astype("i8")
        span = (r["start"].astype("i8") << 32) | (length + WINDOW - 1)
        done.append({"kind": np.zeros(int(settled.sum()), "i4"), "anchor": np.zeros(int(settled.sum()), "i8"), "doc_id": r["doc"][settled], "th": r["th"][settled], "span": span[settled]})
        keep = np.flatnonzero(~settled)
        anchor = (r["a0"][keep].astype("i8")) | (r["a1"][keep].astype("i8") << 32)
        order = np.lexsort((r["start"][keep], r["th"][keep], r["doc"][keep], r["seg"][keep], anchor))
        keep, anchor = keep[order], anchor[order]
        doc, th, start, seg = r["doc"][keep], r["th"][keep], r["start"][keep], r["seg"][keep]
        new_anchor = np.r_[True, anchor[1:] != anchor[:-1]][: len(anchor)]
        new_seg = new_anchor | np.r_[True, seg[1:] != seg[:-1]][: len(anchor)]
        lead = np.maximum.accumulate(np.where(new_seg, np.arange(len(anchor)), 0))
        later = (doc != doc[lead]) | (th != th[lead]) | (start != start[lead])
        group = np.cumsum(new_anchor) - 1
        segments = np.bincount(group[new_seg], minlength=len(anchor))[group] if len(anchor) else np.zeros(0, "i8")
        # rows of one document given twice are equal to their lead: no earlier place
        done.append({"kind": np.zeros(int(later.sum()), "i4"), "anchor": np.zeros(int(later.sum()), "i8"), "doc_id": doc[later], "th": th[later], "span": span[keep][later]})
        open_ = new_seg & (segments > 1)
        done.append({"kind": np.where(segments[open_] > CAP, 2, 1).astype("i4"), "anchor": anchor[open_], "doc_id": doc[open_], "th": th[open_], "span": span[keep][open_]})
    return pd.DataFrame({k: np.concatenate([d[k] for d in done]) for k in ("kind", "anchor", "doc_id", "th", "span")})


def _segments(texts: DataFrame, open_runs: DataFrame) -> DataFrame:
    """kind, anchor, doc_id, th, start, seg (bytes) for each open run."""
    by_doc = open_runs.groupBy("doc_id", "th").agg(F.collect_list(F.struct("kind", "anchor", "span")).alias("open")).select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "open")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, th, text, open_ in zip(batch["doc_id"], batch["th"], batch["text"], batch["open"]):
                raw = text.encode("utf-8", "surrogatepass")
                for r in open_:
                    start, length = r["span"] >> 32, r["span"] & 0xFFFFFFFF
                    out.append((r["kind"], r["anchor"], doc_id, th, start, raw[start : start + length]))
                if len(out) > 50_000:
                    yield pd.DataFrame(out, columns=["kind", "anchor", "doc_id", "th", "start", "seg"])
                    out = []
            yield pd.DataFrame(out, columns=["kind", "anchor", "doc_id", "th", "start", "seg"])

    joined = texts.join(by_doc.hint("merge"), (F.col("doc_id") == F.col("_d")) & (F.col("th") == F.col("_t"))).select("doc_id", "th", "text", "open")
    return joined.mapInPandas(frugal(cut), "kind int, anchor long, doc_id long, th long, start long, seg binary")


def _spans_of(starts: np.ndarray) -> list[int]:
    """Ascending removed windows of one segment -> spans, start << 32 | length."""
    cut = np.flatnonzero(np.diff(starts, prepend=-(1 << 40)) > WINDOW)
    last = np.r_[cut[1:], len(starts)] - 1
    return [(int(starts[a]) << 32) | int(starts[b] - starts[a] + WINDOW) for a, b in zip(cut, last)]


def _shard(frame: pd.DataFrame, at: np.ndarray) -> pd.DataFrame:
    """Segments of whole anchors -> removed spans, by a suffix array over all of them (a MB at a time)."""
    doc, th, start, segs = frame["doc_id"].to_numpy("i8"), frame["th"].to_numpy("i8"), frame["start"].to_numpy("i8"), frame["seg"].tolist()
    size = np.array([len(s) for s in segs], "i8")
    out, lo, weight = [], 0, np.r_[0, np.cumsum(size)]
    for k in range(1, len(at)):
        if weight[at[k]] - weight[lo] < 1_000_000 and k + 1 < len(at):
            continue
        hi = int(at[k])
        data = np.frombuffer(b"\xff".join(segs[lo:hi]) + b"\xff", "u1")  # no UTF-8 text holds this byte
        order = _suffixes.suffix_array(data)
        cls = np.empty(len(data), "i8")
        cls[order] = np.cumsum(_suffixes.common_prefixes(data, order) < WINDOW)
        n = size[lo:hi] - WINDOW + 1
        begin = np.r_[0, np.cumsum(size[lo:hi] + 1)][:-1]
        of = np.repeat(np.arange(hi - lo), n)
        nth = np.arange(len(of)) - np.repeat(np.r_[0, np.cumsum(n)][:-1], n)
        c, d, t, s = cls[begin[of] + nth], doc[lo:hi][of], th[lo:hi][of], start[lo:hi][of] + nth
        sort = np.lexsort((s, t, d, c))
        lead = np.maximum.accumulate(np.where(np.r_[True, c[sort][1:] != c[sort][:-1]], np.arange(len(sort)), 0))
        first = sort[lead]
        gone = sort[(d[sort] != d[first]) | (t[sort] != t[first]) | (s[sort] != s[first])]
        gone = np.sort(gone)
        cut = np.r_[np.flatnonzero(np.diff(of[gone], prepend=-1)), len(gone)]
        for a, b in zip(cut, cut[1:]):
            i = lo + of[gone[a]]
            out += [(doc[i], th[i], x) for x in _spans_of(s[gone[a:b]])]
        lo = hi
    return pd.DataFrame(out, columns=["doc_id", "th", "span"], dtype="i8")


SUB = "core long, lo int, hi int, at int, doc_id long, th long, start long, seg binary"


def _anchored(segments: DataFrame) -> DataFrame:
    """Segments of hot anchors with their anchors' places; windows have lo to hi bytes before the anchor."""
    reach = WINDOW - GRAM

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            places = []
            for seg in batch["seg"]:
                data = np.frombuffer(seg, "u1")
                grams = np.arange(len(data) - WINDOW, reach + 1)  # those that are in all windows of the segment
                h = _bytes.spans(_bytes.prefix_hashes(data), grams, grams + GRAM)
                places.append(int(grams[np.argmin(h >> np.uint64(24))]))
            yield batch.assign(lo=0, hi=reach, at=places)[["anchor", "lo", "hi", "at", "doc_id", "th", "start", "seg"]].rename(columns={"anchor": "core"})

    return segments.select("anchor", "doc_id", "th", "start", "seg").mapInPandas(frugal(find), SUB)


def _divided(rows: DataFrame) -> DataFrame:
    """Each segment's windows in two divisions, with longer cores."""
    def halves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for core, lo, hi, at, doc_id, th, start, seg in batch.itertuples(index=False):
                mid = (lo + hi) // 2
                for a, b in ((lo, mid), (mid + 1, hi)):
                    first, last = max(0, at - b), min(len(seg) - WINDOW, at - a)
                    if first <= last:
                        shared = hashlib.blake2b(seg[at - a : at - b + WINDOW] + core.to_bytes(8, "big", signed=True), digest_size=8).digest()
                        out.append((int.from_bytes(shared, "big", signed=True), a, b, at - first, doc_id, th, start + first, seg[first : last + WINDOW]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SUB.split(", ")])

    return rows.mapInPandas(frugal(halves), SUB)


def _hot(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments of anchors with very many of them -> (sub-shards as segments, spans of segments that are equal to an earlier one)."""
    key, place = ["core", "lo", "hi"], F.struct("doc_id", "th", "start")
    spark = segments.sparkSession
    shards = spark.createDataFrame([], "anchor long, doc_id long, th long, start long, seg binary")
    gone = spark.createDataFrame([], "doc_id long, th long, span long")
    rows = materialize(_anchored(segments), "hot")
    while rows.limit(1).count():
        rows = materialize(_divided(rows), "hot")
        alike = rows.groupBy(*key, "seg").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.first("at").alias("at"))
        alike = materialize(alike, "alike")
        repeated = alike.where("first != last").select(*[F.col(k).alias("_" + k) for k in [*key, "seg"]], "first")
        same = [F.col(k) == F.col("_" + k) for k in [*key, "seg"]]
        later = rows.join(repeated, same).where(place != F.col("first"))
        gone = gone.union(later.select("doc_id", "th", F.shiftleft("start", 32) + F.octet_length("seg")))
        sizes = alike.groupBy(*[F.col(k).alias("_" + k) for k in key]).agg(F.count("*").alias("n")).where("n > 1")
        met = alike.join(materialize(sizes, "sizes"), same[:3]).select(*key, "at", "first.*", "seg", "n")
        shards = shards.union(met.where(F.col("n") <= CAP).select(F.xxhash64(*key).alias("anchor"), "doc_id", "th", "start", "seg"))
        rows = materialize(met.where((F.col("n") > CAP) & (F.col("lo") < F.col("hi"))).drop("n"), "hot")
    return shards, gone


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, th, text. th tells apart rows of equal doc_id; it is 0 where a doc_id has one row."""
    ids = F.col("doc_id") if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long").alias("doc_id")
    base = docs.select(ids, text_or_empty("text").alias("text")).where("doc_id is not null")
    twice = materialize(base.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_twice")), "twice")
    if not twice.limit(1).count():
        return base.select("doc_id", F.lit(0).cast("long").alias("th"), "text")
    marked = base.join(broadcast_if_small(twice), F.col("doc_id") == F.col("_twice"), "left")
    return marked.select("doc_id", F.when(F.col("_twice").isNull(), F.lit(0)).otherwise(F.xxhash64("text")).cast("long").alias("th"), "text")


def removed_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, text) of all documents with an id, and (_d, _t, spans) of those that lose something."""
    spark = docs.sparkSession
    small_batches(spark)
    buckets = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = _texts(docs)
    met = materialize(map_groups(_packed(texts, buckets), ["bucket"], _settle, "kind int, anchor long, doc_id long, th long, span long"), "runs")
    segments = materialize(_segments(texts, met.where("kind > 0")), "segments")
    shards = segments.where("kind = 1").drop("kind")
    gone = met.where("kind = 0").select("doc_id", "th", "span")
    hot = segments.where("kind = 2")
    if hot.limit(1).count():
        more, equal = _hot(hot)
        shards, gone = shards.union(more.select(*shards.columns)), gone.union(equal)
    gone = gone.union(map_groups(shards, ["anchor"], _shard, "doc_id long, th long, span long"))
    return texts, gone.groupBy("doc_id", "th").agg(F.collect_set("span").alias("spans")).select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "spans")


def _cover(spans: np.ndarray | None, n: int) -> list[tuple[int, int]]:
    """Maximal removed runs (begin, end) from spans."""
    if spans is None or not len(spans):
        return []
    s = np.sort(np.asarray(spans, "i8"))
    a, b = s >> 32, (s >> 32) + (s & 0xFFFFFFFF)
    high = np.maximum.accumulate(b)
    cut = np.flatnonzero(np.r_[True, a[1:] > high[:-1]])
    return list(zip(a[cut].tolist(), high[np.r_[cut[1:], len(a)] - 1].tolist()))


def _kept(raw: bytes, cover: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in cover:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each document."""
    texts, gone = removed_spans(docs)

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, spans in zip(batch["doc_id"], batch["text"], batch["spans"]):
                raw = text.encode("utf-8", "surrogatepass")
                cover = _cover(spans, len(raw))
                out.append((doc_id, len(raw), sum(b - a for a, b in cover), len(cover), hashlib.sha256(_kept(raw, cover)).hexdigest()))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = texts.join(gone.hint("merge"), (F.col("doc_id") == F.col("_d")) & (F.col("th") == F.col("_t")), "left").select("doc_id", "text", "spans")
    out = joined.mapInPandas(frugal(digest), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    alone = docs.where("doc_id is null").select(text_or_empty("text").cast("binary").alias("raw"))
    zero = F.lit(0).cast("long")
    return out.union(alone.select(F.lit(None).cast("long"), F.octet_length("raw").cast("long"), zero, zero, F.sha2("raw", 256)))


def apply(docs: DataFrame) -> DataFrame:
    """The documents without repeated strings, with their own columns; n_chars, if there, is the new length."""
    texts, gone = removed_spans(docs)
    gone = materialize(gone, "spans")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, spans in zip(batch["text"], batch["spans"]):
                raw = text.encode("utf-8", "surrogatepass")
                out.append(_kept(raw, _cover(spans, len(raw))).decode("utf-8", "ignore"))
            yield batch.assign(text=out).drop(columns="spans")

    th = texts.where(F.col("th") != 0).select("doc_id").distinct()
    plain = docs.where("doc_id is not null")
    row = plain.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"), F.struct(*[c for c in docs.columns if c != "text"]).alias("_row"))
    if th.limit(1).count():
        twice = broadcast_if_small(materialize(th.withColumnRenamed("doc_id", "_twice"), "twice"))
        row = row.join(twice, F.col("doc_id") == F.col("_twice"), "left").withColumn("th", F.when(F.col("_twice").isNull(), F.lit(0)).otherwise(F.xxhash64("text")).cast("long"))
    else:
        row = row.withColumn("th", F.lit(0).cast("long"))
    joined = row.join(gone, (F.col("doc_id") == F.col("_d")) & (F.col("th") == F.col("_t")), "left").select("text", "_row", "spans")
    out = joined.mapInPandas(frugal(cut), joined.drop("spans").schema).select("_row.*", "text")
    out = out.unionByName(docs.where("doc_id is null").select(*out.columns))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))
