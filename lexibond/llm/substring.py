"""Repeated passages: fixed-block anchors, rolling probes, extension to maximal exact repeats.

Words are numbers. Reference blocks are ``window // 2`` consecutive words at multiples of that length: every window holds
one whole. All documents' blocks are indexed; every rolling position probes that index. A hit that isn't a block's meeting
with itself is extended: the windows around it are compared by a 128-bit BLAKE2b digest of their very words, and those that
start earlier elsewhere mark their words. Overlapping windows together are the maximal repeat. Numbers of words and hashes of
blocks, equal for equal words, only find candidates; what is removed rests on those digests, and within a segment on the words.

Texts are dealt to segments once. Between the steps only sorted hashes travel, packed by segment and hash range and each
hash once a segment, so neither a passage that a third of all documents share nor one repeated word makes a large group.
"""

import struct
from collections.abc import Iterator
from hashlib import blake2b
from itertools import compress

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexibond.llm.common import input_bytes, small_batches
from lexibond.sources.work import table_at, workspace

WINDOW = 20
#: Text bytes of a segment, and hashes of a hash range that one task compares.
SEGMENT_BYTES, RANGE_HASHES = 6 << 20, 3_000_000
#: Bits of a block hash that travel; a chance meeting of two only costs an extension that finds nothing.
BITS = 48
#: Text bytes whose words are numbered at a time.
CHUNK = 1 << 20
_RATIO = 0x2545F4914F6CDD1D
_LETTERS = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64)
_SPACE = bytes(int(x in b" \t\n\x0b\x0c\r") for x in range(256))
_PLAIN = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def _powers(ratio: int, n: int) -> np.ndarray:
    out = np.full(n, ratio, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_numbers(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First bytes, ends and 64-bit numbers of the words of a text that ends in white space.

    A number is a polynomial over random numbers of a word's bytes; all words of a chunk are cut out of one running sum.
    """
    starts, ends, numbers, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    up = down = np.zeros(0, np.uint64)
    while at < len(text):
        end = at + CHUNK
        while end < len(text) and text[end - 1] not in b" \t\n\x0b\x0c\r":
            end += 1
        part = text[at:end]
        if len(up) < len(part):
            up, down = _powers(_RATIO, len(part)), _powers(pow(_RATIO, -1, 1 << 64), len(part))
        space = np.frombuffer(part.translate(_SPACE), np.uint8)
        edge = np.flatnonzero(np.diff(space, prepend=1))
        first, last = edge[0::2], edge[1::2]
        total = np.cumsum(_LETTERS[np.frombuffer(part, np.uint8)] * up[: len(part)], dtype=np.uint64)
        total = np.r_[np.uint64(0), total]
        starts.append(first + at)
        ends.append(last + at)
        numbers.append(_mixed((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64)))
        at = end
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(numbers)


def among(values: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which of ``values`` are in ``found``; a table of low bits settles most."""
    table = np.zeros(1 << 22, bool)
    low = np.uint64((1 << 22) - 1)
    table[found & low] = True
    out = table[values & low]
    maybe = np.flatnonzero(out)
    if len(found):
        found = np.sort(found)
        k = np.minimum(np.searchsorted(found, values[maybe]), len(found) - 1)
        out[maybe] = found[k] == values[maybe]
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def rolling(h: np.ndarray, n: int, base: int) -> np.ndarray:
    """A hash of each ``n`` consecutive words, by doubling: one of n words is made of two shorter ones."""
    have, size, out, done = h, 1, None, 0
    while True:
        if n & size:
            if out is None:
                out, done = have, size
            else:
                m = len(h) - done - size + 1
                out = _mixed(out[: max(0, m)] * np.uint64(base | 1) + have[done : done + max(0, m)])
                done += size
        size *= 2
        if size > n:
            return out[: max(0, len(h) - n + 1)] if len(h) >= n else np.zeros(0, np.uint64)
        m = len(have) - size // 2
        have = _mixed(have[: max(0, m)] * np.uint64((base ^ size) | 1) + have[size // 2 :][: max(0, m)]) if m > 0 else np.zeros(0, np.uint64)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length; the first is ascending and is stored as differences."""
    n = len(arrays[0])
    parts = [np.diff(arrays[0], prepend=arrays[0].dtype.type(0)), *arrays[1:]]
    planes = [np.ascontiguousarray(p).view(np.uint8).reshape(n, -1).T.tobytes() for p in parts]
    return struct.pack("<I", n) + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(data: bytes, *kinds) -> list[np.ndarray]:
    n = struct.unpack_from("<I", data)[0]
    raw = zstandard.ZstdDecompressor().decompress(data[4:], max_output_size=n * sum(np.dtype(k).itemsize for k in kinds) + 1)
    out, at = [], 0
    for k in kinds:
        w = np.dtype(k).itemsize
        out.append(np.frombuffer(raw[at : at + n * w], np.uint8).reshape(w, n).T.copy().reshape(-1).view(k) if n else np.zeros(0, k))
        at += n * w
    out[0] = np.cumsum(out[0], dtype=kinds[0])
    return out


class Segment:
    """The documents of a segment in order of key (null first), their words one after the other."""

    def __init__(self, rows: pd.DataFrame, window: int) -> None:
        rows = rows.sort_values(["known", "doc_id", "copy"], kind="stable")
        self.known, self.keys = rows["known"].to_numpy(np.uint8), rows["doc_id"].to_numpy(np.int64)
        self.window = window
        self.texts = [(t or "").encode() for t in rows["text"]]
        self.text = (b"\n".join(self.texts) + b"\n").translate(_PLAIN)
        self.begin, self.end, self.hashes = word_numbers(self.text)
        bounds = np.cumsum([len(t) + 1 for t in self.texts])
        doc, place = np.searchsorted(bounds, self.begin, "right"), np.arange(len(self.begin))
        self.size = np.bincount(doc, minlength=len(self.texts)).astype(np.int64)
        self.first = np.r_[0, np.cumsum(self.size)]
        #: Words from each place to the end of its document, and to it from its start.
        self.left = self.first[doc + 1] - place
        self.at = place - self.first[doc]
        self.key, self.has_key = self.keys[doc], self.known[doc]

    def _rolling(self, n: int, base: int) -> np.ndarray:
        """A hash at each place where ``n`` words of one document start; elsewhere the number is of no use."""
        out = np.zeros(len(self.hashes), np.uint64)
        h = rolling(self.hashes, n, base)
        out[: len(h)] = h
        return out

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, place and whether it's a reference block, of every rolling position."""
        n = self.window // 2
        place = np.flatnonzero(self.left >= n)
        return self._rolling(n, 0x5851F42D4C957F2D)[place] >> np.uint64(64 - BITS), place, self.at[place] % n == 0

    def around(self, hits: np.ndarray) -> np.ndarray:
        """Places of the windows that hold a block at one of the places ``hits``."""
        n, total = self.window // 2, len(self.hashes)
        mark = np.zeros(total + 1, np.int32)
        np.add.at(mark, np.maximum(hits - (self.window - n), 0), 1)
        np.add.at(mark, np.minimum(hits + 1, total), -1)
        return np.flatnonzero((np.cumsum(mark)[:total] > 0) & (self.left >= self.window))

    def windows(self, places: np.ndarray) -> Iterator[bytes]:
        """The words of the windows at ``places``, joined by single spaces."""
        text, n = self.text, self.window
        long = np.r_[0, np.cumsum(self.end - self.begin)]
        begin, end = self.begin[places], self.end[places + n - 1]
        plain = end - begin == long[places + n] - long[places] + n - 1  # one space between any two words
        for i, j, ok in zip(begin.tolist(), end.tolist(), plain.tolist(), strict=True):
            yield text[i:j] if ok else b" ".join(text[i:j].split())

    def repeats(self, told: np.ndarray) -> np.ndarray:
        """Further places of windows that hold the same words as one of those at ``told``."""
        h = self._rolling(self.window, 0x9E3779B97F4A7C15)
        at = np.flatnonzero(self.left >= self.window)
        at = np.setdiff1d(at[among(h[at], h[told])], told, assume_unique=True)
        told = told[among(h[told], h[at])]
        known = set(self.windows(told)) if len(at) else set()
        return at[np.fromiter((w in known for w in self.windows(at)), bool, len(at))]

    def digests(self, places: np.ndarray) -> np.ndarray:
        """The digests, as two numbers, of the words of the windows at ``places``."""
        out = b"".join([blake2b(w, digest_size=16).digest() for w in self.windows(places)])
        return np.frombuffer(out, "<u8").reshape(-1, 2)


def _ranges(h: np.ndarray, bits: int, n: int) -> Iterator[tuple[int, slice]]:
    """Hash ranges and where they lie in ascending ``h``."""
    cuts = np.searchsorted(h, np.array([-(-(k << bits) // n) for k in range(1, n)], np.uint64))
    for k, (i, j) in enumerate(zip([0, *cuts.tolist()], [*cuts.tolist(), len(h)], strict=True)):
        if j > i:
            yield k, slice(i, j)


def remove_repeats(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", segment_bytes: int = SEGMENT_BYTES, with_text: bool = True) -> DataFrame:
    """``key, n_words, n_removed, kept_sha256`` and, ``with_text``, ``kept`` (the text that is left) of every document.

    A word goes if a window of ``window`` words that covers it occurs earlier: in a document with a smaller key, or in
    the same one further on. The first occurrence stays. Windows are judged on the input.

    Null text has no words. Rows with the same key, and rows without one, which come before all others, have an order of
    their own that depends on their texts' hashes; equal rows come in any. They are dealt out by key and text, so a key
    that many rows share isn't a large segment. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    size = input_bytes(docs, text)
    segments = max(1, -(-size // segment_bytes))
    ranges = max(1, -(-size // (5 * RANGE_HASHES)))
    buckets = min(segments, 4096)
    copy = F.xxhash64(text)
    # windows of one key are ordered by segment, and within one by text
    has, order = F.col(key).isNotNull().cast("tinyint"), F.coalesce(F.col(key).cast("bigint"), F.lit(0).cast("bigint"))
    rows = docs.select(has.alias("known"), order.alias("doc_id"), copy.alias("copy"), F.col(text).alias("text"))
    rows = rows.withColumn("seg", F.pmod(F.xxhash64("doc_id", "copy"), F.lit(segments)).cast("int"))
    path = workspace(spark, "segments")
    table = table_at(spark, "segments_" + path.rsplit("-", 1)[-1])
    # texts are written once by segment: the later steps read them without a shuffle
    rows.repartition(buckets, "seg").write.option("compression", "zstd").bucketBy(buckets, "seg").sortBy("seg").option("path", path).saveAsTable(table)
    held = spark.table(table)

    def probes(pdf: pd.DataFrame) -> pd.DataFrame:
        h, _, block = Segment(pdf, window).blocks()
        h = np.sort(h << np.uint64(1) | block.astype(np.uint64))
        start = np.flatnonzero(np.r_[True, h[1:] >> np.uint64(1) != h[:-1] >> np.uint64(1)]) if len(h) else np.zeros(0, np.int64)
        count = np.diff(np.r_[start, len(h)])
        last = h[start + count - 1]
        once, state = last >> np.uint64(1), ((last & np.uint64(1)).astype(np.uint8) << 1 | (count > 1)).astype(np.uint8)
        out = [(k, int(pdf["seg"].iloc[0]), _pack(once[s], state[s])) for k, s in _ranges(once, BITS, ranges)]
        return pd.DataFrame(out, columns=["r", "seg", "data"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        """Hashes that are a block somewhere and occur twice, told to each segment that has them."""
        parts = [_unpack(d, np.uint64, np.uint8) for d in pdf["data"]]
        h, state = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(h, kind="stable")
        hs = h[order]
        start = np.flatnonzero(np.r_[True, hs[1:] != hs[:-1]])
        block = np.maximum.reduceat(state[order] >> 1, start) > 0
        twice = np.maximum.reduceat(state[order] & 1, start) + np.diff(np.r_[start, len(hs)]) > 1
        good = hs[start[block & twice]]
        out = []
        for seg, (own, _) in zip(pdf["seg"], parts, strict=True):
            found = own[among(own, good)]
            if len(found):
                out.append((int(seg), _pack(found)))
        return pd.DataFrame(out, columns=["seg", "data"])

    def extend(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["r", "seg", "data"]
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=columns)
        seg = Segment(left, window)
        found = np.concatenate([_unpack(d, np.uint64)[0] for d in right["data"]])
        h, place, _ = seg.blocks()
        place = seg.around(place[among(h, found)])
        a, b = seg.digests(place).T
        order = np.lexsort((place, b, a))
        a, b, place = a[order], b[order], place[order]
        start = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
        many = (np.diff(np.r_[start, len(a)]) > 1).astype(np.uint8)
        a, b, place = a[start], b[start], place[start]
        state, key_of = many | seg.has_key[place] << 1, seg.key[place]
        return pd.DataFrame([(k, int(left["seg"].iloc[0]), _pack(a[s], b[s], key_of[s], place[s], state[s])) for k, s in _ranges(a, 64, ranges)], columns=columns)

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        """Windows that occur twice, told to each segment that has them: does it hold the first?"""
        parts = [_unpack(d, np.uint64, np.uint64, np.int64, np.int64, np.uint8) for d in pdf["data"]]
        a, b, key_of, place, state = (np.concatenate([p[i] for p in parts]) for i in range(5))
        source = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        order = np.lexsort((place, pdf["seg"].to_numpy()[source], key_of, state >> 1, b, a))
        a, b, place, source, many = a[order], b[order], place[order], source[order], state[order] & 1
        start = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        count = np.diff(np.r_[start, len(a)])
        lead = np.zeros(len(a), np.uint8)
        lead[start] = 1
        again = (np.repeat(count, count) > 1) | (many > 0)
        out, own = [], np.flatnonzero(again)
        own = own[np.lexsort((place[own], source[own]))]
        cuts = np.searchsorted(source[own], np.arange(len(parts) + 1))
        for k, seg in enumerate(pdf["seg"]):
            s = own[cuts[k] : cuts[k + 1]]
            if len(s):
                out.append((int(seg), _pack(place[s], lead[s])))
        return pd.DataFrame(out, columns=["seg", "data"])

    def mark(left: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
        import hashlib

        columns = ["known", "doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text
        if not len(left):
            return pd.DataFrame([], columns=columns)
        seg = Segment(left, window)
        gone = np.zeros(int(seg.first[-1]) + 1, np.int32)
        if len(hits):
            parts = [_unpack(d, np.int64, np.uint8) for d in hits["data"]]
            told, lead = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            repeat = np.r_[told[lead == 0], seg.repeats(told)]
            np.add.at(gone, repeat, 1)
            np.add.at(gone, repeat + window, -1)
        gone = np.cumsum(gone)[:-1] > 0
        out = []
        for has_key, key_of, text_of, f, n in zip(seg.known.tolist(), seg.keys.tolist(), seg.texts, seg.first.tolist(), seg.size.tolist(), strict=False):
            drop, words = gone[f : f + n], text_of.split()
            removed = int(drop.sum())
            kept = b" ".join(compress(words, (~drop).tolist()) if removed else words)
            row = (has_key, key_of, n, removed, hashlib.sha256(kept).hexdigest())
            out.append((*row, kept.decode("utf-8", "replace")) if with_text else row)
        return pd.DataFrame(out, columns=columns)

    probed = held.groupBy("seg").applyInPandas(probes, "r int, seg int, data binary")
    met = probed.groupBy("r").applyInPandas(meet, "seg int, data binary")
    extended = held.groupBy("seg").cogroup(met.groupBy("seg")).applyInPandas(extend, "r int, seg int, data binary")
    judged = extended.groupBy("r").applyInPandas(first, "seg int, data binary")
    out = held.groupBy("seg").cogroup(judged.groupBy("seg")).applyInPandas(mark, "known tinyint, doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * with_text)
    return out.withColumn("doc_id", F.when(F.col("known") == 1, F.col("doc_id"))).drop("known").withColumnRenamed("doc_id", key)
