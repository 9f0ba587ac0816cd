"""Vector bin packing of token sequences."""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexibond.llm.common import lean, pieces_of, small_batches, spaced_pieces
from lexibond.sources.work import written

#: Limits of a sequence: tokens, segments, loss-bearing tokens.
TOKENS, SEGMENTS, LOSS = 2048, 256, 2048
#: Items that wait at a time; a sequence is filled from these.
WINDOW = 256


class Packer:
    """Fills sequences one after the other from a window of waiting items.

    An item is (key, start, length, loss tokens, whole length, payload). The next item of a sequence is the one
    whose demand, as shares of the limits, has the largest dot product with what is left of the limits. With
    ``cut`` an item may be cut: then what is left over of a sequence is filled with the head of a waiting item, and
    sequences that stay short are split into ones whose length is a power of two. Without, an item that exceeds a
    limit by itself is given alone and in no sequence.
    """

    def __init__(self, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, window: int = WINDOW, cut: bool = True) -> None:
        self.limits = np.array([tokens, segments, loss], float)
        self.window, self.cut = window, cut
        self.items: list = []
        self.need = np.zeros((2 * window, 3))
        self.sequence = 0

    def beyond(self, item) -> bool:
        """Whether an item exceeds a limit by itself."""
        return bool((np.array([item[2], 1, item[3]]) > self.limits).any())

    def _loss(self, item, a: int, b: int) -> int:
        """Loss tokens of a part; those of an item are its last ones."""
        return max(0, b - max(a, item[2] - item[3]))

    def _push(self, item) -> None:
        k = len(self.items)
        if k == len(self.need):
            self.need = np.vstack([self.need, np.zeros_like(self.need)])
        self.items.append(item)
        self.need[k] = (item[2], 1, item[3])

    def _pop(self, k: int):
        item, last = self.items[k], len(self.items) - 1
        self.items[k] = self.items[last]
        self.need[k] = self.need[last]
        self.items.pop()
        return item

    @staticmethod
    def part(item, a: int, b: int, loss: int):
        key, start, _, _, whole, data = item
        return (key, start + a, b - a, loss, whole, data[4 * a : 4 * b] if data is not None else None)

    def add(self, item) -> Iterator[list]:
        if not self.cut and self.beyond(item):
            yield [item]
            return
        full = int(min(self.limits[0], self.limits[2]))
        if self.cut and item[2] > full:
            at = 0
            while item[2] - at > full:
                yield [self.part(item, at, at + full, self._loss(item, at, at + full))]
                at += full
            item = self.part(item, at, item[2], self._loss(item, at, item[2]))
        self._push(item)
        while len(self.items) >= self.window:
            yield self._fill()

    def _fill(self) -> list:
        left, out = self.limits.copy(), []
        weights = 1 / self.limits**2
        while self.items:
            need = self.need[: len(self.items)]
            score = need @ (left * weights)
            score[(need > left).any(axis=1)] = -1
            k = int(score.argmax())
            if score[k] < 0:
                break
            left -= self.need[k]
            out.append(self._pop(k))
        if self.cut and self.items and left[0] > 0 and left[1] >= 1:
            k = int(np.argmax(self.need[: len(self.items), 0]))
            item, room = self.items[k], int(left[0])
            while room and self._loss(item, 0, room) > left[2]:
                room -= 1
            if 0 < room < item[2]:
                self._pop(k)
                out.append(self.part(item, 0, room, self._loss(item, 0, room)))
                self._push(self.part(item, room, item[2], self._loss(item, room, item[2])))
        return out

    def finish(self) -> Iterator[list]:
        while self.items:
            yield self._fill()

    def shorter(self, pieces: list) -> Iterator[list]:
        """A sequence, or with ``cut`` a short one as several whose lengths are powers of two."""
        n = sum(p[2] for p in pieces)
        if not self.cut or n >= self.limits[0] or n & (n - 1) == 0:
            yield pieces
            return
        pieces = pieces[::-1]
        while n:
            room = 1 << (n.bit_length() - 1)
            n -= room
            out = []
            while room:
                p = pieces.pop()
                if p[2] > room:
                    pieces.append(self.part(p, room, p[2], self._loss(p, room, p[2])))
                    p = self.part(p, 0, room, self._loss(p, 0, room))
                out.append(p)
                room -= p[2]
            yield out

    def rows(self, sequences: Iterator[list], first: int) -> Iterator[tuple]:
        for s in sequences:
            if not self.cut and self.beyond(s[0]):
                yield s[0][0], 0, s[0][2], None, s[0][4], None, None
                continue
            for t in self.shorter(s):
                at = 0
                for key, start, length, _, whole, data in t:
                    yield key, start, length, zlib.crc32(data) if data is not None else None, whole, first + self.sequence, at
                    at += length
                self.sequence += 1


SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def _packed(rows: DataFrame, items, **limits) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer, first = Packer(**limits), TaskContext.get().partitionId() << 40
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        wait: list = []
        for b in _then_end(batches):
            sequences = packer.finish() if b is None else (s for item in items(b) for s in packer.add(item))
            wait += packer.rows(sequences, first)
            if wait and (b is None or len(wait) >= 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*wait, strict=True)], names)
                wait = []

    small_batches(rows.sparkSession)
    return rows.mapInArrow(lean(run, tokens=True), SCHEMA)


def _then_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def pack_texts(docs: DataFrame, path: str, end_id: int = 1, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """Pieces of every whole text in sequences: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Each task packs its own rows, so nothing is shuffled, and holds ``WINDOW`` items of at most a sequence's length
    each. At most one sequence a task ends short, and that is split at powers of two. Every token of a running text
    bears loss. Sequence ids are unique over the table: task, then count.

    Null text is empty: a document of the end id alone. Null and repeated keys are packed like others; an empty table
    gives no rows. Other columns are ignored.
    """
    end = np.asarray([end_id], "<u4").tobytes()

    def items(b: pa.RecordBatch) -> Iterator[tuple]:
        ids = pieces_of(path, spaced_pieces).ids([x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()])
        for k, data in zip(b.column(0).to_pylist(), ids, strict=True):
            n = len(data) // 4 + 1
            yield k, 0, n, n, n, data + end

    return _packed(docs.select(F.col(key), F.col(text)), items, **limits)


def pack_counts(examples: DataFrame, **limits) -> DataFrame:
    """Pack whole examples of known size: ``doc_id, tokens, loss_tokens`` in, rows as of ``pack_texts`` out.

    Nothing is cut. An example beyond a limit by itself has a row whose ``sequence_id`` and ``offset`` are null, and is in no
    sequence. Null counts are 0. Null and repeated keys are packed like others; an empty table gives no rows. Other columns
    are ignored. A task packs its own rows, so each can leave one sequence that isn't full.
    """

    def items(b: pa.RecordBatch) -> Iterator[tuple]:
        for k, n, loss in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            yield k, 0, n or 0, loss or 0, n or 0, None

    return _packed(examples.select("doc_id", F.col("tokens").cast("bigint"), F.col("loss_tokens").cast("bigint")), items, cut=False, **limits)


def pack_conversations(turns: DataFrame, path: str, end_id: int = 1, role: str = "assistant", **limits) -> DataFrame:
    """Pack whole conversations ``conv_id, role, text``: ``conv_id, n_tokens, n_loss, n_turns, sequence_id, offset``.

    A turn's tokens are its ids and ``end_id``; those of ``role`` bear loss. Turns are counted where they are and only sums
    are shuffled, so a conversation that a third of all turns belong to is one row there. A conversation beyond a limit by
    itself has a null ``sequence_id``. Null texts are empty; turns without ``conv_id`` are one conversation, whose id is
    null; of a null role no token bears loss.
    """

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = pieces_of(path, spaced_pieces).ids([x or b"" for x in b.column(2).cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) // 4 + 1 for x in ids], pa.int64())], ["conv_id", "role", "n"])

    small_batches(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("bigint"), F.col("role").cast("string"), F.col("text")).mapInArrow(lean(sizes, tokens=True), "conv_id bigint, role string, n bigint")
    loss = F.sum(F.when(F.col("role") == role, F.col("n")).otherwise(0))
    sums = written(rows.groupBy("conv_id").agg(F.sum("n").alias("tokens"), loss.alias("loss_tokens"), F.count("*").alias("n_turns")), "conversations")
    packed = pack_counts(sums.withColumnRenamed("conv_id", "doc_id"), **limits).select("doc_id", "sequence_id", "offset")
    sums = sums.select("conv_id", F.col("tokens").alias("n_tokens"), F.col("loss_tokens").alias("n_loss"), "n_turns")
    return sums.join(packed, F.col("conv_id").eqNullSafe(F.col("doc_id"))).drop("doc_id")
