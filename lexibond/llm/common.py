"""Helpers that several operators share."""

import contextlib
import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexibond.sources.work import store

#: White space of the contracts: a space and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes handed to a Python worker at a time; long texts make the second the binding one.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at a time: the one setting that all operators share, whichever ran last."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def lean(run: Callable[[Iterator], Iterator], tokens: bool = False) -> Callable[[Iterator], Iterator]:
    """A worker's function that gives memory back: idle workers stay for the next stage, and hold what their allocators keep.

    Vocabularies' caches go before the first batch, unless the function is one of those that need them (``tokens``).
    """

    def work(batches: Iterator) -> Iterator:
        if not tokens:
            drop_pieces()
        try:
            yield from run(batches)
        finally:
            give_back()

    return work


def drop_pieces() -> None:
    """Let the worker's vocabularies go."""
    _workers.clear()


def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for the jobs that run within the block."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing if there is none."""
    fs, p = store(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def read_small(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    fs, p = store(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_small(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small file, whole or not at all; False if it exists. Atomic where the store's rename is."""
    fs, p = store(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(part, False)
    out.write(bytearray(text.encode()))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    none = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    files = hadoop.FileContext.getFileContext(fs.makeQualified(p).toUri(), spark._jsc.hadoopConfiguration())
    try:
        files.rename(fs.makeQualified(part), fs.makeQualified(p), none)
    except Py4JJavaError:
        fs.delete(part, False)
        if fs.exists(p):
            return False
        raise
    return True


#: Rows of a table that is broadcast, at most; a longer one is joined by a shuffle. With 100 bytes a row that is 50 MB.
FEW = 500_000
#: A key with more rows than this, and than ``SHARE`` of all, is hot; so there are at most 1 / SHARE hot keys.
HOT, SHARE = 100, 1e-5


def few(df: DataFrame) -> DataFrame:
    """``written`` rows, marked for a broadcast if they are counted to be few."""
    return F.broadcast(df) if df.count() <= FEW else df


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` with the columns of their group; ``groups`` has a row for each key, with the number of its rows.

    Hot keys' groups are broadcast, 100,000 at most, and their rows stay where they are; the others are shuffled.
    """
    most = max(HOT, total * SHARE)
    columns = [c for c in groups.columns if c != key]
    hot = groups.where(F.col(size) > most).select(key, F.struct(*columns).alias("_hot"))
    marked = rows.join(F.broadcast(hot), key, "left")
    own = marked.where("_hot is not null").select(*rows.columns, *(F.col(f"_hot.{c}").alias(c) for c in columns))
    others = marked.where("_hot is null").drop("_hot").hint("merge").join(groups.where(F.col(size) <= most), key)
    return own.unionByName(others.select(*rows.columns, *columns))


def input_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of a text column, summed over all rows (a column scan without a shuffle of rows)."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("b")).first()["b"]


def joined(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[np.ndarray]]:
    """Columns of numbers, so many rows or a few more at a time."""
    wait, n = [], 0
    for b in batches:
        wait.append(b)
        n += b.num_rows
        if n >= rows:
            yield [np.concatenate([x.column(i).to_numpy(zero_copy_only=False) for x in wait]) for i in range(b.num_columns)]
            wait, n = [], 0
    if n:
        yield [np.concatenate([x.column(i).to_numpy(zero_copy_only=False) for x in wait]) for i in range(wait[0].num_columns)]


def map_text(df: DataFrame, key: str, text: str, schema: str, make: Callable[[], Callable[[list, list[bytes]], dict | None]]) -> DataFrame:
    """Map batches of (key, text as UTF-8; null as empty) to columns of ``schema``.

    ``make`` runs once a task and returns the function of a batch; that gives a dict of columns.
    """
    small_batches(df.sparkSession)
    names = [x.strip().split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for b in batches:
            keys = b.column(0).to_pylist()
            texts = [x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()]
            if (out := work(keys, texts)) is not None:
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (out[n] for n in names)], names)

    return df.select(F.col(key), F.col(text)).mapInArrow(lean(run, tokens=True), schema)


def filter_text(docs: DataFrame, text: str, make: Callable[[], Callable[[list[bytes]], list[bool]]]) -> DataFrame:
    """The rows that a function of their texts keeps, with all columns; ``make`` runs once a task."""
    small_batches(docs.sparkSession)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for b in batches:
            yield b.filter(pa.array(keep([x or b"" for x in b.column(place).cast(pa.binary()).to_pylist()]), pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def lower_ascii(column) -> F.Column:
    """Lower-case A to Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


_WIDE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
#: Text bytes whose pieces are looked up together: one by one, or each distinct one once.
GROUP_BYTES, LINE_BYTES = 1 << 20, 2 << 20
#: White space beyond ASCII, then ASCII white space.
_MIXED = re.compile(rb"(?:\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)[\x20\x09-\x0d]")
_SPACED = re.compile(rb"[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
#: Classes of bytes: 1 ASCII letters and digits, 2 second bytes of Latin-1 letters, 4 full stop and comma, 8 space and line
#: end, 16 other ASCII white space and the three bytes that mark keys, 32 first bytes of wider white space, 64 that of Latin-1.
_CLASS = bytearray(256)
for _bytes, _class in (
    (b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (bytes(set(range(0x80, 0xC0)) - {0x97, 0xB7}), 2), (b".,", 4),
    (b" \n", 8), (b"\x00\x01\x02\t\x0b\x0c\r", 16), (b"\xc2\xe1\xe2\xe3", 32), (b"\xc3", 64),
):
    for _x in _bytes:
        _CLASS[_x] = _class
_CLASS = bytes(_CLASS)


def _cut_marks(text: bytes, kind: bytes, mark: bytes) -> bytes:
    """Set full stops and commas that end a word apart, if all of them follow an ASCII letter or digit or a Latin-1 letter."""
    n = kind.count(b"\x04\x08")
    if n and n == kind.count(b"\x01\x04\x08") + kind.count(b"\x40\x02\x04\x08"):
        for x in (b". ", b", ", b".\n", b",\n"):
            text = text.replace(x, b" " + mark + x)
    return text


def spaced_line(text: bytes) -> bytes | None:
    """The pieces that ``spaced_pieces`` gives, with a space between; None if some may hold spaces."""
    kind = text.translate(_CLASS)
    if b"\x10" in kind or b"\x08\x08" in kind or b"\x20" in kind and any(x in text for x in _WIDE):
        return None
    return b"\x01" + _cut_marks(text, kind, b"\x01").replace(b"\n", b" \x00")


def spaced_pieces(text: bytes) -> list[bytes]:
    """Cut a text before white space so that byte-level BPE of the pieces gives the ids of the whole; see ``plain``.

    That pre-tokenizer never runs on from a letter, digit or mark into white space, nor from a letter into a mark, and
    what it makes of white space depends on that run and on whether something follows. A run that mixes other white
    space with ASCII would be cut within; such a text stays whole. The pieces are keys: a first byte 0 stands for a
    line end, 1 for nothing, 2 for a piece that is given as it is, and none of these for a space.
    """
    kind = text.translate(_CLASS)
    if b"\x20" in kind and any(x in text for x in _WIDE) and _MIXED.search(text):
        return [b"\x02" + text]
    if b"\x10" in kind or b"\x08\x08" in kind:
        return [b"\x02" + x for x in _SPACED.findall(text)]
    return (b"\x01" + _cut_marks(text, kind, b"\x01").replace(b"\n", b" \x00")).split(b" ")


def space_dropped_pieces(text: bytes) -> list[bytes]:
    """Cut at ASCII white space, for vocabularies that drop white space and lower-case; keys as of ``spaced_pieces``.

    Special tokens' names are in lower case and hold '<|': where that occurs, letters stay as they are.
    """
    kind = text.translate(_CLASS)
    if b"<|" in text:
        return [b"\x02" + x for x in text.split()]
    if b"\x10" in kind:
        return [b"\x02" + x for x in text.lower().split()]
    return _cut_marks(text.lower(), kind, b"").split()


def space_dropped_line(text: bytes) -> bytes | None:
    """As of ``spaced_line``, for ``space_dropped_pieces``; empty pieces, which have no ids, may be among them."""
    kind = text.translate(_CLASS)
    if b"<|" in text or b"\x10" in kind:
        return None
    return _cut_marks(text.lower(), kind, b"").replace(b"\n", b" ")


_LINES = {spaced_pieces: spaced_line, space_dropped_pieces: space_dropped_line}


def pieces_of_lines(lines: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All lines' pieces as one array, and where each line's end in it."""
    data = np.frombuffer(b" ".join([*lines, b""]), np.uint8)
    space = data == 32
    at = np.flatnonzero(space)
    offsets = np.zeros(len(at) + 1, np.int32)
    offsets[1:] = at - np.arange(len(at))
    ends = np.searchsorted(at, np.cumsum([len(x) + 1 for x in lines]) - 1) + 1
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data[~space])]), ends


def plain(piece: bytes) -> bytes:
    """The text of a piece."""
    first = piece[:1]
    if first in (b"\x01", b"\x02"):
        return piece[1:]
    return b"\n" + piece[1:] if first == b"\x00" else b" " + piece


class Pieces:
    """Ids of pieces, cached in the worker: little-endian 32-bit ids as bytes.

    Beyond ``limit`` pieces the cache becomes the older one, of which pieces that occur again are taken over; so twice
    ``limit`` are held at most, and frequent ones stay. Pieces that are missing are encoded together, a batch at a time.
    """

    def __init__(self, path: str, cut: Callable[[bytes], list[bytes]], limit: int = 400_000) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.cut, self.limit, self.known, self.older = Tokenizer.from_file(path), cut, limit, {}, {}
        self.tokenizer.model._resize_cache(0)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.separator, self.between = self._separator()

    def _separator(self) -> tuple[str, int | None]:
        """A text that parts pieces without a change to their ids, and its one id: a line end or else a special token."""
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        for x in ("\n", *(str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values() if t.special)):
            own = ids(f"a{x}b")
            if len(own) == 3 and own[::2] == [*ids("a"), *ids("b")] and (x == "\n" or x.startswith("<|")):
                return x, own[1]
        return "", None

    def learn(self, pieces: list[bytes]) -> None:
        """Encode pieces and keep their values.

        Pieces of letters and marks are encoded many at a time, with a separator before each whose id parts them again;
        where that is a line end, it counts to a piece that starts with one. A group that doesn't come out in as many parts,
        and pieces that hold white space, are encoded piece by piece.
        """
        kinds = b"\x02" if self.separator == "\n" else b"\x00\x02"
        alone = [p for p in pieces if not p or p[0] in kinds or p == b"\x00"] if self.between is not None else list(pieces)
        if len(alone) < len(pieces):
            others = set(alone)
            rest = [p for p in pieces if p not in others] if alone else pieces
            separator = self.separator.encode()
            groups = [rest[i : i + 256] for i in range(0, len(rest), 256)]
            texts = [separator + separator.join([p[1:] if p[0] < 3 else b" " + p for p in g]) for g in groups]
            plainly = [not any(x in t for x in _WIDE) and t.count(b"<|") == len(g) * separator.count(b"<|") for t, g in zip(texts, groups, strict=True)]
            for g, e, ok in zip(groups, self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False), plainly, strict=True):
                ids = np.array(e.ids, "<u4")
                cuts = np.flatnonzero(ids == self.between)
                if ok and len(cuts) == len(g):
                    self.known.update(zip(g, self.parts(ids, cuts + [p[0] != 0 for p in g], np.r_[cuts[1:], len(ids)]), strict=True))
                else:
                    alone += g
        for p, e in zip(alone, self.tokenizer.encode_batch_fast([plain(p).decode("utf-8", "replace") for p in alone], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            self.known[p] = self.parts(ids, np.array([0]), np.array([len(ids)]))[0]

    def parts(self, ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> list:
        """The values of stretches of ids."""
        data = ids.tobytes()
        return [data[i:j] for i, j in zip((4 * start).tolist(), (4 * end).tolist(), strict=True)]

    def values(self, texts: list[bytes]) -> Iterator[Iterator]:
        """Each text's pieces as values, a few texts at a time, so that their pieces stay in the processor's cache."""
        group, size = [], 0
        for i, t in enumerate(texts):
            group.append(self.cut(t))
            size += len(t)
            if size >= GROUP_BYTES or i + 1 == len(texts):
                missing = set()
                for p in group:
                    missing.update(p)
                missing = missing.difference(self.known)  # looks each piece up once, in C
                if missing and self.older:
                    again = missing.intersection(self.older)
                    self.known.update(zip(again, map(self.older.__getitem__, again), strict=True))
                    missing -= again
                if missing:
                    self.learn(list(missing))
                get = self.known.__getitem__
                for p in group:
                    yield map(get, p)
                self.trim()
                group, size = [], 0

    def trim(self) -> None:
        if len(self.known) > self.limit:
            self.known, self.older = {}, self.known

    def found(self, pieces: list[bytes]) -> list:
        """The values of distinct pieces."""
        values = list(map(self.known.get, pieces))
        if None in values:
            at = [i for i, v in enumerate(values) if v is None]
            missing = [pieces[i] for i in at]
            if self.older:
                again = [(p, v) for p, v in zip(missing, map(self.older.get, missing), strict=True) if v is not None]
                self.known.update(again)
                self.learn([p for p in missing if p not in self.known] if again else missing)
            else:
                self.learn(missing)
            for i, v in zip(at, map(self.known.__getitem__, missing), strict=True):
                values[i] = v
        return values

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text. Each distinct piece of ``LINE_BYTES`` of texts is looked up once, and the rest is array work."""
        out: list[bytes] = [b""] * len(texts)
        line = _LINES.get(self.cut)
        places, lines, lists, size = [], [], [], 0
        for i, t in enumerate(texts):
            own = line(t) if line else None
            if own is None:
                lists.append((i, self.cut(t)))
            else:
                places.append(i)
                lines.append(own)
            size += len(t)
            if size >= LINE_BYTES or i + 1 == len(texts):
                self._group_ids(places, lines, lists, out)
                places, lines, lists, size = [], [], [], 0
        return out

    def _group_ids(self, places: list[int], lines: list[bytes], lists: list[tuple[int, list[bytes]]], out: list[bytes]) -> None:
        pieces, ends = pieces_of_lines(lines)
        if lists:
            pieces = pa.concat_arrays([pieces, pa.array([p for _, own in lists for p in own], pa.binary())])
            ends = np.r_[ends, (ends[-1] if len(ends) else 0) + np.cumsum([len(own) for _, own in lists])]
        coded = pieces.dictionary_encode()
        codes = coded.indices.to_numpy()
        values = self.found(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        many = np.fromiter(map(len, values), np.int64, len(values)) // 4
        first = np.cumsum(many) - many
        flat = np.frombuffer(b"".join(values), "<u4")
        self.trim()
        n = many[codes]
        upto = np.cumsum(n)
        data = flat[np.repeat(first[codes] - upto + n, n) + np.arange(upto[-1] if len(upto) else 0)].tobytes()
        cuts = np.r_[0, np.r_[0, upto][ends]] * 4
        for i, a, b in zip([*places, *(i for i, _ in lists)], cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            out[i] = data[a:b]


_workers: dict = {}


def pieces_of(path: str, cut: Callable[[bytes], list[bytes]], kind: type = Pieces) -> Pieces:
    """The worker's cache for a vocabulary; it lives on from task to task, until another operator's ``lean`` function runs."""
    if (key := (path, cut.__name__, kind.__name__)) not in _workers:
        _workers[key] = kind(path, cut)
    return _workers[key]
