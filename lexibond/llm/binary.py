"""Token ids as files of compressed bit or byte planes with a chunk index.

One file::

    magic    8 bytes
    chunks   each ``BLOCK`` ids (the last fewer): the planes, each a zstandard frame
    docs     zstandard of doc ids (8 bytes each), lengths (4 bytes each) and 1, or 0 for a null id (1 byte each)
    index    zstandard of, for each chunk: offset (8), ids (4), then the plane sizes (4 each)
    footer   offsets of docs and index, numbers of docs, chunks, ids and planes, kind of plane, magic

All numbers are little-endian. A chunk can be read alone from its index entry.
"""

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexibond.llm.common import input_bytes, pieces_of, small_batches, space_dropped_pieces, spaced_pieces
from lexibond.sources.work import workspace

MAGIC = b"IDPLANE2"
FOOTER = struct.Struct("<QQQQQBB8s")
BLOCK = 1 << 16
#: Text bytes that one file takes.
FILE_BYTES = 64 << 20


def to_planes(ids: np.ndarray, planes: int, bits: bool) -> list[bytes]:
    """The ids' bytes or bits, those of one rank together; lowest first."""
    data = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [data[:, k].tobytes() for k in range(planes)]
    flat = np.unpackbits(data[:, : (planes + 7) // 8], axis=1, bitorder="little")
    return [np.packbits(flat[:, k]).tobytes() for k in range(planes)]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    """Ids of planes."""
    if not bits:
        data = np.zeros((n, 4), np.uint8)
        for k, p in enumerate(planes):
            data[:, k] = np.frombuffer(p, np.uint8)
        return data.reshape(-1).view("<u4")
    flat = np.zeros((n, 32), np.uint8)
    for k, p in enumerate(planes):
        flat[:, k] = np.unpackbits(np.frombuffer(p, np.uint8), count=n)
    return np.packbits(flat, axis=1, bitorder="little").reshape(-1).view("<u4")


class PlaneWriter:
    """Writes one file; holds one chunk and the document table."""

    def __init__(self, out, planes: int, bits: bool, level: int = 3) -> None:
        self.out, self.planes, self.bits, self.at = out, planes, bits, 0
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.wait, self.waiting = [], 0
        self.index, self.doc_ids, self.lengths, self.n = io.BytesIO(), [], [], 0
        self.chunks = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.n += len(ids) // 4
        self.wait.append(ids)
        self.waiting += len(ids) // 4
        if self.waiting >= BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.wait), "<u4")
        for i in range(0, len(ids), BLOCK):
            chunk = ids[i : i + BLOCK]
            if len(chunk) < BLOCK and not last:
                break
            parts = [self.zstd.compress(p) for p in to_planes(chunk, self.planes, self.bits)]
            self.index.write(struct.pack(f"<QI{self.planes}I", self.at, len(chunk), *map(len, parts)))
            self.chunks += 1
            for p in parts:
                self._put(p)
        rest = ids[len(ids) - len(ids) % BLOCK :] if not last else ids[:0]
        self.wait, self.waiting = [rest.tobytes()], len(rest)

    def close(self) -> None:
        self._flush(True)
        docs_at = self.at
        known = np.array([d is not None for d in self.doc_ids], np.uint8)
        self._put(self.zstd.compress(np.array([d or 0 for d in self.doc_ids], "<i8").tobytes() + np.asarray(self.lengths, "<u4").tobytes() + known.tobytes()))
        index_at = self.at
        self._put(self.zstd.compress(self.index.getvalue()))
        self._put(FOOTER.pack(docs_at, index_at, len(self.doc_ids), self.chunks, self.n, self.planes, self.bits, MAGIC))


class PlaneReader:
    """Reads one file, a chunk at a time."""

    def __init__(self, file) -> None:
        self.file = file
        size = file.size()
        docs_at, index_at, self.n_docs, self.n_chunks, self.n, self.planes, self.bits, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a file of id planes")
        self.zstd = zstandard.ZstdDecompressor()
        docs = self.zstd.decompress(self._at(docs_at, index_at - docs_at), max_output_size=13 * self.n_docs + 1)
        ids, known = np.frombuffer(docs[: 8 * self.n_docs], "<i8"), docs[12 * self.n_docs :]
        self.doc_ids = [d if k else None for d, k in zip(ids.tolist(), known, strict=True)]
        self.lengths = np.frombuffer(docs[8 * self.n_docs : 12 * self.n_docs], "<u4")
        entry = struct.Struct(f"<QI{self.planes}I")
        index = self.zstd.decompress(self._at(index_at, size - FOOTER.size - index_at), max_output_size=entry.size * self.n_chunks + 1)
        self.index = list(entry.iter_unpack(index))

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def chunk(self, k: int) -> np.ndarray:
        at, n, *sizes = self.index[k]
        data, out, i = self._at(at, sum(sizes)), [], 0
        most = -(-n // 8) if self.bits else n
        for s in sizes:
            out.append(self.zstd.decompress(data[i : i + s], max_output_size=most + 1))
            i += s
        return from_planes(out, n, self.bits)

    def documents(self) -> Iterator[tuple[int | None, bytes, int]]:
        """``doc_id, ids as bytes, first id's place in the file`` in order; holds a document and a chunk."""
        k, rest, start = 0, b"", 0
        for doc_id, length in zip(self.doc_ids, self.lengths.tolist(), strict=True):
            parts, have = [rest], len(rest)
            while have < 4 * length:
                part = self.chunk(k).tobytes()
                k += 1
                parts.append(part)
                have += len(part)
            data = b"".join(parts)
            yield doc_id, data[: 4 * length], start
            rest = data[4 * length :]
            start += length


def write_ids(docs: DataFrame, path: str, out: str, end_id: int = 1, drops_space: bool = True, planes: int = 2, bits: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text, append ``end_id``, write files in ascending key order; returns their manifest.

    Texts are range-partitioned by key once and encoded where they arrive. Each task writes its file under a name
    of its own attempt, so a task that is repeated or speculative leaves a stray file and no wrong one; only files
    in the manifest count. It has a row for each file: ``part, file, n_docs, n_ids``. ``planes``: bytes (bits, with
    ``bits``) of an id that are kept; an id beyond that is an error. ``out`` may be in any store that pyarrow opens.

    Null text is empty and gets its end id. Null keys come first; rows that share a key come in the order of their texts'
    hashes, and may be dealt to several files. An empty table gives no files. Other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    parts = max(1, -(-input_bytes(docs, text) // FILE_BYTES), min(64, spark.sparkContext.defaultParallelism))
    top = 1 << (planes if bits else 8 * planes)
    cut = space_dropped_pieces if drops_space else spaced_pieces
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pieces, writer, stream = pieces_of(path, cut), None, None
        for b in batches:
            for k, ids in zip(b.column(0).to_pylist(), pieces.ids([x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()]), strict=True):
                if len(ids) and np.frombuffer(ids, "<u4").max() >= top:
                    raise ValueError(f"an id needs more than {planes} planes")
                if writer is None:
                    fs, base = pafs.FileSystem.from_uri(_uri(out))
                    fs.create_dir(base, recursive=True)
                    part = TaskContext.get().partitionId()
                    name = f"{part:06d}-{uuid.uuid4().hex}.idp"
                    stream = fs.open_output_stream(f"{base}/{name}")
                    writer = PlaneWriter(stream, planes, bits)
                writer.add(k, ids + end)
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([len(writer.doc_ids)]), pa.array([writer.n])], ["part", "file", "n_docs", "n_ids"])

    rows = docs.select(F.col(key).cast("bigint").alias("_key"), F.col(text).alias("_text")).withColumn("_copy", F.xxhash64("_text"))
    rows = rows.repartitionByRange(parts, "_key", "_copy").sortWithinPartitions("_key", "_copy").select("_key", "_text")
    made = rows.mapInArrow(run, "part int, file string, n_docs bigint, n_ids bigint").collect()
    return spark.createDataFrame(sorted(made), "part int, file string, n_docs bigint, n_ids bigint")


def _uri(path: str) -> str:
    """``file:/x`` as Hadoop writes it, for pyarrow."""
    return "file://" + path[5:].lstrip("/").join(("/", "")) if path.startswith("file:/") else path


def read_ids(manifest: DataFrame, out: str, key: str = "doc_id") -> DataFrame:
    """``key, start, n_tokens, ids_crc32`` of every document in the files, a file a task.

    The manifest is as long as there are files, so the driver sums it to the files' first places.
    """
    spark = manifest.sparkSession
    files, base = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r["part"]):
        files.append((r["file"], base))
        base += r["n_ids"]
    schema = f"{key} bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    if not files:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, root = pafs.FileSystem.from_uri(_uri(out))
                with fs.open_input_file(f"{root}/{name}") as file:
                    rows = [(d, first + at, len(ids) // 4, zlib.crc32(ids)) for d, ids, at in PlaneReader(file).documents()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], [x.split()[0] for x in schema.split(", ")])

    return spark.createDataFrame(spark.sparkContext.parallelize(files, len(files)), "file string, base bigint").mapInArrow(run, schema)


def binary_round_trip(docs: DataFrame, path: str, bits: bool = False) -> DataFrame:
    """Write all documents' ids to the shared folder and read them back."""
    out = workspace(docs.sparkSession, "ids")
    return read_ids(write_ids(docs, path, out, bits=bits, planes=16 if bits else 2), out)
