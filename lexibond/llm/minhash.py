"""Near copies by Jaccard similarity of word shingles: MinHash bands find candidates, whole shingle sets decide."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexibond.llm.common import few, lean, small_batches
from lexibond.llm.components import components
from lexibond.sources.work import forget, written

#: Words in a shingle and least similarity of near copies.
SHINGLE, SIMILARITY = 5, 0.8
#: Bands and MinHashes in a band: two texts of similarity 0.8 share no band with a chance of 0.0008.
BANDS, ROWS = 18, 5
#: Shingles of one candidate group that a task compares; a larger group is dealt out to cells of two blocks.
GROUP = 1_000_000
_MIX = np.random.default_rng(7).integers(1, 1 << 63, BANDS * ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Shingles:
    """A text's distinct shingles as sorted 64-bit hashes; words are lower-cased (ASCII) and cached in the worker."""

    def __init__(self, limit: int = 100_000) -> None:
        self.limit, self.known = limit, {}

    def of(self, text: bytes, shingle: int = SHINGLE) -> np.ndarray:
        import xxhash

        words, known = text.lower().split(), self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if len(known) > self.limit:
            known.clear()
        n = max(1, len(codes) - shingle + 1) if len(codes) else 0
        out = np.zeros(n, np.uint64)
        for i in range(min(shingle, len(codes))):
            out = (out ^ (out >> np.uint64(29))) * _ODD + codes[i : i + n]
        return np.unique((out ^ (out >> np.uint64(32))) * _ODD)


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """A row of band keys for each set; sets without shingles have keys of their own."""
    sizes = np.array([len(s) for s in sets])
    full = np.flatnonzero(sizes)
    out = np.zeros((len(sets), BANDS), np.uint64)
    if len(full):
        flat, first = np.concatenate([sets[i] for i in full]), np.r_[0, np.cumsum(sizes[full])[:-1]]
        for b in range(BANDS):
            key = np.full(len(full), b + 1, np.uint64)
            for m in _MIX[b * ROWS : (b + 1) * ROWS]:
                x = flat * m
                key = (key ^ (key >> np.uint64(29))) * _ODD + np.minimum.reduceat(x ^ (x >> np.uint64(32)), first)
            out[full, b] = key
    return out


def set_links(sets: list[np.ndarray], similarity: float = SIMILARITY) -> Iterator[tuple[int, np.ndarray]]:
    """A spanning forest of the pairs of sets that are similar enough, as a set and those linked to it.

    Breadth first, with counts of common shingles from an inverted index: a cloud of near copies gives a link for each
    member and not one for each pair.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    left = np.ones(len(sets), bool)

    def index() -> tuple[np.ndarray, np.ndarray]:
        """Shingles of the sets that aren't reached yet, in order, and whose each is."""
        rest = np.flatnonzero(left)
        flat = np.concatenate([sets[i] for i in rest]) if len(rest) else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        return flat[order], np.repeat(rest, sizes[rest])[order]

    (flat, owner), held, rest = index(), len(sets), len(sets)
    for k in range(len(sets)):
        if not left[k]:
            continue
        front, left[k] = [k], False
        rest -= 1
        while front and rest:
            if 2 * rest < held:
                (flat, owner), held = index(), rest
            i = front.pop()
            lo, hi = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
            n = hi - lo
            common = np.bincount(owner[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(sets))
            near = np.flatnonzero(left & (common >= similarity * (sizes + sizes[i] - common) - 1e-9))
            if len(near):
                left[near] = False
                rest -= len(near)
                yield i, near
                front.extend(near.tolist())


def shingle_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", fingerprint: Callable[[bytes], int] | None = None) -> DataFrame:
    """``id, t, h, n, bands``: the row's key and hash of its text, digest and size of its shingle set, band keys.

    ``fp`` follows where a function ``fingerprint`` of the text is given. Rows without a key are left out.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        own = Shingles()
        for b in batches:
            h, n, fps, keys = [], [], [], [np.zeros((0, BANDS), np.uint64)]
            texts = b.column(2).cast(pa.binary())
            for i in range(0, len(texts), 20):  # few sets at a time, which stay in the processor's cache
                some = [x.as_py() or b"" for x in texts[i : i + 20]]
                if fingerprint is not None:
                    fps += map(fingerprint, some)
                sets = [own.of(x) for x in some]
                h += [xxhash.xxh64_intdigest(s.tobytes()) for s in sets]
                n += [len(s) for s in sets]
                keys.append(bands(sets))
            keys = np.concatenate(keys).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
            codes = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in ([h] if fingerprint is None else [h, fps])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), codes[0], pa.array(n, pa.int64()), lists, *codes[1:]], names)

    schema = "id bigint, t bigint, h bigint, n bigint, bands array<bigint>" + (", fp bigint" if fingerprint is not None else "")
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint"), F.xxhash64(text), F.col(text)).mapInArrow(lean(run), schema)


def _sets(texts: DataFrame) -> DataFrame:
    """``g, cell, h, s`` of ``g, cell, h, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Shingles()
        for b in batches:
            sets = [own.of(x or b"").tobytes() for x in b.column(3).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sets, pa.binary())], ["g", "k", "h", "s"])

    return texts.mapInArrow(lean(run), "g bigint, k bigint, h bigint, s binary")


def _links(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Links from rows ``g, cell, h, s`` that come sorted by group and cell."""
    at, own, sets = None, [], []

    def work():
        for i, near in set_links(sets, similarity):
            yield pa.RecordBatch.from_arrays([pa.array([own[i]] * len(near), pa.int64()), pa.array([own[j] for j in near], pa.int64())], ["u", "v"])

    for b in batches:
        for g, cell, h, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (g, cell) != at:
                yield from work()
                at, own, sets = (g, cell), [], []
            own.append(h)
            sets.append(np.frombuffer(s, np.uint64))
    yield from work()


def similar_links(docs: DataFrame, rows: DataFrame, similarity: float = SIMILARITY, group: int = GROUP, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``u, v``: links between digests of shingle sets that connect all sets of the written ``shingle_rows`` that are similar enough.

    Equal sets are one class, of which one row takes part in the search. Classes that share a band are candidates;
    components of those are compared whole, set by set, so the similarity is exact and a pair is missed only if no chain
    of bands connects it.
    """
    keys = rows.where("n > 0").select(F.explode("bands").alias("key"), "h")
    shared = written(keys.groupBy("key").agg(F.min("h").alias("m"), F.max("h").alias("most")).where("m <> most").select("key", "m"), "shared-bands")
    edges = keys.join(few(shared), "key").where("h <> m").select(F.col("h").alias("u"), F.col("m").alias("v"))
    found = components(edges).select(F.col("node").alias("h"), F.col("root").alias("g"))
    found = rows.select("id", "t", "h", "n").join(found, "h").groupBy("g", "h", "n").agg(F.min(F.struct("id", "t")).alias("row"))
    found = written(found, "candidates")
    forget(shared)
    blocks = found.groupBy("g").agg(F.sum("n").alias("all")).select("g", F.when(F.col("all") > group, F.ceil(F.col("all") * 2 / group)).otherwise(1).cast("bigint").alias("k"))
    dealt = written(found.join(blocks, "g").select("g", "k", "h", F.col("row.id").alias("id"), F.col("row.t").alias("t")), "dealt")
    texts = docs.select(F.col(key).cast("bigint").alias("id"), F.xxhash64(text).alias("t"), F.col(text).alias("text")).join(few(dealt), ["id", "t"])  # only the texts of candidates move
    held = written(_sets(texts.select("g", "k", "h", "text")), "shingle-sets")
    sets = held.withColumn("own", F.pmod(F.xxhash64("h"), F.col("k")))
    cells = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1), lambda c: F.least(c, F.col("own")) * F.col("k") + F.greatest(c, F.col("own")))
    cells = sets.select("g", F.explode(cells).alias("cell"), "h", "s").repartition("g", "cell").sortWithinPartitions("g", "cell")
    links = written(cells.mapInArrow(lean(lambda b: _links(b, similarity)), "u bigint, v bigint"), "set-links")
    forget(held, found, dealt)
    return links


def least_of_groups(docs: DataFrame, rows: DataFrame, groups: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that have the smallest key of their group or no key.

    ``rows`` are the written ``shingle_rows``, deleted here; ``groups`` is ``h, g`` of the sets that are linked to others.
    """
    found, rows = rows, written(rows.select("id", "t", "h").hint("merge").join(groups, "h", "left").select("id", "t", F.coalesce("g", "h").alias("g")), "groups")
    forget(found)
    least = rows.groupBy("g").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least <> most").select("g", "least")
    gone = written(rows.join(least, "g").where("id <> least").select(F.col("id").alias("_key"), F.col("t").alias("_t")).distinct(), "near-copies")
    forget(rows)
    return docs.join(few(gone), (F.col(key) == F.col("_key")) & (F.xxhash64(text) == F.col("_t")), "left_anti")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that have the smallest key of their group of near copies, or no key.

    Texts with fewer words than a shingle are one shingle; null and empty texts are near copies of each other alone.
    Rows that share a key but not a text are told apart. An empty table gives no rows.
    """
    rows = written(shingle_rows(docs, key, text), "shingle-rows")
    groups = components(similar_links(docs, rows, key=key, text=text, **options)).select(F.col("node").alias("h"), F.col("root").alias("g"))
    return least_of_groups(docs, rows, groups, key, text)
