"""SimHash fingerprints and near-duplicate groups through deletion-variant signatures."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexibond.llm.common import few, join_groups, joined, lean, map_text, small_batches
from lexibond.llm.components import components
from lexibond.sources.work import written

#: Words in a shingle, seed of its hash, and bits by which linked fingerprints may differ.
SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Rows of one variant key that one task compares; a larger bucket is dealt out to cells of two blocks.
BUCKET = 50_000
#: Rows that a task compares at a time; a bucket that goes on is kept for the next.
LINK_ROWS = 200_000


def segments(distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Bit ranges: so few segments that, of ``distance`` differing bits, one segment has at most one.

    Exact segments would take ``distance + 1``; with one wildcard bit ``distance // 2 + 1`` are enough.
    """
    n = distance // 2 + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a text: a bit is set if it is in over half the shingle hashes."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, n, 1 << 16):
        j = min(n, i + (1 << 16))
        last = ends[i + shingle - 1 : j + shingle - 1] if len(words) >= shingle else ends[-1:]
        h = np.fromiter((digest(whole[a:b], SEED) for a, b in zip(starts[i:j].tolist(), last.tolist(), strict=True)), np.uint64, j - i)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``key, fp`` (64 bits, signed) of every whole text."""

    def make():
        def work(keys, texts):
            fps = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            return {key: pa.array(keys, pa.int64()), "fp": pa.array(fps)}

        return work

    return map_text(docs, key, text, f"{key} bigint, fp bigint", make)


def _canonical(x: np.ndarray, p: int | np.ndarray, distance: int) -> np.ndarray:
    """Whether differing bits ``x`` are few enough and meet in the bucket of wildcard ``p`` and none before.

    Two fingerprints share buckets of every segment with at most one differing bit. Their own one is that of the
    first such segment: the differing bit's, or the segment's first bit's if none differs.
    """
    own, done = np.full(x.shape, -1, np.int64), np.zeros(x.shape, bool)
    for lo, hi in segments(distance):
        part = (x >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)
        n = np.bitwise_count(part)
        here = ~done & (n <= 1)
        bit = np.bitwise_count(np.where(part == 0, 1, part) - np.uint64(1)).astype(np.int64)
        own = np.where(here, lo + bit, own)
        done |= here
    return (np.bitwise_count(x) <= distance) & (own == p)


def bucket_links(p: int, fps: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links in one bucket, as index pairs.

    Breadth first: each fingerprint is compared with those that aren't reached yet, so a cloud of near copies
    gives a link for each member and not one for each pair.
    """
    rest = np.arange(len(fps))
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            i = front.pop()
            near = _canonical(fps[rest] ^ fps[i], p, distance)
            if near.any():
                found = rest[near]
                yield np.full(len(found), i), found
                front.extend(found)
                rest = rest[~near]


def _links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Links from rows ``key, cell, fp, rep`` that come sorted by key and cell."""
    key, cell, fp, rep = (np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.int64))

    def work(key, cell, fp, rep):
        if not len(key):
            return
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])])
        size = np.diff(np.r_[first, len(key)])
        run = np.repeat(np.arange(len(first)), size)
        small = size[run] <= 64
        a, b = [], []
        for s in range(1, int(min(64, size.max()))):
            i = np.flatnonzero((run[:-s] == run[s:]) & small[:-s])
            i = i[np.bitwise_count(fp[i] ^ fp[i + s]) <= distance]
            i = i[_canonical(fp[i] ^ fp[i + s], key[i] & 63, distance)]
            a.append(rep[i])
            b.append(rep[i + s])
        for k in np.flatnonzero(size > 64):
            own = slice(first[k], first[k] + size[k])
            for i, j in bucket_links(int(key[first[k]] & 63), fp[own], distance):
                a.append(rep[own][i])
                b.append(rep[own][j])
        if a and len(a := np.concatenate(a)):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(np.concatenate(b))], ["u", "v"])

    for cols in joined(batches, LINK_ROWS):
        key, cell = np.r_[key, cols[0].astype(np.int64)], np.r_[cell, cols[1]]
        fp, rep = np.r_[fp, cols[2].view(np.uint64)], np.r_[rep, cols[3]]
        if not len(key):
            continue
        done = int(np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])])[-1])  # the last bucket may go on
        yield from work(key[:done], cell[:done], fp[:done], rep[:done])
        key, cell, fp, rep = key[done:], cell[done:], fp[done:], rep[done:]
    yield from work(key, cell, fp, rep)


def fingerprint_links(classes: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """``u, v``: links between representatives of fingerprints ``fp, rep`` that connect all within ``distance`` bits.

    Every fingerprint gives a row for each bit: that bit's segment with the bit as wildcard. Rows meet by equality
    of that key and are verified. Counts of whole segments tell which keys exceed ``bucket``; the rows of those are
    hashed to blocks and meet in a cell for each two blocks, so no task gets an unbounded bucket.
    """
    small_batches(classes.sparkSession)
    segs = segments(distance)
    part = lambda lo, hi: F.shiftrightunsigned("fp", lo).bitwiseAND((1 << (hi - lo)) - 1)
    wild = lambda value, lo, hi: [F.shiftleft(value.bitwiseAND(~(1 << (p - lo))), 6).bitwiseOR(F.lit(p)) for p in range(lo, hi)]
    keys = F.array(*(k for lo, hi in segs for k in wild(part(lo, hi), lo, hi)))
    values = F.explode(F.array(*(F.struct(F.lit(i).alias("s"), part(lo, hi).alias("value")) for i, (lo, hi) in enumerate(segs))))
    large = classes.select(values.alias("x")).groupBy("x.s", "x.value").count().where(F.col("count") > bucket // 2)
    by_seg = F.lit(None)
    for i, (lo, hi) in enumerate(segs):
        by_seg = F.when(F.col("s") == i, F.array(*wild(F.col("value"), lo, hi))).otherwise(by_seg)
    hot = written(large.select(F.explode(by_seg).alias("key"), "count").groupBy("key").agg((F.sum("count") + bucket // 2).alias("n")), "hot-keys")
    rows = classes.select(F.explode(keys).alias("key"), "fp", "rep").join(hot, "key", "left")
    blocks = F.coalesce(F.ceil(F.col("n") * 2 / bucket), F.lit(1)).cast("bigint")
    rows = rows.select("key", "fp", "rep", blocks.alias("k")).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("k")))
    cells = F.when(F.col("k") == 1, F.array(F.lit(0).cast("bigint"))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1), lambda c: F.least(c, F.col("own")) * F.col("k") + F.greatest(c, F.col("own")))
    )
    rows = rows.select("key", F.explode(cells).alias("cell"), "fp", "rep").repartition("key", "cell").sortWithinPartitions("key", "cell")
    return rows.mapInArrow(lean(lambda b: _links(b, distance)), "u bigint, v bigint")


def near_groups(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, bucket: int = BUCKET, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fingerprint, component_id`` for every row: SimHash in hexadecimal, smallest key reachable by links.

    Documents link if their fingerprints differ in at most ``distance`` bits; equal fingerprints are one class, of
    which one row takes part in the search. Null and empty texts have no words: fingerprint zero, linked like any
    other. Rows that share a key but not a text keep a component each. A null key has a fingerprint and no component. An empty table
    gives no rows. Other columns are ignored.
    """
    rows = written(fingerprints(docs, key, text, shingle).withColumnRenamed(key, "id"), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "classes")
    links = fingerprint_links(classes.where("rep is not null"), distance, bucket)
    roots = components(links)
    members = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("fp", "n", F.coalesce("root", "rep").alias("component_id"))
    out = join_groups(rows, written(members, "members"), "fp", "n", rows.count())
    component = F.when(F.col("id").isNotNull(), F.col("component_id"))
    return out.select(F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that have the smallest key of their group or no key."""
    groups = near_groups(docs, key=key, text=text, **options).where(f"{key} <> component_id").select(F.col(key).alias("_key"))
    return docs.join(few(written(groups.distinct(), "near-copies")), F.col(key) == F.col("_key"), "left_anti")
