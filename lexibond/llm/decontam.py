"""Benchmark passages in documents: CGK embeddings, bit-sampling LSH and exact edit verification.

The alphabet is words (lower case, punctuation stripped). The CGK walk turns a word sequence into a longer one: at
step j it gives the current word and moves on if a random bit of (j, word) says so. Two sequences that take the same
bits differ, after that, in about as many places as their edit distance. A repetition samples a few places; a window
of a document whose words there equal an item's is a candidate, which the edit distance then confirms or refutes.
Samples start near their window's first word, so windows start all over an item, and a passage is found by any of them.
"""

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexibond.llm.common import filter_text, pieces_of_lines, small_batches

#: Repetitions (each a walk and a sample), places in a sample, and edits allowed as a share of an item's words.
REPETITIONS, PLACES, EDITS = 16, 3, 0.2
#: Items and bytes of their texts in one broadcast; a larger benchmark is searched in blocks of this size.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20
#: A word in more than this share of the items isn't embedded, if an item has ``FEWEST`` others.
COMMON, FEWEST = 0.02, 8
_MARKS = ".,;:!?\"'()[]{}<>*_-–—“”‘’«»¿¡…|#%&$"
_SPACES = bytes.maketrans(b"\t\n\v\f\r", b"     ")
_STEPS = 60
#: Words from one sampled window of an item to the next, at most, and words in a window that starts within an item, at least.
STRIDE, WINDOW = 12, 8


class Symbols:
    """Words to 64-bit symbols, cached in the worker; a word of punctuation alone is 0 and left out."""

    def __init__(self, limit: int = 150_000) -> None:
        self.limit, self.known = limit, {}

    def of(self, text: bytes) -> np.ndarray:
        return self.of_all([text])[0]

    def of_all(self, texts: list[bytes]) -> list[np.ndarray]:
        """Symbols of each text; each distinct word of all of them is looked up once."""
        words, ends = pieces_of_lines([t.translate(_SPACES) for t in texts])
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        symbols = list(map(self.known.get, distinct))
        at = [i for i, v in enumerate(symbols) if v is None]
        if at:
            new = self.make([distinct[i] for i in at])
            for i, v in zip(at, new, strict=True):
                symbols[i] = v
            if len(self.known) + len(at) > self.limit:
                self.known.clear()
            if len(at) <= self.limit:
                self.known.update(zip([distinct[i] for i in at], new, strict=True))
        out = np.array(symbols, np.uint64)[coded.indices.to_numpy()]
        kept = out != 0
        return np.split(out[kept], np.r_[0, np.cumsum(kept)][ends[:-1]]) if texts else []

    @staticmethod
    def make(words: list[bytes]) -> list[int]:
        import xxhash

        # white space has no case and isn't skipped for a neighbour's, so words lower together as they do alone
        bare = [w.strip(_MARKS) for w in b"\n".join(words).decode("utf-8", "replace").lower().split("\n")]
        return [xxhash.xxh64_intdigest(w) | 1 if w else 0 for w in bare]


def edit_ends(item: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each place in ``text``, the fewest edits between ``item`` and a stretch that ends there."""
    span = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, w in enumerate(item, 1):
        new = row + 1
        new[0] = i
        np.minimum(new[1:], row[:-1] + (text != w), out=new[1:])
        new -= span
        row = np.minimum.accumulate(new) + span
    return row


def verify(item: np.ndarray, held: set[int], text: np.ndarray, near: int, most: int) -> tuple[int, int, int] | None:
    """``edits, first, end`` of the best stretch around word ``near``, if it takes ``most`` edits or fewer.

    ``held`` are the item's distinct words.
    """
    lo, hi = max(0, near - len(item) - most), min(len(text), near + 2 * len(item))
    if len(held.difference(text[lo:hi].tolist())) > most:  # each missing word is an edit
        return None
    cost = edit_ends(item, text[lo:hi])
    end = int(cost.argmin())
    if cost[end] > most:
        return None
    back = edit_ends(item[::-1], text[lo : lo + end][::-1])
    start = end - int(np.flatnonzero(back == cost[end])[0])
    return int(cost[end]), lo + start, lo + end


def starts(length: int) -> list[int]:
    """Where the sampled windows of an item of so many words start.

    Four at least, if they fit, and one every ``STRIDE`` words: edits at the head leave a window whole, and edits up to a
    fifth of the words can't spoil the first words of all windows of a long item.
    """
    last = max(0, length - WINDOW)
    return sorted({*range(0, last + 1, max(1, min(STRIDE, -(-length // 4)))), last})


def folded(keys: list[np.ndarray]) -> np.ndarray:
    """One 64-bit number for the words of a sample."""
    out = keys[0]
    for k in keys[1:]:
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + k
    return out


class Lookup:
    """Items by sample, looked up for many samples at once."""

    def __init__(self, keys: np.ndarray, items: np.ndarray) -> None:
        order = np.lexsort((items, keys))
        keys, items = keys[order], items[order]
        new = np.r_[True, (keys[1:] != keys[:-1]) | (items[1:] != items[:-1])] if len(keys) else np.zeros(0, bool)
        keys, self.items = keys[new], items[new].astype(np.int32)
        self.keys, self.first = np.unique(keys, return_index=True)
        self.many = np.diff(np.r_[self.first, len(keys)])

    def get(self, at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and items, a pair for each item of each sample that is found."""
        if not len(keys) or not len(self.keys):
            return at[:0], self.items[:0]
        k = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        found = self.keys[k] == keys
        k, at = k[found], at[found]
        many = self.many[k]
        start = np.repeat(self.first[k] - np.cumsum(many) + many, many)
        return np.repeat(at, many), self.items[start + np.arange(len(start))]


class Index:
    """The samples of the items' windows, by repetition and class of length: arrays, built once and sent to the workers."""

    def __init__(self, items: list[tuple[int, np.ndarray]], seed: int = 11) -> None:
        self.items = [(k, w) for k, w in items if len(w)]
        self._held: dict[int, set[int]] = {}
        rng = np.random.default_rng(seed)
        distinct = [np.unique(w) for _, w in self.items]
        seen, n = np.unique(np.concatenate(distinct), return_counts=True) if distinct else (np.zeros(0, np.uint64),) * 2
        common = seen[n > COMMON * len(self.items)]
        self.mix = [int(x) | 1 for x in rng.integers(1, 1 << 63, REPETITIONS)]
        firsts = [int(x) for x in rng.integers(0, 5, REPETITIONS)]
        #: For each stream of words (all but the common ones; all): the words left out, and samples by repetition.
        self.streams = []
        bare = [w[~np.isin(w, common)] for _, w in self.items]
        for few in (False, True):
            members = [i for i, w in enumerate(bare) if (len(w) < FEWEST) == few]
            if members:
                classes = defaultdict(list)
                for i in members:
                    own = self.items[i][1] if few else bare[i]
                    for o in starts(len(own)):
                        classes[(len(own) - o).bit_length()].append((i, own[o : o + _STEPS + 1]))  # a walk goes no farther
                packed = []
                for own in classes.values():
                    sizes = np.array([len(w) for _, w in own])
                    packed.append((np.array([i for i, _ in own]), np.concatenate([w for _, w in own]), np.cumsum(sizes) - sizes, np.cumsum(sizes), int(sizes.min())))
                self.streams.append((np.zeros(0, np.uint64) if few else common, [self._samples(packed, r, firsts[r], rng) for r in range(REPETITIONS)]))

    def held(self, n: int) -> set[int]:
        """The distinct words of an item."""
        if n not in self._held:
            self._held[n] = set(self.items[n][1].tolist())
        return self._held[n]

    def _samples(self, classes: list, r: int, first: int, rng) -> list:
        """By first sampled step: a table of the windows' words there, and the samples of each class of lengths.

        Steps stay within the shortest window of a class. Nearly all classes share their first step, so that one look-up
        settles it for all of them.
        """
        by_first = defaultdict(list)
        for owner, words, begin, ends, shortest in classes:
            most = max(1, min(_STEPS, int(1.4 * shortest)))
            start = min(first, most - 1)
            rest = rng.choice(np.arange(start + 1, most), min(PLACES - 1, most - start - 1), replace=False)
            steps = sorted([start, *map(int, rest)])
            whole, keys = sample(words, begin, self.mix[r], 0, steps, ends)
            by_first[start].append((steps, Lookup(folded(keys), owner[whole]), (keys[0] & np.uint64(0xFFFF)).astype(np.intp)))
        out = []
        for start, group in sorted(by_first.items()):
            table = np.zeros(1 << 16, np.uint8)  # a bit for each class; those beyond eight share the last
            for k, (_, _, words) in enumerate(group):
                table[words] |= np.uint8(1 << min(k, 7))
            out.append((start, table, [(steps, by) for steps, by, _ in group]))
        return out

    def candidates(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a place in ``words`` and an item that has a sample which the window that starts there equals."""
        for drop, repetitions in self.streams:
            kept = np.flatnonzero(~np.isin(words, drop)) if len(drop) else np.arange(len(words))
            w = words[kept]
            if not len(w):
                continue
            low = (w & np.uint64(0xFFFF)).astype(np.intp)
            pad, n = np.zeros(_STEPS, np.uint8), len(w)
            for r, groups in enumerate(repetitions):
                mixed, shift, at = w * np.uint64(self.mix[r]), np.zeros(n, np.uint8), 0
                for first, table, classes in groups:
                    for j in range(at, first):
                        shift += shifted(np.r_[(mixed >> np.uint64(63 - j)).astype(np.uint8) & np.uint8(1), pad], shift, j)
                    at = first
                    start = np.flatnonzero(shifted(np.r_[(table != 0).view(np.uint8)[low], pad], shift, first))
                    held = table[low[start + shift[start]]]
                    for k, (steps, by) in enumerate(classes if len(start) else ()):
                        here = start[held & np.uint8(1 << min(k, 7)) != 0]
                        own, keys = sample(w, here + shift[here], self.mix[r], first, steps)
                        yield by.get(kept[here[own]], folded(keys))


def shifted(values: np.ndarray, shift: np.ndarray, most: int) -> np.ndarray:
    """``values[i + shift[i]]`` of 0/1 bytes, for shifts up to a small ``most``, without an indexed read."""
    n = len(shift)
    out = values[:n] & (shift == 0)
    for k in range(1, most + 1):
        out |= values[k : n + k] & (shift == k)
    return out


def sample(words: np.ndarray, pos: np.ndarray, mix: int, at: int, steps: list[int], ends: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Walk from step ``at``, at the places ``pos``: which walks stay within the words, and their words at ``steps``.

    With ``ends``, each walk has to stay before its own end.
    """
    own, keys = np.arange(len(pos)), []
    for s in steps:
        pos, at = walk(words, pos, mix, at, s), s
        inside = pos < (len(words) if ends is None else ends[own])
        own, pos, keys = own[inside], pos[inside], [k[inside] for k in keys]
        keys.append(words[pos])
    return own, keys


def walk(words: np.ndarray, pos: np.ndarray, mix: int, start: int, stop: int) -> np.ndarray:
    """Places after the steps ``start`` to ``stop``; a walk that has left the words stays out."""
    for j in range(start, stop):
        here = words[np.minimum(pos, len(words) - 1)]
        pos = pos + (((here * np.uint64(mix)) >> np.uint64(63 - j)) & np.uint64(1)).astype(np.int64)
    return pos


def _hits(index: Index, texts: list[np.ndarray], edits: float) -> dict[tuple[int, int], tuple[int, int, int]]:
    """Best stretch by places of a text and an item."""
    sizes = np.array([len(t) for t in texts], np.int64)
    bounds = np.cumsum(sizes)
    words = np.concatenate(texts) if texts else np.zeros(0, np.uint64)
    tried, best = set(), {}
    for places, items in index.candidates(words):
        owner = np.searchsorted(bounds, places, "right")
        own = places - bounds[owner] + sizes[owner]
        for d, at, n in zip(owner.tolist(), own.tolist(), items.tolist(), strict=True):
            item = index.items[n][1]
            mark = (d, n, at // max(4, len(item) // 4))
            if mark not in tried:
                tried.add(mark)
                hit = verify(item, index.held(n), texts[d], at, int(edits * len(item)))
                if hit is not None and ((d, n) not in best or hit < best[d, n]):
                    best[d, n] = hit
    return best


def _search(docs: DataFrame, sent, edits: float, key: str, text: str) -> DataFrame:
    schema = f"{key} bigint, item_id bigint, edits int, start_word bigint, end_word bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, own = sent.value, Symbols()
        for b in batches:
            keys = b.column(0).to_pylist()
            best = _hits(index, own.of_all([x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()]), edits)
            rows = [(keys[d], index.items[n][0], *hit) for (d, n), hit in sorted(best.items())]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def _blocks(benchmark: DataFrame, item: str) -> Iterator:
    """Broadcasts of indexes of the benchmark's items, each of bounded size; one, if empty, at least."""
    symbols, block, size, sent = Symbols(), [], 0, 0
    spark = benchmark.sparkSession
    for r in benchmark.select(item, "text").orderBy(item).toLocalIterator():
        if block and (len(block) >= BLOCK_ITEMS or size + len(r[1] or "") > BLOCK_BYTES):
            yield spark.sparkContext.broadcast(Index(block))
            block, size, sent = [], 0, sent + 1
        block.append((r[0], symbols.of((r[1] or "").encode())))
        size += len(r[1] or "")
    if block or not sent:
        yield spark.sparkContext.broadcast(Index(block))


def contaminated(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """``key, item_id, edits, start_word, end_word``: documents that hold a benchmark item within ``edits`` of its words.

    A row for each document row and item: the stretch with the fewest edits. Documents aren't shuffled. The benchmark is
    broadcast in blocks of bounded size, so a larger one costs more passes and no more memory.

    Null and empty texts hold nothing, items without words are in nothing; rows of either with null or repeated keys
    are searched like others. Empty tables give no rows. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    found = [_search(docs, sent, edits, key, text) for sent in _blocks(benchmark, item)]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, text: str = "text", item: str = "item_id") -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no benchmark item. Rows aren't shuffled."""

    def without(docs: DataFrame, sent) -> DataFrame:
        def make():
            index, own = sent.value, Symbols()

            def keep(texts: list[bytes]) -> list[bool]:
                held = {d for d, _ in _hits(index, own.of_all(texts), edits)}
                return [d not in held for d in range(len(texts))]

            return keep

        return filter_text(docs, text, make)

    for sent in _blocks(benchmark, item):
        docs = without(docs, sent)
    return docs
