"""Convolutional toxicity classifier: hashed word embeddings, several widths, max pooling, in numpy."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexibond.llm.common import filter_text, give_back, map_text
from lexibond.sources.work import forget, give_back_driver, written

#: Words and their first ``PREFIX`` letters are hashed to this many buckets each; only buckets in ``MIN_DOCS`` sampled
#: texts or more get an embedding. A word whose bucket has none takes that of its first letters.
BUCKETS, MIN_DOCS, PREFIX = 1 << 24, 4, 5
#: Bounds of the training sample: labelled rows, and bytes of their texts together.
SAMPLE_ROWS, SAMPLE_BYTES = 6000, 32 << 20
DIMENSIONS, FILTERS, WIDTHS = 16, 12, (1, 2, 3)
EPOCHS, BATCH, RATE, DECAY = 8, 48, 0.01, 1e-5
#: A small sample is gone through more often, for so many steps at least.
STEPS = 300
CHUNK = 1 << 15

#: Frequent words that tell the language of a text.
LANGUAGES = {
    "en": "the and of to in is that it for was with as on be at by this are from or",
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch",
    "fr": "le la les des et du en une que est pour dans qui par sur pas au avec ce il",
    "es": "el los las del y que en un una por con para es se no lo como más su al",
}
_MARKS = b".,;:!?\"'()[]{}*_-"


class Words:
    """Buckets and language marks of words, cached in the worker; at most ``limit`` words are held."""

    def __init__(self, limit: int = 150_000) -> None:
        self.limit, self.known = limit, {}
        self.language = {w: k for k, v in enumerate(LANGUAGES.values(), 1) for w in v.split()}
        for w in list(self.language):  # a word of several languages tells nothing
            if sum(w in v.split() for v in LANGUAGES.values()) > 1:
                del self.language[w]

    def code(self, word: bytes) -> int:
        """From the lowest bit: the word's bucket, 1 + its language's place or 0 (3 bits), its first letters' bucket."""
        import xxhash

        w = word.decode("utf-8", "replace").lower().strip(_MARKS.decode())
        first = xxhash.xxh64_intdigest(w[:PREFIX], 1) % BUCKETS
        return xxhash.xxh64_intdigest(w) % BUCKETS | self.language.get(w, 0) << 24 | first << 27

    def codes(self, text: bytes) -> np.ndarray:
        words = text.split()
        known = self.known
        for w in set(words).difference(known):
            known[w] = self.code(w)
        out = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        if len(known) > self.limit:
            known.clear()
        return out


def guess(codes: np.ndarray) -> int:
    """The language whose frequent words occur most, 1 and up; 0 if none does."""
    n = np.bincount(codes >> 24 & 7, minlength=len(LANGUAGES) + 1)
    n[0] = 0
    return int(n.argmax()) if n.any() else 0


@dataclass
class Model:
    """A trained classifier. ``buckets``: those with an embedding, ascending; row 0 is for all others.

    ``base``: the share of label 1, which a text without words takes for its score.
    """

    buckets: np.ndarray
    embed: np.ndarray
    filters: list
    bias: np.ndarray
    out: np.ndarray
    shift: np.ndarray
    base: float = 0.5


    def _row(self, b: np.ndarray) -> np.ndarray:
        if not len(self.buckets):
            return np.zeros(len(b), np.int64)
        k = np.minimum(np.searchsorted(self.buckets, b), len(self.buckets) - 1)
        return np.where(self.buckets[k] == b, k + 1, 0)

    def both_rows(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the words (or else of their first letters), and of the first letters."""
        word, first = self._row(codes & (BUCKETS - 1)), self._row(BUCKETS + (codes >> 27))
        return np.where(word, word, first), first

    def rows(self, codes: np.ndarray) -> np.ndarray:
        return self.both_rows(codes)[0]

    def tables(self) -> list[list[np.ndarray]]:
        """What each word adds to each filter at each place, so that a convolution is a sum of look-ups."""
        return [[self.embed @ f[j] for j in range(len(f))] for f in self.filters]

    def pooled(self, rows: np.ndarray, tables: list) -> np.ndarray:
        """Each filter's maximum over the whole text, zero at least; long texts in overlapping chunks."""
        best = np.full((len(WIDTHS), FILTERS), -np.inf, np.float32)
        rows = np.concatenate([rows, np.zeros(max(WIDTHS) - 1, rows.dtype)])
        for at in range(0, len(rows) - max(WIDTHS) + 1, CHUNK):
            part = rows[at : at + CHUNK + max(WIDTHS) - 1]
            n = len(part) - max(WIDTHS) + 1
            for k, t in enumerate(tables):
                conv = t[0][part[:n]]
                for j in range(1, len(t)):
                    conv = conv + t[j][part[j : n + j]]
                best[k] = np.maximum(best[k], conv.max(axis=0))
        return np.maximum(best.ravel() + self.bias, 0) if len(rows) >= max(WIDTHS) else np.zeros(len(self.bias), np.float32)

    def score(self, codes: np.ndarray, tables: list) -> float:
        if not len(codes):
            return self.base
        z = float(self.pooled(self.rows(codes), tables) @ self.out[:-1] + self.out[-1]) - self.shift[guess(codes)]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(texts: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Model:
    """Fit to word codes and 0/1 labels. A fifth of the sample sets the thresholds by language.

    With one class only, every score is that class's share (kept off 0 and 1).
    """
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    fit, held = order[len(order) // 5 :], order[: len(order) // 5]
    seen, n = np.unique(np.concatenate([np.unique(np.r_[texts[i] & (BUCKETS - 1), BUCKETS + (texts[i] >> 27)]) for i in fit] or [np.zeros(0, np.int64)]), return_counts=True)
    buckets = seen[n >= MIN_DOCS]
    width = len(WIDTHS) * FILTERS
    f32 = np.float32
    model = Model(buckets, rng.normal(0, 0.02, (len(buckets) + 1, DIMENSIONS)).astype(f32), [rng.normal(0, 0.3, (w, DIMENSIONS, FILTERS)).astype(f32) for w in WIDTHS], np.zeros(width, f32), rng.normal(0, 0.3, width + 1).astype(f32), np.zeros(len(LANGUAGES) + 1))
    model.embed[0] = 0
    share = labels.mean() if len(labels) else 0.5
    model.base = float(share)
    if len(set(labels[fit].tolist())) < 2:
        model.out[:] = 0
        model.out[-1] = np.log((share + 1e-3) / (1 - share + 1e-3))
        return model
    model.out[-1] = np.log(share / (1 - share))
    rows = {int(i): model.both_rows(texts[i]) for i in order}
    params = [model.embed, *model.filters, model.bias, model.out]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    epochs = max(EPOCHS, STEPS * BATCH // len(fit))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for at in range(0, len(fit), BATCH):
            batch = fit[at : at + BATCH]
            grads = [np.zeros_like(p) for p in params]
            tables = model.tables()
            for i in batch:
                word, prefix = rows[int(i)]
                luck = rng.random(len(word))
                mixed = np.where(luck < 0.1, 0, np.where(luck < 0.4, prefix, word))
                _backward(model, tables, mixed, int(labels[i]), grads, len(batch))
            step += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                g += DECAY * p
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(f32)
            model.embed[0] = 0
        fit = rng.permutation(fit)
    _calibrate(model, [texts[i] for i in held], labels[held])
    return model


def _backward(model: Model, tables: list, rows: np.ndarray, label: int, grads: list, batch: int) -> None:
    """Add one text's gradient. Only the places of the maxima take part."""
    span = max(WIDTHS) - 1
    rows = np.concatenate([rows, np.zeros(span, rows.dtype)])
    n = len(rows) - span
    if n <= 0:
        return
    tops, where = [], []
    for t in tables:
        conv = t[0][rows[:n]]
        for j in range(1, len(t)):
            conv = conv + t[j][rows[j : n + j]]
        k = conv.argmax(axis=0)
        where.append(k)
        tops.append(conv[k, np.arange(FILTERS)])
    hidden = np.maximum(np.concatenate(tops) + model.bias, 0)
    z = float(hidden @ model.out[:-1] + model.out[-1])
    d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) / batch
    grads[-1][:-1] += d * hidden
    grads[-1][-1] += d
    g = (d * model.out[:-1] * (hidden > 0)).astype(np.float32)
    grads[-2] += g
    for k, f in enumerate(model.filters):
        own = g[k * FILTERS : (k + 1) * FILTERS]
        for j in range(len(f)):
            at = rows[where[k] + j]
            grads[1 + k][j] += (model.embed[at] * own[:, None]).T
            np.add.at(grads[0], at, own[:, None] * f[j].T)


def _calibrate(model: Model, texts: list[np.ndarray], labels: np.ndarray) -> None:
    """Each language's threshold on the score before the sigmoid: fewest errors, in the middle of the best range.

    A language with few held texts of either label takes the threshold of all.
    """
    tables, languages = model.tables(), np.array([guess(t) for t in texts])
    z = np.array([model.pooled(model.rows(t), tables) @ model.out[:-1] + model.out[-1] for t in texts])

    def best(own: np.ndarray) -> float | None:
        y, s = labels[own], z[own]
        if y.sum() < 5 or (1 - y).sum() < 5:
            return None
        cuts = np.concatenate([[s.min() - 1], np.sort(s), [s.max() + 1]])
        cuts = (cuts[1:] + cuts[:-1]) / 2
        errors = np.array([((s >= c) != y).sum() for c in cuts])
        return float(np.median(cuts[errors == errors.min()]))

    common = best(np.ones(len(z), bool)) if len(z) else None
    for k in range(len(model.shift)):
        own = best(languages == k) if len(z) else None
        model.shift[k] = own if own is not None else common if common is not None else 0.0


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Train on labelled rows whose crc32(key as text) mod 5 isn't 0.

    The sample is the first ``SAMPLE_ROWS`` labelled keys in hash order, one text each (of a repeated key's texts the one
    with the least hash), as far as these fit ``SAMPLE_BYTES``; the driver gets word codes of those only. Labels of
    repeated keys count as 1 if any does; null labels and keys count as none.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label).isNotNull() & (F.crc32(F.col(key).cast("string").cast("binary")) % 5 != 0)).groupBy(key).agg(F.max(label).alias("y"))
    known = known.withColumn("h", F.xxhash64(key)).orderBy("h", key).limit(SAMPLE_ROWS)
    rows = docs.select(key, F.col(text).alias("text")).join(F.broadcast(known), key)
    # one row a key, summed up before the shuffle, whatever the number of rows that share it
    rows = rows.groupBy(key, "y", "h").agg(F.min(F.struct(F.xxhash64("text").alias("x"), "text")).alias("t")).select(key, "y", "h", F.col("t.text").alias("text"))
    rows = written(rows, "labelled")
    sizes = rows.select(key, "y", "h", F.coalesce(F.octet_length("text"), F.lit(0)).alias("b")).collect()
    sample, used = {}, 0
    for r in sorted(sizes, key=lambda r: (r["h"], r[key])):
        if used + r["b"] <= SAMPLE_BYTES:
            used += r["b"]
            sample[r[key]] = r["y"]
    if not sample:
        return train([], np.zeros(0, np.int64))
    ids = F.broadcast(spark.createDataFrame([(k,) for k in sample], f"{key} bigint"))

    def make():
        words = Words()
        return lambda keys, texts: {key: pa.array(keys, pa.int64()), "codes": pa.array([words.codes(t).astype("<i8").tobytes() for t in texts], pa.binary())}

    got = map_text(rows.select(key, "text").join(ids, key), key, "text", f"{key} bigint, codes binary", make).collect()
    forget(rows)
    got.sort(key=lambda r: r[0])
    texts, y = [np.frombuffer(r[1], "<i8") for r in got], np.array([int(sample[r[0]] > 0) for r in got])
    del got, sizes, sample
    model = train(texts, y)
    del texts
    give_back()
    give_back_driver(spark)
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score, predicted`` of every whole text. The model is broadcast; its size is bounded by the sample.

    Null text is empty and has a score too. Null and repeated keys give a row each, an empty table none. Other
    columns are ignored: neither label, language column nor key enters a score.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own, words = sent.value, Words()
        tables = own.tables()

        def work(keys, texts):
            s = [float(own.score(words.codes(t), tables)) for t in texts]
            return {key: pa.array(keys, pa.int64()), "score": pa.array(s, pa.float64()), "predicted": pa.array([int(x >= 0.5) for x in s], pa.int32())}

        return work

    return map_text(docs, key, text, f"{key} bigint, score double, predicted int", make)


def clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text isn't predicted toxic. Rows aren't shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own, words = sent.value, Words()
        tables = own.tables()
        return lambda texts: [own.score(words.codes(t), tables) < 0.5 for t in texts]

    return filter_text(docs, text, make)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of all documents, by a model fitted to the labelled ones.

    A row without a key has no label and isn't held out; the rest is as of ``fit`` and ``score``.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out")
    return score(docs, fit(docs, labels)).select("doc_id", held, "score", "predicted")
