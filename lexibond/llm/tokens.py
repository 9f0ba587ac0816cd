"""Token counts with a two-tier lookup on the map side."""

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexibond.llm.common import Pieces, map_text, pieces_of, space_dropped_pieces, spaced_pieces

#: Pre-tokens in the broadcast table; also the bound on its size (these, at most 64 bytes long, and a byte each).
TABLE = 32_768
#: Candidates that each task names for the table, and pieces that it counts before it drops the rare ones.
NAMED, COUNTED = 1024, 500_000
LONGEST = 64


class Lengths(Pieces):
    """Numbers of ids instead of ids; the frequent ones stay."""

    frequent: dict = {}

    def parts(self, ids, start, end) -> list[int]:
        return (end - start).tolist()

    def trim(self) -> None:
        if len(self.known) > self.limit:
            self.known, self.older = dict(self.frequent), self.known


def frequent_pieces(docs: DataFrame, cut, text: str = "text", size: int = TABLE) -> list[bytes]:
    """The most frequent pre-tokens of all texts.

    Every task counts its own texts whole and names its top ``NAMED``, so the exchange carries that many rows a
    task and no pre-tokens. The list only decides what is looked up fast, never a result.
    """

    def make():
        seen: Counter = Counter()

        def work(keys, texts):
            for t in texts:
                seen.update(cut(t))
            if len(seen) > COUNTED:
                top = seen.most_common(COUNTED // 10)
                seen.clear()
                seen.update(dict(top))
            return None

        work.seen = seen
        return work

    def run(batches):
        work = make()
        for b in batches:
            work(None, [x or b"" for x in b.column(0).cast(pa.binary()).to_pylist()])
        top = [(w, n) for w, n in work.seen.most_common(NAMED) if len(w) <= LONGEST]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"])

    named = docs.select(text).mapInArrow(run, "piece binary, n bigint")
    rows = named.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(size).collect()
    return [bytes(r["piece"]) for r in rows]


def count_tokens(docs: DataFrame, path: str, limit: int = 512, key: str = "doc_id", text: str = "text", drops_space: bool = False) -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` of every whole text, as the tokenizers library counts.

    Frequent pre-tokens' lengths are broadcast (``TABLE`` entries at most); others are encoded once a worker and
    cached there. Texts aren't shuffled and neither are pre-tokens.

    Null text counts as empty: 0 bytes, 0 tokens. Null and repeated keys give a row each, an empty table none;
    other columns of the input are ignored, whatever their names.
    """
    spark: SparkSession = docs.sparkSession
    cut = space_dropped_pieces if drops_space else spaced_pieces
    words = frequent_pieces(docs, cut, text)
    own = Lengths(path, cut)
    own.learn(words)
    sizes = [own.known[w] for w in words]
    packed = spark.sparkContext.broadcast((b"\xff".join(words), sizes))  # no UTF-8 text holds that byte

    def make():
        lengths = pieces_of(path, cut, Lengths)
        blob, n = packed.value
        lengths.frequent = dict(zip(blob.split(b"\xff"), n, strict=True)) if n else {}
        lengths.known.update(lengths.frequent)

        def work(keys, texts):
            n_tokens = [sum(v) for v in lengths.values(texts)]
            lengths.trim()
            return {key: pa.array(keys, pa.int64()), "n_bytes": pa.array(map(len, texts), pa.int64()), "n_tokens": pa.array(n_tokens, pa.int64()), "over_limit": pa.array([n > limit for n in n_tokens], pa.bool_())}

        return work

    return map_text(docs, key, text, f"{key} bigint, n_bytes bigint, n_tokens bigint, over_limit boolean", make)
