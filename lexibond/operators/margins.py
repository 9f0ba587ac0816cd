"""Marginal counts and scores of pairs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexibond.functions.scores import llr, llr_defined


def attach_first(bigrams: DataFrame, unigrams: DataFrame) -> DataFrame:
    """Pairs with ``c1``; a pair whose first word isn't counted in its language and decade is dropped."""
    c1 = unigrams.select("lang", "decade", F.col("w").alias("w1"), F.col("c").alias("c1"))
    return bigrams.join(c1, ["lang", "decade", "w1"])


def attach_margins(bigrams: DataFrame, unigrams: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """``lang, decade, w1, w2, c12, c1, c2, n``.

    No hints: the unigram side grows with the corpus, so statistics choose the join and adaptive execution
    splits hot words. ``sizes`` has a row for each language and decade; Spark broadcasts it when it is small.
    """
    from lexibond.operators.counts import corpus_size

    c2 = unigrams.select("lang", "decade", F.col("w").alias("w2"), F.col("c").alias("c2"))
    rows = attach_first(bigrams, unigrams).join(c2, ["lang", "decade", "w2"])
    rows = rows.join(corpus_size(unigrams) if sizes is None else sizes, ["lang", "decade"])
    return rows.select("lang", "decade", "w1", "w2", "c12", "c1", "c2", "n")


def score(pairs: DataFrame, digits: int | None = None) -> DataFrame:
    """``lang, decade, w1, w2, llr``; pairs with an impossible table are dropped. ``digits`` rounds the score."""
    counts = [F.col(x) for x in ("c1", "c2", "c12", "n")]
    value = llr(*counts)
    if digits is not None:
        value = F.round(value, digits)
    out = pairs.where(llr_defined(*counts)).select("lang", "decade", "w1", "w2", value.alias("llr"))
    return out.where(~F.isnan("llr") & (F.abs("llr") < float("inf")))
