"""Stop-word filter and counts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexibond.functions.text import LANG_EN, LANG_HE

#: Stop words up to this many are broadcast; a longer list leaves the choice of join to the optimizer.
MAX_BROADCAST_WORDS = 100_000


def listed(stopwords: DataFrame) -> DataFrame:
    """``_sl, _sw``: the distinct stop words, marked for a broadcast once their number is known to be small."""
    words = stopwords.select(F.col("lang").alias("_sl"), F.col("sw").alias("_sw")).distinct()
    return F.broadcast(words) if words.limit(MAX_BROADCAST_WORDS + 1).count() <= MAX_BROADCAST_WORDS else words


def _stop_lang(fallback: bool) -> Column:
    return F.when(F.col("lang") == LANG_HE, LANG_HE).otherwise(LANG_EN) if fallback else F.col("lang")


def drop_stopwords(rows: DataFrame, stopwords: DataFrame, columns: tuple[str, ...], fallback: bool = False) -> DataFrame:
    """Rows none of whose ``columns`` is a stop word of the row's language.

    ``stopwords``: ``lang, sw``, or what ``listed`` made of it, so that several calls check its size once. ``fallback``:
    any language but Hebrew takes the English list. Words are compared as they are, so an uncleaned list entry never
    matches a cleaned token.
    """
    words = stopwords if "_sw" in stopwords.columns else listed(stopwords)
    for c in columns:
        rows = rows.join(words, (_stop_lang(fallback) == F.col("_sl")) & (F.col(c) == F.col("_sw")), "left_anti")
    return rows


def drop_stopword_steps(steps: DataFrame, stopwords: DataFrame, fallback: bool = False) -> DataFrame:
    """Steps whose first word is no stop word; a second word that is one becomes ''."""
    words = stopwords if "_sw" in stopwords.columns else listed(stopwords)
    rows = drop_stopwords(steps, words, ("w1",), fallback)
    rows = rows.join(words, (_stop_lang(fallback) == F.col("_sl")) & (F.col("w2") == F.col("_sw")), "left")
    return rows.select("lang", "decade", "w1", F.when(F.col("_sw").isNull(), F.col("w2")).otherwise("").alias("w2"), "occ")


def step_counts(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``unigram_counts`` and ``bigram_counts`` of steps (``token_steps``), from one pass over them.

    Steps are summed once; where the second word is missing the sum is negative. That sign, and not the second word,
    tells the pairs, so that no filter moves below the sum and both results read the same exchange.
    """
    signed = F.when(F.col("w2") == "", -F.col("occ")).otherwise(F.col("occ"))
    sums = steps.groupBy("lang", "decade", "w1", "w2").agg(F.sum(signed).alias("x"))
    words = sums.groupBy("lang", "decade", F.col("w1").alias("w")).agg(F.sum(F.abs("x")).alias("c"))
    return words, sums.where("x > 0").withColumnRenamed("x", "c12")


def unigram_counts(words: DataFrame) -> DataFrame:
    """``lang, decade, w, c``: summed over all input, in whatever parts it arrives."""
    return words.groupBy("lang", "decade", "w").agg(F.sum("occ").alias("c"))


def bigram_counts(pairs: DataFrame) -> DataFrame:
    """``lang, decade, w1, w2, c12``: one row for each pair, fully summed."""
    return pairs.groupBy("lang", "decade", "w1", "w2").agg(F.sum("occ").alias("c12"))


def corpus_size(unigrams: DataFrame) -> DataFrame:
    """``lang, decade, n``: occurrences of all words that are left, over the whole corpus."""
    return unigrams.groupBy("lang", "decade").agg(F.sum("c").alias("n"))
