"""From words and pairs to the strongest pairs of each language and decade."""

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lexibond.operators import attach_margins, bigram_counts, corpus_size, drop_stopword_steps, drop_stopwords, listed, score, step_counts, top_k, unigram_counts

log = logging.getLogger(__name__)


def counted(words: DataFrame, pairs: DataFrame, stopwords: DataFrame | None = None, fallback: bool = False) -> tuple[DataFrame, DataFrame]:
    """Word and pair counts without stop words. Both inputs are counted in full, so the result doesn't depend on partitions."""
    if stopwords is not None:
        stopwords = listed(stopwords)
        words = drop_stopwords(words, stopwords, ("w",), fallback)
        pairs = drop_stopwords(pairs, stopwords, ("w1", "w2"), fallback)
    return unigram_counts(words), bigram_counts(pairs)


def counted_steps(steps: DataFrame, stopwords: DataFrame | None = None, fallback: bool = False) -> tuple[DataFrame, DataFrame]:
    """``counted`` of running text, which is read and cleaned once for both counts."""
    return step_counts(steps if stopwords is None else drop_stopword_steps(steps, listed(stopwords), fallback))


def scored_pairs(words: DataFrame, pairs: DataFrame, stopwords: DataFrame | None = None, fallback: bool = False, digits: int | None = None) -> DataFrame:
    """LLR of every pair."""
    unigrams, bigrams = counted(words, pairs, stopwords, fallback)
    return score(attach_margins(bigrams, unigrams), digits)


def top_pairs(words: DataFrame, pairs: DataFrame, stopwords: DataFrame | None = None, k: int = 100, fallback: bool = False, digits: int | None = None, stats: Observation | None = None) -> DataFrame:
    """``lang, decade, w1, w2, llr, rank``. ``stats`` observes the number of scored pairs as ``scored``."""
    scored = scored_pairs(words, pairs, stopwords, fallback, digits)
    if stats is not None:
        scored = scored.observe(stats, F.count(F.lit(1)).alias("scored"))
    return top_k(scored, k)


def top_pairs_of_steps(steps: DataFrame, stopwords: DataFrame | None = None, k: int = 100, digits: int | None = None, fallback: bool = False) -> DataFrame:
    """``top_pairs`` of running text as steps (``token_steps``)."""
    unigrams, bigrams = counted_steps(steps, stopwords, fallback)
    return top_k(score(attach_margins(bigrams, unigrams), digits), k)


def run(words: DataFrame, pairs: DataFrame, write: Callable[[DataFrame], None], stopwords: DataFrame | None = None, k: int = 100, fallback: bool = False, digits: int | None = None, stages: str | None = None) -> dict[str, int]:
    """Compute ``top_pairs``, hand it to a sink, return the observed counts: ``scored`` and ``kept``.

    ``stages``: a folder that takes the tables between as parquet: ``words`` (counts), ``sizes`` (corpus sizes), ``pairs``
    (with their margins) and ``scored``. Each is then read back by the next step, so a job that fails goes on from files.
    """
    spark = words.sparkSession
    if stopwords is not None and log.isEnabledFor(logging.INFO):
        log.info("stop words: %s", {r["lang"]: r["n"] for r in stopwords.distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()})

    def stage(df: DataFrame, name: str) -> DataFrame:
        if stages is None:
            return df
        df.write.parquet(f"{stages.rstrip('/')}/{name}")
        return spark.read.schema(df.schema).parquet(f"{stages.rstrip('/')}/{name}")

    unigrams, bigrams = counted(words, pairs, stopwords, fallback)
    unigrams = stage(unigrams, "words")
    sizes = stage(corpus_size(unigrams), "sizes")
    if stages is not None:
        log.info("languages and decades: %d", sizes.count())
    margins = stage(attach_margins(bigrams, unigrams, sizes), "pairs")
    scored, kept = Observation("scored"), Observation("kept")
    ranked = stage(score(margins, digits), "scored").observe(scored, F.count(F.lit(1)).alias("scored"))
    write(top_k(ranked, k).observe(kept, F.count(F.lit(1)).alias("kept")))
    out = {**scored.get, **kept.get}
    log.info("pairs: %s", out)
    return out
