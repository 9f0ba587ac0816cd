"""Relational operators of the association pipeline."""

from lexibond.operators.counts import bigram_counts, corpus_size, drop_stopword_steps, drop_stopwords, listed, step_counts, unigram_counts
from lexibond.operators.margins import attach_first, attach_margins, score
from lexibond.operators.topk import top_k

__all__ = [
    "attach_first", "attach_margins", "bigram_counts", "corpus_size", "drop_stopword_steps", "drop_stopwords", "listed", "score", "step_counts", "top_k",
    "unigram_counts",
]
