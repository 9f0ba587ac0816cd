"""Readers of n-grams and stop words, text adapters, and sinks."""

from lexibond.sources.corpus import conversation_tokens, document_tokens, part_ngrams, part_steps, token_pairs, token_steps, token_words
from lexibond.sources.ngrams import parse_pairs, parse_words, read_lines, read_ngrams
from lexibond.sources.sinks import read_tsv, write_parquet, write_sequence_file, write_tsv
from lexibond.sources.stopwords import STOPWORDS, parse_stopwords, read_stopwords, stopword_frame

__all__ = [
    "STOPWORDS", "conversation_tokens", "document_tokens", "parse_pairs", "parse_stopwords", "parse_words", "part_ngrams", "part_steps",
    "read_lines", "read_ngrams", "read_stopwords", "read_tsv", "stopword_frame", "token_pairs", "token_steps", "token_words", "write_parquet",
    "write_sequence_file", "write_tsv",
]
