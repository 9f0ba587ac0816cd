"""Documents to packed training sequences, in five stages.

Each stage takes what the one before kept, written as Parquet and read again; what a stage read is deleted once its
output is written. All but the last return the columns of ``documents``. Null texts count as empty, an empty table passes
through, and other columns are carried along, whatever their names (but ``_key``, ``_digest``, ``_own`` and ``_t``).
"""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lexibond.llm import decontam, exact, near, packing, toxicity
from lexibond.sources.work import forget, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier rejects; it is trained on the labelled ones.

    A row goes or stays by its text alone: equal rows together, rows without a key like others.
    """
    return toxicity.clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the largest doc_id of those with the same text; of equal rows one.

    A null doc_id is the smallest; a text that only rows without one have keeps one of them.
    """
    return exact.distinct_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each group of near copies.

    SimHash fingerprints of four-word shingles link at 4 or fewer differing bits, as in op9; sets of five-word shingles
    of similarity 0.8 link as well. Rows without a doc_id stay; rows that share one are told apart by their texts.
    """
    return near.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, by their texts alone."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens; repeated rows and rows without a doc_id like others."""
    return packing.pack_texts(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: SQL can express neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
            forget(before)
            before = docs
    return docs
