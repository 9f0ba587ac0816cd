"""Registered queries of this subpackage, and SQL for those that SQL can express."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lexibond.llm import binary, decontam, exact, extraction, licenses, packing, simhash, substring, tokens, toxicity


def _docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    path = public_tokenizers.path
    return {
        "op1_exact_dedup": lambda s, d: exact.dedup_documents(_docs(s, d)),
        "dedup_second_batch": lambda s, d: exact.dedup_second_batch(_docs(s, d)),
        "op2_binary_output": lambda s, d: binary.binary_round_trip(_docs(s, d), path("word_bpe_49k.json")),
        "op3_html_extraction": lambda s, d: extraction.extract(s.read.parquet(f"{d}/pages.parquet").select("page_id", "url", "html")),
        "op4_decontamination": lambda s, d: decontam.contaminated(_docs(s, d), s.read.parquet(f"{d}/benchmark.parquet")),
        "op5_toxicity": lambda s, d: toxicity.toxicity(_docs(s, d), s.read.parquet(f"{d}/labels.parquet")),
        "op6_packing": lambda s, d: packing.pack_texts(_docs(s, d), path("byte_bpe_50k.json")),
        "instruction_packing": lambda s, d: packing.pack_conversations(s.read.parquet(f"{d}/conversations.parquet"), path("byte_bpe_50k.json"), tokens=2048, segments=12, loss=1024),
        "op7_license_scan": lambda s, d: licenses.scan_documents(_docs(s, d, "doc_id", "text", "lang", "source")),
        "op8_substring_dedup": lambda s, d: substring.remove_repeats(_docs(s, d), with_text=False),
        "op9_simhash": lambda s, d: simhash.near_groups(_docs(s, d)),
        "op10_token_counts": lambda s, d: tokens.count_tokens(_docs(s, d), path("byte_bpe_50k.json")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact.ORACLE, "dedup_second_batch": exact.SECOND_ORACLE, "op7_license_scan": licenses.oracle()}
