"""What Python workers hold once a task is done."""

import subprocess
import sys

import public_tokenizers
import pyarrow as pa

from lexibond.llm import common, packing, toxicity
from lexibond.sources import work

HOLDS = """
import re
import numpy as np
from lexibond.llm import common

def held():
    return int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) // 1024

def run(batches):
    for b in batches:
        many = [np.ones(10_000, np.uint8) for _ in range(20_000)]
        keep.append(np.ones(10_000, np.uint8))  # above the others, so that the heap's end can't shrink
        yield b

keep, before = [], held()
assert list(FUNCTION([1])) == [1]
print(held() - before)
"""


def left(function):
    """MB that a process has more after a function that used 200."""
    return int(subprocess.run([sys.executable, "-c", HOLDS.replace("FUNCTION", function)], capture_output=True, text=True, check=True).stdout)


def test_freed_memory_is_returned():
    assert left("run") > 150
    assert left("common.lean(run)") < 50


def test_vocabularies_are_let_go(spark):
    docs = spark.createDataFrame([(i, f"some words of text {i}") for i in range(20)], "doc_id bigint, text string").coalesce(1)
    assert packing.pack_texts(docs, public_tokenizers.path("byte_bpe_50k.json")).count() > 0

    def caches(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(common._workers)], pa.int64())], ["n"])

    sees = lambda: max(r["n"] for r in docs.mapInArrow(caches, "n bigint").collect())
    for _ in range(8):  # every worker that waits gets a turn
        common.filter_text(docs, "text", lambda: lambda texts: [True] * len(texts)).count()
    assert sees() == 0


def test_the_driver_gives_memory_back(spark, monkeypatch):
    assert "heap" in work.give_back_driver(spark)
    calls = []
    for module in (work, toxicity):
        monkeypatch.setattr(module, "give_back_driver", lambda s: calls.append(s), raising=False)
    docs = spark.createDataFrame([(i, f"some words of text {i}") for i in range(20)], "doc_id bigint, text string")
    work.forget(work.written(docs, "given-back"))
    assert len(calls) == 1
    toxicity.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id bigint, toxic int"))
    assert len(calls) == 3  # the sample is written, then trained on
