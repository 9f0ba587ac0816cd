import math
import random

import pytest
from pyspark.sql import Observation

from lexibond.operators import attach_margins, bigram_counts, corpus_size, drop_stopwords, top_k, unigram_counts
from lexibond.plans.pipeline import counted, counted_steps, run, scored_pairs, top_pairs, top_pairs_of_steps
from lexibond.sources import stopword_frame, token_pairs, token_steps, token_words, write_tsv

WORDS = "lang string, decade int, w string, occ bigint"
PAIRS = "lang string, decade int, w1 string, w2 string, occ bigint"


def frames(spark, parts=1, seed=0):
    words = [("EN", 1990, "a", 4), ("EN", 1990, "a", 6), ("EN", 1990, "b", 20), ("EN", 1990, "z", 970)]
    pairs = [("EN", 1990, "a", "b", 3), ("EN", 1990, "a", "b", 2), ("EN", 1990, "a", "unknown", 9), ("EN", 1990, "z", "z", 1)]
    random.Random(seed).shuffle(words)
    random.Random(seed).shuffle(pairs)
    return spark.createDataFrame(words, WORDS).repartition(parts), spark.createDataFrame(pairs, PAIRS).repartition(parts)


@pytest.mark.parametrize("parts", [1, 2, 8])
def test_counts_do_not_depend_on_partitions(spark, parts):
    rows = scored_pairs(*frames(spark, parts, parts)).collect()
    assert [(r["w1"], r["w2"]) for r in rows] == [("a", "b")]  # a word without count, and a pair with k22 < 0, are dropped
    assert math.isclose(rows[0]["llr"], 26.754070032434576, rel_tol=1e-9)


def test_ties_have_an_order(spark):
    rows = [("EN", 1990, *p.split(), s) for p, s in (("z z", 1.0), ("b a", 5.0), ("a c", 5.0), ("a b", 5.0))]
    for parts in (1, 2, 8):
        df = spark.createDataFrame(rows[:: -1 if parts == 2 else 1], "lang string, decade int, w1 string, w2 string, llr double").repartition(parts)
        got = sorted((r["rank"], r["w1"], r["w2"]) for r in top_k(df, 2).collect())
        assert got == [(1, "a", "b"), (2, "a", "c")]


def test_stopwords(spark):
    words, pairs = frames(spark)
    stop = stopword_frame(spark, {"EN": "b"})
    assert corpus_size(unigram_counts(drop_stopwords(words, stop, ("w",)))).first()["n"] == 980
    left = drop_stopwords(pairs, stop, ("w1", "w2")).select("w1", "w2").distinct().collect()
    assert {tuple(r) for r in left} == {("a", "unknown"), ("z", "z")}
    other = spark.createDataFrame([("XX", 1990, "b", 1), ("HE", 1990, "b", 1)], WORDS)
    assert [r["lang"] for r in drop_stopwords(other, stop, ("w",), fallback=True).collect()] == ["HE"]


def test_plan(spark):
    words, pairs = frames(spark)
    plan = top_pairs(words, pairs, stopword_frame(spark, {"EN": "q"}), k=10)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Broadcast" in plan
    assert "Python" not in plan.split("Physical Plan")[-1]


def test_margins(spark):
    words, pairs = frames(spark)
    r = attach_margins(bigram_counts(pairs), unigram_counts(words)).where("w1 = 'a'").first()
    assert (r["c12"], r["c1"], r["c2"], r["n"]) == (5, 10, 20, 1000)


def test_run(spark, tmp_path):
    words, pairs = frames(spark)
    assert run(words, pairs, lambda df: write_tsv(df, str(tmp_path / "out")), k=5) == {"scored": 1, "kept": 1}
    assert spark.read.text(str(tmp_path / "out")).first()[0].startswith("EN\t1990\ta b\t26.75")
    stats = Observation("x")
    top_pairs(words, pairs, stats=stats).collect()
    assert stats.get["scored"] == 1


def test_empty(spark):
    assert top_pairs(spark.createDataFrame([], WORDS), spark.createDataFrame([], PAIRS)).count() == 0


def test_one_pass_gives_both_counts(spark):
    """Steps give the counts of words and pairs, with and without stop words, and the plan reads their exchange twice."""
    texts = [("en", 1990, ["a", "b", "", "a", "b", "c"]), ("en", 1990, ["c"]), ("de", 2000, []), ("de", 2000, ["x", "x", "x"]), ("en", 1990, ["", ""])]
    tokens = spark.createDataFrame(texts, "lang string, decade int, toks array<string>").repartition(3)
    rows = lambda df: sorted(map(tuple, df.select(*sorted(df.columns)).collect()))
    for stop in (None, stopword_frame(spark, {"en": "b", "de": "q"})):
        unigrams, bigrams = counted_steps(token_steps(tokens), stop)
        words, pairs = counted(token_words(tokens), token_pairs(tokens), stop)
        assert rows(unigrams) == rows(words) and rows(bigrams) == rows(pairs)
    top = top_pairs_of_steps(token_steps(tokens), stopword_frame(spark, {"en": "b"}))
    top.collect()
    assert "ReusedExchange" in top._jdf.queryExecution().executedPlan().toString()


def test_stage_outputs(spark, tmp_path):
    words, pairs = frames(spark)
    got = []
    seen = run(words, pairs, lambda df: got.extend(df.collect()), k=5, stages=str(tmp_path / "st"))
    assert seen == {"scored": 1, "kept": 1} and len(got) == 1
    assert {p.name for p in (tmp_path / "st").iterdir()} == {"words", "sizes", "pairs", "scored"}
    assert spark.read.parquet(str(tmp_path / "st" / "sizes")).first()["n"] == 1000
