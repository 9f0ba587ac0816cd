"""The document pipeline, stage by stage."""

import random

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from lexibond.llm import exact, toxicity
from lexibond.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def changed(text, n):
    """The text with ``n`` of its 120 words replaced, well apart."""
    words = text.split()
    for k in range(n):
        words[15 + 25 * k] = f"other{k}"
    return " ".join(words)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Documents of which some are toxic, copies, near copies or leaks; labels and a benchmark."""
    d = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(6)
    prose = lambda n: " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else f"w{rng.randrange(3000)}" for _ in range(n))
    rows = [(i, prose(120), "en", "s", 1) for i in range(300)]
    labels = []
    for i in range(0, 120, 2):
        rows[i] = (i, f"{prose(30)} idiot {prose(30)} moron", "en", "s", 1)
    labels = [(i, 1, int(i < 120 and i % 2 == 0)) for i in range(300)]
    rows += [(1000 + i, rows[201 + i][1].upper(), "en", "s", 1) for i in range(10)]
    rows += [(2000 + i, changed(rows[221 + i][1], 2), "en", "s", 1) for i in range(5)]  # 10 of 116 shingles differ: 0.84
    rows += [(2100 + i, changed(rows[231 + i][1], 4), "en", "s", 1) for i in range(5)]  # 20 of 116: 0.71
    bench = [(i, prose(30)) for i in range(5)]
    rows += [(3000 + i, f"{prose(40)} {bench[i][1]} {prose(40)}", "en", "s", 1) for i in range(5)]
    rows += [(4000, None, None, None, None), (4001, "", "en", "s", 0), (4002, prose(20_000), "en", "s", 1), (None, prose(50), "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        out.write.parquet(f"{sf_dir}/after-{name}")
        docs = spark.read.parquet(f"{sf_dir}/after-{name}")
        left[name] = {r["doc_id"] for r in docs.collect()}
    before = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert before - left["toxicity"] == set(range(0, 120, 2))
    assert left["toxicity"] - left["exact_dedup"] == {*range(201, 211), 4000}  # the larger id of a group stays
    assert left["exact_dedup"] - left["simhash_dedup"] == set(range(2000, 2005))
    assert left["simhash_dedup"] - left["decontamination"] == set(range(3000, 3005))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == left["decontamination"]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).collect()} == left["decontamination"]


def test_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_registered():
    names = entry.queries()
    assert [n for k in range(1, 11) for n in names if n.startswith(f"op{k}_")] == sorted((n for n in queries() if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))
    assert set(queries()) <= set(names) and set(oracle_sql()) <= set(queries())
    assert names["pipeline"] is corpus_pipeline.run and corpus_pipeline.ORACLE_SQL is None
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_dedup", "decontamination", "packing"]


def test_exact_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.sql(oracle_sql()["op1_exact_dedup"]).fetchall())
    assert sorted(map(tuple, exact.dedup_documents(spark.read.parquet(f"{SF}/documents.parquet")).collect())) == want


def test_filter_keeps_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("*", "struct(doc_id) as extra", "doc_id as score")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert toxicity.clean(docs, model).schema == docs.schema
