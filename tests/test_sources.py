import pytest
from pyspark.sql import Observation

from lexibond.sources import parse_pairs, parse_stopwords, parse_words, read_ngrams, read_stopwords, write_parquet, write_sequence_file, write_tsv

LINES = ["fish\t1990\t5\t3\t2", "fish\t 1990 \t+5", "fish\t1990", "fish\t1990.7\t5", "fish\t1990\t1e3", "fish\t1990\t", "fish\t1990\t0", "fish\t1990\t-2", "...\t1990\t5", "foo bar\t2001\t1", "fish\t99999999999\t1", ""]
PAIRS = ["fish\t1990\t5", "red fish pond\t1990\t5", "the fish\t1990\t5", "red ...\t1990\t1", " red fish\t1990\t1", "red\tfish\t1990\t5", "Red_ADJ Fish_NOUN\t1999\t7\t1"]


def test_words(spark):
    rows = parse_words(spark.createDataFrame([("EN", x) for x in LINES], "lang string, value string")).collect()
    assert sorted((r["decade"], r["w"], r["occ"]) for r in rows) == [(1990, "fish", 5), (1990, "fish", 5), (2000, "foo bar", 1)]


def test_pairs(spark):
    rows = parse_pairs(spark.createDataFrame([("EN", x) for x in PAIRS], "lang string, value string")).collect()
    assert sorted((r["w1"], r["w2"], r["occ"]) for r in rows) == [("red", "fish", 5), ("red", "fish", 7), ("the", "fish", 5)]


@pytest.mark.parametrize("fmt", ["text", "parquet", "sequencefile"])
def test_read(spark, tmp_path, fmt):
    for name in ("eng", "heb"):
        path = str(tmp_path / f"{name}-1gram")
        lines = [f"{name}word\t1990\t{i + 1}" for i in range(3)]
        if fmt == "sequencefile":
            spark.sparkContext.parallelize([(i, x) for i, x in enumerate(lines)]).saveAsSequenceFile(path)
        else:
            spark.createDataFrame([(x,) for x in lines], "value string").write.format(fmt).save(path)
    by_path = read_ngrams(spark, f"{tmp_path}/*-1gram" if fmt != "sequencefile" else f"{tmp_path}/eng-1gram,{tmp_path}/heb-1gram", 1, fmt)
    named = read_ngrams(spark, {"EN": f"{tmp_path}/eng-1gram", "HE": f"{tmp_path}/heb-1gram"}, 1, fmt)
    want = sorted((lang, f"{name}word", i + 1) for lang, name in (("EN", "eng"), ("HE", "heb")) for i in range(3))
    for df in (by_path, named):
        assert sorted((r["lang"], r["w"], r["occ"]) for r in df.collect()) == want


def test_stopwords(spark, tmp_path):
    (tmp_path / "eng-stopwords.txt").write_text("﻿The\n\n# note\n  a \nthe\n'tis\n", encoding="utf-8")
    (tmp_path / "Heb-Stopwords.txt").write_text("של\n", encoding="utf-8")
    (tmp_path / "other.txt").write_text("word\n")
    got = read_stopwords(spark, *(str(tmp_path / n) for n in ("eng-stopwords.txt", "Heb-Stopwords.txt", "other.txt"))).collect()
    assert sorted(map(tuple, got)) == sorted([("EN", "the"), ("EN", "a"), ("EN", "'tis"), ("HE", "של")])
    assert read_stopwords(spark).count() == 0
    assert parse_stopwords(spark.createDataFrame([], "lang string, value string")).count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("HE", 1990, 'צה"ל', "x", 1.5)], "lang string, decade int, w1 string, w2 string, llr double")
    write_tsv(df, str(tmp_path / "tsv"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "tsv")).collect()] == ['HE\t1990\tצה"ל x\t1.5']
    write_parquet(df, str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq")).where("lang = 'HE' and decade = 1990").count() == 1


def test_sequence_files_need_no_python(spark, tmp_path):
    for name, n in (("eng-a", 3000), ("heb-b", 2500)):
        write_sequence_file(spark.range(n).selectExpr(f"concat('word', id, '\\t1990\\t', id + 1) as value").repartition(3), str(tmp_path / name))
    rows = read_ngrams(spark, f"{tmp_path}/*-?", 1, "sequencefile")
    assert {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()} == {"EN": 3000, "HE": 2500}
    assert "Python" not in rows._jdf.queryExecution().toString()
    assert read_ngrams(spark, f"{tmp_path}/none-*", 1, "sequencefile").count() == 0


def test_parse_counters(spark):
    stats = Observation("lines")
    parse_words(spark.createDataFrame([("EN", x) for x in [*LINES, None]], "lang string, value string"), stats).collect()
    assert stats.get == {"lines": 13, "short": 3, "bad_year": 2, "bad_count": 2, "not_positive": 2}
