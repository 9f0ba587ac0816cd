import math

import pytest
from pyspark.sql import functions as F

from lexibond.functions import clean_token, decade, lang_from_path, llr

TOKENS = {
    "run_VERB": "run", "a_b_c": "a", "_foo_NOUN": "foo_noun", " _foo_X": "foo_x", "'_x": "", "_": "", "...": "", "'tis": "tis", "don't": "don't",
    "U.S.A.": "u.s.a", "2nd": "2nd", "É_X": "é", 'צה"ל': 'צה"ל', "שָׁ": "ש", "": "", " \t ": "", "\x01word\x02": "word", None: "",
}


def test_clean_token(spark):
    rows = spark.createDataFrame([(t,) for t in TOKENS], "t string").select("t", clean_token(F.col("t")).alias("w")).collect()
    assert {r["t"]: r["w"] for r in rows} == TOKENS


def test_decade(spark):
    years = {1999: 1990, 2000: 2000, 1990: 1990, -5: 0, 9: 0, -15: -10}
    rows = spark.createDataFrame([(y,) for y in years], "y int").select("y", decade(F.col("y")).alias("d"))
    assert {r["y"]: r["d"] for r in rows.collect()} == years
    assert dict(rows.dtypes)["d"] == "int"


def test_lang_from_path(spark):
    paths = {"s3://x/eng-all/1": "EN", "s3://x/HEB-all/1": "HE", None: "Unknown"}
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", lang_from_path(F.col("p")).alias("l")).collect()
    assert {r["p"]: r["l"] for r in rows} == paths


GOLDEN = [
    (10, 20, 5, 1000, 26.754070032434576), (10, 20, 5, 500, 19.95449070637065), (10, 20, 3, 1000, 11.961830755544874),
    (10, 20, 2, 1000, 6.1354578493570315), (10, 10, 10, 1000, 112.00306870969483), (100, 100, 10, 1000, 0.0), (10, 10, 10, 10, 0.0),
    (500, 500, 1, 1000, 1357.4399313955382), (5, 5, 6, 100, None), (60, 60, 1, 100, None), (10, 20, 0, 1000, None), (0, 20, 1, 1000, None), (10, 20, 5, 0, None),
]


@pytest.mark.parametrize("swap", [False, True])
def test_llr(spark, swap):
    rows = spark.createDataFrame([g[:4] for g in GOLDEN], "c1 bigint, c2 bigint, c12 bigint, n bigint")
    c = ["c2", "c1"] if swap else ["c1", "c2"]
    got = rows.select("c1", "c2", "c12", "n", llr(F.col(c[0]), F.col(c[1]), F.col("c12"), F.col("n")).alias("v")).collect()
    values = {tuple(r)[:4]: r["v"] for r in got}
    for *counts, want in GOLDEN:
        v = values[tuple(counts)]
        assert v is None if want is None else math.isclose(v, want, rel_tol=1e-9, abs_tol=1e-9)
