"""Stop-word lists."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexibond.functions.text import LANG_EN, LANG_HE

#: The file names that are read, and their language.
STOPWORD_FILES = {"eng-stopwords.txt": LANG_EN, "heb-stopwords.txt": LANG_HE}

#: Common function words, for corpora that bring no list of their own.
STOPWORDS = {
    "en": "a an and are as at be by for from has he in is it of on or that the this to was with",
    "de": "als auch auf das dem den der des die ein eine für ich im in ist mit nicht sich sie und von zu",
    "fr": "au avec ce dans de des du elle en est et il la le les ne pas pour que qui sur un une",
    "es": "al como con de del el en es la las lo los más no para por que se su un una y",
}


def parse_stopwords(lines: DataFrame) -> DataFrame:
    """``lang, sw`` from ``lang, value``: no byte-order marks, trimmed, lower case; blanks and '#' lines dropped."""
    word = F.regexp_replace(F.col("value"), "﻿", "")
    word = F.lower(F.regexp_replace(word, r"^[\x00-\x20]+|[\x00-\x20]+$", ""))
    return lines.select("lang", word.alias("sw")).where("sw <> '' and sw not like '#%'").distinct()


def read_stopwords(spark: SparkSession, *paths: str) -> DataFrame:
    """``lang, sw`` of the files that have one of the known names; others are ignored, none gives no rows."""
    out = spark.createDataFrame([], "lang string, sw string")
    for path in paths:
        if lang := STOPWORD_FILES.get(path.rstrip("/").rsplit("/", 1)[-1].lower()):
            out = out.unionByName(parse_stopwords(spark.read.text(path).select(F.lit(lang).alias("lang"), "value")))
    return out


def stopword_frame(spark: SparkSession, words: dict[str, str] = STOPWORDS) -> DataFrame:
    """``lang, sw`` of lists in the program."""
    return spark.createDataFrame([(k, w) for k, v in words.items() for w in v.split()], "lang string, sw string")
