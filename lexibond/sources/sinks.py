"""Sinks of scored pairs and of the tables between."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet in a folder for each language and decade."""
    df.write.mode(mode).partitionBy("lang", "decade").parquet(path)


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Text lines ``lang TAB decade TAB w1 w2 TAB llr``, unquoted, as words may hold quotation marks."""
    line = F.concat_ws("\t", "lang", F.col("decade").cast("string"), F.concat_ws(" ", "w1", "w2"), F.col("llr").cast("string"))
    df.select(line.alias("value")).write.mode(mode).text(path)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """``lang, decade, w1, w2, llr`` of lines that ``write_tsv`` wrote."""
    f = F.split("value", "\t")
    pair = F.split(f[2], " ")
    return spark.read.text(path).select(f[0].alias("lang"), f[1].cast("int").alias("decade"), pair[0].alias("w1"), pair[1].alias("w2"), f[3].cast("double").alias("llr"))


def write_sequence_file(lines: DataFrame, path: str) -> None:
    """Sequence files of (number, text) from a column ``value``; Spark writes these through the RDD API.

    Numbers start beyond 32 bits: a file's key class follows the first one's size.
    """
    lines.select(F.monotonically_increasing_id() + (1 << 40), "value").rdd.map(tuple).saveAsSequenceFile(path)
