"""Pre-counted n-grams: lines of ``ngram TAB year TAB occurrences [TAB ignored]``."""

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lexibond.functions.text import HE_PATH_MARK, LANG_EN, LANG_HE, clean_token, decade, lang_from_path, split_pair
from lexibond.sources.work import store


def _sequence_file(spark: SparkSession, path: str) -> DataFrame:
    """``off, value`` of sequence files. Records become rows in the JVM; no Python worker takes part."""
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    pickled = jvm.PythonRDD.sequenceFile(jsc, path, None, None, None, None, spark.sparkContext.defaultMinPartitions, 0)
    rows = jvm.SerDeUtil.toJavaArray(jvm.SerDeUtil.pythonToJava(pickled, True)).rdd()
    schema = StructType([StructField("off", LongType()), StructField("value", StringType())])
    return DataFrame(spark._jsparkSession.applySchemaToPythonRDD(rows, schema.json()), spark)


def _files(spark: SparkSession, path: str) -> list[str]:
    """The data files of comma-separated paths, patterns and folders."""
    out = []
    for one in path.split(","):
        fs, p = store(spark, one)
        for found in fs.globStatus(p) or []:
            files = fs.listFiles(found.getPath(), True)
            while files.hasNext():
                f = files.next().getPath()
                if not f.getName().startswith(("_", ".")):
                    out.append(f.toString())
    return out


def read_lines(spark: SparkSession, path: str, fmt: str = "text", lang: str | None = None) -> DataFrame:
    """Lines of one corpus as ``lang, value``.

    ``fmt``: 'text', 'parquet' (a column ``value``) or 'sequencefile' (number, text; compressed or not).
    Without ``lang`` it comes from each file's path (``lang_from_path``). Sequence files are listed on the driver for that,
    and those of a language are read together.
    """
    if fmt != "sequencefile":
        raw = spark.read.format(fmt).load(path)
        return raw.select((F.lit(lang) if lang else lang_from_path(F.col("_metadata.file_path"))).alias("lang"), "value")
    by_lang = {lang: path}
    if not lang:
        files = _files(spark, path)
        by_lang = {k: ",".join(f for f in files if (HE_PATH_MARK in f.lower()) == (k == LANG_HE)) for k in (LANG_EN, LANG_HE)}
    out = spark.createDataFrame([], "lang string, value string")
    for k, paths in by_lang.items():
        if paths:
            out = out.unionByName(_sequence_file(spark, paths).select(F.lit(k).alias("lang"), "value"))
    return out


def _fields(lines: DataFrame, stats: Observation | None = None) -> DataFrame:
    """``lang, ngram, year, occ`` of the well-formed lines; others are dropped.

    ``stats`` observes ``lines``, and those dropped: ``short`` (fewer than three fields), ``bad_year``, ``bad_count``
    (no number) and ``not_positive``, each counted once, in this order.
    """
    part = F.split("value", "\t")
    field = lambda i: F.get(part, F.lit(i))
    number = lambda c, kind: F.trim(c).try_cast(kind)
    rows = lines.select("lang", F.coalesce(F.size(part) >= 3, F.lit(False)).alias("whole"), field(0).alias("ngram"), number(field(1), "int").alias("year"), number(field(2), "bigint").alias("occ"))
    whole, year, occ = F.col("whole"), F.col("year").isNotNull(), F.col("occ")
    if stats is not None:
        kinds = {"short": ~whole, "bad_year": whole & ~year, "bad_count": whole & year & occ.isNull(), "not_positive": whole & year & (occ <= 0)}
        rows = rows.observe(stats, F.count(F.lit(1)).alias("lines"), *(F.count(F.when(v, 1)).alias(k) for k, v in kinds.items()))
    return rows.where(whole & year & (occ > 0)).drop("whole")


def _kept(lang: Column, year: Column, occ: Column) -> list[Column]:
    return [lang.alias("lang"), decade(year).alias("decade"), occ.alias("occ")]


def parse_words(lines: DataFrame, stats: Observation | None = None) -> DataFrame:
    """``lang, decade, occ, w`` from 1-gram lines. The n-gram is one token even if it holds spaces."""
    c = F.col
    rows = _fields(lines, stats).select(*_kept(c("lang"), c("year"), c("occ")), clean_token(c("ngram")).alias("w"))
    return rows.where("w <> ''")


def parse_pairs(lines: DataFrame, stats: Observation | None = None) -> DataFrame:
    """``lang, decade, occ, w1, w2`` from 2-gram lines; of more words than two the first two count."""
    c = F.col
    words = _fields(lines, stats).withColumn("ws", split_pair(c("ngram"))).where(F.size("ws") >= 2)
    rows = words.select(
        *_kept(c("lang"), c("year"), c("occ")), clean_token(c("ws")[0]).alias("w1"), clean_token(c("ws")[1]).alias("w2")
    )
    return rows.where("w1 <> '' and w2 <> ''")


def read_ngrams(spark: SparkSession, paths: dict[str, str] | str, n: int, fmt: str = "text") -> DataFrame:
    """Parsed 1- or 2-grams of one path (language from the path) or of ``{lang: path}``."""
    parse = {1: parse_words, 2: parse_pairs}[n]
    if isinstance(paths, str):
        return parse(read_lines(spark, paths, fmt))
    frames = [parse(read_lines(spark, path, fmt, lang)) for lang, path in paths.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
