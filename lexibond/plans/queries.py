"""Registered queries over the test tables, each with SQL that another engine can check it by."""

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lexibond.functions.text import clean_token, decade, lang_from_path
from lexibond.operators import attach_first, attach_margins, bigram_counts, corpus_size, drop_stopwords, score, top_k, unigram_counts
from lexibond.plans.pipeline import counted_steps, run, scored_pairs, top_pairs, top_pairs_of_steps
from lexibond.sources import (
    STOPWORDS, conversation_tokens, document_tokens, parse_pairs, parse_stopwords, parse_words, part_ngrams, part_steps, read_ngrams, read_tsv,
    stopword_frame, token_pairs, token_steps, token_words, write_parquet, write_sequence_file, write_tsv,
)
from lexibond.sources.corpus import part_pairs, part_words
from lexibond.sources.work import workspace

#: Scores are rounded before ranking, so that two engines' logarithms rank alike.
DIGITS = 6


def _read(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def _doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_tokens(_read(spark, sf_dir, "documents")[0].select("doc_id", "lang", "text"))


def _doc_words(spark: SparkSession, sf_dir: str, stop: bool) -> DataFrame:
    words = token_words(_doc_tokens(spark, sf_dir))
    return drop_stopwords(words, stopword_frame(spark), ("w",)) if stop else words


def _doc_pairs(spark: SparkSession, sf_dir: str, stop: bool) -> DataFrame:
    pairs = token_pairs(_doc_tokens(spark, sf_dir))
    return drop_stopwords(pairs, stopword_frame(spark), ("w1", "w2")) if stop else pairs


def _doc_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_steps(_doc_tokens(spark, sf_dir))


def clean_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _read(spark, sf_dir, "documents")[0].select(F.explode(F.split("text", r"\s+")).alias("raw"))
    return raw.select(clean_token(F.col("raw")).alias("w")).where("w <> ''").groupBy("w").agg(F.count("*").alias("n"))


def decade_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders")[0]
    return orders.select("o_orderkey", decade(F.year("o_orderdate")).alias("decade"))


def _part_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as n-gram lines, some of them malformed."""
    lineitem, orders, part = _read(spark, sf_dir, "lineitem", "orders", "part")
    rows = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    kind = F.col("l_orderkey") % 7
    year, occ = F.year("o_orderdate").cast("string"), F.col("l_quantity").cast("bigint").cast("string")
    line = (
        F.when(kind == 0, F.concat_ws("\t", "p_name", year))
        .when(kind == 1, F.concat_ws("\t", "p_name", F.concat(year, F.lit(".7")), occ))
        .when(kind == 2, F.concat_ws("\t", "p_name", year, F.lit("-2")))
        .when(kind == 3, F.concat_ws("\t", "p_name", F.concat(F.lit(" "), year, F.lit(" ")), occ, F.lit("9")))
        .when(kind == 4, F.concat_ws("\t", F.concat(F.col("p_name"), F.lit("_NOUN")), year, occ))
        .otherwise(F.concat_ws("\t", "p_name", year, occ))
    )
    return rows.select(F.lit("EN").alias("lang"), line.alias("value"))


def parse_ngram_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse_pairs(_part_lines(spark, sf_dir))
    return rows.groupBy("lang", "decade", "w1", "w2").agg(F.sum("occ").alias("occ"), F.count("*").alias("n_rows"))


def parse_word_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse_words(_part_lines(spark, sf_dir))
    return rows.groupBy("lang", "decade", "w").agg(F.sum("occ").alias("occ"), F.count("*").alias("n_rows"))


def _part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_ngrams(*_read(spark, sf_dir, "lineitem", "orders", "part"))


def _part_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ngrams = _part_names(spark, sf_dir)
    return part_words(ngrams), part_pairs(ngrams)


def _margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, pairs = counted_steps(_doc_steps(spark, sf_dir), stopword_frame(spark))
    return attach_margins(pairs, words)


def _first_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, pairs = counted_steps(_doc_steps(spark, sf_dir), stopword_frame(spark))
    return attach_first(pairs, words)


def llr_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, pairs = counted_steps(part_steps(_part_names(spark, sf_dir)))
    return score(attach_margins(pairs, words), DIGITS)


def _folder(spark: SparkSession, name: str) -> str:
    return workspace(spark, f"query-{name}")


def _read_sequence_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part lines written to sequence files in two folders, one of which is Hebrew by its name; read in one call."""
    lines, base = _part_lines(spark, sf_dir).select("value"), _folder(spark, "sequence")
    for name, own in (("eng-2gram", "value like '%a%'"), ("heb-2gram", "not (value like '%a%')")):
        write_sequence_file(lines.where(own), f"{base}/{name}")
    rows = read_ngrams(spark, f"{base}/*-2gram", 2, "sequencefile")
    return rows.groupBy("lang", "decade", "w1", "w2").agg(F.sum("occ").alias("occ"), F.count("*").alias("n_rows"))


def _read_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines as text of one language and parquet of another, united."""
    lines, base = _part_lines(spark, sf_dir).select("value"), _folder(spark, "languages")
    lines.write.text(f"{base}/english")
    lines.write.text(f"{base}/other")
    rows = read_ngrams(spark, {"EN": f"{base}/english", "HE": f"{base}/other"}, 1)
    return rows.groupBy("lang", "decade", "w").agg(F.sum("occ").alias("occ"), F.count("*").alias("n_rows"))


def _parse_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = Observation("parse")
    parse_pairs(_part_lines(spark, sf_dir), stats).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame(sorted(stats.get.items()), "counter string, n bigint")


def _write_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "tsv")
    write_tsv(QUERIES["top_pairs_parts"](spark, sf_dir), path)
    return read_tsv(spark, path)


def _write_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "parquet")
    write_parquet(QUERIES["top_pairs_parts"](spark, sf_dir), path)
    return spark.read.schema("w1 string, w2 string, llr double, rank int, lang string, decade int").parquet(path)


def _stage_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and sums of the tables that a run leaves, and what it observed."""
    path, words, pairs = _folder(spark, "stages"), *_part_inputs(spark, sf_dir)
    seen = run(words, pairs, lambda df: write_parquet(df, f"{path}/top"), k=5, digits=DIGITS, stages=path)
    sums = {"words": "c", "sizes": "n", "pairs": "c12", "scored": "cast(1 as bigint)"}
    out = spark.createDataFrame([(f"observed {k}", v, v) for k, v in seen.items()], "stage string, n_rows bigint, total bigint")
    for name, column in sums.items():
        out = out.unionByName(spark.read.parquet(f"{path}/{name}").agg(F.count("*").alias("n_rows"), F.expr(f"sum({column})").alias("total")).withColumn("stage", F.lit(name)))
    return out


def _stop_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every language but Hebrew takes the English list."""
    words = token_words(_doc_tokens(spark, sf_dir))
    return unigram_counts(drop_stopwords(words, stopword_frame(spark, {"EN": STOPWORDS["en"]}), ("w",), fallback=True))


def _trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names within controls and spaces, with a part of speech."""
    name = F.concat(F.lit("\x01 \t"), F.col("p_name"), F.lit("_NOUN_X\x1f "))
    return _read(spark, sf_dir, "part")[0].select("p_partkey", clean_token(name).alias("w"))


def _paths(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p,) for p in PATHS], "path string")


def _stop_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _read(spark, sf_dir, "nation")[0]
    line = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("﻿ "), "n_name")).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit("#"), "n_name")).otherwise(F.concat("n_name", F.lit(" ")))
    return parse_stopwords(items.select(F.lit("EN").alias("lang"), line.alias("value")))


#: Paths for the query lang_from_path.
PATHS = ("s3://books/eng-gb-all/1gram/data", "s3://books/heb-all/2gram/data", "/data/HEBREW/part-0", "file:/x/en", "")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "clean_tokens": clean_tokens,
    "decade_bucket": decade_bucket,
    "lang_from_path": lambda s, d: _paths(s).select("path", lang_from_path(F.col("path")).alias("lang")),
    "parse_stopwords": _stop_lines,
    "parse_ngram_rows": parse_ngram_rows,
    "parse_word_rows": parse_word_rows,
    "unigram_counts": lambda s, d: unigram_counts(_doc_words(s, d, False)),
    "bigram_counts": lambda s, d: bigram_counts(_doc_pairs(s, d, False)),
    "corpus_size": lambda s, d: corpus_size(unigram_counts(_doc_words(s, d, False))),
    "stopword_filtered_unigrams": lambda s, d: unigram_counts(_doc_words(s, d, True)),
    "stopword_filtered_bigrams": lambda s, d: bigram_counts(_doc_pairs(s, d, True)),
    "stopword_fallback": _stop_fallback,
    "trim_controls": _trimmed,
    "pairs_with_c1": _first_margins,
    "pairs_with_margins": _margins,
    "llr_scores": llr_scores,
    "top_k_llr": lambda s, d: top_k(llr_scores(s, d), 5),
    "top_pairs_parts": lambda s, d: top_pairs_of_steps(part_steps(_part_names(s, d)), k=10, digits=DIGITS),
    "top_pairs_counted": lambda s, d: top_pairs(*_part_inputs(s, d), k=10, digits=DIGITS),
    "scored_by_row": lambda s, d: scored_pairs(*_part_inputs(s, d), digits=DIGITS),
    "top_pairs_documents": lambda s, d: top_pairs_of_steps(_doc_steps(s, d), stopword_frame(s), 100, DIGITS),
    "top_pairs_conversations": lambda s, d: top_pairs_of_steps(token_steps(conversation_tokens(_read(s, d, "conversations")[0])), None, 100, DIGITS),
    "read_sequence_files": _read_sequence_files,
    "read_languages": _read_languages,
    "parse_counters": _parse_counters,
    "write_read_tsv": _write_tsv,
    "write_read_parquet": _write_parquet,
    "stage_outputs": _stage_outputs,
}


def _clean(x: str) -> str:
    t = rf"regexp_replace({x}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"
    t = rf"regexp_replace({t}, '(?s)^([^_]+)_.*$', '\1')"
    t = rf"regexp_replace({t}, '^[^\p{{L}}\p{{N}}]+', '')"
    return rf"lower(regexp_replace({t}, '[^\p{{L}}\p{{N}}]+$', ''))"


def _stop_sql(col: str) -> str:
    lists = (f"lang = '{k}' AND {col} IN ({', '.join(repr(w) for w in v.split())})" for k, v in STOPWORDS.items())
    return "NOT (" + " OR ".join(f"({x})" for x in lists) + ")"


_ARRAYS = rf"SELECT lang, CAST(((1900 + doc_id % 100) // 10) * 10 AS INTEGER) AS decade, regexp_split_to_array(coalesce(text, ''), '\s+') AS a FROM documents"
_CONV = rf"SELECT role AS lang, CAST(2000 AS INTEGER) AS decade, regexp_split_to_array(coalesce(text, ''), '\s+') AS a FROM conversations"


def _words_sql(arrays: str, stop: bool) -> str:
    x = f"SELECT * FROM (SELECT lang, decade, {_clean('t')} AS w, 1 AS occ FROM (SELECT lang, decade, unnest(a) AS t FROM ({arrays}))) x WHERE w <> ''"
    return x + (f" AND {_stop_sql('w')}" if stop else "")


def _pairs_sql(arrays: str, stop: bool) -> str:
    x = f"SELECT * FROM (SELECT lang, decade, {_clean('t1')} AS w1, {_clean('t2')} AS w2, 1 AS occ FROM (SELECT lang, decade, unnest(a[:-2]) AS t1, unnest(a[2:]) AS t2 FROM ({arrays}))) x WHERE w1 <> '' AND w2 <> ''"
    return x + (f" AND {_stop_sql('w1')} AND {_stop_sql('w2')}" if stop else "")


def _uni_sql(words: str) -> str:
    return f"SELECT lang, decade, w, CAST(sum(occ) AS BIGINT) AS c FROM ({words}) GROUP BY lang, decade, w"


def _bi_sql(pairs: str) -> str:
    return f"SELECT lang, decade, w1, w2, CAST(sum(occ) AS BIGINT) AS c12 FROM ({pairs}) GROUP BY lang, decade, w1, w2"


def _margins_sql(words: str, pairs: str) -> str:
    """Words are joined by one composed key; with several columns the engine may join the two word tables first."""
    key = "concat_ws(chr(9), lang, decade, {})".format
    return f"""WITH uni AS MATERIALIZED (SELECT {key("w")} AS k, * FROM ({_uni_sql(words)})),
        bi AS MATERIALIZED (SELECT {key("w1")} AS k1, {key("w2")} AS k2, * FROM ({_bi_sql(pairs)})),
        sizes AS MATERIALIZED (SELECT concat_ws(chr(9), lang, decade) AS k, CAST(sum(c) AS BIGINT) AS n FROM uni GROUP BY lang, decade)
        SELECT bi.lang, bi.decade, bi.w1, bi.w2, bi.c12, a.c AS c1, b.c AS c2, sizes.n FROM bi
        JOIN uni a ON a.k = bi.k1 JOIN uni b ON b.k = bi.k2
        JOIN sizes ON sizes.k = concat_ws(chr(9), bi.lang, bi.decade)"""


def _llr_sql(margins: str) -> str:
    k = {"k11": "c12", "k12": "c1 - c12", "k21": "c2 - c12", "k22": "n - c1 - c2 + c12"}
    cells = ", ".join(f"CAST({v} AS DOUBLE) AS {name}" for name, v in k.items())

    def term(i: int, j: int) -> str:
        e = f"((k{i}1 + k{i}2) * (k1{j} + k2{j}) / (k11 + k12 + k21 + k22))"
        return f"CASE WHEN k{i}{j} = 0 OR {e} <= 0 THEN 0.0 ELSE k{i}{j} * ln(k{i}{j} / {e}) END"

    return f"""SELECT lang, decade, w1, w2, round(2.0 * ({term(1, 1)} + {term(1, 2)} + {term(2, 1)} + {term(2, 2)}), {DIGITS}) AS llr
        FROM (SELECT lang, decade, w1, w2, {cells} FROM ({margins}) WHERE c12 > 0 AND c1 >= c12 AND c2 >= c12 AND n > 0 AND n - c1 - c2 + c12 >= 0)"""


def _top_sql(scored: str, k: int) -> str:
    return f"""SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, decade ORDER BY llr DESC, w1, w2) AS INTEGER) AS rank FROM ({scored})) WHERE rank <= {k}"""


_JOINED = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"
_PARTS = rf"SELECT 'EN' AS lang, CAST((year(o_orderdate) // 10) * 10 AS INTEGER) AS decade, regexp_split_to_array(p_name, '\s+') AS a, CAST(l_quantity AS BIGINT) AS occ FROM {_JOINED}"
_PART_WORDS = f"SELECT lang, decade, {_clean('t')} AS w, occ FROM (SELECT lang, decade, occ, unnest(a[1:2]) AS t FROM ({_PARTS}))"
_PART_PAIRS = f"SELECT lang, decade, {_clean('a[1]')} AS w1, {_clean('a[2]')} AS w2, occ FROM ({_PARTS}) WHERE len(a) >= 2"
_PART_LLR = _llr_sql(_margins_sql(_PART_WORDS, _PART_PAIRS))
#: Lines of kinds 0 to 2 are malformed.
_GOOD = f"SELECT 'EN' AS lang, CAST((year(o_orderdate) // 10) * 10 AS INTEGER) AS decade, p_name, CAST(l_quantity AS BIGINT) AS occ FROM {_JOINED} WHERE l_orderkey % 7 > 2"

ORACLES: dict[str, str] = {
    "clean_tokens": rf"SELECT w, count(*) AS n FROM (SELECT {_clean('t')} AS w FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS t FROM documents)) WHERE w <> '' GROUP BY w",
    "decade_bucket": 'SELECT o_orderkey, CAST((year(o_orderdate) // 10) * 10 AS INTEGER) AS "decade" FROM orders',
    "lang_from_path": f"SELECT path, CASE WHEN lower(path) LIKE '%heb%' THEN 'HE' ELSE 'EN' END AS lang FROM (VALUES {', '.join(f"('{p}')" for p in PATHS)}) AS v(path)",
    "parse_stopwords": "SELECT DISTINCT 'EN' AS lang, lower(trim(n_name)) AS sw FROM nation WHERE n_nationkey % 3 <> 1",
    "parse_ngram_rows": f"SELECT lang, decade, lower(split_part(p_name, ' ', 1)) AS w1, lower(split_part(p_name, ' ', 2)) AS w2, CAST(sum(occ) AS BIGINT) AS occ, count(*) AS n_rows FROM ({_GOOD}) GROUP BY ALL",
    "parse_word_rows": f"SELECT lang, decade, lower(p_name) AS w, CAST(sum(occ) AS BIGINT) AS occ, count(*) AS n_rows FROM ({_GOOD}) GROUP BY ALL",
    "unigram_counts": _uni_sql(_words_sql(_ARRAYS, False)),
    "bigram_counts": _bi_sql(_pairs_sql(_ARRAYS, False)),
    "corpus_size": f"SELECT lang, decade, count(*) AS n FROM ({_words_sql(_ARRAYS, False)}) GROUP BY lang, decade",
    "stopword_filtered_unigrams": _uni_sql(_words_sql(_ARRAYS, True)),
    "stopword_filtered_bigrams": _bi_sql(_pairs_sql(_ARRAYS, True)),
    "stopword_fallback": _uni_sql(_words_sql(_ARRAYS, False) + f" AND w NOT IN ({', '.join(repr(w) for w in STOPWORDS['en'].split())})"),
    "trim_controls": f"SELECT p_partkey, {_clean("chr(1) || ' ' || chr(9) || p_name || '_NOUN_X' || chr(31) || ' '")} AS w FROM part",
    "pairs_with_c1": f"SELECT lang, decade, w1, w2, c12, c1 FROM ({_margins_sql(_words_sql(_ARRAYS, True), _pairs_sql(_ARRAYS, True))})",
    "pairs_with_margins": _margins_sql(_words_sql(_ARRAYS, True), _pairs_sql(_ARRAYS, True)),
    "llr_scores": _PART_LLR,
    "top_k_llr": _top_sql(_PART_LLR, 5),
    "top_pairs_parts": _top_sql(_PART_LLR, 10),
    "top_pairs_counted": _top_sql(_PART_LLR, 10),
    "scored_by_row": _PART_LLR,
    "read_sequence_files": f"SELECT CASE WHEN line LIKE '%a%' THEN 'EN' ELSE 'HE' END AS lang, decade, lower(split_part(p_name, ' ', 1)) AS w1, lower(split_part(p_name, ' ', 2)) AS w2, CAST(sum(occ) AS BIGINT) AS occ, count(*) AS n_rows FROM (SELECT *, p_name AS line FROM ({_GOOD})) GROUP BY ALL",
    "read_languages": f"SELECT l.lang, decade, lower(p_name) AS w, CAST(sum(occ) AS BIGINT) AS occ, count(*) AS n_rows FROM ({_GOOD}) g, (VALUES ('EN'), ('HE')) l(lang) GROUP BY ALL",
    "parse_counters": f"SELECT counter, n FROM (SELECT count(*) AS lines, count(*) FILTER (l_orderkey % 7 = 0) AS short, count(*) FILTER (l_orderkey % 7 = 1) AS bad_year, CAST(0 AS BIGINT) AS bad_count, count(*) FILTER (l_orderkey % 7 = 2) AS not_positive FROM {_JOINED}) UNPIVOT (n FOR counter IN (lines, short, bad_year, bad_count, not_positive))",
    "write_read_tsv": f"SELECT lang, decade, w1, w2, llr FROM ({_top_sql(_PART_LLR, 10)})",
    "write_read_parquet": _top_sql(_PART_LLR, 10),
    "stage_outputs": f"""WITH words AS MATERIALIZED ({_uni_sql(_PART_WORDS)}), pairs AS MATERIALIZED ({_margins_sql(_PART_WORDS, _PART_PAIRS)}), scored AS MATERIALIZED ({_PART_LLR})
        SELECT 'words' AS stage, count(*) AS n_rows, CAST(sum(c) AS BIGINT) AS total FROM words UNION ALL SELECT 'sizes', count(DISTINCT (lang, decade)), CAST(sum(c) AS BIGINT) FROM words
        UNION ALL SELECT 'pairs', count(*), CAST(sum(c12) AS BIGINT) FROM pairs UNION ALL SELECT 'scored', count(*), count(*) FROM scored
        UNION ALL SELECT 'observed scored', count(*), count(*) FROM scored UNION ALL SELECT 'observed kept', count(*), count(*) FROM ({_top_sql("SELECT * FROM scored", 5)})""",
    "top_pairs_documents": _top_sql(_llr_sql(_margins_sql(_words_sql(_ARRAYS, True), _pairs_sql(_ARRAYS, True))), 100),
    "top_pairs_conversations": _top_sql(_llr_sql(_margins_sql(_words_sql(_CONV, False), _pairs_sql(_CONV, False))), 100),
}
