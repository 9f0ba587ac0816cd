"""Adapters that give running text and table columns the shape of counted n-grams."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexibond.functions.text import clean_token, decade, split_pair


def _tokens(df: DataFrame, lang: Column, year: Column, text: Column) -> DataFrame:
    """``lang, decade, toks``: every token is cleaned once, and both n-gram sizes are made from that array."""
    toks = F.transform(F.split(F.coalesce(text, F.lit("")), r"\s+"), clean_token)
    return df.select(lang.alias("lang"), decade(year).alias("decade"), toks.alias("toks"))


#: Input below this many bytes is dealt to all cores where one file part holds it all.
SMALL_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table dealt to all cores, as a file part can't be split; larger ones as they are, whatever their splits."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < SMALL_BYTES else df


def document_tokens(documents: DataFrame) -> DataFrame:
    """Tokens of ``documents``; these have no year, 1900 + doc_id % 100 stands for it."""
    return _tokens(spread(documents), F.col("lang"), (F.lit(1900) + F.col("doc_id") % 100).cast("int"), F.col("text"))


def conversation_tokens(conversations: DataFrame) -> DataFrame:
    """Tokens of ``conversations`` by role, in one decade."""
    return _tokens(spread(conversations), F.col("role"), F.lit(2000), F.col("text"))


def token_words(tokens: DataFrame) -> DataFrame:
    """``lang, decade, w, occ``: a row for each non-empty token."""
    rows = tokens.select("lang", "decade", F.explode("toks").alias("w"), F.lit(1).cast("bigint").alias("occ"))
    return rows.where("w <> ''")


def token_pairs(tokens: DataFrame) -> DataFrame:
    """``lang, decade, w1, w2, occ``: a row for each two adjacent tokens that are both non-empty."""
    n = F.size("toks")
    pairs = F.arrays_zip(F.slice("toks", F.lit(1), n - 1).alias("w1"), F.slice("toks", F.lit(2), n - 1).alias("w2"))
    rows = tokens.where(n >= 2).select("lang", "decade", F.explode(pairs).alias("p"))
    out = rows.select("lang", "decade", F.col("p.w1").alias("w1"), F.col("p.w2").alias("w2"), F.lit(1).cast("bigint").alias("occ"))
    return out.where("w1 <> '' and w2 <> ''")


def token_steps(tokens: DataFrame) -> DataFrame:
    """``lang, decade, w1, w2, occ``: a row for each non-empty token, with the token after it or ''.

    Both counts come from these: a token is the first of exactly one row, and the pairs are the rows with both.
    """
    toks = F.col("toks")
    step = F.transform(toks, lambda w, i: F.struct(w.alias("w1"), F.coalesce(F.get(toks, i + 1), F.lit("")).alias("w2")))
    return tokens.select("lang", "decade", F.inline(step), F.lit(1).cast("bigint").alias("occ")).where("w1 <> ''")


def part_ngrams(lineitem: DataFrame, orders: DataFrame, part: DataFrame) -> DataFrame:
    """``ngram, year, occ``: part names by order year, weighted with the quantity."""
    rows = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        F.col("p_name").alias("ngram"), F.year("o_orderdate").alias("year"), F.col("l_quantity").cast("bigint").alias("occ")
    )


def part_steps(ngrams: DataFrame) -> DataFrame:
    """``token_steps`` of part names: the first word with the second, and the second with none. Equal names are summed up first."""
    rows = ngrams.where("occ > 0").groupBy("ngram", decade(F.col("year")).alias("decade")).agg(F.sum("occ").alias("occ"))
    ws = split_pair(F.col("ngram"))
    word = lambda i: clean_token(F.coalesce(F.get(ws, F.lit(i)), F.lit("")))
    rows = rows.select("decade", "occ", word(0).alias("a"), word(1).alias("b"))
    steps = F.array(F.struct(F.col("a").alias("w1"), F.col("b").alias("w2")), F.struct(F.col("b").alias("w1"), F.lit("").alias("w2")))
    return rows.select(F.lit("EN").alias("lang"), "decade", F.inline(steps), "occ").where("w1 <> ''")


def part_words(ngrams: DataFrame) -> DataFrame:
    """``lang, decade, w, occ``: each of the two words of a part name."""
    rows = ngrams.select(decade(F.col("year")).alias("decade"), F.explode(F.slice(split_pair(F.col("ngram")), 1, 2)).alias("w"), "occ")
    return rows.select(F.lit("EN").alias("lang"), "decade", clean_token(F.col("w")).alias("w"), "occ").where("w <> '' and occ > 0")


def part_pairs(ngrams: DataFrame) -> DataFrame:
    """``lang, decade, w1, w2, occ``: the first two words of a part name."""
    ws = split_pair(F.col("ngram"))
    rows = ngrams.where(F.size(ws) >= 2).select(
        F.lit("EN").alias("lang"), decade(F.col("year")).alias("decade"),
        clean_token(ws[0]).alias("w1"), clean_token(ws[1]).alias("w2"), "occ",
    )
    return rows.where("w1 <> '' and w2 <> '' and occ > 0")
