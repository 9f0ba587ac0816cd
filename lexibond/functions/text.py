"""Token, year and path expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language codes and the mark in a path that means Hebrew.
LANG_EN = "EN"
LANG_HE = "HE"
HE_PATH_MARK = "heb"


def clean_token(token: Column) -> Column:
    """Normalise one token; null gives ''.

    In this order: trim characters up to U+0020, cut a part-of-speech tag at the first underscore
    (not at index 0), strip all but letters and digits from both ends, lower-case.
    """
    plain = token.rlike(r"^[\p{Ll}\p{N}]+\z")  # most tokens of running text: nothing to do
    t = F.regexp_replace(F.coalesce(token, F.lit("")), r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    t = F.regexp_replace(t, r"(?s)^([^_]+)_.*$", "$1")
    t = F.regexp_replace(t, r"^[^\p{L}\p{N}]+", "")
    return F.when(plain, token).otherwise(F.lower(F.regexp_replace(t, r"[^\p{L}\p{N}]+$", "")))


def decade(year: Column) -> Column:
    """The year's decade, rounded toward zero: 1999 gives 1990, -5 gives 0."""
    return (year - year % F.lit(10)).cast("int")


def split_pair(ngram: Column) -> Column:
    """Words of an n-gram, split at white space."""
    return F.split(ngram, r"\s+")


def lang_from_path(path: Column) -> Column:
    """HE if the lower-cased path contains 'heb', else EN; null gives 'Unknown'."""
    found = F.when(F.lower(path).contains(HE_PATH_MARK), LANG_HE).otherwise(LANG_EN)
    return F.when(path.isNull(), "Unknown").otherwise(found)
