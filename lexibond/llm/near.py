"""Near copies by SimHash fingerprints, and by shingle similarity where fingerprints differ in more bits."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexibond.llm import minhash, simhash
from lexibond.llm.common import few
from lexibond.llm.components import components
from lexibond.sources.work import forget, written


def _fingerprint_links(rows: DataFrame, distance: int, bucket: int) -> list[DataFrame]:
    """Written ``u, v``: links between values ``h`` of rows ``fp, h`` with equal fingerprints, and with close ones."""
    classes = written(rows.groupBy("fp").agg(F.min("h").alias("rep"), F.max("h").alias("most")), "classes")
    several = few(classes.where("rep <> most").select("fp", "rep"))
    equal = rows.select("fp", "h").join(several, "fp").where("h <> rep").select(F.col("h").alias("u"), F.col("rep").alias("v"))
    equal = written(equal, "equal-fingerprints")
    links = written(simhash.fingerprint_links(classes.select("fp", "rep"), distance, bucket), "fingerprint-links")
    forget(classes)
    return [equal, links]


def one_of_each(docs: DataFrame, distance: int = simhash.DISTANCE, bucket: int = simhash.BUCKET, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that have the smallest key of their group of near copies, or no key.

    Documents link if their SimHash fingerprints differ in at most ``distance`` bits, found and joined as ``simhash``
    does (segments, one-wildcard variants, stars). They link, too, if their sets of five-word shingles are similar by
    ``minhash``, whose ``options`` follow. Groups are the components of both kinds of links together, so none of a
    group that ``simhash.near_groups`` gives is lost, and chains may mix them.

    Null and empty texts are alike, with fingerprint zero. Rows that share a key but not a text are told apart. An empty
    table gives no rows.
    """
    rows = written(minhash.shingle_rows(docs, key, text, simhash.fingerprint), "shingle-rows")
    equal, close = _fingerprint_links(rows, distance, bucket)
    similar = minhash.similar_links(docs, rows, key=key, text=text, **options)
    groups = components(equal.unionByName(close).unionByName(similar)).select(F.col("node").alias("h"), F.col("root").alias("g"))
    forget(equal, close, similar)
    return minhash.least_of_groups(docs, rows, groups, key, text)
