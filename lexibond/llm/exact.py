"""Exact dedup against a persistent digest index."""

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexibond.llm.common import create_small, few, join_groups, lower_ascii, names, read_small, setting
from lexibond.sources.work import forget, remove, workspace, written

#: Bytes that a bucket should have, bytes of a row, runs from which an index is merged, and the layout's number.
BUCKET_BYTES, ROW_BYTES, RUNS, FORMAT = 128 << 20, 40, 8, 1


class DigestIndex:
    """Digests of all texts that were kept, with the key of each: runs, tables bucketed and sorted by digest.

    ``path`` makes it last. It holds the runs and a log: version n is a file that names the layout, the number of buckets
    and the runs that count, so any later session opens it right, whatever its own defaults. An append writes one run and
    then the next version; a job that dies between leaves a run that doesn't count. Of two writers that make the same
    version one fails to and looks again. More than ``RUNS`` runs are merged into one, with buckets for its size.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None) -> None:
        self.spark, self.path, self.wanted = spark, path.rstrip("/"), buckets
        self.tables: dict[str, str] = {}
        self._load()

    def _load(self) -> None:
        versions = [int(x.removesuffix(".json")) for x in names(self.spark, f"{self.path}/log") if x.removesuffix(".json").isdigit()]
        self.version, self.runs, self.buckets = max(versions, default=-1), [], self.wanted
        if versions:
            state = json.loads(read_small(self.spark, f"{self.path}/log/{self.version:08d}.json"))
            if state["format"] != FORMAT:
                raise ValueError(f"{self.path} has format {state['format']}, not {FORMAT}")
            self.runs, self.buckets = state["runs"], state["buckets"]
            if self.wanted not in (None, self.buckets):
                raise ValueError(f"{self.path} has {self.buckets} buckets, not {self.wanted}")

    def _commit(self, runs: list[str], buckets: int) -> bool:
        state = json.dumps({"format": FORMAT, "buckets": buckets, "runs": runs})
        if not create_small(self.spark, f"{self.path}/log/{self.version + 1:08d}.json", state):
            self._load()
            return False
        self.version, self.runs, self.buckets = self.version + 1, runs, buckets
        return True

    def _table(self, run: str, buckets: int) -> str:
        if run not in self.tables:
            self.tables[run] = f"digests_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {self.tables[run]} (digest BINARY, keep_id BIGINT) USING parquet OPTIONS (compression 'zstd') CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}/{run}'")
        return self.tables[run]

    def _run(self, run: str) -> DataFrame:
        return self.spark.table(self._table(run, self.buckets))

    def _fit(self, rows: int) -> int:
        """Buckets for so many rows; small ones still keep all cores busy."""
        return max(-(-rows * ROW_BYTES // BUCKET_BYTES), self.spark.sparkContext.defaultParallelism)

    def read(self) -> DataFrame:
        """``digest, keep_id`` of every run."""
        out = self.spark.createDataFrame([], "digest binary, keep_id bigint")
        for run in self.runs:
            out = out.unionByName(self._run(run))
        return out

    def matches(self, groups: DataFrame) -> DataFrame:
        """Rows of ``groups`` whose ``digest`` is in the index, with ``keep_id``: a sort-merge join by bucket and run."""
        out, groups = None, groups.repartition(self.buckets or 1, "digest")
        for run in self.runs:
            found = groups.join(self._run(run).hint("merge"), "digest")
            out = found if out is None else out.unionByName(found)
        return groups.select("*", F.lit(None).cast("bigint").alias("keep_id")).limit(0) if out is None else out

    def add(self, groups: DataFrame) -> None:
        """Append ``digest, keep_id`` of digests that the index lacks: a sort-merge anti-join by bucket with each run."""
        while True:
            buckets = self.buckets or self._fit(groups.count())
            new = groups.select("digest", "keep_id").repartition(buckets, "digest")
            for run in self.runs:
                new = new.join(self._run(run).hint("merge"), "digest", "left_anti")
            run = self._write(new, buckets)
            if self.spark.table(self.tables[run]).isEmpty():
                return self._drop(run)
            if self._commit([*self.runs, run], buckets):
                return self.compact() if len(self.runs) > RUNS else None
            self._drop(run)

    def _write(self, rows: DataFrame, buckets: int) -> str:
        run = f"run-{uuid.uuid4().hex}"
        # with a file for each bucket, as one writer leaves them, Spark takes the stored order and sorts no run again
        with setting(self.spark, "spark.sql.legacy.bucketedTableScan.outputOrdering", "true"):
            rows.sortWithinPartitions("digest").write.insertInto(self._table(run, buckets))
        return run

    def _drop(self, run: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(run)}")
        remove(self.spark, f"{self.path}/{run}")

    def compact(self) -> None:
        """Merge all runs into one, whose number of buckets fits its rows; the old runs go once the new version is there."""
        old, rows = self.runs, self.read()
        buckets = self.wanted or max(self.buckets, self._fit(rows.count()))
        run = self._write(rows.repartition(buckets, "digest"), buckets)
        if not self._commit([run], buckets):
            return self._drop(run)
        for r in old:
            self._drop(r)

    def close(self) -> None:
        """Forget the session's tables; the files stay."""
        for name in self.tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables = {}


def digest_of(text: Column) -> Column:
    """SHA-256, as 32 bytes, of the text with A-Z lower-cased; null as empty."""
    return F.unhex(F.sha2(lower_ascii(F.coalesce(text, F.lit(""))).cast("binary"), 256))


def _judged(docs: DataFrame, index: DigestIndex, key: str, text: str) -> DataFrame:
    """``key, digest, keep_id, group_size`` of every row; new digests go into the index."""
    rows = written(docs.select(F.col(key).cast("bigint").alias(key), digest_of(F.col(text)).alias("digest")), "digests")
    groups = written(rows.groupBy("digest").agg(F.max(key).alias("keep_id"), F.count("*").alias("group_size")), "groups")
    index.add(groups)
    with setting(docs.sparkSession, "spark.sql.legacy.bucketedTableScan.outputOrdering", "true"):
        kept = written(index.matches(groups.select("digest", "group_size")), "kept")
    forget(groups)
    return join_groups(rows, kept, "digest", "group_size", rows.count())


def exact_dedup(docs: DataFrame, index: DigestIndex, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, keep_id, group_size, kept, text_sha256`` for every row; new digests go into the index.

    Of equal texts in ``docs`` the row with the largest key stays, unless the index has the text already: then
    its row stays and all of these go. Only digests are shuffled, summed up before; rows of a text that many rows share
    get their group by a broadcast of such groups.

    Null text is empty. Rows with the same key are one document: all stay or all go (group_size counts rows). A null
    key is smaller than any other; a group of nulls keeps its rows. An empty table gives no rows. Other columns are
    ignored.
    """
    out = _judged(docs, index, key, text)
    return out.select(key, "keep_id", "group_size", F.col(key).eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def _with_new_index(docs: DataFrame, judge, *options) -> DataFrame:
    """What ``judge`` says of rows against an empty index, which isn't needed after."""
    path = workspace(docs.sparkSession, "digest-index")
    index = DigestIndex(docs.sparkSession, path)
    out = judge(docs, index, *options)
    index.close()
    remove(docs.sparkSession, path)
    return out


def dedup_documents(docs: DataFrame) -> DataFrame:
    """``exact_dedup`` with a new index in the shared folder."""
    return _with_new_index(docs, exact_dedup)


def dedup_second_batch(docs: DataFrame) -> DataFrame:
    """``exact_dedup`` of a second batch against an index that holds ``docs`` and was closed and opened again.

    The batch is every document once more, and every one with something added to its text under the key -1 - doc_id.
    """
    spark, path = docs.sparkSession, workspace(docs.sparkSession, "digest-index")
    first = DigestIndex(spark, path, 5)
    exact_dedup(docs, first)
    first.close()
    changed = docs.select((-1 - F.col("doc_id")).alias("doc_id"), F.concat(F.coalesce("text", F.lit("")), F.lit(" (second edition)")).alias("text"))
    second = DigestIndex(spark, path)
    out = exact_dedup(docs.select("doc_id", "text").unionByName(changed), second)
    second.close()
    remove(spark, path)
    return out


def distinct_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``exact_dedup`` keeps; of rows equal in key and text one.

    Only the keys and digests of rows that go are joined to ``docs``, which isn't shuffled as long as they are few.
    Nulls, ties and empty tables are as of ``exact_dedup``; a null key with its own text stays. Columns may have any name
    but ``_key``, ``_digest`` and ``_own``.
    """
    rows = _with_new_index(docs, _judged, key, text)
    rows = rows.groupBy(F.col(key).alias("_key"), F.col("digest").alias("_digest")).agg(F.first(F.col(key).eqNullSafe(F.col("keep_id"))).alias("kept"), F.count("*").alias("n"))
    found = written(rows.where("not kept or n > 1"), "copies")
    docs = docs.withColumn("_own", digest_of(F.col(text)))
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_own") == F.col("_digest"))
    out = docs.join(few(found), same, "left_anti")
    again = found.where("kept")
    if not again.isEmpty():
        out = out.unionByName(docs.join(again, same, "left_semi").dropDuplicates([key, "_own"]))
    return out.drop("_own")


_DIGESTS = "SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM"
_JUDGED = """SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM ({}) WINDOW g AS (PARTITION BY text_sha256)"""
ORACLE = _JUDGED.format(f"{_DIGESTS} documents")
SECOND_ORACLE = _JUDGED.format(f"{_DIGESTS} documents UNION ALL {_DIGESTS} (SELECT -1 - doc_id AS doc_id, coalesce(text, '') || ' (second edition)' AS text FROM documents)")
