"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory. DataFrame functions only.

Templates are licence texts, the standard headers and heads of licence files, sentences that name a licence, and SPDX
tags. A file is one sequence of words: line ends, comment marks and punctuation are none. For each template, windows of
its length that start every eighth of it are compared, whatever words they hold. Two conditions that every window within the
cosine meets spare the rest: with unit vectors, a window that lacks the template's heaviest words (so many that their
squares exceed 1 - cosine²) can't reach the cosine, nor can one whose shared words' squares sum to less than cosine².
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexibond.llm.licence_texts import templates
from lexibond.sources.work import forget, written

#: Least cosine, and what the conditions leave for rounding.
COSINE, SLACK = 0.75, 1e-3
#: Windows of a template start every length / ``GRID`` words. Up to ``SAYING`` words a template is a sentence, which
#: doesn't count if a word that denies it stands within it or up to half its length and ``BEFORE`` words before.
GRID, SAYING, BEFORE = 8, 16, 3
DENIES = ("not", "never", "isn", "nor", "neither", "cannot", "unlike", "aren", "wasn")
#: Names of files that speak for their directory.
LICENCE_FILE = r"(?i)^(un)?licen[cs]e([._-].*)?$|^copying([._-].*)?$|^notice([._-].*)?$"
_TOKEN = r"([a-z0-9]+(?:[.-][a-z0-9]+)*)"


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), 1)


def _template_words(spark: SparkSession) -> DataFrame:
    """``license, template, size, token, tf``: as many rows as the templates have words."""
    rows = spark.createDataFrame(templates(), "license string, template string, text string").withColumn("toks", _tokens(F.col("text")))
    words = rows.select("license", "template", F.size("toks").alias("size"), F.explode("toks").alias("token"))
    return words.groupBy("license", "template", "size", "token").agg(F.count("*").alias("tf"))


def _literals(words: list[str]) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def _weights(files: DataFrame, vocabulary: DataFrame) -> tuple[DataFrame, Column]:
    """``token, idf`` of the templates' words over all files, and the weight of any other word.

    Each file is cut down to the templates' words before anything is exploded or shuffled.
    """
    known = _literals([r["token"] for r in vocabulary.orderBy("token").collect()])
    held = files.select(F.explode(F.array_intersect(_tokens(F.col("text")), known)).alias("token"))
    df = held.groupBy("token").agg(F.count("*").alias("df"))
    n = F.lit(files.count())
    idf = lambda d: F.ln((n + 1) / (d + 1)) + 1
    return vocabulary.join(df, "token", "left").select("token", idf(F.coalesce("df", F.lit(0))).alias("idf")), idf(F.lit(0))


def _unit_vectors(words: DataFrame, weights: DataFrame) -> DataFrame:
    """``license, template, size, token, w, heavy``: unit vectors; a window without a heavy word is beyond the cosine."""
    from pyspark.sql import Window

    rows = words.join(F.broadcast(weights), "token").withColumn("w", F.col("tf") * F.col("idf"))
    rows = rows.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("template"))))
    before = Window.partitionBy("template").orderBy(F.desc(F.round("w", 9)), "token").rowsBetween(Window.unboundedPreceding, -1)
    heavier = F.coalesce(F.sum(F.col("w") * F.col("w")).over(before), F.lit(0.0))
    return rows.select("license", "template", "size", "token", "w", (heavier <= 1 - (COSINE - SLACK) ** 2).alias("heavy"))


def declared(files: DataFrame) -> DataFrame:
    """``path, license, score``: the best template of each file that has one within ``COSINE``.

    Every window of the whole text is compared. Ties go to the smaller licence name.
    """
    spark = files.sparkSession
    words = written(_template_words(spark), "template-words")
    vocabulary = words.select("token").distinct()
    weights, other = _weights(files, vocabulary)
    weights = written(weights, "idf")  # as many rows as the templates have words: broadcast below
    ours = written(_unit_vectors(words, weights), "templates")
    heavy = _literals([r["token"] for r in ours.where("heavy").select("token").distinct().orderBy("token").collect()])
    known = _literals([r["token"] for r in vocabulary.orderBy("token").collect()])
    # files with any heavy word, then pairs of file and template that share enough
    rows = files.select("path", _tokens(F.col("text")).alias("toks")).where(F.arrays_overlap("toks", heavy))
    rows = written(rows.withColumn("row", F.expr("uuid()")), "files-with-heavy-words")
    held = rows.select("row", F.explode(F.array_intersect("toks", known)).alias("token")).join(F.broadcast(ours), "token")
    share = held.groupBy("row", "template").agg(F.sum(F.col("w") * F.col("w")).alias("share"), F.max("heavy").alias("heavy"))
    share = written(share.where(F.col("heavy") & (F.col("share") >= (COSINE - SLACK) ** 2)).select("row", "template"), "pairs")
    lists = ours.groupBy("template").agg(F.first("license").alias("license"), F.first("size").alias("size"), F.collect_list(F.when(F.col("heavy"), F.col("token"))).alias("heavy"), F.collect_list("token").alias("own"))
    pairs = rows.join(share, "row").join(F.broadcast(lists), "template")
    step, size = F.greatest(F.lit(1), F.floor(F.col("size") / GRID).cast("int")), F.col("size")
    cut = lambda s: F.slice("toks", s + 1, size)
    starts = F.filter(F.sequence(F.lit(0), F.size("toks") - 1, step), lambda s: F.arrays_overlap(cut(s), "heavy"))
    windows = pairs.select("path", "row", "template", "license", "size", "own", "toks", F.explode(starts).alias("at"))
    denies = _literals(list(DENIES))
    first = F.greatest(F.col("at") - BEFORE - F.floor(size / 2).cast("int"), F.lit(0))
    around = F.slice("toks", first + 1, F.col("at") - first + size)
    denied = (size <= SAYING) & F.arrays_overlap(around, denies) & ~F.arrays_overlap("own", denies)
    windows = windows.where(~denied).select("path", "row", "template", "license", "at", F.explode(cut(F.col("at"))).alias("token"))
    counts = windows.groupBy("path", "row", "template", "license", "at", "token").agg(F.count("*").alias("tf"))
    counts = counts.join(F.broadcast(weights), "token", "left").join(F.broadcast(ours.select("template", "token", "w")), ["template", "token"], "left")
    value = F.col("tf") * F.coalesce("idf", other)
    scores = counts.groupBy("path", "row", "template", "license", "at").agg((F.sum(value * F.coalesce("w", F.lit(0.0))) / F.sqrt(F.sum(value * value))).alias("score"))
    scores = scores.select("path", "license", F.round("score", 6).alias("score")).where(F.col("score") >= COSINE)
    best = F.min(F.struct((-F.col("score")).alias("s"), "license"))
    out = written(scores.groupBy("path").agg(best.alias("b")).select("path", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score")), "declared")
    forget(words, weights, ours, rows, share)
    return out


def scan(files: DataFrame) -> DataFrame:
    """``path, license, score, origin, license_path`` of every file ``path, text``.

    origin: 'own' if the file declares a licence; 'inherited' from the licence file of the nearest directory above it
    that has one (``license_path``; of several in a directory the smallest path); else 'none'. Inheritance is worked
    out once a directory: directories are made distinct before their ancestors are listed, so a directory that holds a
    third of all files is one row there. Licences are named by SPDX, without 'only' or 'or later'.

    Null and empty texts declare nothing but can inherit. Files with the same path are one file with the windows of all;
    a null path inherits nothing and declares nothing. An empty table gives no rows. Other columns are ignored.
    """
    files = files.select("path", "text")
    own = declared(files.where("path is not null"))
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    speaks = own.where(name.rlike(LICENCE_FILE)).select(folder.alias("dir"), F.struct("path", "license", "score").alias("f"))
    speaks = written(speaks.groupBy("dir").agg(F.min("f").alias("f")), "licence-files")
    dirs = files.select(folder.alias("dir")).where("dir is not null").distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("up")))).alias("a"))
    near = above.select("dir", "a.depth", F.col("a.up").alias("up")).distinct().join(speaks.withColumnRenamed("dir", "up"), "up")
    near = written(near.groupBy("dir").agg(F.max_by("f", "depth").alias("f")), "nearest")
    forget(speaks)
    rows = files.select("path", folder.alias("dir")).join(own, "path", "left").join(near, "dir", "left")
    inherits = F.col("license").isNull() & F.col("f").isNotNull()
    origin = F.when(F.col("license").isNotNull(), "own").when(inherits, "inherited").otherwise("none")
    return rows.select("path", F.coalesce("license", "f.license").alias("license"), F.coalesce("score", "f.score").alias("score"), origin.alias("origin"), F.when(inherits, F.col("f.path")).alias("license_path"))


def document_files(documents: DataFrame) -> DataFrame:
    """``path, text`` of documents, which have no paths of their own.

    source/lang/number of the hundred/document; every twentieth document is taken for its directory's licence file.
    """
    name = F.when(F.col("doc_id") % 20 == 0, F.concat(F.lit("LICENSE-"), F.col("doc_id"))).otherwise(F.concat(F.col("doc_id"), F.lit(".txt")))
    folder = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.floor(F.col("doc_id") / 100))
    return documents.select(F.concat_ws("/", F.when(F.col("doc_id") % 40 == 0, F.coalesce("source", F.lit(""))).otherwise(folder), name).alias("path"), "text")


def scan_documents(documents: DataFrame) -> DataFrame:
    """``scan`` of documents by ``doc_id``."""
    number = F.regexp_extract("path", r"(\d+)(?:\.txt)?$", 1).cast("bigint").alias("doc_id")
    return scan(document_files(documents)).select(number, "path", "license", "score", "origin", "license_path")


def oracle() -> str:
    """SQL of ``scan_documents``; it spares windows by the sum of shared words' squares alone."""
    quoted = lambda t: t.replace("'", "''")
    values = ", ".join(f"('{k}', '{t}', '{quoted(x)}')" for k, t, x in templates())
    token = _TOKEN
    folder = "regexp_replace(path, '/?[^/]*$', '')"
    name = "regexp_extract(path, '([^/]*)$', 1)"
    licence = LICENCE_FILE.removeprefix("(?i)")
    denies = "[" + ", ".join(f"'{w}'" for w in DENIES) + "]"
    return f"""WITH files AS (SELECT doc_id, concat_ws('/', CASE WHEN doc_id % 40 = 0 THEN coalesce(source, '') ELSE concat_ws('/', coalesce(source, ''), coalesce(lang, ''), doc_id // 100) END, CASE WHEN doc_id % 20 = 0 THEN 'LICENSE-' || doc_id ELSE doc_id || '.txt' END) AS path, text FROM documents),
    tt AS MATERIALIZED (SELECT license, template, regexp_extract_all(lower(t), '{token}', 1) AS own FROM (VALUES {values}) v(license, template, t)),
    tw AS (SELECT license, template, len(own) AS size, token, count(*) AS tf FROM (SELECT *, unnest(own) AS token FROM tt) GROUP BY ALL),
    vocab AS (SELECT DISTINCT token FROM tw),
    toks AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{token}', 1) AS toks FROM files),
    held AS MATERIALIZED (SELECT DISTINCT doc_id, token FROM (SELECT doc_id, unnest(toks) AS token FROM toks) WHERE token IN (SELECT token FROM vocab)),
    df AS (SELECT token, count(*) AS df FROM held GROUP BY token),
    total AS (SELECT count(*) AS n FROM files),
    idf AS MATERIALIZED (SELECT token, ln((n + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM vocab LEFT JOIN df USING (token), total),
    other AS (SELECT ln(n + 1.0) + 1 AS o FROM total),
    ours AS MATERIALIZED (SELECT license, template, size, token, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY template)) AS w FROM tw JOIN idf USING (token)),
    pairs AS MATERIALIZED (SELECT doc_id, license, template, size FROM held JOIN ours USING (token) GROUP BY ALL HAVING sum(w ** 2) >= {(COSINE - SLACK) ** 2}),
    starts AS (SELECT doc_id, license, template, size, toks, own, unnest(range(0, len(toks), greatest(1, size // {GRID}))) AS place FROM pairs JOIN toks USING (doc_id) JOIN tt USING (license, template)),
    windows AS (SELECT doc_id, license, template, place, unnest(toks[place + 1 : place + size]) AS token FROM starts
        WHERE NOT (size <= {SAYING} AND list_has_any(toks[greatest(place - {BEFORE} - size // 2, 0) + 1 : place + size], {denies}) AND NOT list_has_any(own, {denies}))),
    counts AS (SELECT doc_id, license, template, place, token, count(*) AS tf FROM windows GROUP BY ALL),
    weighed AS (SELECT doc_id, license, template, place, token, tf * coalesce(idf, o) AS v FROM counts LEFT JOIN idf USING (token), other),
    scores AS (SELECT doc_id, weighed.license, round(sum(v * coalesce(w, 0)) / sqrt(sum(v ** 2)), 6) AS score FROM weighed LEFT JOIN ours USING (template, token) GROUP BY doc_id, weighed.license, template, place),
    own AS (SELECT doc_id, path, license, score FROM (SELECT doc_id, license, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license) AS k FROM scores WHERE score >= {COSINE}) JOIN files USING (doc_id) WHERE k = 1),
    speaks AS (SELECT {folder} AS dir, min(path) AS path, arg_min(license, path) AS license, arg_min(score, path) AS score FROM own WHERE regexp_matches({name}, '{licence}', 'i') GROUP BY 1),
    near AS (SELECT f.doc_id, arg_max(s.path, length(s.dir)) AS path, arg_max(s.license, length(s.dir)) AS license, arg_max(s.score, length(s.dir)) AS score FROM files f JOIN speaks s ON starts_with({folder.replace("path", "f.path")} || '/', s.dir || '/') GROUP BY 1)
    SELECT f.doc_id, f.path, coalesce(o.license, a.license) AS license, coalesce(o.score, a.score) AS score, CASE WHEN o.license IS NOT NULL THEN 'own' WHEN a.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin, CASE WHEN o.license IS NULL THEN a.path END AS license_path
    FROM files f LEFT JOIN own o USING (doc_id) LEFT JOIN near a USING (doc_id)"""
