"""The pipeline's near copies: SimHash links and links by shingle similarity, together."""

import random

import corpus_pipeline
from lexibond.llm import near
from lexibond.llm.simhash import fingerprint

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def similarity(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def bits(a, b):
    return (fingerprint(a.encode()) ^ fingerprint(b.encode())).bit_count()


def corpus():
    """For each base three texts: the first two link by fingerprint alone, the last two by shingles alone."""
    rng = random.Random(11)
    prose = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    docs = []
    while len(docs) < 24:
        refrain, tail = prose(30), prose(16)
        a, b, c = " ".join([refrain] * 40 + [prose(16)]), " ".join([refrain] * 40 + [tail]), " ".join([refrain] + [tail] * 20)
        if (bits(a, b) == 0) == (len(docs) < 6) and bits(a, b) <= 4:  # two bases with equal fingerprints, six with close ones
            docs += [a, b, c]
    return docs


def test_fingerprints_and_shingles_link(spark):
    docs = corpus()
    for a, b, c in zip(docs[::3], docs[1::3], docs[2::3], strict=True):
        assert bits(a, b) <= 4 and similarity(a, b) < 0.8
        assert bits(b, c) > 4 and similarity(b, c) >= 0.8
        assert bits(a, c) > 4 and similarity(a, c) < 0.8
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(docs)] + [(None, docs[1], "en", "s", 1), (1, "another text of key one", "en", "s", 1), (100, None, "en", "s", 0), (101, "", "en", "s", 0)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    out = corpus_pipeline.drop_near_copies(spark, df, "")
    assert out.columns == df.columns
    want = [(i, docs[i]) for i in range(0, len(docs), 3)] + [(None, docs[1]), (1, "another text of key one"), (100, None)]
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(want, key=str)
    small = near.one_of_each(df, bucket=4, group=100)  # buckets and groups are dealt out to cells
    assert sorted(((r["doc_id"], r["text"]) for r in small.collect()), key=str) == sorted(want, key=str)
    assert near.one_of_each(df.limit(0)).count() == 0
