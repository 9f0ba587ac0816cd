"""Near copies of word shingles against brute force."""

import random

import corpus_pipeline
from lexibond.llm import minhash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    """Rows that stay, by all pairs."""
    sets, root = [shingles(t) for _, t in docs], list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if docs[i][0] is not None and docs[j][0] is not None and (a == b or len(a & b) >= 0.8 * len(a | b)):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    least = {}
    for i, (k, _) in enumerate(docs):
        if k is not None:
            least[root[i]] = min(k, least.get(root[i], k))
    return sorted((d for i, d in enumerate(docs) if d[0] is None or d[0] == least[root[i]]), key=str)


def corpus():
    rng = random.Random(3)
    prose = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    docs = []
    for _ in range(60):
        w = prose(rng.randint(4, 250))
        for _ in range(3):
            docs.append((len(docs), " ".join(w)))
            w = list(w)
            for _ in range(rng.randint(0, max(1, len(w) // 45))):
                w[rng.randrange(len(w))] = "NEW"
    hub = prose(200)
    docs += [(len(docs) + i, " ".join([*hub, f"x{i}"])) for i in range(80)]
    return [*docs, (900, None), (901, ""), (902, "a b"), (903, "A  b"), (None, docs[0][1]), (None, None), (5, "other text of key five"), (905, "other text of key five")]


def test_stage_reaches_similarity(spark):
    docs = corpus()
    df = spark.createDataFrame([(*d, "en", "s", 1) for d in docs], DOCS).repartition(3)
    out = corpus_pipeline.drop_near_copies(spark, df, "")
    assert out.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == brute(docs)
    small = minhash.one_of_each(df, group=2000)  # groups are dealt out to cells
    assert sorted(((r["doc_id"], r["text"]) for r in small.collect()), key=str) == brute(docs)
    assert minhash.one_of_each(df.limit(0)).count() == 0
