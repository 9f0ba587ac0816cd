"""Exact, near and substring dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexibond.llm import exact, simhash, substring
from lexibond.llm.common import create_small, names, read_small, setting
from lexibond.llm.components import components
from lexibond.sources.work import workspace

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, digest string, fp string, seg string, key string, n string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "d", "f", "s", "k", "n") for i, t in rows], SCHEMA)


def lower(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


def test_exact(spark):
    rows = [(1, "Same"), (2, "sAME"), (7, "same"), (3, "É"), (4, "é"), (5, None), (6, ""), (8, "x" * 200_000), (9, "one"), (9, "one"), (None, "lost"), (None, None)]
    got = exact.dedup_documents(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["text_sha256"]): r for r in got}
    for i, t in rows:
        digest = hashlib.sha256(lower(t).encode()).hexdigest()
        group = [k for k, u in rows if lower(u) == lower(t)]
        keep = max((k for k in group if k is not None), default=None)
        r = by[i, digest]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(group), i == keep)
    assert exact.dedup_documents(frame(spark, rows[:0])).count() == 0


def test_index_lasts(spark):
    path = workspace(spark, "index")
    index = exact.DigestIndex(spark, path, 3)
    first = exact.exact_dedup(frame(spark, [(1, "a"), (2, "b"), (3, "A")]), index)
    assert {r["doc_id"]: r["kept"] for r in first.collect()} == {1: False, 2: True, 3: True}
    index.close()
    again = exact.DigestIndex(spark.newSession(), path)  # another session, which doesn't know the number of buckets
    assert again.buckets == 3
    new = {r["doc_id"]: (r["kept"], r["keep_id"]) for r in exact.exact_dedup(frame(again.spark, [(9, "a"), (10, "c"), (11, "B")]), again).collect()}
    assert new == {9: (False, 3), 10: (True, 10), 11: (False, 2)}
    assert again.read().count() == 3 and len(again.runs) == 2
    repeated = exact.exact_dedup(frame(again.spark, [(10, "c")]), again).first()
    assert repeated["kept"]  # a batch that is run again changes nothing
    assert again.read().count() == 3 and len(again.runs) == 2
    with pytest.raises(ValueError):
        exact.DigestIndex(spark, path, 24)
    log = [x for x in names(spark, f"{path}/log") if x.endswith(".json")]
    assert log == ["00000000.json", "00000001.json"]
    assert not create_small(spark, f"{path}/log/00000001.json", "other") and "run-" in read_small(spark, f"{path}/log/00000001.json")


def test_index_of_two_writers(spark):
    path = workspace(spark, "index")
    a, b = exact.DigestIndex(spark, path, 2), exact.DigestIndex(spark, path, 2)
    exact.exact_dedup(frame(spark, [(1, "a"), (2, "b")]), a)
    got = exact.exact_dedup(frame(spark, [(5, "b"), (6, "c")]), b)  # b hasn't seen that version
    assert {r["doc_id"]: r["keep_id"] for r in got.collect()} == {5: 2, 6: 6}
    assert exact.DigestIndex(spark, path).read().count() == 3


def test_index_merges_runs(spark, monkeypatch):
    monkeypatch.setattr(exact, "RUNS", 2)
    index = exact.DigestIndex(spark, workspace(spark, "index"))
    for i in range(4):
        exact.exact_dedup(frame(spark, [(i, f"text {i}"), (10 + i, "shared")]), index)
    assert len(index.runs) <= 2 and index.read().count() == 5
    got = exact.exact_dedup(frame(spark, [(99, "SHARED"), (98, "new")]), index)
    assert {r["doc_id"]: (r["keep_id"], r["kept"]) for r in got.collect()} == {99: (10, False), 98: (98, True)}


def test_stored_order_is_used(spark):
    index = exact.DigestIndex(spark, workspace(spark, "index"), 3)
    rows = frame(spark, [(i, f"text {i}") for i in range(50)]).select("doc_id", "text")
    groups = rows.select(exact.digest_of(F.col("text")).alias("digest"), F.col("doc_id").alias("keep_id"))
    index.add(groups)
    with setting(spark, "spark.sql.legacy.bucketedTableScan.outputOrdering", "true"), setting(spark, "spark.sql.adaptive.enabled", "false"):
        new = groups.repartition(3, "digest").join(index._run(index.runs[0]).hint("merge"), "digest", "left_anti")
        plan = new._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Sort [digest") == 1 and plan.count("Exchange") == 1  # of the new side alone


def test_distinct_documents(spark):
    rows = [(1, "a"), (2, "A"), (2, "A"), (3, "b"), (None, "c"), (None, None)]
    out = exact.distinct_documents(frame(spark, rows))
    assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted([(2, "A"), (3, "b"), (None, "c"), (None, None)], key=str)


def simple_fingerprint(t):
    words = WORD.findall(lower(t))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_fingerprint():
    for t in ("", "one", "a b c", "A b C d", "x y z w x y z w x", "É É É é", "w " * 70_000, "tab\tline\nfeed\x0bend"):
        assert simhash.fingerprint(t.encode()) == simple_fingerprint(t)


def roots(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 20])
def test_links_connect_all(spark, bucket):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(200)}
    cloud = rng.getrandbits(64)
    for _ in range(400):  # a cloud of near copies shares its segments
        x = cloud
        for _ in range(rng.randint(0, 6)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    chain = rng.getrandbits(64)
    for i in range(0, 60, 4):
        chain ^= 0b1111 << i
        fps.add(chain)
    fps = sorted(fps)
    a = np.array(fps, np.uint64)
    pairs = [(i, int(j)) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 4) if j > i]
    df = spark.createDataFrame([(int(x), i) for i, x in enumerate(a.view(np.int64))], "fp bigint, rep bigint")
    links = [(r["u"], r["v"]) for r in simhash.fingerprint_links(df, bucket=bucket).collect()]
    assert {tuple(sorted(x)) for x in links} <= set(pairs)
    assert roots(links, range(len(a))) == roots(pairs, range(len(a)))
    if bucket == simhash.BUCKET:  # a forest of the cloud, not its pairs
        assert len(links) < len(pairs) / 2


def test_near_groups(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(5, base), (3, base.upper()), (9, base + " end"), (4, None), (8, " \n"), (7, "other text of few words"), (None, base), (7, "again")]
    got = simhash.near_groups(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    fps = {simple_fingerprint(t): i for i, t in rows}
    by = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in got}
    assert all((i, f"{simple_fingerprint(t):016x}") in by for i, t in rows) and len(fps) >= 4
    assert by[5, f"{simple_fingerprint(base):016x}"] == 3 and by[4, "0" * 16] == 4 and by[8, "0" * 16] == 4 and by[None, f"{simple_fingerprint(base):016x}"] is None
    assert simhash.near_groups(frame(spark, rows[:0])).count() == 0
    kept = simhash.one_of_each(frame(spark, rows))
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([3, 4, 7, 7, None] + ([9] if bin(simple_fingerprint(base) ^ simple_fingerprint(base + " end")).count("1") > 4 else []), key=str)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(300)] + [(1000, x) for x in range(1001, 1400)] + [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(150)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    want = roots(edges, {x for e in edges for x in e if e[0] != e[1]})
    assert got == want
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def brute_repeats(rows, n=20):
    seen, out = set(), {}
    words = {d: WORD.findall(t or "") for d, t in rows}
    for d in sorted(words):
        w = words[d]
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            if k in seen:
                gone[i : i + n] = [True] * n
            seen.add(k)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("segment", [substring.SEGMENT_BYTES, 3000])
def test_substring(spark, segment):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(50)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = [text(rng.randint(15, 60)) for _ in range(6)]
    rows = [(i, " ".join(rng.choice([text(rng.randint(0, 30)), rng.choice(shared)]) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    rows += [(100, "a " * 300), (101, "a " * 50 + "b"), (102, None), (103, ""), (104, "  \n"), (-7, shared[0]), (105, "Word, word x " * 20)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(frame(spark, rows), segment_bytes=segment).collect()}
    assert got == brute_repeats(rows)


def test_substring_edges(spark):
    assert substring.remove_repeats(frame(spark, [])).count() == 0
    text = " ".join(map(str, range(30)))
    got = substring.remove_repeats(frame(spark, [(None, text), (1, text), (1, text), (-(1 << 63), text), (-(1 << 62) - 5, "few words")])).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in got) == [(str(-(1 << 62) - 5), 0), (str(-(1 << 63)), 30), ("1", 30), ("1", 30), ("None", 0)]


def test_words_of_polynomial_collisions(spark):
    """The two complementary Thue-Morse words meet in every polynomial hash modulo a power of two."""
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    a, b = ("".join("xy"[x ^ flip] for x in bits) for flip in (0, 1))
    head = " ".join(f"w{i}" for i in range(19))
    got = substring.remove_repeats(frame(spark, [(1, f"{head} {a}"), (2, f"{head} {b}"), (3, f"{head} {a}")])).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {1: 0, 2: 0, 3: 20}


@pytest.mark.parametrize("segment", [substring.SEGMENT_BYTES, 2000])
def test_substring_repeated_key(spark, segment):
    """Rows of one key have some order; each window of theirs stays in one of them."""
    rng = random.Random(12)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    shared = text(40)
    rows = [(5, f"{text(30)} {shared} {text(i)}") for i in range(40)] + [(None, f"{text(9)} {shared}") for _ in range(3)] + [(9, shared)]
    got = substring.remove_repeats(frame(spark, rows), segment_bytes=segment).collect()
    removed = sorted(((str(r["doc_id"]), r["n_removed"]) for r in got))
    assert removed == sorted([("5", 40)] * 40 + [("9", 40)] + [("None", 40)] * 2 + [("None", 0)])


def test_local_repeats_are_compared_by_word():
    import pandas as pd

    rows = pd.DataFrame([(1, 1, 0, "a b c d e a b c d e a b c x e")], columns=["known", "doc_id", "copy", "text"])
    seg = substring.Segment(rows, 3)
    assert seg.repeats(np.array([0])).tolist() == [5, 10] and seg.repeats(np.array([1, 2])).tolist() == [6, 7]
