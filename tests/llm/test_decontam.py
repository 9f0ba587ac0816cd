"""Decontamination against planted passages and brute force."""

import random

import numpy as np

from lexibond.llm import decontam

DOCS = "doc_id bigint, text string, item_id string, edits string, start_word string"
ITEMS = "item_id bigint, text string, doc_id string"


def words(rng, n):
    return [rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else f"w{rng.randrange(4000)}" for _ in range(n)]


def edited(rng, item, n):
    out = list(item)
    for _ in range(n):
        p = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[p] = f"new{rng.randrange(999)}"
        elif kind == 1:
            out.insert(p, f"new{rng.randrange(999)}")
        else:
            del out[p]
    return out


def distance(a, b):
    """Edits between ``a`` and any stretch of ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_edit_distance():
    rng = random.Random(4)
    for _ in range(40):
        a, b = [rng.randrange(4) for _ in range(rng.randrange(1, 9))], [rng.randrange(4) for _ in range(rng.randrange(0, 20))]
        assert decontam.edit_ends(np.array(a, np.uint64), np.array(b, np.uint64)).min() == distance(a, b)


def test_planted(spark):
    rng = random.Random(8)
    items = {i: words(rng, rng.randint(14, 60)) for i in range(60)}
    docs, planted = [], {}
    for d in range(300):
        body = words(rng, rng.randint(0, 300))
        if d % 3 == 0:
            i = rng.randrange(60)
            edits = rng.randint(0, int(0.15 * len(items[i])))
            at = rng.randint(0, len(body))
            body[at:at] = edited(rng, items[i], edits)
            planted[d, i] = edits
        t = " ".join(body)
        docs.append((d, t.upper() + "." if d % 6 == 0 else t.replace(" ", ", "), None, None, None))
    df = spark.createDataFrame(docs, DOCS).repartition(3)
    bench = spark.createDataFrame([(i, " ".join(w), "x") for i, w in items.items()], ITEMS)
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.contaminated(df, bench).collect()}
    assert set(got) <= set(planted), "a clean document was taken"
    assert len(got) >= 0.97 * len(planted)
    assert all(got[k]["edits"] <= planted[k] for k in got)
    exact = {k for k, e in planted.items() if e == 0}
    assert exact <= set(got)
    kept = decontam.clean(df, bench)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == set(range(300)) - {d for d, _ in got}


def test_edits_in_one_place():
    rng = random.Random(10)
    for length in (20, 50, 120):
        items = [words(rng, length) for _ in range(60)]
        own = decontam.Symbols()
        codes = [own.of(" ".join(w).encode()) for w in items]
        index, n = decontam.Index(list(enumerate(codes))), length // 5
        new = [f"new{i}" for i in range(n)]
        middle = (length - n) // 2
        for how in (
            lambda w: w[n:], lambda w: new + w[n:], lambda w: w[:1] + new + w[1:], lambda w: w[:middle] + new + w[middle + n :], lambda w: w[:-n] + new, lambda w: w[:-n],
            lambda w: edited(rng, w, n),
        ):
            texts = [own.of(" ".join(how(w)).encode()) for w in items]
            found = decontam._hits(index, texts, decontam.EDITS)
            assert sum((i, i) in found for i in range(60)) >= 0.97 * 60


def test_recall_by_length_and_edits():
    """Of items planted with so many edits, each of which all-places edit distance finds, at least 0.9 in every cell."""
    rng = random.Random(20)
    own = decontam.Symbols()
    lengths = (5, 8, 12, 20, 40, 80, 120)
    items = [words(rng, n) for n in lengths for _ in range(40)]
    codes = [own.of(" ".join(w).encode()) for w in items]
    index = decontam.Index(list(enumerate(codes)))
    for share in (0, 0.1, 0.2):
        texts = []
        for w in items:
            body = words(rng, 120)
            body[60:60] = edited(rng, w, int(share * len(w)))
            texts.append(own.of(" ".join(body).encode()))
        assert all(decontam.edit_ends(c, t).min() <= int(share * len(c)) for c, t in zip(codes, texts, strict=True))
        found = decontam._hits(index, texts, decontam.EDITS)
        for k, n in enumerate(lengths):
            assert sum((i, i) in found for i in range(40 * k, 40 * k + 40)) >= 36, (n, share)


def test_index_of_many_items_is_built_once(monkeypatch, spark):
    import time

    rng = np.random.default_rng(5)
    items = [(i, rng.integers(1, 1 << 40, 40).astype(np.uint64)) for i in range(20_000)]
    start = time.process_time()
    index = decontam.Index(items)
    assert time.process_time() - start < 40
    found = decontam._hits(index, [items[7][1], items[19_999][1]], decontam.EDITS)
    assert set(found) == {(0, 7), (1, 19_999)}
    built = []
    real = decontam.Index.__init__
    monkeypatch.setattr(decontam.Index, "__init__", lambda self, block: built.append(len(block)) or real(self, block))
    df = spark.createDataFrame([(i, f"word{i} alpha beta gamma") for i in range(40)], "doc_id bigint, text string").repartition(8)
    assert decontam.contaminated(df, df.where("doc_id < 5").selectExpr("doc_id as item_id", "text")).count() >= 5
    assert built == [5]


def test_blocks_and_edges(spark, monkeypatch):
    rng = random.Random(9)
    items = [(i, " ".join(words(rng, 30)), None) for i in range(7)] + [(90, None, None), (91, "...", None), (None, "alpha beta gamma delta", None), (92, "short one", None)]
    docs = [(1, f"x {items[0][1]} y {items[5][1]}", None, None, None), (2, None, None, None, None), (3, "", None, None, None), (None, items[2][1], None, None, None), (4, "this holds alpha Beta gamma, delta today", None, None, None), (4, "w " * 30_000 + items[3][1], None, None, None), (5, "a short one here", None, None, None)]
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    want = {(1, 0), (1, 5), (None, 2), (4, None), (4, 3), (5, 92)}
    for block in (decontam.BLOCK_ITEMS, 3):
        monkeypatch.setattr(decontam, "BLOCK_ITEMS", block)
        assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(df, bench).collect()} == want
        assert sorted(str(r["doc_id"]) for r in decontam.clean(df, bench).collect()) == ["2", "3"]
    assert decontam.contaminated(df, bench.limit(0)).count() == 0 and decontam.clean(df, bench.limit(0)).count() == len(docs)
    assert decontam.contaminated(df.limit(0), bench).count() == 0


def test_symbols_of_many_texts_at_once():
    texts = ["The cat, the CAT.", "", " \t\n", "ΑΣ\vΣ\fΑΣ\rb", "-- (cat) --", "a\xa0b a\x85b \x1c", "İstanbul straße"]
    for limit in (150_000, 3):
        own, alone = decontam.Symbols(limit), decontam.Symbols(limit)
        got = own.of_all([t.encode() for t in texts])
        assert [x.tolist() for x in got] == [alone.of(t.encode()).tolist() for t in texts]
    assert [len(x) for x in got] == [4, 0, 0, 4, 1, 3, 2]
    assert len(set(got[0].tolist())) == 2 and got[4].tolist() == got[0][1:2].tolist()
    assert decontam.Symbols().of_all([]) == []
