"""Token ids, counts, files and packing, against the tokenizers library itself."""

import array
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexibond.llm import binary, packing, tokens
from lexibond.llm.common import Pieces, space_dropped_pieces, spaced_pieces

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "a", "The cat sat. On the mat, it's 2024!\nNew line.\n\nTwo  spaces \t tab", "x<|endoftext|> y <|ENDOFTEXT|> <|startoftext|>",
    "café. Été, naïve  x \n y 　", "\x00\x01\x02 control \x1c", "😀. 😀, !!, ... ×. ", "word " * 3000, "ab" * 4000,
]
ROWS = [(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(3, "a", "x", "y"), (3, "a", "x", "y"), (-5, "below zero", None, None)]
SCHEMA = "doc_id bigint, text string, start string, piece string"


def ids_of(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


PARTS = st.sampled_from(["a", "B", "é", "ß", "'", "'s", "n't", ".", ",", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\xa0", " ", "1", "<|endoftext|>", "<|ENDOFTEXT|>", "-", "😀", "\x00", "\x01", "\x02", "\x1c", "\x85", "İ", "́", "<|", ". ", ", ", "the"])
CACHES = {p: Pieces(p, cut) for p, cut in ((BYTES, spaced_pieces), (WORDS, space_dropped_pieces))}


@settings(max_examples=400, deadline=None)
@given(st.lists(PARTS, max_size=12).map("".join), st.sampled_from([BYTES, WORDS]))
def test_pieces_give_the_ids_of_the_whole(text, path):
    cache = CACHES[path]
    assert list(array.array("I", cache.ids([text.encode()])[0])) == cache.tokenizer.encode(text, add_special_tokens=False).ids


def test_counts(docs):
    got = sorted(map(tuple, tokens.count_tokens(docs, BYTES).collect()))
    want = sorted((r[0], len((r[1] or "").encode()), n := len(ids_of(BYTES, r[1])), n > 512) for r in ROWS)
    assert got == want
    assert tokens.count_tokens(docs.limit(0), BYTES).count() == 0
    assert tokens.count_tokens(docs.selectExpr("cast(null as bigint) doc_id", "text"), BYTES).count() == len(ROWS)


@pytest.mark.parametrize("bits", [False, True])
def test_round_trip(docs, bits):
    got = [tuple(r) for r in binary.binary_round_trip(docs, WORDS, bits=bits).collect()]
    at, want = 0, []
    for r in sorted(ROWS, key=lambda r: r[0]):
        data = array.array("I", [*ids_of(WORDS, r[1]), 1]).tobytes()
        want.append((r[0], at, len(data) // 4, zlib.crc32(data)))
        at += len(data) // 4
    assert sorted(got, key=lambda r: r[1]) == want
    assert binary.binary_round_trip(docs.limit(0), WORDS).count() == 0


def test_planes():
    ids = np.arange(70_000, dtype="<u4") * 7 % 65_536
    for n in (0, 1, 7, 70_000):
        for bits, planes in ((False, 2), (True, 16), (False, 4), (True, 32)):
            assert (binary.from_planes(binary.to_planes(ids[:n], planes, bits), n, bits) == ids[:n]).all()


def test_null_keys_come_first_and_wide_ids_are_errors(spark, tmp_path):
    rows = [(None, "b c"), (4, "a"), (None, None), (-9, "d")]
    got = [tuple(r) for r in binary.binary_round_trip(spark.createDataFrame(rows, "doc_id bigint, text string"), WORDS).orderBy("start").collect()]
    assert [r[0] for r in got] == [None, None, -9, 4] and [r[1] for r in got] == list(np.cumsum([0, *(r[2] for r in got[:-1])]))
    assert sorted(r[2] for r in got[:2]) == sorted(len(ids_of(WORDS, t)) + 1 for k, t in rows if k is None)
    with pytest.raises(Exception):
        binary.write_ids(spark.createDataFrame([(1, "hello")], "doc_id bigint, text string"), WORDS, f"file://{tmp_path}", planes=1)


def test_rows_of_one_key_are_dealt_out(spark):
    rows = [(7, f"text number {i}") for i in range(300)] + [(8, "x"), (6, "y")]
    got = binary.binary_round_trip(spark.createDataFrame(rows, "doc_id bigint, text string"), WORDS).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [6, *[7] * 300, 8]
    assert [r["start"] for r in got] == list(np.cumsum([0, *(r["n_tokens"] for r in got[:-1])]))


def check_packing(rows, limits=(2048, 256)):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    padding = 0
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert 0 < at <= limits[0] and len(s) <= limits[1]
        padding += 0 if at & (at - 1) == 0 else limits[0] - at
    return pieces, padding


def test_packing(spark, docs):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    got = packing.pack_texts(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2), BYTES).collect()
    pieces, padding = check_packing(got)
    assert padding == 0
    for i, t in rows:
        ids, at = [*ids_of(BYTES, t), 1], 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(array.array("I", ids[at : at + r["length"]]).tobytes())
            at += r["length"]
        assert at == len(ids)
    assert packing.pack_texts(docs.limit(0), BYTES).count() == 0
    assert packing.pack_texts(docs.selectExpr("cast(null as bigint) doc_id", "text"), BYTES).count() > 0


def test_vector_limits(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(n), int(n * rng.random())) for i, n in enumerate(rng.integers(1, 900, 2000))]
    got = packing.pack_counts(spark.createDataFrame(rows, "doc_id bigint, tokens int, loss_tokens int").coalesce(1), tokens=2048, segments=6, loss=900).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(2000)) and all(r["length"] == rows[r["doc_id"]][1] for r in got)
    used, loss = defaultdict(int), defaultdict(int)
    for r in got:
        used[r["sequence_id"]] += 1
        loss[r["sequence_id"]] += rows[r["doc_id"]][2]
    check_packing(got, (2048, 6))
    assert max(used.values()) <= 6 and max(loss.values()) <= 900
    bound = max(sum(r[1] for r in rows) / 2048, sum(r[2] for r in rows) / 900, 2000 / 6)
    assert len(used) <= 1.15 * bound
    lone = packing.pack_counts(spark.createDataFrame([(1, 3000, 0), (2, 5, 2000), (None, None, None), (None, 4, 4), (3, 4, 4), (3, 4, 4)], "doc_id bigint, tokens int, loss_tokens int"), loss=900).collect()
    assert {r["doc_id"] for r in lone if r["sequence_id"] is None} == {1, 2} and len(lone) == 6
    assert packing.pack_counts(spark.createDataFrame([], "doc_id bigint, tokens int, loss_tokens int")).count() == 0


def test_each_limit_binds(spark):
    """With one scarce resource at a time, bins stay within a tenth of what that resource alone takes."""
    rng = np.random.default_rng(4)
    kinds = {"tokens": (1, 700, 0.1), "segments": (1, 60, 0.1), "loss": (1, 700, 0.95)}
    for scarce, (low, high, share) in kinds.items():
        rows = [(i, int(n), int(n * share)) for i, n in enumerate(rng.integers(low, high, 3000))]
        limits = {"tokens": 2048, "segments": 12, "loss": 1024}
        got = packing.pack_counts(spark.createDataFrame(rows, "doc_id bigint, tokens int, loss_tokens int").coalesce(1), **limits).collect()
        need = {"tokens": sum(r[1] for r in rows), "segments": len(rows), "loss": sum(r[2] for r in rows)}
        bounds = {k: need[k] / limits[k] for k in limits}
        assert max(bounds, key=bounds.get) == scarce
        assert len({r["sequence_id"] for r in got}) <= 1.1 * bounds[scarce] + 1


def test_conversations(spark):
    rng = np.random.default_rng(6)
    turns = [(c, t, ("user", "assistant")[t % 2], "word " * int(rng.integers(1, 120)), "clash") for c in range(300) for t in range(int(rng.integers(1, 6)))]
    turns += [(900, 0, "assistant", "long " * 1500, "x"), (None, 0, "user", None, "x"), (None, None, None, "one two", None)]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string, tokens string").repartition(3)
    limits = {"tokens": 2048, "segments": 12, "loss": 1024}
    got = packing.pack_conversations(df, BYTES, **limits).collect()
    want = defaultdict(lambda: [0, 0, 0])
    for c, _, role, text, _ in turns:
        n = len(ids_of(BYTES, text)) + 1
        want[c] = [want[c][0] + n, want[c][1] + n * (role == "assistant"), want[c][2] + 1]
    assert {r["conv_id"]: [r["n_tokens"], r["n_loss"], r["n_turns"]] for r in got} == dict(want) and len(got) == len(want)
    assert [r["conv_id"] for r in got if r["sequence_id"] is None] == [900]
    used = defaultdict(lambda: [0, 0, 0])
    for r in sorted(got, key=lambda r: r["offset"] or 0):
        if r["sequence_id"] is not None:
            u = used[r["sequence_id"]]
            assert r["offset"] == u[0]
            used[r["sequence_id"]] = [u[0] + r["n_tokens"], u[1] + 1, u[2] + r["n_loss"]]
    assert all(u[0] <= 2048 and u[1] <= 12 and u[2] <= 1024 for u in used.values())
    assert packing.pack_conversations(df.limit(0), BYTES, **limits).count() == 0


class Counted:
    """A tokenizer that notes how many texts it is given."""

    def __init__(self, own):
        self.own, self.given = own, 0

    def encode_batch_fast(self, texts, **options):
        self.given += len(texts)
        return self.own.encode_batch_fast(texts, **options)


class Looked(dict):
    """A cache that counts how often it is asked."""

    asked = 0

    def get(self, key, default=None):
        self.asked += 1
        return super().get(key, default)

    def __getitem__(self, key):
        self.asked += 1
        return super().__getitem__(key)


@pytest.mark.parametrize(("path", "cut"), [(BYTES, spaced_pieces), (WORDS, space_dropped_pieces)])
def test_a_repeated_piece_is_looked_up_once(path, cut):
    pieces = Pieces(path, cut)
    pieces.known = Looked()
    texts = ["the cat sat " * 300, "", "on the\nmat\n\n", "mat \x01 cat", "the cat sat " * 300]
    assert [list(array.array("I", x)) for x in pieces.ids([t.encode() for t in texts])] == [ids_of(path, t) for t in texts]
    assert pieces.known.asked < 100


def test_pieces_at_line_ends_are_encoded_together():
    pieces = Pieces(BYTES, spaced_pieces)
    pieces.tokenizer = Counted(pieces.tokenizer)
    text = "\n".join(f"{w}{n} end" for n in range(100) for w in ("Line", "é", "...", "'s"))
    assert list(array.array("I", pieces.ids([text.encode()])[0])) == ids_of(BYTES, text)
    assert pieces.tokenizer.given < 10


def test_ids_stay_with_their_texts_over_groups(monkeypatch):
    monkeypatch.setattr("lexibond.llm.common.LINE_BYTES", 40)
    for path, cut in ((BYTES, spaced_pieces), (WORDS, space_dropped_pieces)):
        got = Pieces(path, cut, limit=10).ids([(t or "").encode() for t in TEXTS * 3])
        assert [list(array.array("I", x)) for x in got] == [ids_of(path, t) for t in TEXTS * 3]
