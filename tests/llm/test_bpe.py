import hashlib
import random
import time

import public_tokenizers
import pytest
import tiktoken

from batchwright.llm import bpe
from batchwright.llm.bpe import Tokenizer, decode_documents, encode_documents, read_ranks, token_report
from batchwright.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as file:
        return read_ranks(file.read())


@pytest.fixture(scope="module")
def ours(ranks):
    return Tokenizer(ranks, PATTERN)


@pytest.fixture(scope="module")
def theirs(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_of_odd_characters(ours, theirs):
    spaces = "".join(map(chr, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 0x1680, 0x180E, 0x2000, 0x200B, 0x2028, 0x202F, 0x205F, 0x3000, 0xFEFF]))
    rng = random.Random(3)
    texts = [a + b + c for a in spaces for b in spaces for c in ("x", "", " y")]
    alphabet = spaces + "aé1²Ⅷß中🙂'sStLlvVe.,!-ǅ́­"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(2000)]
    for text in texts:
        assert ours.encode(text) == theirs.encode_ordinary(text), text.encode("unicode_escape")


def test_ties_long_runs_and_random_bytes(ours, theirs):
    rng = random.Random(4)
    texts = ["a" * n for n in range(70)] + ["ab" * 700, "aaab" * 900, "é" * 999, " " * 5000, "x" * 20000, "0" * 3000]
    texts += ["".join(rng.choice("abcdeéstionin") for _ in range(rng.randint(1, 90))) for _ in range(3000)]
    for text in texts:
        ids = ours.encode(text)
        assert ids == theirs.encode_ordinary(text)
        assert ours.decode(ids) == text.encode()


def expected(theirs, text):
    ids = theirs.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_query_equals_tiktoken(spark, sf, theirs):
    want = sorted((r.doc_id, *expected(theirs, r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sorted(tuple(r) for r in QUERIES["op2_byte_bpe"](spark, sf).collect()) == want


def test_edge_rows_and_full_memory(spark, theirs, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE_CHARS", 40)
    monkeypatch.setattr(bpe, "REMEMBERED_CHARS", 10)
    rows = [(1, None, 1), (2, "", 2), (3, "tie tie", 3), (3, "tie tie", 3), (None, "no id", 4), (5, "long " * 30000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    want = sorted(((i, *expected(theirs, t)) for i, t, _ in rows), key=repr)
    assert sorted((tuple(r) for r in token_report(df, PATH, PATTERN).collect()), key=repr) == want
    assert token_report(df.limit(0), PATH, PATTERN).collect() == []


def test_documents_round_trip(spark):
    rows = [(1, None), (2, ""), (3, "Ça va? 123  x\n"), (4, "  ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = decode_documents(encode_documents(df, PATH, PATTERN), PATH, PATTERN).collect()
    assert {r.doc_id: bytes(r.decoded).decode() for r in got} == {i: t or "" for i, t in rows}
    assert [len(r.token_ids) for r in sorted(got)][:2] == [0, 0]


def test_long_pieces_by_rounds_of_one_rank(ours, theirs, monkeypatch):
    """Short pieces through the long ones' way as well, so that every rank order occurs."""
    rng = random.Random(6)
    with monkeypatch.context() as m:
        m.setattr(bpe, "LONG_BYTES", 1)
        for _ in range(4000):
            text = "".join(rng.choice("abcdeéstioningrñ") for _ in range(rng.randint(1, 60)))
            assert ours.encode(text) == theirs.encode_ordinary(text), text
        for text in ("a" * 999, "ab" * 333, "aab" * 200):
            assert ours.encode(text) == theirs.encode_ordinary(text)


def test_a_merge_that_opens_a_smaller_rank():
    """A vocabulary in which a union is older than one of its parts, which training cannot give."""
    own = {bytes([b]): b + 1000 for b in range(256)} | {b"ab": 2000, b"cab": 5, b"abab": 7, b"cabab": 3}
    ranks = {token: rank for token, rank in own.items()}
    mine = Tokenizer(ranks, r".+")
    theirs = tiktoken.Encoding("odd", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice("abc") for _ in range(rng.randint(2, 40)))
        if text.encode() not in ranks:
            assert mine._merge_long(text.encode()) == theirs.encode_ordinary(text), text


def test_one_piece_of_a_megabyte(ours, theirs):
    rng = random.Random(2)
    for text in ("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000)), "x" * 1_000_000):
        start = time.perf_counter()
        ids = ours.encode(text)
        assert time.perf_counter() - start < 20
        assert ours.decode(ids) == text.encode()
    short = text[:1] + "".join(rng.choice("etaoin") for _ in range(20_000))
    assert ours.encode(short) == theirs.encode_ordinary(short)
