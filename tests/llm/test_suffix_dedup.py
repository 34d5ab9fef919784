import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from batchwright.llm import suffix_dedup as module
from batchwright.llm.queries import QUERIES
from batchwright.llm.suffix_dedup import refine, repeated_spans, suffix_report, window_anchors


def brute(rows, length=200):
    """Count every string of `length` bytes, then mark what the repeated ones cover."""
    texts = [(text or "").encode() for _, text in rows]
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc_id, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, dtype=np.int8)
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = 1
        kept = bytes(b for b, g in zip(t, gone) if not g)
        n_spans = int((np.diff(np.append(0, gone)) == 1).sum())
        out.append((doc_id, len(t), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def answer(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)


def test_query_equals_counting(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = answer(QUERIES["op1_suffix_dedup"](spark, sf))
    assert got == brute(rows)
    assert any(0 < r[2] < r[1] for r in got)


def test_refinement_equals_equality():
    rng = random.Random(6)
    for length in (8, 16, 24, 37, 200):
        strings = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(12)]
        strings += [strings[0] * 9, strings[1] * 9, strings[0] * 9]
        data = np.frombuffer("".join(strings).encode(), dtype=np.uint8)
        ends = np.cumsum([len(s) for s in strings])
        owner = np.repeat(np.arange(len(strings)), [len(s) for s in strings])
        bucket = refine(data, ends, owner, length)
        seen = {}
        for i in range(len(data)):
            if i + length <= ends[owner[i]]:
                seen.setdefault(data[i : i + length].tobytes(), []).append(i)
        for places in seen.values():
            groups = {int(bucket[i]) for i in places}
            assert len(groups) == 1 and (groups == {-1}) == (len(places) == 1)
        named = [int(bucket[places[0]]) for places in seen.values() if len(places) > 1]
        assert len(set(named)) == len(named)
        assert (bucket >= 0).sum() == sum(len(p) for p in seen.values() if len(p) > 1)


def test_anchor_is_the_last_smallest_of_its_window():
    rng = np.random.default_rng(0)
    grams = rng.integers(0, 40, 1000, dtype=np.uint64) << np.uint64(40)
    got = window_anchors(grams)
    for s in range(len(grams) - module.REACH):
        part = grams[s : s + module.REACH + 1]
        assert got[s] == s + np.flatnonzero(part == part.min())[-1]


@pytest.mark.parametrize("contexts", [1024, 2])
def test_short_strings_of_few_letters(spark, monkeypatch, contexts):
    """LENGTH 24 over repetitive texts: periodic runs, self overlaps, crowded buckets with several salts."""
    for name, value in (("LENGTH", 24), ("GRAM", 8), ("REACH", 16), ("CONTEXTS", contexts), ("SCAN_BYTES", 300), ("SCAN_BITS", 10)):
        monkeypatch.setattr(module, name, value)
    rng = random.Random(9)
    common = "the shared passage of forty-six letters, in all"
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 80))) for _ in range(30)]
    texts += ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(0, 60))) + common
              + "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    texts += ["a" * 3000, "ab" * 900, "xyz" * 9, common[:23], common[:24], common * 3, ""]
    texts += [t[rng.randint(0, 9) :] + "?" for t in texts[:20]] + texts[28:33]
    texts += ["".join(rng.choice("abcdefghijklmnop") for _ in range(4000))] * 1
    texts += [texts[-1][:1500] + "#" + texts[-1][1500:]]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert answer(suffix_report(df)) == brute(rows, 24)


def test_edge_rows(spark):
    long = " ".join(f"word{i * i}" for i in range(20000))
    rows = [(1, None), (2, ""), (3, "x" * 199), (4, "x" * 200), (5, "y" * 201), (6, long), (7, long[5000:90000]), (8, "z" + "é" * 300),
            (8, "z" + "é" * 300), (None, "q" * 150 + "r" * 150), (None, "q" * 150 + "r" * 150), (9, "s" * 150 + "t" * 60)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, doc int")
    assert answer(suffix_report(df)) == brute(rows)
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in repeated_spans(df).collect()}
    assert spans[6] == [(5000, 90000)] and spans[5] == [(0, 201)]
    assert suffix_report(df.limit(0)).collect() == []
