import hashlib
import re

from batchwright.llm import exact_dedup as module
from batchwright.llm.exact_dedup import exact_dedup, merge_runs


def brute(rows):
    digest = [hashlib.sha256(re.sub(r"[ \t-\r]+", " ", text or "").encode()).hexdigest() for _, text in rows]
    groups = {}
    for (doc_id, _), d in zip(rows, digest):
        groups.setdefault(d, []).append(doc_id)
    out = []
    for (doc_id, _), d in zip(rows, digest):
        ids = [i for i in groups[d] if i is not None]
        keep = min(ids) if ids else None
        out.append((doc_id, keep, len(groups[d]), doc_id == keep, d))
    return sorted(out, key=repr)


ROWS = [(5, "a  b"), (3, "a\t\nb"), (9, "a b "), (7, None), (8, ""), (8, ""), (None, "a b"), (None, "only"), (2, " a b"),
        (1, "x " * 60000), (4, "x\n" * 60000), (6, " "), (10, "\x0b\x0c\r")]


def test_edge_rows_and_repeats(spark):
    df = spark.createDataFrame([(t, i, "p", 0) for i, t in ROWS], "text string, doc_id long, digest string, run int")
    for parts in (1, 5, 13):
        got = sorted((tuple(r) for r in exact_dedup(df.repartition(parts)).collect()), key=repr)
        assert got == brute(ROWS)


def test_empty_table(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_every_round_keeps_the_smallest_identifier(spark, monkeypatch):
    monkeypatch.setattr(module, "BITS", 1)
    df = spark.createDataFrame([(i, f"t{i % 7}") for i in range(200)], "doc_id long, text string").repartition(11)
    rows = module.digest_rows(df)
    got = sorted((r.keep_id, r.group_size) for r in merge_runs(rows, 11).collect())
    assert got == [(i, len(range(i, 200, 7))) for i in range(7)]


def test_a_digest_with_two_texts_stops_the_job(spark):
    import pytest

    rows = spark.createDataFrame([(1, "d", (1, 2), 0), (2, "d", (1, 3), 0)],
                                 "doc_id long, digest string, proof struct<size: int, second: long>, run int")
    with pytest.raises(Exception, match="one digest, two texts"):
        merge_runs(rows, 1).collect()
