import json
from collections import Counter

import pytest
from conftest import plan, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from batchwright.errors import InvalidData, KeyConflict
from batchwright.operators import append as A
from batchwright.operators import duplicates as D
from batchwright.operators.joins import rows_with_keys
from batchwright.sources.envelope import read_envelope
from batchwright.sources.parquet import with_row_position
from batchwright.sources.synth import inject_duplicates, synth_variations

KEYS = list(D.DEFAULT_KEYS)


@pytest.fixture(scope="module")
def edge_case(spark):
    """5,000 distinct records, each twice, one three times."""
    templates = spark.createDataFrame([(i,) for i in range(7)], "t bigint")
    unique = synth_variations(templates, 5000, ["t"], seed=3)
    return inject_duplicates(unique, KEYS).cache()


def test_closed_form_counts(edge_case):
    assert tuple(D.duplicate_summary(edge_case).first()) == (10_001, 5_000, 5_001, 5_000)
    assert rows(D.multiplicity_histogram(edge_case)) == [(2, 4_999), (3, 1)]
    assert tuple(D.multiplicity_counts(edge_case).first()) == (4_999, 1)
    report = D.dedupe_report(edge_case).first()
    assert tuple(report)[:3] == (10_001, 5_000, 5_001) and report.reduction_percent == 5001 / 10001 * 100
    assert D.distinct_keys(edge_case).first()[0] == 5_000
    assert abs(D.approx_distinct_keys(edge_case).first()[0] - 5_000) < 500
    assert D.dedupe_first(edge_case, None, ["_field_name"]).count() == 5_000
    assert D.duplicate_members(edge_case).count() == 10_001
    assert A.reconcile_duplicates(edge_case, KEYS, 5_000, 5_001).first().matches
    assert not A.reconcile_duplicates(edge_case, KEYS, 5_000, 5_000).first().matches


def test_D1_first_by_row_position(spark, tmp_path):
    data = [(1, "a"), (2, "b"), (1, "c"), (None, "d"), (None, "e"), (2, "f")]
    spark.createDataFrame(data, "k bigint, v string").coalesce(1).write.parquet(str(tmp_path / "p"))
    df = with_row_position(spark.read.parquet(str(tmp_path / "p")))
    kept = D.dedupe_first(df, ["k"], ["ordinal"]).drop("ordinal")
    assert rows(kept) == sorted([(1, "a"), (2, "b"), (None, "d")], key=repr)
    with pytest.raises(InvalidData):
        D.dedupe_first(df, ["k"], [])


def test_D1_first_by_document_position(spark, tmp_path):
    for name, values in (("a.json", [(1, "x"), (2, "y"), (1, "z")]), ("b.json", [(2, "w"), (3, "v")])):
        (tmp_path / name).write_text(json.dumps({"value": [{"k": k, "v": v} for k, v in values]}))
    df = read_envelope(spark, str(tmp_path)).select(
        "ordinal", F.variant_get("record", "$.k", "int").alias("k"), F.variant_get("record", "$.v", "string").alias("v")
    )
    assert rows(D.dedupe_first(df, ["k"], ["ordinal"]).select("k", "v")) == [(1, "x"), (2, "y"), (3, "v")]


def test_D2_key_resolution(spark):
    df = spark.createDataFrame([(1, 2, 3)], "well_code int, x int, field_code int")
    assert D.resolve_keys(df) == ["field_code", "well_code"]
    assert D.resolve_keys(df, ["x", "nope"]) == ["x"]
    assert D.resolve_keys(df, ["nope"]) == ["well_code", "x", "field_code"]


def test_D3_empty_input(spark):
    empty = spark.createDataFrame([], "field_code bigint")
    assert tuple(D.dedupe_report(empty).first()) == (0, 0, 0, 0.0)
    assert D.dedupe_first(empty, None, ["field_code"]).count() == 0


def test_D4_D7_groups_members_examples(spark):
    data = [("b", 1), ("a", 2), ("b", 3), (None, 4), ("a", 5), (None, 6), ("c", 7), ("b", 8)]
    df = spark.createDataFrame(data, "k string, pos bigint")
    assert rows(D.duplicate_groups(df, ["k"], "pos")) == rows(
        spark.createDataFrame([("b", 3, 1, 8), ("a", 2, 2, 5), (None, 2, 4, 6)], "k string, n bigint, f bigint, l bigint")
    )
    assert sorted(r.pos for r in D.duplicate_members(df, ["k"]).collect()) == [1, 2, 3, 4, 5, 6, 8]
    assert sorted(r.pos for r in D.duplicate_examples(df, ["k"], "pos", 2).collect()) == [1, 2, 3, 5, 8]
    assert sorted(r.pos for r in D.duplicate_examples(df, ["k"], k=1).collect()) == [4, 6]


def test_A7_unique(spark):
    D.assert_unique(spark.range(5), ["id"])
    with pytest.raises(KeyConflict, match="'id': 1"):
        D.assert_unique(spark.createDataFrame([(1,), (2,), (1,)], "id bigint"), ["id"])


keys = st.one_of(st.none(), st.integers(0, 3))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(keys, keys, st.integers(0, 1000)), min_size=1, max_size=40))
def test_properties(spark, data):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(data)], "a bigint, b bigint, v bigint, pos bigint")
    counts = Counter((a, b) for a, b, _ in data)
    first = {}
    for i, (a, b, v) in enumerate(data):
        first.setdefault((a, b), (a, b, v, i))
    once = D.dedupe_first(df.repartition(3), ["a", "b"], ["pos"])
    assert rows(once) == sorted(first.values(), key=repr)
    assert rows(D.dedupe_first(once, ["a", "b"], ["pos"])) == rows(once)
    total, unique, surplus, repeated = D.duplicate_summary(df, ["a", "b"]).first()
    assert (total, unique, surplus) == (len(data), len(counts), len(data) - len(counts))
    assert repeated == sum(n > 1 for n in counts.values())
    assert D.duplicate_members(df, ["a", "b"]).count() == sum(n for n in counts.values() if n > 1)


def test_D1_hot_key_is_cut_before_the_exchange(spark):
    """A third of all rows share one key; what is shuffled is one row per key and task."""
    df = spark.range(0, 300_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 1000).alias("k"), F.col("id").alias("v")
    )
    kept = D.dedupe_first(df, ["k"], ["v"])
    text = plan(kept)
    assert text.index("Final") < text.index("Exchange hashpartitioning") < text.index("Partial")
    assert kept.count() == 1001 and kept.filter("k = -1").first().v == 0


def test_J1_hot_key_is_split_by_aqe(spark, setting):
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    setting("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "200KB")
    setting("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100KB")
    setting("spark.sql.adaptive.coalescePartitions.enabled", "false")
    setting("spark.sql.shuffle.partitions", "16")
    df = spark.range(0, 200_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("t")
    )
    members = D.duplicate_members(df, ["k"])
    got = members.collect()
    assert len(got) == 66_667
    assert "skew=true" in plan(members)
    assert {r.k for r in got} == {-1}


def test_J1_null_safe(spark):
    df = spark.createDataFrame([(1, None), (None, None), (2, "x")], "a bigint, b string")
    found = rows_with_keys(df, spark.createDataFrame([(None, None), (1, None)], "a bigint, b string"), ["a", "b"])
    assert rows(found) == sorted([(1, None), (None, None)], key=repr)


def test_D4_positions_of_any_size(spark):
    df = spark.range(0, 5000, 1, 4).selectExpr("if(id % 10 = 0, id, if(id % 7 = 0, null, 1)) AS k", "id")
    masks = D.duplicate_positions(df, ["k"], "id")
    assert {r.k for r in masks.select("k").distinct().collect()} == {None, 1}
    assert masks.count() <= 2 * (5000 // D.MASK_BITS + 1)
    assert rows(D.listed_positions(masks, "id")) == rows(df.filter("k IS NULL OR k = 1"))
    assert D.duplicate_positions(df.limit(0), ["k"], "id").count() == 0
