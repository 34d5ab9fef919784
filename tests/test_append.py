import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from batchwright.errors import EmptyInput, InvalidData, KeyConflict, SchemaNotFound, SchemaValidation
from batchwright.operators import append as A
from batchwright.operators.binding import bind
from batchwright.schema import create_table, define, get_schema, read_table
from batchwright.sources.synth import inject_duplicates, synth, synth_variations

SMALL = define("small", [("k", "integer", "BIGINT"), ("t", "string", "VARCHAR"), ("x", "number", "DOUBLE")], ["k"], "small", "")
WELLS = get_schema("well_production")


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "table")


def batch(spark, *data, columns="k bigint, t string, x double"):
    return spark.createDataFrame(list(data), columns)


def files(spark, path):
    return sorted(spark.read.format("binaryFile").load(path).select("path").toPandas().path) if A.table_exists(spark, path) else []


def test_W6_positional_with_raw_names(spark, path):
    create_table(spark, WELLS, path)
    raw = synth(spark, 2000)
    result = A.bulk_append(raw, path, "well_production")
    assert result == A.AppendResult(True, 2000, 2000, 0)
    back = read_table(spark, WELLS, path)
    assert back.count() == 2000
    row = back.filter("production_period = timestamp_ntz'2024-01-01 00:00:05'").first()
    assert (row.field_name, row.well_reference, row.production_period) == ("Field_5", "WELL_REF_005", dt.datetime(2024, 1, 1, 0, 0, 5))
    assert A.reconcile(raw, back).first().matches


def test_P10_arity_and_key_columns(spark, path):
    with pytest.raises(SchemaValidation, match="2 columns"):
        A.bulk_append(batch(spark, (1, "a"), columns="a bigint, b string"), path, SMALL)
    with pytest.raises(SchemaValidation, match="key"):
        A.bulk_append(batch(spark, ("a",), columns="t string"), path, SMALL, bind_by="name")
    with pytest.raises(SchemaNotFound):
        A.bulk_append(batch(spark, (1, "a", 1.0)), path, "nope")


def test_P11_casts(spark):
    text = batch(spark, (" 7 ", 1, "1.5"), ("3.5", 2, None), ("-2.5", 3, "1e3"), columns="a string, b int, c string")
    assert rows(bind(text, SMALL)) == [(-3, "3", 1000.0), (4, "2", None), (7, "1", 1.5)]
    doubles = batch(spark, (2.5,), (3.5,), (-2.5,), columns="k double")
    assert sorted(r.k for r in bind(doubles, SMALL, "name").collect()) == [-2, 2, 4]


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize("bad", [("", "a", "1"), ("99", "a", "abc")])
def test_P11_failed_cast_rejects_the_batch(spark, path, setting, ansi, bad):
    setting("spark.sql.ansi.enabled", ansi)
    A.bulk_append(batch(spark, (100, "old", 1.0)), path, SMALL)
    before = files(spark, path)
    good = [(str(i), "a", "1") for i in range(50)]
    with pytest.raises(InvalidData, match="cannot convert"):
        A.bulk_append(batch(spark, *good, bad, columns="a string, b string, c string"), path, SMALL)
    assert files(spark, path) == before
    assert rows(read_table(spark, SMALL, path)) == [(100, "old", 1.0)]


def test_P11_bad_value_in_a_skipped_row(spark, path):
    A.bulk_append(batch(spark, (1, "old", 1.0)), path, SMALL)
    with pytest.raises(InvalidData, match="column 'x': cannot convert to double: abc"):
        A.bulk_append(batch(spark, (1, "a", "abc"), columns="k bigint, t string, x string"), path, SMALL, on_conflict="skip")


def test_bind_by_name(spark, path):
    A.bulk_append(batch(spark, (5, 1), columns="extra int, k int"), path, SMALL, bind_by="name")
    assert rows(read_table(spark, SMALL, path)) == [(1, None, None)]


@pytest.mark.parametrize("limit", [A.BROADCAST_KEY_BYTES, 0])
def test_V5_conflicts_reject_everything(spark, path, monkeypatch, limit):
    monkeypatch.setattr(A, "BROADCAST_KEY_BYTES", limit)
    A.bulk_append(batch(spark, (1, "a", 1.0), (2, "b", 2.0)), path, SMALL)
    before = files(spark, path)
    for bad, message in (
        ([(3, "c", 1.0), (None, "d", 1.0)], "null in the key"),
        ([(3, "c", 1.0), (3, "d", 1.0)], "duplicate key"),
        ([(3, "c", 1.0), (2, "d", 1.0)], "duplicate key {'k': 2}"),
    ):
        with pytest.raises(KeyConflict, match=message):
            A.bulk_append(batch(spark, *bad), path, SMALL)
    with pytest.raises(EmptyInput):
        A.bulk_append(batch(spark).limit(0), path, SMALL)
    assert files(spark, path) == before
    assert A.bulk_append(batch(spark, (3, "c", 1.0)), path, SMALL).inserted == 1


@pytest.mark.parametrize("limit", [A.BROADCAST_KEY_BYTES, 0])
def test_W7_skip(spark, path, monkeypatch, limit):
    monkeypatch.setattr(A, "BROADCAST_KEY_BYTES", limit)
    A.bulk_append(batch(spark, (1, "old", 1.0)), path, SMALL)
    data = batch(spark, (9, 1, "n", 1.0), (8, 2, "second", 1.0), (7, 2, "first", 1.0), (6, 3, "c", 1.0),
                 columns="pos int, k bigint, t string, x double")
    result = A.bulk_append(data, path, SMALL, on_conflict="skip", ordinal="pos")
    assert (result.records_processed, result.inserted, result.skipped) == (4, 2, 2)
    assert result.message() == "2 records inserted, 2 duplicates removed"
    want = [(1, "old", 1.0), (2, "first", 1.0), (3, "c", 1.0)]
    assert rows(read_table(spark, SMALL, path)) == want
    again = A.bulk_append(data, path, SMALL, on_conflict="skip", ordinal="pos")
    assert (again.inserted, again.skipped) == (0, 4)
    assert rows(read_table(spark, SMALL, path)) == want


def test_W7_closed_form_counts(spark, path):
    templates = spark.range(3)
    made = inject_duplicates(synth_variations(templates, 5000, ["id"]), ["field_code", "well_code", "production_period"])
    result = A.bulk_append(made, path, WELLS, bind_by="name", on_conflict="skip")
    assert (result.records_processed, result.inserted, result.skipped) == (10_001, 5_000, 5_001)


@pytest.mark.parametrize("limit", [A.BROADCAST_KEY_BYTES, 0])
def test_J2_hot_key_in_the_batch(spark, path, monkeypatch, limit):
    monkeypatch.setattr(A, "BROADCAST_KEY_BYTES", limit)
    A.bulk_append(spark.range(0, 500).selectExpr("id * 2", "'old'", "0D"), path, SMALL)
    hot = spark.range(0, 60_000, 1, 8).selectExpr("if(id % 3 = 0, 7, id % 1000) as k", "'new' as t", "double(id) as x")
    result = A.bulk_append(hot, path, SMALL, on_conflict="skip")
    assert (result.inserted, result.skipped) == (500, 59_500)
    assert read_table(spark, SMALL, path).groupBy("k").count().filter("count > 1").isEmpty()


def test_target_is_pruned_by_the_range_of_the_batch(spark, path):
    A.bulk_append(spark.range(0, 1000).selectExpr("id", "'t'", "0D"), path, SMALL)
    new = bind(spark.range(1000, 1010).selectExpr("id", "'t'", "0D"), SMALL)
    target = A.within_profile(read_table(spark, SMALL, path), ["k"], A.key_profile(new, ["k"]))
    text = target._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(k,1000)" in text and "LessThanOrEqual(k,1009)" in text


def test_partitioned_target_and_unstable_batch(spark, path):
    unstable = synth(spark, 500).withColumn("data_source", F.uuid())
    result = A.bulk_append(unstable, path, WELLS, partition_by=["partition_0"], deterministic=False)
    assert result.inserted == 500
    back = read_table(spark, WELLS, path)
    assert back.count() == 500 and back.columns == WELLS.names
    assert A.bulk_append(unstable, path, WELLS, on_conflict="skip", partition_by=["partition_0"]).inserted == 0


def test_range_of_zone_less_times_does_not_depend_on_the_machine(spark, path, monkeypatch):
    import time

    monkeypatch.setenv("TZ", "Asia/Tokyo")
    time.tzset()
    try:
        rows_ = synth(spark, 100)
        A.bulk_append(rows_, path, WELLS)
        assert read_table(spark, WELLS, path).agg(F.max("production_period")).first()[0] == dt.datetime(2024, 1, 1, 0, 1, 39)
        again = A.bulk_append(rows_, path, WELLS, on_conflict="skip")
        assert (again.inserted, again.skipped) == (0, 100)
        new = bind(synth(spark, 100), WELLS)
        target = A.within_profile(read_table(spark, WELLS, path), ["production_period"], A.key_profile(new, ["production_period"]))
        text = target._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(production_period,2024-01-01T00:00)" in text
    finally:
        monkeypatch.undo()
        time.tzset()
