import datetime as dt
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from batchwright import functions as B


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_F1_to_F3_numbers_and_text(spark):
    n = F.lit(1234).cast("bigint")
    assert one(spark, B.remainder(n, 1000), B.tagged("Well_", n), B.tagged_padded("R_", n, 3), B.tagged_padded("R_", F.lit(7), 3)) == (
        234, "Well_1234", "R_1234", "R_007",
    )


def test_F4_F5_F7_F8_times(spark):
    start = F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz")
    later = B.plus_hours(B.plus_seconds(start, F.lit(61)), F.lit(25))
    assert one(spark, B.iso_text(later)) == ("2024-01-02T01:01:01+00:00",)
    assert one(spark, B.parse_iso(F.lit("2024-01-01T02:00:00+05:30"))) == (dt.datetime(2024, 1, 1, 2),)


def test_F6_F9_dates(spark):
    day = F.lit(dt.date(2023, 12, 31))
    assert one(spark, B.month_start(day), F.date_add(day, 1), F.datediff(day, F.lit(dt.date(1947, 1, 1)))) == (
        dt.date(2023, 12, 1), dt.date(2024, 1, 1), (dt.date(2023, 12, 31) - dt.date(1947, 1, 1)).days,
    )


@pytest.mark.parametrize("start,step", [(100.0, 0.1), (50.0, 0.05), (25.0, 0.025), (75.0, 0.075)])
def test_F10_rounding_is_exact(spark, start, step):
    x = F.lit(start) + F.col("id").cast("double") * F.lit(step)
    got = [r.y for r in spark.range(0, 1_000_000, 7).select(B.round_cents(x).alias("y")).collect()]
    assert got == [round(start + i * step, 2) for i in range(0, 1_000_000, 7)]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.one_of(st.floats(0, 8e12), st.integers(0, 2**42).map(lambda k: k / 1000), st.integers(0, 10**6).map(lambda k: k / 200)), min_size=1, max_size=200))
def test_F10_any_value(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r.y for r in df.select(B.round_cents(F.col("x")).alias("y")).collect()] == [round(v, 2) for v in values]


def test_F11_json_text(spark):
    assert one(spark, B.json_payload(F.lit(5))) == (json.dumps({"test": "data_5"}),)


def test_F12_hash_values_are_repeatable_and_in_range(spark):
    df = spark.range(2000).select(
        B.hash_int(1, F.col("id"), "a", 1, 9).alias("i"),
        B.hash_real(1, F.col("id"), "b", 10, 8).alias("r"),
        B.capital_letter(1, F.col("id"), "c").alias("c"),
    )
    got = df.collect()
    assert {r.i for r in got} == set(range(1, 10))
    assert all(0 <= r.r <= 10 and round(r.r, 8) == r.r for r in got)
    assert {r.c for r in got} == set("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    assert got == df.repartition(7).sort("i").select("*").collect() or sorted(got) == sorted(df.repartition(7).collect())


def test_F13_uuid_and_now(spark):
    u, now = one(spark, B.random_uuid(), B.now_ntz())
    assert len(u) == 36 and isinstance(now, dt.datetime)


def test_F15_A12_guards(spark):
    zero = F.lit(0)
    assert one(spark, B.percent(F.lit(1), F.lit(4)), B.percent(zero, zero), B.rate(F.lit(6.0), F.lit(4.0)), B.rate(F.lit(6.0), F.lit(0.0))) == (
        25.0, 0.0, 1.5, 0.0,
    )
    assert one(spark, B.ratio(F.lit(1.0), F.lit(0.0))) == (None,)


@pytest.mark.parametrize("digits, high", [(7, 100.0), (8, 20.0), (8, 5.0)])
def test_F10_more_digits(spark, digits, high):
    import random

    rng = random.Random(digits)
    values = [rng.random() * high for _ in range(20_000)] + [k / 2**n for n in range(20, 40) for k in range(1, 40)] + [0.0, 0.5, 1e-9, high]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r.y for r in df.select(B.round_exact(F.col("x"), digits).alias("y")).collect()] == [round(v, digits) for v in values]


def test_F6_days(spark):
    df = spark.createDataFrame([(dt.date(2024, 2, 28), 2), (dt.date(2023, 12, 31), 1), (dt.date(2024, 1, 1), -1), (None, 1)], "d date, n bigint")
    got = df.select(B.plus_days(F.col("d"), F.col("n")).alias("e"), B.days_between(F.col("d"), F.lit(dt.date(2024, 3, 1))).alias("k")).collect()
    assert [tuple(r) for r in got] == [(dt.date(2024, 3, 1), 2), (dt.date(2024, 1, 1), 61), (dt.date(2023, 12, 31), 60), (None, None)]
