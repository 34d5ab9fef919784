import datetime as dt
import json

import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

from batchwright.errors import InvalidData
from batchwright.operators.query import group_summary
from batchwright.sources import synth as G


COLUMNS = (
    "field_code _field_name well_code _well_reference well_name production_period days_on_production oil_production_kbd "
    "gas_production_mmcfd liquids_production_kbd water_production_kbd data_source source_data partition_0"
).split()


def row(*values):
    return dict(zip(COLUMNS, values))


# Rows at chosen places, written out.
FIRST = row(0, "Field_0", 0, "WELL_REF_000", "Well_0", "2024-01-01T00:00:00+00:00", 30, 100.0, 50.0, 25.0, 75.0,
            "performance_test", '{"test": "data_0"}', "partition_0")
SECOND = row(1, "Field_1", 1, "WELL_REF_001", "Well_1", "2024-01-01T00:00:01+00:00", 30, 100.1, 50.05, 25.02, 75.08,
             "performance_test", '{"test": "data_1"}', "partition_1")
END_OF_CHUNK = row(999, "Field_999", 99, "WELL_REF_099", "Well_99", "2024-01-01T00:16:39+00:00", 30, 199.9, 99.95, 49.98, 149.93,
                   "performance_test", '{"test": "data_999"}', "partition_9")
NEXT_CHUNK = FIRST | {"production_period": "2024-01-01T00:16:40+00:00"}
LATE_HOUR = row(234, "Field_234", 34, "WELL_REF_034", "Well_34", "2010-02-21T10:00:00+00:00", 30, 223.4, 111.7, 55.85, 167.55,
                "performance_test", '{"test": "data_1234"}', "partition_4")


def near(value, numerator, denominator):
    """Two digits at most, and within half a hundredth of the exact fraction (rounded either way at a tie)."""
    hundredths = round(value * 100)
    return value == hundredths / 100 and abs(hundredths * denominator - 100 * numerator) * 2 <= denominator


def check_volumes(number, r):
    assert near(r.oil_production_kbd, 1000 + number, 10)
    assert near(r.gas_production_mmcfd, 1000 + number, 20)
    assert near(r.liquids_production_kbd, 1000 + number, 40)
    assert near(r.water_production_kbd, 3000 + 3 * number, 40)


def test_G3_chunks(spark):
    got = G.synth(spark, 2500, chunk=1000).orderBy("production_period").collect()
    assert len(got) == 2500
    assert [got[k].asDict() for k in (0, 1, 999, 1000, 1999)] == [
        FIRST, SECOND, END_OF_CHUNK, NEXT_CHUNK, END_OF_CHUNK | {"production_period": "2024-01-01T00:33:19+00:00"}
    ]
    for k, r in enumerate(got):
        check_volumes(k % 1000, r)
        assert json.loads(r.source_data) == {"test": f"data_{k % 1000}"}
    periods = [dt.datetime.fromisoformat(r.production_period) for r in got]
    assert {b - a for a, b in zip(periods, periods[1:])} == {dt.timedelta(seconds=1)}


def test_G1_G2_audit_columns(spark):
    start = dt.datetime(2010, 1, 1)
    got = G.synth(spark, 1500, start, "hour", chunk=None, with_audit=True).orderBy("production_period").collect()
    assert len({r.id for r in got}) == 1500 and {r.version for r in got} == {1}
    bare = [{k: v for k, v in r.asDict().items() if k not in ("id", "created_at", "version")} for r in got]
    assert bare[1234] == LATE_HOUR
    assert bare[0] == FIRST | {"production_period": "2010-01-01T00:00:00+00:00"}
    for k, r in enumerate(got):
        check_volumes(k, r)
    assert G.synth(spark, 1, with_audit=True).columns[:3] == ["id", "created_at", "version"]


@pytest.mark.parametrize("limit", [G.BROADCAST_TEMPLATE_BYTES, 0])
@pytest.mark.parametrize("m,n", [(5, 17), (5, 20), (5, 3), (1, 9), (4, 0)])
def test_J3_quota(spark, monkeypatch, m, n, limit):
    monkeypatch.setattr(G, "BROADCAST_TEMPLATE_BYTES", limit)
    templates = spark.createDataFrame([(i * 10,) for i in range(m)], "t bigint")
    got = G.expand_templates(templates.repartition(3), n, ["t"])
    want = [t * 10 for t in range(m) for _ in range(n // m + (t < n % m))]
    assert [r.t for r in got.orderBy("variation").collect()] == want
    assert sorted(r.variation for r in got.collect()) == list(range(n))


def test_J3_few_templates_spread_over_tasks(spark):
    got = G.expand_templates(spark.range(1), 100_000, ["id"])
    sizes = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == spark.sparkContext.defaultParallelism
    with pytest.raises(InvalidData):
        G.expand_templates(spark.range(0), 5, ["id"])


def test_G4_keys_never_repeat(spark):
    templates = spark.createDataFrame([(0, "src"), (1, None)], "t bigint, s string")
    made = G.synth_variations(templates, 20_001, ["t"], seed=5, source="s")
    keys = made.select("field_code", "well_code", "production_period").distinct()
    assert keys.count() == 20_001 == made.count()
    assert {r.data_source for r in made.select("data_source").distinct().collect()} == {"src", None}
    assert made.filter("_well_reference = well_name").count() == 20_001
    assert {tuple(r) for r in made.select("t", "s", "data_source").distinct().collect()} == {(0, "src", "src"), (1, None, None)}
    plain = G.synth_variations(templates, 10, ["t"])
    assert {r.data_source for r in plain.collect()} == {G.DEFAULT_SOURCE}
    assert rows(made) == rows(G.synth_variations(templates.repartition(2), 20_001, ["t"], seed=5, source="s"))
    with pytest.raises(InvalidData):
        G.synth_variations(templates, G.KEY_SPACE + 1, ["t"])


def test_G4_stride_visits_every_slot():
    from math import gcd

    assert gcd(G.KEY_STRIDE, G.KEY_SPACE) == 1 and G.KEY_STRIDE * G.KEY_SPACE < 2**63


def test_G5_injector(spark):
    made = G.inject_duplicates(spark.range(10), ["id"], extra=3)
    counts = dict(tuple(r) for r in made.groupBy("id").count().collect())
    assert counts == {0: 5} | {i: 2 for i in range(1, 10)}
    assert G.inject_duplicates(spark.range(10), ["id"], extra=0).count() == 20


def test_G8_category_table(spark):
    got = group_summary(G.category_table(spark), "category", "value")
    a, b, c = range(500_000), range(500_000, 800_000), range(800_000, 1_000_000)
    assert rows(got) == [(k, sum(v) / len(v), sum(v), len(v)) for k, v in (("A", a), ("B", b), ("C", c))]


def test_generated_rows_need_no_exchange(spark):
    assert "Exchange" not in plan(G.synth(spark, 1000))
