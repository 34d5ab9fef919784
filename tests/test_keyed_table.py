"""Segments, zones, manifest and merging of keyed tables."""

import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from batchwright import segments as S
from batchwright import storage
from batchwright.errors import InvalidData, KeyConflict
from batchwright.operators import append as A
from batchwright.operators import keyed_table as K
from batchwright.schema import create_table, define, read_table

SMALL = define("small", [("k", "integer", "BIGINT"), ("t", "string", "VARCHAR"), ("x", "number", "DOUBLE")], ["k"], "small", "")
PAIR = define("pair", [("a", "string", "VARCHAR"), ("b", "integer", "BIGINT"), ("v", "number", "DOUBLE")], ["a", "b"], "pair", "")


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "table")


def numbers(spark, start, end, step=1):
    return spark.range(start, end, step).selectExpr("id AS k", "'t' AS t", "0D AS x")


def parquet_files(path):
    return sorted(f for folder, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def candidates(spark, path, schema, batch, key_by_key=True):
    """How many of the table's files a batch opens."""
    profile = A.key_profile(batch, list(schema.primary_key))
    ranges = [(A.literal(profile[f"lo_{i}"]), A.literal(profile[f"hi_{i}"])) for i in range(len(schema.primary_key))]
    listed = S.segments(spark, path)
    return len(K.candidate_keys(spark, schema, path, listed, ranges, batch if key_by_key else None)[1])


def test_scattered_keys_open_few_of_many_files(spark, path, monkeypatch):
    """A table of 200 files: keys it lacks open hardly any, keys it has open the files that hold them."""
    monkeypatch.setattr(K, "FILE_BYTES", 2000)
    monkeypatch.setattr(storage, "total_bytes", lambda *_: 400_000)
    A.bulk_append(numbers(spark, 0, 400_000, 2).repartition(8), path, SMALL)
    assert len(parquet_files(f"{path}/_segments")) == 200
    lacking = spark.createDataFrame([(k,) for k in range(1, 400_000, 40_000)], "k bigint")
    held = spark.createDataFrame([(k,) for k in range(0, 400_000, 40_000)], "k bigint")
    assert candidates(spark, path, SMALL, lacking) <= 4
    assert 5 <= candidates(spark, path, SMALL, held) < 20
    narrow = spark.range(1000, 3000).withColumnRenamed("id", "k")
    assert candidates(spark, path, SMALL, narrow, key_by_key=False) <= 3
    batch = lacking.union(held).selectExpr("k", "'new'", "1D")
    assert A.bulk_append(batch, path, SMALL, on_conflict="skip").inserted == lacking.count()
    with pytest.raises(KeyConflict):
        A.bulk_append(held.selectExpr("k", "'new'", "1D"), path, SMALL)


@pytest.mark.parametrize("probe_rows", [A.PROBE_ROWS, 0])
def test_composite_text_keys_with_both_probes(spark, path, monkeypatch, probe_rows):
    monkeypatch.setattr(A, "PROBE_ROWS", probe_rows)
    made = spark.range(3000).selectExpr("concat('g', id % 7, if(id % 5 = 0, 'é', '')) AS a", "id AS b", "double(id) AS v")
    for part in range(3):
        assert A.bulk_append(made.where(f"b % 3 = {part}"), path, PAIR).inserted == 1000
    again = A.bulk_append(made.where("b % 2 = 0").union(made.selectExpr("concat(a, 'z')", "b", "v")), path, PAIR, on_conflict="skip")
    assert (again.inserted, again.skipped) == (3000, 1500)
    assert read_table(spark, PAIR, path).groupBy("a", "b").count().where("count > 1").isEmpty()
    assert read_table(spark, PAIR, path).count() == 6000


def test_batch_is_evaluated_once(spark, path):
    """Every row of the source is counted when it is produced."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    A.bulk_append(numbers(spark, 0, 500), path, SMALL)
    source = numbers(spark, 250, 1250).mapInArrow(counted, "k bigint, t string, x double")
    assert A.bulk_append(source, path, SMALL, on_conflict="skip").inserted == 750
    assert made.value == 1000


def test_failed_batch_leaves_nothing(spark, path, monkeypatch):
    A.bulk_append(numbers(spark, 0, 100), path, SMALL)
    before, version = parquet_files(path), S.versions(spark, path)
    with pytest.raises(KeyConflict):
        A.bulk_append(numbers(spark, 50, 60), path, SMALL)

    def broken(*_):
        raise InvalidData("no commit")

    with monkeypatch.context() as m:
        m.setattr(A, "commit", broken)
        with pytest.raises(InvalidData):
            A.bulk_append(numbers(spark, 200, 300), path, SMALL)
    with monkeypatch.context() as m:
        m.setattr(K, "write_zones", broken)
        with pytest.raises(InvalidData):
            A.bulk_append(numbers(spark, 200, 300), path, SMALL)
    assert (parquet_files(path), S.versions(spark, path)) == (before, version)
    assert read_table(spark, SMALL, path).count() == 100


def test_unlisted_segments_are_invisible_and_commits_are_exclusive(spark, path):
    A.bulk_append(numbers(spark, 0, 100), path, SMALL)
    seen = read_table(spark, SMALL, path)
    K.write_segment(numbers(spark, 500, 600), path, ["k"], 1)
    assert read_table(spark, SMALL, path).count() == 100
    with pytest.raises(InvalidData, match="someone else"):
        S.commit(spark, path, [], 0)
    A.bulk_append(numbers(spark, 500, 510), path, SMALL)
    assert (seen.count(), read_table(spark, SMALL, path).count()) == (100, 110)


def test_levels_keep_segments_few_and_vacuum_frees_the_rest(spark, path):
    most = 0
    for i in range(18):
        A.bulk_append(numbers(spark, i, 18_000, 18), path, SMALL, on_conflict="skip")
        listed = S.segments(spark, path)
        most = max(most, len(listed))
        assert sum(s.rows for s in listed) == 1000 * (i + 1)
    assert most <= 2 * (K.FANOUT - 1) + 1
    assert sorted(s.level for s in S.segments(spark, path)) == [0, 0, 2]
    want = rows(read_table(spark, SMALL, path))
    assert sorted(r[0] for r in want) == list(range(18_000))
    assert S.vacuum(spark, path, keep=1) > 0
    assert rows(read_table(spark, SMALL, path)) == want
    assert len(storage.list_names(spark, f"{path}/_segments")) == 3
    assert A.bulk_append(numbers(spark, 0, 20_000), path, SMALL, on_conflict="skip").inserted == 2000


def test_plain_files_belong_to_the_table(spark, path):
    create_table(spark, SMALL, path)
    numbers(spark, 0, 10).write.mode("append").parquet(path)
    assert A.bulk_append(numbers(spark, 5, 15), path, SMALL, on_conflict="skip").inserted == 5
    assert sorted(r.k for r in read_table(spark, SMALL, path).collect()) == list(range(15))
    with pytest.raises(KeyConflict):
        A.bulk_append(numbers(spark, 3, 4), path, SMALL)


def test_catalog_tables_stay_plain(spark, path):
    create_table(spark, SMALL, path, "small_plain")
    try:
        A.bulk_append(numbers(spark, 0, 10), path, SMALL)
        A.bulk_append(numbers(spark, 5, 15), path, SMALL, on_conflict="skip")
        spark.sql("REFRESH TABLE small_plain")
        assert spark.table("small_plain").count() == read_table(spark, SMALL, path).count() == 15
        assert S.versions(spark, path) == []
    finally:
        spark.sql("DROP TABLE small_plain")


def test_table_without_a_key(spark, path):
    free = define("free", [("k", "integer", "BIGINT"), ("t", "string", "VARCHAR")], [], "free", "")
    for _ in range(5):
        A.bulk_append(spark.range(10).selectExpr("id", "'t'"), path, free)
    assert read_table(spark, free, path).count() == 50


def test_files_are_sorted_and_in_ranges(spark, path, monkeypatch):
    monkeypatch.setattr(K, "FILE_BYTES", 1)
    monkeypatch.setattr(storage, "total_bytes", lambda *_: 10)
    A.bulk_append(numbers(spark, 0, 5000).orderBy(F.rand(3)), path, SMALL)
    held = spark.read.parquet(f"{path}/_segments").groupBy(F.input_file_name().alias("f")).agg(
        F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("lo").collect()
    assert len(held) == 10 and all(a.hi < b.lo for a, b in zip(held, held[1:]))
