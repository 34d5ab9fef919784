import datetime as dt
import hashlib

import pytest
from conftest import rows
from pyspark.sql import functions as F

from batchwright.errors import DatasetNotFound, InvalidData, RecordNotFound
from batchwright.operators import position as P
from batchwright.operators import query as Q
from batchwright.operators.position import with_row_position
from batchwright.sources.parquet import bulk_read, dataset_path, parquet_scan, read_partitioned
from batchwright.sources.parquet import with_row_position as scan_position
from batchwright.sources.synth import synth

ORDER = ["o_totalprice", "o_orderkey"]


def test_S7_S8_names(spark, table):
    Q.register(table("nation"), "nation_view")
    assert spark.sql("SELECT * FROM nation_view").count() == 25
    got = Q.query(spark, "SELECT count(*) AS n FROM {a} JOIN {b} ON n_regionkey = r_regionkey", a=table("nation"), b=table("region"))
    assert got.first().n == 25


def test_R2_scan(spark, sf, table):
    assert rows(parquet_scan(spark, f"{sf}/region.parquet")) == rows(table("region"))


def test_P6_L1(table):
    assert Q.point_lookup(table("orders"), "o_orderkey", 7).count() == 1
    assert Q.first_match(table("orders"), "o_orderstatus", "F", ["o_orderkey"]).first().o_orderkey == table(
        "orders"
    ).filter("o_orderstatus = 'F'").agg(F.min("o_orderkey")).first()[0]
    with pytest.raises(RecordNotFound):
        Q.first_match(table("orders"), "o_orderstatus", "Z", ["o_orderkey"], must_exist=True)


def test_P7_P9_conditions(spark):
    df = spark.range(10)
    def ids(d):
        return [r.id for r in d.orderBy("id").collect()]

    assert ids(Q.where_all(df, Q.in_range("id", 2, 4))) == [2, 3, 4]
    assert ids(Q.where_all(df, Q.in_range("id", 2, 4, high_open=True))) == [2, 3]
    assert ids(Q.where_all(df, Q.in_range("id", low=8), None)) == [8, 9]
    assert Q.where_all(df, None, Q.in_range("id")).count() == 10


def test_A1_A2_empty(spark):
    empty = spark.range(0)
    assert Q.row_count(empty).first().row_count == 0
    assert Q.sum_of(empty, F.col("id"), "s").first().s is None


def test_A5_null_values_and_zero_divisor(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, None, 1.0), (1, 3.0, 0.0), (2, None, None)], "g int, a double, b double")
    got = Q.group_means(df, "g", {"a": F.col("a"), "r": Q.mean_ratio("a", "b")})
    assert rows(got) == [(1, 2.0, 0.5), (2, None, None)]


def test_A6_category(spark):
    df = spark.createDataFrame([("A", 1), ("A", 3), ("B", 5)], "c string, v bigint")
    assert rows(Q.group_summary(df, "c", "v")) == [("A", 2.0, 4, 2), ("B", 5.0, 5, 1)]
    assert rows(Q.group_summary(df, "c", "v", only="B")) == [("B", 5.0, 5, 1)]


def test_L4_deep_page_equals_shallow_page(table, monkeypatch):
    shallow = [tuple(r) for r in Q.page(table("orders"), ORDER, 700, 30).collect()]
    downward = [F.col(ORDER[0]).desc(), *ORDER[1:]]
    shallow_down = [tuple(r) for r in Q.page(table("orders"), downward, 700, 30).collect()]
    monkeypatch.setattr(Q, "TOP_K_ROWS", 10)
    deep = [tuple(r) for r in Q.page(table("orders"), ORDER, 700, 30).collect()]
    assert deep == shallow and len(deep) == 30
    assert [tuple(r) for r in Q.page(table("orders"), downward, 700, 30).collect()] == shallow_down != shallow
    assert Q.page(table("orders"), ORDER, 10_000, 30).count() == 0
    with pytest.raises(InvalidData):
        Q.page(table("orders"), ORDER, -1, 30)


def test_L4_pages_with_ties_equal_rows_and_maps_fit_together(spark, monkeypatch):
    df = spark.createDataFrame([(i % 3 or None, i % 5, {"a": i % 5}) for i in range(90)], "k int, v int, m map<string,int>")
    order = [F.col("k").desc_nulls_first()]
    whole = [tuple(r) for r in Q.page(df, order, 0, 90).collect()]
    monkeypatch.setattr(Q, "TOP_K_ROWS", 40)
    paged = [tuple(r) for skip in range(0, 100, 17) for r in Q.page(df.repartition(4), order, skip, 17).collect()]
    assert paged == whole and sorted(map(repr, whole)) == sorted(repr(tuple(r)) for r in df.collect())


def test_L4_keyset(table):
    seen, last = [], None
    while got := [r.o_orderkey for r in Q.page_after(table("orders"), "o_orderkey", last, 400).collect()]:
        seen += got
        last = got[-1]
    assert seen == list(range(1500))


def test_row_position_with_ties_and_few_partitions(spark, setting):
    setting("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.range(0, 5000, 1, 9).select((F.col("id") * 37 % 5000).alias("k"), F.lit("x").alias("v"))
    got = with_row_position(df, ["k"]).collect()
    assert all(r.position == r.k for r in got) and len(got) == 5000
    ids = spark.range(0, 50_000, 1, 4).select(F.lit(1).alias("k"), "id")
    tied = with_row_position(ids, ["k"])
    placed = {r.id: r.position for r in tied.collect()}
    assert sorted(placed.values()) == list(range(50_000))
    assert placed == {r.id: r.position for r in with_row_position(ids.repartition(9), ["k"]).collect()}
    sizes = tied.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 25_000
    assert with_row_position(spark.range(0), ["id"]).count() == 0


def test_L5_samples(spark):
    df = spark.range(20_000)
    one = rows(Q.sample_by_hash(df, ["id"], 0.1, 1))
    assert one == rows(Q.sample_by_hash(df.repartition(13), ["id"], 0.1, 1))
    assert one != rows(Q.sample_by_hash(df, ["id"], 0.1, 2)) and 1700 < len(one) < 2300
    assert rows(Q.sample_fraction(df, 0.1, 3)) == rows(Q.sample_fraction(df, 0.1, 3))


def test_L5_keys_near_the_end_of_bigint(spark):
    keys = [0, 1, 3_470_000_000, 2**62, 2**63 - 1, -5, -(2**63)]
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    got = {r.k for r in Q.sample_by_multiplier(df, "k", 2654435761, 1000, 400).collect()}
    assert got == {k for k in keys if k * 2654435761 % 1000 < 400}
    with pytest.raises(InvalidData):
        Q.sample_by_multiplier(df, "k", 2**40 + 1, 2**40 + 5, 1)


def test_L5_seeded_digest_sample(spark):
    df = spark.range(4000)
    want = {i for i in range(4000) if int(hashlib.md5(f"3:{i}".encode()).hexdigest(), 16) < 0.1 * 2**128}
    assert {r.id for r in Q.sample_by_digest(df.repartition(5), ["id"], 0.1, 3).collect()} == want
    assert Q.sample_by_digest(df, ["id"], 1.0, 3).count() == 4000 and Q.sample_by_digest(df, ["id"], 0.0, 3).count() == 0


def test_L6_shuffle(spark):
    df = spark.range(1000)
    one = [r.id for r in Q.shuffle_rows(df, 1, ["id"]).collect()]
    assert one == [r.id for r in Q.shuffle_rows(df.repartition(5), 1, ["id"]).collect()]
    assert sorted(one) == list(range(1000)) != one
    assert one != [r.id for r in Q.shuffle_rows(df, 2, ["id"]).collect()]


def test_L7_spot_check(spark):
    df = spark.createDataFrame([(0, "b"), (0, "a"), (3, "c"), (9, "e"), (9, "d")], "k bigint, v string")
    got = Q.spot_check(df, "k", [0, 3], ["v"], "Field Code")
    assert rows(got) == [("Field Code 0", 0, "a"), ("Field Code 3", 3, "c"), ("Max Field Code", 9, "d")]
    assert Q.spot_check(df.limit(0), "k", [0, 3], ["v"], "Field Code").count() == 0


def test_U1_U2(spark):
    a, b = spark.createDataFrame([(1, "x")], "i int, s string"), spark.createDataFrame([("y", 2)], "s string, i int")
    assert rows(Q.stack(a, b, a.select("i"))) == sorted([(1, "x"), (2, "y"), (1, None)], key=repr)
    assert rows(Q.bag_union(a, a, a)) == [(1, "x")] * 3


@pytest.mark.parametrize("layout", ["{year}/{month:02d}", "year={year}/month={month}"])
def test_R14_directories(spark, tmp_path, layout):
    root = tmp_path / "taxi"
    for year in (2013, 2014, 2015, 2016):
        for month in (1, 12):
            frame = spark.createDataFrame([(year * 100 + month, dt.datetime(year, month, 1))], "v bigint, ts timestamp_ntz")
            frame.coalesce(1).write.parquet(str(root / layout.format(year=year, month=month)))
    df = read_partitioned(spark, str(root), ["year", "month"], where="year > 2014 AND month = 12")
    assert rows(df.select("v", "year", "month")) == [(201512, 2015, 12), (201612, 2016, 12)]
    assert len(df.inputFiles()) == 2
    assert read_partitioned(spark, str(root), ["year", "month"]).count() == 8
    none = read_partitioned(spark, str(root), ["year", "month"], where="year > 2100")
    assert none.count() == 0 and none.columns == df.columns
    with pytest.raises(DatasetNotFound):
        read_partitioned(spark, str(tmp_path / "none"), ["year"])
    with pytest.raises(InvalidData):
        read_partitioned(spark, str(root), ["a", "b", "c"])


def test_R1_named_dataset(spark, tmp_path):
    path = dataset_path(str(tmp_path), "well_production", "1K")
    assert path.endswith("/well_production_data_1K.parquet")
    synth(spark, 1000).write.parquet(path)
    assert bulk_read(spark, path, name="well_production").count() == 1000
    with pytest.raises(DatasetNotFound, match="well_production"):
        bulk_read(spark, dataset_path(str(tmp_path), "well_production", "1K", "feather"), "feather", name="well_production")
    with pytest.raises(InvalidData):
        dataset_path("x", "y", "1K", "csv")


def test_scan_position(spark, sf):
    df = scan_position(spark.read.parquet(f"{sf}/lineitem.parquet"))
    assert sorted(r.row for r in df.select("ordinal.row").collect()) == list(range(6000))


def test_R14_text_and_null_partitions(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b", 7), (2, None, 8), (3, "c=d/e", None)], "v int, t string, n int")
    df.write.partitionBy("t", "n").parquet(str(tmp_path / "d"))
    got = read_partitioned(spark, str(tmp_path / "d"), ["t", "n"])
    assert rows(got) == sorted([(1, "a b", 7), (2, None, 8), (3, "c=d/e", None)], key=repr)
    assert rows(read_partitioned(spark, str(tmp_path / "d"), ["t", "n"], where="t IS NULL OR n = 7")) == [(1, "a b", 7), (2, None, 8)]
    assert "PartitionFilters: [isnotnull(t" in got.filter("t = 'a b'")._jdf.queryExecution().executedPlan().toString()


def test_R14_declared_types_and_pruning_by_a_join(spark, tmp_path):
    root = tmp_path / "codes"
    for code in ("007", "08", "8", "x'y"):
        spark.createDataFrame([(code,)], "v string").coalesce(1).write.parquet(str(root / code))
    df = read_partitioned(spark, str(root), ["code"], types={"code": "string"})
    assert rows(df) == sorted(((c, c) for c in ("007", "08", "8", "x'y")), key=repr)
    assert rows(df.where("code = '08'")) == [("08", "08")] and len(df.where("code = '08'").inputFiles()) == 1
    with pytest.raises(InvalidData, match="bigint"):
        read_partitioned(spark, str(root), ["code"])
    native = tmp_path / "native"
    spark.createDataFrame([(1, "007"), (2, "08"), (3, None)], "v int, code string").write.partitionBy("code").parquet(str(native))
    got = read_partitioned(spark, str(native), ["code"], types={"code": "string"})
    assert rows(got) == sorted([(1, "007"), (2, "08"), (3, None)], key=repr)
    chosen = spark.createDataFrame([("08", 1), ("9", 0)], "wanted string, flag int").where("flag = 1")
    joined = df.join(F.broadcast(chosen), F.col("code") == F.col("wanted"))
    assert joined.count() == 1 and "dynamicpruning" in joined._jdf.queryExecution().executedPlan().toString()


def test_L5_exact_size_per_stratum(spark):
    df = spark.range(20_000).selectExpr("id", "if(id % 3 > 0, 'hot', if(id < 30, 'rare', 'other')) AS kind")
    one = Q.sample_exact(df, ["kind"], ["id"], 50, 1)
    assert {r.kind: r["count"] for r in one.groupBy("kind").count().collect()} == {"hot": 50, "rare": 10, "other": 50}
    assert rows(one) == rows(Q.sample_exact(df.repartition(7), ["kind"], ["id"], 50, 1))
    assert rows(one) != rows(Q.sample_exact(df, ["kind"], ["id"], 50, 2))
    want = sorted((hashlib.md5(f"1:{i}".encode()).hexdigest(), i) for i in range(20_000) if i % 3)[:50]
    assert sorted(r.id for r in one.where("kind = 'hot'").collect()) == sorted(i for _, i in want)
    assert "WindowGroupLimit" in one._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("order", [
    lambda: ["x", "id"], lambda: [F.col("x").desc(), "id"], lambda: [F.desc("x"), F.col("id").desc()], lambda: [F.col("x").asc_nulls_last(), "id"],
    lambda: [F.col("x").desc_nulls_first(), "id"], lambda: [F.col("x") + 0, "id"], lambda: ["t"], lambda: [F.col("d").desc(), "id"],
    lambda: ["same", "id"],
])
def test_L4_page_by_rank(spark, order):
    order = order()
    df = spark.range(0, 20_000, 1, 5).selectExpr(
        "id", "if(id % 10 = 0, null, double(id * 7919 % 4001)) AS x", "concat('t', id * 31 % 20000) AS t", "1 AS same",
        "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id * 17 % 20000) AS d")
    want = [r.id for r in df.orderBy(*order).collect()]
    for skip in (0, 1990, 9000, 17_999, 19_990, 25_000):
        assert [r.id for r in P.rows_between(df, order, skip, 20).collect()] == want[skip : skip + 20], skip


def test_L4_deep_page_sorts_a_part_only(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 200_000, 1, 4).selectExpr("id", "id * 7919 % 200003 AS x").write.parquet(path)
    df = spark.read.parquet(path)
    near, passed = P._near_page(df, ["x"], 100_000, 50)
    assert near.count() <= 2000 and passed <= 100_000
    assert "GreaterThanOrEqual(x" in near._jdf.queryExecution().executedPlan().toString()
    assert [r.x for r in Q.page(df, ["x"], 100_000, 50).collect()] == sorted(i * 7919 % 200003 for i in range(200_000))[100_000:100_050]


def test_L4_rows_of_one_hash_stay_apart(spark, monkeypatch):
    from batchwright.operators import position

    monkeypatch.setattr(position, "content_hash", lambda df: F.lit(7).cast("bigint"))
    df = spark.range(0, 200, 1, 3).selectExpr("id", "'x' AS t")
    pages = [position.rows_between(df, ["t"], skip, 50).collect() for skip in (0, 50, 100, 150)]
    assert sorted(r.id for page in pages for r in page) == list(range(200))


def test_paths_are_on_the_default_file_system(spark):
    from batchwright.storage import qualified

    assert qualified(spark, "/a/b") == "/a/b" and qualified(spark, "s3a://x/y") == "s3a://x/y"
    hadoop = spark._jsc.hadoopConfiguration()
    before = hadoop.get("fs.defaultFS")
    hadoop.set("fs.defaultFS", "viewfs:///")
    hadoop.set("fs.viewfs.mounttable.default.link./a", "file:///tmp")
    try:
        assert qualified(spark, "/a/b").startswith("viewfs:/")
    finally:
        hadoop.set("fs.defaultFS", before)
