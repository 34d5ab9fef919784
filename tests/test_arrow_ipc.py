import datetime as dt
import os

import pyarrow as pa
import pyarrow.feather as feather
import pytest
from conftest import rows
from hypothesis import given
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from batchwright.errors import DatasetNotFound, EmptyInput, InvalidData
from batchwright.sources import arrow_ipc as A
from batchwright.sources.batches import fetch_batches, map_batches, stream_bytes
from batchwright.sources.local import decode_payloads, from_ipc_payload, from_local
from batchwright.sources.parquet import bulk_read


@given(st.lists(st.integers(0, 1000), min_size=1, max_size=30), st.integers(1, 50))
def test_R3_parts_cover_every_row_once(sizes, n):
    total = len(sizes)
    for b, size in enumerate(sizes):
        covered = [r for k in range(n) for r in range(*A.row_range(b, size, total, k, n))]
        assert covered == list(range(size))


@pytest.mark.parametrize("name", ["lineitem", "embeddings", "documents", "events"])
@pytest.mark.parametrize("layout,fmt", [("file", "feather"), ("stream", "arrow_stream")])
def test_W3_W4_R3_R4_round_trip(spark, table, tmp_path, name, layout, fmt):
    source = table(name).repartition(3)
    path = str(tmp_path / "out")
    manifest = A.write_arrow(source, path, layout, rows_per_batch=100, target_bytes=20_000)
    assert manifest.agg(F.sum("rows")).first()[0] == source.count()
    back = bulk_read(spark, path, fmt)
    assert back.schema.simpleString() == source.schema.simpleString()
    assert back.exceptAll(source).isEmpty() and source.exceptAll(back).isEmpty()
    again = A.read_arrow(spark, path, layout, target_bytes=7_000)
    assert again.rdd.getNumPartitions() >= 3
    assert rows(again) == rows(source)
    assert not [f for f in os.listdir(path) if f.startswith("_temporary")]


def test_R3_one_large_batch_is_split_by_rows(spark, tmp_path):
    path = str(tmp_path / "one.feather")
    feather.write_feather(pa.table({"i": range(10_000), "t": ["x" * 20] * 10_000}), path, chunksize=10_000, compression="uncompressed")
    df = A.read_arrow(spark, path, target_bytes=40_000)
    assert df.rdd.getNumPartitions() >= 5
    sizes = [len(p) for p in df.rdd.glom().collect()]
    assert min(sizes) > 0 and sum(sizes) == 10_000
    assert sorted(r.i for r in df.collect()) == list(range(10_000))


def test_R3_foreign_encodings(spark, tmp_path):
    t = pa.table(
        {
            "d": pa.array(["a", "b", "a"]).dictionary_encode(),
            "l": pa.array(["x", None, "z"], pa.large_string()),
            "v": pa.array(["x", None, "z"], pa.string_view()),
            "ts": pa.array([dt.datetime(2024, 1, 1)] * 3, pa.timestamp("ns")),
            "e": pa.array([[1.0], [], None], pa.large_list(pa.float32())),
        }
    )
    path = str(tmp_path / "x.feather")
    with pa.ipc.new_file(path, t.schema) as w:
        w.write_table(t)
    df = bulk_read(spark, path, "feather")
    assert df.schema.simpleString() == "struct<d:string,l:string,v:string,ts:timestamp_ntz,e:array<float>>"
    assert [tuple(r) for r in df.collect()] == [
        ("a", "x", "x", dt.datetime(2024, 1, 1), [1.0]),
        ("b", None, None, dt.datetime(2024, 1, 1), []),
        ("a", "z", "z", dt.datetime(2024, 1, 1), None),
    ]


def test_R3_columns_are_pruned_and_ordered(spark, table, tmp_path):
    path = str(tmp_path / "out")
    A.write_arrow(table("orders"), path)
    df = bulk_read(spark, path, "feather", columns=["o_totalprice", "o_orderkey"])
    assert df.columns == ["o_totalprice", "o_orderkey"]
    assert rows(df) == rows(table("orders").select("o_totalprice", "o_orderkey"))


def test_W3_append_overwrite_and_empty(spark, tmp_path):
    path = str(tmp_path / "out")
    A.write_arrow(spark.range(5), path)
    A.write_arrow(spark.range(5, 8), path)
    assert rows(bulk_read(spark, path, "feather")) == [(i,) for i in range(8)]
    A.write_arrow(spark.range(2), path, mode="overwrite")
    assert rows(bulk_read(spark, path, "feather")) == [(0,), (1,)]
    empty = str(tmp_path / "empty")
    A.write_arrow(spark.range(0), empty)
    assert bulk_read(spark, empty, "feather").count() == 0


def test_W3_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    bad = spark.range(0, 1000, 1, 4).select(F.when(F.col("id") == 900, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(PySparkException):
        A.write_arrow(bad, path)
    assert [f for _, _, files in os.walk(path) for f in files] == []


def test_R1_V4_distinct_errors(spark, tmp_path):
    missing = str(tmp_path / "none")
    for fmt in ("parquet", "feather", "arrow_stream"):
        with pytest.raises(DatasetNotFound, match="wells"):
            bulk_read(spark, missing, fmt, name="wells")
    (tmp_path / "empty.arrow").write_bytes(b"")
    with pytest.raises(EmptyInput, match="No Arrow data provided"):
        bulk_read(spark, str(tmp_path / "empty.arrow"), "feather")
    (tmp_path / "bad.arrow").write_bytes(b"notarrowdata")
    for fmt in ("feather", "arrow_stream"):
        with pytest.raises(InvalidData, match="Invalid Arrow IPC data"):
            bulk_read(spark, str(tmp_path / "bad.arrow"), fmt)
    with pytest.raises(InvalidData):
        bulk_read(spark, missing, "csv")


def payload(table):
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def test_W8_V4_payloads(spark):
    two = pa.table({"id": ["a", "b"], "value": [1, 2]})
    assert rows(from_ipc_payload(spark, payload(two))) == [("a", 1), ("b", 2)]
    with pytest.raises(EmptyInput, match="No Arrow data provided"):
        from_ipc_payload(spark, b"")
    with pytest.raises(InvalidData, match="Invalid Arrow IPC data"):
        from_ipc_payload(spark, b"notarrowdata")
    with pytest.raises(EmptyInput, match="Invalid or empty Arrow table"):
        from_ipc_payload(spark, payload(two.slice(0, 0)))


def test_R6_R7_batches(spark, table):
    orders = table("orders").repartition(3)
    batches = list(fetch_batches(orders, rows=100))
    assert max(b.num_rows for b in batches) <= 100
    assert sum(b.num_rows for b in batches) == orders.count()
    doubled = map_batches(orders.select("o_orderkey"), lambda b: pa.RecordBatch.from_arrays(
        [pa.compute.multiply(b.column(0), 2)], ["k"]), "k bigint", rows=50)
    assert rows(doubled) == rows(orders.select(F.col("o_orderkey") * 2))


def test_W4_stream_bytes(spark, table):
    orders = table("orders").repartition(3)
    body = b"".join(stream_bytes(orders, rows=200))
    decoded = pa.ipc.open_stream(body).read_all()
    assert decoded.num_rows == orders.count()
    assert rows(spark.createDataFrame(decoded)) == rows(orders)
    assert pa.ipc.open_stream(b"".join(stream_bytes(spark.range(0)))).read_all().num_rows == 0


def test_R13_local_inputs(spark):
    import pandas as pd

    want = [(1, "A"), (2, "B"), (3, "C")]
    frame = pd.DataFrame({"col1": [1, 2, 3], "col2": ["A", "B", "C"]})
    for data in (frame.to_dict("records"), frame, pa.Table.from_pandas(frame)):
        assert rows(from_local(spark, data)) == want
    typed = from_local(spark, [{"a": 1}, {"b": "x"}], "a bigint, b string")
    assert rows(typed) == [(1, None), (None, "x")]
    with pytest.raises(InvalidData):
        from_local(spark, [{"a": 1}, {"a": "x"}])


def test_R3_types_that_spark_lacks(spark, tmp_path):
    ns = [1, -1_999, 1_700_000_000_123_456_789]
    table = pa.table({
        "u8": pa.array([0, 255, None], pa.uint8()),
        "u16": pa.array([0, 65535, 1], pa.uint16()),
        "u32": pa.array([0, 2**32 - 1, 1], pa.uint32()),
        "u64": pa.array([0, 2**64 - 1, None], pa.uint64()),
        "f16": pa.array([0.5, -2.0, None], pa.float32()).cast(pa.float16()),
        "d64": pa.array([0, 86_400_000, None], pa.date64()),
        "ns": pa.array(ns, pa.timestamp("ns")),
        "list": pa.array([[1], [255], []], pa.list_(pa.uint8())),
    })
    with pa.ipc.new_file(str(tmp_path / "x.arrow"), table.schema) as writer:
        writer.write_table(table)
    df = A.read_arrow(spark, str(tmp_path))
    kinds = dict(df.dtypes)
    assert [kinds[c] for c in ("u8", "u16", "u32", "u64", "f16", "d64", "list")] == [
        "smallint", "int", "bigint", "decimal(20,0)", "float", "date", "array<smallint>"]
    got = df.collect()
    assert {None if r.u64 is None else int(r.u64) for r in got} == {0, 2**64 - 1, None}
    assert {r.u8 for r in got} == {0, 255, None} and {r.f16 for r in got} == {0.5, -2.0, None}
    assert sorted(r.ns.microsecond for r in got) == [0, 123456, 999999]


def test_R3_filters_skip_batches(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    made = spark.range(0, 10_000, 1, 1).selectExpr("id", "double(id) / 7 AS x", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id) AS ts",
                                                   "format_string('k%05d', id) AS t", "date_add(date'2024-01-01', int(id / 100)) AS d", "if(id < 5000, null, id) AS n")
    A.write_arrow(made, path, rows_per_batch=500)
    cases = {
        "id = 777": 1, "id > 8999": 2, "id >= 9500": 1, "id < 1": 1, "id <= 500": 2, "id IN (3, 4, 9999)": 2, "x BETWEEN 10 AND 20": 1,
        "ts = timestamp_ntz'2024-01-01 00:10:00'": 1, "t > 'k09600'": 1, "d = date'2024-01-02'": 1, "n = 6000": 11, "id > 100000": 0,
        "id > 600 AND t < 'k00700'": 1, "id % 2 = 0": 20, "id = 3 OR x = 4": 20,
    }
    file = next(u for u, _ in A.visible_files(path))
    with pa.OSFile(file) as source:
        schema = pa.ipc.open_file(source).schema
    for text, most in cases.items():
        df = A.read_arrow(spark, path).where(text)
        assert rows(df) == rows(made.where(text)), text
        # The same filters as the plan hands to the reader.
        reader = A.IpcReader(A.ipc_schema(path, "file"), {"path": path})
        simple = {"id = 777": [A.EqualTo(("id",), 777)], "id > 8999": [A.GreaterThan(("id",), 8999)], "id IN (3, 4, 9999)": [A.In(("id",), (3, 4, 9999))],
                  "id > 100000": [A.GreaterThan(("id",), 100000)]}.get(text)
        if simple:
            assert reader.pushFilters(simple) == simple
            assert len(A.batches_to_read(file, schema, reader.filters)) == most


def test_R3_filter_reaches_the_reader(spark, tmp_path):
    """Damaged batches outside the filter are never touched."""
    path = str(tmp_path / "out")
    A.write_arrow(spark.range(0, 4000, 1, 1), path, rows_per_batch=1000)
    file = next(u for u, _ in A.visible_files(path))
    with pa.OSFile(file) as source:
        reader = pa.ipc.open_file(source)
        batches = [reader.get_batch(i) for i in range(4)]
    batches[0] = pa.record_batch([pa.array([-5] * 1000, pa.int64())], schema=batches[0].schema)
    with pa.OSFile(file, "wb") as sink, pa.ipc.new_file(sink, batches[0].schema) as writer:
        for batch in batches:
            writer.write_batch(batch)
    assert A.read_arrow(spark, path).where("id < 0").count() == 0  # by the ranges, no batch has such a row
    assert A.read_arrow(spark, path).where("id % 2 <> 0 AND id < 0 OR id < -1").count() == 1000


def test_W3_only_what_a_manifest_lists_is_read(spark, tmp_path):
    path = str(tmp_path / "out")
    A.write_arrow(spark.range(5).coalesce(1), path)
    stray = next(u for u, _ in A.visible_files(path))
    other = f"{path}/write-{'0' * 32}/{'1' * 32}.arrow"  # a write that was never published
    again = f"{os.path.dirname(stray)}/{'2' * 32}.arrow"  # an attempt whose twin was committed
    os.makedirs(os.path.dirname(other))
    for name in (other, again):
        with open(stray, "rb") as a, open(name, "wb") as b:
            b.write(a.read())
    assert bulk_read(spark, path, "feather").count() == 5
    with open(stray, "rb") as a, open(f"{path}/foreign.feather", "wb") as b:
        b.write(a.read())
    assert bulk_read(spark, path, "feather").count() == 10
    assert bulk_read(spark, f"{path}/foreign.feather", "feather").count() == 5


def test_W3_no_file_is_moved_but_the_manifest(spark, tmp_path, monkeypatch):
    moved = []

    class Counting:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def move(self, a, b):
            moved.append(b)
            self.fs.move(a, b)

    real = A.filesystem
    path = str(tmp_path / "out")
    schema = spark.range(1).schema
    os.makedirs(A.job_folder(path, "a" * 32))
    writer = A.IpcWriter(schema, {"path": path, "job": "a" * 32, "targetbytes": 1, "rowsperbatch": 1}, False)
    messages = [writer.write(iter([pa.record_batch([pa.array(range(100), pa.int64())], schema=writer.schema)])) for _ in range(10)]
    assert A.visible_files(path) == []
    monkeypatch.setattr(A, "filesystem", lambda p: (Counting(real(p)[0]), real(p)[1]))
    writer.commit(messages)
    assert moved == [f"{path}/_manifest-{'a' * 32}.json"]
    monkeypatch.undo()
    assert len(A.visible_files(path)) == 1000


def test_V4_many_payloads(spark):
    def body(n, dictionary=False):
        t = pa.table({"t": pa.array([f"x{i}" for i in range(n)]), "a": pa.array(range(n), pa.int32()), "more": pa.array([1.5] * n)})
        t = t.set_column(0, "t", t["t"].dictionary_encode()) if dictionary else t
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema) as writer:
            writer.write_table(t, max_chunksize=2)
        return sink.getvalue().to_pybytes()

    lacking = pa.BufferOutputStream()
    with pa.ipc.new_stream(lacking, pa.schema([("a", pa.int64())])) as writer:
        writer.write_batch(pa.record_batch([pa.array([1], pa.int64())], names=["a"]))
    rows_ = [(1, body(3)), (2, b""), (3, None), (4, body(3)[:-30]), (5, b"not arrow at all"), (6, body(0)), (7, body(2, True)), (8, lacking.getvalue().to_pybytes())]
    df = spark.createDataFrame(rows_, "id int, body binary").repartition(3)
    got = rows(decode_payloads(df, "body", "a bigint, t string", keep=["id"]))
    assert [r for r in got if r[3] is None] == [(1, 0, "x0", None), (1, 1, "x1", None), (1, 2, "x2", None), (7, 0, "x0", None), (7, 1, "x1", None)]
    assert {r[0]: r[3] for r in got if r[3]} == {2: "No Arrow data provided", 3: "No Arrow data provided", 4: "Invalid Arrow IPC data",
                                                 5: "Invalid Arrow IPC data", 6: "Invalid or empty Arrow table", 8: "Invalid Arrow IPC data"}
