import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from batchwright import storage
from batchwright.operators.append import bulk_append
from batchwright.plans import streams
from batchwright.plans.appends import EVENTS
from batchwright.schema import read_table
from batchwright.streaming import ingest


@pytest.fixture
def inbox(table, tmp_path):
    path = str(tmp_path / "inbox")
    table("events").repartition(4).write.parquet(path)
    return path


def test_T1_replay_adds_nothing(spark, table, inbox, tmp_path):
    target = str(tmp_path / "events")
    schema = table("events").schema
    for attempt in range(2):
        stream = ingest.read_stream(spark, inbox, schema, max_files=1)
        query = ingest.stream_append(stream, target, EVENTS, checkpoint=str(tmp_path / f"c{attempt}"))
        query.awaitTermination()
        assert rows(read_table(spark, EVENTS, target)) == rows(table("events"))


def test_T1_continues_from_its_checkpoint(spark, table, inbox, tmp_path):
    target, checkpoint = str(tmp_path / "events"), str(tmp_path / "c")
    schema = table("events").schema
    run = lambda: ingest.stream_append(
        ingest.read_stream(spark, inbox, schema), target, EVENTS, checkpoint
    ).awaitTermination()
    run()
    more = table("events").selectExpr("event_id + 100000 AS event_id", "ts", "user_id", "event_type", "value", "props")
    more.write.mode("append").parquet(inbox)
    run()
    assert read_table(spark, EVENTS, target).count() == 2000


def test_T1_prepare_and_existing_rows(spark, table, inbox, tmp_path):
    target = str(tmp_path / "events")
    bulk_append(table("events").filter("event_id < 10"), target, EVENTS)
    stream = ingest.read_stream(spark, inbox, table("events").schema)
    query = ingest.stream_append(stream, target, EVENTS, prepare=lambda b: b.filter("event_type = 'click'"))
    query.awaitTermination()
    want = table("events").filter("event_id < 10 OR event_type = 'click'")
    assert rows(read_table(spark, EVENTS, target)) == rows(want)


@pytest.mark.parametrize("bounded", [False, True])
def test_T4_dedupe(spark, table, inbox, tmp_path, bounded):
    table("events").write.mode("append").parquet(inbox)
    stream = ingest.read_stream(spark, inbox, table("events").schema, max_files=1)
    kept = ingest.stream_dedupe(stream, ["event_id"], *(("ts", "3650 days") if bounded else ()))
    out = str(tmp_path / "out")
    writer = kept.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
    writer.start(out).awaitTermination()
    assert rows(spark.read.parquet(out)) == rows(table("events"))


def test_T2_T3_feed(spark, table, inbox, tmp_path):
    from pyspark.sql import functions as F

    stream = ingest.read_stream(spark, inbox, table("events").schema)
    feed = ingest.stream_filter(stream, F.col("value") > 100, columns=["event_id", "value"])
    out = str(tmp_path / "out")
    feed.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out).awaitTermination()
    assert rows(spark.read.parquet(out)) == rows(table("events").filter("value > 100").select("event_id", "value"))


def test_T4_hot_key_is_thinned_before_the_exchange(spark, setting):
    setting("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    df = spark.range(0, 20_000, 1, 4).selectExpr("if(id % 100 > 0, 7, id) AS k", "if(id % 2 = 0, null, 'a') AS t", "id")
    thin = ingest.first_in_batches(df, ["k", "t"])
    assert thin.where("k = 7").count() <= 2 * 20
    assert rows(thin.select("k", "t").distinct()) == rows(df.select("k", "t").distinct())
    nested = spark.createDataFrame([([1],), ([1],)], "k array<int>")
    assert ingest.first_in_batches(nested, ["k"]).count() == 2


def drained(spark, sdf, out, checkpoint):
    sdf.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(sdf.schema).parquet(out)


def test_T4_first_by_event_time(spark, tmp_path):
    """Told behind the watermark; an earlier row replaces a later one; a key comes back once it is forgotten."""
    inbox, out, schema = str(tmp_path / "inbox"), str(tmp_path / "out"), "k string, ts timestamp_ntz, v bigint"

    def run(*sent):
        data = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m) if m is not None else None, v) for k, m, v in sent]
        spark.createDataFrame(data, schema).repartition(3).write.mode("append").parquet(inbox)
        stream = ingest.read_stream(spark, inbox, spark.createDataFrame([], schema).schema)
        first = ingest.stream_first(stream, ["k"], "ts", "10 minutes", ["v"], keep_ms=30 * 60_000)
        return sorted((r.k or "", r.v) for r in drained(spark, first, out, str(tmp_path / "c")).collect())

    assert run(("a", 5, 1), ("b", 6, 2), ("a", 6, 3), (None, 3, 4), ("n", None, 5)) == []
    assert run(("a", 4, 6), ("b", 6, 1), ("c", 12, 7)) == []
    assert run(("c", 20, 8), ("a", 13, 9)) == [("", 4), ("a", 6), ("b", 1)]
    assert run(("a", 15, 10), ("d", 200, 11)) == [("", 4), ("a", 6), ("b", 1), ("c", 7)]
    assert run(("a", 195, 12), ("d", 400, 13)) == [("", 4), ("a", 6), ("a", 12), ("b", 1), ("c", 7), ("d", 11)]


def test_T1_micro_batches_stay_cheap(spark, tmp_path):
    """Fifty small appends: the segments stay few, and the last appends open no more files than the first ones."""
    from batchwright import segments

    path, most = str(tmp_path / "t"), 0
    events = spark.range(0, 50 * 40).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-01' AS ts", "id % 5 AS user_id", "'e' AS event_type", "1D AS value", "'{}' AS props")
    for i in range(50):
        bulk_append(events.where(f"event_id % 50 = {i}"), path, EVENTS, "name", on_conflict="skip")
        most = max(most, len(segments.segments(spark, path)))
    assert most <= 8 and read_table(spark, EVENTS, path).count() == 2000


@pytest.mark.parametrize("bound", ["ROWS_PER_FILE", "BYTES_PER_FILE"])
@pytest.mark.parametrize("name", ["stream_append", "stream_dedupe", "stream_first", "stream_filtered"])
def test_inbox_files_grow_in_number_not_in_rows(spark, tmp_path, monkeypatch, name, bound):
    """2,000 rows at 100 a file, or at a twentieth of the bytes: 20 files, where four would hold 500 rows each."""
    spark.range(0, 2000, 1, 2).selectExpr(
        "if(id % 10 = 0, null, id div 3) AS l_orderkey", "int(id % 2) AS l_linenumber", "id AS l_partkey"
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(0, 2000, 1, 2).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, id) AS ts", "id % 50 AS user_id", "'e' AS event_type",
        "double(id % 40) AS value", "'{}' AS props",
    ).write.parquet(str(tmp_path / "events.parquet"))
    source = "lineitem" if name == "stream_dedupe" else "events"
    most = 100 if bound == "ROWS_PER_FILE" else -(-storage.total_bytes(spark, str(tmp_path / f"{source}.parquet")) // 20)
    monkeypatch.setattr(streams, bound, most, raising=False)
    monkeypatch.setattr(streams, "scratch_path", lambda _, label: str(tmp_path / label))
    got = getattr(streams, name)(spark, str(tmp_path))
    files = spark.read.parquet(str(tmp_path / "inbox")).groupBy(F.input_file_name()).count().collect()
    assert len(files) == 20 and max(f["count"] for f in files) <= 110
    given = spark.read.parquet(str(tmp_path / f"{source}.parquet"))
    if name == "stream_dedupe":
        assert rows(got) == rows(given.select("l_orderkey", "l_linenumber").distinct())
    elif name == "stream_append":
        assert rows(got) == rows(given)
    elif name == "stream_first":
        assert got.count() > 0 and rows(got) == rows(given.where(f"event_id < {min(50, got.count())}"))
    else:
        assert got.count() > 0 and rows(got.join(given, ["event_id", "user_id", "value"], "left_anti")) == []


def test_T4_dedupe_state_lies_on_disk(spark, setting, tmp_path):
    """The RocksDB store holds the keys; a checkpoint begun with the default store goes on with that one."""
    inbox = str(tmp_path / "inbox")
    setting(ingest.STATE_STORE, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")

    def run(where, numbers, started=None):
        numbers.selectExpr("if(id = 3, null, id) AS k").write.mode("append").parquet(inbox)
        stream = ingest.read_stream(spark, inbox, spark.range(1).selectExpr("id AS k").schema)
        kept = started(stream) if started else ingest.stream_dedupe(stream, ["k"])
        out = kept.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{where}-c"))
        query = out.trigger(availableNow=True).start(str(tmp_path / where))
        query.awaitTermination()
        found = sorted(-1 if r.k is None else r.k for r in spark.read.parquet(str(tmp_path / where)).collect())
        return found, any(k.startswith("rocksdb") for p in query.recentProgress for o in p.stateOperators for k in o.customMetrics)

    assert run("old", spark.range(5), lambda stream: stream.dropDuplicates(["k"])) == ([-1, 0, 1, 2, 4], False)
    assert run("old", spark.range(8)) == ([-1, 0, 1, 2, 4, 5, 6, 7], False)
    assert run("new", spark.range(9)) == ([-1, 0, 1, 2, 4, 5, 6, 7, 8], True)
    assert run("new", spark.range(10)) == ([-1, 0, 1, 2, 4, 5, 6, 7, 8, 9], True)
