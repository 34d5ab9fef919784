"""Streams."""

from batchwright.operators.query import sample_by_digest
from batchwright.plans.appends import EVENTS, KEYS
from batchwright.plans.registry import registered, table
from batchwright.schema import read_table
from batchwright.storage import scratch_path, total_bytes
from batchwright.streaming import ingest

FILES = 4
ROWS_PER_FILE = 1_000_000
BYTES_PER_FILE = 64 << 20


def filled_inbox(spark, sf_dir, name):
    """A table dealt evenly over the files of a new inbox: its path and the number of files that are half of them.

    There are FILES at least, and enough for one to hold ROWS_PER_FILE rows and BYTES_PER_FILE stored
    bytes of the table at most, so the task that writes a file does not grow with the table.
    """
    rows, inbox = table(spark, sf_dir, name), scratch_path(spark, "inbox")
    files = max(FILES, -(-rows.count() // ROWS_PER_FILE), -(-total_bytes(spark, f"{sf_dir}/{name}.parquet") // BYTES_PER_FILE))
    rows.repartition(files).write.parquet(inbox)
    return inbox, -(-files // 2)


@registered("SELECT * FROM events")
def stream_append(spark, sf_dir):
    """Files of events, in micro-batches of half of them each, into a keyed table."""
    events = table(spark, sf_dir, "events")
    inbox, half = filled_inbox(spark, sf_dir, "events")
    target = scratch_path(spark, "events")
    stream = ingest.read_stream(spark, inbox, events.schema, max_files=half)
    ingest.stream_append(stream, target, EVENTS).awaitTermination()
    return read_table(spark, EVENTS, target)


@registered("SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def stream_dedupe(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    inbox, half = filled_inbox(spark, sf_dir, "lineitem")
    kept = ingest.stream_dedupe(ingest.read_stream(spark, inbox, lineitem.schema, max_files=half), KEYS).select(*KEYS)
    out = scratch_path(spark, "lines")
    writer = kept.writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "stream-checkpoint"))
    writer.trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(kept.schema).parquet(out)


@registered(
    """
    SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)
    WHERE rn = 1 AND date_trunc('millisecond', ts) < date_trunc('millisecond', (SELECT max(ts) FROM events)) - INTERVAL 2 DAY
    """
)
def stream_first(spark, sf_dir):
    """Each user's first event, told once the watermark, two days behind, has passed it."""
    events = table(spark, sf_dir, "events")
    inbox, _ = filled_inbox(spark, sf_dir, "events")
    out = scratch_path(spark, "first")
    first = ingest.stream_first(ingest.read_stream(spark, inbox, events.schema), ["user_id"], "ts", "2 days", ["event_id"])
    writer = first.writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "stream-checkpoint"))
    writer.trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(first.schema).parquet(out)


@registered("SELECT event_id, user_id, value FROM events WHERE value > 20 AND md5('5:' || event_id) < '40000000000000000000000000000000'")
def stream_filtered(spark, sf_dir):
    """A live feed, filtered, sampled by digest and cut to three columns, for a consumer that takes it batch by batch."""
    events = table(spark, sf_dir, "events")
    inbox, half = filled_inbox(spark, sf_dir, "events")
    feed = ingest.stream_filter(ingest.read_stream(spark, inbox, events.schema, max_files=half), "value > 20")
    feed = sample_by_digest(feed, ["event_id"], 0.25, 5).select("event_id", "user_id", "value")
    out = scratch_path(spark, "feed")
    writer = feed.writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "stream-checkpoint"))
    writer.trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(feed.schema).parquet(out)
