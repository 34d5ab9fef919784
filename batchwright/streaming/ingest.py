"""Streams into keyed tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import AtomicType, BooleanType, LongType, StructField, StructType, TimestampNTZType

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

from batchwright import storage
from batchwright.errors import EmptyInput
from batchwright.operators.append import bulk_append
from batchwright.schema import TableSchema


def read_stream(
    spark: SparkSession, path: str, schema: StructType, max_files: int | None = None, fmt: str = "parquet"
) -> DataFrame:
    """New files below `path`, at most `max_files` per micro-batch."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def stream_append(
    sdf: DataFrame,
    path: str,
    schema: TableSchema,
    checkpoint: str | None = None,
    bind_by: str = "name",
    partition_by: Sequence[str] = (),
    prepare: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Append every micro-batch to the keyed table, skipping keys it already holds.

    The table is the only state: nothing grows with the number of keys, and a replayed
    micro-batch finds its keys in the table and adds nothing. Processes what is there and
    ends.
    """

    def one_batch(batch: DataFrame, _epoch: int) -> None:
        rows = prepare(batch) if prepare else batch
        try:
            bulk_append(rows, path, schema, bind_by, on_conflict="skip", partition_by=partition_by)
        except EmptyInput:
            pass

    location = checkpoint or storage.scratch_path(sdf.sparkSession, "stream-checkpoint")
    return sdf.writeStream.foreachBatch(one_batch).option("checkpointLocation", location).trigger(availableNow=True).start()


def first_in_batches(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The first row of each key in every Arrow batch, as the rows come or by the columns of `order`:
    a hot key sends one row a batch to its exchange, not all.

    Keys that Arrow cannot group, such as structs and arrays, leave the rows as they are.
    """
    if not all(isinstance(df.schema[k].dataType, AtomicType) for k in [*keys, *order]):
        return df

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if order:
                batch = batch.take(pc.sort_indices(batch, sort_keys=[(o, "ascending") for o in order]))
            places = pa.table([*(batch.column(k) for k in keys), pa.array(range(batch.num_rows))], names=[*map(str, range(len(keys))), "place"])
            first = places.group_by([str(i) for i in range(len(keys))]).aggregate([("place", "min")])["place_min"]
            yield batch.take(first.combine_chunks().sort())

    return df.mapInArrow(run, df.schema)


def stream_dedupe(
    sdf: DataFrame, keys: Sequence[str], event_time: str | None = None, delay: str | None = None
) -> DataFrame:
    """One row per key (T4). With an event time and a delay, state is dropped once the
    watermark has passed; without them it grows with the number of keys, which suits
    bounded input only. Rows that a batch repeats are dropped before they are exchanged.

    State needs the RocksDB store, which is set for the session: the keys lie on disk, where the
    default store keeps two versions of them in memory."""
    sdf.sparkSession.conf.set(STATE_STORE, ROCKSDB)
    sdf = first_in_batches(sdf, keys)
    if event_time and delay:
        # A watermark needs a timestamp with a zone; a zone-less one is cast for it.
        clock = F.col(event_time)
        if isinstance(sdf.schema[event_time].dataType, TimestampNTZType):
            clock = clock.cast("timestamp")
        timed = sdf.withColumn("__clock", clock).withWatermark("__clock", delay)
        return timed.dropDuplicatesWithinWatermark(list(keys)).drop("__clock")
    return sdf.dropDuplicates(list(keys))


def stream_first(
    sdf: DataFrame, keys: Sequence[str], event_time: str, delay: str, tie: Sequence[str] = (), keep_ms: int = 0
) -> DataFrame:
    """The row of each key with the earliest event time, by `tie` where several have it (T4).

    A row is told once no earlier one can come, which is when the watermark, `delay` behind the
    latest event time seen, has passed it. `keep_ms` later its key is forgotten: until then
    further rows of the key are dropped, and after that they count as a new first. So state is
    one row per key of the last `delay` and `keep_ms`. Rows without an event time are left out.

    Each task sends one row per key and Arrow batch to the exchange. State needs the RocksDB
    store, which is set for the session.
    """
    sdf.sparkSession.conf.set(STATE_STORE, ROCKSDB)
    names, told_schema = sdf.columns, StructType([StructField("told", BooleanType()), StructField("at", LongType()), *sdf.schema])
    clock = F.col(f"`{event_time}`").cast("timestamp")
    timed = sdf.where(F.col(f"`{event_time}`").isNotNull()).withColumns({"__clock": clock, "__at": F.unix_micros(clock)})
    order = ["__at", *tie]
    thin = first_in_batches(timed, keys, order).withWatermark("__clock", delay)

    class FirstByTime(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.first = handle.getValueState("first", told_schema)

        def handleInputRows(self, key, rows, timerValues):
            held = self.first.get() if self.first.exists() else None
            if held is not None and held[0]:
                return iter(())

            def place(row, at):
                return at, [(row[t] is None, row[t]) for t in tie]

            best = None if held is None else dict(zip(names, held[2:]))
            best_at = None if held is None else held[1]
            for row in rows:
                if best is None or place(row, row["__at"]) < place(best, best_at):
                    best, best_at = {n: row[n] for n in names}, row["__at"]
            if best is not None and (held is None or best_at != held[1]):
                if held is not None:
                    self.handle.deleteTimer(held[1] // 1000 + 1)
                self.handle.registerTimer(best_at // 1000 + 1)
            if best is not None:
                self.first.update((False, best_at, *[best[n] for n in names]))
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            held = self.first.get() if self.first.exists() else None
            if held is None or held[0]:
                self.first.clear()
                return iter(())
            if keep_ms > 0:
                self.first.update((True, held[1], *[None] * len(names)))
                self.handle.registerTimer(held[1] // 1000 + 1 + keep_ms)
            else:
                self.first.clear()
            return iter([Row(**dict(zip(names, held[2:])))])

        def close(self):
            pass

    return thin.groupBy(*[f"`{k}`" for k in keys]).transformWithState(FirstByTime(), sdf.schema, "Append", "EventTime")


def stream_filter(sdf: DataFrame, *conditions, columns: Sequence[str] | None = None) -> DataFrame:
    """Filtered and projected feed for a sequential consumer."""
    for c in conditions:
        sdf = sdf.filter(c)
    return sdf.select(*columns) if columns else sdf
