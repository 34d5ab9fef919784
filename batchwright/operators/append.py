"""Appending batches to a primary-keyed table.

The batch is evaluated once: it is bound, cast and written to a scratch folder, and all that
follows reads it there. Checks run in the order a keyed insert applies them (binding, casts,
NOT NULL, unique in the batch, unique against the table). The rows then become a segment of
the table, sorted by key, which is visible once the table's manifest names it (see
`batchwright.segments`); a rejected batch leaves no file. One writer per table at a time is
assumed, and a second one fails at its commit.

Cost of an append to a table far larger than the batch: the batch, and those files of the
table that can hold one of its keys. Of these only the key columns are read, in the batch's key
ranges, and when the keys of the batch, as measured, fit a broadcast, the table is not shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchwright import storage
from batchwright.errors import EmptyInput, InvalidData, KeyConflict
from batchwright.functions.scalar import literal
from batchwright.operators.binding import bind
from batchwright.operators.duplicates import dedupe_first, duplicate_summary
from batchwright.operators.keyed_table import candidate_keys, merged_levels, write_segment
from batchwright.schema import PLAIN_MARK, TableSchema, get_schema
from batchwright.segments import Segment, commit, discard, segments, versions
from batchwright.sinks.files import clustered

# Keys of a batch up to this size, as measured, are broadcast; larger ones are shuffled.
BROADCAST_KEY_BYTES = 64 * 1024 * 1024
# Batches up to this many rows choose the files to open key by key, larger ones by their ranges.
PROBE_ROWS = 100_000


@dataclass(frozen=True)
class AppendResult:
    """records_processed counts the rows sent; inserted + skipped is the same number.
    `rejected` counts input that could not be read as rows."""

    success: bool
    records_processed: int
    inserted: int
    skipped: int
    rejected: int = 0

    def message(self) -> str:
        return f"{self.inserted} records inserted, {self.skipped} duplicates removed"

    def to_frame(self, spark: SparkSession) -> DataFrame:
        counts = {"records_processed": self.records_processed, "inserted": self.inserted, "skipped": self.skipped}
        columns = [F.lit(n).cast("bigint").alias(c) for c, n in counts.items()]
        return spark.range(1).select(F.lit(self.success).alias("success"), *columns)


def key_profile(df: DataFrame, keys: Sequence[str], converted: Sequence[str] = ()) -> Row:
    """Rows, rows with a null key part, bytes of all keys, and the range of each key
    column: one row per task reaches the final aggregate. Counting the values of the
    `converted` columns makes every cast of the batch run here, ahead of any write."""
    null_key, width, bounds = F.lit(False), F.lit(0), []
    for i, k in enumerate(keys):
        column = F.col(f"`{k}`")
        null_key = null_key | column.isNull()
        width = width + (F.octet_length(column) + 16 if df.schema[k].dataType == T.StringType() else F.lit(16))
        bounds += [F.min(column).alias(f"lo_{i}"), F.max(column).alias(f"hi_{i}")]
    return df.agg(
        F.count("*").alias("rows"),
        F.count_if(null_key).alias("null_keys"),
        F.coalesce(F.sum(width), F.lit(0)).alias("key_bytes"),
        *bounds,
        *[F.count(f"`{c}`").alias(f"values_{i}") for i, c in enumerate(converted)],
    ).first()


def within_profile(target: DataFrame, keys: Sequence[str], profile: Row) -> DataFrame:
    """Rows of the table that can share a key with the batch."""
    for i, k in enumerate(keys):
        low, high = profile[f"lo_{i}"], profile[f"hi_{i}"]
        if low is not None:
            target = target.filter(F.col(f"`{k}`").between(literal(low), literal(high)))
    return target


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a table at `path`, which Spark's own configuration resolves."""
    return storage.path_exists(spark, path)


def shared_keys(batch: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of the table that the batch holds too, for a batch whose keys are known to
    fit a broadcast: they travel to the table's scan and the table is not shuffled."""
    columns = [f"`{k}`" for k in keys]
    return target.select(*columns).join(F.broadcast(batch.select(*columns).distinct()), list(keys), "left_semi")


def key_conflicts(batch: DataFrame, target: DataFrame, keys: Sequence[str], broadcast: bool = False) -> DataFrame:
    """Keys of the batch that break the primary key, with the number of rows that hold
    them on either side (A7 and J2 together).

    Both sides are counted by key in one exchange, after a map-side aggregation.
    """
    columns = [f"`{k}`" for k in keys]
    held = shared_keys(batch, target, keys) if broadcast else target.select(*columns)
    sides = batch.select(*columns, F.lit(1).alias("__new")).unionAll(held.select(*columns, F.lit(0).alias("__new")))
    counted = sides.groupBy(*columns).agg(
        F.sum("__new").alias("rows_in_batch"), F.sum(1 - F.col("__new")).alias("rows_in_table")
    )
    return counted.filter("rows_in_batch > 0 and rows_in_batch + rows_in_table > 1")


def surviving_rows(
    batch: DataFrame, target: DataFrame, keys: Sequence[str], order: Sequence, broadcast: bool = False
) -> DataFrame:
    """First row per key of the batch, without the keys the table already holds.

    Small batch: the keys it shares with the table, which are no more than it has, are
    found without a shuffle of the table and taken out before the batch is deduplicated.

    Large batch: it is deduplicated first, which leaves one row of any hot key, and then
    merged with the table's keys, which are unique as well; the deduplication has already
    partitioned the batch for that join.
    """
    if broadcast:
        fresh = batch.join(F.broadcast(shared_keys(batch, target, keys)), list(keys), "left_anti")
        return dedupe_first(fresh, keys, order)
    first = dedupe_first(batch, keys, order)
    return first.join(target.select(*[f"`{k}`" for k in keys]), list(keys), "left_anti")


def bulk_append(
    df: DataFrame,
    path: str,
    schema: TableSchema | str,
    bind_by: str = "position",
    on_conflict: str = "error",
    ordinal: str | None = None,
    partition_by: Sequence[str] = (),
    deterministic: bool = True,
) -> AppendResult:
    """Append a batch to the keyed table at `path`.

    on_conflict="error"  any broken key rejects the whole batch with KeyConflict
    on_conflict="skip"   the first row per key is kept, keys already in the table are
                         skipped; running it twice with the same batch changes nothing
                         the second time

    "First" is by `ordinal`, a column with the input position that is not itself data, or
    by the values of all columns when the batch has none.

    The batch is evaluated once, so its rows may differ between reads (uuid, now, rand, a
    changing source); `deterministic` is kept for callers that say so. A table declared in
    the catalog takes its rows as plain files, without segments.
    """
    spark = df.sparkSession
    schema = get_schema(schema) if isinstance(schema, str) else schema
    if on_conflict not in ("error", "skip"):
        raise InvalidData(f"unknown conflict mode '{on_conflict}'")
    carried = [ordinal] if ordinal else []
    staging = storage.scratch_path(spark, "batch")
    try:
        return _append_staged(bind(df, schema, bind_by, carried), staging, path, schema, on_conflict, carried, partition_by)
    finally:
        storage.delete(spark, staging)


def _append_staged(
    bound: DataFrame, staging: str, path: str, schema: TableSchema, on_conflict: str, carried: list[str], partition_by: Sequence[str]
) -> AppendResult:
    spark, keys = bound.sparkSession, list(schema.primary_key)
    try:
        bound.write.parquet(staging)
    except (PySparkException, Py4JJavaError) as e:
        raise _as_invalid(e) from e
    batch = spark.read.schema(bound.schema).parquet(staging)
    profile = key_profile(batch, keys)
    if profile["rows"] == 0:
        raise EmptyInput("batch holds no records")
    if profile["null_keys"]:
        raise KeyConflict(f"{profile['null_keys']} rows have a null in the key {keys}")

    plain = storage.path_exists(spark, f"{path.rstrip('/')}/{PLAIN_MARK}")
    known = versions(spark, path)
    listed = segments(spark, path, known[-1]) if known else []
    rows = batch
    if keys:
        small = profile["key_bytes"] <= BROADCAST_KEY_BYTES
        ranges = [(literal(profile[f"lo_{i}"]), literal(profile[f"hi_{i}"])) for i in range(len(keys))]
        probed = batch if profile["rows"] <= PROBE_ROWS else None
        target, _ = candidate_keys(spark, schema, path, listed, ranges, probed)
        target = within_profile(target, keys, profile)
        if on_conflict == "error":
            offender = key_conflicts(batch, target, keys, small).first()
            if offender:
                raise KeyConflict(f"duplicate key {({k: offender[k] for k in keys})}")
        else:
            rows = surviving_rows(batch, target, keys, [f"`{n}`" for n in carried + schema.names], small)

    rows = rows.select(*schema.names)
    if plain:
        counted = Observation()
        out = clustered(rows, partition_by).observe(counted, F.count("*").alias("rows"))
        out.write.mode("append").partitionBy(*partition_by).parquet(path)
        inserted = counted.get["rows"]
    else:
        inserted = _add_segment(rows, path, schema, listed, known[-1] if known else 0, storage.total_bytes(spark, staging), partition_by)
    return AppendResult(True, profile["rows"], inserted, profile["rows"] - inserted)


def _add_segment(
    rows: DataFrame, path: str, schema: TableSchema, listed: Sequence[Segment], version: int, size: int, partition_by: Sequence[str]
) -> int:
    """Write the rows as a segment, merge full levels and commit; nothing stays of a failed attempt."""
    spark, keys = rows.sparkSession, list(schema.primary_key)
    added = write_segment(rows, path, keys, size, 0, partition_by)
    if added.rows == 0 and listed:
        discard(spark, path, added.name)
        return 0
    merged = [added]
    try:
        merged = merged_levels(spark, schema.to_struct(), path, keys, [*listed, added], partition_by)
        commit(spark, path, merged, version)
    except BaseException:
        for s in {added, *merged} - set(listed):
            discard(spark, path, s.name)
        raise
    return added.rows


def _as_invalid(e: Exception) -> Exception:
    """Conversion failures raised inside tasks are data errors; the rest stays as it is."""
    found = re.search(r"column '[^\n]*cannot convert to [^\n]*", str(e))
    return InvalidData(found.group(0)) if found else e


def reconcile(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows written, rows read back, whether they agree (V7)."""
    zero = F.lit(0).cast("bigint")
    written = before.agg(F.count("*").alias("rows_written")).withColumn("rows_read", zero)
    read = after.agg(F.count("*").alias("rows_read")).withColumn("rows_written", zero)
    both = written.unionByName(read).agg(
        F.sum("rows_written").alias("rows_written"), F.sum("rows_read").alias("rows_read")
    )
    return both.withColumn("matches", F.col("rows_written") == F.col("rows_read"))


def reconcile_duplicates(df: DataFrame, keys: Sequence[str], unique: int, duplicates: int) -> DataFrame:
    """One row: expected against actual unique keys and surplus rows (V7)."""
    return duplicate_summary(df, keys).select(
        F.lit(unique).cast("bigint").alias("expected_unique"),
        F.col("unique_records").alias("actual_unique"),
        F.lit(duplicates).cast("bigint").alias("expected_duplicates"),
        F.col("total_duplicates").alias("actual_duplicates"),
        ((F.col("unique_records") == unique) & (F.col("total_duplicates") == duplicates)).alias("matches"),
    )
