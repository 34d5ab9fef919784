"""Writing, probing and merging the segments of a keyed table.

A segment's files are sorted by key and cut into key ranges. Its zones say for each file which
range of keys it holds and, in a bitmap of key hashes, which keys. A probe for the keys of a
batch reads the zones first: a file is opened only if its range holds a key of the batch and
the bit of that key is set. Appends are merged level by level, FANOUT segments into one, so a
table of n appends has some FANOUT * log(n) segments and a row is rewritten once a level.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchwright import storage
from batchwright.schema import TableSchema, empty_frame
from batchwright.segments import Segment, below, discard, has_plain_files, scan_files, segment_path, zone_path

#: Size of a segment's files, about.
FILE_BYTES = 128 * 1024 * 1024
#: Segments of a level that are merged into one of the next.
FANOUT = 4
#: Bitmap bits for each key of a file: about one key in ten that a file lacks is looked for in vain.
BITS_PER_KEY = 10
#: Bits of one stored bitmap, as Spark's bitmap functions cut them.
BITMAP_BITS = 32768


# -------------------------------------------------------------------- writing


def clustered_by_key(rows: DataFrame, keys: Sequence[str], size: int, partition_by: Sequence[str]) -> DataFrame:
    """Rows in key ranges of about FILE_BYTES, sorted; a batch for one file needs no sample of its keys."""
    columns = [F.col(f"`{c}`") for c in [*partition_by, *[k for k in keys if k not in partition_by]]]
    if not columns:
        return rows
    n = max(1, math.ceil(size / FILE_BYTES))
    spread = rows.coalesce(1) if n == 1 else rows.repartitionByRange(n, *columns)
    return spread.sortWithinPartitions(*columns)


def write_segment(
    rows: DataFrame, path: str, keys: Sequence[str], size: int, level: int = 0, partition_by: Sequence[str] = ()
) -> Segment:
    """Write rows of about `size` bytes as a segment with its zones; it is not part of the table yet."""
    spark = rows.sparkSession
    name = uuid.uuid4().hex
    counted = Observation()
    try:
        out = clustered_by_key(rows, keys, size, partition_by).observe(counted, F.count("*").alias("rows"))
        out.write.partitionBy(*partition_by).parquet(segment_path(path, name))
        n_rows = counted.get["rows"]
        if n_rows and keys:
            write_zones(spark, rows.schema, path, name, keys, n_rows)
    except BaseException:
        discard(spark, path, name)
        raise
    return Segment(name, level, n_rows, storage.total_bytes(spark, segment_path(path, name)))


def _bit(keys: Sequence[str], bits: Column) -> Column:
    """Place of a key in a bitmap of `bits` bits."""
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), bits)


def write_zones(spark: SparkSession, struct: T.StructType, path: str, name: str, keys: Sequence[str], n_rows: int) -> None:
    """For each file of a segment: ranges of the key columns, and its keys as bitmaps (`bucket`, `bitmap`)."""
    kept = T.StructType([struct[k] for k in keys])
    scan = scan_files(spark, struct, path, [segment_path(path, name)])
    files = storage.count_files(spark, segment_path(path, name))
    per_file = max(1, math.ceil(n_rows / max(1, files)))
    bits = BITMAP_BITS * max(1, math.ceil(BITS_PER_KEY * per_file / BITMAP_BITS))
    at = _bit(keys, F.lit(bits))
    place = scan.select(
        F.regexp_extract("_metadata.file_path", f"segment={name}/.*$", 0).alias("file"),
        F.lit(bits).cast("long").alias("bits"), *[f"`{k}`" for k in kept.names], F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit"),
    )
    ranges = [e for i, k in enumerate(keys) for e in (F.min(f"`{k}`").alias(f"lo_{i}"), F.max(f"`{k}`").alias(f"hi_{i}"))]
    zones = place.groupBy("file", "bits", "bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"), F.count("*").alias("rows"), *ranges)
    zones.write.parquet(zone_path(path, name))


def _zone_struct(schema: T.StructType, keys: Sequence[str]) -> T.StructType:
    struct = T.StructType().add("file", "string").add("bits", "long").add("bucket", "long").add("bitmap", "binary").add("rows", "long")
    for i, k in enumerate(keys):
        struct = struct.add(f"lo_{i}", schema[k].dataType).add(f"hi_{i}", schema[k].dataType)
    return struct


def read_zones(spark: SparkSession, schema: T.StructType, path: str, keys: Sequence[str], listed: Sequence[Segment]) -> DataFrame:
    paths = [zone_path(path, s.name) for s in listed if s.rows]
    struct = _zone_struct(schema, keys)
    return spark.read.schema(struct).parquet(*paths) if paths else empty_frame(spark, struct)


# -------------------------------------------------------------------- probing


def files_in_range(zones: DataFrame, keys: Sequence[str], ranges: Sequence[tuple]) -> DataFrame:
    """(file, bits, lo_*, hi_*) of the files whose key ranges meet the given ones."""
    edges = [e for i in range(len(keys)) for e in (F.min(f"lo_{i}").alias(f"lo_{i}"), F.max(f"hi_{i}").alias(f"hi_{i}"))]
    files = zones.groupBy("file", "bits").agg(*edges)
    for i, (low, high) in enumerate(ranges):
        if low is not None:
            files = files.where((F.col(f"hi_{i}") >= low) & (F.col(f"lo_{i}") <= high))
    return files


def files_with_keys(zones: DataFrame, files: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The files that can hold a key of a batch of bounded size: the key is in the file's range and its bit is set.

    The keys are broadcast to the list of files. What comes out are the pairs of a key and a
    file whose range holds it, as many for each key as there are segments.
    """
    wanted = batch.select(*[F.col(f"`{k}`").alias(f"key_{i}") for i, k in enumerate(keys)]).distinct()
    inside = F.lit(True)
    for i in range(len(keys)):
        inside = inside & F.col(f"key_{i}").between(F.col(f"lo_{i}"), F.col(f"hi_{i}"))
    pairs = files.join(F.broadcast(wanted), inside)
    at = _bit([f"key_{i}" for i in range(len(keys))], F.col("bits"))
    asked = pairs.select("file", F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit")).distinct()
    byte = F.conv(F.hex(F.substring("bitmap", (F.shiftright("bit", 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.expr("shiftright(byte, cast(bit % 8 as int)) & 1 = 1")
    return zones.select("file", "bucket", "bitmap").join(asked, ["file", "bucket"]).withColumn("byte", byte).where(is_set).select("file").distinct()


def candidate_keys(
    spark: SparkSession, schema: TableSchema, path: str, listed: Sequence[Segment], ranges: Sequence[tuple], batch: DataFrame | None
) -> tuple[DataFrame, list[str]]:
    """The table's keys out of the files that can share one with a batch, and those files.

    `ranges` are the batch's smallest and largest key parts; `batch` is given if its keys can
    be broadcast, and narrows the files down key by key. The list of files comes to the
    driver, as every list of files to read does.
    """
    keys, struct = list(schema.primary_key), schema.to_struct()
    zones = read_zones(spark, struct, path, keys, listed)
    files = files_in_range(zones, keys, ranges)
    chosen = files_with_keys(zones, files, batch, keys) if batch is not None else files
    names = [r.file for r in chosen.select("file").collect()] if listed else []
    columns = [f"`{k}`" for k in keys]
    parts = []
    if names:
        parts.append(scan_files(spark, struct, path, [below(path, "_segments", n) for n in names]).select(*columns))
    if has_plain_files(spark, path):
        parts.append(spark.read.schema(struct).parquet(path).select(*columns))
    if not parts:
        return empty_frame(spark, T.StructType([struct[k] for k in keys])), []
    return (parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1])), names


# -------------------------------------------------------------------- merging


def merged_levels(
    spark: SparkSession, struct: T.StructType, path: str, keys: Sequence[str], listed: Sequence[Segment], partition_by: Sequence[str] = ()
) -> list[Segment]:
    """Merge FANOUT segments of a level into one of the next, as long as there are so many."""
    listed = list(listed)
    while True:
        levels = {}
        for s in listed:
            levels.setdefault(s.level, []).append(s)
        full = next((group for _, group in sorted(levels.items()) if len(group) >= FANOUT), None)
        if full is None:
            return listed
        rows = scan_files(spark, struct, path, [segment_path(path, s.name) for s in full]).select(*struct.names)
        one = write_segment(rows, path, keys, sum(s.bytes for s in full), full[0].level + 1, partition_by)
        listed = [s for s in listed if s not in full] + [one]
