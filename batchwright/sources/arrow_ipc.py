"""Arrow IPC files and streams as a Spark data source.

Reading. An IPC file has an index of its record batches, so one file is cut into ranges
of batches of about `target_bytes` each; a batch larger than that is cut by rows. The
plan needs one directory listing and no footers: a range is "part k of n" and the task
resolves it when it opens the file. An IPC stream has no index and is read by one task,
batch by batch. Small files are packed together.

Filters. Beside each file that is written here lies a small hidden one with the smallest and
largest value of every column in each record batch. Comparisons that Spark pushes down are
held against these, and batches that cannot match are not read; Spark still filters the rest.

Writing. Files get their final, unique names in a folder of the write at once. The manifest of the write is published last
and decides which of them are there: files of a write without a manifest, and those of retried or
speculative attempts that it does not list, are never read. Nothing is moved but the manifest.
Files are closed at about `target_bytes`, which keeps streams short.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.fs import FileSelector, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from batchwright.errors import DatasetNotFound, EmptyInput, InvalidData
from batchwright.storage import data_files, filesystem, qualified

FORMAT = "arrow_ipc"
TARGET_BYTES = 128 * 1024 * 1024
ROWS_PER_BATCH = 65_536
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


# Types that Spark lacks, and the narrowest it has that holds all their values.
WIDER = {
    pa.uint8(): pa.int16(),
    pa.uint16(): pa.int32(),
    pa.uint32(): pa.int64(),
    pa.uint64(): pa.decimal128(20, 0),
    pa.float16(): pa.float32(),
    pa.date64(): pa.date32(),
}


def plain_type(t: pa.DataType) -> pa.DataType:
    """The Arrow type Spark knows for encodings that differ only in layout, and the wider one
    for types it lacks. Timestamps are cut to microseconds, towards zero."""
    if t in WIDER:
        return WIDER[t]
    if pa.types.is_dictionary(t):
        return plain_type(t.value_type)
    if pa.types.is_large_string(t) or pa.types.is_string_view(t):
        return pa.string()
    if pa.types.is_large_binary(t) or pa.types.is_binary_view(t):
        return pa.binary()
    if pa.types.is_list(t) or pa.types.is_large_list(t) or pa.types.is_fixed_size_list(t):
        return pa.list_(plain_type(t.value_type))
    if pa.types.is_struct(t):
        return pa.struct([pa.field(f.name, plain_type(f.type), f.nullable) for f in t])
    if pa.types.is_timestamp(t):
        return pa.timestamp("us", t.tz)
    return t


def plain_schema(schema: pa.Schema) -> pa.Schema:
    return pa.schema([pa.field(f.name, plain_type(f.type), f.nullable) for f in schema])


def open_ipc(source, layout: str, columns: Sequence[str] | None = None):
    """IPC reader over a file object, decoding only `columns`."""
    opener = pa.ipc.open_file if layout == "file" else pa.ipc.open_stream
    if columns is None:
        return opener(source)
    names = opener(source).schema.names
    source.seek(0)
    fields = sorted(names.index(c) for c in columns)
    return opener(source, options=pa.ipc.IpcReadOptions(included_fields=fields))


_OWN_FILE = re.compile(r"/write-([0-9a-f]{32})/([0-9a-f]{32}\.arrows?)$")


def job_folder(path: str, job: str) -> str:
    return f"{path.rstrip('/')}/write-{job}"


def _hidden(path: str, prefix: str) -> list[str]:
    """Hidden files of a kind, directly in a folder."""
    fs, inner = filesystem(path)
    if fs.get_file_info(inner).type != FileType.Directory:
        return []
    return [f.path for f in fs.get_file_info(FileSelector(inner)) if f.base_name.startswith(prefix)]


def visible_files(path: str) -> list[tuple[str, int]]:
    """(uri, bytes) of the files that make up a dataset: those that manifests list, and those written by others."""
    files = data_files(path)
    own = {uri: m.groups() for uri, _ in files if (m := _OWN_FILE.search(uri))}
    if not own or (len(files) == 1 and files[0][0] == path):
        return files
    jobs = {job for job, _ in own.values()}
    fs, _ = filesystem(path)
    listed = set()
    for manifest in _hidden(path, "_manifest-"):
        if manifest.rsplit("_manifest-", 1)[1].removesuffix(".json") in jobs:
            with fs.open_input_stream(manifest) as source:
                listed.update(json.loads(line)["path"].rsplit("/", 1)[1] for line in source.read().splitlines())
    return [f for f in files if f[0] not in own or own[f[0]][1] in listed]


def stats_path(uri: str) -> str:
    """Where the value ranges of a file's batches lie."""
    folder, name = uri.rsplit("/", 1)
    return f"{folder}/_ranges-{name}"


def _ranged(t: pa.DataType) -> bool:
    return (pa.types.is_integer(t) or pa.types.is_floating(t) or pa.types.is_date(t) or pa.types.is_timestamp(t)
            or pa.types.is_string(t) or pa.types.is_decimal(t))


def batch_ranges(batch: pa.RecordBatch) -> list[tuple]:
    """Smallest and largest value of each column that has an order; None where there is no bound.

    A column with NaN has none, as NaN is larger than all numbers in Spark; long texts have none either.
    """
    out = []
    for column in batch.columns:
        low = high = None
        if _ranged(column.type) and column.null_count < len(column):
            found = pc.min_max(column)
            low, high = found["min"], found["max"]
            nan = pa.types.is_floating(column.type) and pc.any(pc.is_nan(column)).as_py()
            if nan or (pa.types.is_string(column.type) and max(len(low.as_py()), len(high.as_py())) > 64):
                low = high = None
        out.append((low, high))
    return out


def ranges_table(schema: pa.Schema, ranges: list[list[tuple]]) -> pa.Table:
    """One row per batch: lo_i and hi_i of each column that can have them."""
    columns = {}
    for i, field in enumerate(schema):
        if _ranged(field.type):
            for k, side in enumerate(("lo", "hi")):
                columns[f"{side}_{i}"] = pa.array([r[i][k].as_py() if r[i][k] is not None else None for r in ranges], field.type)
    return pa.table({"batch": pa.array(range(len(ranges)), pa.int32()), **columns})


def batches_to_read(uri: str, schema: pa.Schema, filters: Sequence[Filter]) -> set[int] | None:
    """Numbers of the batches that can hold a row for all filters; None if nothing is known of the file."""
    if not filters:
        return None
    fs, inner = filesystem(stats_path(uri))
    if fs.get_file_info(inner).type != FileType.File:
        return None
    with fs.open_input_file(inner) as source:
        ranges = pa.ipc.open_file(source).read_all()
    kept = pa.chunked_array([pa.repeat(True, ranges.num_rows)])
    for f in filters:
        i = schema.get_field_index(f.attribute[0])
        if f"lo_{i}" not in ranges.column_names:
            continue
        low, high = ranges[f"lo_{i}"], ranges[f"hi_{i}"]

        def value(v, t=low.type):
            return pa.scalar(v, t)

        try:
            if isinstance(f, EqualTo):
                can = pc.and_(pc.less_equal(low, value(f.value)), pc.greater_equal(high, value(f.value)))
            elif isinstance(f, GreaterThan):
                can = pc.greater(high, value(f.value))
            elif isinstance(f, GreaterThanOrEqual):
                can = pc.greater_equal(high, value(f.value))
            elif isinstance(f, LessThan):
                can = pc.less(low, value(f.value))
            elif isinstance(f, LessThanOrEqual):
                can = pc.less_equal(low, value(f.value))
            else:
                wanted = [value(v) for v in f.value if v is not None]
                can = pa.chunked_array([pa.array([lo is None or any(lo <= w.as_py() <= hi for w in wanted)
                                                  for lo, hi in zip(low.to_pylist(), high.to_pylist())], pa.bool_())])
        except (pa.ArrowException, TypeError, ValueError, OverflowError):
            continue  # a value that the column's type cannot hold decides nothing here
        kept = pc.and_(kept, pc.fill_null(can, True))
    return {b for b, k in zip(ranges["batch"].to_pylist(), kept.to_pylist()) if k}


def ipc_schema(path: str, layout: str, name: str | None = None) -> StructType:
    """Spark schema of the first file at `path`."""
    label = name or path
    files = visible_files(path)
    if not files:
        raise DatasetNotFound(f"no data found for '{label}'")
    uri, size = next(((u, s) for u, s in files if s), files[0])
    if size == 0:
        raise EmptyInput(f"No Arrow data provided: '{label}'")
    fs, inner = filesystem(uri)
    try:
        with fs.open_input_file(inner) as source:
            arrow = open_ipc(source, layout).schema
    except (pa.ArrowInvalid, OSError) as e:
        raise InvalidData(f"Invalid Arrow IPC data: '{label}'") from e
    return from_arrow_schema(plain_schema(arrow), prefer_timestamp_ntz=True)


@dataclass
class Slices(InputPartition):
    """Parts of files read by one task: (uri, k, n) is part k of n."""

    parts: list[tuple[str, int, int]]


def plan_slices(files: Sequence[tuple[str, int]], layout: str, target_bytes: int) -> list[Slices]:
    """Cut large files, pack small ones; about `target_bytes` per task."""
    tasks: list[Slices] = []
    open_parts: list[tuple[str, int, int]] = []
    filled = 0
    for uri, size in files:
        if size == 0:
            continue
        n = math.ceil(size / target_bytes) if layout == "file" else 1
        if n > 1:
            tasks += [Slices([(uri, k, n)]) for k in range(n)]
            continue
        if open_parts and filled + size > target_bytes:
            tasks.append(Slices(open_parts))
            open_parts, filled = [], 0
        open_parts.append((uri, 0, 1))
        filled += size
    if open_parts:
        tasks.append(Slices(open_parts))
    return tasks


def row_range(batch: int, rows: int, batches: int, k: int, n: int) -> tuple[int, int]:
    """Rows of `batch` that belong to part k of n.

    Every batch is n ticks long and every part takes as many ticks as there are batches,
    so the parts cover each row exactly once whatever the batch sizes are.
    """
    low = min(max(k * batches - batch * n, 0), n)
    high = min(max((k + 1) * batches - batch * n, 0), n)
    return rows * low // n, rows * high // n


def read_part(
    uri: str, k: int, n: int, layout: str, columns: Sequence[str], wanted: set[int] | None = None
) -> Iterator[pa.RecordBatch]:
    """Part k of n of a file; only the `wanted` batches, if these are known."""
    if wanted is not None and not wanted:
        return
    fs, inner = filesystem(uri)
    with fs.open_input_file(inner) as source:
        reader = open_ipc(source, layout, columns)
        if layout == "stream":
            yield from reader
            return
        total = reader.num_record_batches
        for b in range(k * total // n, min(math.ceil((k + 1) * total / n), total)):
            if wanted is not None and b not in wanted:
                continue
            batch = reader.get_batch(b)
            low, high = row_range(b, batch.num_rows, total, k, n)
            if high > low:
                yield batch.slice(low, high - low)


class IpcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns = schema.names
        self.target = to_arrow_schema(schema)
        self.path = options["path"]
        self.layout = options.get("layout", "file")
        self.target_bytes = int(options.get("targetbytes", TARGET_BYTES))
        self.filters: list[Filter] = []

    def pushFilters(self, filters):
        """Comparisons with a column narrow down the batches; Spark evaluates all filters on the rest."""
        kinds = (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In)
        self.filters = [f for f in filters if isinstance(f, kinds) and len(f.attribute) == 1]
        return filters

    def partitions(self):
        tasks = plan_slices(visible_files(self.path), self.layout, self.target_bytes)
        return tasks or [Slices([])]

    def _wanted(self, uri: str) -> set[int] | None:
        """Batches to read of a file; its own schema numbers the ranges."""
        if not self.filters or self.layout != "file":
            return None
        fs, inner = filesystem(uri)
        with fs.open_input_file(inner) as source:
            return batches_to_read(uri, open_ipc(source, self.layout).schema, self.filters)

    def read(self, partition: Slices):
        for uri, k, n in partition.parts:
            for batch in read_part(uri, k, n, self.layout, self.columns, self._wanted(uri)):
                for start in range(0, batch.num_rows, ROWS_PER_BATCH):
                    piece = batch.slice(start, ROWS_PER_BATCH)
                    # Only timestamps lose digits here; all other casts are to wider types.
                    arrays = [piece.column(f.name).cast(f.type, safe=False) for f in self.target]
                    yield pa.RecordBatch.from_arrays(arrays, schema=self.target)


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: (path, rows, batches, bytes)."""

    files: list[tuple[str, int, int, int]]


class IpcWriter(DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.schema = to_arrow_schema(schema)
        self.path = options["path"].rstrip("/")
        self.layout = options.get("layout", "file")
        self.target_bytes = int(options.get("targetbytes", TARGET_BYTES))
        self.rows_per_batch = int(options.get("rowsperbatch", ROWS_PER_BATCH))
        self.overwrite = overwrite
        self.job = options["job"]

    def _chunks(self, iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Regroup Spark's batches into batches of `rows_per_batch`."""
        pending: list[pa.RecordBatch] = []
        rows = 0
        for batch in iterator:
            while batch.num_rows:
                taken = batch.slice(0, self.rows_per_batch - rows)
                pending.append(taken)
                rows += taken.num_rows
                batch = batch.slice(taken.num_rows)
                if rows == self.rows_per_batch:
                    yield pa.concat_batches(pending)
                    pending, rows = [], 0
        if rows:
            yield pa.concat_batches(pending)

    def _new_file(self):
        path = f"{job_folder(self.path, self.job)}/{uuid.uuid4().hex}.{'arrow' if self.layout == 'file' else 'arrows'}"
        fs, inner = filesystem(path)
        return path, fs.open_output_stream(inner)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files = []
        writer = None
        new_writer = pa.ipc.new_file if self.layout == "file" else pa.ipc.new_stream
        for batch in self._chunks(iterator):
            if writer is None:
                path, sink = self._new_file()
                writer, rows, ranges = new_writer(sink, self.schema), 0, []
            batch = batch.cast(self.schema)
            writer.write_batch(batch)
            rows += batch.num_rows
            ranges.append(batch_ranges(batch))
            if sink.tell() >= self.target_bytes:
                files.append((path, rows, len(ranges), self._close(writer, sink, path, ranges)))
                writer = None
        if writer is not None:
            files.append((path, rows, len(ranges), self._close(writer, sink, path, ranges)))
        return Written(files)

    def _close(self, writer, sink, path: str, ranges: list[list[tuple]]) -> int:
        writer.close()
        size = sink.tell()
        sink.close()
        if self.layout == "file":
            fs, inner = filesystem(stats_path(path))
            table = ranges_table(self.schema, ranges)
            with fs.open_output_stream(inner) as out, pa.ipc.new_file(out, table.schema) as ranged:
                ranged.write_table(table)
        return size

    def commit(self, messages):
        fs, base = filesystem(self.path)
        old = visible_files(self.path) if self.overwrite else []
        files = [f for m in messages if m is not None for f in m.files]
        if not files:
            path, sink = self._new_file()
            writer = (pa.ipc.new_file if self.layout == "file" else pa.ipc.new_stream)(sink, self.schema)
            files = [(path, 0, 0, self._close(writer, sink, path, []))]
        with fs.open_output_stream(f"{base}/_unpublished-{self.job}.json") as out:
            for path, rows, batches, size in files:
                out.write(json.dumps({"path": path, "rows": rows, "batches": batches, "bytes": size}).encode() + b"\n")
        fs.move(f"{base}/_unpublished-{self.job}.json", f"{base}/_manifest-{self.job}.json")
        listed = {path.rsplit("/", 1)[1] for path, *_ in files}
        self._delete([uri for uri, _ in old] + [uri for uri in self._own_files() if uri.rsplit("/", 1)[1] not in listed])

    def abort(self, messages):
        fs, folder = filesystem(job_folder(self.path, self.job))
        if fs.get_file_info(folder).type == FileType.Directory:
            fs.delete_dir(folder)

    def _own_files(self) -> list[str]:
        return [uri for uri, _ in data_files(job_folder(self.path, self.job))]

    def _delete(self, uris: Sequence[str]) -> None:
        """Files and their ranges."""

        def one(uri):
            for path in (uri, stats_path(uri)):
                fs, inner = filesystem(path)
                if fs.get_file_info(inner).type == FileType.File:
                    fs.delete_file(inner)

        with ThreadPoolExecutor(32) as pool:
            list(pool.map(one, uris))


class ArrowIpcSource(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return ipc_schema(self.options["path"], self.options.get("layout", "file"))

    def reader(self, schema):
        return IpcReader(schema, dict(self.options))

    def writer(self, schema, overwrite):
        return IpcWriter(schema, dict(self.options), overwrite)


def read_arrow(
    spark: SparkSession,
    path: str,
    layout: str = "file",
    columns: Sequence[str] | None = None,
    target_bytes: int = TARGET_BYTES,
    name: str | None = None,
) -> DataFrame:
    """Scan the IPC files or streams at `path`. Catalyst does not prune the columns of this
    scan, so name the wanted `columns` here and only their buffers are read. Filters are
    pushed down to it, for which the session's switch for Python sources is turned on."""
    spark.conf.set(PUSHDOWN, "true")
    name, path = name or path, qualified(spark, path)
    schema = ipc_schema(path, layout, name)
    if columns:
        schema = StructType([schema[c] for c in columns])
    spark.dataSource.register(ArrowIpcSource)
    reader = spark.read.format(FORMAT).schema(schema)
    return reader.option("layout", layout).option("targetBytes", target_bytes).load(path)


def write_arrow(
    df: DataFrame,
    path: str,
    layout: str = "file",
    mode: str = "append",
    target_bytes: int = TARGET_BYTES,
    rows_per_batch: int = ROWS_PER_BATCH,
) -> DataFrame:
    """Write `df` as IPC files or streams and return the manifest of this write
    (path, rows, batches, bytes), one row per file."""
    spark = df.sparkSession
    spark.dataSource.register(ArrowIpcSource)
    path, job = qualified(spark, path), uuid.uuid4().hex
    # Made here and not by the tasks, so that a task which outlives a failed job cannot
    # bring the folder back.
    fs, folder = filesystem(job_folder(path, job))
    fs.create_dir(folder, recursive=True)
    writer = df.write.format(FORMAT).mode(mode).option("layout", layout).option("job", job)
    writer.option("targetBytes", target_bytes).option("rowsPerBatch", rows_per_batch).save(path)
    manifest = filesystem(f"{path.rstrip('/')}/_manifest-{job}.json")[1]
    with fs.open_input_stream(manifest) as source:
        rows = [json.loads(line) for line in source.read().splitlines()]
    return spark.createDataFrame(pa.Table.from_pylist(rows))
