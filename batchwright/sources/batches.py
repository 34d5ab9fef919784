"""Record-batch streams over a query.

Work on batches stays on the executors (`map_batches`). A client that has to see the
rows itself takes `fetch_batches` or `stream_bytes`, which hold one partition at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from batchwright.sources.arrow_ipc import ROWS_PER_BATCH


def map_batches(
    df: DataFrame,
    fn: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None,
    schema: StructType | str | None = None,
    rows: int = ROWS_PER_BATCH,
) -> DataFrame:
    """Apply `fn` to every record batch of at most `rows` rows, one batch in memory. Without
    `fn` the frame is returned as it is: nothing is sent to Python and back."""
    if fn is None:
        return df

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                piece = batch.slice(start, rows)
                yield fn(piece)

    return df.mapInArrow(run, schema or df.schema)


def fetch_batches(df: DataFrame, rows: int = ROWS_PER_BATCH) -> Iterator[pa.RecordBatch]:
    """Pull a query's result batch by batch; the next partition is prefetched."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as writer:
                    writer.write_batch(batch.slice(start, rows))
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()])], ["ipc"])

    for row in df.mapInArrow(encode, "ipc binary").toLocalIterator(prefetchPartitions=True):
        yield from pa.ipc.open_stream(bytes(row.ipc))


def stream_bytes(df: DataFrame, rows: int = ROWS_PER_BATCH) -> Iterator[bytes]:
    """A query's result as the chunks of one Arrow IPC stream (W4), for a response body."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(df.schema)
    sink = _Chunk()
    with pa.ipc.new_stream(sink, schema) as writer:
        for batch in fetch_batches(df, rows):
            writer.write_batch(batch.cast(schema))
            yield sink.take()
    yield sink.take()


class _Chunk:
    """File-like object that hands over what was written since the last call."""

    closed = False

    def __init__(self):
        self._parts: list[bytes] = []

    def write(self, data) -> int:
        self._parts.append(bytes(data))
        return len(data)

    def flush(self) -> None:
        pass

    def close(self) -> None:
        pass

    def take(self) -> bytes:
        parts, self._parts = self._parts, []
        return b"".join(parts)
