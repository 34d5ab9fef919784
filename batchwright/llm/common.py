"""Column selection and small Arrow helpers shared by the text operators."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the documents table, in order.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def whole_text(name: str = "text") -> Column:
    """The text as it stands; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def ids_and_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text) only: other columns of the input, whatever their names, go no further."""
    return docs.select("doc_id", whole_text().alias("text"))


#: Bytes of a record batch that become Python values together.
PIECE_BYTES = 1 << 23


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about PIECE_BYTES; nothing for an empty batch."""
    parts = max(1, -(-batch.nbytes // PIECE_BYTES))
    rows = max(1, -(-batch.num_rows // parts))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def map_batches(df: DataFrame, fn: Callable[[dict[str, list]], Iterable[dict[str, list]] | dict[str, list]],
                schema: str) -> DataFrame:
    """Run `fn` over Arrow batches as plain lists of Python values, one task per input partition.

    `fn` gets {column: list} and returns {column: list}, of about PIECE_BYTES or one row at a
    time, so a task's memory grows neither with its partition nor with the rows of a batch.
    """
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    spec = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(spec)
        for batch in batches:
            for piece in pieces(batch):
                got = fn(piece.to_pydict())
                for out in [got] if isinstance(got, dict) else got:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(out[f.name], type=f.type) for f in target], schema=target
                    )

    return df.mapInArrow(run, spec)


def slices(texts: list[str], budget: int) -> Iterator[tuple[int, int]]:
    """Consecutive (start, end) ranges of `texts` of at most `budget` characters, one text at least."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > budget:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def send(spark: SparkSession, model):
    """Broadcast a fitted model of bounded size; its classes travel with it."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(model))


_received: dict[int, object] = {}


def received(sent, build: Callable):
    """`build(model)` for a broadcast model, made once for a task and kept between its batches."""
    key = zlib.crc32(sent.value)
    if key not in _received:
        _received.clear()
        _received[key] = build(pickle.loads(sent.value))
    return _received[key]
