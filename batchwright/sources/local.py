"""Rows that already sit in the driver process become a DataFrame."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from batchwright.errors import EmptyInput, InvalidData
from batchwright.sources.arrow_ipc import plain_schema


def from_local(
    spark: SparkSession, data: Sequence[dict] | pd.DataFrame | pa.Table, schema: StructType | str | None = None
) -> DataFrame:
    """List of dicts, pandas frame or Arrow table to DataFrame. Dicts go through Arrow:
    types are inferred from the values, or taken from `schema`, and absent keys are null."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    if isinstance(data, (list, tuple)):
        try:
            data = pa.Table.from_pylist(list(data), schema=to_arrow_schema(schema) if schema else None)
        except (pa.ArrowInvalid, pa.ArrowTypeError) as e:
            raise InvalidData(f"records do not form a table: {e}") from e
    return spark.createDataFrame(data, schema=schema)


def from_ipc_payload(spark: SparkSession, payload: bytes) -> DataFrame:
    """A request body holding one Arrow IPC stream."""
    if not payload:
        raise EmptyInput("No Arrow data provided")
    try:
        table = pa.ipc.open_stream(payload).read_all()
    except (pa.ArrowInvalid, OSError) as e:
        raise InvalidData("Invalid Arrow IPC data") from e
    if table.num_rows == 0:
        raise EmptyInput("Invalid or empty Arrow table")
    return spark.createDataFrame(table.cast(plain_schema(table.schema)))


def decode_payloads(df: DataFrame, payload: str, schema: StructType | str, keep: Sequence[str] = ()) -> DataFrame:
    """The rows of many payloads, each one Arrow IPC stream in a binary column.

    Columns of `schema` and those of `keep`, and `error`: null for the rows of a sound payload.
    A payload that is empty, cannot be read, holds no rows or lacks a column gives one row
    with the error and nothing else, so one bad payload does not stop the others. A payload is
    decoded batch by batch in the task that has it.
    """
    spec = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kept = StructType([df.schema[c] for c in keep])
    out = StructType([*kept.fields, *spec.fields, *StructType.fromDDL("error string").fields])
    target = to_arrow_schema(out)

    def rejected(held: pa.RecordBatch, message: str) -> pa.RecordBatch:
        nulls = [pa.nulls(1, target.field(f.name).type) for f in spec]
        return pa.RecordBatch.from_arrays([*held.columns[:-1], *nulls, pa.array([message])], schema=target)

    def decoded(held: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        body = held.column(len(kept)).to_pylist()[0]
        if not body:
            yield rejected(held, "No Arrow data provided")
            return
        found, rows = [], 0
        try:
            for batch in pa.ipc.open_stream(body):
                columns = [batch.column(f.name).cast(target.field(f.name).type) for f in spec]
                labels = [pa.repeat(c[0], batch.num_rows) for c in held.columns[:-1]]
                found.append(pa.RecordBatch.from_arrays([*labels, *columns, pa.nulls(batch.num_rows, pa.string())], schema=target))
                rows += batch.num_rows
        except (pa.ArrowException, OSError, KeyError):
            yield rejected(held, "Invalid Arrow IPC data")
            return
        if rows:
            yield from found
        else:
            yield rejected(held, "Invalid or empty Arrow table")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from decoded(batch.slice(i, 1))

    return df.select(*[f"`{c}`" for c in keep], f"`{payload}`").mapInArrow(run, out)
