"""Binding a batch to a declared schema: names or positions, and explicit casts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchwright.errors import SchemaValidation
from batchwright.schema import TableSchema


def to_bigint(value: Column, source: T.DataType) -> Column:
    """Number or text as BIGINT, rounded rather than truncated: doubles to the even
    neighbour at a tie, decimals and decimal text away from zero."""
    if isinstance(source, (T.DoubleType, T.FloatType)):
        return F.rint(value).try_cast("bigint")
    if isinstance(source, T.StringType):
        exact = F.trim(value).try_cast("bigint")
        return F.coalesce(exact, F.round(F.trim(value).try_cast("decimal(38,18)"), 0).try_cast("bigint"))
    if isinstance(source, T.DecimalType):
        return F.round(value, 0).try_cast("bigint")
    return value.try_cast("bigint")


def checked_cast(name: str, value: Column, source: T.DataType, target: T.DataType) -> Column:
    """Cast that fails the job on a value it cannot convert, whatever the session's ANSI
    setting; the error names the column."""
    if source == target:
        return value
    cast = to_bigint(value, source) if isinstance(target, T.LongType) else value.try_cast(target)
    message = F.concat(F.lit(f"column '{name}': cannot convert to {target.simpleString()}: "), value.cast("string"))
    return F.coalesce(cast, F.when(value.isNotNull(), F.raise_error(message).cast(target)))


def bind_positions(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rename column i to names[i] (P10)."""
    if len(df.columns) != len(names):
        raise SchemaValidation(f"batch has {len(df.columns)} columns, the table has {len(names)}")
    return df.toDF(*names)


def bind(df: DataFrame, schema: TableSchema, how: str = "position", keep: Sequence[str] = ()) -> DataFrame:
    """Project a batch onto the table's columns and types.

    position  column i of the batch is column i of the table, names are ignored
    name      columns are matched by name; a column the batch lacks is null unless it
              belongs to the key, extra columns are dropped

    Columns in `keep` are not data of the batch; they follow the table's columns.
    """
    kept = [F.col(f"`{c}`").alias(f"__keep_{i}") for i, c in enumerate(keep)]
    data = [c for c in df.columns if c not in keep]
    if how == "position":
        if len(data) != len(schema.names):
            raise SchemaValidation(f"batch has {len(data)} columns, the table has {len(schema.names)}")
        df = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(data, schema.names)], *kept)
    elif how == "name":
        df = df.select(*[f"`{c}`" for c in data], *kept)
    else:
        raise SchemaValidation(f"unknown binding '{how}'")
    have = {f.name: f.dataType for f in df.schema}
    lacking = [k for k in schema.primary_key if k not in have]
    if lacking:
        raise SchemaValidation(f"batch lacks key columns {lacking}")
    columns = []
    for target in schema.to_struct():
        if target.name in have:
            value = checked_cast(target.name, F.col(f"`{target.name}`"), have[target.name], target.dataType)
        else:
            value = F.lit(None).cast(target.dataType)
        columns.append(value.alias(target.name))
    return df.select(*columns, *[F.col(f"__keep_{i}").alias(c) for i, c in enumerate(keep)])


def converted_columns(df: DataFrame, schema: TableSchema, how: str, keep: Sequence[str] = ()) -> list[str]:
    """Table columns that `bind` has to cast for this batch."""
    data = [f for f in df.schema if f.name not in keep]
    names = schema.names if how == "position" else [f.name for f in data]
    have = {n: f.dataType for n, f in zip(names, data)}
    return [t.name for t in schema.to_struct() if t.name in have and have[t.name] != t.dataType]
