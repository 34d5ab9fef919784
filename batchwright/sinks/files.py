"""Parquet and JSON envelope sinks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchwright.errors import InvalidData
from batchwright.functions.scalar import iso_text


def clustered(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Bring the rows of a directory together before a partitioned write, so that not
    every task writes a file into every directory. Rebalancing splits a directory that
    holds most of the rows between several tasks."""
    return df.hint("rebalance", *[F.col(f"`{c}`") for c in partition_by]) if partition_by else df


def write_parquet(
    df: DataFrame,
    path: str,
    codec: str | None = None,
    level: int | None = None,
    mode: str = "errorifexists",
    partition_by: Sequence[str] = (),
) -> None:
    """Parquet with the session's codec, or with `codec` and, for zstd, `level`."""
    writer = clustered(df, partition_by).write.mode(mode).partitionBy(*partition_by)
    if codec:
        writer = writer.option("compression", codec)
    if level is not None:
        if codec != "zstd":
            raise InvalidData("a compression level is only defined for zstd")
        writer = writer.option("parquet.compression.codec.zstd.level", level)
    writer.parquet(path)


def _json_ready(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.TimestampNTZType):
        fraction = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
        whole = F.date_format(column, "SSSSSS") == "000000"
        column = F.when(whole, iso_text(column)).otherwise(fraction)
    return column.alias(field.name)


NESTED = (T.StructType, T.ArrayType, T.MapType, T.VariantType)


def _flat_indented(pretty: Column, margin: str) -> Column:
    """A record as `to_json` prints it over several lines, as `indented` would: no space before colons, and a margin."""
    colons = F.regexp_replace(pretty, r'(?m)^(  "(?:[^"\\]|\\.)*+") : ', "$1: ")
    return F.concat(F.lit(margin), F.replace(colons, F.lit("\n"), F.lit(f"\n{margin}")))


_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[][{},:]|[^][{},:"\s]+')


def indented(text: str, margin: str) -> str:
    """JSON text on lines of its own, two spaces a level; strings and numbers stay as written."""
    out: list[str] = []
    depth, before = 0, ""
    for token in _TOKEN.findall(text):
        if token in "]}" and before not in "[{":
            out.append("\n" + margin + "  " * (depth - 1))
        elif before and before in "[{," and token not in "]}":
            out.append("\n" + margin + "  " * depth)
        depth += (token in "[{") - (token in "]}")
        out.append(": " if token == ":" else token)
        before = token
    return "".join(out)


def write_envelope(
    df: DataFrame,
    path: str,
    envelope: dict | None = None,
    key: str = "value",
    mode: str = "errorifexists",
    indent: bool = False,
    record: str | None = None,
) -> None:
    """Write one envelope document per partition: the other envelope fields, then `key`
    with one record per line. Text stays UTF-8, null fields stay present.

    Each file is a complete JSON document for any reader, and because records sit on
    lines of their own `read_envelope(layout="lines")` splits files of any size. With
    `indent` the documents are pretty-printed, for `layout="indented"`. A record is made of
    all columns, or is the VARIANT column `record` as it was read.
    """
    # Flat records are indented by column expressions, others token by token in the tasks.
    flat = not record and not any(isinstance(f.dataType, NESTED) for f in df.schema)
    if record:
        lines = df.select(F.to_json(record).alias("value"))
    else:
        fields = F.struct(*[_json_ready(f) for f in df.schema])
        text = F.to_json(fields, {"ignoreNullFields": "false", "pretty": str(indent and flat).lower()})
        lines = df.select((_flat_indented(text, "    ") if indent and flat else text).alias("value"))
    fields = [f"{json.dumps(k)}: {json.dumps(v, ensure_ascii=False)}" for k, v in (envelope or {}).items()]
    separator = ",\n  " if indent else ", "
    head = ("{\n  " if indent else "{") + separator.join([*fields, json.dumps(key) + ": ["])
    end = "  ]\n}" if indent else "]}"

    def shown(text: str) -> str:
        return "    " + indented(text, "    ") if indent and not flat else text

    def frame(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Add the head, the commas and the tail; holds back one record at a time."""
        last = None
        for batch in batches:
            records = [shown(t) for t in batch.column(0).to_pylist()]
            if not records:
                continue
            done = [head] if last is None else [last + ","]
            done += [r + "," for r in records[:-1]]
            last = records[-1]
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["value"])
        tail = [head if last is None else last, end]
        yield pa.RecordBatch.from_arrays([pa.array(tail, pa.string())], ["value"])

    lines.mapInArrow(frame, "value string").write.mode(mode).text(path)

