"""Whole ways of JSON records: into a keyed table, and from envelope to clean envelope."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchwright import storage
from batchwright.errors import EmptyInput, SchemaNotFound
from batchwright.operators.append import AppendResult, bulk_append
from batchwright.operators.duplicates import DEFAULT_KEYS, dedupe_first, dedupe_report
from batchwright.operators.records import WELL_RULES, Rule, normalize
from batchwright.schema import get_schema
from batchwright.sinks.files import write_envelope
from batchwright.sources.envelope import Rejects, envelope_fields, field, read_envelope


def load_records(
    spark: SparkSession,
    path: str,
    table: str,
    schema: str = "well_production",
    key: str | None = "value",
    layout: str = "document",
    mode: str = "permissive",
    rules: tuple[Rule, ...] = WELL_RULES,
    on_conflict: str = "skip",
) -> AppendResult:
    """Read, normalise and append records.

    The payload is a bare list (key=None), or the list below `key`, such as `value` of an
    envelope or `data` of a request that names its schema. Nothing to load is EmptyInput.
    A permissive read counts the lines, records or documents it left out as `rejected`, in
    the one pass that stages the batch.
    """
    rejects = Rejects()
    rows = normalize(read_envelope(spark, path, key, layout, mode, rejects=rejects), rules)
    result = bulk_append(rows, table, get_schema(schema), "name", on_conflict, ordinal="ordinal")
    return replace(result, rejected=rejects.count())


def load_request(spark: SparkSession, path: str, tables: str, **options) -> AppendResult:
    """Load a request `{"schema_name": ..., "data": [...]}` into the table of that schema
    below `tables`; all documents at `path` name the same schema."""
    named = read_envelope(spark, path, "data", keep=["schema_name"]).select("schema_name").first()
    if named is None:
        raise EmptyInput(f"'{path}' holds no records")
    if named.schema_name is None:
        raise SchemaNotFound(f"'{path}' names no schema")
    target = f"{tables.rstrip('/')}/{get_schema(named.schema_name).table_name}"
    return load_records(spark, path, target, named.schema_name, "data", **options)


def keyed_records(records: DataFrame, keys: Sequence[str] = DEFAULT_KEYS) -> tuple[DataFrame, list[str]]:
    """Records with one text column per key field, absent and null being the same. Those
    of `keys` that occur in any record are the key; if none does, all fields are (D2), as one
    text column, so records may have any number of differing fields."""
    record = F.col("record")
    occurring = records.agg(*[F.bool_or(field(record, k).isNotNull()).alias(f"k{i}") for i, k in enumerate(keys)]).first()
    chosen = [k for k, found in zip(keys, occurring) if found]
    if not chosen:
        fields = F.try_variant_get(record, "$", "map<string,variant>")
        filled = F.map_filter(fields, lambda _, v: ~F.coalesce(F.is_variant_null(v), F.lit(True)))
        named = F.transform(F.sort_array(F.map_keys(filled)), lambda k: F.struct(k.alias("k"), F.to_json(filled[k]).alias("v")))
        return records.withColumn("__key_0", F.coalesce(F.to_json(named), F.to_json(record))), ["__key_0"]
    text =[F.to_json(field(record, k)) for k in chosen]
    columns = [F.nullif(t, F.lit("null")).alias(f"__key_{i}") for i, t in enumerate(text)]
    return records.select("*", *columns), [f"__key_{i}" for i in range(len(chosen))]


def dedupe_envelope(
    spark: SparkSession,
    source: str,
    target: str,
    keys: Sequence[str] = DEFAULT_KEYS,
    layout: str = "document",
    envelope: dict | None = None,
) -> DataFrame:
    """Write the envelope at `source` without its duplicate records to `target`, the
    other envelope fields unchanged, and return the report (D1-D3, W5).

    The first record per key stays, in the order of the input, with all its fields. The
    documents at `source` are merged, so their other fields must agree, unless the
    `envelope` fields to write are given.
    """
    if envelope is None:
        envelope = envelope_fields(spark, source, layout=layout)
    records = storage.materialize(read_envelope(spark, source, layout=layout, mode="failfast"), "records")
    keyed, columns = keyed_records(records, keys)
    write_envelope(dedupe_first(keyed, columns, ["ordinal"]), target, envelope, record="record")
    return dedupe_report(keyed, columns)
