"""Normalising and validating JSON records held as VARIANT."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchwright.errors import EmptyInput, InvalidData, SchemaValidation
from batchwright.schema import TableSchema
from batchwright.sources.envelope import field, typed


@dataclass(frozen=True)
class Rule:
    """Output column: the names it may have in a record, best first, and the value it
    takes when none of them is present."""

    column: str
    names: tuple[str, ...]
    type: T.DataType
    default: object = None


# Output columns, accepted names, defaults for absent keys.
WELL_RULES = (
    Rule("field_code", ("field_code",), T.LongType()),
    Rule("field_name", ("_field_name", "field_name"), T.StringType(), ""),
    Rule("well_code", ("well_code",), T.LongType()),
    Rule("well_reference", ("_well_reference", "well_reference"), T.StringType(), ""),
    Rule("well_name", ("well_name",), T.StringType(), ""),
    Rule("production_period", ("production_period",), T.StringType(), ""),
    Rule("days_on_production", ("days_on_production",), T.LongType(), 0),
    Rule("oil_production_kbd", ("oil_production_kbd",), T.DoubleType(), 0.0),
    Rule("gas_production_mmcfd", ("gas_production_mmcfd",), T.DoubleType(), 0.0),
    Rule("liquids_production_kbd", ("liquids_production_kbd",), T.DoubleType(), 0.0),
    Rule("water_production_kbd", ("water_production_kbd",), T.DoubleType(), 0.0),
    Rule("data_source", ("data_source",), T.StringType(), ""),
    Rule("source_data", ("source_data",), T.StringType(), ""),
    Rule("partition_0", ("partition_0",), T.StringType(), "latest"),
)


def _with_fields(df: DataFrame, names: Sequence[str], record: str) -> tuple[DataFrame, dict[str, Column]]:
    """Take each field out of the record once, as a column that later steps share."""
    columns = {n: f"__field_{i}" for i, n in enumerate(dict.fromkeys(names))}
    wide = df.select("*", *[field(F.col(record), n).alias(c) for n, c in columns.items()])
    return wide, {n: F.col(c) for n, c in columns.items()}


def pick(fields: dict[str, Column], rule: Rule) -> Column:
    """First name that is present wins, with an explicit null staying null; the default
    applies only when every name is absent."""
    chosen = F.coalesce(*[fields[n] for n in rule.names])
    return F.when(chosen.isNotNull(), typed(chosen, rule.type, rule.column)).otherwise(F.lit(rule.default).cast(rule.type))


def normalize(df: DataFrame, rules: tuple[Rule, ...] = WELL_RULES, record: str = "record") -> DataFrame:
    """Records to canonical columns; the other columns of `df` are kept in front."""
    kept = [f"`{c}`" for c in df.columns if c != record]
    wide, fields = _with_fields(df, [n for r in rules for n in r.names], record)
    return wide.select(*kept, *[pick(fields, r).alias(r.column) for r in rules])


# Names used in type messages, by type family.
TYPE_NAMES = {
    "BIGINT": "int",
    "STRING": "str",
    "BOOLEAN": "bool",
    "DOUBLE": "float",
    "FLOAT": "float",
    "VOID": "NoneType",
    "DECIMAL": "float",
    "ARRAY": "list",
    "OBJECT": "dict",
}

# Type families accepted for a declared type. A boolean counts as a number.
ACCEPTED = {
    "string": ("STRING",),
    "integer": ("BIGINT", "BOOLEAN"),
    "number": ("BIGINT", "BOOLEAN", "DOUBLE", "FLOAT", "DECIMAL"),
    "boolean": ("BOOLEAN",),
    "array": ("ARRAY",),
    "object": ("OBJECT",),
}


def type_family(value: Column) -> Column:
    """BIGINT, STRING, DECIMAL, ARRAY, ... without parameters."""
    return F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)


def _with_error(df: DataFrame, schema: TableSchema, record: str, error: str) -> DataFrame:
    """Add the one message a record is rejected with, or null.

    Required keys that are absent are reported first, all in one message. Otherwise the
    first present field of a wrong type is reported; null has no type that fits.
    """
    unknown = [p.type for p in schema.properties if p.type not in ACCEPTED]
    if unknown:
        raise SchemaValidation(f"schema '{schema.name}' declares unknown types {unknown}")
    wide, fields = _with_fields(df, schema.names, record)
    families = {p.name: f"__family_{i}" for i, p in enumerate(schema.properties)}
    wide = wide.select(*df.columns, *[type_family(fields[n]).alias(c) for n, c in families.items()])

    required = [p.name for p in schema.properties if p.required]
    absent = F.concat_ws(", ", *[F.when(F.col(families[n]).isNull(), F.lit(n)) for n in required])
    messages = [F.when(absent != "", F.concat(F.lit("Missing required fields: "), absent))]
    names = F.create_map(*[F.lit(x) for pair in TYPE_NAMES.items() for x in pair])
    for p in schema.properties:
        family = F.col(families[p.name])
        shown = F.coalesce(names[family], F.lower(family))
        message = F.concat(F.lit(f"Field '{p.name}' expected {p.type}, got "), shown)
        messages.append(F.when(~family.isin(*ACCEPTED[p.type]), message))
    return wide.select(*[f"`{c}`" for c in df.columns], F.coalesce(*messages).alias(error))


def validate(
    df: DataFrame, schema: TableSchema, record: str = "record", mode: str = "mark", error: str = "error"
) -> DataFrame:
    """Check every record against the schema.

    mark   add the column `error`
    good   keep the valid records
    bad    keep the rejected records with their `error`
    raise  fail the job at the first rejected record
    """
    marked = _with_error(df, schema, record, error)
    if mode == "mark":
        return marked
    if mode == "bad":
        return marked.filter(F.col(error).isNotNull())
    if mode == "good":
        return marked.filter(F.col(error).isNull()).drop(error)
    if mode == "raise":
        checked = F.when(F.col(error).isNotNull(), F.raise_error(F.col(error))).otherwise(F.col(record))
        return marked.withColumn(record, checked).drop(error)
    raise InvalidData(f"unknown validation mode '{mode}'")


def as_records(df: DataFrame, record: str = "record") -> DataFrame:
    """Rows of a typed DataFrame as records, so that `validate` can check them."""
    return df.select(F.to_variant_object(F.struct(*[f"`{c}`" for c in df.columns])).alias(record))


def require_rows(df: DataFrame, what: str = "batch") -> DataFrame:
    """Raise EmptyInput when there is nothing to process (V8)."""
    if df.isEmpty():
        raise EmptyInput(f"{what} holds no records")
    return df
