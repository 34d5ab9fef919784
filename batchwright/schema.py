"""Declared table schemas: registry, type map and table creation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchwright import storage
from batchwright.errors import SchemaNotFound, SchemaValidation
from batchwright.segments import read_segments, segments

#: A table whose folder has this file takes appends as plain files, for readers that know no manifest.
PLAIN_MARK = "_plain"

# Column types by declared database type; any other name is text.
DB_TYPES = {
    "BIGINT": T.LongType(),
    "DOUBLE": T.DoubleType(),
    "TIMESTAMP": T.TimestampNTZType(),
    "VARCHAR": T.StringType(),
}


def spark_type(db_type: str) -> T.DataType:
    """Spark type for a declared database type; unknown types are strings."""
    return DB_TYPES.get(db_type, T.StringType())


@dataclass(frozen=True)
class Property:
    name: str
    type: str = "string"
    db_type: str = "VARCHAR"
    required: bool = False
    primary_key: bool = False
    default: object = None


@dataclass(frozen=True)
class TableSchema:
    name: str
    properties: tuple[Property, ...]
    primary_key: tuple[str, ...] = ()
    table_name: str = ""
    description: str = ""

    def __post_init__(self):
        names = self.names
        if len(set(names)) != len(names):
            raise SchemaValidation(f"schema '{self.name}' declares a column twice")
        missing = [k for k in self.primary_key if k not in names]
        if missing:
            raise SchemaValidation(f"schema '{self.name}': key columns not declared: {missing}")

    @property
    def names(self) -> list[str]:
        return [p.name for p in self.properties]

    def to_struct(self) -> T.StructType:
        """Columns in declaration order. Only key columns are NOT NULL: `required`
        is a validation rule, not a storage constraint, and travels as metadata."""
        return T.StructType(
            [
                T.StructField(
                    p.name,
                    spark_type(p.db_type),
                    nullable=p.name not in self.primary_key,
                    metadata={"required": p.required, "primary_key": p.name in self.primary_key},
                )
                for p in self.properties
            ]
        )

    def ddl(self) -> str:
        """Quoted column list, for CREATE TABLE."""
        return ", ".join(f"`{p.name}` {spark_type(p.db_type).simpleString()}" for p in self.properties)


def define(
    name: str,
    columns: Sequence[tuple],
    primary_key: Sequence[str],
    table_name: str,
    description: str,
) -> TableSchema:
    """Build a schema from (name, type, db_type) rows; key columns are required."""
    properties = tuple(
        Property(col, kind, db, required=col in primary_key or "required" in flags, primary_key=col in primary_key)
        for col, kind, db, *flags in columns
    )
    return TableSchema(name, properties, tuple(primary_key), table_name, description)


# The two declared schemas.
REGISTRY: dict[str, TableSchema] = {
    "fields_aliases": define(
        "fields_aliases",
        [
            ("field_code", "integer", "BIGINT"),
            ("field_name", "string", "VARCHAR", "required"),
        ],
        ["field_code"],
        "fields_prices",
        "Field codes and their names",
    ),
    "well_production": define(
        "well_production",
        [
            ("field_code", "integer", "BIGINT"),
            ("field_name", "string", "VARCHAR"),
            ("well_code", "integer", "BIGINT"),
            ("well_reference", "string", "VARCHAR"),
            ("well_name", "string", "VARCHAR"),
            ("production_period", "string", "TIMESTAMP"),
            ("days_on_production", "integer", "BIGINT"),
            ("oil_production_kbd", "number", "DOUBLE"),
            ("gas_production_mmcfd", "number", "DOUBLE"),
            ("liquids_production_kbd", "number", "DOUBLE"),
            ("water_production_kbd", "number", "DOUBLE"),
            ("data_source", "string", "VARCHAR"),
            ("source_data", "string", "VARCHAR"),
            ("partition_0", "string", "VARCHAR"),
        ],
        ["field_code", "well_code", "production_period"],
        "well_production",
        "Production volumes per well and period",
    ),
}


def register_schema(schema: TableSchema) -> TableSchema:
    REGISTRY[schema.name] = schema
    return schema


def get_schema(name: str) -> TableSchema:
    if name not in REGISTRY:
        raise SchemaNotFound(f"schema '{name}' not found")
    return REGISTRY[name]


def empty_frame(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """No rows of that schema, known to the optimizer to be none."""
    columns = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    return spark.range(1).filter(F.lit(False)).select(*columns)


def create_table(
    spark: SparkSession,
    schema: TableSchema,
    path: str,
    catalog_name: str | None = None,
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Create an empty keyed table at `path` and return it.

    With `catalog_name` the directory is also declared in the catalog, and stays a plain
    one that the catalog can read: appends add files to it, without segments. Spark has
    no enforced PRIMARY KEY for Parquet; the key is recorded as a table property and
    enforced by `bulk_append`.
    """
    writer = empty_frame(spark, schema.to_struct()).write.mode("errorifexists")
    writer.partitionBy(*partition_by).parquet(path)
    if catalog_name:
        storage.publish_text(spark, f"{path.rstrip('/')}/{PLAIN_MARK}", "")
        clause = f" PARTITIONED BY ({', '.join(f'`{c}`' for c in partition_by)})" if partition_by else ""
        spark.sql(
            f"CREATE TABLE {catalog_name} ({schema.ddl()}) USING parquet{clause} LOCATION '{path}' "
            f"TBLPROPERTIES ('primary_key' = '{','.join(schema.primary_key)}')"
        )
    return read_table(spark, schema, path)


def read_table(spark: SparkSession, schema: TableSchema, path: str) -> DataFrame:
    """Scan a keyed table with its declared schema (no footer inference).

    What is read is the last version that was committed before the call.
    """
    return read_segments(spark, schema.to_struct(), path, segments(spark, path))
