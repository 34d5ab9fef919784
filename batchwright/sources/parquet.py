"""Columnar scans by path: Parquet, Arrow IPC file and Arrow IPC stream."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchwright.errors import DatasetNotFound, InvalidData, ReadFailed
from batchwright.sources.arrow_ipc import read_arrow


#: Partitions that one statement registers.
STATEMENT_PARTITIONS = 500

# File suffix by format of a named dataset.
SUFFIXES = {"parquet": "parquet", "feather": "feather", "arrow_stream": "arrows"}


def dataset_path(root: str, schema: str, tag: str, fmt: str = "parquet") -> str:
    """Where the dataset of a schema lies: `<root>/<schema>_data_<tag>.<suffix>`, the tag
    naming its size, as in 100K or 1M."""
    if fmt not in SUFFIXES:
        raise InvalidData(f"unknown dataset format '{fmt}'")
    return f"{root.rstrip('/')}/{schema}_data_{tag}.{SUFFIXES[fmt]}"


def bulk_read(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    columns: Sequence[str] | None = None,
    name: str | None = None,
) -> DataFrame:
    """Full scan of a dataset. `fmt` is `parquet`, `feather` or `arrow_stream`.

    Raises DatasetNotFound when nothing is there and ReadFailed when something is there
    but has no readable schema. `columns` only matters for the Arrow formats, whose scan
    Catalyst cannot prune; Parquet is pruned from the query itself.
    """
    label = name or path
    if fmt in ("feather", "arrow_stream"):
        return read_arrow(spark, path, "file" if fmt == "feather" else "stream", columns, name=name)
    if fmt != "parquet":
        raise InvalidData(f"unknown dataset format '{fmt}'")
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise DatasetNotFound(f"no data found for '{label}'") from e
        raise ReadFailed(f"cannot read '{label}'") from e
    except (PySparkException, Py4JJavaError) as e:
        raise ReadFailed(f"cannot read '{label}'") from e
    return df.select(*columns) if columns else df


def parquet_scan(spark: SparkSession, path: str) -> DataFrame:
    """The table function in SQL form (R2)."""
    quoted = path.replace("`", "``")
    return spark.sql(f"SELECT * FROM parquet.`{quoted}`")


def with_row_position(df: DataFrame, name: str = "ordinal") -> DataFrame:
    """Add the input position (file, row in file) of each row of a Parquet scan.

    Must be applied to the scan itself, before any other operator.
    """
    return df.select(
        "*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias(name)
    )


def _without_scheme(uri: str) -> str:
    return re.sub(r"^[A-Za-z0-9+.-]+:(//[^/]*)?", "", uri).rstrip("/")


def partition_directories(spark: SparkSession, path: str, names: Sequence[str], types: dict[str, str]) -> DataFrame:
    """One row per directory of the lowest level: its uri and the value of each level, as text of its type.

    The listing is Spark's own and the paths stay distributed; no file is opened.
    """
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise DatasetNotFound(f"no data found for '{path}'") from e
        raise
    base = re.escape(_without_scheme(path))
    directory = F.regexp_extract("path", f"^(.*?{base}{'/[^/]+' * len(names)})/[^/]", 1)
    below = f"{base}{'/([^/]+)' * len(names)}/[^/]"
    values = [F.regexp_extract("path", below, i + 1).try_cast(types[n]).cast("string").alias(n) for i, n in enumerate(names)]
    found = files.select("path", F.nullif(directory, F.lit("")).alias("directory"), *values)
    odd = found.filter(" OR ".join(f"`{n}` IS NULL" for n in ["directory", *names])).first()
    if odd:
        raise InvalidData(f"'{odd.path}' is not below {len(names)} directories with values of the types {[types[n] for n in names]}")
    return found.drop("path").distinct()


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register_partitions(
    spark: SparkSession, path: str, names: Sequence[str], types: dict[str, str] | None = None, table: str | None = None
) -> DataFrame:
    """Declare a partitioned directory as a catalog table and return it.

    Each directory becomes a partition with its own location, `2015/01` as well as
    `year=2015/month=01`. Any later filter or join on the partition columns then prunes
    directories, whose files are not even listed. `types` declares columns; those of
    `name=value` directories are inferred without it, those of bare ones are bigint. Bare
    directories with other values are InvalidData. The table is called `table`, or gets a new
    name; directories that come later are not seen.
    """
    native = _native_partitions(spark, path, names)
    if native is not None:
        kinds = {n: native.schema[n].dataType.simpleString() for n in names} | (types or {})
        data = [f for f in native.schema if f.name not in names]
        found = []
    else:
        kinds = dict.fromkeys(names, "bigint") | (types or {})
        found = partition_directories(spark, path, names, kinds).collect()  # one row per directory
        if not found:
            raise DatasetNotFound(f"no data found for '{path}'")
        data = spark.read.parquet(found[0].directory).schema
    table = table or f"batchwright_{uuid.uuid4().hex}"
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in data] + [f"`{n}` {kinds[n]}" for n in names]
    parts = ", ".join(f"`{n}`" for n in names)
    spark.sql(f"CREATE TABLE {table} ({', '.join(columns)}) USING parquet PARTITIONED BY ({parts}) LOCATION {_quoted(path)}")
    if native is not None:
        spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
    for start in range(0, len(found), STATEMENT_PARTITIONS):
        added = [
            f"PARTITION ({', '.join(f'`{n}` = {_quoted(r[n])}' for n in names)}) LOCATION {_quoted(r.directory)}"
            for r in found[start : start + STATEMENT_PARTITIONS]
        ]
        spark.sql(f"ALTER TABLE {table} ADD {' '.join(added)}")
    return spark.table(table)


def _native_partitions(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame | None:
    """The dataset by Spark's own discovery of `name=value` directories; None for another layout."""
    try:
        scan = spark.read.option("basePath", path).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise DatasetNotFound(f"no data found for '{path}'") from e
        if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return None
    if not set(names) <= set(scan.columns):
        return None
    whole = [F.col(f"`{n}`").cast("bigint").alias(n) if scan.schema[n].dataType == T.IntegerType() else F.col(f"`{n}`") for n in names]
    return scan.select(*[f"`{c}`" for c in scan.columns if c not in names], *whole)


def read_partitioned(
    spark: SparkSession, path: str, names: Sequence[str], where: str | None = None, types: dict[str, str] | None = None
) -> DataFrame:
    """Dataset laid out as one directory level per name.

    `name=value` directories are found by Spark itself: values are integers, dates or text,
    and nulls are kept. Bare directories such as `2015/01` hold integers. `types` declares
    partition columns as something else, for instance text whose zeros are to stay. `where`
    and later filters prune directories; see `register_partitions`.
    """
    if where is None and types is None:
        scan = _native_partitions(spark, path, names)
        if scan is not None:
            return scan
    scan = register_partitions(spark, path, names, types)
    return scan.filter(where) if where else scan
