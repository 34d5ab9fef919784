"""Where intermediate tables go, and file listings on whatever storage a path names.

Anything written between two jobs must outlive the executor that wrote it, so it goes
to the shared folder named by `spark.checkpoint.dir`; a session without one uses a folder
below its warehouse, which all its executors reach as well.
"""

from __future__ import annotations

import uuid

from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession

from batchwright.errors import InvalidData


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder, or scratch space below the session's warehouse."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/batchwright-scratch"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_folder(spark)}/batchwright/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Cut lineage: write `df` once as Parquet in the shared folder and read it back.

    Unlike a checkpoint of rows the result stays columnar, so later passes that need
    only the key columns read only those.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: keeps partitioning and row order, survives executor loss."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def _hadoop(spark: SparkSession, path: str):
    """Spark's own file system for a path, and the path in it; one without a scheme is on the default file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def qualified(spark: SparkSession, path: str) -> str:
    """A path without a scheme with that of Spark's default file system; local ones stay as they are."""
    if ":/" in path:
        return path
    fs, place = _hadoop(spark, path)
    full = place.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString()
    return path if full.startswith("file:") else full


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether anything is at `path`, as Spark resolves it."""
    fs, place = _hadoop(spark, path)
    return fs.exists(place)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly in a folder, hidden ones as well; none if there is no such folder."""
    fs, place = _hadoop(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []


def total_bytes(spark: SparkSession, path: str) -> int:
    fs, place = _hadoop(spark, path)
    return fs.getContentSummary(place).getLength()


def count_files(spark: SparkSession, path: str) -> int:
    """Files below a folder that Spark has written, its success mark left out."""
    fs, place = _hadoop(spark, path)
    return max(0, fs.getContentSummary(place).getFileCount() - 1)


def delete(spark: SparkSession, path: str) -> None:
    fs, place = _hadoop(spark, path)
    fs.delete(place, True)


def rename(spark: SparkSession, source: str, target: str) -> None:
    fs, place = _hadoop(spark, source)
    if not fs.rename(place, _hadoop(spark, target)[1]):
        raise InvalidData(f"cannot rename '{source}' to '{target}'")


def read_text(spark: SparkSession, path: str) -> str:
    fs, place = _hadoop(spark, path)
    stream = fs.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def publish_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that is there as a whole or not at all; InvalidData if the name is taken."""
    fs, place = _hadoop(spark, path)
    hidden = spark._jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{uuid.uuid4().hex}")
    stream = fs.create(hidden)
    stream.write(bytearray(text.encode()))
    stream.close()
    if fs.exists(place) or not fs.rename(hidden, place):
        fs.delete(hidden, False)
        raise InvalidData(f"'{path}' has been written by someone else")


def filesystem(path: str) -> tuple[FileSystem, str]:
    """Arrow file system and the path inside it; works on the driver and in tasks."""
    if "://" not in path:
        return LocalFileSystem(), path.removeprefix("file:")
    scheme, rest = path.split("://", 1)
    if scheme in ("s3a", "s3n"):
        path = f"s3://{rest}"
    return FileSystem.from_uri(path)


def exists(path: str) -> bool:
    fs, inner = filesystem(path)
    return fs.get_file_info(inner).type != FileType.NotFound


def data_files(path: str, suffixes: tuple[str, ...] = ()) -> list[tuple[str, int]]:
    """(uri, bytes) of the data files at or below `path`, hidden ones left out."""
    fs, inner = filesystem(path)
    info = fs.get_file_info(inner)
    if info.type == FileType.File:
        return [(path, info.size)]
    if info.type == FileType.NotFound:
        return []
    found = fs.get_file_info(FileSelector(inner, recursive=True))
    base = inner.rstrip("/")
    files = []
    for f in found:
        if f.type != FileType.File:
            continue
        relative = f.path[len(base) + 1 :]
        if any(part[:1] in ("_", ".") for part in relative.split("/")):
            continue
        if suffixes and not f.path.endswith(suffixes):
            continue
        files.append((f"{path.rstrip('/')}/{relative}", f.size))
    return sorted(files)
