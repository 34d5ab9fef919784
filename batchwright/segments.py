"""Segments of a keyed table and the manifest that decides what is visible.

    <table>/_segments/segment=<id>/...   Parquet files of one append or merge, clustered by key
    <table>/_zones/segment=<id>/...      for each of these files: key ranges and key bitmaps
    <table>/_manifest/<version>.json     the segments that make up the table

A segment is written under its final name and belongs to the table once a manifest names it.
Nothing is moved, and what an abandoned write leaves behind is never read. The manifest lists
segments, not files: appends are merged level by level, so there are few of them.

Parquet files that lie in the table's folder itself, written by other means, belong to the table
as well.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from batchwright import storage


@dataclass(frozen=True)
class Segment:
    name: str
    level: int
    rows: int
    bytes: int


def below(path: str, *parts: str) -> str:
    return "/".join([path.rstrip("/"), *parts])


def segment_path(path: str, name: str) -> str:
    return below(path, "_segments", f"segment={name}")


def zone_path(path: str, name: str) -> str:
    return below(path, "_zones", f"segment={name}")


def discard(spark: SparkSession, path: str, name: str) -> None:
    """Delete a segment that is not, or no longer, part of the table."""
    storage.delete(spark, segment_path(path, name))
    storage.delete(spark, zone_path(path, name))


# ------------------------------------------------------------------- manifest


def versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions of the table, oldest first; a folder without a manifest has none."""
    names = storage.list_names(spark, below(path, "_manifest"))
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")


def segments(spark: SparkSession, path: str, version: int | None = None) -> list[Segment]:
    """Segments of a version, by default the last one."""
    if version is None:
        known = versions(spark, path)
        if not known:
            return []
        version = known[-1]
    text = storage.read_text(spark, below(path, "_manifest", f"{version:012d}.json"))
    return [Segment(**s) for s in json.loads(text)["segments"]]


def commit(spark: SparkSession, path: str, listed: Sequence[Segment], after: int) -> None:
    """Make these segments the table. Fails if another writer has committed since version `after`."""
    text = json.dumps({"segments": [asdict(s) for s in listed]})
    storage.publish_text(spark, below(path, "_manifest", f"{after + 1:012d}.json"), text)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete segments that none of the last `keep` versions names, and older manifests; returns how many segments went.

    Not to be run while an append is under way or a reader still uses an older version.
    """
    known = versions(spark, path)
    live = {s.name for v in known[-keep:] for s in segments(spark, path, v)}
    gone = 0
    for name in storage.list_names(spark, below(path, "_segments")):
        if name.removeprefix("segment=") not in live:
            discard(spark, path, name.removeprefix("segment="))
            gone += 1
    for v in known[:-keep]:
        storage.delete(spark, below(path, "_manifest", f"{v:012d}.json"))
    return gone


# -------------------------------------------------------------------- reading


def scan_files(spark: SparkSession, struct: T.StructType, path: str, files: Sequence[str]) -> DataFrame:
    return spark.read.schema(struct).option("basePath", below(path, "_segments")).parquet(*files)


def has_plain_files(spark: SparkSession, path: str) -> bool:
    return any(n[0] not in "._" for n in storage.list_names(spark, path))


def read_segments(spark: SparkSession, struct: T.StructType, path: str, listed: Sequence[Segment]) -> DataFrame:
    """Rows of the segments and of the files in the table's folder itself."""
    parts = []
    if listed:
        parts.append(scan_files(spark, struct, path, [segment_path(path, s.name) for s in listed]).select(*struct.names))
    if not listed or has_plain_files(spark, path):
        parts.append(spark.read.schema(struct).parquet(path).select(*struct.names))
    return parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1])
