"""Numbering the rows of a distributed frame, and cutting pages out of it."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchwright.functions.scalar import literal
from batchwright.storage import checkpoint


def _hashable(name: str, kind: T.DataType) -> Column:
    column = F.col(f"`{name}`")
    if isinstance(kind, T.MapType):
        return F.sort_array(F.map_entries(column))
    return column.cast("string") if isinstance(kind, T.VariantType) else column


def content_hash(df: DataFrame) -> Column:
    """Hash of all columns: orders rows that tie elsewhere, whatever task reads them."""
    return F.xxhash64(*[_hashable(f.name, f.dataType) for f in df.schema])


#: Two hashes of all columns: together they tell rows apart, one alone orders ties.
HASHES = ["__hash", "__check"]


def _with_hashes(df: DataFrame) -> DataFrame:
    check = F.xxhash64(F.lit("check"), *[_hashable(f.name, f.dataType) for f in df.schema])
    return df.withColumns({"__hash": content_hash(df), "__check": check})


def _in_order(df: DataFrame, order: Sequence[str | Column], keep: Sequence[str], name: str) -> DataFrame:
    """The columns of `keep` with the position of each row in (order, hash of all columns).

    A window over the whole frame would sort it in one task. Here the rows are sorted in
    range partitions and checkpointed, which fixes the partitions; a row's position is
    its rank in its partition plus the sizes of the partitions before. Only one count
    per partition is brought together.
    """
    columns = [*[F.col(f"`{o}`") if isinstance(o, str) else o for o in order], *map(F.col, HASHES)]
    ranged = _with_hashes(df).repartitionByRange(*columns).sortWithinPartitions(*columns)
    numbered = checkpoint(ranged.select(*[f"`{c}`" for c in keep])).withColumn("__id", F.monotonically_increasing_id())
    part = F.shiftright("__id", 33)
    sizes = numbered.groupBy(part.alias("__part")).agg(F.count("*").alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
    placed = numbered.withColumn("__part", part).join(F.broadcast(starts), "__part")
    rank = F.col("__id") - F.shiftleft(F.col("__part"), 33)
    return placed.select(*[f"`{c}`" for c in keep], (F.col("__start") + rank).alias(name))


def with_row_position(df: DataFrame, order: Sequence[str | Column], name: str = "position") -> DataFrame:
    """Add the 0-based position of each row in `order`; rows that tie are ordered by a hash of all columns.

    The order does not depend on which task reads a row, so a repeated task cannot lose or
    double rows; rows that are equal in all columns are interchangeable. A value shared by
    many rows is spread over as many ranges as it needs.
    """
    return _in_order(df, order, df.columns, name)


#: Cuts of the first order column that a page is looked for between; a thousandth of the rows lie between two.
CUTS = 1024
_PLAIN_ORDER = re.compile(r"^Column<'`?([^`'()]+?)`? (ASC|DESC) NULLS (FIRST|LAST)'>$")


def _first_column(df: DataFrame, order: Sequence[str | Column]) -> tuple[str, bool, bool] | None:
    """(name, ascending, nulls first) of the first order column; None if it is no plain column that has quantiles."""
    first = order[0] if order else None
    if isinstance(first, Column):
        found = _PLAIN_ORDER.match(str(first))
        name, ascending, nulls_first = (found.group(1), found.group(2) == "ASC", found.group(3) == "FIRST") if found else (None, True, True)
    else:
        name, ascending, nulls_first = first, True, True
    kinds = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)
    if name not in df.columns or not isinstance(df.schema[name].dataType, kinds):
        return None
    return name, ascending, nulls_first


def _near_page(df: DataFrame, order: Sequence[str | Column], skip: int, limit: int) -> tuple[DataFrame, int] | None:
    """The rows whose first order column is near the page's, and how many rows come before these.

    Cuts come from a sketch of that column; how many rows lie before and between two of them is
    then counted exactly. None where the page cannot be found that way: among nulls, or if
    the sketch has missed it.
    """
    found = _first_column(df, order)
    if found is None:
        return None
    name, ascending, nulls_first = found
    column = F.col(f"`{name}`")
    cuts = F.percentile_approx(column, [i / CUTS for i in range(CUTS + 1)], 10 * CUTS)
    known = df.agg(F.count(column).alias("values"), F.count_if(column.isNull()).alias("nulls"), cuts.alias("cuts")).first()
    before = known["nulls"] if nulls_first else 0
    low, high = skip - before, min(skip + limit - before, known["values"])  # places among the values
    if low < 0 or low >= known["values"] or (not nulls_first and known["nulls"] and skip + limit > known["values"]):
        return None
    if not ascending:
        low, high = known["values"] - high, known["values"] - low
    edges = known["cuts"]
    least = edges[max(0, low * CUTS // known["values"] - 1)]
    most = edges[min(CUTS, -(-high * CUTS // known["values"]) + 1)]
    inside = (column >= literal(least)) & (column <= literal(most))
    counts = df.agg(F.count_if(column < literal(least)).alias("below"), F.count_if(inside).alias("inside")).first()
    if counts["below"] > low or counts["below"] + counts["inside"] < high:
        return None
    passed = counts["below"] if ascending else known["values"] - counts["below"] - counts["inside"]
    return df.where(inside), before + passed


def rows_between(df: DataFrame, order: Sequence[str | Column], skip: int, limit: int) -> DataFrame:
    """Rows skip .. skip+limit-1 in (order, hash of all columns), in that order.

    Where the first order column has quantiles, the page is found by rank: only rows whose value
    is near the page's are sorted, and the filter for these reaches the scan. Otherwise the
    order columns of the whole table are.
    """
    near = _near_page(df, order, skip, limit)
    if near is None:
        return _sorted_between(df, order, skip, limit)
    rows, passed = near
    return _sorted_between(rows, order, skip - passed, limit)


def _sorted_between(df: DataFrame, order: Sequence[str | Column], skip: int, limit: int) -> DataFrame:
    """Rows skip .. skip+limit-1 in (order, hash of all columns), in that order.

    Only the order columns and two hashes are sorted and only the hashes are stored, sixteen
    bytes a row. The hashes of the page then pick its rows from a scan; rows that are equal in
    all columns are taken as often as their hashes are on the page.
    """
    places = _in_order(df, order, HASHES, "__position").where(
        (F.col("__position") >= skip) & (F.col("__position") < skip + limit)
    )
    wanted = places.groupBy(*HASHES).agg(F.collect_list("__position").alias("__positions"))
    found = (
        _with_hashes(df)
        .join(wanted, HASHES)
        .groupBy(*HASHES)
        .agg(F.any_value(F.struct(*[f"`{c}`" for c in df.columns])).alias("__row"), F.any_value("__positions").alias("__positions"))
    )
    placed = found.select("__row.*", F.explode("__positions").alias("__position"))
    return placed.orderBy("__position").drop("__position")
