"""Deduplication and duplicate audit on composite keys.

Counting operators aggregate by key before the exchange, so a hot key costs one row per
map task. No operator gathers the rows or positions of a key in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchwright.errors import InvalidData, KeyConflict
from batchwright.functions.scalar import percent
from batchwright.operators.joins import rows_with_keys

# Key columns used when the caller names none.
DEFAULT_KEYS = ("field_code", "well_code", "production_period")
#: Positions that one mask covers, a power of two.
MASK_BITS = 32


def resolve_keys(df: DataFrame, keys: Sequence[str] | None = None) -> list[str]:
    """Those of the wanted keys that exist, or all columns when none does."""
    present = [k for k in (keys or DEFAULT_KEYS) if k in df.columns]
    return present or df.columns


def _keyed(df: DataFrame, keys: Sequence[str] | None) -> tuple[list[str], DataFrame]:
    names = resolve_keys(df, keys)
    return names, df.groupBy(*[f"`{k}`" for k in names])


def dedupe_first(df: DataFrame, keys: Sequence[str] | None, order: Sequence[str | Column]) -> DataFrame:
    """Keep the first row per key in `order` (D1); null keys compare equal.

    Because only rank 1 is kept, Spark ranks within each map task before the exchange
    and ships at most one row per key and task.
    """
    if not order:
        raise InvalidData("keep-first needs an order: an input position or the columns that define it")
    names = resolve_keys(df, keys)
    # Within a key the key columns are constant, so they need no sorting.
    order = [o for o in order if not isinstance(o, str) or o.strip("`") not in names] or [F.lit(0)]
    window = Window.partitionBy(*[f"`{k}`" for k in names]).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(window)).filter("__rank = 1").drop("__rank")


def key_counts(df: DataFrame, keys: Sequence[str] | None = None, name: str = "n") -> DataFrame:
    """Rows per key."""
    return _keyed(df, keys)[1].agg(F.count("*").alias(name))


def duplicate_summary(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """One row: total records, unique keys, surplus records, keys with duplicates."""
    n = F.col("n")
    return key_counts(df, keys).agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("total_records"),
        F.count("*").alias("unique_records"),
        F.coalesce(F.sum(n - 1), F.lit(0)).alias("total_duplicates"),
        F.count_if(n > 1).alias("keys_with_duplicates"),
    )


def dedupe_report(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """One row: what keep-first would do to `df` (D3)."""
    totals = duplicate_summary(df, keys)
    removed = F.col("total_records") - F.col("unique_records")
    return totals.select(
        F.col("total_records").alias("original_count"),
        F.col("unique_records").alias("final_count"),
        removed.alias("removed_count"),
        percent(removed, F.col("total_records")).alias("reduction_percent"),
    )


def distinct_keys(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """One row: number of distinct keys, a null part counting as a value."""
    return key_counts(df, keys).agg(F.count("*").alias("distinct_keys"))


def approx_distinct_keys(df: DataFrame, keys: Sequence[str] | None = None, rsd: float = 0.02) -> DataFrame:
    """As `distinct_keys`, estimated in one pass without an exchange of keys."""
    names = resolve_keys(df, keys)
    return df.agg(F.approx_count_distinct(F.struct(*[f"`{k}`" for k in names]), rsd).alias("distinct_keys"))


def multiplicity_histogram(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """How many keys occur once, twice, ...."""
    return key_counts(df, keys, "occurrences").groupBy("occurrences").agg(F.count("*").alias("keys"))


def multiplicity_counts(df: DataFrame, keys: Sequence[str] | None = None, exactly: Sequence[int] = (2, 3)) -> DataFrame:
    """One row: number of keys with exactly so many occurrences."""
    counted = [F.count_if(F.col("n") == k).alias(f"keys_with_{k}") for k in exactly]
    return key_counts(df, keys).agg(*counted)


def duplicate_groups(df: DataFrame, keys: Sequence[str] | None, ordinal: str) -> DataFrame:
    """Keys that occur more than once, with their count and the first and last value of
    `ordinal` (D4). All positions of a group, one per row, come from `duplicate_members`."""
    grouped = _keyed(df, keys)[1].agg(
        F.count("*").alias("occurrences"),
        F.min(ordinal).alias("first_position"),
        F.max(ordinal).alias("last_position"),
    )
    return grouped.filter("occurrences > 1")


def duplicate_positions(df: DataFrame, keys: Sequence[str] | None, ordinal: str) -> DataFrame:
    """All positions of every key that occurs more than once, as masks: the keys, `block`, `mask` and `n`.

    `ordinal` numbers the rows with whole numbers. Bit i of `mask` is position
    MASK_BITS * block + i, and `n` is how many bits are set, so the positions of a group of any
    size are rows of fixed width and never a list. Masks are put together in each task before
    the exchange. `listed_positions` turns them back into positions.
    """
    names = resolve_keys(df, keys)
    at =F.col(f"`{ordinal}`").cast("bigint")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(MASK_BITS - 1).cast("int"))
    block = F.shiftright(at, MASK_BITS.bit_length() - 1).alias("block")
    masks = df.groupBy(*[f"`{k}`" for k in names], block).agg(F.bit_or(bit).alias("mask"))
    masks = masks.withColumn("n", F.bit_count("mask").cast("bigint"))
    repeated = masks.groupBy(*[f"`{k}`" for k in names]).agg(F.sum("n").alias("__n")).filter("__n > 1")
    return rows_with_keys(masks, repeated, names)


def listed_positions(masks: DataFrame, name: str = "position") -> DataFrame:
    """One row per position of `duplicate_positions`."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(MASK_BITS - 1)), lambda i: F.getbit("mask", i) == 1)
    spread = masks.withColumn("__bit", F.explode(bits)).withColumn(name, F.col("block") * MASK_BITS + F.col("__bit"))
    return spread.drop("__bit", "block", "mask", "n")


def duplicate_members(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Full rows of every key that occurs more than once."""
    names, grouped = _keyed(df, keys)
    repeated = grouped.agg(F.count("*").alias("__n")).filter("__n > 1")
    return rows_with_keys(df, repeated, names)


def duplicate_examples(
    df: DataFrame, keys: Sequence[str] | None = None, ordinal: str | None = None, k: int = 3
) -> DataFrame:
    """Full rows of the first `k` duplicate groups (D7): those that start first by
    `ordinal`, or those with the lowest keys when no ordinal is given."""
    names, grouped = _keyed(df, keys)
    start = [F.min(ordinal).alias("__start")] if ordinal else []
    repeated = grouped.agg(F.count("*").alias("__n"), *start).filter("__n > 1")
    order = (["__start"] if ordinal else []) + [f"`{c}`" for c in names]
    first = repeated.orderBy(*order).limit(k).select(*[f"`{c}`" for c in names])
    return rows_with_keys(df, first, names)


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raise KeyConflict when a key occurs twice (A7); names one offending key."""
    offender = key_counts(df, keys).filter("n > 1").first()
    if offender:
        values = {k: offender[k] for k in keys}
        raise KeyConflict(f"duplicate key {values}: {offender['n']} rows")
    return df
