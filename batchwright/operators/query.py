"""Questions asked of a DataFrame: names, filters, aggregates, order, pages and samples
(S7-S9, P2-P9, P12, P13, L1-L7, U1, U2, A1-A6)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from batchwright.errors import InvalidData, RecordNotFound
from batchwright.functions.scalar import literal, ratio
from batchwright.operators.position import content_hash, rows_between

#: Rows that a page may carry to one task; a choice between plans with equal results.
TOP_K_ROWS = 10_000


def register(df: DataFrame, name: str) -> DataFrame:
    """Make the frame queryable by name in SQL."""
    df.createOrReplaceTempView(name)
    return df


def query(spark: SparkSession, sql: str, **frames: DataFrame) -> DataFrame:
    """SQL over frames referred to as {name}, without registering them."""
    return spark.sql(sql, **frames)


# ------------------------------------------------------------------ filters


def point_lookup(df: DataFrame, column: str, value) -> DataFrame:
    """Rows with one value of a column."""
    return df.filter(F.col(f"`{column}`") == literal(value))


def first_match(df: DataFrame, column: str, value, order: Sequence[str | Column], must_exist: bool = False) -> DataFrame:
    """One row with that value, the first in `order` (L1)."""
    found = point_lookup(df, column, value).orderBy(*order).limit(1)
    if must_exist and found.isEmpty():
        raise RecordNotFound(f"no record with {column} = {value!r}")
    return found


def in_range(column: str, low=None, high=None, high_open: bool = False) -> Column:
    """low <= column <= high, or < high; either end may be left out."""
    c = F.col(f"`{column}`")
    parts = []
    if low is not None:
        parts.append(c >= literal(low))
    if high is not None:
        parts.append(c < literal(high) if high_open else c <= literal(high))
    return reduce(Column.__and__, parts, F.lit(True))


def where_all(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """Conjunction of the conditions that are given; None stands for "not asked" (P8, P9)."""
    for c in conditions:
        if c is not None:
            df = df.filter(c)
    return df


# --------------------------------------------------------------- aggregates


def row_count(df: DataFrame) -> DataFrame:
    """One row: number of rows (A1)."""
    return df.agg(F.count("*").alias("row_count"))


def fixed_point(value: Column, scale: int) -> Column:
    """Value times 10^scale as a whole number, for values that have no more digits."""
    return F.rint(value * float(10**scale)).cast("bigint")


def exact_sum(value: Column, scale: int, whole: Column | None = None) -> Column:
    """Sum as a double that does not depend on the order of the rows.

    The values (or `whole`, already multiplied by 10^scale) are added as integers, which
    costs no more than adding doubles. High and low bits are added apart and joined at
    the end: the low half holds 8.8e12 rows, the high half values that add up to 9.6e24.
    Beyond that the sum stops with an overflow error.
    """
    whole = fixed_point(value, scale) if whole is None else whole
    high = F.sum(F.shiftright(whole, 20)).cast("decimal(28,0)")
    low = F.sum(whole.bitwiseAND(F.lit((1 << 20) - 1)))
    return (high * F.lit(1 << 20) + low).cast("double") / float(10**scale)


def exact_mean(value: Column, scale: int) -> Column:
    """Mean of such values, as the exact sum over the count."""
    return exact_sum(value, scale) / F.count(value)


def sum_of(df: DataFrame, value: Column, name: str, where: Column | None = None) -> DataFrame:
    """One row: sum over the rows that match (A2)."""
    return where_all(df, where).agg(F.sum(value).alias(name))


def sum_of_product(
    df: DataFrame, a: str, b: str, name: str, where: Column | None = None, scale: int | None = None
) -> DataFrame:
    """One row: sum(a * b) over the rows that match (A3, A4). With `scale` both factors
    have that many digits at most, and the sum is exact in any order."""
    left, right = F.col(f"`{a}`"), F.col(f"`{b}`")
    if scale is None:
        total = F.sum(left * right)
    else:
        total = exact_sum(left, 2 * scale, fixed_point(left, scale) * fixed_point(right, scale))
    return where_all(df, where).agg(total.alias(name))


def group_means(df: DataFrame, by: str, means: dict[str, Column], where: Column | None = None) -> DataFrame:
    """Means per group, nulls left out, sorted by the group (A5, L3)."""
    grouped = where_all(df, where).groupBy(f"`{by}`")
    return grouped.agg(*[F.avg(c).alias(n) for n, c in means.items()]).orderBy(f"`{by}`")


def mean_ratio(a: str, b: str) -> Column:
    """Row-wise a / b, to be averaged: the mean of the ratios."""
    return ratio(F.col(f"`{a}`"), F.col(f"`{b}`"))


def group_summary(
    df: DataFrame, by: str, value: str, only: object | None = None, scale: int | None = None
) -> DataFrame:
    """Mean, total and count per category, optionally of one category only."""
    chosen = where_all(df, None if only is None else F.col(f"`{by}`") == literal(only))
    v = F.col(f"`{value}`")
    if scale is None:
        mean, total = F.avg(v), F.sum(v)
    else:
        mean, total = exact_mean(v, scale), exact_sum(v, scale)
    return chosen.groupBy(f"`{by}`").agg(
        mean.alias("average_value"), total.alias("total_value"), F.count("*").alias("record_count")
    )


# ------------------------------------------------------- order, page, sample


def top_k(df: DataFrame, order: Sequence[str | Column], k: int) -> DataFrame:
    """First k rows in `order`: every task keeps k rows, nothing is sorted whole."""
    return df.orderBy(*order).limit(k)


def page(df: DataFrame, order: Sequence[str | Column], skip: int, limit: int) -> DataFrame:
    """Rows skip .. skip+limit-1 in `order`, names or columns in any direction (L4).

    Rows that tie are ordered by a hash of all columns, so pages fit together at any depth.
    Near the start this is a top-k. Further in, a top-k would carry all skipped rows to one
    task, so the page is looked up in sorted ranges; the rows are the same either way.
    """
    if skip < 0 or limit < 0:
        raise InvalidData("skip and limit must not be negative")
    if skip + limit > TOP_K_ROWS:
        return rows_between(df, order, skip, limit)
    columns = [F.col(f"`{o}`") if isinstance(o, str) else o for o in order]
    return df.orderBy(*columns, content_hash(df)).offset(skip).limit(limit)


def page_after(df: DataFrame, key: str, last: object | None, limit: int) -> DataFrame:
    """Next page by a unique key: the rows after the last one seen. Costs the same at any
    depth, as the filter reaches the scan (L4)."""
    after = None if last is None else F.col(f"`{key}`") > literal(last)
    return where_all(df, after).orderBy(f"`{key}`").limit(limit)


def sample_fraction(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Random sample, repeatable for the same partitioning only."""
    return df.sample(fraction, seed)


def sample_by_hash(df: DataFrame, keys: Sequence[str], fraction: float, seed: int) -> DataFrame:
    """Sample decided by a hash of the key, so it is the same whatever the layout.
    Other seeds draw other samples."""
    bucket = F.pmod(F.xxhash64(F.lit(seed), *[f"`{k}`" for k in keys]), F.lit(1_000_000))
    return df.filter(bucket < int(fraction * 1_000_000))


def sample_by_multiplier(df: DataFrame, key: str, multiplier: int, out_of: int, below: int) -> DataFrame:
    """Sample of an integer key by a multiplicative hash that any SQL engine can repeat.

    The key is reduced before it is multiplied, which gives the same remainder and does not
    overflow for any key, as long as out_of squared fits.
    """
    if out_of * max(1, multiplier % out_of) >= 2**63:
        raise InvalidData("out_of is too large for its multiplier")
    reduced = F.pmod(F.col(f"`{key}`"), F.lit(out_of))
    return df.filter(F.pmod(reduced * F.lit(multiplier % out_of), F.lit(out_of)) < below)


def sample_by_digest(df: DataFrame, keys: Sequence[str], fraction: float, seed: int) -> DataFrame:
    """Seeded sample by the MD5 digest of "seed:key", which other engines can repeat.

    A row is drawn if its digest, read as a fraction of all digests, is below `fraction`.
    """
    if not 0 <= fraction <= 1:
        raise InvalidData("fraction must be between 0 and 1")
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(f"`{k}`").cast("string") for k in keys])
    bound = round(fraction * 2**128)
    if bound == 2**128:
        return df
    return df.filter(F.md5(text.cast("binary")) < F.lit(f"{bound:032x}"))


def sample_exact(df: DataFrame, by: Sequence[str], keys: Sequence[str], k: int, seed: int) -> DataFrame:
    """`k` rows of each stratum, all of a smaller one, drawn by a seeded digest of the keys.

    The rows with the smallest digests stay, so the sample is the same whatever the layout,
    and any other engine can repeat it. Each task keeps its own k rows of a stratum before
    anything is exchanged; a stratum with most of the rows therefore sends k rows a task.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(f"`{c}`").cast("string") for c in keys]).cast("binary"))
    order = Window.partitionBy(*[f"`{c}`" for c in by]).orderBy("__digest", *[f"`{c}`" for c in keys])
    ranked = df.withColumn("__digest", digest).withColumn("__rank", F.row_number().over(order))
    return ranked.where(F.col("__rank") <= k).drop("__digest", "__rank")


def shuffle_rows(df: DataFrame, seed: int, keys: Sequence[str]) -> DataFrame:
    """Rows in a random order that `seed` and the keys determine."""
    return df.orderBy(F.xxhash64(F.lit(seed), *[f"`{k}`" for k in keys]), *[f"`{k}`" for k in keys])


# ------------------------------------------------------------ stack and label


def stack(*frames: DataFrame, fill: bool = True) -> DataFrame:
    """Rows of all frames, columns aligned by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=fill), frames)


def bag_union(*frames: DataFrame) -> DataFrame:
    """Rows of all frames, duplicates kept, columns by position."""
    return reduce(DataFrame.unionAll, frames)


def labelled(df: DataFrame, label: str, name: str = "label") -> DataFrame:
    """Add a constant label in front of the columns."""
    return df.select(F.lit(label).alias(name), "*")


def spot_check(
    df: DataFrame, column: str, values: Sequence[object], order: Sequence[str], title: str
) -> DataFrame:
    """One labelled row for each of `values` and one for the highest value (L7). An empty
    table gives no rows."""
    tie = [F.col(f"`{o}`") for o in order]
    rows = [labelled(first_match(df, column, v, tie), f"{title} {v}") for v in values]
    highest = df.orderBy(F.col(f"`{column}`").desc(), *tie).limit(1)
    return stack(*rows, labelled(highest, f"Max {title}"))
