"""Roll-ups of timed runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchwright.functions.scalar import rate
from batchwright.operators.query import exact_mean


def summarize_runs(
    df: DataFrame,
    operation: str = "operation",
    duration: str = "duration_s",
    records: str = "records_retrieved",
    gauges: Sequence[str] = ("cpu_usage", "memory_usage_mb"),
    failed: str | None = None,
    scale: int | None = None,
) -> DataFrame:
    """Averages per operation (A10). Throughput is average records over average duration,
    which is not the average of the throughputs. Rows where `failed` is true are left out.
    With `scale` the measures are averaged as decimals, exactly in any order."""
    runs = df if failed is None else df.filter(~F.col(failed))

    def mean(c: str) -> Column:
        return F.avg(c) if scale is None else exact_mean(F.col(c), scale)

    avg_duration, avg_records = mean(duration), mean(records)
    return runs.groupBy(operation).agg(
        avg_duration.alias("duration_s"),
        avg_records.cast("bigint").alias("records_retrieved"),
        rate(avg_records, avg_duration).alias("throughput_rps"),
        *[mean(g).alias(g) for g in gauges],
    )


def phase_totals(df: DataFrame, insert: str = "insert_s", read: str = "read_s") -> DataFrame:
    """Add insert + read, null when either is missing."""
    return df.withColumn("total_s", F.col(insert) + F.col(read))


def throughput(df: DataFrame, records: str, duration: str, name: str = "throughput_rps", whole: bool = False) -> DataFrame:
    """Add records per second, 0 for no duration, optionally cut to a whole number."""
    value = rate(F.col(records), F.col(duration))
    return df.withColumn(name, value.cast("bigint") if whole else value)
