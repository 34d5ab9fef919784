"""Semi and anti joins on composite keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _match(df: DataFrame, keys_of: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Both sides are joined on one struct of the keys. Two structs with the same nulls
    are equal, so null is a key value like any other. And because no aggregation
    upstream is partitioned by that struct, both sides get an exchange of their own,
    which is the plan shape AQE needs to split a hot key of the left side between tasks.
    When the right side turns out small at run time AQE broadcasts it instead.
    """
    probe = F.struct(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)])
    left = df.withColumn("__key", probe)
    right = keys_of.select(probe.alias("__key"))
    return left.join(right, "__key", how).drop("__key")


def rows_with_keys(df: DataFrame, keys_of: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `df` whose key occurs in `keys_of`."""
    return _match(df, keys_of, keys, "left_semi")


def rows_without_keys(df: DataFrame, keys_of: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `df` whose key does not occur in `keys_of`."""
    return _match(df, keys_of, keys, "left_anti")
