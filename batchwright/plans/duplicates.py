"""Deduplication and duplicate audit. Order lines repeat (order, line number)."""

from pyspark.sql import functions as F

from batchwright.operators import duplicates as D
from batchwright.operators.position import with_row_position
from batchwright.plans.registry import registered, table
from batchwright.plans.rows import LINE_ORDER

KEYS = ["l_orderkey", "l_linenumber"]
COUNTED = "(SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)"


@registered(
    f"""
    SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
        PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(LINE_ORDER)}) AS rn FROM lineitem)
    WHERE rn = 1
    """
)
def dedupe_first(spark, sf_dir):
    return D.dedupe_first(table(spark, sf_dir, "lineitem"), KEYS, LINE_ORDER)


@registered(
    f"""
    SELECT sum(n)::BIGINT AS original_count, count(*) AS final_count, (sum(n) - count(*))::BIGINT AS removed_count,
           (sum(n) - count(*))::BIGINT / sum(n)::BIGINT * 100 AS reduction_percent FROM {COUNTED}
    """
)
def dedupe_report(spark, sf_dir):
    return D.dedupe_report(table(spark, sf_dir, "lineitem"), KEYS)


@registered(
    """
    SELECT l_orderkey, l_linenumber, count(*) AS occurrences, min(l_shipdate) AS first_position,
           max(l_shipdate) AS last_position
    FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1
    """
)
def duplicate_groups(spark, sf_dir):
    return D.duplicate_groups(table(spark, sf_dir, "lineitem"), KEYS, "l_shipdate")


@registered(
    f"""
    WITH p AS (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY {', '.join(LINE_ORDER)}) - 1 AS position FROM lineitem)
    SELECT l_orderkey, l_linenumber, position // 32 AS block, bit_or(1::BIGINT << (position % 32)) AS mask, count(*) AS n
    FROM p WHERE (l_orderkey, l_linenumber) IN
      (SELECT (l_orderkey, l_linenumber) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
    GROUP BY ALL
    """
)
def duplicate_positions(spark, sf_dir):
    """Where the repeated lines stand in the ordered table, 32 positions a row."""
    lines = with_row_position(table(spark, sf_dir, "lineitem"), LINE_ORDER)
    return D.duplicate_positions(lines, KEYS, "position")


@registered(
    f"""
    SELECT sum(n)::BIGINT AS total_records, count(*) AS unique_records, sum(n - 1)::BIGINT AS total_duplicates,
           count(*) FILTER (n > 1) AS keys_with_duplicates FROM {COUNTED}
    """
)
def duplicate_summary(spark, sf_dir):
    return D.duplicate_summary(table(spark, sf_dir, "lineitem"), KEYS)


@registered(
    """
    SELECT count(*) AS distinct_keys FROM (SELECT DISTINCT user_id, CASE WHEN value > 50 THEN event_type END FROM events)
    """
)
def distinct_keys(spark, sf_dir):
    """A key with a null part."""
    kind = F.when(F.col("value") > 50, F.col("event_type"))
    return D.distinct_keys(table(spark, sf_dir, "events").select("user_id", kind.alias("kind")), ["user_id", "kind"])


@registered(f"SELECT n AS occurrences, count(*) AS keys FROM {COUNTED} GROUP BY n")
def multiplicity_histogram(spark, sf_dir):
    return D.multiplicity_histogram(table(spark, sf_dir, "lineitem"), KEYS)


@registered(f"SELECT count(*) FILTER (n = 2) AS keys_with_2, count(*) FILTER (n = 3) AS keys_with_3 FROM {COUNTED}")
def multiplicity_counts(spark, sf_dir):
    return D.multiplicity_counts(table(spark, sf_dir, "lineitem"), KEYS)


@registered("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2")
def key_counts(spark, sf_dir):
    return D.key_counts(table(spark, sf_dir, "lineitem"), KEYS)


@registered(
    """
    SELECT * FROM lineitem WHERE (l_orderkey, l_linenumber) IN
      (SELECT (l_orderkey, l_linenumber) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
    """
)
def duplicate_members(spark, sf_dir):
    return D.duplicate_members(table(spark, sf_dir, "lineitem"), KEYS)


@registered(
    """
    SELECT * FROM lineitem WHERE (l_orderkey, l_linenumber) IN
      (SELECT (l_orderkey, l_linenumber) FROM
         (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY 1, 2 LIMIT 3))
    """
)
def duplicate_examples(spark, sf_dir):
    return D.duplicate_examples(table(spark, sf_dir, "lineitem"), KEYS, k=3)
