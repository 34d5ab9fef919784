"""Sums, means, summaries and timed runs."""

from pyspark.sql import functions as F

from batchwright.operators import query as Q
from batchwright.operators.runs import phase_totals, summarize_runs, throughput
from batchwright.plans.registry import registered, table


@registered("SELECT count(*) AS row_count FROM lineitem")
def row_count(spark, sf_dir):
    return Q.row_count(table(spark, sf_dir, "lineitem"))


@registered("SELECT sum(l_linenumber)::BIGINT AS total FROM lineitem WHERE l_linenumber > 3")
def sum_filtered(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    return Q.sum_of(lineitem, F.col("l_linenumber"), "total", F.col("l_linenumber") > 3)


@registered(
    """
    SELECT sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(12,2)))::DOUBLE AS revenue
    FROM lineitem
    """
)
def sum_product(spark, sf_dir):
    return Q.sum_of_product(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_discount", "revenue", scale=2)


@registered(
    """
    SELECT sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(12,2)))::DOUBLE AS revenue
    FROM lineitem
    WHERE l_shipdate >= CAST('1996-01-01' AS DATE) AND l_shipdate < CAST('1997-01-01' AS DATE)
      AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24
    """
)
def sum_product_filtered(spark, sf_dir):
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    where = (
        Q.in_range("l_shipdate", day("1996-01-01"), day("1997-01-01"), high_open=True)
        & Q.in_range("l_discount", 0.05, 0.07)
        & Q.in_range("l_quantity", high=24, high_open=True)
    )
    lineitem = table(spark, sf_dir, "lineitem")
    return Q.sum_of_product(lineitem, "l_extendedprice", "l_discount", "revenue", where, scale=2)


@registered(
    """
    SELECT l_linenumber, avg(CAST(floor(l_quantity) AS BIGINT)) AS quantity,
           avg(CAST(round(l_extendedprice * 100) AS BIGINT)) AS price_cents,
           avg(CAST(floor(l_extendedprice / nullif(l_quantity, 0) * 1000000) AS BIGINT)) AS unit_price_micros,
           round(avg(l_extendedprice / nullif(l_quantity, 0)), 6) AS unit_price
    FROM lineitem WHERE l_shipdate >= '1996-01-01' AND l_quantity > 1 AND l_discount > 0 AND l_extendedprice > 0
    GROUP BY l_linenumber ORDER BY l_linenumber
    """
)
def group_means(spark, sf_dir):
    """Means of whole numbers, which do not depend on the order of addition, and of a ratio
    of doubles, rounded to what does not depend on it either."""
    where = (
        (F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("l_quantity") > 1) & (F.col("l_discount") > 0) & (F.col("l_extendedprice") > 0)
    )
    means = {
        "quantity": F.floor("l_quantity"),
        "price_cents": Q.fixed_point(F.col("l_extendedprice"), 2),
        "unit_price_micros": F.floor(Q.mean_ratio("l_extendedprice", "l_quantity") * 1_000_000),
    }
    lines = table(spark, sf_dir, "lineitem")
    doubles = {"unit_price": Q.mean_ratio("l_extendedprice", "l_quantity")}
    found = Q.group_means(lines, "l_linenumber", means | doubles, where)
    return found.withColumn("unit_price", F.round("unit_price", 6))


@registered(
    """
    SELECT o_orderpriority, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE / count(o_totalprice) AS average_value,
           sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS total_value, count(*) AS record_count
    FROM orders GROUP BY o_orderpriority
    """
)
def group_summary(spark, sf_dir):
    return Q.group_summary(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", scale=2)


@registered(
    """
    SELECT o_orderpriority, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE / count(o_totalprice) AS average_value,
           sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS total_value, count(*) AS record_count
    FROM orders WHERE o_orderpriority = '2-HIGH' GROUP BY o_orderpriority
    """
)
def group_summary_one(spark, sf_dir):
    return Q.group_summary(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", only="2-HIGH", scale=2)


@registered(
    """
    SELECT event_type AS operation, d AS duration_s, CAST(trunc(r) AS BIGINT) AS records_retrieved,
           CASE WHEN d > 0 THEN r / d ELSE 0.0 END AS throughput_rps, u AS cpu_usage
    FROM (SELECT event_type, sum(CAST(value AS DECIMAL(18,2)))::DOUBLE / count(value) AS d,
                 sum(CAST(event_id AS DECIMAL(18,2)))::DOUBLE / count(event_id) AS r,
                 sum(CAST(user_id AS DECIMAL(18,2)))::DOUBLE / count(user_id) AS u
          FROM events WHERE NOT value > 100 GROUP BY event_type)
    """
)
def summarize_runs_by_type(spark, sf_dir):
    """Events read as timed runs; those above 100 count as failed."""
    runs = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("operation"),
        F.col("value").alias("duration_s"),
        F.col("event_id").alias("records_retrieved"),
        F.col("user_id").alias("cpu_usage"),
        (F.col("value") > 100).alias("failed"),
    )
    return summarize_runs(runs, gauges=["cpu_usage"], failed="failed", scale=2)


@registered(
    """
    SELECT event_id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE value END AS insert_s, value * 2 AS read_s,
           CASE WHEN user_id % 3 = 0 THEN NULL ELSE value END + value * 2 AS total_s,
           CASE WHEN value * 2 > 0 THEN CAST(trunc(event_id / (value * 2)) AS BIGINT) ELSE 0 END AS throughput_rps
    FROM events
    """
)
def phase_totals_by_event(spark, sf_dir):
    phases = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("user_id") % 3 != 0, F.col("value")).alias("insert_s"),
        (F.col("value") * 2).alias("read_s"),
    )
    return throughput(phase_totals(phases), "event_id", "read_s", whole=True)
