"""Generated rows, driven by the rows of a given table."""

from pyspark.sql import functions as F

from batchwright.operators import duplicates as D
from batchwright.operators.query import group_summary
from batchwright.plans.registry import registered, table
from batchwright.sources import synth as G


@registered(
    """
    SELECT i % 1000 AS field_code, 'Field_' || (i % 1000) AS _field_name, i % 100 AS well_code,
           printf('WELL_REF_%03d', i % 100) AS _well_reference, 'Well_' || (i % 100) AS well_name,
           strftime(TIMESTAMP '2024-01-01' + to_seconds(o_orderkey), '%Y-%m-%dT%H:%M:%S+00:00') AS production_period,
           30::BIGINT AS days_on_production, (1000 + i) / 10 AS oil_production_kbd,
           (5000 + 5 * i) / 100 AS gas_production_mmcfd,
           CAST(printf('%.2f', 25.0::DOUBLE + i * 0.025::DOUBLE) AS DOUBLE) AS liquids_production_kbd,
           CAST(printf('%.2f', 75.0::DOUBLE + i * 0.075::DOUBLE) AS DOUBLE) AS water_production_kbd,
           'performance_test' AS data_source, '{"test": "data_' || i || '"}' AS source_data,
           'partition_' || (i % 10) AS partition_0
    FROM (SELECT o_orderkey, o_orderkey % 10000 AS i FROM orders)
    """
)
def synth_production(spark, sf_dir):
    """One production row per order, in chunks of ten thousand."""
    return G.production_rows(table(spark, sf_dir, "orders"), "o_orderkey", chunk=10_000)


@registered(
    """
    SELECT count(*) AS rows, true AS uuid_length, 1::BIGINT AS version, 'Field_0' AS first_field,
           max(strftime(TIMESTAMP '2010-01-01' + to_hours(c_custkey), '%Y-%m-%dT%H:%M:%S+00:00')) AS last_period
    FROM customer
    """
)
def synth_audit(spark, sf_dir):
    """The layout with audit columns, hourly; uuid and time of creation differ per run."""
    import datetime as dt

    start = dt.datetime(2010, 1, 1)
    rows = G.production_rows(table(spark, sf_dir, "customer"), "c_custkey", start, "hour", None, with_audit=True)
    return rows.agg(
        F.count("*").alias("rows"),
        F.bool_and((F.length("id") == 36) & F.col("created_at").isNotNull()).alias("uuid_length"),
        F.max("version").alias("version"),
        F.min("_field_name").alias("first_field"),
        F.max("production_period").alias("last_period"),
    )


@registered(
    """
    SELECT p_partkey, p_name, p_brand, 3 + CASE WHEN row_number() OVER (ORDER BY p_partkey) <= 7 THEN 1 ELSE 0 END AS rows,
           3 + CASE WHEN row_number() OVER (ORDER BY p_partkey) <= 7 THEN 1 ELSE 0 END AS keys_of_its_own, true AS in_range,
           p_name AS data_source
    FROM part
    """
)
def synth_variations(spark, sf_dir):
    """Varied records with the parts as templates, told per template."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    made = G.synth_variations(part, 3 * part.count() + 7, ["p_partkey"], seed=7, source="p_name")
    fits = (
        F.col("field_code").between(1, 10_000)
        & F.col("well_code").between(1_000, 99_999)
        & F.col("production_period").between("1947-01-01T00:00:00+00:00", "2023-12-01T00:00:00+00:00")
        & F.col("production_period").endswith("-01T00:00:00+00:00")
        & F.col("_well_reference").rlike("^[1-9]-[A-Z]-[1-9]-BA$")
        & F.col("days_on_production").between(1, 31)
        & F.col("oil_production_kbd").between(0, 10)
        & F.col("gas_production_mmcfd").between(0, 100)
        & F.col("liquids_production_kbd").between(0, 5)
        & F.col("water_production_kbd").between(0, 20)
    )
    # A key belongs to the template of its first row; a key made twice is counted for one template only.
    keyed = made.groupBy(*D.DEFAULT_KEYS).agg(
        F.count("*").alias("n"), F.bool_and(fits).alias("ok"),
        *[F.min(c).alias(c) for c in ("p_partkey", "p_name", "p_brand", "data_source")],
    )
    return keyed.groupBy("p_partkey", "p_name", "p_brand", "data_source").agg(
        F.sum("n").cast("int").alias("rows"), F.count("*").cast("int").alias("keys_of_its_own"), F.bool_and("ok").alias("in_range")
    )


@registered(
    """
    WITH t AS (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS p FROM customer)
    SELECT c_custkey, c_name, (p * 3 + least(p, 7) + c)::BIGINT AS variation
    FROM (SELECT *, unnest(range(3 + CASE WHEN p < 7 THEN 1 ELSE 0 END)) AS c FROM t)
    """
)
def expand_templates(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return G.expand_templates(customer, 3 * customer.count() + 7, ["c_custkey"])


@registered(
    """
    SELECT 2 * count(*) + 1 AS total_records, count(*) AS unique_records, count(*) + 1 AS total_duplicates,
           count(*) AS keys_with_duplicates FROM orders
    """
)
def inject_duplicates(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return D.duplicate_summary(G.inject_duplicates(orders, ["o_orderkey"], extra=1), ["o_orderkey"])


@registered(
    """
    SELECT category, avg(o_orderkey) AS average_value, sum(o_orderkey)::BIGINT AS total_value, count(*) AS record_count
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey * 10 < n * 5 THEN 'A' WHEN o_orderkey * 10 < n * 8 THEN 'B' ELSE 'C' END
                 AS category
          FROM orders, (SELECT count(*) AS n FROM orders))
    GROUP BY category
    """
)
def category_table_summary(spark, sf_dir):
    """Order numbers as the running value of the category table."""
    orders = table(spark, sf_dir, "orders")
    return group_summary(G.category_rows(orders, "o_orderkey", orders.count()), "category", "value")
