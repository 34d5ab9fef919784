"""Appends to keyed tables."""

from pyspark.sql import functions as F

from batchwright.operators.append import bulk_append, key_conflicts
from batchwright.operators.envelopes import dedupe_envelope, load_records
from batchwright.operators.query import bag_union
from batchwright.plans.registry import registered, table
from batchwright.plans.rows import LINE_ORDER
from batchwright.schema import TableSchema, create_table, define, get_schema, read_table
from batchwright.sinks.files import write_envelope
from batchwright.sources.envelope import read_envelope, record_columns
from batchwright.sources.synth import production_rows
from batchwright.storage import scratch_path

KEYS = ["l_orderkey", "l_linenumber"]

ORDERS = define(
    "orders",
    [
        ("o_orderkey", "integer", "BIGINT"),
        ("o_custkey", "integer", "BIGINT"),
        ("o_orderstatus", "string", "VARCHAR"),
        ("o_totalprice", "number", "DOUBLE"),
        ("o_orderdate", "string", "TIMESTAMP"),
        ("o_orderpriority", "string", "VARCHAR"),
    ],
    ["o_orderkey"],
    "orders",
    "Orders",
)

EVENTS = define(
    "events",
    [
        ("event_id", "integer", "BIGINT"),
        ("ts", "string", "TIMESTAMP"),
        ("user_id", "integer", "BIGINT"),
        ("event_type", "string", "VARCHAR"),
        ("value", "number", "DOUBLE"),
        ("props", "string", "VARCHAR"),
    ],
    ["event_id"],
    "events",
    "Events",
)

KINDS = {
    "l_returnflag": ("string", "VARCHAR"),
    "l_linestatus": ("string", "VARCHAR"),
    "l_shipdate": ("string", "TIMESTAMP"),
    "l_quantity": ("number", "DOUBLE"),
    "l_extendedprice": ("number", "DOUBLE"),
    "l_discount": ("number", "DOUBLE"),
    "l_tax": ("number", "DOUBLE"),
}
LINES: TableSchema = define(
    "lineitem", [(c, *KINDS.get(c, ("integer", "BIGINT"))) for c in LINE_ORDER], KEYS, "lineitem", "Order lines"
)


@registered("SELECT * FROM orders")
def append_positional(spark, sf_dir):
    """Text columns under other names, bound by position and cast into a new table."""
    orders = table(spark, sf_dir, "orders")
    text = orders.select(*[F.col(c).cast("string").alias(f"raw_{i}") for i, c in enumerate(orders.columns)])
    path = scratch_path(spark, "orders")
    create_table(spark, ORDERS, path)
    bulk_append(text, path, ORDERS, bind_by="position")
    return read_table(spark, ORDERS, path)


@registered(
    f"""
    SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
        PARTITION BY l_orderkey, l_linenumber ORDER BY l_linestatus <> 'F', {', '.join(LINE_ORDER)}) AS rn FROM lineitem)
    WHERE rn = 1
    """
)
def append_skip(spark, sf_dir):
    """Finished lines first, then all lines again: keys already there are skipped."""
    lineitem = table(spark, sf_dir, "lineitem")
    path = scratch_path(spark, "lines")
    bulk_append(lineitem.filter("l_linestatus = 'F'"), path, LINES, bind_by="name", on_conflict="skip")
    bulk_append(lineitem, path, LINES, bind_by="name", on_conflict="skip")
    return read_table(spark, LINES, path)


@registered(
    """
    SELECT l_orderkey, l_linenumber, count(*) AS rows_in_batch, count(*) FILTER (l_returnflag = 'R') AS rows_in_table
    FROM lineitem GROUP BY 1, 2 HAVING count(*) + count(*) FILTER (l_returnflag = 'R') > 1
    """
)
def append_conflicts(spark, sf_dir):
    """All lines offered to a table of the returned ones."""
    lineitem = table(spark, sf_dir, "lineitem")
    return key_conflicts(lineitem, lineitem.filter("l_returnflag = 'R'"), KEYS)


@registered("SELECT true AS success, count(*) * 2 AS records_processed, count(*) AS inserted, count(*) AS skipped FROM events")
def append_result(spark, sf_dir):
    """Events sent twice in one batch, through JSON envelopes."""
    events = table(spark, sf_dir, "events")
    inbox = scratch_path(spark, "inbox")
    write_envelope(bag_union(events, events), inbox, {"@odata.context": "events"})
    batch = record_columns(read_envelope(spark, inbox, layout="lines", mode="failfast"), events.schema)
    result = bulk_append(batch, scratch_path(spark, "events"), EVENTS, bind_by="name", on_conflict="skip")
    return result.to_frame(spark)


@registered(
    """
    SELECT i % 1000 AS field_code, 'Field_' || (i % 1000) AS field_name, i % 100 AS well_code,
           printf('WELL_REF_%03d', i % 100) AS well_reference, 'Well_' || (i % 100) AS well_name,
           TIMESTAMP '2024-01-01' + to_seconds(i) AS production_period, 30::BIGINT AS days_on_production,
           (1000 + i) / 10 AS oil_production_kbd, (5000 + 5 * i) / 100 AS gas_production_mmcfd,
           CAST(printf('%.2f', 25.0::DOUBLE + i * 0.025::DOUBLE) AS DOUBLE) AS liquids_production_kbd,
           CAST(printf('%.2f', 75.0::DOUBLE + i * 0.075::DOUBLE) AS DOUBLE) AS water_production_kbd,
           'performance_test' AS data_source, '{"test": "data_' || i || '"}' AS source_data,
           'partition_' || (i % 10) AS partition_0
    FROM (SELECT o_orderkey AS i FROM orders)
    """
)
def load_envelope(spark, sf_dir):
    """One raw production record per order, through JSON envelopes into the keyed table."""
    inbox, target = scratch_path(spark, "inbox"), scratch_path(spark, "wells")
    write_envelope(production_rows(table(spark, sf_dir, "orders"), "o_orderkey", chunk=None), inbox, {"@odata.context": "c"})
    load_records(spark, inbox, target, layout="lines", mode="failfast")
    return read_table(spark, get_schema("well_production"), target)


@registered("SELECT * FROM customer")
def dedupe_envelopes(spark, sf_dir):
    """Customers written twice, read back after the envelope was cleaned of duplicates."""
    customer = table(spark, sf_dir, "customer")
    dirty, clean = scratch_path(spark, "dirty"), scratch_path(spark, "clean")
    write_envelope(bag_union(customer, customer), dirty, {"@odata.context": "c"})
    dedupe_envelope(spark, dirty, clean, keys=["c_custkey"], layout="lines", envelope={"@odata.context": "c"})
    return record_columns(read_envelope(spark, clean, layout="lines", mode="failfast"), customer.schema)
