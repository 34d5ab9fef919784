"""Names, projections, filters, order, pages, samples and JSON records."""

from pyspark.sql import functions as F

from batchwright.functions import scalar as S
from batchwright.operators import query as Q
from batchwright.operators.position import rows_between, with_row_position
from batchwright.operators.records import normalize, validate
from batchwright.plans.registry import registered, table
from batchwright.schema import Property, TableSchema
from batchwright.sources.envelope import read_envelope
from batchwright.storage import scratch_path


@registered(
    """
    SELECT how, c_mktsegment, n, total FROM
      (SELECT c_mktsegment, count(*) AS n, sum(CAST(c_acctbal AS DECIMAL(18,2)))::DOUBLE AS total
       FROM customer WHERE c_acctbal > 0 GROUP BY 1),
      (VALUES ('view'), ('parameter'), ('methods')) v(how)
    """
)
def sql_by_name(spark, sf_dir):
    """The same question to a registered view, a frame parameter and a chain of methods."""
    customer = table(spark, sf_dir, "customer")
    Q.register(customer, "customer_by_name")
    sql = """SELECT '{how}' AS how, c_mktsegment, count(*) AS n,
                    CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS total
             FROM {source} WHERE c_acctbal > 0 GROUP BY c_mktsegment"""
    view = spark.sql(sql.format(how="view", source="customer_by_name"))
    parameter = Q.query(spark, sql.format(how="parameter", source="{customer}"), customer=customer)
    methods = (
        customer.filter("c_acctbal > 0")
        .groupBy("c_mktsegment")
        .agg(F.count("*").alias("n"), Q.exact_sum(F.col("c_acctbal"), 2).alias("total"))
        .select(F.lit("methods").alias("how"), "c_mktsegment", "n", "total")
    )
    return Q.bag_union(view, parameter, methods)


@registered("SELECT * FROM lineitem WHERE l_orderkey = 7")
def point_lookup(spark, sf_dir):
    return Q.point_lookup(table(spark, sf_dir, "lineitem"), "l_orderkey", 7)


@registered("SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 1")
def first_match(spark, sf_dir):
    return Q.first_match(table(spark, sf_dir, "orders"), "o_orderstatus", "F", ["o_orderkey"])


@registered(
    """
    SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount FROM lineitem
    WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01'
      AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24
    """
)
def range_filter(spark, sf_dir):
    chosen = Q.where_all(
        table(spark, sf_dir, "lineitem"),
        Q.in_range("l_shipdate", _ntz("1996-01-01"), _ntz("1997-01-01"), high_open=True),
        Q.in_range("l_discount", 0.05, 0.07),
        Q.in_range("l_quantity", high=24, high_open=True),
    )
    return chosen.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")


def _ntz(day: str):
    return F.lit(day).cast("timestamp_ntz")


@registered("SELECT * FROM events WHERE event_type = 'purchase' AND value > 20 AND user_id > 5")
def multi_filter(spark, sf_dir):
    only, user = "purchase", 5
    return Q.where_all(
        table(spark, sf_dir, "events"),
        F.col("event_type") == only if only else None,
        Q.in_range("value", low=None),
        F.col("value") > 20,
        F.col("user_id") > user,
    )


@registered("SELECT l_orderkey, l_linenumber, l_extendedprice / nullif(l_quantity, 0) AS unit_price FROM lineitem")
def computed_ratio(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", Q.mean_ratio("l_extendedprice", "l_quantity").alias("unit_price")
    )


@registered("SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(spark, sf_dir):
    return Q.top_k(table(spark, sf_dir, "orders"), [F.col("o_totalprice").desc(), "o_orderkey"], 10)


@registered("SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20 OFFSET 40")
def page(spark, sf_dir):
    return Q.page(table(spark, sf_dir, "orders"), ["o_totalprice", "o_orderkey"], skip=40, limit=20)


@registered(
    """
    SELECT o.* FROM orders o, (SELECT count(*) * 4 // 5 AS skip, count(*) // 20 AS rows FROM orders) n
    QUALIFY row_number() OVER (ORDER BY o_totalprice, o_orderkey) BETWEEN skip + 1 AND skip + rows
    """
)
def page_deep(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    rows = orders.count()
    return rows_between(orders, ["o_totalprice", "o_orderkey"], rows * 4 // 5, rows // 20)


@registered(
    """
    SELECT l_orderkey, l_linenumber, l_extendedprice
    FROM lineitem, (SELECT count(*) // 2 AS skip, count(*) // 50 AS rows FROM lineitem) n
    QUALIFY row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber DESC, l_partkey)
      BETWEEN skip + 1 AND skip + rows
    """
)
def page_deep_desc(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.count()
    order = [F.col("l_extendedprice").desc(), "l_orderkey", F.col("l_linenumber").desc(), "l_partkey"]
    return rows_between(lines, order, rows // 2, rows // 50).select("l_orderkey", "l_linenumber", "l_extendedprice")


@registered("SELECT * FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 20")
def page_after(spark, sf_dir):
    return Q.page_after(table(spark, sf_dir, "orders"), "o_orderkey", 1000, 20)


@registered("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS position FROM orders")
def row_position(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey")
    return with_row_position(orders, ["o_totalprice", "o_orderkey"]).drop("o_totalprice")


@registered("SELECT * FROM orders WHERE (o_orderkey * 2654435761) % 1000 < 100")
def sample_by_hash(spark, sf_dir):
    return Q.sample_by_multiplier(table(spark, sf_dir, "orders"), "o_orderkey", 2654435761, 1000, 100)


@registered(
    """
    SELECT c_custkey, c_name, md5('7:' || c_custkey::VARCHAR) AS drawn FROM customer
    WHERE md5('7:' || c_custkey::VARCHAR) < '4'
    """
)
def sample_by_seed(spark, sf_dir):
    chosen = Q.sample_by_digest(table(spark, sf_dir, "customer"), ["c_custkey"], 0.25, seed=7)
    drawn = F.md5(F.concat(F.lit("7:"), F.col("c_custkey").cast("string")).cast("binary"))
    return chosen.select("c_custkey", "c_name", drawn.alias("drawn"))


@registered(
    """
    SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
        PARTITION BY o_orderpriority ORDER BY md5('11:' || o_orderkey), o_orderkey) AS rn FROM orders)
    WHERE rn <= 100
    """
)
def sample_exact(spark, sf_dir):
    """A hundred orders of each priority."""
    return Q.sample_exact(table(spark, sf_dir, "orders"), ["o_orderpriority"], ["o_orderkey"], 100, 11)


@registered(
    """
    SELECT o_orderkey, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 AS INTEGER) AS due,
           date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') AS days_left
    FROM orders
    """
)
def date_days(spark, sf_dir):
    """Dates some days later, and days up to a date."""
    day = F.col("o_orderdate").cast("date")
    left = S.days_between(day, F.lit("1998-08-02").cast("date"))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.plus_days(day, F.col("o_orderkey") % 400).alias("due"), left.alias("days_left"))


@registered("SELECT * FROM customer")
def shuffle_rows(spark, sf_dir):
    return Q.shuffle_rows(table(spark, sf_dir, "customer"), seed=42, keys=["c_custkey"])


LINE_ORDER = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


@registered(
    """
    SELECT 'Order 0' AS label, * FROM (SELECT * FROM lineitem WHERE l_orderkey = 0 ORDER BY ALL LIMIT 1)
    UNION ALL
    SELECT 'Order 3', * FROM (SELECT * FROM lineitem WHERE l_orderkey = 3 ORDER BY ALL LIMIT 1)
    UNION ALL
    SELECT 'Max Order', * FROM (SELECT * FROM lineitem WHERE l_orderkey = (SELECT max(l_orderkey) FROM lineitem)
                                ORDER BY ALL LIMIT 1)
    """
)
def spot_check(spark, sf_dir):
    return Q.spot_check(table(spark, sf_dir, "lineitem"), "l_orderkey", [0, 3], LINE_ORDER, "Order")


@registered(
    """
    SELECT user_id AS field_code,
           CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN event_type WHEN 2 THEN '' END AS field_name,
           event_id AS well_code,
           CASE event_id % 2 WHEN 0 THEN 'W-' || user_id ELSE '' END AS well_reference,
           '' AS well_name,
           CASE event_id % 5 WHEN 0 THEN '' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') END AS production_period,
           CASE event_id % 3 WHEN 0 THEN 0 WHEN 2 THEN 30 END::BIGINT AS days_on_production,
           CASE event_id % 3 WHEN 0 THEN 0.0::DOUBLE WHEN 2 THEN value END AS oil_production_kbd,
           value AS gas_production_mmcfd,
           0.0::DOUBLE AS liquids_production_kbd,
           3.0::DOUBLE AS water_production_kbd,
           '' AS data_source,
           props AS source_data,
           CASE event_id % 2 WHEN 0 THEN 'latest' ELSE 'p' END AS partition_0
    FROM events
    """
)
def normalize_records(spark, sf_dir):
    """Events as records whose keys are present, absent or null by turns."""
    id_ = F.col("event_id")

    def by(n, *variants):
        """JSON members, one variant per remainder of the id; '' leaves the key out."""
        chain = F.lit(variants[0]) if isinstance(variants[0], str) else variants[0]
        for i, v in enumerate(variants[1:], 1):
            chain = F.when(id_ % n == i, v).otherwise(chain)
        return chain

    kind = F.to_json(F.struct(F.col("event_type").alias("t"))).substr(F.lit(6), F.length("event_type") + 2)
    text = F.concat(
        F.format_string('{"field_code": %d, "well_code": %d', "user_id", "event_id"),
        by(
            4,
            F.concat(F.lit(', "_field_name": '), kind),
            F.concat(F.lit(', "field_name": '), kind),
            F.lit(""),
            F.concat(F.lit(', "_field_name": null, "field_name": '), kind),
        ),
        by(2, F.format_string(', "_well_reference": "W-%d", "well_reference": "x"', "user_id"), F.lit("")),
        F.when(id_ % 5 != 0, F.date_format("ts", "', \"production_period\": \"'yyyy-MM-dd'T'HH:mm:ss'+00:00\"'")).otherwise(""),
        by(
            3,
            F.lit(""),
            F.lit(', "days_on_production": null, "oil_production_kbd": null'),
            F.concat(F.lit(', "days_on_production": 30, "oil_production_kbd": '), F.col("value").cast("string")),
        ),
        F.concat(F.lit(', "gas_production_mmcfd": '), F.col("value").cast("string"), F.lit(', "water_production_kbd": 3')),
        F.concat(F.lit(', "source_data": "'), F.replace("props", F.lit('"'), F.lit('\\"')), F.lit('"')),
        by(2, F.lit(""), F.lit(', "partition_0": "p"')),
        F.lit(', "unknown": [1, 2]}'),
    )
    path = scratch_path(spark, "records")
    table(spark, sf_dir, "events").select(text.alias("value")).write.text(path)
    return normalize(read_envelope(spark, path, layout="lines", mode="failfast")).drop("ordinal")


CHECKED = TableSchema(
    "checked_events",
    (
        Property("event_id", "integer", "BIGINT", required=True),
        Property("user_id", "integer", "BIGINT", required=True),
        Property("event_type", "string", "VARCHAR"),
        Property("value", "number", "DOUBLE"),
        Property("flag", "boolean", "VARCHAR"),
        Property("tags", "array", "VARCHAR"),
        Property("props", "object", "VARCHAR"),
    ),
    ("event_id",),
)


@registered(
    """
    SELECT event_id AS seq, CASE event_id % 9
        WHEN 1 THEN 'Missing required fields: event_id, user_id'
        WHEN 2 THEN 'Field ''value'' expected number, got str'
        WHEN 3 THEN 'Field ''user_id'' expected integer, got float'
        WHEN 4 THEN 'Field ''event_type'' expected string, got NoneType'
        WHEN 6 THEN 'Field ''flag'' expected boolean, got int'
        WHEN 7 THEN 'Field ''tags'' expected array, got dict'
        WHEN 8 THEN 'Missing required fields: user_id'
      END AS error
    FROM events
    """
)
def validate_records(spark, sf_dir):
    """Events as records with one of seven defects, or none."""
    whole = "\"event_id\": %1$d, \"user_id\": %2$d, \"event_type\": \"%3$s\", \"value\": %4$s, \"props\": %5$s"
    shapes = [
        whole,
        "\"value\": \"text\"",
        "\"event_id\": %1$d, \"user_id\": %2$d, \"value\": \"%4$s\", \"flag\": 1",
        "\"event_id\": %1$d, \"user_id\": 1.0, \"value\": null",
        "\"event_id\": %1$d, \"user_id\": %2$d, \"event_type\": null",
        "\"event_id\": %1$d, \"user_id\": true, \"value\": true, \"flag\": false, \"tags\": [1, \"a\"]",
        "\"event_id\": %1$d, \"user_id\": %2$d, \"flag\": 1, \"tags\": 2",
        "\"event_id\": %1$d, \"user_id\": %2$d, \"tags\": {\"a\": 1}",
        "\"event_id\": %1$d, \"value\": \"text\"",
    ]
    args = ["event_id", "user_id", "event_type", F.col("value").cast("string"), "props"]
    text = F.lit(None).cast("string")
    for i, shape in enumerate(shapes):
        text = F.when(F.col("event_id") % len(shapes) == i, F.format_string("{" + shape + "}", *args)).otherwise(text)
    records = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.parse_json(text).alias("record"))
    return validate(records, CHECKED).select("seq", "error")
