"""Sources, sinks and round trips."""

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from batchwright.errors import EmptyInput, InvalidData
from batchwright.operators import query as Q
from batchwright.operators.append import reconcile
from batchwright.operators.records import require_rows
from batchwright.plans.registry import registered, table
from batchwright.schema import spark_type
from batchwright.sinks.files import write_envelope, write_parquet
from batchwright.sources.arrow_ipc import read_arrow, write_arrow
from batchwright.sources.batches import map_batches
from batchwright.sources.envelope import read_envelope, record_columns, rejected_pieces
from batchwright.sources.local import decode_payloads, from_local
from batchwright.sources.parquet import bulk_read, parquet_scan, read_partitioned
from batchwright.storage import filesystem, list_names, rename, scratch_path

ENVELOPE = {"@odata.context": "production/$metadata#Agência"}


@registered("SELECT * FROM orders")
def bulk_read_parquet(spark, sf_dir):
    return bulk_read(spark, f"{sf_dir}/orders.parquet")


@registered("SELECT * FROM part")
def parquet_table_function(spark, sf_dir):
    return parquet_scan(spark, f"{sf_dir}/part.parquet")


@registered("SELECT * FROM orders")
def feather_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "feather")
    write_arrow(table(spark, sf_dir, "orders"), path, "file")
    return bulk_read(spark, path, "feather")


@registered("SELECT l_orderkey, l_extendedprice FROM lineitem")
def feather_projection(spark, sf_dir):
    path = scratch_path(spark, "feather")
    write_arrow(table(spark, sf_dir, "lineitem"), path, "file")
    return read_arrow(spark, path, "file", columns=["l_orderkey", "l_extendedprice"], target_bytes=1 << 20)


@registered("SELECT count(*) AS rows FROM embeddings")
def feather_manifest(spark, sf_dir):
    """Rows written according to the manifest."""
    written = write_arrow(table(spark, sf_dir, "embeddings"), scratch_path(spark, "feather"), "file")
    return written.agg(F.sum("rows").alias("rows"))


@registered("SELECT * FROM customer")
def arrow_stream_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "arrow-stream")
    write_arrow(table(spark, sf_dir, "customer"), path, "stream")
    return bulk_read(spark, path, "arrow_stream")


@registered("SELECT * FROM part")
def zstd_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "zstd")
    write_parquet(table(spark, sf_dir, "part"), path, codec="zstd", level=1)
    return bulk_read(spark, path)


@registered(
    """
    SELECT o_orderkey, o_totalprice, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_totalprice > 250000 AS large
    FROM orders WHERE o_totalprice > 100000
    """
)
def scan_batches(spark, sf_dir):
    """A filtered scan whose record batches are worked on as Arrow columns."""

    def priced(batch):
        import pyarrow as pa
        import pyarrow.compute as pc

        price = batch.column("o_totalprice")
        cents = pc.cast(pc.round(pc.multiply(price, 100.0)), pa.int64())
        columns = [batch.column("o_orderkey"), price, cents, pc.greater(price, 250000.0)]
        return pa.RecordBatch.from_arrays(columns, ["o_orderkey", "o_totalprice", "cents", "large"])

    orders = Q.where_all(table(spark, sf_dir, "orders"), F.col("o_totalprice") > 100000).select("o_orderkey", "o_totalprice")
    kind = orders.schema["o_orderkey"].dataType.simpleString()
    return map_batches(orders, priced, f"o_orderkey {kind}, o_totalprice double, cents bigint, large boolean", rows=4096)


@registered("SELECT * FROM supplier")
def envelope_roundtrip(spark, sf_dir):
    source = table(spark, sf_dir, "supplier")
    path = scratch_path(spark, "envelope")
    write_envelope(source, path, ENVELOPE)
    return record_columns(read_envelope(spark, path, layout="lines"), source.schema)


@registered("SELECT * FROM customer")
def envelope_indented(spark, sf_dir):
    source = table(spark, sf_dir, "customer")
    path = scratch_path(spark, "envelope")
    write_envelope(source, path, ENVELOPE, indent=True)
    return record_columns(read_envelope(spark, path, layout="indented"), source.schema)


@registered("SELECT * FROM part")
def envelope_streamed(spark, sf_dir):
    """Files of any size, read strictly: each is cut into splits, and proved to be closed."""
    source = table(spark, sf_dir, "part")
    path = scratch_path(spark, "envelope")
    write_envelope(source, path, ENVELOPE, indent=True)
    return record_columns(read_envelope(spark, path, layout="indented", mode="failfast"), source.schema)


def _damaged_parts(spark, sf_dir, label: str) -> str:
    """Indented documents of all parts, and three damaged ones: cut in a record, cut after one, and with a broken record."""
    path = scratch_path(spark, label)
    write_envelope(table(spark, sf_dir, "part"), path, ENVELOPE, indent=True)
    record = '    {\n      "p_partkey": -1\n    }'
    damaged = [
        f'{{\n  "value": [\n{record},\n    {{\n      "p_partkey": -7',
        f'{{\n  "value": [\n{record}',
        f'{{\n  "value": [\n{record},\n    {{\n      "p_partkey": oops\n    }}\n  ]\n}}',
    ]
    for text in damaged:
        spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("append").text(path)
    return path


@registered("SELECT p_partkey FROM part UNION ALL SELECT -1 FROM range(3)")
def envelope_truncated(spark, sf_dir):
    """Whole records stay, also of documents that are cut off; no record is made up of a rest."""
    source = table(spark, sf_dir, "part").select("p_partkey")
    return record_columns(read_envelope(spark, _damaged_parts(spark, sf_dir, "truncated"), layout="indented"), source.schema)


@registered("SELECT CASE WHEN i < 2 THEN 'the document is not closed' ELSE 'a record' END AS reason, count(*) AS n FROM range(3) t(i) GROUP BY 1")
def envelope_rejects(spark, sf_dir):
    """What that read leaves out: two files that are cut off and a broken record."""
    found = rejected_pieces(spark, _damaged_parts(spark, sf_dir, "rejects"))
    reason = F.when(F.col("text") == "the document is not closed", F.col("text")).otherwise("a record")
    return found.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@registered("SELECT 3 AS refused, count(*) AS accepted FROM part")
def envelope_strict(spark, sf_dir):
    """Strict reads refuse each damaged document and accept the sound ones."""
    sound = scratch_path(spark, "strict")
    write_envelope(table(spark, sf_dir, "part"), sound, ENVELOPE, indent=True)
    accepted = read_envelope(spark, sound, layout="indented", mode="failfast")
    files = spark.read.format("binaryFile").load(_damaged_parts(spark, sf_dir, "refused")).where("length < 150").select("path").collect()
    refused = 0
    for file in files:
        try:
            read_envelope(spark, file.path, layout="indented", mode="failfast").write.format("noop").mode("overwrite").save()
        except (InvalidData, PySparkException, Py4JJavaError):
            refused += 1
    return accepted.agg(F.lit(refused).alias("refused"), F.count("*").alias("accepted"))


@registered("SELECT * FROM events")
def json_dir_read(spark, sf_dir):
    """A directory of documents, one of them malformed."""
    source = table(spark, sf_dir, "events")
    path = scratch_path(spark, "documents")
    write_envelope(source.repartition(8), path, ENVELOPE)
    spark.range(1).select(F.lit('{"value": [{"event_id": 1').alias("value")).write.mode("append").text(path)
    return record_columns(read_envelope(spark, path, layout="document", mode="permissive"), source.schema)


@registered(
    """
    SELECT r.origin, r.rank, count(*) AS orders, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS total
    FROM orders JOIN (VALUES ('dicts', '1-URGENT', 1), ('dicts', '2-HIGH', 2), ('pandas', '3-MEDIUM', 3),
                             ('arrow', '4-NOT SPECIFIED', 4), ('arrow', '5-LOW', 5)) r(origin, name, rank)
      ON o_orderpriority = r.name
    GROUP BY 1, 2
    """
)
def local_to_table(spark, sf_dir):
    """Rows from dicts, pandas and Arrow, used to rank the orders."""
    import pandas as pd
    import pyarrow as pa

    columns = "origin string, name string, rank bigint"
    dicts = [{"origin": "dicts", "name": n, "rank": r} for n, r in (("1-URGENT", 1), ("2-HIGH", 2))]
    frame = pd.DataFrame({"origin": ["pandas"], "name": ["3-MEDIUM"], "rank": [3]})
    arrow = pa.table({"origin": ["arrow"] * 2, "name": ["4-NOT SPECIFIED", "5-LOW"], "rank": [4, 5]})
    ranks = Q.stack(from_local(spark, dicts, columns), from_local(spark, frame, columns), from_local(spark, arrow))
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice")
    # five literal rows
    joined = orders.join(F.broadcast(ranks), F.col("o_orderpriority") == F.col("name"))
    return joined.groupBy("origin", "rank").agg(
        F.count("*").alias("orders"), Q.exact_sum(F.col("o_totalprice"), 2).alias("total")
    )


@registered(
    """
    SELECT l_orderkey, l_extendedprice, year(l_shipdate) AS year, month(l_shipdate) AS month
    FROM lineitem WHERE year(l_shipdate) > 1998 AND l_extendedprice > 100
    """
)
def partitioned_scan(spark, sf_dir):
    source = table(spark, sf_dir, "lineitem")
    shipped = source.withColumns({"year": F.year("l_shipdate"), "month": F.month("l_shipdate")})
    path = scratch_path(spark, "partitioned")
    write_parquet(shipped, path, partition_by=["year", "month"])
    scan = read_partitioned(spark, path, ["year", "month"], where="year > 1998")
    wanted = Q.where_all(scan, F.col("l_extendedprice") > 100)
    return wanted.select("l_orderkey", "l_extendedprice", "year", "month")


@registered(
    """
    SELECT o_orderkey, o_totalprice, nullif(o_orderpriority, '5-LOW') AS priority FROM orders
    WHERE nullif(o_orderpriority, '5-LOW') IS NULL OR o_orderpriority < '3'
    """
)
def partitioned_text(spark, sf_dir):
    """Partitions that are text, one of them null."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"))
    path = scratch_path(spark, "partitioned-text")
    write_parquet(orders, path, partition_by=["priority"])
    return read_partitioned(spark, path, ["priority"], where="priority IS NULL OR priority < '3'")


@registered("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-04-01'")
def feather_filtered(spark, sf_dir):
    """A quarter out of files sorted by date: the filter reaches the scan, which skips the other batches."""
    path = scratch_path(spark, "feather-sorted")
    orders = table(spark, sf_dir, "orders")
    write_arrow(orders.repartitionByRange("o_orderdate").sortWithinPartitions("o_orderdate"), path, "file", rows_per_batch=4096)
    scan = bulk_read(spark, path, "feather", columns=["o_orderkey", "o_orderdate", "o_totalprice"])
    return scan.where("o_orderdate >= timestamp_ntz'1997-01-01' AND o_orderdate < timestamp_ntz'1997-04-01'")


@registered(
    """
    SELECT l_orderkey, l_linenumber, CAST(l_partkey AS BIGINT) AS part, CAST(l_quantity AS REAL) AS half,
           l_shipdate AS shipped, CAST(l_shipdate AS DATE) AS day
    FROM lineitem
    """
)
def feather_types(spark, sf_dir):
    """Files with types that Spark lacks: unsigned and 16-bit numbers, nanoseconds, dates as milliseconds."""
    path = scratch_path(spark, "feather-types")
    source = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate")

    def write(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        for i, batch in enumerate(batches):
            key, line, part, quantity, shipped = batch.columns
            columns = {
                "l_orderkey": key.cast(pa.uint32()),
                "l_linenumber": line.cast(pa.uint8()),
                "part": part.cast(pa.uint64()),
                "half": pa.array(np.asarray(quantity).astype(np.float16)),
                "shipped": shipped.cast(pa.timestamp("ns")),
                "day": shipped.cast(pa.date32()).cast(pa.date64()),
            }
            out = pa.record_batch(columns)
            fs, folder = filesystem(path)
            fs.create_dir(folder)
            with fs.open_output_stream(f"{folder}/part-{TaskContext.get().partitionId()}-{i}.arrow") as sink:
                with pa.ipc.new_file(sink, out.schema) as writer:
                    writer.write_batch(out)
            yield pa.record_batch({"rows": pa.array([batch.num_rows], pa.int64())})

    source.mapInArrow(write, "rows bigint").agg(F.sum("rows")).collect()
    found = bulk_read(spark, path, "feather")
    return found.withColumns({c: F.col(c).cast("bigint") for c in ("l_orderkey", "l_linenumber", "part")})


@registered("SELECT count(*) AS rows_written, count(*) AS rows_read, true AS matches FROM lineitem")
def reconcile_counts(spark, sf_dir):
    source = table(spark, sf_dir, "lineitem")
    path = scratch_path(spark, "lineitem")
    write_parquet(source, path)
    return reconcile(source, bulk_read(spark, path))


@registered(
    """
    SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') AS VARCHAR) AS iso,
           o_orderdate AS parsed, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
           CAST(o_orderdate AS DATE) AS day
    FROM orders
    """
)
def time_text(spark, sf_dir):
    from batchwright.functions import iso_text, month_start, parse_iso

    orders = table(spark, sf_dir, "orders").withColumn("iso", iso_text(F.col("o_orderdate")))
    return orders.select(
        "o_orderkey",
        "iso",
        parse_iso(F.col("iso")).alias("parsed"),
        month_start(F.col("o_orderdate")).alias("month"),
        F.col("iso").cast(spark_type("TIMESTAMP")).cast("date").alias("day"),
    )


@registered(
    """
    SELECT o_orderkey % 50 AS bucket,
           CASE o_orderkey % 50 % 10 WHEN 3 THEN 'No Arrow data provided' WHEN 5 THEN 'Invalid Arrow IPC data'
                WHEN 7 THEN 'Invalid or empty Arrow table' END AS error,
           CASE WHEN o_orderkey % 50 % 10 NOT IN (3, 5, 7) THEN o_orderkey END AS o_orderkey,
           CASE WHEN o_orderkey % 50 % 10 NOT IN (3, 5, 7) THEN o_totalprice END AS o_totalprice
    FROM orders WHERE o_orderkey % 50 % 10 NOT IN (3, 5, 7) OR o_orderkey IN (SELECT min(o_orderkey) FROM orders GROUP BY o_orderkey % 50)
    """
)
def payloads(spark, sf_dir):
    """Orders as fifty Arrow payloads, some of them empty, cut off or without rows."""
    orders = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 50).alias("bucket"), "o_orderkey", "o_totalprice")

    def encode(key, rows):
        import pyarrow as pa

        bucket = key[0].as_py()
        rows = rows.select(["o_orderkey", "o_totalprice"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as writer:
            writer.write_table(rows.slice(0, 0 if bucket % 10 == 7 else None))
        body = sink.getvalue().to_pybytes()
        body = {3: b"", 5: body[:10]}.get(bucket % 10, body)
        return pa.table({"bucket": pa.array([bucket], pa.int64()), "body": pa.array([body], pa.binary())})

    sent = orders.groupBy("bucket").applyInArrow(encode, "bucket bigint, body binary")
    return decode_payloads(sent, "body", "o_orderkey bigint, o_totalprice double", keep=["bucket"])


@registered(
    """
    SELECT s AS status, CASE WHEN count(o_orderkey) = 0 THEN 'orders of status X holds no records' END AS refused, count(o_orderkey) AS n
    FROM (VALUES ('F'), ('O'), ('P'), ('X')) t(s) LEFT JOIN orders ON o_orderstatus = s GROUP BY s
    """
)
def required_rows(spark, sf_dir):
    """Work that stops where a selection is empty: there are no orders of status X."""
    orders, done = table(spark, sf_dir, "orders"), []
    for status in ("F", "O", "P", "X"):
        chosen = orders.where(F.col("o_orderstatus") == status)
        try:
            refused = F.lit(None).cast("string")
            chosen = require_rows(chosen, f"orders of status {status}")
        except EmptyInput as e:
            refused = F.lit(str(e))
        done.append(chosen.agg(F.lit(status).alias("status"), refused.alias("refused"), F.count("*").alias("n")))
    return Q.bag_union(*done)


@registered(
    """
    SELECT o_orderkey, o_totalprice, year(o_orderdate) AS year FROM orders
    WHERE year(o_orderdate) IN (SELECT year(o_orderdate) FROM orders GROUP BY 1 HAVING count(*) % 2 = 0)
    """
)
def partitioned_bare(spark, sf_dir):
    """Bare folders such as `1997/`; a join decides which of them are read."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("year"))
    path = scratch_path(spark, "partitioned-bare")
    write_parquet(orders, path, partition_by=["year"])
    for name in list_names(spark, path):
        if name.startswith("year="):
            rename(spark, f"{path}/{name}", f"{path}/{name.removeprefix('year=')}")
    even = orders.groupBy(F.col("year").cast("bigint").alias("even_year")).agg(F.count("*").alias("n")).where("n % 2 = 0")
    scan = read_partitioned(spark, path, ["year"])
    return scan.join(F.broadcast(even), F.col("year") == F.col("even_year"), "left_semi").select("o_orderkey", "o_totalprice", "year")
