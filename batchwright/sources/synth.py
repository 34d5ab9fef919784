"""Generated tables (G1-G5, G8, J3). Every value is a function of the row's id, so any
task can make any row and a retried task makes the same row again."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchwright.errors import InvalidData
from batchwright.functions import scalar as S
from batchwright.operators.position import with_row_position

CHUNK = 1_000_000
# Templates up to this size, as measured, are broadcast.
BROADCAST_TEMPLATE_BYTES = 64 * 1024 * 1024


def _volume(i: Column, start: float, step: float) -> Column:
    return S.round_cents(F.lit(start) + i.cast("double") * F.lit(step))


def production_columns(row_id: Column, start: dt.datetime, step: str, chunk: int | None) -> dict[str, Column]:
    """The 14 raw columns. Prefixes, moduli, start values and steps."""
    i = row_id if chunk is None else S.remainder(row_id, chunk)
    origin = S.literal(start)
    advance = {"second": S.plus_seconds, "hour": S.plus_hours}[step]
    return {
        "field_code": S.remainder(i, 1000),
        "_field_name": S.tagged("Field_", S.remainder(i, 1000)),
        "well_code": S.remainder(i, 100),
        "_well_reference": S.tagged_padded("WELL_REF_", S.remainder(i, 100), 3),
        "well_name": S.tagged("Well_", S.remainder(i, 100)),
        "production_period": S.iso_text(advance(origin, row_id)),
        "days_on_production": F.lit(30).cast("bigint"),
        "oil_production_kbd": _volume(i, 100.0, 0.1),
        "gas_production_mmcfd": _volume(i, 50.0, 0.05),
        "liquids_production_kbd": _volume(i, 25.0, 0.025),
        "water_production_kbd": _volume(i, 75.0, 0.075),
        "data_source": F.lit("performance_test"),
        "source_data": S.json_payload(i),
        "partition_0": S.tagged("partition_", S.remainder(i, 10)),
    }


def production_rows(
    ids: DataFrame,
    row_id: str = "id",
    start: dt.datetime = dt.datetime(2024, 1, 1),
    step: str = "second",
    chunk: int | None = CHUNK,
    with_audit: bool = False,
) -> DataFrame:
    """One production row per row of `ids` (G3); with `with_audit` the columns id (uuid),
    created_at and version come first and the chunk repeat is usually off (G1, G2)."""
    columns = production_columns(F.col(f"`{row_id}`").cast("bigint"), start, step, chunk)
    audit = {"id": S.random_uuid(), "created_at": S.now_ntz(), "version": F.lit(1).cast("bigint")} if with_audit else {}
    return ids.select(*[c.alias(n) for n, c in (audit | columns).items()])


def synth(
    spark: SparkSession,
    n: int,
    start: dt.datetime = dt.datetime(2024, 1, 1),
    step: str = "second",
    chunk: int | None = CHUNK,
    with_audit: bool = False,
) -> DataFrame:
    """`n` production rows."""
    return production_rows(spark.range(n), "id", start, step, chunk, with_audit)


def expand_templates(templates: DataFrame, n: int, order: Sequence[str], name: str = "variation") -> DataFrame:
    """`n` rows out of m templates: n // m copies each, one more for the first n % m in
    `order` (J3). Adds `name`, the 0-based number of the row among all n, counted
    template by template.

    The rows start from a range that Spark splits evenly, and each number knows its
    template, so a few templates with many copies each do not end up in a few tasks.
    """
    placed = with_row_position(templates, order, "__position")
    width = F.octet_length(F.to_json(F.struct(*[f"`{c}`" for c in templates.columns])))
    m, size = placed.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    if m == 0:
        raise InvalidData("there are no templates to expand")
    base, extra = divmod(n, m)
    longer = extra * (base + 1)  # rows of the templates that get one copy more
    number = F.col(f"`{name}`")
    position = F.when(number < longer, F.floor(number / (base + 1)))
    if base:
        position = position.otherwise(extra + F.floor((number - longer) / base))
    numbered = templates.sparkSession.range(n).select(F.col("id").alias(name)).withColumn("__position", position)
    # Either way gives the same rows; above the bound the join is left to Spark.
    placed = F.broadcast(placed) if size <= BROADCAST_TEMPLATE_BYTES else placed
    return numbered.join(placed, "__position").select(*[f"`{c}`" for c in templates.columns], number)


# Ranges of the varied columns.
FIELD_CODES = (1, 10_000)
WELL_CODES = (1_000, 99_999)
FIRST_MONTH, LAST_MONTH = dt.date(1947, 1, 1), dt.date(2023, 12, 1)
DEFAULT_SOURCE = "Brazil - Agência Nacional do Petróleo (ANP)"

FIELDS = FIELD_CODES[1] - FIELD_CODES[0] + 1
WELLS = WELL_CODES[1] - WELL_CODES[0] + 1
MONTHS = (LAST_MONTH.year - FIRST_MONTH.year + 1) * 12
KEY_SPACE = FIELDS * WELLS * MONTHS
VARIED = (
    "field_code", "_field_name", "well_code", "_well_reference", "well_name", "production_period", "days_on_production",
    "oil_production_kbd", "gas_production_mmcfd", "liquids_production_kbd", "water_production_kbd", "data_source", "partition_0",
)
KEY_STRIDE = 7_368_787  # prime and not a factor of KEY_SPACE, so multiples do not repeat


def synth_variations(
    templates: DataFrame, n: int, order: Sequence[str], seed: int = 0, source: str | None = None
) -> DataFrame:
    """`n` varied records from the templates (G4), keys never repeating.

    The key comes from the row number through a one-to-one map into the space of
    (field, well, month), so the closed-form duplicate counts always hold. `source` names
    the template column with the data source, in which an explicit null stays null; without
    it the default is used. Columns of the template that are not varied follow as they are.
    """
    if n > KEY_SPACE:
        raise InvalidData(f"there are only {KEY_SPACE} distinct keys")
    rows = expand_templates(templates, n, order, "__n")
    number = F.col("__n")
    offset = F.pmod(F.xxhash64(F.lit(seed)), F.lit(KEY_SPACE))
    slot = F.pmod(F.pmod(number * F.lit(KEY_STRIDE), F.lit(KEY_SPACE)) + offset, F.lit(KEY_SPACE))
    field = F.pmod(slot, F.lit(FIELDS)) + FIELD_CODES[0]
    well = F.pmod(F.floor(slot / FIELDS), F.lit(WELLS)) + WELL_CODES[0]
    month = F.floor(slot / (FIELDS * WELLS))
    period = F.add_months(F.lit(FIRST_MONTH), month.cast("int"))
    digit = [S.hash_int(seed, number, f"ref{k}", 1, 9).cast("string") for k in (1, 2)]
    reference = F.concat_ws("-", digit[0], S.capital_letter(seed, number, "letter"), digit[1], F.lit("BA"))
    varied = [
        field.alias("field_code"),
        S.tagged("Field_number_", field).alias("_field_name"),
        well.alias("well_code"),
        reference.alias("_well_reference"),
        reference.alias("well_name"),
        S.iso_text(S.month_start(period).cast("timestamp_ntz")).alias("production_period"),
        S.hash_int(seed, number, "days", 1, 31).alias("days_on_production"),
        S.hash_real(seed, number, "oil", 10, 8).alias("oil_production_kbd"),
        S.hash_real(seed, number, "gas", 100, 7).alias("gas_production_mmcfd"),
        S.hash_real(seed, number, "liquids", 5, 8).alias("liquids_production_kbd"),
        S.hash_real(seed, number, "water", 20, 8).alias("water_production_kbd"),
        (F.col(f"`{source}`") if source else F.lit(DEFAULT_SOURCE)).alias("data_source"),
        F.lit("latest").alias("partition_0"),
    ]
    return rows.select(*varied, *[f"`{c}`" for c in templates.columns if c not in VARIED])


def inject_duplicates(df: DataFrame, order: Sequence[str], extra: int = 1) -> DataFrame:
    """Every row twice, and `extra` more copies of the first row in `order` (G5): k rows
    become 2k + extra."""
    first = df.orderBy(*[f"`{o}`" for o in order]).limit(1)
    copies = first.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.lit(extra)))).drop("__copy")
    doubled = df.unionAll(df)
    return doubled.unionAll(copies) if extra else doubled


def category_rows(ids: DataFrame, row_id: str, total: int) -> DataFrame:
    """category, value: value is the row number, the first half of them in A, the next
    three tenths in B, the rest in C (G8)."""
    value = F.col(f"`{row_id}`").cast("bigint")
    category = F.when(value * 10 < total * 5, "A").when(value * 10 < total * 8, "B").otherwise("C")
    return ids.select(category.alias("category"), value.alias("value"))


def category_table(spark: SparkSession, n: int = 1_000_000) -> DataFrame:
    return category_rows(spark.range(n), "id", n)
