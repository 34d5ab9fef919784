import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from batchwright.errors import EmptyInput, InvalidData, SchemaValidation
from batchwright.operators import records as R
from batchwright.schema import Property, TableSchema, get_schema


def parsed(spark, items):
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(items)], "i bigint, t string")
    return df.select("i", F.parse_json("t").alias("record"))


def test_P1_alias_default_and_null(spark):
    items = [
        {"_field_name": "raw", "field_name": "canonical", "field_code": 1},
        {"field_name": "canonical", "field_code": "7"},
        {},
        {"_field_name": None, "field_name": "canonical", "partition_0": None, "oil_production_kbd": None},
        {"field_code": 3.0, "oil_production_kbd": 2, "source_data": {"a": 1}, "production_period": "2024-01-01"},
    ]
    got = R.normalize(parsed(spark, items)).orderBy("i").collect()
    assert [r.field_name for r in got] == ["raw", "canonical", "", None, ""]
    assert [r.field_code for r in got] == [1, 7, None, None, 3]
    assert [r.partition_0 for r in got] == ["latest", "latest", "latest", None, "latest"]
    assert [r.oil_production_kbd for r in got] == [0.0, 0.0, 0.0, None, 2.0]
    assert [r.days_on_production for r in got] == [0] * 5
    assert [r.production_period for r in got] == ["", "", "", "", "2024-01-01"]
    assert got[4].source_data == '{"a":1}'
    assert R.normalize(parsed(spark, items)).columns[1:] == get_schema("well_production").names


SCHEMA = TableSchema(
    "s",
    (
        Property("s", "string", required=True),
        Property("i", "integer", required=True),
        Property("n", "number"),
        Property("b", "boolean"),
        Property("a", "array"),
        Property("o", "object"),
    ),
)

# (field, value, message); None: the value is accepted. Messages name types as JSON readers do.
TYPE_TABLE = [
    ("s", "x", None),
    ("s", 1, "Field 's' expected string, got int"),
    ("s", 2.5, "Field 's' expected string, got float"),
    ("s", True, "Field 's' expected string, got bool"),
    ("s", None, "Field 's' expected string, got NoneType"),
    ("s", [1], "Field 's' expected string, got list"),
    ("s", {"k": 1}, "Field 's' expected string, got dict"),
    ("i", 1, None),
    ("i", -(2**63), None),
    ("i", 12345678901, None),
    ("i", True, None),
    ("i", 1.0, "Field 'i' expected integer, got float"),
    ("i", 1e3, "Field 'i' expected integer, got float"),
    ("i", "1", "Field 'i' expected integer, got str"),
    ("i", None, "Field 'i' expected integer, got NoneType"),
    ("n", 1, None),
    ("n", 2.5, None),
    ("n", True, None),
    ("n", "2.5", "Field 'n' expected number, got str"),
    ("n", None, "Field 'n' expected number, got NoneType"),
    ("n", [1], "Field 'n' expected number, got list"),
    ("b", True, None),
    ("b", 1, "Field 'b' expected boolean, got int"),
    ("b", "true", "Field 'b' expected boolean, got str"),
    ("b", None, "Field 'b' expected boolean, got NoneType"),
    ("a", [1], None),
    ("a", [], None),
    ("a", {"k": 1}, "Field 'a' expected array, got dict"),
    ("a", "x", "Field 'a' expected array, got str"),
    ("a", None, "Field 'a' expected array, got NoneType"),
    ("o", {"k": 1}, None),
    ("o", [1], "Field 'o' expected object, got list"),
    ("o", 3, "Field 'o' expected object, got int"),
    ("o", None, "Field 'o' expected object, got NoneType"),
]

# Absent required fields are told first, and all of them; of wrong types only the first in schema order.
RECORD_TABLE = [
    ({}, "Missing required fields: s, i"),
    ({"s": 1}, "Missing required fields: i"),
    ({"i": "x"}, "Missing required fields: s"),
    ({"o": 3, "i": 1}, "Missing required fields: s"),
    ({"s": "x", "i": 1}, None),
    ({"s": "x", "i": 1, "unknown": []}, None),
    ({"s": "x", "i": 1, "o": 3, "b": 0}, "Field 'b' expected boolean, got int"),
    ({"o": 3, "n": "x", "i": 1, "s": "x"}, "Field 'n' expected number, got str"),
    ({"s": 5, "i": "x", "n": "x"}, "Field 's' expected string, got int"),
]


def test_V1_V2_every_type_pair(spark):
    table = RECORD_TABLE + [({"s": "x", "i": 1} | {name: value}, message) for name, value, message in TYPE_TABLE]
    got = R.validate(parsed(spark, [record for record, _ in table]), SCHEMA).orderBy("i").collect()
    assert [r.error for r in got] == [message for _, message in table]


def test_V2_modes(spark):
    df = parsed(spark, [{"s": "x", "i": 1}, {"s": 2, "i": 1}])
    assert [r.i for r in R.validate(df, SCHEMA, mode="good").collect()] == [0]
    assert [r.error for r in R.validate(df, SCHEMA, mode="bad").collect()] == ["Field 's' expected string, got int"]
    with pytest.raises(PySparkException, match="expected string, got int"):
        R.validate(df, SCHEMA, mode="raise").collect()
    with pytest.raises(InvalidData):
        R.validate(df, SCHEMA, mode="other")
    with pytest.raises(SchemaValidation):
        R.validate(df, TableSchema("x", (Property("s", "text"),)))


def test_V1_typed_rows_and_no_required_fields(spark):
    loose = TableSchema("x", (Property("n", "number"),))
    df = R.as_records(spark.createDataFrame([(1.5,), (None,)], "n double"))
    assert {r.error for r in R.validate(df, loose).collect()} == {None, "Field 'n' expected number, got NoneType"}


def test_V8_empty(spark):
    with pytest.raises(EmptyInput):
        R.require_rows(spark.range(0))
    assert R.require_rows(spark.range(1)).count() == 1
