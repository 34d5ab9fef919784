import pytest
from pyspark.sql import types as T

from batchwright import schema as S
from batchwright.errors import SchemaNotFound, SchemaValidation


def test_S1_registry():
    well = S.get_schema("well_production")
    assert well.primary_key == ("field_code", "well_code", "production_period")
    assert len(well.names) == 14
    aliases = S.get_schema("fields_aliases")
    assert aliases.table_name == "fields_prices" and aliases.names == ["field_code", "field_name"]
    assert [p.required for p in aliases.properties] == [True, True]


def test_S2_unknown_name():
    with pytest.raises(SchemaNotFound):
        S.get_schema("doesnotexist")


def test_S3_types():
    assert S.spark_type("BIGINT") == T.LongType()
    assert S.spark_type("DOUBLE") == T.DoubleType()
    assert S.spark_type("TIMESTAMP") == T.TimestampNTZType()
    assert S.spark_type("HUGEINT") == T.StringType()


def test_S4_struct_and_table(spark, tmp_path):
    well = S.get_schema("well_production")
    struct = well.to_struct()
    assert [f.name for f in struct if not f.nullable] == list(well.primary_key)
    path = str(tmp_path / "t")
    assert S.create_table(spark, well, path, "wells_s4").count() == 0
    stored = spark.table("wells_s4")
    assert stored.columns == well.names
    assert stored.schema["production_period"].dataType == T.TimestampNTZType()
    properties = {r.key: r.value for r in spark.sql("SHOW TBLPROPERTIES wells_s4").collect()}
    assert properties["primary_key"] == "field_code,well_code,production_period"
    spark.sql("DROP TABLE wells_s4")


def test_S4_required_is_not_stored():
    aliases = S.get_schema("fields_aliases").to_struct()
    assert aliases["field_name"].nullable and aliases["field_name"].metadata["required"]


def test_bad_definitions():
    with pytest.raises(SchemaValidation):
        S.define("x", [("a", "string", "VARCHAR")], ["b"], "x", "")
    with pytest.raises(SchemaValidation):
        S.TableSchema("x", (S.Property("a"), S.Property("a")))
