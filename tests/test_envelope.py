import json
from decimal import Decimal

import pytest
from conftest import rows
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from batchwright.errors import DatasetNotFound, InvalidData
from batchwright.sinks.files import write_envelope, write_parquet
from batchwright.sources import envelope as E

RECORDS = [
    {"a": 1, "t": "Agência", "n": {"x": [1, {"y": 2}]}, "e": []},
    {},
    {"a": None, "t": "line\nbreak }, {", "n": {}},
    {},
    {"a": 4, "b": {"c": {"d": 1}}},
]


def save(path, data, indent=2):
    path.write_text(json.dumps(data, ensure_ascii=False, indent=indent), encoding="utf-8")
    return str(path)


def records(df):
    got = df.orderBy("ordinal").select(F.to_json("record").alias("j")).collect()
    return [json.loads(r.j) for r in got]


@pytest.mark.parametrize("layout", ["document", "indented"])
@pytest.mark.parametrize("value", [RECORDS, RECORDS[:1], [{}], [{}, {}], []])
def test_R8_pretty_printed_documents(spark, tmp_path, layout, value):
    path = save(tmp_path / "x.json", {"@odata.context": "c", "value": value})
    assert records(E.read_envelope(spark, path, layout=layout, mode="failfast")) == value


def test_R8_compact_document_and_missing_key(spark, tmp_path):
    path = save(tmp_path / "x.json", {"@odata.context": "c", "value": RECORDS}, indent=None)
    assert records(E.read_envelope(spark, path)) == RECORDS
    kept = E.read_envelope(spark, path, keep=["@odata.context"])
    assert {r[0] for r in kept.select("`@odata.context`").collect()} == {"c"}
    assert records(E.read_envelope(spark, save(tmp_path / "y.json", {"other": 1}))) == []
    with pytest.raises(PySparkException, match="not an indented envelope"):
        E.read_envelope(spark, path, layout="indented").collect()


def test_R8_indented_document_is_split(spark, tmp_path, setting):
    value = [{"i": i, "t": "Agência" * (i % 7), "n": {"k": [i]}} for i in range(3000)]
    path = save(tmp_path / "x.json", {"@odata.context": "c", "value": value})
    setting("spark.sql.files.maxPartitionBytes", "20000")
    df = E.read_envelope(spark, path, layout="indented", mode="failfast")
    assert df.rdd.getNumPartitions() > 5
    assert records(df) == value


@pytest.mark.parametrize("indent,layout", [(False, "lines"), (False, "document"), (True, "indented"), (True, "document")])
def test_W5_round_trip_in_splits(spark, table, tmp_path, setting, indent, layout):
    source = table("events").repartition(2)
    path = str(tmp_path / "out")
    write_envelope(source, path, {"@odata.context": "Agência", "n": 1}, indent=indent)
    for part in (tmp_path / "out").glob("part-*"):
        document = json.loads(part.read_text(encoding="utf-8"))
        assert document["@odata.context"] == "Agência" and list(document) == ["@odata.context", "n", "value"]
        assert "Agência" in part.read_text(encoding="utf-8")
    setting("spark.sql.files.maxPartitionBytes", "10000")
    back = E.read_envelope(spark, path, layout=layout, mode="failfast")
    if layout != "document":
        assert back.rdd.getNumPartitions() > 4
    assert rows(E.record_columns(back, source.schema)) == rows(source)


def test_W5_same_text_as_a_plain_dump(spark, tmp_path):
    df = spark.createDataFrame([(1, "Ã", None), (2, 'q"', 1.5)], "a bigint, t string, x double").coalesce(1)
    write_envelope(df, str(tmp_path / "out"), {"@odata.context": "c"}, indent=True)
    (part,) = (tmp_path / "out").glob("part-*")
    want = {"@odata.context": "c", "value": [{"a": 1, "t": "Ã", "x": None}, {"a": 2, "t": 'q"', "x": 1.5}]}
    assert part.read_text(encoding="utf-8").rstrip("\n") == json.dumps(want, ensure_ascii=False, indent=2)


def test_W5_flat_records_with_odd_texts(spark, tmp_path):
    value = [{"a b": 'x" : y', "t": 'line\nbreak\n  "k" : {', "n": None, "x": 1.5}, {"a b": "\\", "t": "", "n": 3, "x": None}]
    df = spark.createDataFrame([tuple(v.values()) for v in value], "`a b` string, t string, n bigint, x double").coalesce(1)
    write_envelope(df, str(tmp_path / "out"), indent=True)
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_text(encoding="utf-8").rstrip("\n") == json.dumps({"value": value}, indent=2)


def test_W5_empty(spark, tmp_path):
    write_envelope(spark.range(0), str(tmp_path / "out"))
    assert E.read_envelope(spark, str(tmp_path / "out"), layout="lines").count() == 0


def test_R9_permissive(spark, tmp_path):
    missing = E.read_envelope(spark, str(tmp_path / "none"), keep=["k"])
    assert missing.columns == ["ordinal", "record", "k"] and missing.isEmpty()
    save(tmp_path / "good.json", {"value": RECORDS})
    (tmp_path / "bad.json").write_text('{"value": [{"a": 1')
    assert records(E.read_envelope(spark, str(tmp_path))) == RECORDS
    (bad,) = E.corrupt_documents(spark, str(tmp_path)).collect()
    assert bad.file.endswith("/bad.json")


def test_R10_failfast(spark, tmp_path):
    for layout in ("document", "lines", "indented"):
        with pytest.raises(DatasetNotFound):
            E.read_envelope(spark, str(tmp_path / "none"), layout=layout, mode="failfast")
    (tmp_path / "bad.json").write_text('{"value": [{"a": 1')
    with pytest.raises((PySparkException, Py4JJavaError), match="Malformed|MALFORMED|FAILED_READ_FILE"):
        E.read_envelope(spark, str(tmp_path / "bad.json"), mode="failfast").collect()
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{"a": \n')
    with pytest.raises((PySparkException, Py4JJavaError), match="MALFORMED_RECORD"):
        E.read_envelope(spark, str(tmp_path / "bad.jsonl"), layout="lines", mode="failfast").collect()
    assert records(E.read_envelope(spark, str(tmp_path / "bad.jsonl"), layout="lines")) == [{"a": 1}]


def test_R11_directory(spark, tmp_path):
    save(tmp_path / "a.json", {"value": [{"a": 1}]})
    save(tmp_path / "b.json", {"value": [{"a": 2}]})
    (tmp_path / "c.txt").write_text("not json")
    assert records(E.read_envelope(spark, str(tmp_path), glob="*.json", mode="failfast")) == [{"a": 1}, {"a": 2}]


def test_R8_lines_lose_nothing(spark, tmp_path):
    path = tmp_path / "x.json"

    def read(text, mode="failfast", key="value"):
        path.write_text(text)
        return records(E.read_envelope(spark, str(path), key, "lines", mode))

    assert read('{"@odata.context": "c", "value": [{"a": 1}, {"a": 2}]}') == [{"a": 1}, {"a": 2}]
    assert read('{"value": [\n{"a": 1},\n{"a": 2}\n], "next": "n"}') == [{"a": 1}, {"a": 2}]
    assert read('[\n{"a": 1},\n{"a": 2}\n]', key=None) == [{"a": 1}, {"a": 2}]
    for text in ('{"value": [\n{"a": 1},\n{"a": \n{"a": 3}\n]}', '{"value": [\n{"a": 1},\n{"a": 2}', '{"value": [{"a": 1},\n{"a": 2}\n]}'):
        with pytest.raises((PySparkException, Py4JJavaError, InvalidData), match="MALFORMED_RECORD"):
            read(text)
    assert read('{"value": [{"a": 1},\n{"a": 2}\n]}', "permissive") == [{"a": 2}]
    assert [r.text for r in E.rejected_lines(spark, str(path)).collect()] == ['{"value": [{"a": 1},']


def test_R8_indents_of_any_kind(spark, tmp_path):
    data = {"@odata.context": "c", "value": [{"a": 1, "n": {"b": [1]}}, {}, {"a": 2}]}
    for indent in (1, 4, "\t"):
        path = save(tmp_path / "x.json", data, indent)
        assert records(E.read_envelope(spark, path, layout="indented", mode="failfast")) == data["value"]
    path = save(tmp_path / "y.json", data | {"links": [{"h": 1}]})
    with pytest.raises(PySparkException, match="not an indented envelope"):
        E.read_envelope(spark, path, layout="indented", mode="failfast").collect()
    path = save(tmp_path / "z.json", {"other": [{"a": 1}]})
    with pytest.raises(InvalidData, match="no list 'value'"):
        E.read_envelope(spark, path, layout="indented", mode="failfast").collect()


def test_values_keep_their_digits_or_fail(spark, tmp_path):
    text = '{"value": [{"i": 9007199254740993.0, "d": 1234567890123456789.123456789012345678, "t": null}]}'
    (tmp_path / "x.json").write_text(text)
    df = E.read_envelope(spark, str(tmp_path / "x.json"), mode="failfast")
    schema = spark.createDataFrame([], "i bigint, d decimal(38,18), t date").schema
    assert rows(E.record_columns(df, schema)) == [(9007199254740993, Decimal("1234567890123456789.123456789012345678"), None)]
    write_envelope(df, str(tmp_path / "out"), record="record", indent=True)
    back = E.read_envelope(spark, str(tmp_path / "out"), layout="indented", mode="failfast")
    assert rows(E.record_columns(back, schema)) == rows(E.record_columns(df, schema))
    for kind, value in (("bigint", '"thirty"'), ("bigint", "[1]"), ("double", '"abc"'), ("date", '"2024-13-01"')):
        (tmp_path / "y.json").write_text(f'{{"value": [{{"x": {value}}}]}}')
        bad = E.record_columns(E.read_envelope(spark, str(tmp_path / "y.json")), spark.createDataFrame([], f"x {kind}").schema)
        with pytest.raises((PySparkException, Py4JJavaError), match="column 'x': cannot convert"):
            bad.collect()


def test_W1_W2_codecs(spark, table, tmp_path):
    import pyarrow.parquet as pq

    for name, args, codec in (("a", {}, "SNAPPY"), ("b", {"codec": "zstd", "level": 1}, "ZSTD")):
        path = tmp_path / name
        write_parquet(table("part"), str(path), **args)
        (part,) = path.glob("part-*")
        assert pq.ParquetFile(part).metadata.row_group(0).column(0).compression == codec
        assert rows(spark.read.parquet(str(path))) == rows(table("part"))
    with pytest.raises(InvalidData):
        write_parquet(table("part"), str(tmp_path / "c"), codec="gzip", level=1)


CUT = json.dumps({"c": 1, "value": [{"a": i, "t": 'x { ] " y'} for i in range(3)], "z": [1]}, indent=2)


@pytest.mark.parametrize("at", range(0, len(CUT), 9))
def test_R10_a_document_cut_off_anywhere_is_refused(spark, tmp_path, at):
    """Failfast refuses it; a permissive read keeps the records before the cut and counts one reject."""
    (tmp_path / "cut.json").write_text(CUT[:at])
    path = str(tmp_path / "cut.json")
    whole = CUT[:at].count('"\n    }')
    if CUT[:at].strip():
        with pytest.raises((InvalidData, PySparkException)):
            E.read_envelope(spark, path, layout="indented", mode="failfast").collect()
        assert E.rejected_pieces(spark, path).count() == 1
    assert [r["a"] for r in records(E.read_envelope(spark, path, layout="indented"))] == list(range(whole))


def test_R9_rejects_of_the_indented_layout(spark, tmp_path):
    save(tmp_path / "a.json", {"value": [{"a": 1}, {"a": 2}]})
    broken = json.dumps({"value": [{"a": 3}, {"a": "?"}, {"a": 4}]}, indent=2).replace('"?"', "oops")
    (tmp_path / "b.json").write_text(broken)
    assert sorted(r["a"] for r in records(E.read_envelope(spark, str(tmp_path), layout="indented"))) == [1, 2, 3, 4]
    got = E.rejected_pieces(spark, str(tmp_path)).collect()
    assert len(got) == 1 and got[0].file.endswith("b.json") and "oops" in got[0].text
    assert E.open_ended(spark, str(tmp_path)).collect() == []


def test_open_strings_and_brackets_inside_strings(spark, tmp_path):
    texts = {"ok": json.dumps({"a": ']}{"', "b": "\\"}), "string": '{"a": "x}', "extra": '{"a": 1}}', "list": '[{"a": "["}'}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    assert sorted(r.file.rsplit("/", 1)[1] for r in E.open_ended(spark, str(tmp_path)).collect()) == ["extra", "list", "string"]
