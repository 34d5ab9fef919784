import json

import pytest
from conftest import rows

from batchwright.errors import EmptyInput, InvalidData, SchemaNotFound
from batchwright.operators import envelopes as W
from batchwright.schema import get_schema, read_table
from batchwright.sources import envelope as E
from batchwright.sources.envelope import envelope_fields, read_envelope

WELLS = get_schema("well_production")


def record(i, **more):
    return {"field_code": i, "well_code": 1, "production_period": "2024-01-01T00:00:00+00:00", "_field_name": f"F{i}"} | more


def save(path, data, indent=None):
    path.write_text(json.dumps(data, ensure_ascii=False, indent=indent), encoding="utf-8")
    return str(path)


@pytest.mark.parametrize("indent,layout", [(None, "document"), (2, "document"), (2, "indented")])
def test_W9_bare_list(spark, tmp_path, indent, layout):
    value = [record(1), {}, record(2, n={"x": [{"y": 1}]})]
    path = save(tmp_path / "x.json", value, indent)
    df = read_envelope(spark, path, key=None, layout=layout, mode="failfast").orderBy("ordinal")
    assert [json.loads(r[0]) for r in df.selectExpr("to_json(record)").collect()] == value


def test_W9_both_routes_load_the_same_rows(spark, tmp_path):
    value = [record(1), record(2), record(1, _field_name="again"), record(3, days_on_production=None)]
    fast = str(tmp_path / "fast")
    result = W.load_records(spark, save(tmp_path / "a.json", value), fast, key=None)
    assert (result.success, result.records_processed, result.inserted, result.skipped) == (True, 4, 3, 1)
    slow = W.load_request(spark, save(tmp_path / "b.json", {"schema_name": "well_production", "data": value}), str(tmp_path))
    assert slow == result
    loaded = read_table(spark, WELLS, fast)
    assert rows(loaded) == rows(read_table(spark, WELLS, str(tmp_path / "well_production")))
    assert [r.field_name for r in loaded.orderBy("field_code").collect()] == ["F1", "F2", "F3"]
    assert [r.days_on_production for r in loaded.orderBy("field_code").collect()] == [0, 0, None]


def test_V8_nothing_to_load(spark, tmp_path):
    with pytest.raises(EmptyInput):
        W.load_records(spark, str(tmp_path / "none.json"), str(tmp_path / "t"))
    with pytest.raises(EmptyInput):
        W.load_records(spark, save(tmp_path / "x.json", {"value": []}), str(tmp_path / "t"))
    with pytest.raises(EmptyInput):
        W.load_request(spark, save(tmp_path / "y.json", {"schema_name": "well_production", "data": []}), str(tmp_path))
    with pytest.raises(SchemaNotFound):
        W.load_request(spark, save(tmp_path / "z.json", {"schema_name": "nope", "data": [{}]}), str(tmp_path))


def written(spark, path):
    df = read_envelope(spark, path, layout="lines", mode="failfast")
    return sorted((json.loads(r[0]) for r in df.selectExpr("to_json(record)").collect()), key=json.dumps)


def test_D1_W5_envelope_to_envelope(spark, tmp_path):
    value = [record(1, extra="Agência"), record(2), record(1, extra="late"), {"well_code": 1}, {"field_code": None, "well_code": 1}]
    source = save(tmp_path / "x.json", {"@odata.context": "ç", "n": {"a": 1}, "value": value}, 2)
    report = W.dedupe_envelope(spark, source, str(tmp_path / "out")).first()
    assert tuple(report)[:3] == (5, 3, 2) and report.reduction_percent == 40.0
    assert written(spark, str(tmp_path / "out")) == sorted([value[0], value[1], value[3]], key=json.dumps)
    for part in (tmp_path / "out").glob("part-*"):
        document = json.loads(part.read_text(encoding="utf-8"))
        assert {k: v for k, v in document.items() if k != "value"} == {"@odata.context": "ç", "n": {"a": 1}}
    assert envelope_fields(spark, source) == {"@odata.context": "ç", "n": {"a": 1}}


def test_W5_envelopes_are_kept_or_refused(spark, tmp_path):
    for name, context in (("a", "A"), ("b", "A")):
        save(tmp_path / f"{name}.json", {"@odata.context": context, "value": [record(1), record(2)]}, 2)
    for layout in ("document", "indented"):
        out = tmp_path / f"out-{layout}"
        assert tuple(W.dedupe_envelope(spark, str(tmp_path / "?.json"), str(out), layout=layout).first())[:3] == (4, 2, 2)
        kept = {k: v for part in out.glob("part-*") for k, v in json.loads(part.read_text()).items() if k != "value"}
        assert kept == {"@odata.context": "A"}
    assert envelope_fields(spark, str(tmp_path / "out-document"), layout="lines") == {"@odata.context": "A"}
    save(tmp_path / "b.json", {"@odata.context": "B", "@odata.nextLink": "n", "value": [record(3)]})
    with pytest.raises(InvalidData, match="envelopes .* differ"):
        W.dedupe_envelope(spark, str(tmp_path / "?.json"), str(tmp_path / "out2"))


def test_W9_rejects_are_counted_and_bad_values_fail(spark, tmp_path):
    lines = [json.dumps(record(1)), '{"field_code": ', json.dumps(record(2)), "nonsense"]
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    result = W.load_records(spark, str(tmp_path / "x.jsonl"), str(tmp_path / "t"), layout="lines")
    assert (result.inserted, result.rejected) == (2, 2)
    path = save(tmp_path / "y.json", {"value": [record(1, days_on_production="thirty")]})
    with pytest.raises(Exception, match="days_on_production"):
        W.load_records(spark, path, str(tmp_path / "t2"))


def test_D2_no_key_fields(spark, tmp_path):
    value = [{"a": 1, "b": 2}, {"b": 2, "a": 1}, {"a": 1, "b": 3}, {"a": 1}, {"a": 1, "b": None}]
    source = save(tmp_path / "x.json", {"value": value})
    assert tuple(W.dedupe_envelope(spark, source, str(tmp_path / "out")).first())[:3] == (5, 3, 2)
    assert written(spark, str(tmp_path / "out")) == sorted([value[0], value[2], value[3]], key=json.dumps)
    bare = save(tmp_path / "y.json", {"value": [{}, {}]})
    assert tuple(W.dedupe_envelope(spark, bare, str(tmp_path / "out2")).first())[:3] == (2, 1, 1)


def test_D3_empty_envelope(spark, tmp_path):
    source = save(tmp_path / "x.json", {"@odata.context": "c", "value": []})
    assert tuple(W.dedupe_envelope(spark, source, str(tmp_path / "out")).first()) == (0, 0, 0, 0.0)
    assert written(spark, str(tmp_path / "out")) == []


def test_W9_rejects_of_indented_documents_are_counted(spark, tmp_path):
    text = json.dumps({"value": [record(i) for i in range(4)]}, indent=2)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(text)
    (tmp_path / "in" / "b.json").write_text(text.replace('"field_code": ', '"field_code": 1')[: text.index("F2")])
    result = W.load_records(spark, str(tmp_path / "in"), str(tmp_path / "t"), layout="indented")
    assert (result.inserted, result.rejected) == (6, 1)


@pytest.mark.parametrize("key", ["value", None])
def test_W9_rejected_documents_are_counted_as_the_batch_is_staged(spark, tmp_path, monkeypatch, key):
    for name in ("rejected_lines", "rejected_pieces", "corrupt_documents"):
        monkeypatch.setattr(E, name, None)
    (tmp_path / "in").mkdir()
    for i in range(3):
        value = [record(2 * i), record(2 * i + 1)]
        save(tmp_path / "in" / f"{i}.json", {"value": value} if key else value)
    (tmp_path / "in" / "cut.json").write_text("{" if key else "nothing")
    (tmp_path / "in" / "empty.json").write_text("")
    result = W.load_records(spark, str(tmp_path / "in"), str(tmp_path / "t"), key=key)
    assert (result.inserted, result.rejected) == (6, 1)
    assert W.load_records(spark, str(tmp_path / "in" / "1.json"), str(tmp_path / "t"), key=key, mode="failfast").rejected == 0


def test_D2_free_form_records_have_one_key_column(spark, tmp_path):
    value = [{f"f{i % 300}": 1, "n": {"b": 1, "a": [2]}} for i in range(450)] + [{"n": {"a": [2], "b": 1}, "f7": 1, "z": None}]
    source = save(tmp_path / "x.json", {"value": value})
    keyed, columns = W.keyed_records(read_envelope(spark, source))
    assert columns == ["__key_0"] and keyed.select("__key_0").distinct().count() == 300
    assert tuple(W.dedupe_envelope(spark, source, str(tmp_path / "out")).first())[:3] == (451, 300, 151)
