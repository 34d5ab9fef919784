import hashlib
import random
import re
import time

from batchwright.llm.pii import BASE_KINDS, BASE_RULES, find, pii_report, redact
from batchwright.llm.queries import QUERIES


def check_sum(digits):
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (2 if place % 2 else 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def brute(text):
    """The base rules run over the whole text, each on its own."""
    out = []
    for kind in BASE_KINDS:
        for m in re.finditer(BASE_RULES[kind], text):
            digits = re.sub(r"[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and check_sum(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def base(text):
    return [s for s in find(text) if s[0] in BASE_KINDS]


def test_anchored_parsers_equal_whole_text_rules():
    rng = random.Random(8)
    parts = ["@", ".", "-", "a", "b1", "+", "1", "22", "255", "256", " ", "(", ")", "x@y.z", "1.2.3.4", "4111 1111 1111 1111",
             "4111111111111111", "+1 (017) 555-7713", "é", "%", "_", "0", "\n", "٣", "token = "]
    for _ in range(30000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert base(text) == brute(text), repr(text)


def test_query_equals_rules(spark, sf):
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        spans = brute(r.text or "")
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        want[r.doc_id] = (*(sum(s[0] == k for s in spans) for k in BASE_KINDS), hashlib.sha256(text.encode()).hexdigest())
    got = QUERIES["op6_pii"](spark, sf).collect()
    assert {r.doc_id: tuple(r)[1:6] for r in got} == want
    assert all(r.n_email == r.spans.count("email:") for r in got)
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in got) > 0


def test_added_kinds():
    assert [s for s in find("see https://a.example/x?y=1, ok") if s[0] == "url"] == [("url", 4, 27)]
    text = 'thst token = "04dbebab91ab85687d33eeaaf9ac699e11880000" end'
    assert [(k, text[s:e]) for k, s, e in find(text)] == [("secret", "04dbebab91ab85687d33eeaaf9ac699e11880000")]
    assert find("the account of the thing, secretly hidden") == []


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "a@b.cd"), (3, "a@b.cd"), (None, "+1 555 000 0000"), (4, "z " * 50000 + "é 1.2.3.4")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    got = sorted((tuple(r) for r in pii_report(df).collect()), key=repr)
    assert [(r[0], *r[1:5], r[6]) for r in got] == sorted(
        [(1, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, ""), (3, 1, 0, 0, 0, "email:0:6"), (3, 1, 0, 0, 0, "email:0:6"),
         (None, 0, 0, 0, 1, "phone:0:15"), (4, 0, 1, 0, 0, "ip:100002:100009")], key=repr)
    assert pii_report(df.limit(0)).collect() == []
    cleaned = {r.doc_id: r.text for r in redact(df.select("doc_id", "text")).collect()}
    assert cleaned[1] is None and cleaned[2] == "" and cleaned[3] == "[email]" and cleaned[4].endswith("é [ip]")


def test_long_texts_take_linear_time():
    for text in ("7" * 1_000_000, "1.2.3." * 160_000, "1." + "2" * 999_000, "http://" * 140_000, "token" * 200_000, "+1 " * 300_000, "a@" * 500_000, "a.b@" * 250_000):
        start = time.perf_counter()
        find(text)
        assert time.perf_counter() - start < 10, text[:20]
