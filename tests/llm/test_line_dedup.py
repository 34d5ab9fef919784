import hashlib
import random
import re
from collections import defaultdict

import pytest

from batchwright.llm.line_dedup import dedup_lines, generalised, held_lines, line_report, line_table, numbered, recurring_lines
from batchwright.llm.queries import QUERIES


def mask(line):
    return re.sub(r"[^ 0-9]*[0-9][^ ]*", "<*>", line.strip(" "))


def leaf(line):
    tokens = line.split(" ")
    return " ".join([str(len(tokens)), *tokens[:3]])


def recurs(places):
    """places: (document, fingerprint) of each line or template; copies of a document are one."""
    prints, documents = {p for _, p in places}, {d for d, _ in places}
    return len(prints) >= 3 and 2 * len(prints) >= len(documents)


def brute(rows):
    where = defaultdict(list)
    for _, text in rows:
        lines = {mask(x) for x in (text or "").split("\n")} - {""}
        for line in lines:
            others = {hashlib.md5(leaf(x).encode()).hexdigest()[:16] for x in lines if leaf(x) != leaf(line)}
            where[line].append((frozenset(lines), min(others, default="")))
    dropped = {line for line, places in where.items() if recurs(places)}
    leaves = defaultdict(list)
    for line in where:
        leaves[leaf(line)].append(line.split(" "))
    templates = defaultdict(list)
    for members in leaves.values():
        if len(members) < 3 or len(members[0]) <= 3:
            continue
        columns = list(zip(*members))
        for tokens in members:
            fixed = [columns[i].count(t) >= 3 for i, t in enumerate(tokens)]
            if 100 * sum(fixed) >= 60 * len(tokens):
                templates[tuple(t if f else "<*>" for t, f in zip(tokens, fixed))].append(" ".join(tokens))
    for lines in templates.values():
        if recurs([p for line in lines for p in where[line]]):
            dropped |= set(lines)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if mask(x) not in dropped]
        digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        out.append((doc_id, 0 if text is None else len(lines), len(lines) - len(kept), digest))
    return sorted(out, key=repr)


def answer(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=repr)


def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = answer(QUERIES["op3_line_dedup"](spark, sf))
    assert got == brute(rows)
    assert any(r[2] for r in got)


ROWS = [
    (1, "alpha one\nPage 1 of 20 was printed\nbody of the first document here"),
    (2, "Page 2 of 20 was printed\nother words fill this second text"),
    (3, "third text has its own long line\n  Page 3 of 31 was printed "),
    (4, "Dear Anna we thank you for your order\nfourth document is about a river and a bridge over it"),
    (5, "Dear Anna we thank you for your letter\nthe fifth document tells of mountains that nobody climbs"),
    (6, "Dear Anna we thank you for your order\nsixth, on the price of bread in the old town market"),
    (7, "Dear Anna we thank you for your visit\n\nseventh and last of the family of short letters we have"),
    (8, None), (9, ""), (10, "\n\n"), (None, "Page 7 of 7 was printed"), (11, "word " * 40000 + "\nPage 5 of 9 was printed"),
    (11, "word " * 40000 + "\nPage 5 of 9 was printed"),
    *((20 + i, "a copied line\nanother line of the copy that is the longest of it\nthird") for i in range(6)),
]


def test_edge_rows(spark):
    df = spark.createDataFrame([(t, i, 0, "k") for i, t in ROWS], "text string, doc_id long, n_dropped int, line_key string")
    got = answer(line_report(df.repartition(3)))
    assert got == brute(ROWS)
    dropped = {r[0]: r[2] for r in got}
    assert dropped[1] == dropped[2] == dropped[3] == dropped[11] == 1  # digits are variable fields
    assert dropped[4] == dropped[5] == dropped[7] == 1  # so are words that vary within a leaf
    assert not any(dropped[20 + i] for i in range(6))  # copies are not boilerplate
    texts = {r.doc_id: r.text for r in dedup_lines(df).collect()}
    assert texts[8] is None and texts[9] == "" and texts[10] == "\n\n" and texts[None] == ""
    assert texts[1] == "alpha one\nbody of the first document here"


def test_empty_table(spark):
    assert line_report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_no_python_in_the_plan(spark, sf):
    df = QUERIES["op3_line_dedup"](spark, sf)
    rows = numbered(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    lines, recurring = recurring_lines(rows)
    for frame in (df, line_table(rows), held_lines(lines), generalised(rows, lines), recurring):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def dropped_by_stage(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.n_dropped for r in dedup_lines(df.repartition(3)).orderBy("doc_id").collect()]


def word(i):
    """A token without digits."""
    return "".join(chr(97 + int(c)) for c in str(i))


@pytest.mark.parametrize("n", [3, 100, 10_000])
def test_passage_longer_than_every_other_line(spark, n):
    passage = " ".join(f"passage{word(i)}" for i in range(115))
    texts = [f"{passage}\n{word(i)} alone has this body" for i in range(n)]
    assert set(dropped_by_stage(spark, texts)) == {1}
    copies = [f"{passage}\nthe same body in all of them"] * n
    assert set(dropped_by_stage(spark, copies)) == {0}


def test_template_with_several_variants_in_each_document(spark):
    names = ("alice", "bob", "carol", "dave", "erin")
    texts = ["\n".join([*(f"Today the user {x} logged in from home" for x in names), f"{word(i)} wrote a much longer body of text than that"])
             for i in range(100)]
    texts = [t.replace("alice", f"alice{word(i)}") for i, t in enumerate(texts)]
    assert set(dropped_by_stage(spark, texts)) == {5}


def test_copies_do_not_outvote_a_line(spark):
    line = "All rights reserved by the publisher of these pages"
    texts = [f"{line}\n{word(i)} wrote this body" for i in range(300)]
    assert set(dropped_by_stage(spark, texts + [texts[0]] * 2000)) == {1}


def test_long_passage_in_many_documents(spark):
    passage = " ".join(f"passage{word(i)}" for i in range(120))
    texts = [f"short {word(i)} line\n{passage}\nand {word(i + 7)} a second short one" for i in range(200)]
    assert set(dropped_by_stage(spark, texts)) == {1}


@pytest.mark.parametrize("n_lines", [6, 20])
def test_near_copies_keep_their_prose(spark, n_lines):
    """Each copy has a word put into one of its lines."""
    rng = random.Random(n_lines)
    prose = [" ".join(f"{word(rng.randrange(10**6))}" for _ in range(12)) for _ in range(n_lines)]
    texts = []
    for i in range(120):
        lines = list(prose)
        at = rng.randrange(n_lines)
        words = lines[at].split(" ")
        words.insert(rng.randrange(len(words)), f"new{word(i)}")
        lines[at] = " ".join(words)
        texts.append("\n".join(lines))
    assert set(dropped_by_stage(spark, texts)) == {0}
