import itertools
import random
import re
import zlib

import numpy as np
import pytest

from batchwright.llm.calibration import Logistic
from batchwright.llm.quality import blocks, quality_report
from batchwright.llm.queries import QUERIES
from batchwright.llm import quality, toxicity
from batchwright.llm.toxicity import CLAUSES, GRAMMAR, NEGATIONS, REPORTS, Grammar, read_clause, toxicity_report
from batchwright.llm.transducer import Transducer, compose

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("query, label, modulus, held, least", [
    ("op4_toxicity", "toxic", 3, 1, 0.96),
    ("op9_quality", "quality", 5, 0, 0.96),
])
def test_held_out_accuracy(spark, query, label, modulus, held, least):
    got = {r.doc_id: r for r in QUERIES[query](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(got) == docs.count()
    for r in got.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == held)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= (0.7 if label == "toxic" else 0.3))
    rows = [(got[r.doc_id].predicted, r[label]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()
            if r.doc_id in got and got[r.doc_id].held_out]
    assert sum(p == y for p, y in rows) / len(rows) >= least
    rare = 1 if label == "toxic" else 0
    assert sum(p == y == rare for p, y in rows) / sum(y == rare for _, y in rows) >= 0.7


@pytest.mark.parametrize("report, label", [(toxicity_report, "toxic"), (quality_report, "quality")])
def test_odd_rows_and_missing_labels(spark, report, label):
    rows = [(1, None), (2, ""), (3, "x" * 300000), (4, "fine words"), (4, "fine words"), (None, "no id")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, label int")
    for labelled in ([], [(1, 1), (2, 0), (3, None), (None, 1), (4, 1), (4, 0), (99, 1)]):
        labels = spark.createDataFrame(labelled, f"doc_id long, {label} int")
        got = report(docs, labels).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
        assert len({r.score for r in got if r.doc_id == 4}) == 1
    assert report(docs.limit(0), labels).collect() == []


def weight(text, **entries):
    found, _ = Grammar(entries).matches(text)
    return sum(m.weight for m in found)


def test_grammar_weighs_clauses_not_words():
    bare, aimed = weight("what an idiot"), weight("you are an idiot")
    assert 0 < bare < aimed
    assert weight("you are not an idiot") < bare
    assert weight('he said "you idiot" again') < bare
    assert weight("he called it stupid. nothing else") < bare
    assert weight("the fire will kill") > 0 and weight("they will kill you") > 0
    assert weight("a kill switch, you see") == 0
    assert weight("good day to you. not bad") == weight("") == 0
    assert weight("LOSER!! in### idiot***") > 2 * bare - 1e-9
    assert weight("ein Lostra Wort", **{"^lostr": 6.0}) == 6.0


def test_blocks_are_whole():
    for n in (0, 1, 2047, 2048, 5000, 100001):
        data = bytes(i % 251 for i in range(n))
        assert b"".join(blocks(data)) == data


def test_logistic_orders_and_stays_inside():
    x = np.arange(100.0).reshape(-1, 1)
    p = Logistic(x, (x[:, 0] > 49).astype(int)).probability(np.array([[-1e9], [10.0], [90.0], [1e9]]))
    assert (np.diff(p) >= 0).all() and 0 < p[0] < 0.1 and 0.9 < p[-1] < 1
    assert Logistic(np.empty((0, 1)), np.empty(0)).probability(x).tolist() == [0.5] * 100


def test_composition_is_one_transducer_after_the_other():
    rng = random.Random(4)
    for _ in range(50):
        def one(reads, writes):
            arcs = {(s, x): (rng.randrange(4), rng.choice(writes), rng.random()) for s in range(4) for x in reads}
            return Transducer(0, arcs)

        a, b = one("xyz", "pq"), one("pq", "uvw")
        for word in itertools.product("xyz", repeat=4):
            first = a.run(word)
            second = b.run(o for o, _ in first)
            want = [(o, w * v) for (_, w), (o, v) in zip(first, second)]
            assert compose(a, b).run(word) == want


def plain_clause(tokens):
    """The rules of the grammar word by word, with counters instead of states."""
    left, verb, inside, before, total = 0, False, False, "start", 0.0
    marks = {"negated": False, "reported": False, "aimed": False}
    for kind, value, quote in tokens:
        verb = verb or kind == toxicity.REPORT
        covered = verb or inside or quote
        if kind == toxicity.INSULT or kind == toxicity.THREAT and before == "intent":
            if left:
                value, marks["negated"] = value * 0.25, True
            if covered:
                value, marks["reported"] = value * 0.3, True
            if before in ("target", "aimed"):
                value, marks["aimed"] = value * 1.5, True
            total += value
        elif kind == toxicity.TARGET and before in ("insult", "threat"):
            marks["aimed"] = True
        left = 3 if kind == toxicity.NEGATION else max(0, left - 1)
        inside = inside != quote
        moves = {("start", 3): "target", ("start", 4): "intent", ("target", 4): "intent", ("intent", 3): "target", ("start", 1): "insult",
                 ("insult", 3): "aimed", ("target", 1): "aimed", ("intent", 2): "threat", ("threat", 3): "aimed"}
        before = moves.get((before, kind), before)
    return (total, *marks.values()) if total > 0 else None


def test_composed_grammar_equals_plain_rules():
    rng = random.Random(9)
    assert len({state for state, _ in GRAMMAR.arcs}) > 40 and len(REPORTS.arcs) == 4 * 14 and NEGATIONS.start == 0 and CLAUSES.start == "start"
    for _ in range(30000):
        tokens = [(k := rng.randrange(7), 5.0 if k in (1, 2) else 0.0, rng.random() < 0.2) for _ in range(rng.randint(0, 9))]
        match, want = read_clause(tokens), plain_clause(tokens)
        got = match and (match.weight, match.negated, match.reported, match.aimed)
        assert (got is None) == (want is None) and (got is None or (got[1:] == want[1:] and abs(got[0] - want[0]) < 1e-9)), tokens


SMALL_SF = "/root/testdata/sf0.01"


def test_toxicity_query_equals_plain_loop(spark):
    """The query's scores, recomputed for every document with clauses cut by a regular expression and the plain rules."""
    docs, labels = (spark.read.parquet(f"{SMALL_SF}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.fit_toxicity(docs, labels)
    got = {r.doc_id: r.score for r in QUERIES["op4_toxicity"](spark, SMALL_SF).collect()}
    grammar, hits = Grammar(model.entries), 0
    for r in docs.collect():
        tokens = [grammar.classify(t) for t in (r.text or "").split()]
        ends = "".join("." if t[3] else "w" for t in tokens)
        weights = [m[0] for part in re.finditer(r"w*\.|w+", ends) if (m := plain_clause([t[:3] for t in tokens[part.start() : part.end()]]))]
        hits += bool(weights)
        total = sum(weights)
        x = [np.log1p(total), min(max(weights, default=0.0), 30.0), np.log1p(100 * total / len(tokens)) if tokens else 0.0]
        assert abs(model.calibrator.probability(np.array([x]))[0] - got[r.doc_id]) < 1e-6
    assert hits


def plain_quality(zstandard, model, rows):
    out = {}
    for doc_id, text in rows:
        data = text.encode()
        x = [0.0, 0.0, 0.0]
        if data:
            n = max(1, round(len(data) / 2048))
            cuts = [len(data) * i // n for i in range(n + 1)]
            sizes = []
            for content in (model.good, model.bad):
                options = dict(level=3, write_checksum=False, write_content_size=False, write_dict_id=False)
                if content:
                    options["dict_data"] = zstandard.ZstdCompressionDict(content)
                sizes.append(sum(len(zstandard.ZstdCompressor(**options).compress(data[a:b])) for a, b in zip(cuts, cuts[1:])))
            good, bad = sizes
            x = [(good - bad) / len(data), (good - bad) / (good + bad), good / len(data)]
        out[doc_id] = float(model.calibrator.probability(np.array([x]))[0])
    return out


def test_quality_query_equals_plain_loop(spark):
    """The query's scores, recomputed with the fitted dictionaries, block by block."""
    import zstandard

    docs, labels = (spark.read.parquet(f"{SMALL_SF}/{n}.parquet") for n in ("documents", "labels"))
    model = quality.fit_quality(docs, labels)
    got = {r.doc_id: r.score for r in QUERIES["op9_quality"](spark, SMALL_SF).collect()}
    assert plain_quality(zstandard, model, [(r.doc_id, r.text or "") for r in docs.collect()]) == pytest.approx(got, abs=1e-9)
