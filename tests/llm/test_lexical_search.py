import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from batchwright.llm import lexical_search as ls

TERM = re.compile(ls.TERM)


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items, top=10):
    """(item row, item_id, rank, doc_id, score), scores by the formula alone."""
    terms = [(i, Counter(TERM.findall(lowered(t)))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in terms]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for (doc_id, c), n in zip(terms, sizes):
            score = 0
            for t in TERM.findall(lowered(text)):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 100 - 75 + (75 * n * n_docs) // n_terms
                    score += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id, score))
        for rank, (_, _, doc_id, score) in enumerate(sorted(scored)[:top], 1):
            out.append((item_id, rank, doc_id, score))
    return sorted(out, key=repr)


def answer(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def words(rng, n, of):
    return " ".join(f"w{min(rng.randrange(of), rng.randrange(of))}" for _ in range(n))


def test_search_equals_brute_force(spark, monkeypatch):
    rng = random.Random(13)
    docs = [(rng.randrange(250), words(rng, rng.randint(0, 60), 300)) for _ in range(300)]
    docs += [(None, None), (None, "w1 w2 w3"), (900, ""), (901, "W1 w1 w1_w1"), (902, "w7 " * 30000)] + [(1000 + i, "w5 w6 w7 w8 tie") for i in range(30)]
    items = [(k % 9, words(rng, rng.randint(1, 12), 300)) for k in range(20)] + [(None, "w1 w2 w3"), (50, None), (51, ""), (52, "nowhere"), (53, "tie tie w5")]
    d = spark.createDataFrame([(t, i, 0, 1.0) for i, t in docs], "text string, doc_id long, rank int, score double").repartition(5)
    b = spark.createDataFrame([(*r, 3) for r in items], "item_id long, text string, number int")
    want = brute(docs, items)
    assert answer(ls.search(d, b)) == want
    monkeypatch.setattr(ls, "TREE_ROWS", 40)
    assert answer(ls.search(d, b, block_bytes=60)) == want  # several blocks of items
    assert answer(ls.search(d, b, top=3)) == brute(docs, items, 3)


@pytest.mark.parametrize("seed", [1, 2])
def test_bounds_hold_and_prune(seed):
    """Of clustered documents few are scored, and no bound is below what its documents score."""
    rng = np.random.default_rng(seed)
    sizes, terms, values = [], [], []
    for k in range(400):
        own = np.sort(rng.choice(np.arange(50 * (k % 8), 50 * (k % 8) + 50), 20, replace=False))
        sizes.append(20), terms.append(own), values.append(rng.integers(10**9, 2 * 10**10, 20))
    starts = np.append(0, np.cumsum(sizes))
    tree = ls.BallTree(starts, np.concatenate(terms), np.concatenate(values), 400, leaf_rows=8)
    leaves = [r for r, left in zip(tree.rows, tree.left) if left < 0]
    assert sorted(np.concatenate(leaves).tolist()) == list(range(400))
    texts = [" ".join(f"t{k}" for k in range(50 * i, 50 * i + 50) for _ in range(rng.integers(1, 4))) for i in range(8)]
    items = ls.Items([(-1, " ".join(f"t{k}" for k in range(400))), *enumerate(texts)])
    assert items.place == {f"t{k}": k for k in range(400)}
    bounds = tree.bounds(items)
    for item in range(9):
        exact = tree.scores(np.arange(400), items.dense(item))
        assert all(exact[rows].max() <= bounds[item, node] for node, rows in enumerate(tree.rows))
        best = ls.Best(1, 10)
        scored = tree.search(items.dense(item), bounds[item], 1, lambda rows, scores: best.add(0, rows.tolist(), scores))
        assert sorted((r[2] for r in best.rows[0]), reverse=True) == sorted(exact.tolist(), reverse=True)[:10]
        assert item == 0 or scored < 100


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert ls.search(d, b).collect() == []
    assert ls.search(b.withColumnRenamed("item_id", "doc_id"), b.limit(0)).collect() == []
