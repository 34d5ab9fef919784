"""Exact lexical search in sparse ball trees.

A document is a sparse vector over the terms of the items: at each term the integer that one
occurrence of it in an item adds to the document's score. An item is the vector of its term
counts, so a score is an inner product. Every task builds ball trees over its documents and
searches them best-first for all items: a node's centroid and radii bound what any document
below it can reach, <q, centroid> + |q| * radius, rounded upwards by more than doubles can be
off. Nodes whose bound stays below the item's best scores so far are never opened; documents
in the leaves that are opened are scored in 64-bit integers. Only the best rows of each task
are exchanged, so the result is exact whatever the trees look like.

Two passes read the documents' texts once: the first keeps each document's length and its
counts of the terms that items have; document frequencies and lengths follow from these. Items
come to the tasks in blocks of bounded size, one at a time.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from batchwright.llm.common import map_batches, pieces, received, send, whole_text
from batchwright.storage import materialize

# Terms and the parameters of the score.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 10
#: Text of the items that tasks hold at once, in bytes.
BLOCK_BYTES = 1 << 20
#: Documents of one tree, and of a leaf.
TREE_ROWS = 2048
LEAF_ROWS = 32
#: Groups of terms with radii of their own.
GROUPS = 16

_LOWERED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def terms_of(text: str | None) -> list[str]:
    """The terms of a whole text, A-Z lower-cased and nothing else; null has none."""
    if not text:
        return []
    return _LOWERED.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


def idf(n_docs: int, df: int) -> int:
    """A term's weight."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """(number, text) of the items in blocks of about `block_bytes`, one at a time."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / block_bytes))
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64("number"), F.lit(n)) == b).select("number", "text").collect()
        if rows:
            yield sorted((r.number, r.text) for r in rows)


class Items:
    """The term counts of those items of a block that have terms, one after the other."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.names: list[int] = []
        self.place: dict[str, int] = {}
        terms: list[int] = []
        times: list[int] = []
        sizes: list[int] = []
        for number, text in rows:
            own: dict[int, int] = {}
            for term in terms_of(text):
                at = self.place.setdefault(term, len(self.place))
                own[at] = own.get(at, 0) + 1
            if own:
                self.names.append(number)
                sizes.append(len(own))
                terms += own.keys()
                times += own.values()
        self.terms, self.times = np.array(terms, dtype=np.int64), np.array(times, dtype=np.int64)
        self.sizes = np.array(sizes, dtype=np.int64)
        self.starts = np.append(0, np.cumsum(self.sizes)).astype(np.int64)

    def dense(self, item: int) -> np.ndarray:
        out = np.zeros(len(self.place), dtype=np.int64)
        part = slice(self.starts[item], self.starts[item + 1])
        out[self.terms[part]] = self.times[part]
        return out


def term_counts(docs: DataFrame, items: Items) -> DataFrame:
    """(doc_id, n, terms, tfs): each document's number of terms, and the counts of those terms that the items have."""
    sent = send(docs.sparkSession, items.place)

    def run(batch):
        place = received(sent, lambda found: found)
        out = {"doc_id": batch["doc_id"], "n": [], "terms": [], "tfs": []}
        for text in batch["text"]:
            words = terms_of(text)
            at = [p for p in map(place.get, words) if p is not None]
            terms, tfs = np.unique(np.array(at, dtype=np.int32), return_counts=True)
            out["n"].append(len(words))
            out["terms"].append(terms)
            out["tfs"].append(tfs)
        return out

    base = docs.select("doc_id", whole_text().alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    return map_batches(base, run, f"doc_id {kind}, n bigint, terms array<int>, tfs array<bigint>")


class BallTree:
    """Documents as rows of a sparse matrix of non-negative integers, in balls within balls.

    A node has a centroid and radii: one over all terms, and one in each of GROUPS groups of
    terms. What an item can gain beyond the centroid is at most |q| times the radius, and at
    most the sum of |q| times radius over the groups; the smaller one counts. A term belongs
    to the group of that upper subtree in which it weighs most, so items say little in the
    groups of documents that do not share their vocabulary.

    Squared distances come from |x|^2 - 2<x,c> + |c|^2, whose rounding error is bounded by a
    small multiple of the terms' magnitudes; that much is added before the root is taken, and
    again when a bound is put together.
    """

    def __init__(self, starts: np.ndarray, terms: np.ndarray, values: np.ndarray, n_terms: int, leaf_rows: int = LEAF_ROWS):
        self.starts, self.terms, self.values, self.n_terms, self.leaf_rows = starts, terms, values, n_terms, leaf_rows
        self.floats = values.astype(float)
        self.norms = np.add.reduceat(self.floats**2, starts[:-1])
        self.rows: list[np.ndarray] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self._grow(np.arange(len(starts) - 1))
        self.group = self._groups()
        self.centroids: list[tuple[np.ndarray, np.ndarray]] = []
        radii = [self._radii(rows) for rows in self.rows]
        self.radii, self.group_radii = np.array([r for r, _ in radii]), np.array([g for _, g in radii])

    def _entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the rows' entries, where each row begins among them, and how many it has; every row has some."""
        sizes = self.starts[rows + 1] - self.starts[rows]
        begin = np.append(0, np.cumsum(sizes)[:-1])
        return np.arange(sizes.sum()) + np.repeat(self.starts[rows] - begin, sizes), begin, sizes

    def _products(self, at: np.ndarray, begin: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.floats[at] * dense[self.terms[at]], begin)

    def _row(self, row: int) -> np.ndarray:
        dense = np.zeros(self.n_terms)
        part = slice(self.starts[row], self.starts[row + 1])
        dense[self.terms[part]] = self.floats[part]
        return dense

    def _grow(self, rows: np.ndarray) -> int:
        """Add the node of these rows and those below it; returns its number."""
        node = len(self.rows)
        self.rows.append(rows)
        self.left.append(-1)
        self.right.append(-1)
        if len(rows) > self.leaf_rows:
            at, begin, _ = self._entries(rows)
            from_first = self.norms[rows] - 2 * self._products(at, begin, self._row(int(rows[np.argmax(self.norms[rows])])))
            one = self._row(int(rows[np.argmax(from_first)]))
            from_one = self.norms[rows] - 2 * self._products(at, begin, one)
            two = self._row(int(rows[np.argmax(from_one)]))
            nearer = 2 * self._products(at, begin, two - one) - float(two @ two) + float(one @ one)
            split = np.argsort(nearer, kind="stable")
            half = self._cut(nearer[split])
            self.left[node] = self._grow(rows[split[:half]])
            self.right[node] = self._grow(rows[split[half:]])
        return node

    @staticmethod
    def _cut(sorted_gaps: np.ndarray) -> int:
        """Where a node is cut: at the widest gap in its middle three quarters, so trees stay shallow."""
        n = len(sorted_gaps)
        low, high = n // 8, n - n // 8
        return low + 1 + int(np.argmax(np.diff(sorted_gaps[low:high])))

    def _groups(self) -> np.ndarray:
        """The group of each term: of the largest subtrees, the one in which the term weighs most a document."""
        tops = [0]
        while len(tops) < GROUPS:
            widest = max(tops, key=lambda node: len(self.rows[node]) if self.left[node] >= 0 else 0)
            if self.left[widest] < 0:
                break
            tops.remove(widest)
            tops += [self.left[widest], self.right[widest]]
        mass = np.zeros((len(tops), self.n_terms))
        for k, node in enumerate(tops):
            at, _, _ = self._entries(self.rows[node])
            mass[k] = np.bincount(self.terms[at], weights=self.floats[at], minlength=self.n_terms) / len(self.rows[node])
        return np.argmax(mass, axis=0)

    def _radii(self, rows: np.ndarray) -> tuple[float, np.ndarray]:
        """The radius of a node over all terms, and in each group; keeps its centroid."""
        at, begin, sizes = self._entries(rows)
        terms, floats = self.terms[at], self.floats[at]
        centroid = np.bincount(terms, weights=floats, minlength=self.n_terms) / len(rows)
        used = np.flatnonzero(centroid)
        self.centroids.append((used, centroid[used]))
        cell = np.repeat(np.arange(len(rows)) * GROUPS, sizes) + self.group[terms]
        shape = (len(rows), GROUPS)
        own = np.bincount(cell, weights=floats**2, minlength=len(rows) * GROUPS).reshape(shape)
        both = np.bincount(cell, weights=floats * centroid[terms], minlength=len(rows) * GROUPS).reshape(shape)
        middle = np.bincount(self.group[used], weights=centroid[used] ** 2, minlength=GROUPS)
        unit = (len(at) + self.n_terms + 8) * 2.0**-50
        apart = np.maximum(own - 2 * both + middle, 0.0) + unit * (own + 2 * both + middle)
        return math.sqrt(apart.sum(axis=1).max()) * (1 + 2.0**-40), np.sqrt(apart.max(axis=0)) * (1 + 2.0**-40)

    def bounds(self, items: Items) -> np.ndarray:
        """For each item and node, what no document below the node exceeds."""
        n = len(items.names)
        cell = np.repeat(np.arange(n) * GROUPS, items.sizes) + self.group[items.terms]
        squares = np.bincount(cell, weights=items.times.astype(float) ** 2, minlength=n * GROUPS).reshape(n, GROUPS)
        middle = np.empty((n, len(self.rows)))
        dense = np.zeros(self.n_terms)
        for node, (used, value) in enumerate(self.centroids):
            dense[used] = value
            middle[:, node] = np.add.reduceat(items.times * dense[items.terms], items.starts[:-1])
            dense[used] = 0
        beyond = np.minimum(np.sqrt(squares.sum(axis=1))[:, None] * self.radii[None, :], np.sqrt(squares) @ self.group_radii.T)
        return (middle + beyond * (1 + 2.0**-40)) * (1 + (self.n_terms + 8) * 2.0**-50) + 1

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact scores of rows, in 64-bit integers."""
        at, begin, _ = self._entries(rows)
        return np.add.reduceat(self.values[at] * query[self.terms[at]], begin)

    def search(self, query: np.ndarray, bounds: np.ndarray, floor: int, found: Callable) -> int:
        """Open nodes best-first and hand (rows, scores) of leaves to `found`, which returns the new floor.

        A node is left out if its bound is below the floor; one that reaches it may hold a tie.
        Returns the number of documents scored.
        """
        queue = [(-bounds[0], 0)]
        scored = 0
        while queue and -queue[0][0] >= floor:
            _, node = heapq.heappop(queue)
            if self.left[node] < 0:
                rows = self.rows[node]
                scored += len(rows)
                floor = found(rows, self.scores(rows, query))
            else:
                for child in (self.left[node], self.right[node]):
                    if bounds[child] >= floor:
                        heapq.heappush(queue, (-bounds[child], child))
        return scored


class Best:
    """The best (score, doc) of each item that a task has seen: highest scores, of equal ones the smallest ids, null last."""

    def __init__(self, n_items: int, top: int):
        self.top = top
        self.rows: list[list[tuple]] = [[] for _ in range(n_items)]

    def floor(self, item: int) -> int:
        """The score a document must reach to matter; 1 while there is room."""
        held = self.rows[item]
        return max(1, held[-1][2]) if len(held) == self.top else 1

    def add(self, item: int, ids: list, scores: np.ndarray) -> int:
        floor = self.floor(item)
        new = [(-s, (d is None, d if d is not None else 0), s, d) for d, s in zip(ids, scores.tolist()) if s >= floor]
        if new:
            self.rows[item] = sorted(self.rows[item] + new, key=lambda r: r[:2])[: self.top]
        return self.floor(item)


def search_batch(best: Best, items: Items, ids: list, sizes: np.ndarray, terms: np.ndarray, values: np.ndarray,
                 tree_rows: int | None = None) -> int:
    """Search a batch of documents, rows of a sparse matrix, for all items; returns how many documents were scored."""
    starts = np.append(0, np.cumsum(sizes))
    tree_rows = tree_rows or TREE_ROWS
    scored = 0
    for first in range(0, len(ids), tree_rows):
        last = min(first + tree_rows, len(ids))
        part = slice(starts[first], starts[last])
        tree = BallTree(starts[first : last + 1] - starts[first], terms[part], values[part], len(items.place))
        bounds = tree.bounds(items)
        own = ids[first:last]
        for item in np.flatnonzero(bounds[:, 0] >= [best.floor(i) for i in range(len(items.names))]).tolist():
            scored += tree.search(items.dense(item), bounds[item], best.floor(item),
                                  lambda rows, scores: best.add(item, [own[r] for r in rows.tolist()], scores))
    return scored


def _block_top(counted: DataFrame, items: Items, weights: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(number, doc_id, score): the best documents of each task for each item of a block."""
    sent = send(counted.sparkSession, (items, weights))
    schema = counted.schema
    kind = schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weight = received(sent, lambda pair: pair)
        best = Best(len(own.names), top)
        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for piece in pieces(batch):
                ids = piece.column(0).to_pylist()
                lists = piece.column(2)
                terms = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                tfs = piece.column(3).flatten().to_numpy(zero_copy_only=False)
                sizes = np.diff(lists.offsets.to_numpy())
                n = np.repeat(piece.column(1).to_numpy(zero_copy_only=False), sizes)
                m = 100 - 75 + (75 * n * n_docs) // n_terms
                search_batch(best, own, ids, sizes, terms, weight[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m)))
        rows = [(own.names[i], doc, score) for i, held in enumerate(best.rows) for _, _, score, doc in held]
        if rows:
            number, doc, score = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(doc, id_type), pa.array(score, pa.int64())],
                                             names=["number", "doc_id", "score"])

    return counted.where(F.size("terms") > 0).select("doc_id", "n", "terms", "tfs").mapInArrow(run, f"number bigint, doc_id {kind}, score bigint")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` documents of each item with a score above zero.

    `items` has item_id and text. Each row of either table stands for itself, also where ids
    repeat or are null; equal scores come by doc_id, null last. Null and empty texts have no
    terms; items without terms, and an empty table, give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    numbered = materialize(
        items.select("item_id", whole_text().alias("text"), F.monotonically_increasing_id().alias("number")), "search-items"
    )
    found = None
    for rows in item_blocks(numbered, block_bytes):
        block = Items(rows)
        counted = materialize(term_counts(docs, block), "term-counts")
        totals = counted.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
        if not totals.terms or not block.place:
            continue
        seen = counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
        weights = np.zeros(len(block.place), dtype=np.int64)
        for r in seen:
            weights[r.term] = idf(totals.docs, r["count"])
        part = _block_top(counted, block, weights, totals.docs, totals.terms, top)
        found = part if found is None else found.unionAll(part)
    if found is None:
        kind = docs.schema["doc_id"].dataType.simpleString()
        found = spark.createDataFrame([], f"number bigint, doc_id {kind}, score bigint")
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return numbered.select("number", "item_id").join(ranked, "number").select("item_id", "rank", "doc_id", "score")
