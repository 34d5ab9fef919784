"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items and documents are normalised to words: A-Z in lower case, words are runs of letters,
digits and non-ASCII characters. The automaton holds every word sequence of every item. A
document's words stream through it; at each word the automaton knows the longest suffix that
occurs in some item. Where that length reaches the window (10 words, or a whole shorter
item), the window's words are hit.

Benchmark items are a query set of bounded size per block: they are dealt into blocks by
hash so that a block's text stays near BLOCK_BYTES, a block is read by its own small job and
broadcast, and all documents are read once for each block. With one block nothing is
shuffled. With several, rows are numbered and written once, the hits of all blocks on the
unchanged text are gathered by row number, and the answer is the one a single block gives.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchwright.llm.common import map_batches, whole_text
from batchwright.storage import materialize

#: Consecutive words of an item that make a leak.
WINDOW = 10

#: Share of hit words above which a document goes whole.
MAX_COVERAGE = 0.5

#: Text bytes of benchmark items that one broadcast may hold.
BLOCK_BYTES = 1 << 20

_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_WORD_RUN = re.compile(rb"[^ ]+")


def words_of(text: str) -> list[bytes]:
    """Normalised words, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


class ItemAutomaton:
    """Suffix automaton over the word numbers of all items.

    A state stands for the sequences that end at the same places; `longest` is the length of
    the longest of them, `link` leads to the state of the next shorter suffixes. `window_items`
    of a state that holds a 10-word sequence names the items which contain it, and `whole`
    lists short items that a state spells out.
    """

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        coded = [(key, [number(w, len(self.vocabulary)) for w in words]) for key, words in items if words]
        self.shortest = min((min(len(c), window) for _, c in coded), default=window)
        self.longest = [0]
        self.link = [-1]
        self.step: list[dict[int, int]] = [{}]
        ends = []
        for key, codes in coded:
            state = 0
            for code in codes:
                state = self._extend(state, code)
            ends.append((key, codes))
        self.window_items: dict[int, set[int]] = {}
        self.whole: dict[int, list[tuple[int, int]]] = {}
        for key, codes in ends:
            self._mark(key, codes)
        self._nearest_whole()
        pairs = {(a, b) for _, codes in coded for a, b in zip(codes, codes[1:])}
        self.width = len(self.vocabulary) + 1
        self.pairs = np.sort(np.fromiter((a * self.width + b for a, b in pairs), dtype=np.int64, count=len(pairs)))

    def _extend(self, last: int, code: int) -> int:
        """Append one word after state `last`, sharing what other items already spell."""
        known = self.step[last].get(code)
        if known is not None:
            if self.longest[known] == self.longest[last] + 1:
                return known
            return self._split(last, code, known)
        new = self._state(self.longest[last] + 1, {})
        at = last
        while at != -1 and code not in self.step[at]:
            self.step[at][code] = new
            at = self.link[at]
        if at == -1:
            self.link[new] = 0
            return new
        target = self.step[at][code]
        if self.longest[target] != self.longest[at] + 1:
            target = self._split(at, code, target)
        self.link[new] = target
        return new

    def _split(self, at: int, code: int, target: int) -> int:
        """Give the sequences of `target` that end after state `at` a state of their own."""
        twin = self._state(self.longest[at] + 1, dict(self.step[target]))
        self.link[twin] = self.link[target]
        self.link[target] = twin
        while at != -1 and self.step[at].get(code) == target:
            self.step[at][code] = twin
            at = self.link[at]
        return twin

    def _state(self, longest: int, step: dict[int, int]) -> int:
        self.longest.append(longest)
        self.link.append(0)
        self.step.append(step)
        return len(self.longest) - 1

    def _mark(self, key: int, codes: list[int]) -> None:
        """Name the item in the states of its windows."""
        size = min(len(codes), self.window)
        for state, matched in self.walk(codes):
            if matched < size:
                continue
            while self.longest[self.link[state]] >= size:
                state = self.link[state]
            if size == self.window:
                self.window_items.setdefault(state, set()).add(key)
            elif (size, key) not in self.whole.setdefault(state, []):
                self.whole[state].append((size, key))

    def _nearest_whole(self) -> None:
        """For each state, the nearest state on its suffix path that spells a whole short item."""
        self.next_whole = [-1] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.longest.__getitem__):
            self.next_whole[state] = state if state in self.whole else self.next_whole[self.link[state]]

    def walk(self, codes):
        """(state, matched length) after each word number; -1 is a word that no item has."""
        state = matched = 0
        for code in codes:
            while state and code not in self.step[state]:
                state = self.link[state]
                matched = self.longest[state]
            state = self.step[state].get(code, 0)
            matched = matched + 1 if state else 0
            yield state, matched

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit ranges (start, end) over the words, and the items whose windows occur."""
        hits: list[tuple[int, int]] = []
        items: set[int] = set()
        if len(words) < self.shortest or not self.vocabulary:
            return hits, items
        codes = np.fromiter(map(self.vocabulary.get, words, [-1] * len(words)), dtype=np.int64, count=len(words))
        for start, end in self._candidates(codes):
            self._scan(codes[start:end].tolist(), start, hits, items)
        return hits, items

    def _candidates(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """Ranges in which every word, and every pair of neighbours, occurs in some item.

        A match of `shortest` words or more lies wholly inside one such range, so the scan of
        these ranges equals the scan of the document.
        """
        joined = np.zeros(len(codes), dtype=bool)  # word i continues a range that holds word i - 1
        if len(self.pairs) and len(codes) > 1:
            pair = codes[:-1] * self.width + codes[1:]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined[1:] = (self.pairs[at] == pair) & (codes[:-1] >= 0) & (codes[1:] >= 0)
        starts = np.flatnonzero(~joined & (codes >= 0))
        breaks = np.append(np.flatnonzero(~joined), len(codes))
        ends = breaks[np.searchsorted(breaks, starts, side="right")]
        keep = ends - starts >= self.shortest
        return list(zip(starts[keep].tolist(), ends[keep].tolist()))

    def _scan(self, codes: list[int], offset: int, hits: list[tuple[int, int]], items: set[int]) -> None:
        window, longest, link = self.window, self.longest, self.link
        for i, (state, matched) in enumerate(self.walk(codes), offset + 1):
            if matched >= window:
                at = state
                while longest[link[at]] >= window:
                    at = link[at]
                items.update(self.window_items[at])
                hits.append((i - window, i))
            at = self.next_whole[state]
            while at != -1:
                for size, key in self.whole[at]:
                    if size <= matched:
                        items.add(key)
                        hits.append((i - size, i))
                at = self.next_whole[link[at]]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges without overlap, sorted; ranges that touch become one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str]]]:
    """The items as (item_id text, text) in blocks of about `block_bytes`, one at a time.

    Null and empty texts have no words and are left out. Items with a null id hit as all
    others do, but have no name.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), whole_text().alias("text")).where("text <> ''")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / block_bytes))
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b).collect()
        yield sorted(((r.item, r.text) for r in rows), key=lambda row: (row[0] is not None, row))


_built: dict[int, tuple[ItemAutomaton, list[str]]] = {}


def _automaton(sent, window: int) -> tuple[ItemAutomaton, list[str]]:
    """The automaton of a broadcast block, built once in each Python worker."""
    rows = sent.value
    key = zlib.crc32(repr(rows).encode("utf-8", "surrogatepass")) * 1000 + window
    if key not in _built:
        _built.clear()
        names = sorted({item for item, _ in rows}, key=lambda item: (item is not None, item))
        place = {item: i for i, item in enumerate(names)}
        _built[key] = ItemAutomaton([(place[item], words_of(text)) for item, text in rows], window), names
    return _built[key]


def block_hits(docs: DataFrame, rows: list[tuple[str, str]], window: int = WINDOW) -> DataFrame:
    """doc columns, n_words, spans (word ranges hit by the block) and items, one row per row of `docs`."""
    sent = docs.sparkSession.sparkContext.broadcast(rows)
    carried = docs.columns

    def find(batch):
        automaton, names = _automaton(sent, window)
        out = {name: batch[name] for name in carried} | {"n_words": [], "spans": [], "items": []}
        for text in batch["text"]:
            words = words_of(text)
            hits, items = automaton.spans(words)
            out["n_words"].append(len(words))
            out["spans"].append([{"start": a, "end": b} for a, b in merged(hits)])
            out["items"].append(sorted((names[i] for i in items), key=lambda item: (item is None, item)))
        return out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_batches(
        docs, find, f"{fields}, n_words bigint, spans array<struct<start: bigint, end: bigint>>, items array<string>"
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans, items: the words of each document that benchmark windows hit.

    A window is `window` consecutive item words; an item of fewer words, but not none, is one
    window. `spans` are word ranges (end exclusive) without overlap, `items` the ids, as text,
    of items with an occurring window; those without an id count as one, which is null and last. Null and empty texts have no words; an empty benchmark
    hits nothing. Every row is answered by itself, also where a doc_id is null or repeated.
    """
    base = docs.select("doc_id", whole_text().alias("text"))
    only, blocks = _one_or_more(item_blocks(benchmark, block_bytes))
    if only is not None:
        return block_hits(base, only, window).drop("text")
    numbered = materialize(base.withColumn("row_number", F.monotonically_increasing_id()), "numbered-documents")
    found = _hits_of_blocks(numbered.select("row_number", "text"), blocks, window)
    return numbered.select("row_number", "doc_id").join(found, "row_number").drop("row_number")


def _one_or_more(blocks: Iterator[list[tuple[str, str]]]) -> tuple[list[tuple[str, str]] | None, Iterator[list[tuple[str, str]]]]:
    """(the block, nothing) if there is only one, else (None, all blocks); no more than two are held."""
    blocks = iter(blocks)
    first, second = next(blocks), next(blocks, None)
    return (first, iter(())) if second is None else (None, chain([first, second], blocks))


def _hits_of_blocks(numbered: DataFrame, blocks: Iterator[list[tuple[str, str]]], window: int) -> DataFrame:
    """row_number, n_words, spans, items of each row of (row_number, text): what all blocks together hit.

    A block leaves the driver for its broadcast before the next one comes.
    """
    found = None
    for rows in blocks:
        hits = block_hits(numbered, rows, window).drop("text")
        found = hits if found is None else found.unionByName(hits)
    together = found.groupBy("row_number").agg(
        F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )

    def join(batch):
        joined = [merged([(s["start"], s["end"]) for s in spans]) for spans in batch["spans"]]
        return batch | {"spans": [[{"start": a, "end": b} for a, b in spans] for spans in joined]}

    return map_batches(together, join, together.schema)


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: the digest of `contamination`.

    An item without an id is counted, but adds nothing to the hash.
    """
    found = contamination(docs, benchmark)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )



def _word_places(data: bytes) -> list[tuple[int, int]]:
    """Byte range of each word, in the order of `words_of`."""
    return [m.span() for m in _WORD_RUN.finditer(data.translate(_WORD_BYTES))]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = MAX_COVERAGE) -> DataFrame:
    """The documents without the words that benchmark windows hit, with all their columns.

    Each hit range goes, from its first word to its last; what stays is joined by nothing
    else, so the text around it is as it was. A document of which hits cover more than
    `coverage` of the words goes whole. Clean documents, and null or empty texts, stay as
    they are. Hits are those of the whole benchmark on the text as it is given, however many
    blocks it needs.
    """
    only, blocks = _one_or_more(item_blocks(benchmark))
    if only is not None:
        return _cut_block(docs, only, window, coverage)
    # Two plain names that the table does not have itself.
    number, spans = (next(n for n in (base + "_" * k for k in range(len(docs.columns) + 1)) if n not in docs.columns)
                     for base in ("row_number", "spans"))
    numbered = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "numbered-documents")
    texts = numbered.select(F.col(number).alias("row_number"), whole_text().alias("text"))
    found = _hits_of_blocks(texts, blocks, window).where(F.size("spans") > 0)
    hits = found.select(F.col("row_number").alias(number), F.col("spans").alias(spans))

    def cut(batch):
        out = {name: [] for name in batch}
        for i, text in enumerate(batch["text"]):
            if batch[spans][i]:
                text = _cut(text, [(s["start"], s["end"]) for s in batch[spans][i]], coverage)
                if text is None:
                    continue
            for name in batch:
                out[name].append(text if name == "text" else batch[name][i])
        return out

    return map_batches(numbered.join(hits, number, "left").drop(number), cut, docs.schema)


def _cut(text: str, spans: list[tuple[int, int]], coverage: float) -> str | None:
    """The text without the words of these ranges; None where they cover more than `coverage` of its words."""
    data = text.encode("utf-8", "surrogatepass")
    places, parts, done = _word_places(data), [], 0
    if sum(b - a for a, b in spans) > coverage * len(places):
        return None
    for a, b in spans:
        parts.append(data[done : places[a][0]])
        done = places[b - 1][1]
    return (b"".join(parts) + data[done:]).decode("utf-8", "surrogatepass")


def _cut_block(docs: DataFrame, rows: list[tuple[str, str]], window: int, coverage: float) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(rows)

    def cut(batch):
        automaton, _ = _automaton(sent, window)
        out = {name: [] for name in batch}
        for i, text in enumerate(batch["text"]):
            spans = merged(automaton.spans(words_of(text or ""))[0])
            if spans:
                text = _cut(text, spans, coverage)
                if text is None:
                    continue
            for name in batch:
                out[name].append(text if name == "text" else batch[name][i])
        return out

    return map_batches(docs, cut, docs.schema)
