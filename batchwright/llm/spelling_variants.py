"""Spelling variants of words by blocked Gram matrices.

Two words are near if one inserted, deleted or replaced letter turns one into the other. The
squared distance of their letter counts is then 2 (replaced) or 1 (inserted). Blocks of words
are compared by one NumPy product of their letter-count matrices, which gives all squared
distances; pairs at most two apart, of one length or of adjacent ones, are verified letter by
letter.

A length block grows with the square of the vocabulary if it is compared as a whole. So it is
cut by what near words share: a word is dealt into pieces of at most PIECE letters, and an edit
touches one piece only. Words of a length that agree outside one piece form a block, and so do
words one letter longer that agree with them outside that piece. Every near pair shares the
block of the piece in which it first differs, and is counted there and nowhere else. The words
of a block differ in PIECE letters (one more for the longer ones), so its size is bounded by
the letters there are, not by the corpus; occurrences are counted before anything is dealt.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchwright.llm.common import ids_and_text, pieces
from batchwright.storage import materialize

# Letters of words, as given; A-Z are lower-cased before, and only these.
WORD = r"[A-Za-zÀ-ÿ]+"
#: Of the runs of a document, those whose checksum is divisible by this lose a letter.
NOISE = 97
#: Letters and occurrences a word must have.
LEAST_LETTERS, LEAST_COUNT = 5, 3
#: A form is at least so many times as frequent as the word.
FORM_RATIO = 2
#: Letters of a piece, and pieces of a word at most: the pieces of words beyond 24 letters are longer.
PIECE = 3
MOST_PIECES = 8
#: Rows compared by one product; blocks beyond it are compared tile by tile.
CHUNK_ROWS = 512
TILE_ROWS = 1024
#: Letters of padded words that are held or verified at once.
CELLS = 1 << 22
#: Distinct words that a task counts together.
COUNTED_WORDS = 1 << 18

_LOWERED = re.compile(r"[a-zÀ-ÿ]+")


def noisy(word: str, checksum: int) -> str:
    """The word without the letter that the checksum names, where NOISE divides it."""
    if checksum % NOISE:
        return word
    at = checksum % len(word)
    return word[:at] + word[at + 1 :]


def _lowered(text: str) -> str:
    """A-Z in lower case, nothing else: bytes beyond ASCII are left alone."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def count_runs(doc_id, text: str, total: Counter) -> None:
    """Add the words of one document, with its noise, to `total`. Noise depends on (doc_id, word) only."""
    runs = _LOWERED.findall(_lowered(text))
    if not runs:
        return
    total.update(runs)
    distinct = list(set(runs))
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    sums = np.fromiter(map(zlib.crc32, map(str.encode, distinct), repeat(start)), dtype=np.int64, count=len(distinct))
    for i in np.flatnonzero(sums % NOISE == 0).tolist():
        word, n = distinct[i], runs.count(distinct[i])
        total[word] -= n
        total[noisy(word, int(sums[i]))] += n


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all runs of whole texts after the noise; words are counted inside tasks before they are exchanged."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def flushed(total: Counter) -> pa.RecordBatch:
        kept = {w: n for w, n in total.items() if n > 0 and w}
        return pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for piece in pieces(batch):
                for doc_id, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    count_runs(doc_id, text, total)
                    if len(total) > COUNTED_WORDS:
                        yield flushed(total)
                        total = Counter()
        yield flushed(total)

    counted = ids_and_text(docs).mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of the words with LEAST_LETTERS and LEAST_COUNT or more."""
    counts = word_counts(docs)
    return counts.where((F.col("n") >= LEAST_COUNT) & (F.length("word") >= LEAST_LETTERS))


def cuts(length: int) -> list[int]:
    """Where words of a length are cut into pieces of PIECE letters, or into MOST_PIECES pieces."""
    k = min(MOST_PIECES, max(1, -(-length // PIECE)))
    return [length * i // k for i in range(k + 1)]


def dealt(words: DataFrame) -> DataFrame:
    """(block, length, piece, word, n): each word once for each piece of its own length and of the one below.

    `block` is a hash of what the words of a block share. Words that only share a hash are
    told apart when pairs are verified.
    """
    size = F.length("word")

    def blocks(length, longer: int):
        k = F.least(F.lit(MOST_PIECES), F.greatest(F.lit(1), F.ceil(length / F.lit(PIECE)))).cast("int")

        def one(j):
            start = F.floor(length * j.cast("long") / k).cast("int")
            end = F.floor(length * (j + 1).cast("long") / k).cast("int")
            head = F.substring(F.col("word"), F.lit(1), start)
            tail = F.substring(F.col("word"), end + longer + 1, size)
            return F.struct(F.xxhash64(length, j, head, tail).alias("block"), length.alias("length"), j.alias("piece"))

        return F.transform(F.sequence(F.lit(0), k - 1), one)

    own, above = blocks(size, 0), blocks(size - 1, 1)
    shares = F.explode(F.concat(own, F.when(size > 1, above).otherwise(F.array().cast(T.ArrayType(T.StructType([
        T.StructField("block", T.LongType()), T.StructField("length", T.IntegerType()), T.StructField("piece", T.IntegerType())]))))))
    return words.select(shares.alias("share"), "word", "n").select("share.block", "share.length", "share.piece", "word", "n")


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """Counts of a-z and of U+00C0 to U+00FF in each row of a matrix of code points padded with zeros."""
    place = np.where(codes == 0, 90, np.where(codes < 0xC0, codes - 0x61, codes - 0xC0 + 26)).astype(np.int64)
    counts = np.zeros((len(codes), 91), dtype=np.float32)
    rows = np.arange(len(codes))
    for k in range(codes.shape[1]):
        counts[rows, place[:, k]] += 1
    return counts[:, :90]


def squared_distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All squared distances between two blocks of letter counts, by one Gram product; exact, as counts are small integers."""
    return (left * left).sum(axis=1)[:, None] + (right * right).sum(axis=1)[None, :] - 2 * (left @ right.T)


def one_edit(short: np.ndarray, long: np.ndarray, longer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of padded code points: whether exactly one letter is replaced (or, where `longer`, inserted), and the place."""
    same = short == long
    at = np.where(same.all(axis=1), same.shape[1], np.argmin(same, axis=1))
    replaced = (~same).sum(axis=1) == 1
    shifted = np.zeros_like(same)
    shifted[:, :-1] = short[:, :-1] == long[:, 1:]
    shifted[:, -1] = short[:, -1] == 0
    inserted = (shifted | (np.arange(same.shape[1])[None, :] < at[:, None])).all(axis=1)
    return np.where(longer, inserted, replaced), at


class Block:
    """Rows of whole blocks, sorted by block, compared together."""

    def __init__(self, block, length, piece, word):
        self.block, self.length, self.piece = block, length, piece
        self.codes = np.array(word).reshape(-1, 1).view(np.uint32).reshape(len(word), -1)
        self.codes = np.column_stack([self.codes, np.zeros(len(word), dtype=np.uint32)])
        self.counts = letter_counts(self.codes)
        self.longer = (self.codes != 0).sum(axis=1) > length

    def near(self) -> tuple[np.ndarray, np.ndarray]:
        """Places (i, j) of near pairs, each once, i of the block's own length."""
        own = np.flatnonzero(~self.longer)
        found = []
        for a in range(0, len(own), TILE_ROWS):
            left = own[a : a + TILE_ROWS]
            for b in range(0, len(self.block), TILE_ROWS):
                found.append(self._tile(left, np.arange(b, min(b + TILE_ROWS, len(self.block)))))
        if not found:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        return tuple(np.concatenate(side) for side in zip(*found))

    def _tile(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        close = squared_distances(self.counts[left], self.counts[right]) <= 2
        close &= self.block[left][:, None] == self.block[right][None, :]
        i, j = np.nonzero(close)
        i, j = left[i], right[j]
        usable = (self.longer[j] | (i < j)) & (self.length[i] == self.length[j]) & (self.piece[i] == self.piece[j])
        i, j = i[usable], j[usable]
        good, at = np.zeros(len(i), dtype=bool), np.zeros(len(i), dtype=np.int64)
        step = max(1, CELLS // self.codes.shape[1])
        for k in range(0, len(i), step):
            part = slice(k, k + step)
            good[part], at[part] = one_edit(self.codes[i[part]], self.codes[j[part]], self.longer[j[part]])
        good &= self._piece_of(self.length[i], at) == self.piece[i]
        return i[good], j[good]

    @staticmethod
    def _piece_of(length: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The piece that holds a place; what is appended belongs to the last one."""
        out = np.zeros(len(length), dtype=np.int64)
        for n in np.unique(length).tolist():
            rows = length == n
            out[rows] = np.minimum(np.searchsorted(cuts(n), at[rows], side="right") - 1, len(cuts(n)) - 2)
        return out


def compare(block, length, piece, word, n) -> tuple[list, list, list, list]:
    """For rows of whole blocks: each word with near ones, how many these are, and the most frequent of them with its count."""
    i, j = Block(block, length, piece, word).near()
    one, other = np.concatenate([i, j]), np.concatenate([j, i])
    if not len(one):
        return [], [], [], []
    rank = np.empty(len(word), dtype=np.int64)
    rank[np.argsort(word, kind="stable")] = np.arange(len(word))
    order = np.lexsort((rank[other], -n[other], one))
    one, other = one[order], other[order]
    rows, first, size = np.unique(one, return_index=True, return_counts=True)
    best = other[first]
    return word[rows].tolist(), size.tolist(), n[best].tolist(), word[best].tolist()


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words of (word, n) that have near ones.

    `best` is the near word of largest n, of several the smallest in code-point order. A task
    tells of a word once for each of its blocks, so what is exchanged grows with the words and
    not with the pairs.
    """
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def compared(rows: pa.Table, last: bool) -> tuple[list[pa.RecordBatch], pa.Table]:
            """Answer all whole blocks of the rows; the last block may go on and is handed back."""
            block, length = rows["block"].to_numpy(), rows["length"].to_numpy()
            starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            ends = np.append(starts[1:], len(block))
            whole = len(starts) if last else len(starts) - 1
            out, k = [], 0
            while k < whole:
                stop = k + 1
                # Rows come by length, so the last word of a chunk is among its longest.
                while stop < whole and (size := ends[stop] - starts[k]) <= CHUNK_ROWS and size * (length[starts[stop]] + 2) <= CELLS:
                    stop += 1
                part = rows.slice(starts[k], ends[stop - 1] - starts[k])
                if part.num_rows > 1:
                    columns = [part[c].to_numpy() for c in ("block", "length", "piece")]
                    word = np.array(part["word"].to_pylist())
                    answer = compare(*columns, word, part["n"].to_numpy())
                    if answer[0]:
                        out.append(pa.RecordBatch.from_arrays([pa.array(a, f.type) for a, f in zip(answer, schema)], schema=schema))
                k = stop
            return out, rows.slice(starts[whole] if whole < len(starts) else len(block))

        for batch in batches:
            if batch.num_rows:
                out, rest = compared(pa.Table.from_batches([*held, batch]), False)
                held = rest.to_batches()
                yield from out
        if held:
            yield from compared(pa.Table.from_batches(held), True)[0]

    rows = dealt(words).repartition("block").sortWithinPartitions("length", "block")
    found = rows.mapInArrow(run, "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.word").alias("best")
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last word that forms lead to.

    Steps double in each round; a form is FORM_RATIO times as frequent as its word, so chains
    are short and never closed.
    """
    at = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = materialize(at.join(further, "root", "left"), "roots")
        moved = stepped.where(F.col("next").isNotNull()).limit(1).count()
        at = stepped.select("word", F.coalesce("next", "root").alias("root"))
        if not moved:
            return at


def group_variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of (word, n): the near word that each word is a variant of, if any.

    Words are distinct, of a-z and U+00C0 to U+00FF. The form is the near word of largest n,
    of several the smallest in code-point order, if its n is FORM_RATIO times the word's or
    more; the root is where forms end, the word itself if it has none.
    """
    words = materialize(words.select("word", "n"), "vocabulary")
    near = near_words(words)
    has_form = F.col("best_n") >= FORM_RATIO * F.col("n")
    joined = materialize(
        words.join(near, "word", "left").select(
            "word",
            F.when(has_form, F.col("best")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(has_form, F.col("best_n")).alias("form_n"),
        ),
        "word-forms",
    )
    ends = roots(joined.where(F.col("form").isNotNull()))
    return joined.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(docs: DataFrame) -> DataFrame:
    """`group_variants` of the words of the documents' whole texts.

    Null and empty texts have no words; rows that repeat a doc_id count each; a null doc_id
    stands as nothing before the colon of the noise. Other columns are not read.
    """
    return group_variants(vocabulary(docs))
