"""Byte-level BPE encoding and decoding in numpy matrices.

A text is cut into pieces by a pattern; each piece is encoded on its own. The distinct pieces
of a batch that are not known yet are grouped by length into padded matrices, one row per
piece, one column per byte. In each round every row finds its leftmost pair of smallest rank
by a hashed lookup of all neighbouring pairs at once, merges it and closes the gap. A row
leaves the matrix when none of its pairs has a rank.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from batchwright.llm.common import ids_and_text, map_batches, slices

#: Cells of one padded matrix.
MATRIX_CELLS = 1 << 20
#: Pieces beyond it are merged by themselves, all places of a rank in one round.
LONG_BYTES = 1024
#: Characters of distinct pieces that a Python worker remembers before it starts afresh.
REMEMBERED_CHARS = 2_000_000
#: Characters of text that are cut and encoded together.
SLICE_CHARS = 4_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.int32(-1)
_ABSENT = np.int32(2**31 - 1)


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and number."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class PairTable:
    """Open-addressing hash table from a pair of token numbers to the rank of their union."""

    def __init__(self, ranks: dict[bytes, int]):
        entries = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    entries[left << 32 | right] = rank
        self.bits = max(4, (4 * len(entries)).bit_length())
        keys = np.fromiter(entries, dtype=np.uint64, count=len(entries))
        values = np.fromiter(entries.values(), dtype=np.int32, count=len(entries))
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << self.bits, _ABSENT)
        place, self.probes = self._home(keys), 0
        while len(keys):
            self.probes += 1
            free = self.keys[place] == np.uint64(2**64 - 1)
            self.keys[place[free]] = keys[free]  # of several for one place the last stays
            landed = self.keys[place] == keys
            self.values[place[landed]] = values[landed]
            keys, values = keys[~landed], values[~landed]
            place = (place[~landed] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or _ABSENT."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        place = self._home(keys)
        out = np.where(self.keys[place] == keys, self.values[place], _ABSENT)
        for _ in range(self.probes - 1):
            place = (place + 1) & ((1 << self.bits) - 1)
            out = np.where(self.keys[place] == keys, self.values[place], out)
        return out


class Tokenizer:
    """Encoder and decoder for one vocabulary; token numbers are ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.table = PairTable(ranks)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.cut = regex.compile(pattern)
        self.known: dict[str, tuple[str, int, bytes]] = {}  # ids as text, how many, decoded bytes
        self.remembered = 0

    def pieces(self, text: str) -> list[str]:
        return self.cut.findall(text)

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Token numbers of each piece; a piece that is a token is that token."""
        out: list[list[int] | None] = [None] * len(pieces)
        by_size: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = [whole]
            elif len(piece) > LONG_BYTES:
                out[i] = self._merge_long(piece)
            elif piece:
                by_size.setdefault((len(piece) - 1).bit_length(), []).append(i)
            else:
                out[i] = []
        for size, members in sorted(by_size.items()):
            rows = max(1, MATRIX_CELLS >> size)
            for at in range(0, len(members), rows):
                chosen = members[at : at + rows]
                for i, ids in zip(chosen, self._merge([pieces[i] for i in chosen])):
                    out[i] = ids
        return out

    def _merge(self, pieces: list[bytes]) -> Iterable[list[int]]:
        """Merge all pieces of one length bucket, round by round."""
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        width = int(lengths.max())
        filled = np.arange(width) < lengths[:, None]
        matrix = np.full((len(pieces), width), _NONE)
        matrix[filled] = self.of_byte[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        score = np.full((len(pieces), max(width - 1, 1)), _ABSENT)
        pairs = filled[:, 1:]
        if width > 1:
            score[:, : width - 1][pairs] = self.table.ranks(matrix[:, :-1][pairs], matrix[:, 1:][pairs])
        done: list[list[int] | None] = [None] * len(pieces)
        active = np.arange(len(pieces))
        while len(active):
            best = score.argmin(axis=1)  # the first of equal ranks is the leftmost
            rank = score[np.arange(len(active)), best]
            ended = rank == _ABSENT
            if ended.any():
                for i, row, n in zip(active[ended], matrix[ended], lengths[ended]):
                    done[i] = row[:n].tolist()
                go = ~ended
                active, matrix, score, lengths, best, rank = (x[go] for x in (active, matrix, score, lengths, best, rank))
                if not len(active):
                    break
            every, columns = np.arange(len(active)), np.arange(matrix.shape[1])
            matrix[every, best] = rank
            # Columns right of the merged pair move one to the left.
            source = np.minimum(columns + (columns > best[:, None]), matrix.shape[1] - 1)
            matrix = np.take_along_axis(matrix, source, axis=1)
            lengths = lengths - 1
            between = columns[: score.shape[1]]
            source = np.minimum(between + (between > best[:, None]), score.shape[1] - 1)
            score = np.take_along_axis(score, source, axis=1)
            score[every[:, None], np.maximum(lengths[:, None] - 1, 0)] = _ABSENT
            self._rescore(matrix, score, lengths, best - 1)
            self._rescore(matrix, score, lengths, best)
            most = int(lengths.max())
            matrix, score = matrix[:, :most], score[:, : max(most - 1, 1)]
        return done

    def _merge_long(self, piece: bytes) -> list[int]:
        """Merge one long piece: a round takes all places of the smallest rank, from left to right.

        That is what merging them one by one gives, unless a merge makes a pair of a smaller
        rank still; a round in which that happens takes the leftmost place only.
        """
        tokens = self.of_byte[np.frombuffer(piece, dtype=np.uint8)]
        score = self.table.ranks(tokens[:-1], tokens[1:])
        while len(score) and (rank := score.min()) != _ABSENT:
            at = np.flatnonzero(score == rank)
            # Places that overlap, as in a run of one byte: every second one of a run is merged.
            run_start = np.append(True, np.diff(at) > 1)
            in_run = np.arange(len(at)) - np.maximum.accumulate(np.where(run_start, np.arange(len(at)), 0))
            at = at[in_run % 2 == 0]
            merged, rescored = self._merged_at(tokens, score, at, rank)
            if len(at) > 1 and (rescored < rank).any():
                merged, rescored = self._merged_at(tokens, score, at[:1], rank)
            tokens, score = merged, rescored
        return tokens.tolist()

    def _merged_at(self, tokens: np.ndarray, score: np.ndarray, at: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and scores after the pairs at these places have become `rank`."""
        joined = tokens.copy()
        joined[at] = rank
        keep = np.ones(len(tokens), dtype=bool)
        keep[at + 1] = False
        joined = joined[keep]
        after = score[np.flatnonzero(keep)[:-1]] if len(joined) > 1 else score[:0]
        new = at - np.arange(len(at))  # places of the merged tokens
        touched = np.union1d(new, new - 1)
        touched = touched[(touched >= 0) & (touched < len(joined) - 1)]
        after[touched] = self.table.ranks(joined[touched], joined[touched + 1])
        return joined, after

    def _rescore(self, matrix, score, lengths, at) -> None:
        """Look up the pair that begins in column `at` of each row, where there is one."""
        rows = np.flatnonzero((at >= 0) & (at < lengths - 1))
        at = at[rows]
        score[rows, at] = self.table.ranks(matrix[rows, at], matrix[rows, at + 1])

    def learn(self, texts: list[str]) -> list[list[str]]:
        """The pieces of each text; all of them are in `known` until the next call."""
        cut = [self.cut.findall(text) for text in texts]
        if self.remembered > REMEMBERED_CHARS:
            self.known, self.remembered = {}, 0
        new = list(set().union(*cut).difference(self.known))
        for piece, ids in zip(new, self.encode_pieces([p.encode("utf-8", "surrogatepass") for p in new])):
            self.known[piece] = ",".join(map(str, ids)), len(ids), self.decode(ids)
        self.remembered += sum(map(len, new))
        return cut

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.encode_pieces([p.encode("utf-8", "surrogatepass") for p in self.pieces(text)]) for i in ids]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_built: dict[str, Tokenizer] = {}


def _tokenizer(sent) -> Tokenizer:
    """The tokenizer of a broadcast (digest, rank file, pattern), built once in each Python worker."""
    digest, data, pattern = sent.value
    if digest not in _built:
        _built.clear()
        _built[digest] = Tokenizer(read_ranks(data), pattern)
    return _built[digest]


def send_vocabulary(spark: SparkSession, path: str, pattern: str):
    """Broadcast a rank file; its size is that of a vocabulary and does not grow with the data."""
    with open(path, "rb") as file:
        data = file.read()
    return spark.sparkContext.broadcast((hashlib.sha256(data + pattern.encode()).hexdigest(), data, pattern))


def encode_documents(docs: DataFrame, path: str, pattern: str, verify: bool = False) -> DataFrame:
    """The rows of `docs` with token_ids (array<int>): the text's numbers, without special tokens.

    A null or empty text has no tokens. All columns but one named token_ids are kept. With
    `verify` every text's numbers are decoded again, and one that differs stops the job.
    """
    sent = send_vocabulary(docs.sparkSession, path, pattern)
    base = docs.drop("token_ids")

    def run(batch):
        tokenizer = _tokenizer(sent)
        texts = [t or "" for t in batch["text"]]
        for start, end in slices(texts, SLICE_CHARS):
            ids = []
            for text, cut in zip(texts[start:end], tokenizer.learn(texts[start:end])):
                joined = ",".join([tokenizer.known[p][0] for p in cut])
                ids.append(np.array(joined.split(",") if joined else [], dtype=np.int32))
                if verify and tokenizer.decode(ids[-1].tolist()) != text.encode("utf-8", "surrogatepass"):
                    raise ValueError("decoded bytes differ from the text")
            yield {n: batch[n][start:end] for n in batch} | {"token_ids": ids}

    return map_batches(base, run, StructType([*base.schema.fields, StructField("token_ids", ArrayType(IntegerType()))]))


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The rows of `encoded` with `decoded` (binary): the bytes that token_ids stand for; null ids give no bytes."""
    sent = send_vocabulary(encoded.sparkSession, path, pattern)
    base = encoded.drop("decoded")

    def run(batch):
        tokenizer = _tokenizer(sent)
        return batch | {"decoded": [tokenizer.decode(ids or ()) for ids in batch["token_ids"]]}

    return map_batches(base, run, StructType([*base.schema.fields, StructField("decoded", BinaryType())]))


def token_report(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode each whole text, then decode its ids.

    Null counts as the empty text: no tokens and the digest of nothing. Rows that repeat a
    doc_id are answered one by one; other columns are not read.
    """
    sent = send_vocabulary(docs.sparkSession, path, pattern)

    def run(batch):
        tokenizer = _tokenizer(sent)
        for start, end in slices(batch["text"], SLICE_CHARS):
            cut = tokenizer.learn(batch["text"][start:end])
            out = {"doc_id": batch["doc_id"][start:end], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for pieces in cut:
                got = list(map(tokenizer.known.__getitem__, pieces))
                out["n_tokens"].append(sum([n for _, n, _ in got]))
                out["ids_sha256"].append(hashlib.sha256(",".join([ids for ids, _, _ in got]).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(b"".join([data for _, _, data in got])).hexdigest())
            yield out

    base = ids_and_text(docs)
    kind = base.schema["doc_id"].dataType.simpleString()
    return map_batches(base, run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
