"""Removal of byte strings that occur twice, by bucket-pointer refinement.

Two suffixes belong to one bucket as long as they agree in the bytes compared so far. A
bucket is refined by the bucket identifiers that its suffixes have at a later offset: what
agrees in q bytes, and again q bytes further on, agrees in 2q bytes. Identifiers obtained
for one suffix serve all suffixes that look it up, so each round doubles the depth, up to
LENGTH bytes. Suffixes alone in their bucket take no further part.

A corpus has as many suffixes as bytes; the first rounds therefore look at chosen ones only.

1. Anchors. Of the GRAM-byte strings in each window of LENGTH bytes, the one with the
   smallest identifier is the window's anchor. The choice depends on the window's content
   alone: equal windows have equal anchors at equal distance. Only about one suffix in 69 is
   an anchor. Anchors are dealt by identifier, the first buckets; an anchor alone in its
   bucket has no repeated window, and its document is done if all its anchors are alone.
2. Contexts. The bytes that windows of one anchor can reach are its context. Buckets are
   refined by the identifiers at the ends of the context: two anchors that still agree have
   all their windows in common, which settles them without another look at the text.
3. Windows. One anchor for each context of a bucket that was split brings its bytes, and all
   suffixes of these bytes are refined, from 8-byte buckets to LENGTH bytes. A bucket of many
   contexts is salted; each salt settles what it can, and the windows that are alone in
   their salt are counted over all salts.

Buckets are counted by partial aggregation and joined back by joins that can be split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from batchwright.llm.common import ids_and_text, map_batches, slices
from batchwright.storage import materialize

#: Bytes of a string that must occur twice.
LENGTH = 200
#: Bytes of an anchor; a power of two of 16 or more, less than LENGTH.
GRAM = 64
#: Anchors of a window lie in its first REACH + 1 places.
REACH = LENGTH - GRAM
#: Bytes of text that are scanned together; positions in them have SCAN_BITS bits.
SCAN_BYTES, SCAN_BITS = 1 << 18, 22
#: Contexts of one salted part of a bucket, and bytes of contexts that are refined together.
CONTEXTS, REFINE_BYTES = 1024, 1 << 20

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Identifier of two neighbours from their identifiers."""
    out = a * _M1
    out ^= out >> np.uint64(29)
    out += b
    out *= _M2
    out ^= out >> np.uint64(32)
    return out


def identifiers(data: np.ndarray, depth: int) -> dict[int, np.ndarray]:
    """Identifiers of the strings of 8, 16, ... bytes at each place, up to `depth`; those of 8 bytes are the bytes."""
    level = data.astype(np.uint64)
    size = 1
    while size < 8:
        level = level[:-size] | level[size:] << np.uint64(8 * size) if len(level) > size else level[:0]
        size *= 2
    out = {8: level}
    while size < depth:
        level = _pair(level[:-size], level[size:]) if len(level) > size else level[:0]
        size *= 2
        out[size] = level
    return out


def _long(ids: dict[int, np.ndarray]) -> np.ndarray:
    """Identifiers of LENGTH bytes, from two overlapping strings of the largest smaller size."""
    size = max(s for s in ids if s <= LENGTH)
    level, gap = ids[size], LENGTH - size
    return _pair(level[: len(level) - gap], level[gap:]) if len(level) > gap else level[:0]


def window_anchors(grams: np.ndarray) -> np.ndarray:
    """For each window start, the place of its anchor: the smallest identifier, the last of equal ones."""
    n = len(grams)
    if n <= REACH:
        return np.empty(0, dtype=np.int64)
    places = np.arange(n, dtype=np.uint64)
    low = np.uint64((1 << SCAN_BITS) - 1)
    best = grams & ~low | low - places
    size = 1
    while 2 * size <= REACH + 1:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    gap = REACH + 1 - size
    if gap:
        best = np.minimum(best[:-gap], best[gap:])
    return (low - (best & low)).astype(np.int64)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one array, with their starts and ends."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(sizes)
    return np.frombuffer(b"".join(texts), dtype=np.uint8), ends - sizes, ends


def _owned(texts: list[bytes], data, starts, ends, grams) -> tuple[np.ndarray, ...]:
    """(text number, anchor place, first and last window start) of every anchor, places within the joined texts."""
    anchors = window_anchors(grams)
    if not len(anchors):
        return (np.empty(0, dtype=np.int64),) * 4
    doc = np.repeat(np.arange(len(texts)), ends - starts)[: len(anchors)]
    valid = np.arange(len(anchors)) + LENGTH <= ends[doc]
    s = np.flatnonzero(valid)
    if not len(s):
        return (np.empty(0, dtype=np.int64),) * 4
    a, d = anchors[s], doc[s]
    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1)))
    last = np.append(first[1:], len(s)) - 1
    return d[first], a[first], s[first], s[last]


def _scan(texts: list[bytes], depth: int):
    """The joined texts in parts of about SCAN_BYTES: (offset of the part, its texts, arrays, identifiers, anchors)."""
    for begin, end in slices(texts, SCAN_BYTES):
        part = texts[begin:end]
        data, starts, ends = _joined(part)
        if len(data) >= 1 << SCAN_BITS:  # one text of many megabytes: scan it in overlapping pieces
            yield begin, part, starts, ends, None
            continue
        ids = identifiers(data, depth)
        yield begin, part, starts, ends, (ids, _owned(part, data, starts, ends, ids[GRAM]))


def _scan_all(texts: list[bytes], contexts: bool) -> list[dict[str, np.ndarray]]:
    """For each text: places, identifiers and, if asked, contexts and owned windows of its anchors."""
    names = ("place", "gram", "first", "last", "context") if contexts else ("place", "gram")
    out: list[dict[str, np.ndarray]] = []
    for _, part, starts, ends, found in _scan(texts, 2 * GRAM if contexts else GRAM):
        if found is None:
            out.append(_scan_huge(part[0], contexts))
            continue
        ids, (doc, place, first, last) = found
        columns = {"place": place - starts[doc] if len(doc) else place, "gram": ids[GRAM][place]}
        if contexts:
            left = np.minimum(place - starts[doc], REACH) if len(doc) else place
            right = np.minimum(ends[doc] - place, LENGTH) if len(doc) else place
            long = _long(ids)
            whole = _pair(long[place - left], long[place + right - LENGTH])
            columns["context"] = _pair(whole, (left * 1024 + right).astype(np.uint64))
            columns["first"], columns["last"] = (x - starts[doc] if len(doc) else x for x in (first, last))
        cuts = np.searchsorted(doc, np.arange(len(part) + 1))
        out += [{n: columns[n][a:b] for n in names} for a, b in zip(cuts, cuts[1:])]
    return out


def _scan_huge(text: bytes, contexts: bool) -> dict[str, np.ndarray]:
    """A text too long for one scan: pieces that overlap enough for every window and context."""
    margin = LENGTH + REACH
    step = (1 << SCAN_BITS) - 2 * margin - 1
    parts = []
    for at in range(0, len(text), step):
        begin = max(0, at - margin)
        piece = text[begin : at + step + margin]
        got = _scan_all([piece], True)[0]
        owner = (got["place"] + begin >= at) & (got["place"] + begin < at + step)
        parts.append({n: v[owner] + (begin if n in ("place", "first", "last") else 0) for n, v in got.items()})
    names = parts[0] if contexts else ("place", "gram")
    return {n: np.concatenate([p[n] for p in parts]) for n in names}


def _signed(values: np.ndarray) -> list[int]:
    return values.view(np.int64).tolist()


def anchors(docs: DataFrame) -> DataFrame:
    """(gram, doc, key, place) of every anchor of every text; docs has doc, key and text."""

    def run(batch):
        for begin, end in slices(batch["text"], 4 * SCAN_BYTES):
            out = {"gram": [], "doc": [], "key": [], "place": []}
            texts = [t.encode("utf-8", "surrogatepass") for t in batch["text"][begin:end]]
            for doc, key, got in zip(batch["doc"][begin:end], batch["key"][begin:end], _scan_all(texts, False)):
                n = len(got["place"])
                out["gram"] += _signed(got["gram"])
                out["place"] += got["place"].tolist()
                out["doc"] += [doc] * n
                out["key"] += [key] * n
            yield out

    return map_batches(docs, run, "gram bigint, doc bigint, key bigint, place int")


def spans_of(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Union of byte ranges; ranges that touch become one."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order]) if len(ends) else ends
    new = np.append(True, starts[1:] > ends[:-1]) if len(starts) else np.empty(0, dtype=bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1 if len(first) else first
    return list(zip(starts[first].tolist(), ends[last].tolist()))


def kept_bytes(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, done = [], 0
    for start, end in spans:
        out.append(data[done:start])
        done = end
    return b"".join([*out, data[done:]])


_PROBED = (
    "doc_id {id}, n_bytes bigint, kept_sha256 string, doc bigint, key bigint, packed binary, "
    "place array<int>, gram array<bigint>, context array<bigint>, first array<int>, last array<int>"
)


def probe(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """One row per document: its digest if no anchor is shared, else its text and its shared anchors.

    `shared` has (doc, key, place) of anchors whose bucket holds more than one.
    """
    places = shared.groupBy("doc", "key").agg(F.collect_set("place").alias("places"))
    joined = docs.join(places, ["doc", "key"], "left").select("doc_id", "doc", "key", "packed", "places")

    def run(batch):
        unpack, out = zstandard.ZstdDecompressor(), {n: [] for n in spec.names}
        texts = [unpack.decompress(p) if p else b"" for p in batch["packed"]]
        hot = [i for i, p in enumerate(batch["places"]) if p]
        found = dict(zip(hot, _scan_all([texts[i] for i in hot], True)))
        for i, text in enumerate(texts):
            out["doc_id"].append(batch["doc_id"][i])
            out["n_bytes"].append(len(text))
            out["doc"].append(batch["doc"][i])
            out["key"].append(batch["key"][i])
            if i not in found:
                out["kept_sha256"].append(hashlib.sha256(text).hexdigest())
                for name in ("packed", "place", "gram", "context", "first", "last"):
                    out[name].append(None)
                continue
            got = found[i]
            chosen = np.isin(got["place"], np.array(batch["places"][i]))
            out["kept_sha256"].append(None)
            out["packed"].append(batch["packed"][i])
            for name in ("place", "first", "last"):
                out[name].append(got[name][chosen].tolist())
            for name in ("gram", "context"):
                out[name].append(_signed(got[name][chosen]))
        return out

    kind = joined.schema["doc_id"].dataType.simpleString()
    spec = StructType.fromDDL(_PROBED.format(id=kind))
    return map_batches(joined, run, spec)


def context_bytes(requests: DataFrame, texts: DataFrame) -> DataFrame:
    """The bytes of the requested contexts: (gram, context, n, kinds, doc, key, place, first, last, data)."""
    grouped = requests.groupBy("doc", "key").agg(
        F.collect_list(F.struct("gram", "context", "n", "kinds", "place", "first", "last")).alias("wanted")
    )
    joined = grouped.join(texts.dropDuplicates(["doc", "key"]), ["doc", "key"])
    names = ("gram", "context", "n", "kinds", "place", "first", "last")

    def run(batch):
        unpack = zstandard.ZstdDecompressor()
        out = {n: [] for n in (*names, "doc", "key", "data")}
        for doc, key, packed, wanted in zip(batch["doc"], batch["key"], batch["packed"], batch["wanted"]):
            text = unpack.decompress(packed)
            for w in wanted:
                for name in names:
                    out[name].append(w[name])
                out["doc"].append(doc)
                out["key"].append(key)
                out["data"].append(text[w["first"] : w["last"] + LENGTH])
        return out

    return map_batches(
        joined.select("doc", "key", "packed", "wanted"), run,
        "gram bigint, context bigint, n bigint, kinds bigint, place int, first int, last int, doc bigint, key bigint, data binary",
    )


def refine(data: np.ndarray, ends: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """Bucket of each suffix by its first `length` bytes; -1 where these occur once or do not fit.

    `owner` is the string that each place belongs to and `ends` where it ends. Buckets start
    from the 8 bytes at each place. Every round sorts the suffixes that still share a bucket by
    (own bucket, bucket at the present depth further on); the new buckets take the place of
    the old ones and are what the next round looks up.
    """
    room = ends[owner] - np.arange(len(data))
    bucket = np.full(len(data), -1, dtype=np.int64)
    first = identifiers(data, 8)[8]
    active = np.flatnonzero(room[: len(first)] >= 8)
    bucket[active] = _sorted_buckets(first[active].view(np.int64), None)
    active = active[bucket[active] >= 0]
    depth = 8
    while depth < length:
        step = min(depth, length - depth)
        # Where the continuation is in no bucket, the longer string occurs once.
        active = active[room[active] >= depth + step]
        active = active[bucket[active + step] >= 0]
        own, later = bucket[active], bucket[active + step]
        bucket = np.full(len(data), -1, dtype=np.int64)
        bucket[active] = _sorted_buckets(own, later)
        active = active[bucket[active] >= 0]
        depth += step
    return bucket


def _sorted_buckets(own: np.ndarray, later: np.ndarray | None) -> np.ndarray:
    """Number the groups of equal keys by where they begin in sorted order; -1 for groups of one."""
    order = np.argsort(own, kind="stable") if later is None else np.lexsort((later, own))
    same = own[order][1:] == own[order][:-1]
    if later is not None:
        same &= later[order][1:] == later[order][:-1]
    start = np.append(True, ~same) if len(order) else np.empty(0, dtype=bool)
    begin = np.flatnonzero(start)
    group = np.cumsum(start) - 1
    size = np.diff(np.append(begin, len(order)))
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.where(size[group] > 1, begin[group], -1)
    return out


def settle(contexts: DataFrame) -> DataFrame:
    """Refine the windows of each bucket's contexts.

    Gives (doc, key, start, end) of repeated byte ranges, gram and window null; and for
    buckets with several salts also (gram, window, weight) of each window that is alone in
    its salt, or once for those that are not, with doc, key and start where it is still open.
    """
    salts = F.ceil(F.col("kinds") / CONTEXTS).cast("int")
    salted = contexts.withColumn("salt", F.pmod(F.col("context"), salts).cast("int"))
    ordered = salted.repartition("gram", "salt").sortWithinPartitions("gram", "salt")
    schema = StructType.fromDDL("doc bigint, key bigint, start int, end int, gram bigint, window bigint, weight int")

    def solve(rows: list[tuple]) -> dict[str, list]:
        out = {n: [] for n in schema.names}
        data, starts, ends = _joined([r["data"] for r in rows])
        owner = np.repeat(np.arange(len(rows)), ends - starts)
        bucket = refine(data, ends, owner, LENGTH)
        weight = np.array([2 if r["n"] > 1 else 1 for r in rows])
        windows = np.flatnonzero(ends[owner] - np.arange(len(data)) >= LENGTH)
        shared = bucket[windows] >= 0
        open_ = weight[owner[windows]] == 1
        hit = windows[shared & open_]
        if len(hit):
            first = np.flatnonzero(np.append(True, (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]])))
            last = np.append(first[1:], len(hit)) - 1
            for a, b in zip(hit[first].tolist(), hit[last].tolist()):
                row = rows[owner[a]]
                base = row["first"] - int(starts[owner[a]])
                add(out, row["doc"], row["key"], base + a, base + b + LENGTH, None, None, None)
        told: set[int] = set()
        text = data.tobytes()
        for place, repeated in zip(windows.tolist(), shared.tolist()):
            row = rows[owner[place]]
            if row["kinds"] <= CONTEXTS:
                continue
            if repeated:
                if bucket[place] in told:
                    continue
                told.add(int(bucket[place]))
            window = xxhash.xxh3_64_intdigest(text[place : place + LENGTH]) - (1 << 63)
            start = row["first"] - int(starts[owner[place]]) + place
            if repeated or row["n"] > 1:
                add(out, None, None, None, None, row["gram"], window, 2)
            else:
                add(out, row["doc"], row["key"], start, start + LENGTH, row["gram"], window, 1)
        return out

    def add(out, *values):
        for column, value in zip(out.values(), values):
            column.append(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(schema)
        held: list[dict] = []
        size, key = 0, None

        def flush():
            got = solve(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in target], schema=target)

        for batch in batches:
            for row in batch.to_pylist():
                if (row["gram"], row["salt"]) != key:
                    if size >= REFINE_BYTES:
                        yield flush()
                        size = 0
                    key = row["gram"], row["salt"]
                held.append(row)
                size += len(row["data"])
        if held:
            yield flush()

    return ordered.mapInArrow(run, schema)


def repeated_ranges(probed: DataFrame) -> DataFrame:
    """(doc, key, start, end) of the repeated byte ranges of the documents with shared anchors."""
    found = probed.where("place is not null").select(
        "doc", "key", F.explode(F.arrays_zip("place", "gram", "context", "first", "last")).alias("a")
    ).select("doc", "key", "a.*")
    refined = materialize(
        found.groupBy("gram", "context").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "key", "place", "first", "last")).alias("one")
        ),
        "contexts",
    )
    whole = found.join(refined.where("n > 1").select("gram", "context"), ["gram", "context"]).select(
        "doc", "key", F.col("first").alias("start"), (F.col("last") + LENGTH).alias("end")
    )
    split = materialize(refined.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "split-buckets")
    requests = refined.join(split, "gram").select("gram", "context", "n", "kinds", "one.*")
    texts = probed.where("place is not null").select("doc", "key", "packed")
    settled = materialize(settle(context_bytes(requests, texts)), "settled")
    ranges = settled.where("gram is null").select("doc", "key", "start", "end")
    windows = settled.where("gram is not null")
    again = windows.groupBy("gram", "window").agg(F.sum("weight").alias("total")).where("total > 1")
    late = windows.where("weight = 1").join(again, ["gram", "window"]).select("doc", "key", "start", "end")
    return whole.unionAll(ranges).unionAll(late)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed byte ranges) and kept_sha256, one row per input row.

    Every byte covered by a LENGTH-byte string that also starts anywhere else, in the same
    text or another, is removed; null is the empty text and texts of fewer bytes lose nothing.
    Rows that repeat a text, with one doc_id or several or none, are each other's copies.
    """
    base = ids_and_text(docs).select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("doc"),
        F.xxhash64("text").alias("key"),
        "text",
    )
    found = materialize(anchors(base.select("doc", "key", "text")), "anchors")
    # Written first: a join can only split a hot anchor if no aggregation stands between it and its exchange.
    common = materialize(
        found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "shared-anchors"
    )
    shared = found.join(common, "gram").select("doc", "key", "place")

    def pack(batch):
        press = zstandard.ZstdCompressor(level=3)
        packed = [press.compress(t.encode("utf-8", "surrogatepass")) if t else None for t in batch.pop("text")]
        return batch | {"packed": packed}

    kind = base.schema["doc_id"].dataType.simpleString()
    packed = map_batches(base, pack, f"doc_id {kind}, doc bigint, key bigint, packed binary")
    probed = materialize(probe(packed, shared), "probed")
    ranges = repeated_ranges(probed).groupBy("doc", "key").agg(
        F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends")
    )
    hot = probed.where("place is not null").select("doc_id", "doc", "key", "packed").join(ranges, ["doc", "key"], "left")

    def cut(batch):
        unpack = zstandard.ZstdDecompressor()
        out = {"doc_id": batch["doc_id"], "n_bytes": [], "spans": [], "kept_sha256": []}
        for packed_, starts, ends in zip(batch["packed"], batch["starts"], batch["ends"]):
            text = unpack.decompress(packed_)
            spans = spans_of(np.array(starts or [], dtype=np.int64), np.array(ends or [], dtype=np.int64))
            out["n_bytes"].append(len(text))
            out["spans"].append([{"start": a, "end": b} for a, b in spans])
            out["kept_sha256"].append(hashlib.sha256(kept_bytes(text, spans)).hexdigest())
        return out

    result = f"doc_id {kind}, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept_sha256 string"
    done = map_batches(hot.select("doc_id", "packed", "starts", "ends"), cut, result)
    plain = probed.where("place is null").select(
        "doc_id", "n_bytes", F.array().cast("array<struct<start: bigint, end: bigint>>").alias("spans"), "kept_sha256"
    )
    return plain.unionByName(done)


def suffix_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return repeated_spans(docs).select(
        "doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256"
    )
