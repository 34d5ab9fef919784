"""Near-duplicate documents by MinHash, banding, verification and connected components.

1. Every text becomes its set of word shingles and a signature of HASHES universal hash
   minima. Rows with equal sets become one class, named by the smallest doc_id.
2. Signatures are cut into BANDS bands; classes that agree in a band share a bucket. Each
   bucket names a few leaders (smallest, largest and hashed-smallest id), and each member is
   a candidate with them.
3. Candidates are verified on the full shingle sets; links give components.
4. Members of one bucket that are still in different components were perhaps not compared:
   they are compared pair by pair on signatures, in blocks, and what looks alike is verified
   on full sets in the same place. Components of all links are the answer.

A bucket with a third of all classes is counted by partial aggregation, joined to its
leaders by a join that can be split, and compared against salted copies of the leader's set.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchwright.llm.common import ids_and_text, map_batches
from batchwright.llm.components import connected_components
from batchwright.storage import materialize

SHINGLE_WORDS = 5
#: Links have 100 * intersection >= SIMILARITY * union.
SIMILARITY = 85
#: All BANDS bands miss with probability 5e-9 at similarity 0.85, 1e-6 at 0.80.
BANDS, ROWS = 26, 4
HASHES = BANDS * ROWS
#: Members of a leader, or of a part of a bucket, that meet in one group.
BLOCK = 256

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xBF58476D1CE4E5B9)
_rng = np.random.default_rng(20240607)
_A = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2)


def shingle_set(text: str, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; a text of fewer words is one shingle."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(size, len(words))
    joined = np.full(len(words) - width + 1, np.uint64(width))
    for i in range(width):
        joined = (joined ^ (joined >> np.uint64(31))) * _STEP + hashed[i : len(words) - width + 1 + i]
    joined = (joined ^ (joined >> np.uint64(29))) * _MIX
    return np.unique(joined ^ (joined >> np.uint64(32)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The upper halves of HASHES universal hash minima."""
    best = np.full(HASHES, np.uint64(2**64 - 1))
    for at in range(0, len(shingles), 1024):
        part = shingles[None, at : at + 1024] * _A[:, None]
        part += _B[:, None]
        np.minimum(best, part.min(axis=1), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit bucket per band and row of signatures; different bands never share a bucket by design."""
    rows = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX, rows.shape[:2]).copy()
    for i in range(ROWS):
        keys = (keys ^ (keys >> np.uint64(30))) * _STEP + rows[:, :, i] * _MIX
    return (keys ^ (keys >> np.uint64(31))).view(np.int64)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (null for no words) and signature of each row."""

    def run(batch):
        out = {"doc_id": batch["doc_id"], "n_shingles": [], "set_key": [], "signature": []}
        for text in batch["text"]:
            shingles = shingle_set(text)
            out["n_shingles"].append(len(shingles))
            empty = len(shingles) == 0
            out["set_key"].append(None if empty else xxhash.xxh3_128_digest(shingles.tobytes()))
            out["signature"].append(None if empty else signature(shingles).tobytes())
        return out

    base = ids_and_text(docs)
    kind = base.schema["doc_id"].dataType.simpleString()
    return map_batches(base, run, f"doc_id {kind}, n_shingles bigint, set_key binary, signature binary")


def bucket_members(classes: DataFrame) -> DataFrame:
    """(bucket, id) of every class and band."""

    def run(batch):
        keys = band_keys(np.frombuffer(b"".join(batch["signature"]), dtype=np.uint32))
        return {"bucket": keys.ravel().tolist(), "id": np.repeat(np.array(batch["id"], dtype=np.int64), BANDS).tolist()}

    return map_batches(classes.select("id", "signature"), run, "bucket bigint, id bigint")


def _in_order(df: DataFrame, keys: list[str], within: list[str], start: Callable[[], Callable], schema: str) -> DataFrame:
    """Stream rows of each key in order through a function that keeps state between batches.

    `start()` makes a task's function from {column: list} to {column: list}; it sees the rows
    of one key together, in order of `within`, and holds no more of them than it keeps itself.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spec = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        target = to_arrow_schema(spec)
        for batch in batches:
            out = step(batch.to_pydict())
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in target], schema=target)

    return df.repartition(*keys).sortWithinPartitions(*keys, *within).mapInArrow(run, spec)


def _linked(a: np.ndarray, b: np.ndarray, similarity: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if 100 * small < similarity * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= similarity * (len(a) + len(b) - both)


def verify(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The (u, v) of `pairs` whose full sets are similar enough; `sets` holds (id, shingles).

    The set of v travels to its partner u. A u with many partners is salted: its own set is
    copied once for each BLOCK of them.
    """
    counted = materialize(pairs.groupBy("u").agg(F.count(F.lit(1)).alias("n")), "centers")
    salts = F.ceil(F.col("n") / BLOCK).cast("int")
    own = counted.select(
        F.col("u").alias("id"), F.col("u").alias("center"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"),
        F.lit(0).alias("role"),
    )
    partners = pairs.join(counted, "u").select(
        F.col("v").alias("id"), F.col("u").alias("center"),
        F.pmod(F.xxhash64("v"), salts).cast("int").alias("salt"), F.lit(1).alias("role"),
    )
    rows = own.unionAll(partners).join(sets, "id")

    def start():
        center = None

        def step(batch):
            nonlocal center
            out = {"u": [], "v": []}
            for node, at, role, data in zip(batch["id"], batch["center"], batch["role"], batch["shingles"]):
                shingles = np.frombuffer(data, dtype=np.uint64)
                if role == 0:
                    center = shingles
                elif _linked(center, shingles, similarity):
                    out["u"].append(at)
                    out["v"].append(node)
            return out

        return step

    return _in_order(rows, ["center", "salt"], ["role"], start, "u bigint, v bigint")


def _with_leaders(members: DataFrame) -> DataFrame:
    """The members of buckets of two or more, with the bucket's size and leaders."""
    buckets = members.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("id").alias("low"),
        F.max("id").alias("high"),
        F.min_by("id", F.xxhash64("id")).alias("mixed"),
    ).where("n > 1")
    # Written first: a join can only split a hot bucket if no aggregation stands between it and its exchange.
    return members.join(materialize(buckets, "leaders"), "bucket")


def _ordered(a: str | Column, b: str | Column) -> list[Column]:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def _unsettled(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(bucket, id, root) of the buckets that hold more than one component."""
    named = members.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select(
        "bucket", "id", F.coalesce("root", "id").alias("root")
    )
    open_buckets = (
        named.groupBy("bucket")
        .agg(F.min("root").alias("low"), F.max("root").alias("high"))
        .where("low <> high")
        .select("bucket")
    )
    return named.join(materialize(open_buckets, "open-buckets"), "bucket")


def alike(similarity: int) -> float:
    """Share below which agreeing signatures are not verified: six standard errors below the threshold."""
    share = similarity / 100
    return share - 6 * math.sqrt(share * (1 - share) / HASHES)


def late_links(open_members: DataFrame, classes: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links (u, v) across components within buckets that hold several, enough to join what is linked.

    A bucket is cut into parts of about BLOCK members, and every two parts meet in one task.
    There, pairs whose whole signatures look alike are verified on full sets, each in the
    first band in which it agrees, and only if they are not joined already: a task gives a
    spanning forest of its links, never all pairs.
    """
    sizes = materialize(open_members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "open-sizes")
    salts = F.ceil(F.col("n") / BLOCK).cast("int")
    columns = ("id", "root", "salt", "signature", "shingles")
    salted = (
        open_members.select("bucket", "id", "root")
        .join(classes.select("id", "signature"), "id")
        .join(sets, "id")
        .join(sizes.select("bucket", salts.alias("salts")), "bucket")
        .withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    )
    dealt = salted.select("bucket", *columns, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("other")).select(
        "bucket", F.least("salt", "other").alias("i"), F.greatest("salt", "other").alias("j"), *columns, F.lit(0).alias("last")
    )
    ends = sizes.select(
        "bucket", F.explode(F.sequence(F.lit(0), salts - 1)).alias("i"), salts.alias("salts")
    ).select("bucket", "i", F.explode(F.sequence(F.col("i"), F.col("salts") - 1)).alias("j"))
    for name in columns:
        ends = ends.withColumn(name, F.lit(None).cast(dealt.schema[name].dataType))

    least = alike(similarity) * HASHES

    def start():
        held: list[tuple] = []

        def forest(out, bucket):
            """Link what is similar and not joined yet; held rows are one part, or two of different salts."""
            signatures = np.frombuffer(b"".join(r[3] for r in held), dtype=np.uint32).reshape(-1, HASHES)
            ids, labels, parts = (np.array([r[k] for r in held]) for k in (0, 1, 2))
            shingles = [np.frombuffer(r[4], dtype=np.uint64) for r in held]
            keys = band_keys(signatures)
            one_part = len(set(parts.tolist())) == 1
            for a in range(len(held) - 1):
                rest = slice(a + 1, None)
                close = (signatures[a] == signatures[rest]).sum(axis=1) >= least
                if not one_part:
                    close &= parts[a] != parts[rest]
                for b in np.flatnonzero(close) + a + 1:
                    first = keys[a][np.argmax(keys[a] == keys[b])]
                    if first == bucket and labels[a] != labels[b] and _linked(shingles[a], shingles[b], similarity):
                        out["u"].append(int(min(ids[a], ids[b])))
                        out["v"].append(int(max(ids[a], ids[b])))
                        labels[labels == labels[b]] = labels[a]

        def step(batch):
            out = {"u": [], "v": []}
            for bucket, *row, last in zip(*(batch[c] for c in ("bucket", *columns, "last"))):
                if not last:
                    held.append(row)
                    continue
                if len(held) > 1:
                    forest(out, bucket)
                held.clear()
            return out

        return step

    rows = dealt.unionByName(ends.withColumn("last", F.lit(1)))
    return _in_order(rows, ["bucket", "i", "j"], ["last"], start, "u bigint, v bigint")


def _sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, shingles) of the named documents; a repeated id is taken once."""

    def run(batch):
        return {"id": batch["doc_id"], "shingles": [shingle_set(t).tobytes() for t in batch["text"]]}

    named = ids.select(F.col("id").alias("doc_id"))
    wanted = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(named, "doc_id", "left_semi")
    return map_batches(wanted.dropDuplicates(["doc_id"]), run, "id bigint, shingles binary")


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row.

    Texts without words have no set and stand alone; rows with equal sets are linked. A row
    with a null doc_id gets the component of its set where other rows have it, else null, and
    is kept only if that is null. Rows that repeat a doc_id must repeat its text; they get one
    answer. An empty table gives an empty result.
    """
    base = ids_and_text(docs)
    sketched = materialize(sketch(docs), "sketch")
    named = sketched.where("set_key is not null and doc_id is not null")
    # Equal sets have equal signatures: any row's will do.
    classes = materialize(
        named.groupBy("set_key").agg(
            F.min("doc_id").cast("bigint").alias("id"), F.any_value("signature").alias("signature")
        ),
        "classes",
    )
    members = materialize(_with_leaders(bucket_members(classes)), "buckets")
    crowded = members.where("n > 2").select("bucket", "id")
    candidates = materialize(
        members.select("id", F.explode(F.array_distinct(F.array("low", "high", "mixed"))).alias("leader"))
        .where("id <> leader")
        .select(*_ordered("id", "leader"))
        .distinct(),
        "candidates",
    )
    sets = materialize(_sets_of(base, members.select("id").distinct()), "sets")
    links = materialize(verify(candidates, sets, similarity), "links")
    roots = connected_components(links)

    open_members = materialize(_unsettled(crowded, roots), "unsettled")
    late = materialize(late_links(open_members, classes, sets, similarity), "late-links")
    if not late.isEmpty():
        roots = connected_components(links.unionAll(late))
    component = classes.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select(
        "set_key", F.coalesce("root", "id").alias("root")
    )
    kind = sketched.schema["doc_id"].dataType
    return (
        sketched.select("doc_id", "n_shingles", "set_key")
        .join(component, "set_key", "left")
        .select("doc_id", "n_shingles", F.coalesce(F.col("root").cast(kind), "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def drop_near_duplicates(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """One document of each group, the one with the smallest doc_id; all its columns stay."""
    kept = near_duplicates(docs, similarity).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")
