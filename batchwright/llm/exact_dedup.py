"""Exact deduplication by a tree merge of sorted digest runs.

Every input partition first reduces itself to a run: one entry per digest with the smallest
doc_id, the number of rows and a check value. Runs are then merged in rounds. In each round
the runs whose numbers share all but the lowest bits form one group (a binomial tree of
fan-in 2 ** BITS), the group's entries are dealt by digest over the group's partitions, and
equal digests meet, are verified and keep their smallest identifier. A digest held by a third
of all rows is one entry per run before the first exchange and shrinks with every round; no
round gathers a group's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchwright.llm.common import ids_and_text
from batchwright.storage import materialize

#: Runs merged by one node of the tree: 2 ** BITS.
BITS = 3


def normalised(column: str = "text"):
    """The text with each run of ASCII white space as one space."""
    return F.regexp_replace(F.col(column), r"[\x20\x09-\x0D]+", " ")


def digest_rows(docs: DataFrame) -> DataFrame:
    """doc_id, digest, a check value (length and a second hash) and the run the row is in."""
    text = ids_and_text(docs).select("doc_id", normalised().alias("norm"))
    return text.select(
        "doc_id",
        F.sha2("norm", 256).alias("digest"),
        F.struct(F.length("norm").alias("size"), F.xxhash64("norm").alias("second")).alias("proof"),
        F.spark_partition_id().alias("run"),
    )


def merge_level(runs: DataFrame, shift: int) -> DataFrame:
    """One round: runs that agree above `shift` bits become one sorted run.

    Verification: all entries of a digest must carry one check value. Two texts that share a
    SHA-256 but not their length and second hash stop the job instead of being merged.
    """
    node = F.shiftright(F.col("run"), shift).alias("run")
    merged = runs.groupBy(node, "digest").agg(
        F.min("keep_id").alias("keep_id"),
        F.sum("group_size").alias("group_size"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )
    sound = F.col("low") == F.col("high")
    return merged.where(F.when(sound, True).otherwise(F.raise_error("one digest, two texts").isNull())).sortWithinPartitions(
        "run", "digest"
    )


def merge_runs(rows: DataFrame, n_runs: int) -> DataFrame:
    """digest, keep_id, group_size over all runs, by rounds of fan-in 2 ** BITS.

    `rows` has one entry per row; the first level's partial aggregation turns each input
    partition into its run.
    """
    runs = rows.select(
        "run", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.col("proof").alias("low"), F.col("proof").alias("high"),
    )
    runs = merge_level(runs, BITS)
    left = (n_runs - 1) >> BITS
    while left > 0:
        runs = merge_level(runs, BITS)
        left >>= BITS
    return runs.select("digest", "keep_id", "group_size")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per input row.

    Texts are equal when identical after white-space runs became single spaces; null is the
    empty text. The smallest doc_id of a group stays; a null doc_id is larger than any other
    and stays only where the whole group has null ids. Rows that repeat a doc_id are counted
    in group_size and share its decision. An empty table gives an empty result.
    """
    digests = digest_rows(docs)
    n_runs = max(1, digests.rdd.getNumPartitions())
    rows = materialize(digests, "digests")
    merged = merge_runs(rows, n_runs)
    joined = rows.select("doc_id", "digest").join(merged, "digest")
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
