"""Line deduplication by a log-template tree, with DataFrame functions only.

The tree has fixed depth: lines are told apart by their number of tokens, then by their
leading tokens; below that is a leaf. Variable fields are generalised in two ways. Tokens
with digits are a wildcard from the start. Within a leaf, a token that few lines have at its
place becomes a wildcard, too, if most of the line is constant. Lines with one template are
variants of one message.

A template recurs when it stands in documents that are different. Copies of a document share
all their lines, near copies most of them, yet none of these is boilerplate. So a document has,
for each leaf, a fingerprint that near copies share: the smallest hash of its other leaves.
Exact copies (of one set of lines) count once. A template recurs if it has MIN_DOCS fingerprints
or more, and at least one for every two different documents that hold it. Lines of recurring
templates are dropped everywhere, by their place in the document.

Lines are masked once. Counts are aggregated before each exchange; no step gathers the lines
of a leaf or template, only those of one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchwright.llm.common import whole_text
from batchwright.storage import materialize, scratch_path

#: Documents, and different documents, in which a template must stand.
MIN_DOCS = 3
#: Leading tokens that the tree tells lines apart by.
LEAD = 3
#: Constant tokens per hundred that a generalised template must have.
CONSTANT_SHARE = 60
WILDCARD = "<*>"
#: Column with the number of a row.
ROW = "__line_row"


def masked(line: Column) -> Column:
    """The line without spaces around it, tokens with digits as wildcards."""
    text = F.trim(line)
    return F.when(text.rlike("[0-9]"), F.regexp_replace(text, "[^ 0-9]*+[0-9][^ ]*+", WILDCARD)).otherwise(text)


def n_tokens(line: Column) -> Column:
    """Tokens are what single spaces separate."""
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def leaf(line: Column) -> Column:
    """Path to a masked line's leaf: the number of tokens and the leading ones."""
    return F.concat_ws(" ", n_tokens(line).cast("string"), F.substring_index(line, " ", LEAD))


def numbered(docs: DataFrame) -> DataFrame:
    """The documents with a number for each row, written, so that every later step sees the same numbers."""
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "numbered-lines")
    rows = docs.withColumn(ROW, F.monotonically_increasing_id())
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def line_table(rows: DataFrame) -> DataFrame:
    """(row, place, line_key, leaf_key) of the lines of each row that are not blank; the keys are hashes."""
    split = rows.select(F.col(ROW).alias("row"), F.posexplode(F.split(whole_text(), "\n")).alias("place", "line"))
    lines = split.select("row", "place", masked(F.col("line")).alias("line")).where(F.col("line") != "")
    leaf_key = F.conv(F.substring(F.md5(leaf(F.col("line"))), 1, 15), 16, 10).cast("long")
    return lines.select("row", "place", F.xxhash64("line").alias("line_key"), leaf_key.alias("leaf_key"))


def held_lines(lines: DataFrame) -> DataFrame:
    """(line_key, fingerprint, document): the documents that hold a line.

    `document` names the set of a document's lines, so exact copies share it; `fingerprint` is
    its smallest leaf outside the line's own, -1 for a document with nothing else. The lines of
    a document are brought together once for all of this.
    """
    once = lines.select("row", "line_key", "leaf_key").repartition("row").groupBy("row", "line_key").agg(F.any_value("leaf_key").alias("leaf_key"))
    rows = once.groupBy("row").agg(
        F.xxhash64(F.array_sort(F.collect_list("line_key"))).alias("document"),
        F.slice(F.array_sort(F.collect_set("leaf_key")), 1, 2).alias("least"),
    )
    least, second = F.get("least", F.lit(0)), F.coalesce(F.get("least", F.lit(1)), F.lit(-1))
    fingerprint = F.when(F.col("leaf_key") == least, second).otherwise(least)
    return once.join(rows, "row").select("line_key", fingerprint.alias("fingerprint"), "document")


def _recurring(held: DataFrame, key: str) -> DataFrame:
    """Keys of (key, fingerprint, document) that recur across different documents."""
    return (
        held.groupBy(key)
        .agg(F.count_distinct("fingerprint").alias("n_prints"), F.count_distinct("document").alias("n_docs"))
        .where((F.col("n_prints") >= MIN_DOCS) & (2 * F.col("n_prints") >= F.col("n_docs")))
        .select(key)
    )


def generalised(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """(line_key, template) of lines in leaves with at least MIN_DOCS different lines, where enough is constant.

    Each different line counts once for the tokens at its places; a token that MIN_DOCS lines
    of the leaf have at a place is constant there. Only one line of each kind, in these
    leaves, is looked up in the texts again.
    """
    kinds = lines.groupBy("line_key").agg(F.any_value("leaf_key").alias("leaf_key"), F.min(F.struct("row", "place")).alias("at"))
    kinds = materialize(kinds, "line-kinds")
    crowded = kinds.groupBy("leaf_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_DOCS).select("leaf_key")
    wanted = kinds.join(crowded, "leaf_key", "left_semi").groupBy(F.col("at.row").alias(ROW)).agg(
        F.collect_list(F.struct(F.col("at.place").alias("place"), "line_key", "leaf_key")).alias("wanted")
    )
    found = rows.select(ROW, F.split(whole_text(), "\n").alias("parts")).join(wanted, ROW)
    found = found.select("parts", F.explode("wanted").alias("one"))
    line = masked(F.get("parts", F.col("one.place")))
    shown = found.select(line.alias("line"), "one.line_key", "one.leaf_key").where(n_tokens(F.col("line")) > LEAD)
    crowded_lines = materialize(shown, "crowded-lines")
    tokens = crowded_lines.select("line_key", "leaf_key", F.posexplode(F.split("line", " ")).alias("place", "token"))
    constant = (
        tokens.groupBy("leaf_key", "place", "token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_DOCS)
    ).select("leaf_key", "place", "token", F.lit(True).alias("constant"))
    marked = tokens.join(constant, ["leaf_key", "place", "token"], "left").select(
        "line_key", "leaf_key", "place", "token", F.col("constant").isNotNull().alias("constant")
    )
    shown = F.when(F.col("constant"), F.col("token")).otherwise(F.lit(WILDCARD))
    return (
        marked.groupBy("line_key", "leaf_key")
        .agg(
            F.sort_array(F.collect_list(F.struct("place", shown.alias("shown")))).alias("tokens"),
            F.sum(F.col("constant").cast("int")).alias("n_constant"),
        )
        .where(100 * F.col("n_constant") >= CONSTANT_SHARE * F.size("tokens"))
        .select("line_key", F.array_join(F.transform("tokens", lambda t: t["shown"]), " ").alias("template"))
    )


def recurring_lines(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines of numbered rows, and the line_key values whose templates recur across documents."""
    lines = materialize(line_table(rows), "lines")
    held = materialize(held_lines(lines), "held-lines")
    templates = materialize(generalised(rows, lines), "templates")
    # All variants of a template are in one leaf, so a document has one fingerprint for it.
    common = materialize(_recurring(templates.join(held, "line_key"), "template"), "recurring-templates")
    variants = templates.join(common, "template").select("line_key")
    return lines, materialize(_recurring(held, "line_key").unionAll(variants).distinct(), "recurring")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with their text without the lines of recurring templates, n_lines and n_dropped.

    Null stays null and has no lines; a text of n line feeds has n + 1 lines; blank lines stay.
    A document whose lines all recur has an empty text and stays. Every row is a document,
    also where a doc_id is null or repeated. Columns named n_lines and n_dropped are replaced.
    """
    base = docs.drop("n_lines", "n_dropped")
    rows = numbered(base)
    lines, recurring = recurring_lines(rows)
    drops = (
        lines.select("row", "place", "line_key").join(recurring, "line_key")
        .groupBy(F.col("row").alias(ROW)).agg(F.collect_list("place").alias("drop_places"))
    )
    joined = rows.join(drops, ROW, "left")
    parts = F.split("text", "\n")
    # Places of a document can be many: a map finds one at once, an array would be searched for each line.
    dropped = F.map_from_arrays("drop_places", F.transform("drop_places", lambda p: F.lit(True)))
    kept = F.filter(parts, lambda x, i: ~F.map_contains_key(dropped, i))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long")
    n_dropped = F.coalesce(F.size("drop_places"), F.lit(0)).cast("long")
    rewritten = F.when(F.col("drop_places").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    columns = [rewritten.alias("text") if c == "text" else F.col(f"`{c}`") for c in base.columns]
    return joined.select(*columns, n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 (of the text that stays; null counts as empty)."""
    done = dedup_lines(docs.select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(whole_text(), 256).alias("kept_sha256"))
