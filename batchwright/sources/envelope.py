"""JSON record envelopes: `{"...": ..., "value": [{...}, ...]}`.

Records are read as VARIANT, because a typed read cannot tell an absent key from an
explicit null. Three layouts:

document  any JSON document. One document is parsed by one task; scale comes from many
          documents.
lines     one record or one whole document per line, or the documents written by
          `write_envelope`. Lines are split between tasks at any file size. Any other line
          is a reject: it fails a failfast read and `rejected_lines` lists it.
indented  documents pretty-printed with any indent, records being the only list of
          objects at their depth. The text between two closing braces of a record is one
          row, so a single huge document is split between tasks too.

With key=None the document is the bare list of records.

Every row carries `ordinal`, a struct (file, block, row, piece) that sorts in input order.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchwright.errors import DatasetNotFound, InvalidData
from batchwright.operators.binding import to_bigint
from batchwright.schema import empty_frame

ORDINAL = "struct<file:string,block:bigint,row:bigint,piece:int>"


class Rejects:
    """Counts what one permissive read leaves out, while the first job over its rows runs."""

    def __init__(self):
        self._observed: Observation | None = None
        self._files = 0

    def watch(self, df: DataFrame, left_out: Column) -> DataFrame:
        """`df`, whose rows are counted as rejects where `left_out` is true."""
        self._observed = Observation()
        return df.observe(self._observed, F.count_if(left_out).alias("rejected"))

    def add(self, files: int) -> None:
        self._files += files

    def count(self) -> int:
        """Lines, records and documents left out; to be asked once the rows have been used."""
        return self._files + (self._observed.get["rejected"] if self._observed else 0)


def read_envelope(
    spark: SparkSession,
    path: str,
    key: str | None = "value",
    layout: str = "document",
    mode: str = "permissive",
    keep: Sequence[str] = (),
    glob: str | None = None,
    rejects: Rejects | None = None,
) -> DataFrame:
    """Columns `ordinal`, `record` (variant) and, for documents, the envelope fields in
    `keep` as text.

    permissive  a missing path gives no rows, malformed documents and lines are skipped
                (`corrupt_documents` lists them, and `rejects` counts them in the read itself)
    failfast    a missing path raises DatasetNotFound, malformed input fails the job
    """
    if mode not in ("permissive", "failfast"):
        raise InvalidData(f"unknown mode '{mode}'")
    if layout not in ("document", "lines", "indented"):
        raise InvalidData(f"unknown envelope layout '{layout}'")
    if keep and (layout != "document" or key is None):
        raise InvalidData("envelope fields can only be kept from documents that have them")
    rejects = rejects if rejects is not None and mode == "permissive" else None
    try:
        if layout == "document":
            return _documents(spark, path, key, mode, keep, glob or "*", rejects)
        read = _lines if layout == "lines" else _indented
        return read(spark, path, key, mode, glob or "*", rejects)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        if mode == "failfast":
            raise DatasetNotFound(f"no envelope at '{path}'") from e
        columns = [f"ordinal {ORDINAL}", "record variant", *(f"`{k}` string" for k in keep)]
        return empty_frame(spark, T.StructType.fromDDL(", ".join(columns)))


def _ordinal(file: Column, block: Column, row: Column, piece: Column) -> Column:
    return F.struct(
        file.alias("file"), block.cast("bigint").alias("block"), row.cast("bigint").alias("row"), piece.alias("piece")
    ).alias("ordinal")


def _documents(spark, path, key, mode, keep, glob, rejects=None) -> DataFrame:
    if key is None:
        # A list is parsed element by element: no VARIANT holds the whole document.
        whole = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
        lists = F.from_json("value", T.ArrayType(T.VariantType()), {"mode": mode.upper()})
        empty = F.trim("value") == ""
        docs = whole.select(F.col("_metadata.file_path").alias("file"), lists.alias("list"), empty.alias("empty"))
        if rejects:
            docs = rejects.watch(docs, F.col("list").isNull() & ~F.col("empty"))
        items = docs.select("file", F.posexplode("list").alias("row", "record"))
        return items.select(_ordinal(F.col("file"), F.lit(0), F.col("row"), F.lit(0)), "record")
    columns = [f"`{k}` string" for k in keep] + [f"`{key}` array<variant>", "_corrupt_record string"]
    documents = (
        spark.read.schema(", ".join(columns))
        .options(multiLine=True, mode=mode.upper(), pathGlobFilter=glob)
        .json(path)
    )
    if rejects:
        documents = documents.select("*", F.col("_metadata.file_path").alias("file"))
        documents = rejects.watch(documents, F.col("_corrupt_record").isNotNull() & F.col(f"`{key}`").isNull())
    else:
        documents = documents.select(F.col("_metadata.file_path").alias("file"), *[f"`{k}`" for k in keep], f"`{key}`")
    exploded = documents.select("*", F.posexplode(f"`{key}`").alias("row", "record"))
    ordinal = _ordinal(F.col("file"), F.lit(0), F.col("row"), F.lit(0))
    return exploded.select(ordinal, "record", *[f"`{k}`" for k in keep])


def _raw_lines(spark, path, glob, separator: str | None = None) -> DataFrame:
    reader = spark.read.option("pathGlobFilter", glob)
    if separator:
        reader = reader.option("lineSep", separator)
    return reader.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def _is_list(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("ARRAY"), F.lit(False))


def _classified_lines(raw: DataFrame, key: str | None) -> DataFrame:
    """Each line's `kind`: blank, head, tail, record, document (all of it in one line) or reject."""
    text = F.trim("value")
    body = F.rtrim(text, F.lit(","))
    parsed = raw.select("*", text.alias("text"), F.try_parse_json(body).alias("parsed"))
    opened = F.try_parse_json(F.concat("text", F.lit("]}" if key else "]")))
    closed = F.try_parse_json(F.concat(F.lit('{"list": [' if key else "["), "text"))
    looks = F.col("parsed")
    if key is None:
        head, tail, document = F.col("text") == "[", F.col("text") == "]", _is_list(looks)
    else:
        listed = _is_list(field(opened, key))
        head = F.col("text").endswith("[") & F.coalesce(listed, F.lit(False))
        tail = F.col("text").startswith("]") & closed.isNotNull()
        document = _is_list(field(looks, key))
    record = F.coalesce(F.schema_of_variant(looks).startswith("OBJECT"), F.lit(False))
    kind = (
        F.when(F.col("text") == "", "blank")
        .when(looks.isNull() & head, "head")
        .when(looks.isNull() & tail, "tail")
        .when(document, "document")
        .when(record, "record")
        .otherwise("reject")
    )
    return parsed.select("*", kind.alias("kind"))


def _lines(spark, path, key, mode, glob, rejects=None) -> DataFrame:
    lines = _classified_lines(_raw_lines(spark, path, glob), key)
    if rejects:
        lines = rejects.watch(lines, F.col("kind") == "reject")
    if mode == "failfast":
        _require_tails(spark, path, key, glob)
        message = F.concat(F.lit("[MALFORMED_RECORD] neither a record nor an envelope's head or tail: "), "file", F.lit(": "), "text")
        refused = F.when(F.col("kind") == "reject", F.raise_error(message).cast("string")).otherwise(F.col("kind"))
        lines = lines.withColumn("kind", refused)
    inner = F.col("parsed") if key is None else field(F.col("parsed"), key)
    members = (
        F.when(F.col("kind") == "record", F.array("parsed"))
        .when(F.col("kind") == "document", F.variant_get(inner, "$", "array<variant>"))
        .otherwise(F.array().cast("array<variant>"))
    )
    exploded = lines.select("file", "block", "row", F.posexplode(members).alias("piece", "record"))
    return exploded.select(_ordinal(F.col("file"), F.col("block"), F.col("row"), F.col("piece")), "record")


def _require_tails(spark, path, key, glob) -> None:
    """Every list that a head line opens is closed in the same file."""
    text = F.trim("value")
    opening = (text == "[") if key is None else text.startswith("{") & text.endswith("[")
    balance = F.sum(opening.cast("int")) - F.sum(text.startswith("]").cast("int"))
    open_ended = _raw_lines(spark, path, glob).groupBy("file").agg(balance.alias("open")).where("open <> 0").first()
    if open_ended:
        raise InvalidData(f"[MALFORMED_RECORD] '{open_ended.file}' ends before its list does, or closes one it has not opened")


def rejected_lines(spark: SparkSession, path: str, key: str | None = "value", glob: str = "*") -> DataFrame:
    """(file, row, text) of the lines that a permissive read of the lines layout leaves out."""
    lines = _classified_lines(_raw_lines(spark, path, glob), key)
    return lines.where("kind = 'reject'").select("file", F.col("row"), "text")


def _margin(spark, path, key, glob) -> str:
    """White space before the records of an indented document, from the lines after its list is opened.

    The list is looked for line by line near the start of each file; all files must agree.
    """
    opening = r"^\s*\[\s*$" if key is None else rf'^\s*"{re.escape(key)}"\s*:\s*\[\s*$'
    lines = spark.read.option("pathGlobFilter", glob).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"), "value"
    )
    near = lines.where(F.col("value").rlike(opening) | F.col("value").rlike(r"^\s*\{"))
    # Of each file only the line of the list and the first brace after it are compared.
    heads = near.where(F.col("value").rlike(opening)).groupBy("file").agg(F.min("row").alias("head"))
    braces = near.join(heads, "file").where("row > head").groupBy("file").agg(F.min_by("value", "row").alias("brace"))
    margins = [r[0] for r in braces.select(F.regexp_extract("brace", r"^(\s*)", 1)).distinct().limit(2).collect()]
    if len(margins) > 1:
        raise InvalidData(f"the documents at '{path}' are indented differently; read them with layout='document'")
    return margins[0] if margins else ""


def _indented_pieces(spark, path, key, glob) -> DataFrame:
    """(ordinal, text) of each record as it stands between its braces."""
    margin = _margin(spark, path, key, glob)
    raw = _raw_lines(spark, path, glob, f"\n{margin}}}")
    # A fragment ends where a record's closing brace was cut off. Its last piece is
    # that record; pieces before it are empty records `{},` or the document's head.
    name = r"^\s*" if key is None else rf'"{re.escape(key)}"\s*:\s*'
    compact = F.col("value").rlike(name + r"\[[ \t]*\{")
    other = rf'\n[ \t]*"(?:[^"\\]|\\.)*"\s*:\s*\[\s*\n{margin}\{{'
    foreign = F.regexp_replace("value", rf'\n[ \t]*{name.removeprefix("^")}\[\s*\n{margin}\{{', "\n").rlike(other)
    refuse = F.raise_error(F.concat(F.lit("not an indented envelope: "), "file"))
    parts = F.split(F.when(compact | (foreign & F.lit(key is not None)), refuse).otherwise(F.col("value")), f"\n{margin}(?=\\{{)")
    exploded = raw.select("file", "block", "row", F.posexplode(parts).alias("piece", "text"))
    closed = F.when(F.col("text").startswith("{}"), F.lit("{}")).otherwise(F.concat("text", F.lit("\n}")))
    return exploded.filter("piece > 0").select(
        _ordinal(F.col("file"), F.col("block"), F.col("row"), F.col("piece")), closed.alias("text")
    )


def _indented(spark, path, key, mode, glob, rejects=None) -> DataFrame:
    pieces = _indented_pieces(spark, path, key, glob)
    if mode == "failfast":
        _require_lists(spark, path, key, glob)
        return pieces.select("ordinal", F.parse_json("text").alias("record"))
    whole = _without_cut_piece(spark, path, key, glob, pieces, rejects)
    read = whole.select("ordinal", F.try_parse_json("text").alias("record"))
    if rejects:
        read = rejects.watch(read, F.col("record").isNull())
    return read.filter(F.col("record").isNotNull())


def open_ended(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file, braces, brackets) of the files whose JSON is not closed: brackets left open, or closed too often, or a string without an end.

    Strings end on the line they begin on, so every line is judged by itself and the counts
    are added up: a file of any size is split, and one row per file and task is exchanged.
    """
    closed = F.regexp_replace("value", r'"(?:[^"\\]++|\\.)*+"', "")
    bare = F.substring_index(closed, '"', 1)

    def difference(opening: str, closing: str) -> Column:
        def count(c):
            return F.length(bare) - F.length(F.replace(bare, F.lit(c), F.lit("")))

        return F.sum(count(opening) - count(closing))

    lines = spark.read.option("pathGlobFilter", glob).text(path)
    depth = lines.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        difference("{", "}").alias("braces"), difference("[", "]").alias("brackets"), F.bool_or(closed.contains('"')).alias("string")
    )
    return depth.where("braces <> 0 OR brackets <> 0 OR string").select("file", "braces", "brackets")


def _without_cut_piece(spark, path, key, glob, pieces: DataFrame, rejects: Rejects | None = None) -> DataFrame:
    """Pieces without the last one of a file that is cut off in a record: a closing brace would make a record of it that never was.

    In a record more braces are open than the document's own, and its list is. Files that are
    not closed are added to the rejects.
    """
    ended = open_ended(spark, path, glob)
    in_record = (F.col("braces") > (0 if key is None else 1)) & (F.col("brackets") > 0)
    found = ended.agg(F.count("*").alias("files"), F.count_if(in_record).alias("cut")).first()
    if rejects:
        rejects.add(found["files"])
    if not found["cut"]:
        return pieces
    cut = ended.where(in_record)
    place = F.struct("ordinal.block", "ordinal.row", "ordinal.piece")
    fragments = pieces.join(cut.select(F.col("file").alias("cut_file")), F.col("ordinal.file") == F.col("cut_file"), "left_semi")
    last = fragments.groupBy(F.col("ordinal.file").alias("cut_file")).agg(F.max(place).alias("last"))
    marked = pieces.join(last, F.col("ordinal.file") == F.col("cut_file"), "left")
    return marked.where(F.col("last").isNull() | (place != F.col("last"))).select("ordinal", "text")


def rejected_pieces(spark: SparkSession, path: str, key: str | None = "value", glob: str = "*") -> DataFrame:
    """(file, text) of what a permissive read of the indented layout leaves out: broken records, and one row for each file that is cut off."""
    pieces = _indented_pieces(spark, path, key, glob)
    broken = _without_cut_piece(spark, path, key, glob, pieces).where(F.try_parse_json("text").isNull())
    ended = open_ended(spark, path, glob)
    return broken.select("ordinal.file", "text").unionAll(ended.select("file", F.lit("the document is not closed").alias("text")))


def _require_lists(spark, path, key, glob) -> None:
    """Every file that is not empty opens a list of records, or an empty list, and is closed."""
    cut = open_ended(spark, path, glob).first()
    if cut:
        raise InvalidData(f"[MALFORMED_RECORD] '{cut.file}' ends before it is closed, or closes what it has not opened")
    opened = r"^\s*\[" if key is None else rf'"{re.escape(key)}"\s*:\s*\['
    files = spark.read.option("pathGlobFilter", glob).text(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.bool_or(F.col("value").rlike(opened)).alias("opened"), F.bool_or(F.trim("value") != "").alias("filled")
    )
    lacking = files.where("filled and not opened").first()
    if lacking:
        raise InvalidData(f"not an indented envelope: '{lacking.file}' has no list '{key}'")


def envelope_fields(spark: SparkSession, path: str, key: str = "value", layout: str = "document", glob: str = "*") -> dict:
    """The other fields of the envelopes at `path` (W5), which must be the same in all of them.

    Field names come from the parser's own scan of each document's keys and their values from
    a read of just these fields: `key`, of any size, is never a VARIANT. In the lines layout
    the fields stand in the head lines.
    """
    if layout == "lines":
        lines = _classified_lines(_raw_lines(spark, path, glob), key).where("kind = 'head'")
        heads = lines.select(F.concat("text", F.lit("]}")).alias("document")).distinct()
    else:
        heads = None
        whole = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    keys = (heads.select(F.json_object_keys("document")) if heads is not None else whole.select(F.json_object_keys("value")))
    names = [r[0] for r in keys.select(F.explode(keys.columns[0])).distinct().collect() if r[0] != key]
    if not names:
        return {}
    schema = T.StructType([T.StructField(n, T.VariantType()) for n in names])
    if heads is not None:
        read = heads.select(F.from_json("document", schema).alias("f")).select("f.*")
    else:
        read = spark.read.options(multiLine=True, pathGlobFilter=glob).schema(schema).json(path)
    texts = read.select(*[F.to_json(F.col(f"`{n}`")).alias(f"f{i}") for i, n in enumerate(names)]).distinct().limit(2).collect()
    if len(texts) > 1:
        raise InvalidData(f"the envelopes at '{path}' differ; pass the fields to write")
    order = keys.first()[0] if texts else []
    found = {n: json.loads(t) for n, t in zip(names, texts[0]) if t is not None} if texts else {}
    return {n: found[n] for n in [*[o for o in order if o in found], *sorted(set(found) - set(order))]}


def corrupt_documents(spark: SparkSession, path: str, key: str = "value", glob: str = "*") -> DataFrame:
    """Files of the document layout that a permissive read leaves out."""
    documents = (
        spark.read.schema(f"`{key}` array<variant>, _corrupt_record string")
        .options(multiLine=True, mode="PERMISSIVE", pathGlobFilter=glob)
        .json(path)
    )
    bad = documents.filter(F.col("_corrupt_record").isNotNull() & F.col(f"`{key}`").isNull())
    return bad.select(F.col("_metadata.file_path").alias("file"))


def field(record: Column, name: str) -> Column:
    """A record's field as VARIANT: null when the key is absent, variant null when the
    key is there with a JSON null."""
    escaped = name.replace("\\", "\\\\").replace("'", "\\'")
    return F.variant_get(record, f"$['{escaped}']", "variant")


def typed(value: Column, target: T.DataType, name: str = "value") -> Column:
    """A VARIANT as a column of `target`, with the conversions of a typed insert.

    JSON null is null; a value that cannot be converted fails the job and the error names the
    field. Whole numbers keep all digits: decimals are rounded as decimals, not as doubles.
    """
    text = F.variant_get(value, "$", "string")
    kind = F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)
    if isinstance(target, T.StringType):
        return text
    if isinstance(target, T.LongType):
        converted = (
            F.when(kind == "BIGINT", F.try_variant_get(value, "$", "bigint"))
            .when(kind == "STRING", to_bigint(text, T.StringType()))
            .when(kind == "DECIMAL", to_bigint(F.try_variant_get(value, "$", "decimal(38,18)"), T.DecimalType(38, 18)))
            .otherwise(to_bigint(F.try_variant_get(value, "$", "double"), T.DoubleType()))
        )
    elif isinstance(target, (T.TimestampNTZType, T.DateType)):
        converted = text.try_cast(target)
    else:
        converted = F.try_variant_get(value, "$", target.simpleString())
    message = F.concat(F.lit(f"column '{name}': cannot convert to {target.simpleString()}: "), F.to_json(value))
    failed = value.isNotNull() & ~F.coalesce(F.is_variant_null(value), F.lit(True))
    return F.coalesce(converted, F.when(failed, F.raise_error(message).cast(target)))


def record_columns(df: DataFrame, schema: T.StructType, record: str = "record") -> DataFrame:
    """Spread the records into typed columns; absent and null both become null."""
    return df.select(*[typed(field(F.col(record), f.name), f.dataType, f.name).alias(f.name) for f in schema])
