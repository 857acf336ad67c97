"""The envelope: one schema for all changes, and tables and JSON lines as envelopes."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.columns import SEPARATOR, record_id
from millrace.sources.lines import SPLIT, line_stream
from millrace.storage import written

SCHEMA = (
    "id string, source string, stream string, operation string, schema_version string, payload_kind string, payload string, "
    "observed_at timestamp, event_time timestamp, cursor string, checksum string, metadata map<string,string>, provenance map<string,string>"
)
OPERATIONS = ("snapshot", "upsert", "delete")  # fixed values
KINDS = ("record", "document_element", "table_batch", "blob_ref", "tombstone")  # fixed values


def envelopes(rows: DataFrame, source: str, stream: str, native_id: Column, payload: Column | None = None, kind: str = "record", operation: Column | None = None, **columns: Column) -> DataFrame:
    """Rows as envelopes. columns: event_time, cursor, checksum, metadata, provenance, observed_at."""
    body = payload if payload is not None else F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    op = F.lower(operation) if operation is not None else F.lit("upsert")
    typed = {"observed_at": "timestamp", "event_time": "timestamp", "cursor": "string", "checksum": "string", "metadata": "map<string,string>", "provenance": "map<string,string>"}
    return rows.select(
        record_id(F.lit(source), F.lit(stream), native_id).alias("id"), F.lit(source).alias("source"), F.lit(stream).alias("stream"), op.alias("operation"), F.lit("1").alias("schema_version"),
        F.when(op == "delete", "tombstone").otherwise(kind).alias("payload_kind"), F.when(op != "delete", body).alias("payload"), *[columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in typed.items()],
    )


def faults(rows: DataFrame) -> DataFrame:
    """Envelopes that break a rule, with the rule."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    rule = F.coalesce(
        *[F.when(empty(c), f"{c} is empty") for c in ("id", "source", "stream", "schema_version")],
        F.when(~F.coalesce(F.col("operation").isin(*OPERATIONS), F.lit(False)), "unknown operation"),
        F.when(~F.coalesce(F.col("payload_kind").isin(*KINDS), F.lit(False)), "unknown payload"),
        F.when((F.col("operation") == "delete") & (F.col("payload_kind") != "tombstone"), "a delete without a tombstone"),
    )
    return rows.withColumn("fault", rule).where("fault is not null")


def checked(rows: DataFrame) -> DataFrame:
    """The same envelopes; the job fails at the first that breaks a rule."""
    bad = (F.col("operation") == "delete") & (F.col("payload_kind") != "tombstone") | F.col("id").isNull()
    return rows.withColumn("id", F.when(bad, F.raise_error(F.lit("a delete without a tombstone, or no id"))).otherwise(F.col("id")))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 1 in its file), seq (from 0 over all files, by their names), file and value of all lines of text files.

    Lines are written with the range of the file that they were read from. In a range they are in
    order, so a line's number is its place there and the number of lines in the ranges before.
    """
    where = F.col("_metadata")
    read = spark.read.option("lineSep", "\n").text(path)
    rows = written(read.select("value", where.file_path.alias("file"), where.file_block_start.alias("_start"), F.monotonically_increasing_id().alias("_id")), "lines")
    ranges = rows.groupBy("file", "_start").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = W.orderBy("file", "_start").rowsBetween(W.unboundedPreceding, -1)
    # One row for each range of a file.
    placed = ranges.withColumn("_all", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_here", F.coalesce(F.sum("_n").over(before.partitionBy("file").orderBy("_start")), F.lit(0))).drop("_n")
    place = F.col("_id") - F.col("_first")
    value = F.regexp_replace("value", "\r$", "")
    return rows.join(placed, ["file", "_start"]).select((F.col("_here") + place + 1).alias("line"), (F.col("_all") + place).alias("seq"), "file", value.alias("value"))


def line_envelopes(lines: DataFrame, source: str, stream: str, id_field: str = "id", operation_field: str = "_operation", strict: bool = True, number: Column | None = None) -> DataFrame:
    """Lines (line, seq, value) of JSON objects as envelopes with seq. Blank lines are skipped; a line without the id field goes by its number. strict: a line that isn't an object fails the job."""
    body = F.try_parse_json("value")
    # The schema of a JSON value as text tells an object from the rest.
    isobject = F.coalesce(F.startswith(F.schema_of_variant(body), F.lit("OBJECT")), F.lit(False))
    refused = F.raise_error(F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(" is not a JSON object: "), F.substring("value", 1, 80)))
    value = F.when(isobject, F.col("value")).otherwise(refused if strict else F.lit(None))
    rows = lines.where(F.trim("value") != "").withColumn("_body", value).where(F.col("_body").isNotNull())
    field = lambda name: F.get_json_object("_body", f"$.{name}")
    native = F.coalesce(field(id_field), number if number is not None else F.col("line").cast("string"))
    facts = F.create_map(F.lit("seq"), F.col("seq").cast("string"), F.lit("line_number"), F.col("line").cast("string"), F.lit("native_id"), native)
    made = envelopes(rows, source, stream, native, F.col("_body"), operation=F.coalesce(field(operation_field), F.lit("upsert")), metadata=facts)
    return made.withColumn("seq", F.col("metadata")["seq"].cast("long"))


def json_lines(spark: SparkSession, path: str, source: str, stream: str, id_field: str = "id", operation_field: str = "_operation", strict: bool = True) -> DataFrame:
    """JSON objects of files, one a line, as envelopes with seq, the place among all lines. Of several files, a line without the id field goes by its file's name and its number there."""
    lines = numbered_lines(spark, path)
    several = lines.select("file").distinct().limit(2).count() > 1
    name = F.concat(F.element_at(F.split("file", "/"), -1), F.lit(":"), F.col("line").cast("string"))
    return line_envelopes(lines, source, stream, id_field, operation_field, strict, name if several else None)


def json_lines_stream(spark: SparkSession, path: str, source: str, stream: str, id_field: str = "id", operation_field: str = "_operation", split: int = SPLIT, last: bool = False) -> DataFrame:
    """A growing file of JSON objects as a stream of envelopes with seq: the same ids as json_lines, whatever the size of partitions and however often the query begins again."""
    lines = line_stream(spark, path, split, last).withColumn("seq", F.col("line") - 1)
    return line_envelopes(lines, source, stream, id_field, operation_field)


def lines_state(data: bytes, lines: int) -> dict[str, object]:
    """What a reader of a growing file keeps: where it was, and the hash of all before it."""
    return {"byte_offset": len(data), "line_number": lines, "prefix_sha256": hashlib.sha256(data).hexdigest()}


def resume_at(data: bytes, state: dict[str, object] | None) -> int:
    """The offset to go on from; ValueError if the file shrank or what was read has changed."""
    if not state:
        return 0
    at = int(state["byte_offset"])  # type: ignore[call-overload]
    if len(data) < at:
        raise ValueError("the file is shorter than it was")
    if hashlib.sha256(data[:at]).hexdigest() != state["prefix_sha256"]:
        raise ValueError("what was read before has changed")
    return at


def stable_key(names: Sequence[str]) -> Column:
    """A native id of several columns."""
    return F.concat_ws(SEPARATOR, *[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names])
