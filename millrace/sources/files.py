"""Files as tables: listings, contents, manifests and what changed since."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Media types by extension.
MEDIA_TYPES = {"txt": "text/plain", "md": "text/markdown", "csv": "text/csv", "html": "text/html", "htm": "text/html", "eml": "message/rfc822", "json": "application/json", "jsonl": "application/x-ndjson", "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"}


def listing(spark: SparkSession, path: str, glob: str | None = None, extensions: tuple[str, ...] = ()) -> DataFrame:
    """path, name, size, modified, extension and content_type of the files below a folder; no content is read. Hidden files are left out, as is what isn't of the extensions."""
    if ".." in path.split("/"):
        raise ValueError("a path must not lead upwards")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    found = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    name = F.regexp_extract("path", r"[^/]*$", 0)
    rows = found.select("path", name.alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("extension"))
    types = F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])
    rows = rows.withColumn("content_type", F.coalesce(types[F.col("extension")], F.lit("application/octet-stream"))).where(~F.startswith("name", F.lit(".")))
    return rows.where(F.col("extension").isin(*extensions)) if extensions else rows


def contents(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The listed files with content and its SHA-256, from one read. The names are those of one listing, so a bounded number."""
    paths = [r["path"] for r in files.select("path").toLocalIterator()]
    if not paths:
        return files.withColumn("content", F.lit(None).cast("binary")).withColumn("sha256", F.lit(None).cast("string"))
    read = spark.read.format("binaryFile").load(paths).select("path", "content", F.sha2("content", 256).alias("sha256"))
    return files.join(read, "path")


def changes(found: DataFrame, manifest: DataFrame, parser: str) -> DataFrame:
    """path and change (new, changed, unchanged, removed) against a manifest (path, sha256, parser, elements)."""
    now = found.select("path", F.col("sha256").alias("_now"))
    was = manifest.select(F.col("path").alias("_path"), F.col("sha256").alias("_was"), F.col("parser").alias("_parser"), F.col("elements").alias("committed"))
    same = (F.col("_now") == F.col("_was")) & (F.col("_parser") == parser)
    kind = F.when(F.col("_path").isNull(), "new").when(F.col("path").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return now.join(was, F.col("path") == F.col("_path"), "full_outer").select(F.coalesce("path", "_path").alias("path"), kind.alias("change"), F.coalesce("committed", F.lit(0)).alias("committed"), F.col("_now").alias("sha256"))


def element_events(change: DataFrame, parsed: DataFrame) -> DataFrame:
    """path, element_index, text and operation: all elements of new and changed files, deletes for elements that are no longer there. parsed: (path, element_index, text)."""
    fresh = parsed.join(change.where(F.col("change").isin("new", "changed")).select("path"), "path", "left_semi").withColumn("operation", F.lit("upsert"))
    counts = parsed.groupBy("path").agg((F.max("element_index") + 1).alias("parsed"))
    over = change.where(F.col("change").isin("changed", "removed")).join(counts, "path", "left").withColumn("parsed", F.when(F.col("change") == "removed", 0).otherwise(F.coalesce("parsed", F.lit(0))))
    gone = over.where(F.col("committed") > F.col("parsed")).select("path", F.explode(F.sequence(F.col("parsed"), F.col("committed") - 1)).alias("element_index"), F.lit(None).cast("string").alias("text"), F.lit("delete").alias("operation"))
    return fresh.select("path", "element_index", "text", "operation").unionByName(gone)


def store_artifacts(rows: DataFrame, path: str, content: str = "content") -> DataFrame:
    """Writes contents under their SHA-256, in folders by its first two digits; returns sha256 and size. Equal contents are stored once."""
    named = rows.select(F.sha2(content, 256).alias("sha256"), F.col(content).alias("content"), F.octet_length(content).alias("size")).dropDuplicates(["sha256"])
    named.withColumn("prefix", F.substring("sha256", 1, 2)).write.partitionBy("prefix").mode("append").parquet(path)
    return named.select("sha256", "size")


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """sha256 and content, each verified against its name."""
    stored = spark.read.parquet(path)
    good = F.when(F.sha2("content", 256) == F.col("sha256"), F.col("content")).otherwise(F.raise_error(F.concat("sha256", F.lit(": damaged"))))
    return stored.select("sha256", good.alias("content"))
