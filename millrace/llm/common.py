"""Reading tables, splits by crc32, and tables written to the cluster's shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.storage import LEVEL, written


BATCH_ROWS, BATCH_BYTES = 2048, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that go to Python, by bytes as well as rows: texts are long, and a task's memory is a multiple of its batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stage(df: DataFrame, name: str, level: int = LEVEL) -> DataFrame:
    """Writes df to the shared folder and returns the written table: cuts the lineage, outlives executors, and its size is known to the planner."""
    small_batches(df.sparkSession)
    return written(df, name, level=level)


def identified(df: DataFrame, level: int = LEVEL) -> DataFrame:
    """df with uid, a number for each row, written once: a plan that numbers rows anew may number them otherwise when executors come or go. A column uid of df is replaced."""
    return stage(df.withColumn("uid", F.monotonically_increasing_id()), "rows", level)


def remainder(doc_id: str, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as the empty text (remainder 0)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n
