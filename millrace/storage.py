"""Tables written to the cluster's shared folder: they cut the lineage and outlive executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Spark's own setting by which the shuffle files of a query go when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: How tables are compressed: texts take about six tenths of what they take by Spark's default.
LEVEL = 6
COMPRESSED = {"compression": "zstd", "parquet.compression.codec.zstd.level": str(LEVEL)}


class Scratch:
    """Tables that are written while it is open are removed when it closes, but for those given to keep.

    Whoever opens it has written, by its end, all that was made of the others: nothing reads them
    again. What an inner one keeps is left to the one around it. After an error all are removed.
    """

    _open: ContextVar[Scratch | None] = ContextVar("scratch", default=None)

    def __init__(self) -> None:
        self.tables: list[tuple[DataFrame, str]] = []
        self.kept: list[DataFrame] = []

    def __enter__(self) -> Scratch:
        self.around = self._open.get()
        self._open.set(self)
        return self

    def keep(self, table: DataFrame) -> DataFrame:
        self.kept.append(table)
        return table

    def __exit__(self, kind: type[BaseException] | None, *_: object) -> None:
        self._open.set(self.around)
        for table, path in self.tables:
            if not kind and any(table is k for k in self.kept):
                if self.around:
                    self.around.tables.append((table, path))
            else:
                removed(table.sparkSession, path)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset: a temporary folder on a local master, ValueError on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What the queries in it shuffle goes as soon as each has ended."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before) if before else spark.conf.unset(CLEANUP)


def written(df: DataFrame, name: str, by: Sequence[str] = (), level: int = LEVEL) -> DataFrame:
    """df as a table that has been written, so that all plans over it read the same rows; what was shuffled for it goes once it is there. by: columns, last in df, whose values are folders. level: zstd's; texts take 7 % more at 3, in half the time."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    with tidy(spark):
        df.write.options(**COMPRESSED | {"parquet.compression.codec.zstd.level": str(level)}).partitionBy(*by).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    if scratch := Scratch._open.get():
        scratch.tables.append((table, path))
    return table


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table from the shared folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
