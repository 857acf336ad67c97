"""Streams of changes into views, with the order: transform, write, then commit the offset."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.view import KEY, applied
from millrace.storage import COMPRESSED, Scratch, tidy, written
from millrace.streaming.commits import Commits, Folder

Transform = Callable[[DataFrame], DataFrame]

#: A batch is merged in rounds of about this many bytes in files, by buckets: what is shuffled for a round goes before the next one begins.
ROUND = 64 << 20
MOST_ROUNDS = 6


def rounds(numbers: Sequence[int], size: int) -> list[list[int]]:
    """Numbers of buckets in groups, one for each ROUND of size; one empty group if there are none."""
    n = max(1, min(MOST_ROUNDS, -(-size // ROUND), len(numbers)))
    return [list(numbers[i::n]) for i in range(n)]


class ViewTable:
    """A current view in a folder, in buckets by the hash of the key; a batch writes anew only the buckets of its keys.

    A commit names the folder of every bucket, so a version is there as a whole or not at all. Each
    writer numbers its batches; one that comes again after a failure finds its number committed and
    does nothing. Of two writers, the one that commits second begins again from the other's version.
    What no version needs any more is removed once it is older than `grace` seconds, so readers have
    as long to end. The number of buckets is fixed with the first commit; a bucket is rewritten by
    one task. Its files also hold _row, a number of each row that came with the commit (null in
    others), which no version shows. Keys may hold nulls; rows of a batch later in seq come after earlier ones and all of
    them after what the view holds.
    """

    tops: tuple[str, ...] = ("data",)

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str] = KEY, buckets: int = 64, grace: float = 3600.0, seq: str = "seq", op: str = "operation") -> None:
        self.spark, self.path, self.key, self.buckets, self.grace, self.seq, self.op = spark, path.rstrip("/"), tuple(key), buckets, grace, seq, op
        self.folder = Folder(spark, self.path)
        self.commits = Commits(self.folder)

    def newest(self) -> tuple[int, dict[str, int]] | None:
        """(version, last batch of each writer) as committed."""
        version, content = self.commits.newest()
        return (version, content["batches"]) if version else None

    def read(self, version: int | None = None) -> DataFrame | None:
        """The view, or an earlier version of it that is still kept; None before the first commit."""
        content = self.commits.newest()[1] if version is None else self.commits.read(version)
        return self._rows(content, None) if content else None

    def lookup(self, keys: DataFrame) -> DataFrame | None:
        """The rows of some keys; only their buckets are read."""
        content = self.commits.newest()[1]
        if not content:
            return None
        rows = self._rows(content, self._touched(keys, content["of"]))
        return rows.join(keys.select(*self.key).distinct(), self._same(rows, keys), "left_semi")

    def _same(self, a: DataFrame, b: DataFrame) -> Column:
        right = b.select(*self.key).distinct()
        out = F.lit(True)
        for c in self.key:
            out = out & a[c].eqNullSafe(right[c])
        return out

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in self.key]), F.lit(n)).cast("int")

    def _touched(self, rows: DataFrame, n: int) -> list[int]:
        """The buckets of rows: as many numbers as there are buckets at most."""
        return sorted(r[0] for r in rows.select(self._bucket(n)).distinct().collect())

    def _rows(self, content: dict[str, Any], only: Sequence[int] | None) -> DataFrame:
        schema = T.StructType.fromJson(content["schema"])
        paths = [f"{self.path}/{at}/_bucket={b}" for b, at in content["buckets"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def merged(self, old: DataFrame | None, log: DataFrame) -> DataFrame:
        """The last row of each key that isn't a delete, and _new: 1 if it is of the log."""
        events = log.withColumn("_new", F.lit(1))
        if old is not None:
            events = old.withColumn("_new", F.lit(0)).unionByName(events, allowMissingColumns=True)
        rest = [c for c in events.columns if c not in (*self.key, "_new")]
        last = events.groupBy(*self.key).agg(F.max_by(F.struct(*rest), F.struct("_new", self.seq)).alias("_last"), F.max("_new").alias("_new"))
        return last.where(F.lower(F.col(f"_last.`{self.op}`")) != "delete").select(*self.key, "_last.*", "_new")

    def changes(self, old: DataFrame | None, log: DataFrame) -> int:
        """How many events of the log change their key's row, one after the other: another content, a first row, or a delete of one."""
        rest = sorted(c for c in log.columns if c not in (*self.key, self.seq, self.op))
        version = F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), 256)
        events = log.select(*self.key, self.seq, self.op, version.alias("_version"), F.lit(1).alias("_new"))
        if old is not None:  # all rows, as few columns: to find the keys of the log first would shuffle the others
            missing = [c for c in rest if c not in old.columns]
            held = old.withColumns({c: F.lit(None).cast(log.schema[c].dataType) for c in missing})
            events = events.unionByName(held.select(*self.key, self.seq, self.op, version.alias("_version"), F.lit(0).alias("_new")))
        return applied(events.withColumn("_at", F.struct("_new", self.seq)), F.col("_version"), self.key, "_at", self.op).where("_new = 1").count()

    def prepare(self, content: dict[str, Any], fresh: Sequence[DataFrame], log: DataFrame) -> dict[str, Any]:
        """What a kind of view adds to its commit. content: the commit before; fresh: the rows that came with the batch, with _row, a number of each; in parts, one for each round."""
        return {}

    def apply(self, log: DataFrame, batch: int, writer: str = "") -> int:
        """Puts a batch of events (key, seq, operation, other columns) into the view. Returns how many of them changed it; 0 if the batch was there already."""
        rest = [c for c in log.columns if c not in (*self.key, self.seq, self.op)]
        log = log.withColumns({c: F.when(F.lower(self.op) == "delete", None).otherwise(F.col(c)) for c in rest})  # a delete has no content
        with Scratch(), tidy(self.spark):
            log = written(log, "batch", level=3)
            while True:
                version, content = self.commits.newest()
                if batch <= content.get("batches", {}).get(writer, -1):
                    return 0
                done = self._attempt(log, version, content, batch, writer)
                if done is not None:
                    self.prune()
                    return done

    def _attempt(self, log: DataFrame, version: int, content: dict[str, Any], batch: int, writer: str) -> int | None:
        n = content.get("of", self.buckets)
        touched = self._touched(log, n)
        at = f"data/{uuid.uuid4().hex}"
        old = self._rows(content, touched) if content else None
        held = [f"{where}/_bucket={b}" for b, where in content.get("buckets", {}).items() if int(b) in touched]
        size = sum(Folder(self.spark, f.rpartition("/")[0]).size() for f in log.inputFiles()[:1])
        groups = rounds(touched, size + sum(self.folder.size(name) for name in held))
        for i, group in enumerate(groups):
            events = log.where(self._bucket(n).isin(*group)) if len(groups) > 1 else log
            rows = self.merged(self._rows(content, group) if content else None, events).withColumn("_bucket", self._bucket(n)).repartition(max(1, len(group)), "_bucket").sortWithinPartitions("_bucket")
            number = F.monotonically_increasing_id() + (i << 58)  # the ids of a job stay below 2^58
            numbered = rows.withColumn("_row", F.when(F.col("_new") == 1, number)).drop("_new")
            numbered.write.mode("append").options(**COMPRESSED).partitionBy("_bucket").parquet(f"{self.path}/{at}")
        schema = rows.drop("_new", "_bucket").schema
        new = {name.partition("=")[2]: at for name in self.folder.names(at) if name.startswith("_bucket=")}
        kept = {b: where for b, where in content.get("buckets", {}).items() if int(b) not in touched}
        made = {"of": n, "schema": schema.jsonValue(), "batches": content.get("batches", {}) | {writer: batch}, "buckets": kept | new}
        came = lambda group: self._rows({"schema": T.StructType([*schema, T.StructField("_row", T.LongType())]).jsonValue(), "buckets": new}, group).where("_row is not null")
        made |= self.prepare(content, [came(group) for group in groups], log)
        done = self.changes(old, log)
        if self.commits.add(version + 1, made):
            return done
        self.folder.remove(at)
        return None

    def folders(self, content: dict[str, Any]) -> set[str]:
        """The folders that a version needs."""
        return set(content["buckets"].values())

    def prune(self) -> None:
        """Removes versions that were followed by another one more than `grace` seconds ago, and folders that no version needs and that are older."""
        before, versions = (time.time() - self.grace) * 1000, self.commits.versions()
        kept = {v for v in versions if v + 1 not in versions or versions[v + 1] >= before}
        needed = set().union(*[self.folders(self.commits.read(v)) for v in kept])
        for v in versions.keys() - kept:
            self.commits.drop(v)
        for top in self.tops:
            for name, changed in self.folder.names(top).items():
                if f"{top}/{name}" not in needed and changed < before:
                    self.folder.remove(f"{top}/{name}")


def run(stream: DataFrame, transforms: Sequence[Transform], view: ViewTable, checkpoint: str) -> StreamingQuery:
    """Starts a stream of events into a view, all that is there in this run. Transforms must leave source and stream be."""

    def step(batch: DataFrame, number: int) -> None:
        out = batch
        for transform in transforms:
            out = transform(out)
            if missing := {"source", "stream"} - set(out.columns):
                raise ValueError(f"a transform lost {sorted(missing)}")
        view.apply(out, number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedupe(stream: DataFrame, keys: Sequence[str], at: str, late: str) -> DataFrame:
    """The first of each key; keys are forgotten after the time that events may be late."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))


def tumbling(rows: DataFrame, at: str, width: str, *by: str, late: str | None = None, **aggregates) -> DataFrame:
    source = rows.withWatermark(at, late) if late else rows
    return source.groupBy(F.window(at, width), *by).agg(*[a.alias(n) for n, a in aggregates.items()])


def sliding(rows: DataFrame, at: str, width: str, step: str, *by: str, late: str | None = None, **aggregates) -> DataFrame:
    source = rows.withWatermark(at, late) if late else rows
    return source.groupBy(F.window(at, width, step), *by).agg(*[a.alias(n) for n, a in aggregates.items()])


def sessions(rows: DataFrame, at: str, gap: str, *by: str, late: str | None = None, **aggregates) -> DataFrame:
    source = rows.withWatermark(at, late) if late else rows
    return source.groupBy(F.session_window(at, gap), *by).agg(*[a.alias(n) for n, a in aggregates.items()])
