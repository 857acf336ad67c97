"""Changelogs: the current view, replays, ledgers, replacement and deltas between snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ("source", "stream", "id")


def current_view(log: DataFrame, view: DataFrame | None = None, key: Sequence[str] = KEY, seq: str = "seq", op: str = "operation") -> DataFrame:
    """The last event of each key that isn't a delete; rows of an earlier view come before all events.

    One aggregation with a partial step: only a candidate for each key and task is shuffled.
    """
    events = log if view is None else view.withColumn(seq, F.lit(-1).cast("long")).unionByName(log, allowMissingColumns=True)
    rest = [c for c in events.columns if c not in key]
    last = events.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_last"))
    return last.where(F.lower(F.col(f"_last.{op}")) != "delete").select(*key, "_last.*")


def applied(log: DataFrame, version: Column, key: Sequence[str] = KEY, seq: str = "seq", op: str = "operation") -> DataFrame:
    """The events that change their key's state: a delete of what is there, or a version other than the last."""
    state = F.when(F.lower(F.col(op)) != "delete", version)
    before = F.lag("_state").over(W.partitionBy(*key).orderBy(seq))
    rows = log.withColumn("_state", state).withColumn("_before", before)
    return rows.where(~F.col("_state").eqNullSafe(F.col("_before"))).drop("_state", "_before")


def append_changes(log: DataFrame, version: Column, known: DataFrame | None = None, seq: str = "seq") -> DataFrame:
    """Events as an append-only change log takes them: the first of each (id, version) that isn't known."""
    rows = log.withColumn("version", version)
    rest = [c for c in rows.columns if c not in ("id", "version")]
    first = rows.groupBy("id", "version").agg(F.min_by(F.struct(*rest), F.col(seq)).alias("_first")).select("id", "version", "_first.*")
    return first if known is None else first.join(known, ["id", "version"], "left_anti")


def ledger_apply(log: DataFrame, ledger: DataFrame, event: Sequence[str], key: Sequence[str], seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(rows to write, ledger to add): events whose identity isn't in the ledger yet, then the last of each key."""
    new = log.groupBy(*event).agg(F.min_by(F.struct(*[c for c in log.columns if c not in event]), F.col(seq)).alias("_e")).select(*event, "_e.*").join(ledger, list(event), "left_anti")
    rest = [c for c in new.columns if c not in key]
    last = new.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_l")).select(*key, "_l.*")
    return last, new.select(*event)


def merged_into(target: DataFrame, log: DataFrame, key: Sequence[str], seq: str = "seq", op: str = "operation") -> DataFrame:
    """The target table after the events of log, in order: a delete removes the row of its key, all others insert or update it. log has the target's columns; a null in a key fails the job."""
    rest = [c for c in target.columns if c not in key]
    whole = F.when(F.concat(*[F.col(c).cast("string") for c in key]).isNull(), F.raise_error(F.lit("a key has a null"))).otherwise(F.col(key[0]))
    checked = log.withColumn(key[0], whole.cast(log.schema[key[0]].dataType))
    last = checked.groupBy(*key).agg(F.max_by(F.struct(F.col(op).alias("_op"), *rest), F.col(seq)).alias("_l"))
    kept = target.join(last.select(*key), list(key), "left_anti").select(*target.columns)
    return kept.unionByName(last.where(F.lower("_l._op") != "delete").select(*key, *[F.col("_l")[c].alias(c) for c in rest]))


def replaced(log: DataFrame, ledger: DataFrame, target: str, event: Sequence[str], key: Sequence[str], seq: str = "seq", op: str = "operation") -> tuple[DataFrame, DataFrame]:
    """(rows, ledger) when a target is replaced by log: all its rows and what the ledger (target, event) has of it go, other targets' stay. A delete fails the job. An empty log resets the target."""
    refused = F.when(F.lower(op) == "delete", F.raise_error(F.lit("a replacement has no deletes"))).otherwise(F.col(op))
    written, events = ledger_apply(log.withColumn(op, refused.cast("string")), ledger.where("false").select(*event), event, key, seq)
    return written, ledger.where(~F.col("target").eqNullSafe(F.lit(target))).unionByName(events.withColumn("target", F.lit(target)))


def delta(before: DataFrame, after: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """key and change (new, changed, unchanged, removed) between two snapshots."""
    a, b = before.select(F.col(key).alias("_a"), F.col(fingerprint).alias("_fa")), after.select(F.col(key).alias("_b"), F.col(fingerprint).alias("_fb"))
    kind = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "removed").when(F.col("_fa").eqNullSafe(F.col("_fb")), "unchanged").otherwise("changed")
    return a.join(b, F.col("_a") == F.col("_b"), "full_outer").select(F.coalesce("_a", "_b").alias(key), kind.alias("change"))


def tombstones(counts: DataFrame, key: str, committed: str, parsed: str) -> DataFrame:
    """key, element_index and operation of deletes for elements from the new count up to the committed one."""
    return counts.where(F.col(committed) > F.col(parsed)).select(key, F.explode(F.sequence(F.col(parsed), F.col(committed) - 1)).alias("element_index"), F.lit("delete").alias("operation"))


def latest(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that is last in order."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*")
