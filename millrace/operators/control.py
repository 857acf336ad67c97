"""The state of runs as tables: jobs and leases, checkpoints, rates, schedules, lineage, rejected rows."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.rows import in_ranges
from millrace.storage import written

# The states that may follow each state.
RUN_STATES = {
    "pending": ("running", "cancelled", "failed"),
    "running": ("paused", "completed", "failed", "cancelled"),
    "paused": ("running", "cancelled"),
    "completed": (),
    "failed": ("running",),
    "cancelled": (),
}


def may_follow(current: Column, target: Column, states: dict[str, Sequence[str]] = RUN_STATES) -> Column:
    """Whether a state may follow another."""
    pairs = [F.concat_ws(">", F.lit(a), F.lit(b)) for a, nexts in states.items() for b in nexts]
    return F.concat_ws(">", current, target).isin(*pairs)


def claimable(jobs: DataFrame, now: Column, n: int = 1) -> DataFrame:
    """The next n jobs to lease: queued and due, or leased with the lease run out; the longest due first."""
    due = (F.col("status") == "queued") & (F.col("available_at") <= now)
    expired = (F.col("status") == "leased") & (F.col("lease_expires_at") <= now)
    return jobs.where(due | expired).orderBy("available_at", "created_at", "job_id").limit(n)


def claim(jobs: DataFrame, owner: str, now: Column, seconds: int = 60) -> DataFrame:
    """jobs with the next one leased to owner."""
    mine = claimable(jobs, now).select("job_id", F.lit(True).alias("_mine"))
    rows = jobs.join(F.broadcast(mine), "job_id", "left")
    for name, value in (("status", F.lit("leased")), ("lease_owner", F.lit(owner)), ("lease_expires_at", now + F.expr(f"interval {seconds} seconds")), ("attempt_count", F.col("attempt_count") + 1)):
        rows = rows.withColumn(name, F.when(F.col("_mine"), value).otherwise(F.col(name)))
    return rows.drop("_mine")


def finish(jobs: DataFrame, job_id: str, owner: str, status: str) -> DataFrame:
    """jobs with a job finished, if owner still holds its lease."""
    held = (F.col("job_id") == job_id) & (F.col("status") == "leased") & (F.col("lease_owner") == owner)
    return jobs.withColumn("status", F.when(held, F.lit(status)).otherwise(F.col("status"))).withColumn("lease_owner", F.when(held, F.lit(None)).otherwise(F.col("lease_owner")))


NEVER = -(1 << 63)


def rate_pass(limit: int, window: int, ends: bool):
    """A pass over rows (_p, _k, _t, _held) in order. A row with _held sets the state; each other one is accepted if fewer than `limit` times are held.

    ends: gives the state (_p, _k, _held) that each range ends with, else the rows with accepted.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, key, held = None, None, deque()
        for part in parts:
            verdict, out = [], []
            for p, k, t, start in zip(part["_p"], part["_k"], part["_t"], part["_held"], strict=True):
                if start is not None:
                    if now is not None:
                        out.append((now, key, list(held)))
                    now, key, held = p, k, deque(start)
                    verdict.append(False)
                    continue
                if k != key:
                    key, held = k, deque()
                while held and held[0] < t - window:
                    held.popleft()
                verdict.append(t != NEVER and len(held) < limit)
                if verdict[-1]:
                    held.append(t)
            if not ends:
                yield part.assign(accepted=verdict)[part["_held"].isna()].drop(columns=["_p", "_k", "_t", "_held"])
            elif out:
                yield pd.DataFrame(out, columns=["_p", "_k", "_held"])
        if ends and now is not None:
            yield pd.DataFrame([(now, key, list(held))], columns=["_p", "_k", "_held"])

    return run


def key_pass(limit: int, window: int):
    """A pass over rows (_k, _p, _t), whole keys in order, that gives the state with which a key enters each of its ranges after the first."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, key, held = None, None, deque()
        for part in parts:
            out = []
            for p, k, t in zip(part["_p"], part["_k"], part["_t"], strict=True):
                if k != key:
                    now, key, held = p, k, deque()
                if p != now:
                    out.append((p, k, list(held)))
                    now = p
                while held and held[0] < t - window:
                    held.popleft()
                if t != NEVER and len(held) < limit:
                    held.append(t)
            if out:
                yield pd.DataFrame(out, columns=["_p", "_k", "_held"])

    return run


def accept_deliveries(deliveries: DataFrame, key: str, at: str, order: str, limit: int, seconds: int = 60, rounds: int = 4) -> DataFrame:
    """deliveries with accepted: fewer than `limit` accepted ones of the key lie in the seconds up to it.

    Only accepted ones count, so each depends on those before. Rows are sorted in ranges of
    (key, at, order), so a key with very many is spread, and each range is passed from the empty
    state. The state is the times that are held, `limit` at most. Where the one before ends with
    other times than a range was passed from, the range is passed again from those, until all agree:
    mostly soon, as times are held for `seconds` only. Keys whose ranges still disagree after
    `rounds` passes (evenly spaced deliveries above the limit) are passed once in time order, a task
    a key, with their times only, to learn each range's state; their rows stay spread.

    Null keys are one key. Rows without a time are not accepted. An empty table gives no rows.
    """
    window, state = seconds * 1_000_000, "_p int, _k string, _held array<long>"
    ntz = deliveries.schema[at].dataType.typeName() == "timestamp_ntz"
    micros = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{at}`)") if ntz else F.unix_micros(at)
    ranged = in_ranges(deliveries, [key, at, order]).withColumn("_k", F.to_json(F.struct(key))).withColumn("_t", F.coalesce(micros, F.lit(NEVER)))
    narrow = ranged.select("_p", "_k", "_t", key, at, order)
    head = F.min(F.struct(key, at, order, F.col("_k").alias("_k0"), F.col("_t").alias("_t0")))
    heads = written(narrow.groupBy("_p").agg(head.alias("_h")).select("_p", "_h._k0", "_h._t0"), "heads")

    # Rows are dealt by hashes of columns, not by columns: after a join on these Spark would leave the
    # dealing out as done, and then read the join's shuffle by map task if it turns into a broadcast.
    def passed(rows: DataFrame, entries: DataFrame, ends: bool) -> DataFrame:
        both = rows.withColumn("_held", F.lit(None).cast("array<long>")).unionByName(entries.withColumn("_t", F.lit(NEVER)), allowMissingColumns=True)
        ordered = both.repartition(F.xxhash64("_p")).sortWithinPartitions("_p", F.col("_held").isNull(), key, at, order)
        schema = state if ends else deliveries.withColumn("accepted", F.lit(False)).schema
        return ordered.select(*(["_p", "_k", "_t", "_held"] if ends else ["_p", "_k", "_t", "_held", *deliveries.columns])).mapInPandas(rate_pass(limit, window, ends), schema)

    def after(exits: DataFrame) -> DataFrame:
        """What ranges enter with: what the one before holds, if it ends with the same key, and still holds at the first row. One row for each range."""
        before = exits.withColumnRenamed("_held", "_e").select("_p", F.lag(F.struct("_k", "_e")).over(W.orderBy("_p")).alias("_b"))
        still = F.when(F.col("_t0") == NEVER, F.col("_b._e")).otherwise(F.filter("_b._e", lambda x: x >= F.col("_t0") - window))
        held = F.when(F.col("_b._k") == F.col("_k0"), still).otherwise(F.array().cast("array<long>"))
        return before.join(heads, "_p").select("_p", F.col("_k0").alias("_k"), F.coalesce(held, F.array().cast("array<long>")).alias("_held"))

    entries = heads.select("_p", F.col("_k0").alias("_k"), F.array().cast("array<long>").alias("_held"))
    exits = written(passed(narrow, entries, True), "exits")
    for n in range(rounds + 1):
        new = written(after(exits), "entries")
        changed = new.join(entries.withColumnRenamed("_held", "_old").drop("_k"), "_p").where("_held <> _old").drop("_old")
        if changed.isEmpty():
            break
        if n == rounds:
            whole = narrow.join(changed.select("_k").distinct(), "_k", "left_semi").select("_k", "_p", "_t", key, at, order)
            walked = whole.repartition(F.xxhash64("_k")).sortWithinPartitions("_k", "_p", key, at, order).select("_k", "_p", "_t").mapInPandas(key_pass(limit, window), state)
            true = walked.select("_p", F.col("_held").alias("_true"))
            new = written(new.join(true, "_p", "left").select("_p", "_k", F.coalesce("_true", "_held").alias("_held")), "entries")
        else:
            again = passed(narrow.join(changed.select("_p"), "_p", "left_semi"), changed, True)
            exits = written(exits.join(changed.select("_p"), "_p", "left_anti").unionByName(again), "exits")
        entries = new
    return passed(ranged, entries, False)


def lineage(rows: DataFrame, source: str, target: str, sample: int = 3) -> DataFrame:
    """One row about what went along an edge: items, bytes as JSON, and the first few rows."""
    line = F.to_json(F.struct(*rows.columns))
    facts = rows.agg(F.count("*").alias("items_count"), F.coalesce(F.sum(F.length(line)), F.lit(0)).alias("approx_bytes"))
    first = rows.limit(sample).agg(F.collect_list(line).alias("sample"))
    return facts.join(F.broadcast(first)).select(F.lit(source).alias("source_node"), F.lit(target).alias("target_node"), "items_count", "approx_bytes", "sample")


def rejected(rows: DataFrame, failed: Column, node: str, error: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, dead letters): a dead letter holds the node, the error and the row as JSON."""
    bad = F.coalesce(failed, F.lit(False))
    letters = rows.where(bad).select(F.lit(node).alias("node"), error.alias("error"), F.to_json(F.struct(*rows.columns)).alias("input_data"), F.lit(0).alias("retry_count"), F.lit(False).alias("resolved"))
    return rows.where(~bad), letters


def kept(rows: DataFrame, at: str, now: Column, hours: int) -> DataFrame:
    """Rows that haven't outlived their time."""
    return rows.where(F.col(at) > now - F.expr(f"interval {hours} hours"))


def backoff(attempt: int, jitter: float = 1.0) -> float:
    """Seconds before the next attempt: 2, 4, 8 ... up to 60, times a jitter from 0.5 to 1.5."""
    return min(2.0 * 2**attempt, 60.0) * jitter


def _field(text: str, low: int, high: int) -> set[int]:
    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        a, _, b = span.partition("-")
        first, last = (low, high) if span == "*" else (int(a), int(b or (high if step else a)))
        if not low <= first <= last <= high or step and int(step) < 1:
            raise ValueError(f"{part}: not within {low}-{high}")
        out.update(range(first, last + 1, int(step or 1)))
    return out


def next_cron(expression: str, after: datetime) -> datetime:
    """The first minute strictly after a time (in its own zone) that five cron fields allow."""
    fields = expression.split()
    if len(fields) != 5:
        raise ValueError("a cron expression has five fields")
    minute, hour, day, month = (_field(f, lo, hi) for f, lo, hi in zip(fields, (0, 0, 1, 1), (59, 23, 31, 12), strict=False))
    weekday = {d % 7 for d in _field(fields[4], 0, 7)}
    either = fields[2] != "*" and fields[4] != "*"
    t = (after + timedelta(minutes=1)).replace(second=0, microsecond=0)
    for _ in range(366 * 5):
        on_day, on_weekday = t.day in day, (t.weekday() + 1) % 7 in weekday
        if t.month in month and ((on_day or on_weekday) if either else (on_day and on_weekday)):
            same = t
            while same.date() == t.date():
                if same.hour in hour and same.minute in minute:
                    return same
                same += timedelta(minutes=1)
        t = (t + timedelta(days=1)).replace(hour=0, minute=0)
    raise ValueError("no time within five years")
