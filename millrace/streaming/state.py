"""Source states with revisions, and deliveries that must be genuine and come once."""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def promote(states: DataFrame, candidates: DataFrame, key: Sequence[str] = ("pipeline", "source", "stream")) -> tuple[DataFrame, DataFrame]:
    """(states, conflicts): a candidate replaces the state whose revision it was based on (0: none yet); others are conflicts."""
    s, c = states.alias("s"), candidates.alias("c")
    on = [F.col(f"s.{k}") == F.col(f"c.{k}") for k in key]
    both = s.join(c, on, "full_outer")
    fits = F.coalesce(F.col("s.revision"), F.lit(0)) == F.col("c.base_revision")
    names = [F.coalesce(f"s.{k}", f"c.{k}").alias(k) for k in key]
    taken = F.coalesce(fits, F.lit(False))
    after = both.select(*names, F.when(taken, F.col("c.state")).otherwise(F.col("s.state")).alias("state"), F.when(taken, F.col("c.base_revision") + 1).otherwise(F.col("s.revision")).alias("revision"), F.when(taken, F.col("c.deleted")).otherwise(F.col("s.deleted")).alias("deleted"))
    lost = both.where(F.col("c.base_revision").isNotNull() & ~taken).select(*names, F.col("c.base_revision").alias("base_revision"), F.col("s.revision").alias("revision"))
    return after.where("revision is not null"), lost


def sign(secret: bytes, timestamp: str, delivery: str, body: bytes) -> str:
    """HMAC-SHA256 over time, delivery and body, with dots between."""
    return hmac.new(secret, f"{timestamp}.{delivery}.".encode() + body, hashlib.sha256).hexdigest()


def genuine(secret: bytes, timestamp: str, delivery: str, body: bytes, signature: str, now: float, skew: int = 300) -> dict:
    """The delivery's JSON object; ValueError if its time is off, the signature is wrong or the body is no object."""
    if abs(now - float(timestamp)) > skew:
        raise ValueError("the time is too far off")
    if not hmac.compare_digest(sign(secret, timestamp, delivery, body), signature):
        raise ValueError("the signature is wrong")
    found = json.loads(body)
    if not isinstance(found, dict):
        raise ValueError("the body is not an object")
    return found


def first_deliveries(deliveries: DataFrame, trigger: str, delivery: str, order: str) -> DataFrame:
    """The first arrival of each delivery of a trigger."""
    rest = [c for c in deliveries.columns if c not in (trigger, delivery)]
    first = deliveries.groupBy(trigger, delivery).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_f"))
    return first.select(trigger, delivery, "_f.*")
