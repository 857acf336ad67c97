"""Deep merges of JSON objects of any shape."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WRITES = "array<struct<path: array<string>, value: string>>"


def writes(text: str | None) -> list[tuple[list[str], str | None]]:
    """What merging an object writes: each value that isn't an object, as JSON, with its path; null in place of a value where an object stands. Texts that aren't objects write nothing."""
    try:
        top = json.loads(text) if text is not None else None
    except ValueError:
        return []
    out: list[tuple[list[str], str | None]] = []
    todo = [([], top)] if isinstance(top, dict) else []
    while todo:
        path, value = todo.pop()
        out.append((path, None if isinstance(value, dict) else json.dumps(value)))
        if isinstance(value, dict):
            todo += [([*path, k], v) for k, v in value.items()]
    return out


def assembled(paths: list[list[str]], values: list[str | None]) -> str:
    """The object of these values and (where a value is None) of these objects, as JSON with keys in order."""
    top: dict = {}
    for path, value in zip(paths, values, strict=True):
        at = top
        for k in path[:-1]:
            at = at.setdefault(k, {})
        if path and value is not None:
            at[path[-1]] = json.loads(value)
        elif path:
            at.setdefault(path[-1], {})
    return json.dumps(top, sort_keys=True)


def merge_json(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key and merged: the JSON objects of each key merged deeply in order; later values win, explicit nulls too.

    Two objects at a path are merged; anything else there is replaced as a whole, arrays and objects
    by other values among it. Objects become rows of (path, value), so a key with very many objects
    is spread by its paths: of each path the last write counts, and it holds unless a later one
    wrote a value at a path above it, or anything below it. Rows of a key are told apart by order.
    Texts that aren't objects write nothing; a key without an object gives {}. Nulls are a key.
    """

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(writes)

    exploded = rows.select(F.struct(F.col(key).alias("key")).alias("k"), F.col(order).alias("o"), F.explode_outer(F.pandas_udf(run, WRITES)(F.col(value))).alias("w")).select("k", "o", "w.path", "w.value")
    leaf = F.col("value").isNotNull()
    depth = F.size("path")
    # For each path: the last value written there, and the last object that was written there or above a deeper write.
    last = exploded.where("path is not null").groupBy("k", "path").agg(F.max(F.when(leaf, F.col("o"))).alias("own"), F.max_by("value", F.when(leaf, F.col("o"))).alias("value"), F.max(F.when(~leaf, F.col("o"))).alias("object"))
    above = F.filter(F.transform(F.sequence(F.lit(0), depth), lambda i: F.slice("path", 1, i)), lambda p: F.size(p) < depth)
    steps = last.select("k", "path", F.explode(above).alias("up"))
    values = last.where("own is not null").select("k", F.col("path").alias("up"), F.col("own").alias("over"))
    killed = steps.join(values, ["k", "up"]).groupBy("k", "path").agg(F.max("over").alias("over"))
    known = last.join(killed, ["k", "path"], "left")
    beaten = lambda c: F.coalesce(F.col("over") > F.col(c), F.lit(False))
    isleaf = F.col("own").isNotNull() & ~beaten("own") & ~F.coalesce(F.col("object") > F.col("own"), F.lit(False))
    isobject = F.col("object").isNotNull() & ~beaten("object") & ~F.coalesce(F.col("own") > F.col("object"), F.lit(False))
    kept = known.where(isleaf | isobject).select("k", "path", F.when(isleaf, F.col("value")).alias("value"))
    parts = kept.groupBy("k").agg(F.collect_list(F.struct("path", "value")).alias("parts"))

    def build(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda items: assembled([list(i["path"]) for i in items], [i["value"] for i in items]))

    merged = F.coalesce(F.pandas_udf(build, "string")(F.coalesce("parts", F.array().cast(WRITES))), F.lit("{}"))
    keys = exploded.select("k").distinct()
    return keys.join(parts, "k", "left").select(F.col("k.key").alias(key), merged.alias("merged"))
