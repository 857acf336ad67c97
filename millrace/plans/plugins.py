"""Plugins by entry points, and checks that sources and sinks must pass."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from importlib.metadata import EntryPoint, entry_points

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources.envelopes import faults

GROUPS = {"sources": "millrace.sources", "destinations": "millrace.destinations", "transforms": "millrace.transforms"}
SECRET_NAMES = ("password", "token", "secret", "api_key")  # fixed values


def discover(kind: str, found: Iterable[EntryPoint] | None = None) -> dict[str, EntryPoint]:
    """Entry points of a kind by name, none of them loaded. ValueError for a name that is there twice."""
    out: dict[str, EntryPoint] = {}
    for e in entry_points(group=GROUPS[kind]) if found is None else found:
        if e.name in out:
            raise ValueError(f"{kind}: {e.name} is there twice")
        out[e.name] = e
    return out


def manifest_faults(manifest: dict) -> list[str]:
    """What a plugin's manifest lacks."""
    out = [f"{k} is missing" for k in ("name", "version", "config") if not manifest.get(k)]
    fields = (manifest.get("config") or {}).get("properties", {})
    out += [f"{n}: a secret must be a reference" for n, f in fields.items() if any(s in n.lower() for s in SECRET_NAMES) and "default" in f]
    return out


def source_faults(read: Callable[[], DataFrame]) -> list[str]:
    """What is wrong with a source of envelopes: broken rules, ids that come with two streams, reads that differ."""
    first, second = read(), read()
    out = [r["fault"] for r in faults(first).select("fault").distinct().collect()]
    if first.groupBy("id").agg(F.count_distinct("source", "stream").alias("n")).where("n > 1").limit(1).count():
        out.append("an id in two streams")
    same = ["id", "operation", "payload"]
    if first.select(*same).exceptAll(second.select(*same)).limit(1).count():
        out.append("two reads differ")
    return out


def sink_faults(write: Callable[[DataFrame], None], read: Callable[[], DataFrame], log: DataFrame, key: tuple[str, ...]) -> list[str]:
    """What is wrong with a sink: rows of one key, or a replay that changes it."""
    write(log)
    before = read()
    kept = before.collect()
    out = ["several rows of one key"] if before.groupBy(*key).count().where("count > 1").limit(1).count() else []
    write(log)
    if sorted(map(repr, read().collect())) != sorted(map(repr, kept)):
        out.append("a replay changes it")
    return out


def leaks(texts: Iterable[str], secrets: Iterable[str]) -> list[str]:
    """Texts that hold a secret."""
    hidden = [s for s in secrets if s]
    return [t for t in texts if any(s in t for s in hidden)]
