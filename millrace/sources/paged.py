"""Paged sources as Spark data sources: pages come from a provider that is passed in by name.

A provider is a function (cursor or None) -> (records, next cursor or None). Register one under a
name, in a module that executors can import or before the session's workers start, and read it with
spark.read.format("paged").option("provider", "module:function").load().
"""

from __future__ import annotations

import importlib
import json
import re
from collections.abc import Callable, Iterator
from urllib.parse import urljoin, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, SimpleDataSourceStreamReader

Provider = Callable[[str | None], tuple[list[dict], str | None]]
# Names that a URL must not carry.
SENSITIVE = ("token", "api_key", "apikey", "key", "secret", "password", "access_token", "signature")


def provider(name: str) -> Provider:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def dotted(record: dict, path: str) -> object:
    for part in path.split(".") if path else []:
        record = record.get(part) if isinstance(record, dict) else None  # type: ignore[assignment]
    return record


def pages(fetch: Provider, cursor: str | None, max_pages: int, max_records: int) -> Iterator[tuple[list[dict], str | None]]:
    """Pages from a cursor on; ValueError if a cursor comes again or a bound is passed."""
    seen, records = set(), 0
    for _ in range(max_pages):
        if cursor in seen:
            raise ValueError(f"the page {cursor!r} came twice")
        seen.add(cursor)
        found, cursor = fetch(cursor)
        records += len(found)
        if records > max_records:
            raise ValueError(f"more than {max_records} records")
        yield found, cursor
        if cursor is None:
            return
    raise ValueError(f"more than {max_pages} pages")


def keyed(records: list[dict], key: str) -> list[tuple[str, str]]:
    """(key, JSON) of a page's records; ValueError for keys that are missing, not scalar, of two types or equal."""
    out, kinds = [], set()
    for r in records:
        value = dotted(r, key)
        if value is None or isinstance(value, dict | list):
            raise ValueError(f"{key}: null or not a scalar")
        kinds.add(type(value))
        out.append((json.dumps(value), json.dumps(r, sort_keys=True)))
    if len(kinds) > 1:
        raise ValueError(f"{key}: of several types")
    if len({k for k, _ in out}) < len(out):
        raise ValueError(f"{key}: equal on one page")
    return out


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "key string, record string, page int"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return PagedStream(self.options)


class PagedReader(DataSourceReader):
    """All pages in one task: each page's cursor comes from the one before."""

    def __init__(self, options: dict) -> None:
        self.options = options

    def read(self, partition):
        o = self.options
        for n, (records, _) in enumerate(pages(provider(o["provider"]), o.get("cursor"), int(o.get("max_pages", 100)), int(o.get("max_records", 100_000)))):
            yield from ((k, r, n) for k, r in keyed(records, o.get("key", "id")))


class PagedStream(SimpleDataSourceStreamReader):
    """A page at a time; the offset is the next page's cursor, so a restart goes on where it was."""

    def __init__(self, options: dict) -> None:
        self.options = options

    def initialOffset(self) -> dict:
        return {"cursor": self.options.get("cursor"), "page": 0, "done": False}

    def read(self, start: dict):
        if start["done"]:
            return iter([]), start
        records, cursor = provider(self.options["provider"])(start["cursor"])
        rows = [(k, r, start["page"]) for k, r in keyed(records, self.options.get("key", "id"))]
        return iter(rows), {"cursor": cursor, "page": start["page"] + 1, "done": cursor is None}

    def readBetweenOffsets(self, start: dict, end: dict):
        at, out = start, []
        while at != end and not at["done"]:
            rows, at = self.read(at)
            out += rows
        return iter(out)

    def commit(self, end: dict) -> None:
        pass


class MessageSource(DataSource):
    """A channel's messages as a stream, from a provider of pages that run from new to old.

    The provider is a function (before or None, size) -> the size newest messages below before, fewer
    only at the channel's beginning. A cycle goes down page by page to the floor, which is the highest
    message of the cycle before; only at its end does the floor rise to the highest message it began with.
    """

    @classmethod
    def name(cls) -> str:
        return "messages"

    def schema(self) -> str:
        return "id string, record string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return MessageStream(self.options)


class MessageStream(SimpleDataSourceStreamReader):
    """A page at a time. The offset holds the mode, the place (before), the floor, the high mark and a count of pages; what a restart reads lies between two offsets, so no page is lost or comes twice."""

    def __init__(self, options: dict) -> None:
        self.fetch = provider(options["provider"])
        self.size = int(options.get("page_size", 100))
        self.floor = str(int(options.get("floor", 0)))

    def initialOffset(self) -> dict:
        return {"mode": "catchup" if self.floor != "0" else "backfill", "before": None, "floor": self.floor, "high": None, "page": 0}

    def read(self, start: dict):
        found = sorted(((int(m["id"]), m) for m in self.fetch(start["before"], self.size)), key=lambda m: m[0])
        floor = int(start["floor"])
        if not found and start["before"] is None:
            return iter([]), start
        if start["before"] is not None and found and found[-1][0] >= int(start["before"]):
            raise ValueError(f"a page below {start['before']} holds {found[-1][0]}")
        high = start["high"] or str(max(found[-1][0], floor))
        rows = [(str(n), json.dumps(m, sort_keys=True)) for n, m in found if n > floor]
        if start["before"] is None and not rows:
            return iter([]), start  # nothing new: the same offset, so Spark makes no batch
        ended = len(found) < self.size or (floor > 0 and found[0][0] <= floor)
        if ended:
            return iter(rows), {"mode": "catchup", "before": None, "floor": high, "high": None, "page": start["page"] + 1}
        return iter(rows), {**start, "before": str(found[0][0]), "high": high, "page": start["page"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict):
        """The rows of a batch again. Messages above the high mark of its end came later and belong to the next cycle."""
        at, out = start, []
        while at["page"] < end["page"]:
            last = at["page"] + 1 == end["page"]
            top = int(at["high"] or (end["high"] or end["floor"] if last else 2**63))
            first = str(top + 1) if at["before"] is None and last else at["before"]
            rows, at = self.read({**at, "before": first, "high": str(top)} if last else at)
            out += rows
        return iter(out)

    def commit(self, end: dict) -> None:
        pass


def next_link(header: str | None) -> str | None:
    """The URL of rel="next" in a Link header; ValueError for two of them."""
    found = [m[1] for m in re.finditer(r"<([^>]*)>((?:\s*;\s*[^,;]+)*)", header or "") if re.search(r";\s*rel\s*=\s*\"?[^\";]*\bnext\b", m[2], re.IGNORECASE)]
    if len(set(found)) > 1:
        raise ValueError("two next links")
    return found[0] if found else None


def safe_url(url: str, base: str | None = None) -> str:
    """The URL, resolved against base; ValueError unless it is HTTPS (or of this machine), without credentials or secrets, and of the base's origin."""
    full = urljoin(base, url) if base else url
    parts = urlsplit(full)
    local = parts.hostname in ("localhost", "127.0.0.1", "::1")
    if parts.scheme != "https" and not (parts.scheme == "http" and local):
        raise ValueError("HTTPS only")
    if parts.username or parts.password or any(p.split("=")[0].lower() in SENSITIVE for p in parts.query.split("&")):
        raise ValueError("a URL must not hold secrets")
    if base and (parts.scheme, parts.netloc) != (urlsplit(base).scheme, urlsplit(base).netloc):
        raise ValueError("the next page lies on another host")
    return full


def retry_after(status: int, attempt: int, header: str | None = None) -> float | None:
    """Seconds to wait before the request is made again, or None if it is final. PermissionError for 401 and 403."""
    if status in (401, 403):
        raise PermissionError(f"status {status}")
    if status != 429 and status < 500:
        return None
    try:
        return max(0.0, float(header))  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return float(min(2**attempt, 30))


def newer_messages(messages: DataFrame, floor: int | None, id_column: str = "id") -> tuple[DataFrame, DataFrame]:
    """(messages above the floor, oldest first; the new floor as one row)."""
    number = F.col(id_column).cast("decimal(20,0)")
    new = messages if floor is None else messages.where(number > F.lit(floor).cast("decimal(20,0)"))
    return new.orderBy(number), new.agg(F.max(number).alias("last_message_id"))


def path_types(rows: DataFrame, column: str) -> DataFrame:
    """path and type of each top-level field of a JSON column, with the number of rows; nulls don't count."""
    fields = F.from_json(column, "map<string,string>")
    pairs = rows.select(F.explode(fields).alias("path", "value")).where("value is not null")
    kind = F.when(F.col("value").rlike(r"^-?\d+$"), "integer").when(F.col("value").rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), "number").when(F.col("value").isin("true", "false"), "boolean").when(F.startswith("value", F.lit("{")), "object").when(F.startswith("value", F.lit("[")), "array").otherwise("string")
    return pairs.groupBy("path", kind.alias("type")).agg(F.count("*").alias("rows"))


def type_conflicts(types: DataFrame) -> DataFrame:
    """Paths with more than one type."""
    return types.groupBy("path").agg(F.count_distinct("type").alias("types")).where("types > 1")
