"""SELECT texts, previews and keyset pages."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def guard(query: str) -> str:
    """The one SELECT statement of a text, without the semicolon at its end; ValueError for anything else."""
    text = query.strip()
    text = text[:-1].rstrip() if text.endswith(";") else text
    if not text:
        raise ValueError("the query is empty")
    if ";" in text:
        raise ValueError("one statement only")
    if not re.match(r"select\b", text, re.IGNORECASE):
        raise ValueError("only SELECT statements")
    return text


def select(spark: SparkSession, query: str, tables: dict[str, DataFrame], limit: int | None = None) -> DataFrame:
    """Rows of a guarded SELECT over named tables, which the text writes as {name}."""
    out = spark.sql(guard(query), **tables)
    return out if limit is None else out.limit(limit)


def after(keys: Sequence[str], values: Sequence[object]) -> Column:
    """(k1, k2, ...) > (v1, v2, ...), as comparisons that can be pushed down to a scan."""
    terms = []
    for i, (k, v) in enumerate(zip(keys, values, strict=True)):
        same = [F.col(a) == F.lit(b) for a, b in zip(keys[:i], values[:i], strict=True)]
        terms.append(reduce(lambda x, y: x & y, [*same, F.col(k) > F.lit(v)]))
    return F.col(keys[0]) >= F.lit(values[0]) if not terms else (F.col(keys[0]) >= F.lit(values[0])) & reduce(lambda x, y: x | y, terms)


def page(rows: DataFrame, keys: Sequence[str], last: Sequence[object] | None, n: int) -> DataFrame:
    """The next n rows in key order after the last key."""
    return (rows if last is None else rows.where(after(keys, last))).orderBy(*keys).limit(n)


def checked_page(rows: DataFrame, keys: Sequence[str], last: Sequence[object] | None, n: int) -> DataFrame:
    """A page whose keys must differ, and differ from the row after it; ValueError otherwise."""
    more = page(rows, keys, last, n + 1)
    if more.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError("rows with equal keys: a page can't end between them")
    return more.orderBy(*keys).limit(n)


def content_id(rows: DataFrame) -> Column:
    """SHA-256 of a row's JSON, fields in order of name: the identity of rows without a key."""
    return F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
