"""Ranked full-text search over a collection."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.columns import search_tokens

UNSEARCHED = ("observed_at", "provenance", "kind")  # fixed values
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6  # fixed values of the ranking


@dataclass(frozen=True)
class Request:
    """What to search: terms (all must occur; none lists everything), a page, and equality on columns."""

    text: str | None = None
    limit: int = 10
    offset: int = 0
    where: tuple[tuple[str, str], ...] = ()

    def __post_init__(self) -> None:
        if not 1 <= self.limit <= 1000 or self.offset < 0:
            raise ValueError("limit is 1 to 1000, offset 0 or more")

    def terms(self) -> list[str]:
        if self.text is None or not self.text.strip():
            return []
        found = re.findall(r"\w+", self.text)
        if not found:
            raise ValueError("the text holds no word")
        return found


def phrases_of(spark: SparkSession, terms: list[str]) -> list[str]:
    """Terms as the tokeniser sees them: folded, an underscore parts two words of a phrase."""
    row = spark.range(1).select(*[F.array_join(search_tokens(F.lit(t)), " ").alias(str(i)) for i, t in enumerate(terms)]).first()
    return [p for p in row if p]


def _ranked(docs: DataFrame, text: str, request: Request) -> DataFrame:
    """Rows that match, with score. Statistics are over the whole collection; they are one row."""
    phrases = phrases_of(docs.sparkSession, request.terms())
    tokens = search_tokens(F.col(text))
    joined = docs.withColumn("_tokens", tokens).withColumn("_len", F.size("_tokens"))
    tf = lambda p: F.size(F.filter("_tokens", lambda t: t == p)) if " " not in p else F.regexp_count(F.concat(F.lit(" "), F.array_join("_tokens", " "), F.lit(" ")), F.lit(f"(?<= ){p}(?= )"))
    counted = joined.select("*", *[tf(p).alias(f"_tf{i}") for i, p in enumerate(phrases)]).drop("_tokens")
    stats = counted.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *frequencies(len(phrases)))
    return scored(counted, stats, len(phrases), request.where).select(*docs.columns, "score")


def frequencies(n: int) -> list[Column]:
    """In how many rows each of n phrases occurs."""
    return [F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(n)]


def scored(counted: DataFrame, stats: DataFrame, n: int, where: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows in which all of n phrases occur, with score. counted has _len and _tf0, _tf1, ... of each row; stats is one row: _n, _avg and _df0, _df1, ... of the collection."""
    hits = counted.where(" and ".join(f"_tf{i} > 0" for i in range(n)))
    for column, value in where:
        hits = hits.where(F.col(column) == value)
    score: Column = F.lit(0.0)
    for i in range(n):
        f, df = F.col(f"_tf{i}"), F.col(f"_df{i}")
        idf = F.ln((F.col("_n") - df + 0.5) / (df + 0.5))
        score = score + F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    return hits.join(F.broadcast(stats)).withColumn("score", score)


def search(docs: DataFrame, request: Request, text: str = "text", seq: str = "seq") -> DataFrame:
    """A page of hits, best first (ties by seq); without terms, all rows, the latest first, with score 0."""
    if not request.terms():
        rows = docs
        for column, value in request.where:
            rows = rows.where(F.col(column) == value)
        return rows.withColumn("score", F.lit(0.0)).orderBy(F.col(seq).desc()).offset(request.offset).limit(request.limit)
    return _ranked(docs, text, request).orderBy(F.col("score").desc(), seq).offset(request.offset).limit(request.limit)


def total(docs: DataFrame, request: Request, text: str = "text") -> DataFrame:
    """The number of hits on all pages."""
    rows = _ranked(docs, text, request) if request.terms() else docs
    if not request.terms():
        for column, value in request.where:
            rows = rows.where(F.col(column) == value)
    return rows.agg(F.count("*").alias("total"))



def searchable_text(value: Column) -> Column:
    """All strings and numbers of a JSON value, in order, with a space between; keys, true, false and null aren't text, nor is what stands under observed_at, provenance or kind. Null stays null; text that isn't JSON fails the job."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        parts, todo = [], [json.loads(text)]
        while todo:
            item = todo.pop()
            if isinstance(item, dict):
                todo += reversed([v for k, v in item.items() if k not in UNSEARCHED])
            elif isinstance(item, list):
                todo += reversed(item)
            elif item is not None and not isinstance(item, bool):
                parts.append(str(item))
        return " ".join(parts)

    return F.pandas_udf(lambda s: s.map(one, na_action="ignore"), "string")(value)
