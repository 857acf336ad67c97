"""python -m millrace: plugins, ingest-jsonl and query."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from millrace.operators.search import Request, searchable_text
from millrace.plans.plugins import GROUPS, discover
from millrace.sources.envelopes import json_lines
from millrace.streaming.index import SearchIndex


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="millrace")
    verbs = out.add_subparsers(dest="verb", required=True)
    verbs.add_parser("plugins")
    ingest = verbs.add_parser("ingest-jsonl")
    ingest.add_argument("input")
    ingest.add_argument("--collection", required=True)
    ingest.add_argument("--source", default="jsonl")
    ingest.add_argument("--stream", default="records")
    ingest.add_argument("--id-field", default="id")
    ingest.add_argument("--operation-field", default="_operation")
    query = verbs.add_parser("query")
    query.add_argument("text", nargs="?")
    query.add_argument("--collection", required=True)
    query.add_argument("--source")
    query.add_argument("--stream")
    query.add_argument("--limit", type=int, default=10)
    query.add_argument("--offset", type=int, default=0)
    return out


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> list[dict]:
    """Runs a verb and returns what it prints."""
    a = parser().parse_args(arguments)
    if a.verb == "plugins":
        return [{k: sorted(discover(k)) for k in GROUPS}]
    spark = spark or SparkSession.builder.getOrCreate()
    index = SearchIndex(spark, a.collection, stored=("payload",))
    if a.verb == "ingest-jsonl":
        last = index.newest()
        log = json_lines(spark, a.input, a.source, a.stream, a.id_field, a.operation_field)
        head = F.to_json(F.array("id", "source", "stream", "operation"))
        body = F.concat(F.lit("["), head, F.lit(","), F.coalesce("payload", F.lit("null")), F.lit("]"))
        index.apply(log.withColumn("text", searchable_text(body)), last[0] if last else 0)
        return [{"records": index.read().count()}]
    if index.newest() is None:
        return []
    where = tuple((k, v) for k, v in (("source", a.source), ("stream", a.stream)) if v)
    page = index.search(Request(a.text, a.limit, a.offset, where))
    return [{"id": r["id"], "score": r["score"], "payload": r["payload"]} for r in page.collect()]


if __name__ == "__main__":
    for line in main():
        print(json.dumps(line, sort_keys=True))
