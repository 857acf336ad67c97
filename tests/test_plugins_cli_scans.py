from importlib.metadata import EntryPoint

import pytest
from pyspark.sql import functions as F

from millrace.__main__ import main
from millrace.plans import plugins
from millrace.sources import envelopes, scans
from millrace.streaming.pipeline import ViewTable


def test_plugins_by_name():
    e = EntryPoint("a", "m:f", plugins.GROUPS["sources"])
    assert plugins.discover("sources", [e]) == {"a": e}
    with pytest.raises(ValueError):
        plugins.discover("sources", [e, e])
    assert plugins.manifest_faults({"name": "x", "version": "1", "config": {"properties": {"token": {"default": "t"}}}}) == ["token: a secret must be a reference"]
    assert plugins.leaks(["ok", "has s3cret"], ["s3cret", ""]) == ["has s3cret"]


def test_conformance(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    good = lambda: envelopes.envelopes(rows, "db", "t", F.col("k"))
    assert plugins.source_faults(good) == []
    assert "id is empty" in plugins.source_faults(lambda: good().withColumn("id", F.lit("")))
    view = ViewTable(spark, str(tmp_path / "v"))
    numbers = iter(range(9))
    log = good().withColumn("seq", F.lit(0).cast("long"))
    assert plugins.sink_faults(lambda d: view.apply(d, next(numbers)), view.read, log, ("id",)) == []


def test_command_line(spark, tmp_path):
    path, view = tmp_path / "x.jsonl", str(tmp_path / "view")
    path.write_text('{"id": "a", "title": "red fox"}\n{"id": "b", "title": "blue fox", "n": 7}\n')
    assert main(["ingest-jsonl", str(path), "--collection", view], spark) == [{"records": 2}]
    assert [r["payload"][8] for r in main(["query", "blue", "--collection", view], spark)] == ["b"]
    path.write_text('{"id": "a", "_operation": "delete"}\n')
    assert main(["ingest-jsonl", str(path), "--collection", view], spark) == [{"records": 1}]
    assert len(main(["query", "--collection", view], spark)) == 1
    assert set(main(["plugins"])[0]) == set(plugins.GROUPS)


def test_recognition_where_it_is_needed(spark):
    pages = spark.createDataFrame([(1, "x" * 300, b"i"), (2, "", b"scan")], "page int, text string, image binary")
    got = {r.page: (r.text, r.recognised) for r in scans.recognised(pages, lambda b: bytes(b).decode() + "!").collect()}
    assert got == {1: ("x" * 300, False), 2: ("scan!", True)}
    with pytest.raises(ValueError):
        scans.needs_recognition(F.col("text"), "maybe")


def test_images_are_checked():
    import struct

    head = scans.BEGINNINGS["png"] + b"\x00\x00\x00\rIHDR"
    assert scans.image_fault("png", head + struct.pack(">II", 10, 10)) is None
    assert scans.image_fault("png", head + struct.pack(">II", 40_000, 1)) == "it is too large"
    assert scans.image_fault("jpg", head) and scans.image_fault("exe", b"MZ")


def test_kept_results_are_not_made_again(spark):
    wanted = spark.createDataFrame([("a",), ("b",)], "key string")
    make = lambda d: d.withColumn("result", F.concat("key", F.lit("!")))
    everything, new = scans.with_kept(wanted, None, make)
    assert new.count() == 2
    everything, new = scans.with_kept(wanted, spark.createDataFrame([("a", "kept")], "key string, result string"), make)
    assert {r.key: r.result for r in everything.collect()} == {"a": "kept", "b": "b!"} and new.count() == 1
    assert scans.extraction_key("s", "c", "1", {"b": 1, "a": 2}) == scans.extraction_key("s", "c", "1", {"a": 2, "b": 1})
