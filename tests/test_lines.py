import json
import random

import pytest

from millrace.sources import envelopes
from millrace.sources.lines import LineReader


def content(n, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        out.append(r.choice([json.dumps({"id": f"k{i}", "v": "é" * r.randrange(30)}, ensure_ascii=False), json.dumps({"v": i}), "", "  "]) + r.choice(["\n", "\n", "\r\n"]))
    return "".join(out)


def expected(text):
    out = []
    for n, line in enumerate(text.split("\n")[:-1] if text.endswith("\n") else text.split("\n"), 1):
        if line.strip():
            out.append((n, str(json.loads(line).get("id", n))))
    return out


def got(rows):
    return [(r.seq + 1, r.metadata["native_id"]) for r in rows.orderBy("seq").collect()]


@pytest.mark.parametrize("size", ["200", "128m"])
def test_lines_have_their_numbers_at_any_split(spark, tmp_path, size):
    path, text = tmp_path / "x.jsonl", content(400)
    path.write_text(text, newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = envelopes.json_lines(spark, str(path), "f", "s")
        assert got(rows) == expected(text)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lines_of_several_files_are_told_apart(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.jsonl").write_text('{"v": 1}\n\n{"v": 2}\n')
    rows = envelopes.json_lines(spark, str(tmp_path), "f", "s").orderBy("seq").collect()
    assert [(r.seq, r.metadata["native_id"]) for r in rows] == [(0, "a.jsonl:1"), (2, "a.jsonl:3"), (3, "b.jsonl:1"), (5, "b.jsonl:3")]
    assert len({r.id for r in rows}) == 4


def sweep(spark, path, out, check, **options):
    stream = envelopes.json_lines_stream(spark, str(path), "f", "s", **options)
    stream.writeStream.format("parquet").option("checkpointLocation", str(check)).trigger(availableNow=True).start(str(out)).awaitTermination()


@pytest.mark.parametrize("split", [1, 300, 1 << 20])
def test_a_stream_goes_on_after_growth(spark, tmp_path, split):
    path, out, check = tmp_path / "x.jsonl", tmp_path / "out", tmp_path / "check"
    text = content(300)
    raw = text.encode()
    cuts = [0, raw.index(b"\n", 900) - 3, raw.index(b"\n", 4000) + 1, len(raw)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        with path.open("ab") as f:
            f.write(raw[a:b])
        sweep(spark, path, out, check, split=split)
    rows = spark.read.parquet(str(out))
    assert got(rows) == expected(text)
    assert {r.id for r in rows.collect()} == {r.id for r in envelopes.json_lines(spark, str(path), "f", "s").collect()}


def test_a_changed_or_shorter_file_is_refused(spark, tmp_path):
    path, out, check = tmp_path / "x.jsonl", tmp_path / "out", tmp_path / "check"
    path.write_text('{"id": "a"}\n{"id": "b"}\n')
    sweep(spark, path, out, check)
    path.write_text('{"id": "A"}\n{"id": "b"}\n{"id": "c"}\n')
    with pytest.raises(Exception, match="has changed before byte"):
        sweep(spark, path, out, check)
    path.write_text('{"id": "a"}\n')
    with pytest.raises(Exception, match="is shorter|has changed"):
        sweep(spark, path, out, check)
    path.write_text('{"id": "a"}\n{"id": "b"}\n{"id": "c"}\n{"id": "unfinished')
    sweep(spark, path, out, check)
    assert [n for n, _ in got(spark.read.parquet(str(out)))] == [1, 2, 3]


def test_offsets_and_a_last_line_without_an_end(tmp_path):
    path = tmp_path / "x"
    path.write_bytes(b"one\ntwo\n\nthr")
    reader, whole = LineReader(str(path), 1), LineReader(str(path), 1, last=True)
    first = reader.latestOffset()
    assert (first["byte"], first["line"]) == (9, 3) and whole.latestOffset()["line"] == 4
    parts = reader.partitions(reader.initialOffset(), first)
    assert [b.to_pydict() for p in parts for b in reader.read(p)] == [{"line": [1], "byte": [4], "value": ["one"]}, {"line": [2], "byte": [8], "value": ["two"]}, {"line": [3], "byte": [9], "value": [""]}]
    path.write_bytes(b"one\ntwo\n\nthree\nfour\n")
    fresh = LineReader(str(path), 1)
    last = fresh.latestOffset()
    assert [b["value"].to_pylist() for p in fresh.partitions(first, last) for b in fresh.read(p)] == [["three"], ["four"]]
    assert fresh.partitions(last, last) == []
    (tmp_path / "none").write_bytes(b"")
    assert LineReader(str(tmp_path / "none")).latestOffset() == reader.initialOffset()
