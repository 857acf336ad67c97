import json
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.plans.graph import Edge, Graph
from millrace.plans.nodes import registry, templates
from millrace.sources import envelopes, files, paged, parsers
from millrace.streaming import pipeline, state

PAGES = {None: ([{"id": 1, "a": {"b": 2}}, {"id": 2}], "x"), "x": ([{"id": 3}], None)}


def fetch(cursor):
    """The provider of these tests."""
    return PAGES[cursor]


# Files


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.txt").write_text("hello\nworld")
    (tmp_path / "b.csv").write_text("x,y\n1,2\n3\n")
    (tmp_path / "c.html").write_text("<p>one</p><script>no</script><p>two</p>")
    (tmp_path / "d.eml").write_text("From: a@b\nSubject: s\n\nbody text\n")
    (tmp_path / "bad.bin").write_bytes(b"\x00\x01")
    (tmp_path / ".hidden.txt").write_text("no")
    with zipfile.ZipFile(tmp_path / "e.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>Hi</w:t></w:r></w:p><w:p><w:r><w:t>there</w:t></w:r></w:p></w:document>')
    return tmp_path


def test_files_are_parsed_and_failures_kept_apart(spark, folder):
    good, bad = parsers.parse_files(files.contents(spark, files.listing(spark, str(folder))))
    got = {r.name: r.text for r in good.collect()}
    assert got == {"a.txt": "hello\nworld", "b.csv": "x | y\n1 | 2\n3", "c.html": "one\ntwo", "d.eml": "body text", "e.docx": "Hi\n\nthere"}
    assert [r.error[:10] for r in bad.collect()] == ["ValueError"]
    with pytest.raises(ValueError):
        files.listing(spark, "../etc")


def test_deltas_of_files(spark, folder):
    manifest = lambda rows: spark.createDataFrame(rows, "path string, sha256 string, parser string, elements int")
    found = files.contents(spark, files.listing(spark, str(folder), "*.txt"))
    row = found.first()
    assert [r.change for r in files.changes(found, manifest([]), "v1").collect()] == ["new"]
    assert [r.change for r in files.changes(found, manifest([(row.path, row.sha256, "v1", 3)]), "v1").collect()] == ["unchanged"]
    change = files.changes(found, manifest([(row.path, row.sha256, "v0", 3), ("gone", "x", "v1", 2)]), "v1")
    parsed = spark.createDataFrame([(row.path, 0, "t")], "path string, element_index int, text string")
    got = sorted((r.path == "gone", r.element_index, r.operation) for r in files.element_events(change, parsed).collect())
    assert got == [(False, 0, "upsert"), (False, 1, "delete"), (False, 2, "delete"), (True, 0, "delete"), (True, 1, "delete")]


def test_artifacts_are_stored_once_and_verified(spark, tmp_path):
    table = spark.createDataFrame([(b"a",), (b"a",), (b"b",)], "content binary")
    assert files.store_artifacts(table, str(tmp_path / "x")).count() == 2
    assert sorted(bytes(r.content) for r in files.read_artifacts(spark, str(tmp_path / "x")).collect()) == [b"a", b"b"]


def test_csv_and_headers():
    assert parsers.csv_rows(b"\xef\xbb\xbfa,,a\n1,2\n1,2,3,4\n") == [{"a": "1", "column_2": "2", "a_2": None}, {"a": "1", "column_2": "2", "a_2": "3"}]
    assert parsers.html_stripped("<p>a</p><p></p><p></p>b<style>x</style>") == "a\n\nb"


def test_recognised_lines_and_table_headers(spark):
    words = [(5, 1, 1, 1, 1, 1, 10, 10, 5, 5, 90.0, "a"), (5, 1, 1, 1, 1, 2, 20, 10, 5, 5, -1.0, "b"), (4, 1, 1, 1, 1, 0, 0, 0, 99, 99, -1.0, "")]
    table = spark.createDataFrame(words, "level int, page int, block int, par int, line int, word int, left int, top int, width int, height int, conf double, text string")
    r = parsers.ocr_lines(table).first()
    assert (r.text, r.confidence, r.left, r.right) == ("a b", 0.9, 10, 25)
    cells = [(0, 0, 2, 0, "Year"), (1, 0, 1, 1, "Q"), (1, 1, 1, 1, "Q"), (2, 0, 1, None, "5")]
    heads = parsers.table_headers(spark.createDataFrame(cells, "row int, column int, colspan int, header_level int, text string"))
    assert [r.name for r in heads.orderBy("col").collect()] == ["Year / Q", "Year / Q_2"]


def test_json_lines(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"id": "a", "v": 1}\n\n{"v": 2}\n{"id": "a", "_operation": "DELETE"}\n')
    got = envelopes.json_lines(spark, str(path), "f", "s").orderBy("seq").collect()
    assert [(r.operation, r.payload_kind) for r in got] == [("upsert", "record"), ("upsert", "record"), ("delete", "tombstone")]
    assert got[0].id == got[2].id != got[1].id
    path.write_text("[1]\n")
    with pytest.raises(Exception, match="not a JSON object"):
        envelopes.json_lines(spark, str(path), "f", "s").collect()


def test_growing_files():
    kept = envelopes.lines_state(b"one\n", 1)
    assert envelopes.resume_at(b"one\ntwo\n", kept) == 4 and envelopes.resume_at(b"x", None) == 0
    for bad in (b"on", b"ONE\ntwo\n"):
        with pytest.raises(ValueError):
            envelopes.resume_at(bad, kept)


# Pages


def test_paged_source(spark):
    spark.dataSource.register(paged.PagedSource)
    got = spark.read.format("paged").option("provider", "tests.test_sources_plans_streams:fetch").load().collect()
    assert [(r.key, r.page) for r in got] == [("1", 0), ("2", 0), ("3", 1)]


def test_pages_and_keys_are_checked():
    with pytest.raises(ValueError, match="twice"):
        list(paged.pages(lambda c: ([], "same"), None, 9, 9))
    with pytest.raises(ValueError, match="records"):
        list(paged.pages(lambda c: ([{}] * 5, str(c) + "x"), None, 9, 7))
    for bad in ([{"id": None}], [{"id": [1]}], [{"id": 1}, {"id": "1"}], [{"id": 1}, {"id": 1}]):
        with pytest.raises(ValueError):
            paged.keyed(bad, "id")
    assert paged.keyed([{"a": {"b": 5}}], "a.b") == [("5", '{"a": {"b": 5}}')]


def test_urls_links_and_waits():
    assert paged.next_link('<https://h/a?p=2>; rel="next", <https://h/a?p=9>; rel="last"') == "https://h/a?p=2"
    assert paged.next_link(None) is None
    assert paged.safe_url("?p=2", "https://h/a") == "https://h/a?p=2"
    for bad in ("http://h/a", "https://u:p@h/", "https://h/?token=1"):
        with pytest.raises(ValueError):
            paged.safe_url(bad)
    with pytest.raises(ValueError):
        paged.safe_url("https://other/", "https://h/a")
    assert paged.retry_after(200, 0) is None and paged.retry_after(503, 9) == 30.0 and paged.retry_after(429, 1, "7") == 7.0
    with pytest.raises(PermissionError):
        paged.retry_after(403, 0)


def test_messages_above_the_floor(spark):
    table = spark.createDataFrame([("10",), ("9",), ("11",)], "id string")
    new, floor = paged.newer_messages(table, 9)
    assert [r.id for r in new.collect()] == ["10", "11"] and int(floor.first()[0]) == 11


def test_type_conflicts(spark):
    table = spark.createDataFrame([('{"a": 1, "b": "x"}',), ('{"a": 1.5, "b": null}',)], "j string")
    assert [r.path for r in paged.type_conflicts(paged.path_types(table, "j")).collect()] == ["a"]


# Graphs


def test_levels_cycles_and_reruns():
    g = Graph({n: {"type": "filter"} for n in "abcd"}, [Edge("a", "b"), Edge("b", "d"), Edge("a", "c"), Edge("c", "d"), Edge("zz", "d")])
    assert g.levels() == [["a"], ["b", "c"], ["d"]]
    assert g.to_rerun(["b"]) == {"b", "d"}
    with pytest.raises(ValueError):
        Graph(g.nodes, [*g.edges, Edge("d", "a")]).levels()
    assert g.checksum() == Graph(dict(reversed(g.nodes.items())), g.edges[::-1]).checksum()


def test_graphs_compile_to_plans(spark, folder):
    kinds = registry(spark, {"tables": {"t": spark.range(20).toDF("k")}, "sink": lambda table, df, c: None})
    g = Graph(
        {"src": {"type": "database_source", "config": {"query": "SELECT k FROM {t}"}}, "f": {"type": "filter", "config": {"condition": "item['k'] % 2 == 0"}}, "m": {"type": "merge", "config": {}}},
        [Edge("src", "f", "table", "items"), Edge("f", "m", "matched", "inputs"), Edge("f", "m", "rejected", "inputs")],
    )
    assert g.compile(kinds)["m"]["merged"].groupBy("input").count().count() == 2
    assert any("condition" in e for e in Graph({"f": {"type": "filter"}}, []).errors(kinds))
    assert any("no such port" in e for e in Graph(g.nodes, [Edge("src", "f", "nope", "items")]).errors(kinds))
    for name, ready in templates().items():
        assert not ready.errors(kinds), name
    with pytest.raises(NotImplementedError):
        Graph({"g": {"type": "github_source"}}, []).compile(kinds)
    files_graph = templates()["files-to-chunks"]
    files_graph.nodes["files"]["config"]["path"] = str(folder)
    assert files_graph.compile(kinds)["chunks"]["chunks"].count() == 5


# Streams


def test_streams_into_a_view(spark, tmp_path):
    schema = "source string, stream string, id string, operation string, v string, seq long"

    def put(n, events):
        spark.createDataFrame([("a", "s", *e) for e in events], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p={n}"))

    table = pipeline.ViewTable(spark, str(tmp_path / "view"))
    start = lambda: pipeline.run(spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*")), [lambda d: d.where("v <> 'skip' or v is null")], table, str(tmp_path / "check")).awaitTermination()
    put(0, [("x", "upsert", "1", 0), ("y", "upsert", "1", 1), ("z", "upsert", "skip", 2)])
    start()
    assert {r.id: r.v for r in table.read().collect()} == {"x": "1", "y": "1"}
    put(1, [("x", "delete", None, 3), ("y", "upsert", "2", 4)])
    start()
    start()
    assert {r.id: r.v for r in table.read().collect()} == {"y": "2"}
    assert not table.apply(spark.createDataFrame([], schema), 0)


def test_states_are_promoted_by_revision(spark):
    s = spark.createDataFrame([("p", "a", "x", "old", 3, False)], "pipeline string, source string, stream string, state string, revision int, deleted boolean")
    c = spark.createDataFrame([("p", "a", "x", "new", 3, False), ("p", "a", "y", "first", 0, False), ("p", "a", "z", "late", 2, False)], "pipeline string, source string, stream string, state string, base_revision int, deleted boolean")
    after, lost = state.promote(s, c)
    assert {r.stream: (r.state, r.revision) for r in after.collect()} == {"x": ("new", 4), "y": ("first", 1)}
    assert [r.stream for r in lost.collect()] == ["z"]


def test_deliveries_are_genuine():
    body = json.dumps({"a": 1}).encode()
    good = state.sign(b"s", "1000", "d", body)
    assert state.genuine(b"s", "1000", "d", body, good, 1200) == {"a": 1}
    for args in ((b"s", "1000", "d", body, good, 1301), (b"s", "1000", "e", body, good, 1000), (b"s", "1000", "d", b"[]", state.sign(b"s", "1000", "d", b"[]"), 1000)):
        with pytest.raises(ValueError):
            state.genuine(*args)


def test_event_windows(spark):
    table = spark.sql("select timestamp_seconds(id * 600) ts from range(12)")
    assert pipeline.tumbling(table, "ts", "1 hour", n=F.count("*")).count() == 2
    assert pipeline.sliding(table, "ts", "1 hour", "30 minutes", n=F.count("*")).count() == 5
    assert pipeline.sessions(table, "ts", "5 minutes", n=F.count("*")).count() == 12


def test_the_library_stands_without_the_corpus_operators():
    import pathlib

    import millrace

    root = pathlib.Path(millrace.__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "millrace.llm" not in p.read_text()
