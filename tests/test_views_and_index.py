import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.operators import search, view
from millrace.streaming.index import SearchIndex
from millrace.streaming.pipeline import ViewTable

LOG = "source string, stream string, id string, operation string, v string, seq long"


def events(spark, rows):
    return spark.createDataFrame([("a", "s", *r) for r in rows], LOG)


def state(table):
    rows = table.read()
    return {} if rows is None else {r.id: r.v for r in rows.collect()}


def test_only_buckets_of_the_batch_are_rewritten(spark, tmp_path):
    table = ViewTable(spark, str(tmp_path / "v"), buckets=128)
    many = spark.range(100_000).select(F.lit("a").alias("source"), F.lit("s").alias("stream"), F.col("id").cast("string").alias("id"), F.lit("upsert").alias("operation"), F.lit("x").alias("v"), F.col("id").alias("seq"))
    assert table.apply(many, 0) == 100_000
    before = table.commits.read(1)["buckets"]
    batch = [(str(k), "upsert", "y", 200_000 + k) for k in range(9)] + [("17", "delete", None, 300_000)]
    assert table.apply(events(spark, batch), 1) == 10
    after = table.commits.read(2)["buckets"]
    assert 0 < sum(after[b] != before[b] for b in before) <= 10 and len(before) == 128
    found = table.lookup(events(spark, [(str(k), "", "", 0) for k in (3, 17, 50)]))
    assert {(r.id, r.v) for r in found.collect()} == {("3", "y"), ("50", "x")}
    assert len(found.inputFiles()) <= 3
    assert table.read().count() == 99_999 and table.read(1).count() == 100_000


def test_random_batches_equal_one_pass(spark, tmp_path):
    r = random.Random(1)
    table, log, applied = ViewTable(spark, str(tmp_path / "v"), buckets=4), [], 0
    for batch in range(6):
        rows = [(f"k{r.randrange(12)}", r.choice(["upsert", "upsert", "delete"]), r.choice("xyz"), len(log) + i) for i in range(15)]
        log += rows
        applied += table.apply(events(spark, rows), batch)
    want = {x.id: x.v for x in view.current_view(events(spark, log)).collect()}
    assert state(table) == want
    now, n = {}, 0
    for key, op, v, _ in log:
        new = None if op == "delete" else v
        n += now.get(key) != new
        now[key] = new
    assert applied == n


def test_a_replayed_batch_and_a_crash_before_the_commit_change_nothing(spark, tmp_path, monkeypatch):
    table = ViewTable(spark, str(tmp_path / "v"), buckets=4)
    table.apply(events(spark, [("x", "upsert", "1", 0)]), 0)
    assert table.apply(events(spark, [("x", "upsert", "2", 1)]), 0) == 0 and state(table) == {"x": "1"}

    def crash(*_):
        raise RuntimeError("crash")

    with monkeypatch.context() as m:
        m.setattr(table.commits, "add", crash)
        with pytest.raises(RuntimeError):
            table.apply(events(spark, [("x", "upsert", "2", 1)]), 1)
    assert state(table) == {"x": "1"} and len(table.folder.names("data")) == 2
    assert table.apply(events(spark, [("x", "upsert", "2", 1)]), 1) == 1 and state(table) == {"x": "2"}
    table.grace = -1.0
    table.prune()
    assert len(table.folder.names("data")) == 1 and list(table.commits.versions()) == [2] and state(table) == {"x": "2"}


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "v")
    one, two = ViewTable(spark, path, buckets=4), ViewTable(spark, path, buckets=4)
    one.apply(events(spark, [("x", "upsert", "1", 0)]), 0, "one")
    add, met = one.commits.add, []

    def late(version, content):
        if not met:
            met.append(two.apply(events(spark, [("x", "upsert", "2", 1), ("y", "upsert", "2", 2)]), 0, "two"))
        return add(version, content)

    monkeypatch.setattr(one.commits, "add", late)
    assert one.apply(events(spark, [("x", "upsert", "3", 3), ("z", "upsert", "3", 4)]), 1, "one") == 2
    assert met == [2] and state(one) == state(two) == {"x": "3", "y": "2", "z": "3"}
    assert one.newest() == (3, {"one": 1, "two": 0})


def test_empty_batches_null_keys_and_new_columns(spark, tmp_path):
    table = ViewTable(spark, str(tmp_path / "v"), buckets=2)
    assert table.read() is None and table.lookup(events(spark, [])) is None and table.newest() is None
    assert table.apply(events(spark, []), 0) == 0 and state(table) == {}
    table.apply(events(spark, [(None, "upsert", "1", 0), ("x", "upsert", "1", 1)]), 1)
    table.apply(events(spark, [(None, "upsert", "2", 2)]).withColumn("w", F.lit(5)), 2)
    assert {(r.id, r.v, r.w) for r in table.read().collect()} == {(None, "2", 5), ("x", "1", None)}
    table.apply(events(spark, [(None, "delete", None, 3), ("x", "DELETE", None, 4)]), 3)
    assert state(table) == {} and table.read().columns[-1] == "w"


DOC = "source string, stream string, id string, operation string, text string, lang string, seq long"
REQUESTS = [
    search.Request("fox"), search.Request("red, FOX!", limit=3, offset=1), search.Request("red_fox"), search.Request("the red_fox the_red", limit=50),
    search.Request("fox", where=(("lang", "de"),)), search.Request("fox", where=(("source", "b"), ("lang", "en"))), search.Request(limit=7, offset=2), search.Request(where=(("lang", "de"),)), search.Request("missing"), search.Request("Füchse"),
]


def pages(rows):
    return [(r.source, r.id, r.seq, round(r.score, 9)) for r in rows.collect()]


def test_index_gives_the_pages_of_a_search(spark, tmp_path):
    r = random.Random(2)
    index = SearchIndex(spark, str(tmp_path / "i"), stored=("lang",), buckets=4, terms=8)
    everything, n = [], 0
    for batch in range(4):
        rows = []
        for _ in range(40):
            text = r.choice([None, "", " ".join(r.choice(["the", "red", "fox", "Fox", "dog", "füchse", "red_fox", "x"]) for _ in range(r.randrange(12)))])
            rows.append((r.choice("ab"), "s", f"k{r.randrange(30)}", r.choice(["upsert", "upsert", "upsert", "delete"]), text, r.choice(["en", "de", None]), n := n + 1))
        everything += rows
        log = spark.createDataFrame(rows, DOC)
        assert index.apply(log, batch) > 0 and index.apply(log, batch) == 0
        if batch == 2:
            assert index.compact() == 3 and len(index.commits.newest()[1]["segments"]) == 1
    now = view.current_view(spark.createDataFrame(everything, DOC)).cache()
    for request in REQUESTS:
        assert pages(index.search(request)) == pages(search.search(now, request)), request
        assert index.total(request).first() == search.total(now, request).first(), request
    content = index.commits.newest()[1]
    assert (content["n"], len(content["segments"])) == (now.count(), 2)
    assert index.compact() == 2 and pages(index.search(REQUESTS[3])) == pages(search.search(now, REQUESTS[3]))
    assert {x["sign"] for x in index.postings(index.commits.newest()[1]).collect()} == {1}
    found = index.rows(index.search(REQUESTS[1])).collect()
    assert {(x.source, x.id, x.text) for x in found} <= {(x.source, x.id, x.text) for x in now.collect()} and len(found) == 3
    with pytest.raises(ValueError):
        index.search(search.Request("fox", where=(("text", "x"),)))


def test_a_search_reads_its_buckets_only(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path / "i"), terms=32)
    index.apply(spark.createDataFrame([("a", "s", str(i), "upsert", f"w{i} fox", "en", i) for i in range(200)], DOC), 0)
    plan = index.search(search.Request("fox"))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*_bucket", plan) and re.search(r"PushedFilters: \[[^\]]*term", plan)
    content = index.commits.newest()[1]
    assert index.postings(content, ["fox"]).select("_bucket").distinct().count() == 1 and index.postings(content).select("_bucket").distinct().count() > 16
    assert index.search(search.Request("fox")).count() == 10


def test_rounds_give_the_same_index_in_little_space(spark, tmp_path, monkeypatch):
    from millrace.streaming import pipeline

    r = random.Random(3)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(3000)]
    texts = [" ".join(r.choice(words) for _ in range(400)) for _ in range(600)]
    rows = [("a", "s", f"k{i}", "upsert", t, "en", i) for i, t in enumerate(texts)]
    log = spark.createDataFrame(rows, DOC)
    drafts = log.withColumn("id", F.concat(F.lit("draft "), "id"))
    log.coalesce(1).write.parquet(str(tmp_path / "input"))
    size = lambda at: sum(f.stat().st_size for f in at.rglob("*.parquet"))
    found = {}
    for name, round_bytes in (("one", 1 << 40), ("many", 1)):
        monkeypatch.setattr(pipeline, "ROUND", round_bytes)
        index = SearchIndex(spark, str(tmp_path / name), buckets=8, terms=4)
        index.apply(drafts, 0)
        index.apply(log.unionByName(drafts.withColumn("operation", F.lit("delete"))), 1)
        content = index.commits.newest()[1]
        assert (content["n"], content["tokens"]) == (600, 240_000)
        request = search.Request(words[0], limit=1000)
        found[name] = [pages(index.search(request)), index.compact(), pages(index.search(request))]
        assert {x["sign"] for x in index.postings(index.commits.newest()[1]).collect()} == {1}
        assert size(tmp_path / name / "postings") < 3 * size(tmp_path / "input"), name
    assert found["one"] == found["many"] and found["one"][0] == found["one"][2] == pages(search.search(log, search.Request(words[0], limit=1000)))


def test_a_row_of_the_same_seq_is_found_by_its_new_text(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path / "i"), terms=2)
    for batch, text in enumerate(["red fox dog", "dog fox red", "fox red dog"]):
        index.apply(spark.createDataFrame([("a", "s", "k", "upsert", text, "en", 1), ("a", "s", f"other{batch}", "upsert", "cat", "en", 2)], DOC), batch)
        for phrase in ("red_fox", "dog_fox", "fox_red", "red_dog"):
            assert index.total(search.Request(phrase)).first()["total"] == (phrase.replace("_", " ") in text), (text, phrase)


def test_an_empty_index(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path / "i"))
    with pytest.raises(ValueError):
        index.search(search.Request("fox"))
    assert index.apply(spark.createDataFrame([], DOC), 0) == 0
    assert index.search(search.Request("fox")).collect() == [] and index.total(search.Request("fox")).first()["total"] == 0 and index.compact() == 0
