import hashlib
import random
import sqlite3
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions import columns as C
from millrace.operators import chunking, control, models, rows, search, select, view
from millrace.plans import graph
from millrace.sources import envelopes

LOG = "source string, stream string, id string, operation string, v string, seq long"


def log(spark, events):
    return spark.createDataFrame([("a", "s", *e, i) for i, e in enumerate(events)], LOG)


# Identities and views


def test_record_id_is_sha256_of_the_parts(spark):
    got = spark.range(1).select(C.record_id(F.lit("a"), F.lit("b"), F.lit(3))).first()[0]
    assert got == hashlib.sha256(b"a\x1fb\x1f3").hexdigest()


def test_version_hash_ignores_what_changes_from_run_to_run(spark):
    one = lambda at: C.version_hash(id=F.lit("x"), payload=F.lit("p"), observed_at=F.lit(at))
    got = spark.range(1).select(one(1) == one(2), C.version_hash(id=F.lit("x"), payload=F.lit("q")) == one(1)).first()
    assert tuple(got) == (True, False)


def test_envelopes_and_their_faults(spark):
    table = spark.createDataFrame([(1, "delete"), (2, "Upsert"), (3, "bad")], "k int, op string")
    made = envelopes.envelopes(table, "db", "t", F.col("k"), operation=F.col("op"))
    got = {r.operation: (r.payload_kind, r.payload) for r in made.collect()}
    assert got["delete"] == ("tombstone", None) and got["upsert"] == ("record", '{"k":2,"op":"Upsert"}')
    assert [r.fault for r in envelopes.faults(made).collect()] == ["unknown operation"]
    with pytest.raises(Exception, match="tombstone"):
        envelopes.checked(made.withColumn("payload_kind", F.lit("record"))).collect()


def test_current_view_equals_a_simulation(spark):
    r = random.Random(7)
    events = [(r.choice("xyz"), r.choice(["upsert", "upsert", "snapshot", "delete"]), r.choice("12")) for _ in range(300)]
    state, applied = {}, 0
    for k, op, v in events:
        new = None if op == "delete" else v
        applied += new != state.get(k)
        state[k] = new
    frame = log(spark, events)
    assert {x.id: x.v for x in view.current_view(frame).collect()} == {k: v for k, v in state.items() if v}
    assert view.applied(frame, F.col("v")).count() == applied
    for cut in (1, 100, 299):  # a run cut at any place ends in the same view
        first = view.current_view(frame.where(f"seq < {cut}")).drop("seq")
        assert {x.id: x.v for x in view.current_view(frame.where(f"seq >= {cut}"), first).collect()} == {k: v for k, v in state.items() if v}


def test_replays_add_nothing(spark):
    frame = log(spark, [("x", "upsert", "1"), ("x", "upsert", "2"), ("x", "upsert", "1"), ("y", "delete", None)])
    first = view.append_changes(frame, F.concat_ws(":", "operation", "v"))
    assert first.count() == 3
    assert view.append_changes(frame, F.concat_ws(":", "operation", "v"), first.select("id", "version")).count() == 0
    written, ledger = view.ledger_apply(frame, spark.createDataFrame([], "id string, operation string, v string"), ("id", "operation", "v"), ("id",))
    assert {r.id: r.v for r in written.collect()} == {"x": "2", "y": None}
    assert view.ledger_apply(frame, ledger, ("id", "operation"), ("id",))[0].count() == 0


# Rows


def test_filter_rejects_what_fails_and_loses_nothing(spark):
    table = spark.createDataFrame([("a", 5, ["x"]), ("b", None, []), ("7", 200, None)], "name string, size int, tags array<string>")
    for text, want in {
        "item['size'] > 100": {"7"}, "int(item['name']) > 1": {"7"}, "item.size": {"a", "7"}, "not item['size']": {"b"}, "item.get('size', 0) < 10": {"a", "b"}, "'x' in item['tags']": {"a"},
        "item['name'].upper() == 'A' or len(item['name']) > 5": {"a"}, "item['name'] > 3": set(), "1 < item['size'] < 10": {"a"}, "item['size'] is None": {"b"}, "item['tags']": {"a"}, "item['size'] / 0 > 1": set(),
        "int(item['name']) >= 0 or item['size'] == 5": {"7"}, "item['size'] == 5 or int(item['name']) >= 0": {"a", "7"}, "item['size'] is not None and item['size'] > 3": {"a", "7"}, "item['size'] != 5": {"b", "7"},
        "item['size'] not in [5, 7]": {"b", "7"}, "item['name'] == 7": set(), "item['missing'] or True": set(), "item.get('missing') is None": {"a", "b", "7"}, "any(t == 'x' for t in item['tags'])": {"a"},
        "all(len(t) > 0 for t in item['tags'])": {"a", "b"}, "len([t for t in item['tags'] if t != 'x']) == 0": {"a", "b"}, "'x' in sorted(item['tags'])": {"a"}, "max(item['tags']) == 'x'": {"a"}, "1 < 0 < item['size'] or True": {"a", "b", "7"},
    }.items():
        yes, no = rows.filter_rows(table, text)
        assert {r.name for r in yes.collect()} == want, text
        assert yes.count() + no.count() == 3
    for bad in ("", "__import__('os')", "open('x')", "item.__class__", "item["):
        with pytest.raises((ValueError, SyntaxError)):
            rows.filter_rows(table, bad)


def test_transform_rounds_half_to_even(spark):
    got = rows.transform_rows(spark.createDataFrame([(2.5, "a b")], "x double, t string"), r="round(item['x'])", w="item['t'].split()[-1]", s="f\"{item['t']}!\"", h="item['x'] // 2").first()
    assert tuple(got) == (2.0, "b", "a b!", 1)


def test_expressions_over_arrays(spark):
    table = spark.createDataFrame([([3, 1, 2], ["b", "a"])], "n array<int>, t array<string>")
    got = rows.transform_rows(
        table, a="[x * 2 for x in item['n'] if x > 1]", b="sorted(item['n'], reverse=True)", c="[f'{i}{x}' for i, x in enumerate(item['t'])]", d="[n for n, t in zip(item['n'], item['t'])]",
        e="list(map(lambda x: x + 1, item['n']))", f="','.join(item['t'])", g="sum(item['n'])", h="list(range(3))", i="list(reversed(item['n']))", j="list(filter(lambda x: x > 1, item['n']))", k="list(range(0))",
    ).first()
    assert tuple(got) == ([6, 4], [3, 2, 1], ["0b", "1a"], [3, 1], [4, 2, 3], "b,a", 6.0, [0, 1, 2], [2, 1, 3], [3, 2], [])


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_positions_over_many_ranges(spark, coalesce):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        n = 400_000
        table = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.repeat(F.lit("x"), 40).alias("wide"))
        got = rows.numbered(table, ["k"]).agg(F.count("*").alias("n"), F.count_if(F.col("idx") != F.col("k")).alias("wrong"), F.max(F.length("wide")).alias("w")).first()
        assert tuple(got) == (n, 0, 40)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_closure_and_levels_of_long_chains(spark):
    chain = spark.range(45).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    assert graph.downstream(chain, spark.createDataFrame([(5,)], "node long")).count() == 41
    assert graph.table_levels(chain, spark.range(46).toDF("node")).agg(F.max("level")).first()[0] == 45
    ring = chain.where("source < 5").unionByName(spark.createDataFrame([(5, 0)], "source long, target long"))
    with pytest.raises(ValueError, match="cycle"):
        graph.table_levels(ring, spark.range(6).toDF("node"))


def test_split_and_merge(spark):
    table = spark.range(10).toDF("k")
    got = {r.batch: [x.k for x in r["items"]] for r in rows.split_batches(table, 4, ["k"]).collect()}
    assert got == {0: [0, 1, 2, 3], 1: [4, 5, 6, 7], 2: [8, 9]}
    assert rows.merge_concat(table, table.withColumn("x", F.lit(1))).where("x is null").count() == 10
    assert rows.merge_zip(table, spark.range(3).toDF("j"), ["k"], ["j"]).count() == 3
    a = spark.createDataFrame([(1, (1, 2))], "k int, o struct<a:int,b:int>")
    b = spark.createDataFrame([(1, (None, 9)), (2, (5, 6))], "k int, o struct<b:int,c:int>")
    assert {r.k: tuple(r.o) for r in rows.merge_objects(a, b, key="k").collect()} == {1: (1, 2, 9), 2: (None, 5, 6)}


def test_templates(spark):
    made = C.template("{{ a }}-{{b}}", {"a": F.lit(1), "b": F.lit(None)})
    assert spark.range(1).select(made).first()[0] == "1-None"
    with pytest.raises(ValueError):
        C.template("{{ missing }}", {})


def test_select_guard():
    assert select.guard(" SELECT 1 ; ") == "SELECT 1"
    for bad in ("", ";", "WITH x AS (SELECT 1) SELECT 1", "DELETE FROM t", "SELECT 1; SELECT 2", "selection"):
        with pytest.raises(ValueError):
            select.guard(bad)


def test_pages_cover_all_rows_and_refuse_ties(spark):
    table = spark.createDataFrame([(i // 3, i) for i in range(20)], "c int, k int")
    seen, last = [], None
    while got := select.checked_page(table, ["c", "k"], last, 6).collect():
        seen += [r.k for r in got]
        last = tuple(got[-1])
    assert seen == list(range(20))
    with pytest.raises(ValueError):
        select.checked_page(table, ["c"], None, 2)


# Search


def test_ranking_equals_that_of_sqlite(spark):
    texts = ["the quick brown fox", "the lazy dog", "quick quick fox naïve", "a_b and fox", "b fox quick the the", "", "Élan fox"]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(x, tokenize = 'unicode61 remove_diacritics 2')")
    db.executemany("insert into t(rowid, x) values (?, ?)", enumerate(texts))
    table = spark.createDataFrame(list(enumerate(texts)), "seq int, text string")
    for terms in ("fox", "quick fox", "the", "a_b", "elan", "NAIVE quick", "nothing"):
        match = " ".join(f'"{t}"' for t in terms.split())
        want = {i: round(-s, 6) for i, s in db.execute("select rowid, bm25(t) from t where t match ?", (match,))}
        got = {r.seq: round(r.score, 6) for r in search.search(table, search.Request(terms)).collect()}
        assert got == want, terms
        assert search.total(table, search.Request(terms)).first()[0] == len(want)
    assert [r.seq for r in search.search(table, search.Request(limit=2, offset=1)).collect()] == [5, 4]
    with pytest.raises(ValueError):
        search.search(table, search.Request("?!"))
    with pytest.raises(ValueError):
        search.Request(limit=0)


# Chunks


def test_word_windows_have_the_last_overlap(spark):
    table = spark.createDataFrame([(0, "a b c d e f g"), (1, " "), (2, "x")], "doc_id int, text string")
    got = chunking.with_index(chunking.chunk_tokens(table, "doc_id", size=5, overlap=2), "doc_id").orderBy("chunk_index").collect()
    assert [(r.doc_id, r.text, r.chunk_tokens) for r in got] == [(0, "a b c d e", 5), (0, "d e f g", 4), (0, "g", 1), (2, "x", 1)]
    assert [r.chunk_index for r in got] == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        chunking.chunk_tokens(table, "doc_id", size=2, overlap=2)
    chars = chunking.chunk_tokens(table, "doc_id", size=3, overlap=1, unit="chars").where("doc_id = 0").collect()
    assert [r.text for r in sorted(chars, key=lambda r: r.local)] == ["a b", "b c", "c d", "d e", "e f", "f g", "g"]
    coded = chunking.chunk_tokens(table, "doc_id", size=4, overlap=1, unit="x", encode=lambda t: list(map(ord, t)), decode=lambda x: "".join(map(chr, x)))
    assert coded.where("doc_id = 2").first().text == "x"


def test_separators():
    split = chunking.by_separators
    assert split("aa. bb. cc", 6, [". "]) == ["aa. bb", "cc"]
    assert split("aaaaaaaa bb", 4, [" "]) == ["aaaa", "aaaa", "bb"]
    assert split("a\n\nb c d e", 5, ["\n\n", " "]) == ["a", "b c d", "e"]
    r = random.Random(3)
    for _ in range(200):
        text = "".join(r.choice("ab .\n") for _ in range(r.randrange(60)))
        pieces = split(text, 7, chunking.unescape(chunking.DEFAULT_SEPARATORS))
        assert all(0 < len(p) <= 7 for p in pieces)
        assert "".join("".join(pieces).split()).replace(".", "") == "".join(text.split()).replace(".", "")
    with pytest.raises(ValueError):
        chunking.unescape("a,,b")


def test_recursive_chunks_carry_the_next_beginning(spark):
    table = spark.createDataFrame([(0, "one two three four")], "doc_id int, text string")
    got = chunking.chunk_recursive(table, "doc_id", size=8, overlap=3, separators=" ").orderBy("local").collect()
    assert [r.text for r in got] == ["one twothr", "threefou", "four"]


def test_html_sections():
    tags = frozenset(("h1", "p"))
    page = "<h1>T</h1><script>x</script><p>one</p>tail<p>two</p>"
    assert [t for t, _ in chunking.html_sections(page, 5, tags)] == ["T\n\non", "e", "tail", "two"]
    assert "x" not in "".join(t for t, _ in chunking.html_sections(page, 2000, tags))
    assert chunking.html_sections("plain", 2, tags) == [("pl", []), ("ai", []), ("n", [])]


def test_elements_break_in_the_second_half():
    text = "a" * 60 + "\n" + "b" * 30 + " " + "c" * 60
    assert chunking.elements(text, 100) == ["a" * 60, "b" * 30 + " " + "c" * 60]
    assert chunking.elements("  \n ") == []
    assert "".join(chunking.elements("x" * 250, 100)) == "x" * 250


def test_topics_break_where_sentences_differ(spark):
    assert chunking.topics(["a.", "b.", "c."], [0.9, 0.1], 0.7, 1, 100) == [("a. b.", 0.9), ("c.", 0.1)]
    assert chunking.topics(["aaaa", "bbbb"], [1.0], 0.5, 1, 5) == [("aaaa", 1.0), ("bbbb", 1.0)]

    def fails(texts):
        raise RuntimeError

    table = spark.createDataFrame([(0, "One. Two.")], "doc_id int, text string")
    assert [tuple(r) for r in chunking.chunk_semantic(table, "doc_id", fails).collect()] == [(0, 0, "One. Two.", None)]


# Models


def test_responses(spark):
    table = spark.createDataFrame([('{"category": "a", "confidence": 3}',), ('x\n```json\n{"category": "z"}\n```',), ("junk",), (None,)], "r string")
    got = [(r.category, r.confidence, r.expected, r.success) for r in models.classification(table, "r", ["a"]).collect()]
    assert got == [("a", 1.0, True, True), ("z", 0.0, False, True), (None, None, False, False), (None, None, False, False)]
    assert [r.raw_response for r in models.extraction(table, "r", "category string").collect()][2] == "junk"


def test_vectors(spark):
    table = spark.createDataFrame([(1, "a"), (2, None)], "k int, text string")
    made = models.embed(table, chunking.hash_embedding, "hash")
    assert {r.dimensions for r in made.collect()} == {32}
    assert models.vector_rows(made, 32).count() == 2
    with pytest.raises(Exception, match="length"):
        models.vector_rows(made, 31).collect()
    one = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0], [1.0])], "a array<double>, z array<double>, s array<double>")
    assert tuple(one.select(C.cosine(F.col("a"), F.col("a")), C.cosine(F.col("a"), F.col("z")), C.cosine(F.col("a"), F.col("s"))).first()) == (1.0, 0.0, 0.0)
    with pytest.raises(ValueError):
        models.vector_table("a; drop")


def test_merge_concat_keeps_the_order_of_each_input(spark, written):
    a, b = written([(3, "c"), (1, "a"), (2, None)], "k int, v string"), written([(9,), (8,)], "k int")
    got = rows.merge_concat(a, b, orders=(["k"], ["k"])).orderBy("input", "ordinal").collect()
    assert [(r.input, r.ordinal, r.k, r.v) for r in got] == [(0, 0, 1, "a"), (0, 1, 2, None), (0, 2, 3, "c"), (1, 0, 8, None), (1, 1, 9, None)]
    assert rows.merge_concat(a.where("false"), b, orders=(["k"], ["k"])).count() == 2
    with pytest.raises(ValueError):
        rows.merge_concat(a, b, orders=(["k"],))


# Control


def test_rate_counts_accepted_deliveries_only(spark):
    times = [0, 10, 20, 55, 61, 62, 71, 130]
    table = spark.createDataFrame([(i, "t", datetime(2024, 1, 1, 0, t // 60, t % 60)) for i, t in enumerate(times)], "n int, trigger string, at timestamp")
    held, want = [], []
    for t in times:
        ok = sum(t - 60 <= x for x in held) < 2
        want.append(ok)
        held += [t] * ok
    got = control.accept_deliveries(table, "trigger", "at", "n", 2).orderBy("n").collect()
    assert [r.accepted for r in got] == want


def test_leases(spark):
    at = datetime(2024, 1, 1)
    jobs = spark.createDataFrame([("a", "queued", at, at, None, None, 0), ("b", "leased", at, at, datetime(2023, 1, 1), "x", 1), ("c", "leased", at, at, datetime(2025, 1, 1), "x", 1)], "job_id string, status string, available_at timestamp, created_at timestamp, lease_expires_at timestamp, lease_owner string, attempt_count int")
    now = F.lit("2024-06-01").cast("timestamp")
    assert [r.job_id for r in control.claimable(jobs, now, 5).collect()] == ["a", "b"]
    got = {r.job_id: (r.lease_owner, r.attempt_count) for r in control.claim(jobs, "me", now).collect()}
    assert got == {"a": ("me", 1), "b": ("x", 1), "c": ("x", 1)}
    done = {r.job_id: r.status for r in control.finish(control.claim(jobs, "me", now), "a", "other", "done").collect()}
    assert done["a"] == "leased"


def test_cron():
    at = datetime(2024, 2, 28, 23, 59)
    assert control.next_cron("*/15 * * * *", at) == datetime(2024, 2, 29, 0, 0)
    assert control.next_cron("30 6 1 * *", at) == datetime(2024, 3, 1, 6, 30)
    assert control.next_cron("0 0 13 * 5", at) == datetime(2024, 3, 1, 0, 0)
    for bad in ("* * * *", "61 * * * *", "0 0 31 2 *"):
        with pytest.raises(ValueError):
            control.next_cron(bad, at)
    assert control.backoff(10, 1.5) == 90.0


def test_a_failed_batch_leaves_the_others(spark, written):
    def provider(texts):
        if "bad" in texts:
            raise RuntimeError("no")
        return [[1.0, 2.0]] * (1 if "short" in texts else len(texts))

    table = written([(i, t) for i, t in enumerate(["a", None, "bad", "b", "short", "c", "d"])], "id int, text string").orderBy("id").coalesce(1)
    got = {r.id: (r.embedding, r.dimensions, r.error) for r in models.embed(table, provider, "m", batch=2, keep=True).collect()}
    assert got[0] == got[1] == got[6] == ([1.0, 2.0], 2, None)
    assert got[2] == got[3] == (None, None, "RuntimeError: no") and got[4] == got[5] == (None, None, "ValueError: 1 vectors for 2 texts")
    with pytest.raises(Exception, match="RuntimeError: no"):
        models.embed(table, provider, "m", batch=2).collect()
    assert models.embed(table.where("false"), provider, "m", keep=True).count() == 0


def test_chunkers_hold_few_texts_as_objects_at_once(spark):
    import pyarrow as pa

    text = "a line of some words\n" * 500
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array([text, None, ""] * 1000)], ["doc", "text"])
    out = list(chunking.in_parts(lambda t: chunking.elements(t) if t else [], pa.string())(iter([batch, batch.slice(0, 0)])))
    assert len(out) > 8 and max(b.column(1).nbytes for b in out) < 3 * chunking.AT_ONCE
    assert [d for b in out for d in b.column(0).to_pylist()] == list(range(3000))
    parts = [p for b in out for p in b.column(1).to_pylist()]
    assert parts == [chunking.elements(text), [], []] * 1000
    rows = spark.createDataFrame([(1, text), (2, None), (None, "x")], "doc_id int, text string")
    assert {(r.doc_id, r.local) for r in chunking.chunk_elements(rows, "doc_id").collect()} == {(1, 0), (None, 0)}
