import pytest
from pyspark.sql import functions as F

from millrace import catalog
from millrace.operators import history, search, view


def test_a_target_takes_events_in_order(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    log = spark.createDataFrame([(1, "c", "upsert", 1), (1, None, "DELETE", 2), (2, None, "delete", 3), (2, "d", "snapshot", 4), (3, "e", "upsert", 5), (4, None, "delete", 6)], "k int, v string, operation string, seq long")
    assert sorted(map(tuple, view.merged_into(target, log, ["k"]).collect())) == [(2, "d"), (3, "e")]
    with pytest.raises(Exception, match="null"):
        view.merged_into(target, log.withColumn("k", F.lit(None).cast("int")), ["k"]).collect()


def test_replacing_clears_only_its_own_target(spark):
    ledger = spark.createDataFrame([("t", 1, "x"), ("u", 1, "x")], "target string, id int, h string")
    log = spark.createDataFrame([(1, "x", "snapshot", 0), (1, "x", "snapshot", 1), (2, "y", "upsert", 2)], "id int, h string, operation string, seq long")
    rows, after = view.replaced(log, ledger, "t", ["id", "h"], ["id"])
    assert sorted(r.id for r in rows.collect()) == [1, 2]
    assert sorted(map(tuple, after.collect())) == [("t", 1, "x"), ("t", 2, "y"), ("u", 1, "x")]
    assert [tuple(r) for r in view.replaced(log.where("false"), ledger, "t", ["id", "h"], ["id"])[1].collect()] == [("u", 1, "x")]
    with pytest.raises(Exception, match="no deletes"):
        view.replaced(log.withColumn("operation", F.lit("delete")), ledger, "t", ["id", "h"], ["id"])[0].collect()


def test_searchable_text_of_any_json(spark):
    texts = ['{"a": [1, 2.5, [true, null, "x"]], "provenance": "no", "b": {"kind": 1, "c": "y z"}}', '"only"', "7", "[]", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[0] for r in rows.orderBy("i").select(search.searchable_text(F.col("t"))).collect()] == ["1 2.5 x y z", "only", "7", "", None]


def test_lineage_of_a_source_keeps_runs_without_entries(spark):
    said = spark.createDataFrame([(1, "s", 10), (2, "s", 11), (3, "r", 12)], "run_id int, source_ref string, p int")
    lineage = spark.createDataFrame([(1, 5), (1, 6), (3, 7)], "run_id int, l int")
    found = history.lineage_of_source(said, lineage, "s")
    assert sorted((r.run_id, r.lineage.l if r.lineage else 0) for r in found.collect()) == [(1, 5), (1, 6), (2, 0)]
    with pytest.raises(ValueError):
        history.lineage_of_source(said, lineage, "s", owner=1)


def test_next_versions_start_at_one(spark):
    saved = spark.createDataFrame([(1, 3), (1, 9)], "g int, version long")
    of = spark.createDataFrame([(1,), (2,)], "g int")
    assert sorted(map(tuple, history.next_versions(saved, of, "g").collect())) == [(1, 10), (2, 1)]


NAMES = "merge_target replace_target lineage_of_graph lineage_of_source dead_letters_of_owner next_versions storage_used models_by_price deselected_streams unique_index_probe searchable_props"


@pytest.mark.parametrize("name", NAMES.split())
def test_queries_equal_their_sql(spark, sf, name):
    import duckdb

    with duckdb.connect() as con:
        for t in ("nation", "customer", "supplier", "part", "orders", "events"):
            con.execute(f"create view {t} as from '{sf}/{t}.parquet'")
        want = con.execute(catalog.SQL[name])
        columns = sorted(c[0] for c in want.description)
        order = [[c[0] for c in want.description].index(c) for c in columns]
        rows = sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())
    got = catalog.QUERIES[name](spark, sf)
    assert sorted(got.columns) == columns
    assert rows and sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == rows
