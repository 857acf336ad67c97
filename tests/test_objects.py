import json
import random

from millrace.operators.objects import merge_json

SCHEMA = "key string, n int, body string"


def merged(target, source):
    for k, v in source.items():
        if isinstance(target.get(k), dict) and isinstance(v, dict):
            merged(target[k], v)
        else:
            target[k] = json.loads(json.dumps(v))
    return target


def value(r, depth):
    kind = r.randrange(8)
    if kind < 4 and depth < 4:
        return {r.choice("abc"): value(r, depth + 1) for _ in range(r.randrange(4))}
    return r.choice([None, True, 1, 2.5, "x", "é\"", [], [1, {"a": None}], {}])


def test_equal_to_a_merge_in_python(spark):
    r = random.Random(5)
    rows, want = [], {}
    for n in range(600):
        key, body = r.choice([None, "p", "q", *[f"k{i}" for i in range(60)]]), {r.choice("abc"): value(r, 0) for _ in range(r.randrange(4))}
        rows.append((key, n, json.dumps(body)))
        want[key] = merged(want.get(key, {}), body)
    got = {x.key: json.loads(x.merged) for x in merge_json(spark.createDataFrame(rows, SCHEMA).repartition(7), "key", "n", "body").collect()}
    assert got == want


def test_edges(spark):
    rows = [("a", 1, '{"x": {"y": 1}}'), ("a", 2, '{"x": null}'), ("b", 1, '{"x": 1}'), ("b", 2, '{"x": {"y": {}}}'), ("c", 1, None), ("c", 2, "[1]"), ("d", 1, "{}"), ("d", 2, "no json"), ("e", 1, '{"x": {"y": 1, "z": 2}}'), ("e", 2, '{"x": 5}'), ("e", 3, '{"x": {"z": [3]}}')]
    got = {x.key: x.merged for x in merge_json(spark.createDataFrame(rows, SCHEMA), "key", "n", "body").collect()}
    assert got == {"a": '{"x": null}', "b": '{"x": {"y": {}}}', "c": "{}", "d": "{}", "e": '{"x": {"z": [3]}}'}
    assert merge_json(spark.createDataFrame([], SCHEMA), "key", "n", "body").collect() == []


def test_a_cycle_is_found_at_once(spark):
    import pytest
    from pyspark.sql import functions as F

    from millrace.plans.graph import table_levels

    ring = spark.range(100_000).select(F.col("id").alias("source"), ((F.col("id") + 1) % 100_000).alias("target"))
    with pytest.raises(ValueError):
        table_levels(ring, spark.range(100_000).withColumnRenamed("id", "node"))
    ways = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (4, 3)], "source long, target long")
    got = table_levels(ways, spark.createDataFrame([(1,), (4,), (9,)], "node long")).collect()
    assert {r.node: r.level for r in got} == {1: 0, 4: 0, 9: 0, 2: 1, 3: 2}
