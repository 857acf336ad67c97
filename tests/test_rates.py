from collections import deque
from datetime import datetime, timedelta
import random

import pytest

from millrace.operators import control

START = datetime(2024, 1, 1)
SCHEMA = "n int, trigger string, at timestamp, body string"


def plain(rows, limit):
    """accepted by n, one delivery after the other."""
    out, held = {}, {}
    for n, k, t, _ in sorted(rows, key=lambda r: (r[1] or "", r[2] or datetime.min, r[0])):
        q = held.setdefault(k, deque())
        out[n] = False
        if t is not None:
            while q and q[0] < t - timedelta(seconds=60):
                q.popleft()
            if len(q) < limit:
                out[n] = True
                q.append(t)
    return out


def deliveries(seed):
    r, rows = random.Random(seed), []
    for s in range(1500):
        rows.append(("even", s))
        rows.append(("uneven", s + r.choice([0, 0, r.random()])))
    rows += [(r.choice(["a", "b", None, "c"]), r.randrange(9000)) for _ in range(1200)]
    rows += [("burst", 1000 * b + r.randrange(20)) for b in range(5) for _ in range(80)]
    r.shuffle(rows)
    return [(n, k, START + timedelta(seconds=t), "x") for n, (k, t) in enumerate(rows)] + [(9000, "even", None, None), (9001, None, None, "y")]


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize(("limit", "rounds"), [(5, 0), (5, 1), (100, 4)])
def test_rates_of_keys_over_many_ranges_are_those_of_a_plain_pass(spark, written, many_ranges, limit, rounds):
    rows = deliveries(limit)
    got = control.accept_deliveries(written(rows, SCHEMA), "trigger", "at", "n", limit, rounds=rounds)
    assert got.columns == ["n", "trigger", "at", "body", "accepted"]
    found = {r.n: r.accepted for r in got.collect()}
    want = plain(rows, limit)
    assert len(found) == len(rows)
    assert [n for n in want if want[n] != found[n]] == []


def test_rates_of_nothing(spark, written):
    assert control.accept_deliveries(written([], SCHEMA), "trigger", "at", "n", 2).collect() == []
