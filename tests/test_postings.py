import random
import re

import numpy as np
import pyarrow as pa
import pytest

from millrace.streaming import postings as P


def batch(rows, texts):
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(texts, pa.string())], ["_row", "_text"])


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def wanted(texts):
    out = {}
    for row, text in texts.items():
        for at, term in enumerate(words(text)):
            out.setdefault((term, row), []).append(at)
    return out


def stored(made):
    """As they are read: with _seg and _bucket; the lengths apart."""
    table = pa.Table.from_batches(made)
    whole = [pa.RecordBatch.from_pydict({"term": t, "_seg": pa.array([1], pa.int32()), "_block": b, "places": p, "_bucket": pa.array([2], pa.int32())}) for t, b, p in ((c.column(0), c.column(1), c.column(2)) for c in (table.slice(i, 1).combine_chunks().to_batches()[0] for i in range(table.num_rows)))]
    return [x for x in whole if x.column(0)[0].as_py()], [x for x in whole if not x.column(0)[0].as_py()]


def opened(batches):
    return {(x["term"], x["_row"]): x["positions"] for b in P.places(iter(batches)) for x in b.to_pylist()}


@pytest.mark.parametrize("most", [P.MOST, 40])
def test_cells_hold_the_places_of_all_tokens(monkeypatch, most):
    monkeypatch.setattr(P, "MOST", most)
    r = random.Random(1)
    some = ["", " ", "The", "the", "fox", "FOX9", "über", "straße", "élan", "a", "z" * 200, "..", "-", "x,y", "\n", "漢字", "w1", "w2"]
    texts = {row: r.choice(["", " ", "_"]).join(r.choice(some) for _ in range(r.randrange(9))) for row in [*range(50), *range(2040, 2060), 7 << 33, (7 << 33) + 2]}
    texts[51], texts[52] = "ends inside", "a word"  # neighbours don't run together
    texts[2070] = " ".join(r.choice(["the", "q"]) for _ in range(5000)) + " last"
    keys = sorted(texts)
    parts = [keys[:30], keys[30:31], keys[31:]]
    made = list(P.cells(iter([batch(k, [texts[x] for x in k]) for k in parts] + [batch([], [])])))
    found, lens = stored(made)
    assert opened(found) == wanted(texts)
    assert {x["_row"]: x["len"] for b in P.lengths(iter(lens)) for x in b.to_pylist()} == {k: n for k, t in texts.items() if (n := len(words(t)))}


def test_rows_out_of_order_and_slices():
    texts = {5: "b a", 3: "a a", 9: "c"}
    whole = batch([99, 5, 3, 9], ["not this", *texts.values()])
    found, _ = stored(list(P.cells(iter([whole.slice(1)]))))
    assert opened(found) == wanted(texts)


@pytest.mark.parametrize("top", [1, 200, 20_000, 3_000_000, 300_000_000])
def test_packed_numbers_come_back(top):
    r = np.random.default_rng(2)
    n = r.integers(1, 6, 40)
    rows = np.concatenate([np.sort(r.choice(1 << P.BITS, k, replace=False)) for k in n])
    counts = r.integers(1, 5, len(rows))
    positions = np.concatenate([np.cumsum(r.integers(1, top + 1, k)) for k in counts])
    places = P.packed(n, rows, counts, positions)
    for got, want in zip(P.unpacked(places), (n, rows, counts, positions), strict=True):
        assert (got == want).all() and len(got) == len(want)
    cut = P.unpacked(places.slice(3, 7))
    assert (cut[0] == n[3:10]).all() and (cut[1] == rows[n[:3].sum() : n[:10].sum()]).all()


def test_dead_rows_are_taken_out():
    r = random.Random(3)
    texts = {row: " ".join(r.choice("abcdefg") for _ in range(6)) for row in range(70)} | {63: "only", 1 << P.BITS: "other block a"}
    found, _ = stored(list(P.cells(iter([batch(list(texts), list(texts.values()))]))))
    dead = {row for row in texts if row % 3 == 0 and row < 70}
    bits = np.zeros(1 << P.BITS, np.uint8)
    bits[list(dead)] = 1
    longs = np.packbits(bits, bitorder="little").view("<i8").tolist()
    marked = [b.append_column("_dead", pa.array([longs if b.column("_block")[0].as_py() == 0 else [0] * len(longs)], pa.list_(pa.int64()))) for b in found]
    left = list(P.without(iter(marked)))
    assert opened(left) == wanted({row: t for row, t in texts.items() if row not in dead})
    assert "only" not in {b.column("term")[0].as_py() for b in left if len(b)} and left[0].schema.names == ["term", "_seg", "_block", "places", "_bucket"]
