import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import phrases

DOCS = "doc_id long, text string, lang string, slice string, j int, n string, positions string, word string, level int"


def brute(rows, least=30, longest=4, top=2000):
    total, f = Counter(), {}
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            w = [x for x in re.split("[\x20\x09]", piece) if x]
            total[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        covered = {}
        for p, a in often.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    covered[p[i : i + k]] = max(a, covered.get(p[i : i + k], 0))
        rest = []
        for p, a in often.items():
            if 100 * covered.get(p, 0) >= 80 * a:
                continue
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            rest.append((-score, -a, " ".join(p).encode(), a, counts[p[:k]], counts[p[k:]]))
        for rank, (score, _, p, a, left, right) in enumerate(sorted(rest)[:top], 1):
            out.append((lang, rank, p.decode(), a, left, right, total[lang], -score))
    return sorted(out)


def rows(n, seed=1):
    r = random.Random(seed)
    vocabulary = [*"abcdefg", "É", "é", "ß", "A", "x\x1cy", " ", "日本", "a_b", "-"]
    marks = [" ", " ", " ", " ", "  ", "\t", ", ", ".", "\r\n", "! ", "\x0b", " ;"]
    out = []
    for _ in range(n):
        words = [r.choice(vocabulary[: r.choice([3, 7, 16])]) for _ in range(r.randrange(40))]
        text = "".join(w + r.choice(marks) for w in words)
        out.append((r.choice([text, text, text, text + " new york city is big", None, "", " . "]), r.choice(["en", "en", "en", "de", None, "und", "é"])))
    return out


def mine(table, **options):
    return sorted(map(tuple, phrases.collocations(table, **options).collect()))


def table(written, rows):
    return written([(i, t, lang, "s", 1, "n", "p", "w", 2) for i, (t, lang) in enumerate(rows)], DOCS)


@pytest.mark.parametrize("tokens", [40, 1 << 20])
def test_against_brute_force(spark, written, tokens):
    data = rows(900)
    got = mine(table(written, data), least=3, tokens=tokens)
    assert got == brute(data, 3) and {len(x[2].split(" ")) for x in got} == {2, 3, 4}


def test_cut_to_top_with_ties(spark, written):
    data = rows(300, 2) + [("same same same same same", "en")] * 7
    assert mine(table(written, data), least=2, top=5) == brute(data, 2, top=5)


def test_long_text_and_lengths(spark, written):
    r = random.Random(4)
    data = [(" ".join(r.choice("pqrst") for _ in range(120_000)), "en"), *rows(30)]
    assert mine(table(written, data)) == brute(data)
    assert mine(table(written, data), longest=2, least=5) == brute(data, 5, 2)


def test_nothing_to_find(spark, written):
    assert mine(table(written, [])) == [] and mine(table(written, [(None, None), ("", "en"), ("one two", "en")])) == []


def test_op12_any_number_of_buckets_gives_the_same(spark, written, monkeypatch):
    data = rows(500, 6)
    monkeypatch.setattr(phrases, "LISTS", 40)
    assert mine(table(written, data), least=3, tokens=500) == brute(data, 3)


def test_op12_lists_leave_a_slice_packed_and_come_back_whole():
    r = np.random.default_rng(7)
    n, kinds = 200_000, 3000
    word = np.minimum(r.zipf(1.3, n), kinds) - 1
    code, counts = np.unique(word, return_counts=True)
    positions = np.argsort(word, kind="stable").astype(np.int64)
    ids = (code * 7919 + (5 << phrases.PLACES)).astype(np.int64)
    pairs = Counter(zip(ids[np.searchsorted(code, word[:-1])].tolist(), ids[np.searchsorted(code, word[1:])].tolist(), strict=True))
    marks = phrases.marked(pa.table({"slice": np.full(len(code), 3), "j": np.arange(len(code), dtype=np.int32), "id": ids}))
    out = []
    for number in (3, 9):  # two slices with the same lists
        file = pa.table({"slice": [number], "n": [counts.astype(np.int32)], "positions": [phrases.packed(phrases.steps(positions))]})
        out.append(phrases.grown(2, 5)(file, marks))
    assert sum(out[0]["m"].to_pylist()) == len(pairs) and out[0].num_rows == 5
    assert sum(map(len, out[0]["lists"].to_pylist())) < 6 * len(pairs)
    got, seen, every = {}, Counter(), pa.concat_tables(out[::-1])
    for k in range(5):
        for x in phrases.counted(6, 2)(every.filter(pa.array([b == k for b in every["bucket"].to_pylist()]))).to_pylist():
            j, known = phrases.unpacked(x["marks"], x["m"], *phrases.MARKS)
            assert (np.diff(np.cumsum(j)) > 0).all() and (known >> phrases.PLACES == 3).all()
            assert (len(x["id"]) == x["m"] and x["id"] == known.tolist()) if x["slice"] == 3 else x["id"] == []
            seen[x["slice"]] += x["m"]
            got |= dict(zip(zip(x["prefix"], x["suffix"], strict=True), x["f"], strict=True))
    want = {p: 2 * f for p, f in pairs.items() if 2 * f >= 6}
    assert got == want and seen == {3: len(want), 9: len(want)}
