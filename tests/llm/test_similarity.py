import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import ngram_join, substring
from millrace.llm.text import shingle_hashes, text_words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, uid string, node int"


def docs(texts):
    return [(i, t, "en", "s", 0, "u", 1) for i, t in enumerate(texts)]


def prose(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(10**6)}" for _ in range(n)]


def near_copies():
    base = prose(200, 1)
    out = [" ".join(base)] * 3
    for k in range(300):
        w = list(base)
        w[k % 200] = f"edit{k}"
        out.append(" ".join(w))
    return out


def shingles(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    sets, n = list(map(shingles, texts)), len(texts)
    links = [[j for j in range(n) if j != i and sets[i] and len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j])] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        new = [min([label[i], *(label[j] for j in links[i])]) for i in range(n)]
        if new == label:
            break
        label = new
    return [(i, label[i], len(links[i])) for i in range(n)]


def test_join_matches_brute_force(spark, written):
    rare = [" ".join(prose(60, s)) for s in range(40)]
    common = [" ".join(prose(30, 99) + prose(40, 1000 + s)) for s in range(80)]
    texts = [*near_copies(), *rare, *common, None, "", "   ", "one two", "one two", "a b c d e", "a b c d e f"]
    got = ngram_join.join(written(docs(texts), DOCS), limit=16, depth=3).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == brute(texts)


def test_join_edges(spark, written):
    same = [(None, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f"), (7, None)]
    rows = [(i, t, "en", "s", 0, "u", 1) for i, t in same]
    got = ngram_join.join(written(rows, DOCS)).collect()
    assert sorted((r.doc_id or 0, r.class_id, r.n_links, r.n_copies) for r in got) == [(0, 7, 2, 3), (0, 7, 2, 3), (7, 7, 0, 1), (7, 7, 2, 3)]
    assert ngram_join.join(written([], DOCS)).collect() == []


def test_keep_first_keeps_columns_and_one_row_of_each_class(spark, written):
    texts = [*near_copies()[:40], "alone is this text here now", None, ""]
    table = written(docs(texts), DOCS)
    kept = ngram_join.keep_first(table)
    assert kept.schema == table.schema
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, c, _ in brute(texts) if i == c)


def test_runs_reach_the_recall():
    assert ngram_join.runs_for(0.9999, 0.8) <= 5
    assert ngram_join.runs_for(0.999999, 0.8) > ngram_join.runs_for(0.9, 0.8)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdefgh"), max_size=12), max_size=6), st.integers(1, 8))
def test_words_and_shingles_of_a_batch_are_those_of_each_text(texts, limit):
    column = pa.array([" ".join(t) for t in texts], pa.string())
    seen = {}
    for i, j, words, offs in text_words(column, limit):
        h, at = shingle_hashes(words, offs)
        for k in range(j - i):
            for s, v in zip([tuple(texts[i + k][p : p + 5]) for p in range(max(1, len(texts[i + k]) - 4))], h[at[k] : at[k + 1]], strict=False):
                assert seen.setdefault(s, v) == v
            assert at[k + 1] - at[k] == (max(1, len(texts[i + k]) - 4) if texts[i + k] else 0)
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=60), st.integers(1, 12), st.lists(st.integers(1, 59), max_size=3))
def test_compact_windows_are_those_of_the_definition(values, t, cuts):
    h = np.array(values, np.uint64)
    at = np.unique([0, *[c for c in cuts if c < len(h)], len(h)])
    got = sorted(zip(*(x.tolist() for x in substring.compact_windows(h, at, t, 0)), strict=True))
    from millrace.llm.text import U, mix

    v = (mix(h, 100) & ~U((1 << substring.POSITION) - 1) | np.arange(len(h), dtype=U)).tolist()
    want = []
    for row, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        for c in range(a, b):
            left = right = c
            while left > a and v[left - 1] > v[c]:
                left -= 1
            while right < b - 1 and v[right + 1] > v[c]:
                right += 1
            if right - left + 1 >= t:
                want.append((c, c - left, right - c, row))
    assert got == sorted(want)


def planted():
    passage, other = prose(70, 5), prose(55, 6)
    texts = [" ".join(prose(100, 100 + s)) for s in range(12)]
    for s in range(4):
        texts.append(" ".join(prose(80 + s, 200 + s) + passage + prose(90, 300 + s)))
    edited = list(passage)
    edited[35] = "changed"
    texts.append(" ".join(prose(60, 400) + edited + prose(60, 401)))
    texts += [" ".join(prose(20 + s, 500 + s) + other) for s in range(3)]
    return texts, passage


def test_repeated_passages_are_found_and_clean_texts_are_not(spark, written):
    texts, passage = planted()
    got = substring.passages_of(written(docs(texts), DOCS)).collect()
    assert {r.doc_id for r in got} == set(range(12, len(texts)))
    for r in got:
        if 12 <= r.doc_id < 16:
            assert (r.start_word, r.n_words) == (80 + r.doc_id - 12, 70)
    assert {r.doc_id for r in got if r.is_first} == {12, 17}


def test_cut_repeats_keeps_one_occurrence(spark, written):
    texts, passage = planted()
    table = written(docs([*texts, texts[0], None, "", "short"]), DOCS)
    cut = substring.cut_repeats(table)
    assert cut.schema == table.schema
    left = {r.doc_id: r.text for r in cut.collect()}
    assert sum(" ".join(passage) in (t or "") for t in left.values()) == 1
    assert left[0] == texts[0] and left[len(texts)] == ""
    assert [left[len(texts) + k] for k in (1, 2, 3)] == [None, "", "short"]
    assert all(left[i] == texts[i] for i in range(12))


def test_passages_of_nothing(spark, written):
    assert substring.passages_of(written([], DOCS)).collect() == []
    same = docs(["a b c", "a b c", None, None, ""])
    assert substring.passages_of(written(same, DOCS)).collect() == []


@pytest.mark.parametrize("n", [49, 50, 51])
def test_fifty_words_are_the_least(spark, written, n):
    p = prose(n, 9)
    texts = [" ".join(prose(30, 10 + s) + p + prose(30, 20 + s)) for s in range(2)]
    assert (len(substring.passages_of(written(docs(texts), DOCS)).collect()) > 0) == (n >= 50)


def test_op6_a_run_that_also_stands_elsewhere_does_not_hide_a_passage():
    r = np.random.default_rng(3)
    p, *fill = (r.integers(0, 1 << 32, n, dtype=np.uint32) for n in (46, 60, 60, 60, 20, 60))
    x = np.concatenate([fill[0], p, fill[1]])
    for part in (p[5:6], p[30:44]):
        y = np.concatenate([fill[2], part, fill[3], p, fill[4]])
        at = 80 + len(part)
        assert substring.passages(x, y, 46, 0.8) == [(60, 106, at, at + 46)]
        assert substring.passages(y, x, 46, 0.8) == [(at, at + 46, 60, 106)]


def test_op6_an_earlier_row_with_less_of_a_passage_does_not_hide_it(spark, written):
    texts, starts = [], {}
    for k in range(40):
        p = prose(50, 7000 + k)
        for part, n in ((p[:49], 30), (p, 40), (p, 45)):
            if len(part) == 50:
                starts[len(texts)] = n
            texts.append(" ".join(prose(n, 8000 + 10 * len(texts)) + part + prose(60, 8001 + 10 * len(texts))))
    got = {r.doc_id: (r.start_word, r.start_word + r.n_words) for r in substring.passages_of(written(docs(texts), DOCS)).collect()}
    assert [d for d, n in starts.items() if d not in got or got[d][0] > n or got[d][1] < n + 50] == []


def test_op6_passages_near_both_thresholds_against_brute_force(spark, written):
    texts, want = [], []
    for k in range(600):
        n, changes = [(50, [25]), (60, [30]), (50, [16, 33]), (49, [])][0 if k < 300 else k % 4]
        p = prose(n, 20000 + k)
        q = [f"edit{k}-{i}" if i in changes else w for i, w in enumerate(p)]
        a, b = ({tuple(v[i : i + 5]) for i in range(n - 4)} for v in (p, q))
        want.append(n >= 50 and len(a & b) >= 0.8 * len(a | b))
        texts += [" ".join(prose(60, 30000 + 4 * k + s) + v + prose(60, 30002 + 4 * k + s)) for s, v in enumerate((p, q))]
    got = {r.doc_id for r in substring.passages_of(written(docs(texts), DOCS)).collect()}
    found = [2 * k in got and 2 * k + 1 in got for k in range(len(want))]
    assert not any(f for f, w in zip(found, want, strict=True) if not w)
    lost = sum(w and not f for f, w in zip(found, want, strict=True))
    assert lost <= 0.005 * sum(want), (lost, sum(want))


def around_boilerplate():
    """60 pairs of passages with one word changed, all around one stretch that 60 other texts have too, then clean texts."""
    shared, texts = prose(24, 90000), []
    for k in range(60):
        own = prose(32, 91000 + k)
        p = own[:16] + shared + own[16:]
        q = ["edit" if i == 50 else w for i, w in enumerate(p)]
        texts += [" ".join(prose(30, 92000 + 2 * k + s) + v + prose(30, 94000 + 2 * k + s)) for s, v in enumerate((p, q))]
    texts += [" ".join(prose(40, 96000 + k) + shared + prose(40, 97000 + k)) for k in range(60)]
    return [*texts, *[" ".join(prose(90, 98000 + k)) for k in range(20)]]


@pytest.mark.parametrize(("small", "common"), [(16, 4096), (2, 4096), (2, 20)])
def test_op6_groups_of_every_size_find_the_same_passages_in_any_layout(spark, written, monkeypatch, small, common):
    monkeypatch.setattr(substring, "SMALL", small)
    monkeypatch.setattr(substring, "COMMON", common)
    texts = around_boilerplate()
    table = written(docs(texts), DOCS)
    rows = [sorted(tuple(r) for r in substring.passages_of(t).collect()) for t in (table, table.repartition(13))]
    assert rows[0] == rows[1]
    got = {r[0] for r in rows[0]}
    assert got <= set(range(120))
    assert sum(2 * k in got and 2 * k + 1 in got for k in range(60)) >= 57


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=60), st.integers(1, 12), st.lists(st.integers(1, 59), max_size=3))
def test_op6_short_reaches_are_those_of_compact_windows(values, t, cuts):
    h = np.array(values, np.uint64)
    at = np.unique([0, *[c for c in cuts if c < len(h)], len(h)])
    c, left, right, row = substring.compact_windows(h, at, t, 0)
    got = substring.compact_windows(h, at, t, 0, whole=False)
    assert [x.tolist() for x in got] == [x.tolist() for x in (c, np.minimum(left, t - 1), np.minimum(right, t - 1), row)]


def test_op6_only_diagonals_that_span_enough_of_both_are_followed(monkeypatch):
    followed, along = [], substring.along
    monkeypatch.setattr(substring, "along", lambda *a: followed.append(1) or along(*a))
    r = np.random.default_rng(5)
    unit, fill, p = (r.integers(0, 1 << 32, n, dtype=np.uint32) for n in (30, 100, 50))
    # Each element of x stands in y, but y has 30 of them only.
    assert substring.passages(np.tile(unit, 4), np.concatenate([unit, fill]), 46, 0.8) == [] and not followed
    x = np.concatenate([np.tile(unit, 4), p, fill])
    y = np.concatenate([unit, p, fill[:3]])
    want = [(30, 173, 0, 83)]
    assert substring.passages(x, y, 46, 0.8) == want and followed
    monkeypatch.setattr(substring, "CELLS", 1)
    assert substring.passages(x, y, 46, 0.8) == want


def test_op6_pairs_compared_together_have_the_passages_of_each(monkeypatch):
    r, pairs = np.random.default_rng(11), []
    for k in range(300):
        x, y = (r.integers(0, (6, 40, 1 << 32)[k % 3], r.integers(0, 90), dtype=np.uint32) for _ in range(2))
        n = int(r.integers(0, min(len(x), len(y)) + 1))
        y[:n] = x[len(x) - n :]
        y[n // 2 : n // 2 + k % 2] = 7
        pairs.append((x, y))
    at = [np.append(0, np.cumsum([len(p[side]) for p in pairs])) for side in (0, 1)]
    for cells in (substring.CELLS, 1):
        monkeypatch.setattr(substring, "CELLS", cells)
        got = substring.passages_of_pairs(np.concatenate([p[0] for p in pairs]), at[0], np.concatenate([p[1] for p in pairs]), at[1], 12, 0.8).tolist()
        want = [[k, *found] for k, (x, y) in enumerate(pairs) for found in substring.passages(x, y, 12, 0.8)]
        assert sorted(got) == sorted(want) and len({g[0] for g in got}) > 50


def test_op6_regions_that_start_at_the_same_places_are_one_and_the_longest(spark):
    found = spark.createDataFrame([(9, 60, 1, 15), (9, 70, 1, 24)], "cid long, pos long, other long, other_pos long")
    got = [tuple(r) for r in substring.regions(found, 46).collect()]
    assert len({(cid, other, a, c) for cid, a, _, other, c, _ in got}) == len(got)
    assert (9, 3, 127, 1, 0, 82) in got


@pytest.mark.parametrize("every", [1 << 19, 100])
def test_op6_signatures_are_shuffled_in_rows_of_buckets(spark, written, monkeypatch, every):
    monkeypatch.setattr(substring, "BUCKETS", 3)
    monkeypatch.setattr(substring, "HELD", every)
    texts = [" ".join(prose(200, 60000 + k // 2)) for k in range(40)]
    table = written([(k, t) for k, t in enumerate(texts)], "cid long, t string").coalesce(1)
    signatures = [x for b in table.toArrow().to_batches() for x in zip(*(v.tolist() for v in next(substring.text_signatures(b, 21))[:3]), strict=True)]
    common, total = substring.common_signatures(table, 21)
    packed = substring.windows(table, 21, common, total)
    assert common == {} and total == len(signatures) > 500
    assert packed.count() <= 8 * (1 if every > total else total // every + 1)
    met = [(r.cid, r.pos, r.other, r.other_pos) for r in substring.meetings(packed).where("kind = 0").collect()]
    by = {}
    for key, cid, pos in signatures:
        by.setdefault(key, []).append((cid, pos))
    assert sorted(met) == sorted((*w, *min(g)) for g in by.values() for w in g if w[0] != min(g)[0])
    monkeypatch.setattr(substring, "COMMON", 1)
    assert substring.common_signatures(table, 21)[0] == {np.uint64(k).astype(np.int64).item(): len(g) for k, g in by.items() if len(g) > 1}
