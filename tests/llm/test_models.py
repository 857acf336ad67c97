import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.llm import hmm, langid, quality
from millrace.llm.common import read, remainder
from millrace.llm.queries import op2_quality, op8_hmm, op10_langid

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, held_out int"


def rows(texts, lang="en"):
    return [(i, t, lang, "s", 0, "x", 9) for i, t in enumerate(texts)]


def test_remainder_is_that_of_crc32(spark):
    got = spark.range(50).withColumn("r", remainder("id", 5)).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 5 for r in got)


# Languages


def test_held_out_languages(spark, sf):
    got = op10_langid(spark, sf).join(read(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95


def test_language_edges(spark, written):
    table = written(rows(["the cat sat on the mat and the dog"] * 5) + [(9, "der hund und die katze sitzen", "de", "s", 0, "x", 9)] * 5, DOCS)
    model = langid.fit(table)
    odd = written(rows([None, "", "123 !!! 45", "the cat", "ЖЖЖ", "a", "hund"]), DOCS)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(odd, model).collect()}
    assert [got[i] for i in range(3)] == [("und", 0.0)] * 3
    assert got[3][0] == "en" and got[6][0] == "de"
    assert got[4][0] in ("en", "de") and got[4][1] == 0.0
    assert all(0 <= s <= 1 for _, s in got.values())
    none = langid.fit(written([(1, "text", None, "s", 0, "x", 9)], DOCS))
    assert {r.lang_pred for r in langid.predict(odd, none).collect()} == {"und"}
    assert langid.predict(written([], DOCS), model).collect() == []


def test_grams_are_those_of_each_text():
    texts = ["Ab cd", None, "", "x", "été!! 12 long", "a  b"]
    want = []
    for t in texts:
        b = re.sub(rb"[\x00-\x60\x7b-\x7f]+", b" ", f" {(t or '').lower()} ".encode())
        want.append([int.from_bytes(b[i : i + 4], "little") for i in range(len(b) - 3)])
    got = [c[o[k] : o[k + 1]].tolist() for i, j, c, o in langid.grams(pa.array(texts)) for k in range(j - i)]
    assert got == want


def test_bloom_never_loses_a_language(spark, written):
    table = written(rows(["abcdef ghijkl"] * 3), DOCS)
    model = langid.fit(table)
    (_, _, codes, offs), = langid.grams(pa.array(["abcdef ghijkl"]))
    assert model.hits(codes, offs)[0, 0] == len(codes)


# Quality


def test_held_out_quality(spark, sf):
    got = op2_quality(spark, sf).join(read(spark, sf, "labels"), "doc_id").where("held_out").collect()
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_quality_edges(spark, written):
    table = written(rows([None, "", "good words here", "good words here"]), DOCS)
    labels = written([(2, 1, 0), (2, 0, 0), (3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(table, labels, remainder("doc_id", 3) == 1).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[0] == by[1] and by[2] == by[3]
    nobody = quality.classify(table, labels.limit(0), remainder("doc_id", 3) == 1).collect()
    assert {r.score for r in nobody} == {0.5}
    assert quality.classify(written([], DOCS), labels, remainder("doc_id", 3) == 1).collect() == []


def test_class_prior_of_a_known_mixture():
    r = np.random.default_rng(1)
    p, n = r.normal(1, 1, 40_000), r.normal(-3, 1, 10_000)
    bins = np.linspace(-8, 6, 201)
    got = quality.class_prior(np.histogram(p[:20_000], bins)[0], np.histogram(np.concatenate([p[20_000:], n[:5000]]), bins)[0])
    assert abs(got - 0.8) < 0.05


def test_features_of_a_text_don_t_depend_on_the_batch():
    texts = ["One two, two!\nThree.\nThree.", None, "", "A" * 5000, "é ü | |"]
    together = quality.features(pa.array(texts))
    alone = np.concatenate([quality.features(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(together, alone)


# Language model


def tokens(text):
    return [w.decode() for w in re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()).split()] + [None]


def test_base_score_and_held_out_gain(spark, sf):
    docs = {r.doc_id: tokens(r.text) for r in read(spark, sf, "documents").collect()}
    count = Counter(t for i, x in docs.items() if zlib.crc32(str(i).encode()) % 5 != 1 for t in x)
    n, v = sum(count.values()), len(count)
    got = op8_hmm(spark, sf).collect()
    for r in got:
        x = docs[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(x), sum(count[t] > 0 for t in x), n)
        assert math.isclose(r.base_score, sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in x), rel_tol=1e-9)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_likelihood_equals_the_sum_over_paths():
    r = np.random.default_rng(2)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    m = hmm.Model(np.zeros(0, np.int64), np.zeros(0, np.int64), norm(r.random(hmm.STATES), 0), norm(r.random((hmm.STATES, hmm.STATES)), 1), norm(r.random((hmm.CLASSES, hmm.STATES)), 0))
    sizes = [1, 3, 700, hmm.SEGMENT, hmm.SEGMENT + 1, 3 * hmm.SEGMENT + 17]
    offs = np.concatenate([[0], np.cumsum(sizes)])
    seq = r.integers(0, hmm.CLASSES, offs[-1]).astype(np.uint16)
    want = []
    for a, b in zip(offs[:-1], offs[1:], strict=True):
        v, log = m.start.copy(), 0.0
        for t in range(a, b):
            v = (v if t == a else v @ m.move) * m.emit[seq[t]]
            log, v = log + math.log(v.sum()), v / v.sum()
        want.append(log)
    assert np.allclose(hmm.likelihood(seq, offs, m), want)


def test_expected_counts_match_plain_forward_backward(monkeypatch):
    monkeypatch.setattr(hmm, "SEGMENT", 4)  # rows of 14 and 9 tokens go over borders
    r = np.random.default_rng(3)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    k = hmm.STATES
    m = hmm.Model(np.zeros(0, np.int64), np.zeros(0, np.int64), norm(r.random(k), 0), norm(r.random((k, k)), 1), norm(r.random((hmm.CLASSES, k)), 0))
    offs = np.array([0, 4, 5, 11, 25, 34])
    seq = r.integers(0, 50, 34).astype(np.uint16)
    emitted, moved, begun = np.zeros((hmm.CLASSES, k)), np.zeros((k, k)), np.zeros(k)
    hmm.expected(seq, offs, m, emitted, moved, begun)
    e2, m2, b2 = np.zeros_like(emitted), np.zeros_like(moved), np.zeros_like(begun)
    for a, b in zip(offs[:-1], offs[1:], strict=True):
        f = [m.start * m.emit[seq[a]]]
        for t in range(a + 1, b):
            f.append((f[-1] @ m.move) * m.emit[seq[t]])
        g = [np.ones(k)]
        for t in range(b - 1, a, -1):
            g.insert(0, m.move @ (m.emit[seq[t]] * g[0]))
        p = f[-1].sum()
        b2 += f[0] * g[0] / p
        for t in range(b - a):
            e2[seq[a + t]] += f[t] * g[t] / p
            if t:
                m2 += np.outer(f[t - 1], m.emit[seq[a + t]] * g[t]) * m.move / p
    assert np.allclose(emitted, e2) and np.allclose(moved, m2) and np.allclose(begun, b2)


def test_texts_of_usual_length_are_passed_once(monkeypatch):
    passed, whole = [], hmm.forward
    monkeypatch.setattr(hmm, "forward", lambda seq, first, size, *rest: passed.append(int(size.sum())) or whole(seq, first, size, *rest))
    r = np.random.default_rng(4)
    m = hmm.Model(np.zeros(0, np.int64), np.zeros(0, np.int64), np.full(hmm.STATES, 1 / hmm.STATES), np.full((hmm.STATES, hmm.STATES), 1 / hmm.STATES), r.random((hmm.CLASSES, hmm.STATES)))
    offs = np.array([0, 5000, 5010, 11_000])
    seq = r.integers(0, hmm.CLASSES, offs[-1]).astype(np.uint16)
    hmm.likelihood(seq, offs, m)
    assert sum(passed) == offs[-1]
    emitted, moved, begun = np.zeros((hmm.CLASSES, hmm.STATES)), np.zeros((hmm.STATES, hmm.STATES)), np.zeros(hmm.STATES)
    hmm.expected(seq, offs, m, emitted, moved, begun)
    assert sum(passed) == offs[-1]  # the pass of the expected counts is its own
    assert np.allclose(emitted.sum(axis=1), np.bincount(seq, minlength=hmm.CLASSES)) and np.isclose(moved.sum(), offs[-1] - 3) and np.isclose(begun.sum(), 3)


def test_very_unlikely_words_between_scalings(monkeypatch):
    monkeypatch.setattr(hmm, "GROUP", 40)
    k = hmm.STATES
    r = np.random.default_rng(5)
    start, move, emit = r.random(k), r.random((k, k)), r.random((hmm.CLASSES, k)) * 1e-30
    m = hmm.Model(np.zeros(0, np.int64), np.zeros(0, np.int64), start / start.sum(), move / move.sum(axis=1, keepdims=True), emit)
    for size in range(1, 3 * hmm.SCALED + 2):
        offs = np.array([0, size, 2 * size, 2 * size + 1])
        seq = r.integers(0, 50, offs[-1]).astype(np.uint16)
        emitted, moved, begun = np.zeros((hmm.CLASSES, k)), np.zeros((k, k)), np.zeros(k)
        hmm.expected(seq, offs, m, emitted, moved, begun)
        likely = hmm.Model(m.keys, m.number, m.start, m.move, emit * 1e30)
        e2, m2, b2 = np.zeros((hmm.CLASSES, k)), np.zeros((k, k)), np.zeros(k)
        hmm.expected(seq, offs, likely, e2, m2, b2)
        assert np.allclose(emitted, e2) and np.allclose(moved, m2) and np.allclose(begun, b2)
        assert np.allclose(hmm.likelihood(seq, offs, m), hmm.likelihood(seq, offs, likely) - 30 * math.log(10) * np.diff(offs))


def test_words_and_their_places_among_common_ones():
    texts = ["To be or not to BE", None, "", "be  x\ty x", "or"]
    (w,) = hmm.words_of(pa.array(texts))
    keys, rare, n = w.distinct()
    assert sorted(n.tolist()) == sorted(Counter(t for x in texts for t in tokens(x)[:-1]).values())
    assert rare.tolist() == [int(w.rare(np.flatnonzero(w.keys == k))[0]) for k in keys]
    assert all((w.keys == k).sum() == c for k, c in zip(keys, n, strict=True))
    # Words that share their upper bits, the least and the greatest one included.
    common = np.unique(np.concatenate([np.arange(-20, 20, 2), [-1 << 63, (1 << 63) - 1], np.arange(1 << 50, (1 << 50) + 9, 3)]))
    asked = np.concatenate([common, common[1:] - 1, common[:-1] + 1])
    for some in (common, common[1:-1], common[:1], common[:0]):
        m = hmm.Model(some, np.ones(len(some), np.int64), *[np.zeros(0)] * 3)
        at = {int(k): i for i, k in enumerate(some)}
        assert m.places(asked).tolist() == [at.get(int(k), -1) for k in asked]


def test_score_edges(spark, written):
    table = written([(None, None, "en", "s", 0, "x", 9), (3, "", "en", "s", 0, "x", 9), (3, "Word word", "en", "s", 0, "x", 9)], DOCS)
    got = hmm.score(table, F.lit(False)).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 3]
    assert all(r.score < 0 and r.base_score < 0 for r in got)
    held = hmm.score(table, F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in held)
    assert hmm.score(written([], DOCS), F.lit(False)).collect() == []
