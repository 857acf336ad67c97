import random

import numpy as np
import pytest

from millrace.llm import setsketch
from millrace.llm.text import U

DOCS = "doc_id long, text string, n int, key string, bucket long, regs string, uid string, node int, component string"


def docs(texts):
    return [(i, t, 0, "k", 1, "r", "u", 1, "c") for i, t in enumerate(texts)]


def prose(n, seed, words=10**6):
    r = random.Random(seed)
    return [f"w{r.randrange(words)}" for _ in range(n)]


def edited(base, share, seed):
    r = random.Random(seed)
    out = list(base)
    for i in r.sample(range(len(out)), int(len(out) * share)):
        out[i] = f"e{seed}x{i}"
    return " ".join(out)


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in lower.replace("\t", " ").replace("\n", " ").split(" ") if w]


def brute(texts):
    sets, n = [], len(texts)
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if w else set())
    label = list(range(n))

    def find(i):
        while label[i] != i:
            i = label[i] = label[label[i]]
        return i

    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return [(i, len(sets[i]), find(i), find(i) == i) for i in range(n)]


def mixed_texts():
    base, other = prose(200, 1), prose(300, 2)
    texts = [edited(base, s, 10 + i) for i in range(150) for s in (0.02,)]
    texts += [edited(base, 0.08, 500 + i) for i in range(150)]  # near the threshold to each other and to the first ones
    texts += [" ".join(other)] * 40 + [edited(other, 0.12, 900 + i) for i in range(60)]
    chain, at = [], prose(120, 3)
    for i in range(25):  # each is linked with the one before, the ends are far apart
        at = at[6:] + prose(6, 4000 + i)
        chain.append(" ".join(at))
    texts += chain
    texts += [" ".join(prose(30, 99) + prose(30, 7000 + i)) for i in range(120)]  # a passage in common, no links
    texts += [" ".join(prose(k, 8000 + k)) for k in range(1, 12)] * 2
    texts += [None, "", "  \t\n", "one", "One", "one two", "ONE TWO", "one two three", "É a", "é a", " ".join(prose(60_000, 77)), " ".join(prose(60_000, 77)) + " end"]
    random.Random(5).shuffle(texts)
    return texts


@pytest.mark.parametrize("block", [8, 512])
def test_against_brute_force(spark, written, block):
    texts = mixed_texts()
    got = setsketch.near_duplicates(written(docs(texts), DOCS), block=block).collect()
    assert sorted(map(tuple, got)) == brute(texts)


def test_edges(spark, written):
    rows = [(None, "a b c d e"), (None, "a b c d e"), (9, "A b c d e"), (4, "a b c d e"), (4, "a b c d e"), (None, None), (3, None), (3, ""), (None, "z z")]
    got = setsketch.near_duplicates(written([(i, t, 0, "", 1, "", "", 1, "") for i, t in rows], DOCS)).collect()
    want = [(None, 0, None, True), (None, 1, None, True), (3, 0, 3, True), (3, 0, 3, True), (4, 4, 4, True), (4, 4, 4, True), (9, 4, 4, False), (None, 4, 4, False), (None, 4, 4, False)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert setsketch.near_duplicates(written([], DOCS)).collect() == []


def sketch(hashes, m=4000):
    return setsketch.registers(np.sort(hashes), np.zeros(1, np.int64), m)


def test_registers_merge_count_and_estimate():
    r = np.random.default_rng(1)
    for n, k, both in ((4000, 4000, 3556), (1000, 800, 800), (50, 60, 40), (3000, 3000, 0)):
        h = r.integers(0, 2**63, n + k - both, dtype=np.int64).astype(U) * U(2) + U(1)
        a, b = sketch(h[:n]), sketch(h[n - both :])
        assert (setsketch.merged(a, b) == sketch(h)).all()
        assert abs(setsketch.cardinality(a)[0] / n - 1) < 0.1
        truth = both / (n + k - both)
        more, equal = (a > b).sum(axis=1), (a == b).sum(axis=1)
        fits = [t for t in np.arange(0.01, min(n / k, k / n) - 0.005, 0.01) if setsketch.slope(more, 4000 - more - equal, equal, np.array([n]), np.array([k]), t)[0] >= 0]
        assert abs(max(fits, default=0) - truth) < 0.04


def test_a_pair_at_the_threshold_shares_a_band():
    bands = setsketch.bands_for(0.9999, 0.8)
    m, r, met, tries = bands * setsketch.ROWS, np.random.default_rng(2), 0, 400
    for _ in range(tries):
        h = r.integers(0, 2**63, 500, dtype=np.int64).astype(U) * U(2) + U(1)
        a, b = (setsketch.registers(np.sort(x), np.zeros(1, np.int64), m).reshape(bands, -1) for x in (h[:450], h[50:]))
        met += bool((a == b).all(axis=1).any())
    assert met == tries
