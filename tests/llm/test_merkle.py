import random
import zlib
from hashlib import sha256

from millrace.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, p int, digest string, uid string, path string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    fields = (r[0], r[3], r[2], r[4], text)
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])


def lower(text):
    return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def way(tree, i):
    out = []
    for nodes in tree[:-1]:
        a = i - i % 16
        out.append((nodes[a:i], nodes[i + 1 : a + 16]))
        i //= 16
    return out


def brute(rows):
    by = {}
    for r in rows:
        changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        by.setdefault(r[3], []).append((r[0], leaf(r, r[1]), leaf(r, lower(r[1]) if changed else r[1])))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = levels([x[1] for x in by[s]])
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (doc_id, node, given) in enumerate(by[s]):
            path = way(trees[s], i) + way(top, k)
            at = given
            for left, right in path:
                at = h(*left, at, *right)
            out.append((doc_id, node, trees[s][-1][0], top[-1][0], h(*[d for left, right in path for d in left + right]), at, at == top[-1][0]))
    return sorted(out, key=str)


def proved(table):
    rows = merkle.proofs(merkle.build(table, merkle.tampered())).drop("path").collect()
    return sorted(map(tuple, rows), key=str)


def row(i, text="Some Text", source="s", lang="en"):
    return (i, text, lang, source, len(text or ""), "t", 1, "d", "u", "q")


def test_manifest_against_brute_force(spark, written):
    r = random.Random(3)
    rows = [row(i, f"Text {i} É") for i in range(4500)]
    rows += [row(10_000 + i, f"t{i}", f"q{i}") for i in range(4200)]
    rows += [row(20_000 + i, None if i % 7 == 0 else "" if i % 5 == 0 else "Ab" * r.randrange(9), r.choice([None, "", "é", "z", "A"]), r.choice([None, "de"])) for i in range(300)]
    rows += [row(30_000, "x" * 300_000, "long")]
    r.shuffle(rows)
    got = proved(written(rows, DOCS))
    assert got == brute(rows)
    assert {x[-1] for x in got} == {True, False}


def test_ties_and_repeated_rows(spark, written):
    rows = [row(5)] * 40 + [row(5, "Other")] * 3 + [row(None)] * 20 + [row(None, None, None, None)] * 2
    assert proved(written(rows, DOCS)) == brute(rows)


def test_one_row_and_none(spark, written):
    rows = [row(1)]
    got = merkle.proofs(merkle.build(written(rows, DOCS))).collect()
    assert [(x.leaf, x.subroot, x.root, x.proof_sha256, x.verified, x.path) for x in got] == [(leaf(rows[0], "Some Text"),) * 3 + (h(), True, [])]
    empty = merkle.build(written([], DOCS), merkle.tampered())
    assert empty.root is None and merkle.proofs(empty).collect() == []


def test_paths_are_proofs(spark, written):
    rows = [row(i, f"Text {i}", f"s{i % 3}") for i in range(100)]
    for x in merkle.proofs(merkle.build(written(rows, DOCS))).collect():
        assert merkle.fold(x.leaf, [(s.place, s.others) for s in x.path]) == x.root
