import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import media, mixing, packing, topk, warc
from millrace.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, uid string, taken int"


def docs(texts, source="s"):
    return [(i, t, "en", source, 0, 0, "u", 1) for i, t in enumerate(texts)]


# Media


def filtered(image, kind):
    """Filters each row of an image by the format's definition."""
    out, rows, cols = image.astype(int), *image.shape
    for r in range(rows):
        for c in range(cols):
            a = int(image[r, c - 1]) if c else 0
            b = int(image[r - 1, c]) if r else 0
            d = int(image[r - 1, c - 1]) if r and c else 0
            p = a + b - d
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
            out[r, c] = (int(image[r, c]) - [0, a, b, (a + b) // 2, paeth][kind[r]]) % 256
    return np.hstack([np.array(kind)[:, None], out]).astype(np.uint8)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 6), st.integers(1, 9), st.data())
def test_unfilter_undoes_every_filter(rows, cols, data):
    image = np.array(data.draw(st.lists(st.integers(0, 255), min_size=rows * cols, max_size=rows * cols)), np.uint8).reshape(rows, cols)
    kind = data.draw(st.lists(st.integers(0, 4), min_size=rows, max_size=rows))
    assert (media.unfilter(filtered(image, kind)) == image).all()


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=400))
def test_png_round_trip(data):
    padded = media.payload(data)
    assert len(padded) % 64 == 0 and padded and padded.startswith(data)
    image = np.frombuffer(padded, np.uint8).reshape(-1, 64)
    assert media.decode_png(media.encode_png(image)).tobytes() == padded


def test_damaged_png_is_refused():
    good = media.encode_png(np.arange(128, dtype=np.uint8).reshape(2, 64))
    for at in (0, 20, 45, len(good) - 3):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            media.decode_png(bytes(bad))
    with pytest.raises(ValueError):
        media.decode_png(good[:-12])


def test_media_rows(spark, written):
    texts = [None, "", "a", "é" * 100, "x" * 64, "long " * 30_000, "a"]
    got = {r.doc_id: r for r in media.read_media(media.store_media(written(docs(texts), DOCS))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert got[0][1:] == got[1][1:] and got[2][1:] == got[6][1:] and got[2].feature != got[3].feature
    assert media.read_media(media.store_media(written([], DOCS))).collect() == []


# Packing


def check_packing(rows, want):
    """want: ids of each document, in any order of rows."""
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    padding = 0
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        at = 0
        for r in pieces:
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= packing.SIZE
        padding += 0 if at & (at - 1) == 0 else packing.SIZE - at
    for doc, ids in want.items():
        mine = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.start)
        assert sum(r.length for r in mine) == len(ids) == mine[0].doc_tokens
        at = 0
        for r in mine:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
    return padding


def test_packing_is_exact(spark, written):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    texts = [None, "", "One two.", "it's don't 'S |a| x|y", "<|endoftext|> É́ ñ ﬁ İ", "w1x2 ,,, " * 5000, *[f"text {i} " * (i % 97 + 1) for i in range(300)]]
    table = written(docs(texts), DOCS).repartition(7)
    path = packing.pack(table, tokenizer_path(), windows=4)
    rows = path.collect()
    want = {i: [*plain.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    padding = check_packing(rows, want)
    assert padding <= 0.01 * sum(map(len, want.values()))
    assert packing.pack(written([], DOCS), tokenizer_path()).collect() == []


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 9000), max_size=60), st.integers(1, 6))
def test_packer_loses_nothing(sizes, windows):
    p = packing.Packer(windows)
    for i, n in enumerate(sizes):
        p.add(i, np.arange(n, dtype=np.uint32))
        assert len(p.open) <= windows
    left = p.merge()
    pieces = [x for w in [*p.done, *packing.halve(left)] for x in w]
    for i, n in enumerate(sizes):
        mine = sorted((x for x in pieces if x[0] == i), key=lambda x: x[1])
        assert np.array_equal(np.concatenate([x[2] for x in mine]), np.arange(n))
    assert all(packing.SIZE - sum(len(x[2]) for x in w) < p.least_cut for w in p.done)


# Mixing


def test_mix_takes_exact_budgets(spark, written):
    rows = [(i, "w " * (i % 7), "en", ["a", "b", "c", None][i % 4] if i >= 100 else "a", 0, 0, "u", 1) for i in range(400)]
    got = mixing.mix_sources(written(rows, DOCS), buckets=8).collect()
    source = {r[0]: r[3] for r in rows}
    total = sum(r.size for r in got)
    size = {s: sum(r.size for r in got if source[r.doc_id] == s) for s in ("a", "b", "c", None)}
    level, weight = 0.0, {"a": 1, "b": 2, "c": 3, None: 1}
    target, open_ = {}, set(weight)
    while open_:  # what is over is shared again until nobody is above
        share = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * share > 3 * size[s]}
        if not over:
            target |= {s: weight[s] * share for s in open_}
            break
        target |= {s: 3.0 * size[s] for s in over}
        open_ -= over
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 3 * r.size
    for s in size:
        assert sum(r.taken for r in got if source[r.doc_id] == s) == int(target[s] + 1e-9)
    again = mixing.mix_sources(written(rows[::-1], DOCS), buckets=8).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert level == 0.0


def test_mix_edges(spark, written):
    assert mixing.mix_sources(written([], DOCS)).collect() == []
    got = mixing.mix_sources(written(docs([None, "", "  "]), DOCS)).collect()
    assert [(r.size, r.taken, r.target) for r in got] == [(0, 0, 0.0)] * 3
    same = written([(1, "a b c", "en", "x", 0, 0, "u", 1)] * 5 + [(2, "d e", "en", "y", 0, 0, "u", 1)], DOCS)
    assert sum(r.taken for r in mixing.mix_sources(same).collect()) == 17


def test_take_mix_repeats_and_cuts(spark, written):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 5 + 1)), "en", f"s{i % 3}" if i > 60 else "s0", 0, 0, "u", 1) for i in range(120)]
    table = written(rows, DOCS)
    taken = {r.doc_id: r.taken for r in mixing.mix_sources(table).collect()}
    out = mixing.take_mix(table)
    assert out.schema == table.schema
    words = {}
    for r in out.collect():
        assert r.n_chars == len(r.text)
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == {i: n for i, n in taken.items() if n}


# Top-k


def brute_top(rows, k=10):
    ok = [(i, [int(np.floor(np.float64(x) * 1024)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % 100 == 0:
            scores = sorted((-max(min(sum(x * y for x, y in zip(a, b, strict=True)), 2**63 - 1), -(2**63)), i) for i, b in ok if i != q and len(a) == len(b))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_top_k_matches_brute_force(spark, written):
    r = np.random.default_rng(4)
    rows = [(i, r.normal(0, 0.2, 64).astype(np.float32).tolist()) for i in range(0, 700)]
    rows += [(1000 + i, rows[i % 3][1]) for i in range(40)] + [(2000, None), (None, rows[0][1]), (2001, [1.0, None] * 32), (2002, [float("nan")] * 64), (2100, [0.5, 0.25]), (2101, [0.5, 0.5]), (2200, []), (2201, [])]
    table = written(rows, "vec_id long, embedding array<float>")
    for group in (16384, 128):
        got = sorted(map(tuple, topk.top_k(table, group_rows=group, query_rows=4).collect()))
        assert got == brute_top(rows)
    huge = [(0, [3e38, 1.0]), (1, [3e38, 2.0]), (2, [-3e38, 0.0]), (3, [1.0, 1.0])]
    assert sorted(map(tuple, topk.top_k(written(huge, "vec_id long, embedding array<float>")).collect())) == brute_top(huge)
    assert topk.top_k(written([], "vec_id long, embedding array<float>")).collect() == []


def test_segment_statistics_bound_the_inner_product():
    r = np.random.default_rng(5)
    a, b = r.integers(-300, 300, (2, 50, 64)).astype(float)
    for s in (1, 4, 16, 64):
        assert (topk.segment_stats(a, s) @ topk.segment_stats(b, s).T >= a @ b.T - 1e-6).all()


# WARC


@given(st.binary(max_size=300), st.integers(1, 50))
def test_chunked_framing_round_trip(data, size):
    assert warc.dechunked(warc.chunked(data, size)) == data


def test_damaged_framing_and_records_are_refused():
    for bad in (b"", b"5\r\nabc", b"zz\r\n", b"3\r\nabcd\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.dechunked(bad)
    good = warc.record("response", "urn:x", b"hello") + warc.END
    assert [b for _, b in warc.records(good * 2)] == [b"hello"] * 2
    for bad in (good[:-1], good[1:], good.replace(b"Length: 5", b"Length: 4")):
        with pytest.raises(ValueError):
            list(warc.records(bad))


PAGES = "page_id long, url string, html string, uid long, type string"


def brute_warc(rows):
    body = [(i, (h or "").encode()) for i, _, h, *_ in rows]
    top = {}
    for i, b in body:
        if len(b) >= 1000:
            top[b] = max(top.get(b, -1), -1 if i is None else i)
    return [(i, len(b), hashlib.sha1(b).hexdigest(), *(("revisit", top[b]) if len(b) >= 1000 and top[b] != i else ("response", None))) for i, b in body]


def test_warc_rows(spark, written):
    big = "é" * 40_000
    rows = [(i, f"http://x/{i}", h, 1, "t") for i, h in enumerate(["", None, "small", "small", "y" * 999, "y" * 999, "z" * 1000, "z" * 1000, "z" * 1000, big, big, "\r\n\r\n" * 300, "0\r\n\r\n" * 300])]
    rows += [(None, None, "only", 1, "t"), (50, "http://x/\r\nWARC-Type: bad", "n" * 5000, 1, "t")]
    table = written(rows, PAGES).repartition(5)
    for segment in (500, 32768):
        got = [tuple(r) for r in warc.archive_digests(table, segment=segment, per_file=3).collect()]
        key = lambda r: (r[0] is None, r[0])
        assert sorted(got, key=key) == sorted(brute_warc(rows), key=key)
    assert warc.archive_digests(written([], PAGES)).collect() == []


def test_repeated_pages_have_one_response(spark, written):
    got = warc.archive_digests(written([(7, "u", "r" * 2000, 1, "t")] * 4, PAGES)).collect()
    assert sorted(r.record_type for r in got) == ["response", "revisit", "revisit", "revisit"]
    assert {r.refers_to for r in got} == {None, 7}
