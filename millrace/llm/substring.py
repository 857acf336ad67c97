"""Substring dedup by compact windows over token min-hashes.

A text is the sequence of its runs of five words. Under one hash function, all subsequences whose
minimum is the same element form a compact window: the element and how far it stays the minimum to
the left and right, as in a Cartesian tree. The windows of all functions are joined by their
intervals: where they have `seed` runs or more in common, those subsequences share one signature,
the minima of every function. Rows with equal signatures are grouped; pairs that a group names are
verified on the texts' own runs, around the places where they meet.

Passages at the threshold have a stretch of `seed` equal runs (seed_runs), and over such a stretch
all functions agree. So two passages that differ by insertions, deletions, changes or swaps of words
share a signature for certain. Each window is verified with the first of its group. Where a window
of a group lies in no verified passage after that, it is verified with all others of the group if
that is small, else with the first ones of the parts that also share minima of the runs before or
after; and what is equal word for word around such groups is found (exact), all of it. Windows of
very common signatures are dealt by salts, whose firsts are compared in turn, or by their parts.

Texts that are equal as a whole are handled once. Rows are numbered in the order of doc_id and
content: the results are a function of the rows, not of how they lie in files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import identified, stage
from millrace.llm.ngram_join import whole_buckets
from millrace.llm.text import U, mix, shingle_hashes, slices, string_bytes, text_words, word_spans
from millrace.storage import Scratch

K = 5
FUNCTIONS = 2
SMALL = 16
#: Groups of up to SMALL windows are compared pair by pair.
#: A signature is common if more windows have it than this, and than one in COMMON_SHARE of all.
COMMON, COMMON_SHARE = 4096, 1_000_000
#: Runs of a text that are worked on at once, and parts of regions that are verified at once.
PIECE, REGION = 1 << 25, 1 << 15
REQUESTS = 1024
#: Elements of pairs that are compared at once, and of their diagonals.
ELEMENTS, CELLS = 1 << 17, 1 << 16
POSITION = 26
#: Signatures that a task packs at once, and bits of a signature that are its bucket, at least.
HELD, BUCKETS = 1 << 19, 11
#: Parts of a group: the sides (before 0 and 1, after 2 and 3) whose minima its windows share.
PARTS = ((0,), (1,), (2,), (3,), (0, 1), (2, 3), (0, 2), (1, 3))


def seed_runs(t: int, similarity: float, k: int = K) -> int:
    """Runs of the longest equal stretch that two passages of t runs or more at the similarity have at least.

    A changed, inserted, deleted or moved word takes k - 1 runs or more from one passage and adds as
    many to the other, k in one of the two. With e of them in n runs the similarity is at most
    (n - (k-1)e) / (n + ke), and what is left of n - (k-1)e runs lies in e + 1 stretches.
    """
    least = t
    for n in range(t, 64 * t):
        e = 0
        while n - (k - 1) * (e + 1) >= similarity * (n + k * (e + 1)):
            e += 1
        least = min(least, -(-(n - (k - 1) * e) // (e + 1)))
    return max(least, 1)


def ranks(h: np.ndarray, function: int) -> np.ndarray:
    """The elements' order under a hash function, with their positions in the low bits."""
    return mix(h, 100 + function) & ~U((1 << POSITION) - 1) | np.arange(len(h), dtype=U)


def lowest(h: np.ndarray, t: int, function: int) -> np.ndarray:
    """Position of the minimum of each window of t elements."""
    low, width = ranks(h, function), 1
    while width * 2 <= t:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < t:
        low = np.minimum(low[: len(h) - t + 1], low[t - width :])
    return (low & U((1 << POSITION) - 1)).astype(np.int64)


def window_sums(h: np.ndarray, t: int) -> np.ndarray:
    """A hash of each window of t elements in their order."""
    out, done = np.zeros(len(h) - t + 1, U), 0
    power, width = h, 1
    while width <= t:
        if t & width:
            out = mix(out) + power[done : done + len(out)]
            done += width
        power = mix(power[: len(power) - width]) + power[width:] if width * 2 <= t else power
        width *= 2
    return out


def compact_windows(h: np.ndarray, at: np.ndarray, t: int, function: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Position, reach to the left and to the right of every compact window of at least t elements, and its row; h: elements of rows at[i] to at[i+1]. Not whole: reaches of t - 1 at most, which are those of the windows of t elements with that minimum."""
    none = np.zeros(0, np.int64)
    if len(h) < t:
        return none, none, none, none
    v = ranks(h, function)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = row[: len(h) - t + 1] == row[t - 1 :]
    c, start = lowest(h, t, function)[inside], np.flatnonzero(inside)
    if not len(c):
        return none, none, none, none
    new = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
    c = c[new]
    if not whole:
        return c, c - start[new], start[np.append(new[1:], len(start)) - 1] + t - 1 - c, row[c]
    w, r, m = v[c], row[c], len(c)

    def nearest(w: np.ndarray, r: np.ndarray) -> np.ndarray:
        """The nearest earlier position with a smaller value in the same row, or -1."""
        p = np.arange(m) - 1
        live = np.arange(m)
        while len(live):
            q = p[live]
            live, q = live[q >= 0], q[q >= 0]
            out = r[q] != r[live]
            p[live[out]] = -1
            go = ~out & (w[q] > w[live])
            live, q = live[go], q[go]
            p[live] = p[q]
        return p

    before, after = nearest(w, r), m - 1 - nearest(w[::-1], r[::-1])[::-1]
    left = np.where(before >= 0, c[before] + 1, at[r])
    right = np.where(after < m, c[np.minimum(after, m - 1)] - 1, at[r + 1] - 1)
    return c, c - left, right - c, r


def pieces(h: np.ndarray, at: np.ndarray, t: int, size: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """The elements in pieces of a bounded size: h, at, the row and the place in it where the piece starts. Only a row that is longer by itself is taken apart, so that each window of t elements is whole in a piece."""
    if len(h) < 2 * size:
        yield h, at, 0, 0
        return
    for r, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        for x in range(a, max(b - t + 1, a + 1), size):
            part = h[x : min(x + size + t - 1, b)]
            yield part, np.array([0, len(part)]), r, x - a


def signatures(h: np.ndarray, at: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key, place of the first function's minimum and row of each part of a text over which all functions' compact windows have t elements or more in common."""
    found, starts, some = [], [], np.zeros(len(h), bool)
    for f in range(FUNCTIONS):
        c, left, _, _ = compact_windows(h, at, t, f, whole=False)
        if not len(c):
            return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        starts.append(c - left)  # of the first window of t elements whose minimum is c
        found.append(c)
        some[starts[-1]] = True
    first = np.flatnonzero(some)
    c = [x[np.searchsorted(s, first, side="right") - 1] for x, s in zip(found, starts, strict=True)]
    key = np.zeros(len(first), U)
    for f, x in enumerate(c):
        key = mix(key ^ h[x], 200 + f)
    return key, c[0], np.searchsorted(at, c[0], side="right") - 1


def side_minima(h: np.ndarray, at: np.ndarray, c: np.ndarray, row: np.ndarray, width: int) -> np.ndarray:
    """For each place c four columns of 16 bits: the least elements, under two functions, of the `width` ones before it and after it; 0 where the row has fewer."""
    out = np.zeros((len(c), 4), np.int64)
    for f in range(2):
        v = mix(h, 300 + f)
        low = v
        done = 1
        while done * 2 <= width:
            low = np.minimum(low[:-done], low[done:])
            done *= 2
        low = np.minimum(low[: len(h) - width + 1], low[width - done : len(h) - done + 1]) if len(h) >= width else v[:0]
        for side, first in ((0, c - width), (2, c + 1)):
            ok = (first >= at[row]) & (first + width <= at[row + 1])
            if len(low):
                out[:, side + f] = np.where(ok, (low[np.where(ok, first, 0)] >> U(20) & U(0xFFFF)).astype(np.int64) | 1, 0)
    return out


def part_keys(key: np.ndarray, sides: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of PARTS: the keys of the windows' parts, and which windows have it."""
    for k, part in enumerate(PARTS):
        out = mix(key, 500 + k)
        for x in part:
            out = mix(out ^ sides[:, x].astype(U), 520)
        yield out, (sides[:, part] > 0).all(axis=1)


def packed(sides: np.ndarray) -> np.ndarray:
    return sides[:, 0] | sides[:, 1] << 16 | sides[:, 2] << 32 | sides[:, 3] << 48


def unpacked(sides: np.ndarray) -> np.ndarray:
    return np.stack([sides >> s & 0xFFFF for s in (0, 16, 32, 48)], axis=1)


def text_signatures(batch: pa.RecordBatch, seed: int, with_sides: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """key, cid, place, sides and a hash of the text of the signatures of a batch (cid, t), slice by slice."""
    for i, j, words, offs in text_words(batch["t"]):
        h, at = shingle_hashes(words, offs, K)
        cid = batch["cid"].to_numpy()[i:j]
        for part, own, r, x in pieces(h, at, seed):
            key, c, row = signatures(part, own, seed)
            if len(key):
                total = np.concatenate([np.zeros(1, U), np.cumsum(part, dtype=U)])
                yield key, cid[row + r], c - own[row] + x, side_minima(part, own, c, row, seed) if with_sides else np.zeros((len(c), 4), np.int64), (total[own[1:]] - total[own[:-1]])[row]


def held(parts: Iterator[list[np.ndarray]], least: int) -> Iterator[list[np.ndarray]]:
    """Columns of `least` rows or a few more each, the last ones of what is left, put together from shorter ones."""
    kept, rows = [], 0
    for part in parts:
        kept.append(part)
        rows += len(part[0])
        if rows >= least:
            yield [np.concatenate(v) for v in zip(*kept, strict=True)]
            kept, rows = [], 0
    if rows:
        yield [np.concatenate(v) for v in zip(*kept, strict=True)]


def bucket_rows(bits: int, key: np.ndarray, *more: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket of the keys (their first bits) with its keys in order and what goes with them, packed column by column."""
    order = np.argsort(key)
    bucket = (key[order] >> U(64 - bits)).astype(np.int64)
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    n = np.diff(np.append(starts, len(key)))
    columns = [pa.array(bucket[starts])]
    for v in (key, *more):
        at = np.append(starts, len(key)) * v.itemsize
        columns.append(pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(v[order])]))
    return pa.RecordBatch.from_arrays(columns, ["bucket", "key", *(f"v{k}" for k in range(len(more)))])


def unpacked_rows(table: pa.Table, kinds: dict[str, type]) -> list[np.ndarray]:
    """Columns of the rows of bucket_rows, one after the other."""
    return [string_bytes(table[c].combine_chunks())[0].view(kind) for c, kind in kinds.items()]


def common_signatures(docs: DataFrame, seed: int) -> tuple[dict[int, int], int]:
    """Signatures that are common, with their exact numbers: COMMON_SHARE keys at most; and the number of all signatures. Counted over all rows, so it is no matter how they lie in tasks."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key,) in held(([key] for batch in batches for key, *_ in text_signatures(batch, seed, False)), HELD):
            yield bucket_rows(BUCKETS, key)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for t in whole_buckets(batches):
            (key,) = unpacked_rows(t, {"key": U})
            key = np.sort(key)
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            n = np.diff(np.append(starts, len(key)))
            total += len(key)
            some = n > COMMON
            yield pa.RecordBatch.from_arrays([pa.array(key[starts[some]].view(np.int64)), pa.array(n[some])], ["key", "n"])
        # Key 0 has no windows of its own that matter: its rows are the numbers of all.
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([total], pa.int64())], ["key", "n"])

    packed_keys = docs.mapInArrow(each, "bucket long, key binary").repartition("bucket").sortWithinPartitions("bucket")
    counts = stage(packed_keys.mapInArrow(added, "key long, n long"), "common")
    total = counts.where("key = 0").agg(F.sum("n")).first()[0] or 0
    return {r["key"]: r["n"] for r in counts.where(f"key <> 0 and n > {max(COMMON, total // COMMON_SHARE)}").collect()}, total


#: The columns that windows() packs.
WINDOW = {"key": U, "v0": np.int64, "v1": np.int32, "v2": np.int64, "v3": np.int64}


def windows(docs: DataFrame, seed: int, common: dict[int, int], total: int = 0) -> DataFrame:
    """The signatures of every text (cid, t), packed by buckets of their keys: key, cid, pos, sides and base. A common one is dealt by a salt of the text's content and has its key as base, others have 0. total: how many there are, for the number of buckets."""
    at = np.array(sorted(common), np.int64)
    limit = max(COMMON, min(common.values(), default=0))
    bits = max(BUCKETS, (total >> 18).bit_length())
    shared = docs.sparkSession.sparkContext.broadcast((at, np.array([-(-common[k] // limit) for k in at.tolist()], np.int64)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        hot, salts = shared.value
        for batch in batches:
            for key, cid, pos, sides, whole in text_signatures(batch, seed):
                dealt, base = key, np.zeros(len(key), np.int64)
                if len(hot):
                    x = np.minimum(np.searchsorted(hot, key.view(np.int64)), len(hot) - 1)
                    is_common = hot[x] == key.view(np.int64)
                    salted = mix(key ^ mix(mix(whole, 600) % salts[x].astype(U), 601), 602)
                    dealt, base = np.where(is_common, salted, key), np.where(is_common, key.view(np.int64), 0)
                yield [dealt, cid, pos.astype(np.int32), packed(sides), base]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in held(each(batches), HELD):
            yield bucket_rows(bits, *columns)

    return docs.mapInArrow(run, "bucket long, key binary, v0 binary, v1 binary, v2 binary, v3 binary")


def meetings(found: DataFrame) -> DataFrame:
    """kind, cid, pos, other, other_pos, sides: windows and the first of their group (kind 0); windows of groups of three or more (1; other is the signature, other_pos 1 for more than SMALL windows, 2 for a common one); and the first window of each salt of a common signature (2, with that as other)."""
    fields = ["kind", "cid", "pos", "other", "other_pos", "sides"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_buckets(batches):
            key, cid, pos, sides, base = unpacked_rows(t, WINDOW)
            order = np.argsort(key)
            same = key[order[1:]] == key[order[:-1]]
            # A window that is alone with its key meets none.
            x = order[np.append(same, False) | np.append(False, same) | (base[order] != 0)]
            # Groups are in order of cid, so the first is the same however rows lie.
            x = x[np.lexsort((pos[x], cid[x], key[x]))]
            key, cid, pos, sides, base = key[x].view(np.int64), cid[x], pos[x].astype(np.int64), sides[x], base[x]
            if not len(key):
                continue
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            each = np.diff(np.append(starts, len(key)))
            size, first = np.repeat(each, each), np.repeat(starts, each)
            a = np.flatnonzero(cid != cid[first])
            b = first[a]
            crowd = np.flatnonzero((size > 2) | (base != 0))
            heads = starts[base[starts] != 0]
            how = np.where(base != 0, 2, size > SMALL)
            zero = np.zeros(max(len(a), len(heads)), np.int64)
            for k, cols in enumerate(((cid[a], pos[a], cid[b], pos[b], zero[: len(a)]), (cid[crowd], pos[crowd], np.where(base != 0, base, key)[crowd], how[crowd], sides[crowd]), (cid[heads], pos[heads], base[heads], zero[: len(heads)], zero[: len(heads)]))):
                if len(cols[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), k, np.int32)), *map(pa.array, cols)], fields)

    return found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "kind int, cid long, pos long, other long, other_pos long, sides long")


def edges(met: DataFrame) -> DataFrame:
    """cid, pos, other, other_pos of the windows to verify: those of `meetings`, and of the salts of a signature with the first of them."""
    heads = met.where("kind = 2").select("cid", "pos", F.col("other").alias("base"))
    first = heads.groupBy("base").agg(F.min(F.struct("cid", "pos")).alias("m"))
    more = heads.join(first, "base").where("cid > m.cid").select("cid", "pos", F.col("m.cid").alias("other"), F.col("m.pos").alias("other_pos"))
    return met.where("kind = 0").select("cid", "pos", "other", "other_pos").unionByName(more)


def unsettled(met: DataFrame, near: DataFrame) -> DataFrame:
    """key, cid, pos, how, sides and alone of the windows of groups of which at least one window lies in no verified passage (alone): there, windows may have a partner that they weren't compared with."""
    crowd = met.where("kind = 1").select(F.col("other").alias("key"), "cid", "pos", F.col("other_pos").alias("how"), "sides")
    spans = near.select("cid", "start", "end").unionByName(near.select(F.col("other").alias("cid"), F.col("other_start").alias("start"), F.col("other_end").alias("end"))).distinct()
    known = islands(spans.withColumn("other", F.col("cid")).withColumn("other_start", F.col("start"))).select(F.col("cid").alias("of"), "start", "end")
    inside = (F.col("cid") == F.col("of")) & (F.col("start") <= F.col("pos")) & (F.col("pos") + K <= F.col("end"))
    marked = stage(crowd.join(known, inside, "left").select("key", "cid", "pos", "how", "sides", F.col("of").isNull().alias("alone")), "marked")
    return marked.join(marked.where("alone").select("key").distinct(), "key", "left_semi")


def second_meetings(rest: DataFrame) -> DataFrame:
    """cid, pos, other, other_pos: pairs of windows to verify in unsettled groups, one of each pair alone. In small groups all pairs; in large ones a window and the first one of each of its parts. Common signatures are dealt by their parts."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, cid, pos, how, sides, alone = (batch[c].to_numpy(zero_copy_only=False) for c in ("key", "cid", "pos", "how", "sides", "alone"))
            one = how < 2
            parts = [(key[one], one), *((p.view(np.int64)[ok], np.flatnonzero(~one)[ok]) for p, ok in part_keys(key[~one].view(U), unpacked(sides[~one])))] if not one.all() else [(key, one)]
            for p, at in parts:
                if len(p):
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (p, cid[at], pos[at], how[at], sides[at], alone[at])], ["key", "cid", "pos", "how", "sides", "alone"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_buckets(batches, bucket="key"):
            key, cid, pos, how, sides, alone = (t[c].to_numpy() for c in ("key", "cid", "pos", "how", "sides", "alone"))
            n = len(key)
            out: list[tuple[np.ndarray, np.ndarray]] = []
            at = np.flatnonzero(how == 0)
            for lag in range(1, SMALL):
                at = at[at + lag < n]
                at = at[key[at] == key[at + lag]]
                out.append((at + lag, at))
            deep = np.flatnonzero(how == 1)
            groups = [(key[how == 2], np.flatnonzero(how == 2))]
            if len(deep):
                groups += [(p[ok], deep[ok]) for p, ok in part_keys(key[deep].view(U), unpacked(sides[deep]))]
            for p, x in groups:
                order = np.argsort(p, kind="stable")
                x, p = x[order], p[order]
                new = np.append(True, p[1:] != p[:-1]) if len(p) else np.zeros(0, bool)
                out.append((x, x[np.flatnonzero(new)][np.cumsum(new) - 1]))
            a, b = (np.concatenate(v) for v in zip(*out, strict=True))
            go = (cid[a] != cid[b]) & (alone[a] | alone[b])
            a, b = np.divmod(np.unique(a[go] * n + b[go]), n)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (cid[a], pos[a], cid[b], pos[b])], ["cid", "pos", "other", "other_pos"])

    dealt = rest.mapInArrow(deal, rest.schema).repartition("key").sortWithinPartitions("key", "cid", "pos")
    return dealt.mapInArrow(run, "cid long, pos long, other long, other_pos long")


def regions(found: DataFrame, t: int) -> DataFrame:
    """cid, a, b, other, c, d: parts of two texts (in runs) where windows lie near each other, at about one diagonal, with what may belong to their passage on both sides."""
    margin = t + t // 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_buckets(batches):
            cid, other, x, y = (table[c].to_numpy() for c in ("cid", "other", "pos", "other_pos"))
            parts = []
            for shift in (0, t):  # in one of the two, diagonals up to t apart are together
                band = (x - y + shift) // (2 * t)
                order = np.lexsort((x, band, other, cid))
                u, o, g, p, q = (v[order] for v in (cid, other, band, x, y))
                new = np.ones(len(u), bool)
                new[1:] = (u[1:] != u[:-1]) | (o[1:] != o[:-1]) | (g[1:] != g[:-1]) | (p[1:] - p[:-1] > t)
                s = np.flatnonzero(new)
                lo, hi = np.minimum.reduceat(p, s) - margin, np.maximum.reduceat(p, s) + margin
                near, far = np.minimum.reduceat(p - q, s), np.maximum.reduceat(p - q, s)
                count = -(-(hi - lo) // REGION)  # a long region in parts that overlap by more than a passage
                k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                lo, hi, near, far, u, o = (np.repeat(v, count) for v in (lo, hi, near, far, u[s], o[s]))
                lo = lo + k * REGION
                hi = np.minimum(hi, lo + REGION + 2 * margin)
                parts.append(np.stack([u, o, np.maximum(lo, 0), np.maximum(lo - far, 0), hi, np.maximum(hi - near, 0)]))
            u, o, a, c, b, d = np.unique(np.concatenate(parts, axis=1), axis=1)
            # Regions that start at the same places are one, as long as the longest on each side: those four name it.
            s = np.flatnonzero(np.append(True, (u[1:] != u[:-1]) | (o[1:] != o[:-1]) | (a[1:] != a[:-1]) | (c[1:] != c[:-1])))
            whole = (u[s], a[s], np.maximum.reduceat(b, s), o[s], c[s], np.maximum.reduceat(d, s))
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in whole], ["cid", "a", "b", "other", "c", "d"])

    dealt = found.withColumn("bucket", F.xxhash64("cid", "other")).repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "cid long, a long, b long, other long, c long, d long")


def diagonals(matches: Iterator[tuple[np.ndarray, np.ndarray]], base: np.ndarray, size: np.ndarray, t: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pair and diagonal, for every part of a pair's diagonals that has at least `least` matches: the commonest one of it. matches: pairs and their diagonals, from 0 to size; base: where each pair's sizes start."""
    count = np.zeros(int(size.sum()) + t, np.int64)
    for pair, d in matches:
        count += np.bincount(base[pair] + d, minlength=len(count))
    total = np.concatenate([[0], np.cumsum(count)])
    step = max(1, t // 2)
    each = -(-size // step)
    pair = np.repeat(np.arange(len(size)), each)
    first = (np.arange(len(pair)) - np.repeat(np.cumsum(each) - each, each)) * step
    width = np.minimum(t, size[pair] - first)
    at = base[pair] + first
    some = np.flatnonzero(total[at + width] - total[at] >= least)
    pair, first, width, at = pair[some], first[some], width[some], at[some]
    found = []
    for k in range(0, len(some), 1 << 12):
        part = slice(k, k + (1 << 12))
        inside = np.where(np.arange(t) < width[part, None], count[at[part, None] + np.arange(t)], -1)
        found.append(first[part] + inside.argmax(axis=1))
    both = np.unique((base[pair] + np.concatenate(found)) if found else np.zeros(0, np.int64))
    pair = np.searchsorted(base, both, side="right") - 1
    return pair, both - base[pair]


def passages(x: np.ndarray, y: np.ndarray, t: int, similarity: float) -> list[tuple[int, int, int, int]]:
    """(start, end, start, end) of passages of at least t elements of x and of y whose sets have at least the similarity."""
    found = passages_of_pairs(x, np.array([0, len(x)]), y, np.array([0, len(y)]), t, similarity)
    return [tuple(row[1:]) for row in found.tolist()]


def passages_of_pairs(x: np.ndarray, xat: np.ndarray, y: np.ndarray, yat: np.ndarray, t: int, similarity: float) -> np.ndarray:
    """(pair, start, end, start, end), a row for each of the passages of at least t elements of x and of y, whose sets have at least the similarity, in each pair of x[xat[k]:xat[k+1]] and y[yat[k]:yat[k+1]].

    Each diagonal that has enough equal elements is followed by itself: an element's place in y is
    the one nearest to it, so that other occurrences of the element don't matter. All pairs'
    diagonals are looked up together.
    """
    n, none = len(xat) - 1, np.zeros((0, 5), np.int64)
    if not len(x) or not len(y):
        return none
    pair, ypair = (np.repeat(np.arange(n), np.diff(at)) for at in (xat, yat))
    ky = ypair.astype(U) << U(32) | y
    order = np.argsort(ky, kind="stable")
    ys, places = ky[order], order - yat[ypair[order]]
    at = np.searchsorted(ys, kx := pair.astype(U) << U(32) | x)
    hit = np.flatnonzero(ys[np.minimum(at, len(ys) - 1)] == kx)
    own, at, i = pair[hit], at[hit], hit - xat[pair[hit]]
    count = np.bincount(own, minlength=n)
    enough = count >= max(1, int(t * similarity))  # along() joins nothing with fewer
    first = np.cumsum(count) - count
    d = places[at] - i
    # One stretch, equal element by element, each of which stands once in both, is a passage or nothing is.
    twice = np.append(ys[1:] == ys[:-1], False)[at]
    plain = enough & (np.bincount(own[twice | (d != d[first[own]])], minlength=n) == 0)
    k = np.flatnonzero(plain)
    a = i[first[k]]
    whole = i[first[k] + count[k] - 1] - a + 1 == count[k]
    plain[k[~whole]] = False
    long = whole & (count[k] >= t)
    k, a = k[long], a[long]
    c = a + d[first[k]]
    out = [np.stack([k, a, a + count[k], c, c + count[k]], axis=1)]

    left = (enough & ~plain)[own]
    own, at, i = own[left], at[left], i[left]
    if not len(own):
        return out[0]
    ends = np.append(np.flatnonzero(ys[1:] != ys[:-1]) + 1, len(ys))
    group = np.searchsorted(ends, at, side="right")
    many = ends[group] - at
    total, nx = np.cumsum(many), np.diff(xat)

    def matches() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        a = 0
        while a < len(own):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + (1 << 18), side="right")))
            m = many[a:b]
            k = np.arange(m.sum()) + np.repeat(at[a:b] - np.cumsum(m) + m, m)
            yield np.repeat(own[a:b], m), places[k] - np.repeat(i[a:b], m) + np.repeat(nx[own[a:b]], m)
            a = b

    size = nx + np.diff(yat)
    of, ds = diagonals(matches(), np.cumsum(size) - size, size, t, int(t * similarity * similarity))
    if not len(of):
        return out[0]
    ds -= nx[of]
    # Places in order within each group of equal elements of a pair.
    width = U(int(max(np.diff(yat).max(), 1)).bit_length())
    numbers = np.repeat(np.arange(len(ends)), np.diff(np.append(0, ends)))
    ordered = numbers.astype(U) << width | places.astype(U)
    count = np.bincount(own, minlength=n)
    first = np.cumsum(count) - count
    stretches: list[tuple[int, bytes]] = []
    ends_of = np.cumsum(count[of])
    done = 0
    while done < len(of):
        upto = max(done + 1, int(np.searchsorted(ends_of, (ends_of[done - 1] if done else 0) + CELLS, side="right")))
        m = count[of[done:upto]]
        line = np.repeat(np.arange(len(m)), m)
        k = np.arange(len(line)) + np.repeat(first[of[done:upto]] - np.cumsum(m) + m, m)
        wanted = i[k] + ds[done + line]
        limit = np.minimum(np.maximum(wanted, 0), np.diff(yat)[own[k]]).astype(U)
        near = np.searchsorted(ordered, group[k].astype(U) << width | limit)
        after, before = np.minimum(near, ends[group[k]] - 1), np.maximum(near - 1, at[k])
        far = [np.abs(places[q] - wanted) for q in (before, after)]
        place = np.where(far[0] < far[1], places[before], places[after])
        ok = np.minimum(*far) <= t
        line, p, q = line[ok], i[k[ok]], place[ok]
        if len(line):
            s = np.flatnonzero(np.append(True, (line[1:] != line[:-1]) | (p[1:] != p[:-1] + 1) | (q[1:] != q[:-1] + 1)))
            e = np.append(s[1:], len(line)) - 1
            rows = np.stack([p[s], p[e] + 1, q[s], q[e] + 1], axis=1)
            start = np.flatnonzero(np.append(True, line[s[1:]] != line[s[:-1]]))
            stop = np.append(start[1:], len(s))
            # along() finds nothing in fewer elements, or in less of x or y.
            hits = np.add.reduceat(e - s + 1, start)
            span_x = rows[stop - 1, 1] - rows[start, 0]
            span_y = np.maximum.reduceat(rows[:, 3], start) - np.minimum.reduceat(rows[:, 2], start)
            for j in np.flatnonzero((hits >= t * similarity) & (span_x >= t) & (span_y >= t * similarity)).tolist():
                stretches.append((int(of[done + line[s[start[j]]]]), rows[start[j] : stop[j]].tobytes()))
        done = upto
    # Neighbouring diagonals often have the same stretches.
    by: dict[int, set[bytes]] = {}
    for k, rows in stretches:
        by.setdefault(k, set()).add(rows)
    for k, lines in by.items():
        out.append(np.array([(k, *row) for row in of_pair(x[xat[k] : xat[k + 1]], y[yat[k] : yat[k + 1]], lines, t, similarity)], np.int64).reshape(-1, 5))
    return np.concatenate(out)


def of_pair(x: np.ndarray, y: np.ndarray, lines: set[bytes], t: int, similarity: float) -> list[tuple[int, int, int, int]]:
    """passages() along the diagonals of a pair; lines: the stretches of each."""
    xs, ys = x.tolist(), y.tolist()

    def similar(a: int, b: int, c: int, d: int) -> bool:
        if b - a + d - c <= 1024:
            p, q = set(xs[a:b]), set(ys[c:d])
            both = len(p & q)
        else:
            p, q = np.unique(x[a:b]), np.unique(y[c:d])
            both = len(np.intersect1d(p, q, assume_unique=True))
        return both >= similarity * (len(p) + len(q) - both)

    out: set[tuple[int, int, int, int]] = set()
    for rows in lines:
        out.update(along(np.frombuffer(rows, np.int64).reshape(-1, 4).tolist(), t, similarity, similar))
    joined: list[tuple[int, int, int, int]] = []
    for a, b, c, d in sorted(out):  # passages that overlap in both, on neighbouring diagonals, are one
        for k, (a2, b2, c2, d2) in enumerate(joined):
            if a <= b2 and c <= d2 and c2 <= d:
                joined[k] = (a2, max(b, b2), min(c, c2), max(d, d2))
                break
        else:
            joined.append((a, b, c, d))
    return joined


def along(stretches: list[list[int]], t: int, similarity: float, similar: Callable[[int, int, int, int], bool]) -> list[tuple[int, int, int, int]]:
    """passages() along a diagonal; stretches: runs of elements of x that occur in y one after the other, and where (start, end, start, end). similar: whether the sets of x[a:b] and y[c:d] are.

    Stretches are joined while what they span in both may still be similar enough. Where the sets of
    a joined passage are not, its two parts are tried.
    """
    joined: list[tuple] = []  # start, end, elements that occur, start, end, parts
    for a, b, c, d in stretches:
        m = b - a
        q: tuple = (a, b, m, c, d, ())
        while joined:
            p = joined[-1]
            first, _, n, c2, d2, _ = p
            c, d, m = c if c < c2 else c2, d if d > d2 else d2, m + n
            if m < similarity * (b - first + d - c - m):
                break
            joined.pop()
            q = (first, b, m, c, d, (p, q))
        joined.append(q)
    out, least = [], t * similarity
    joined = [q for q in joined if q[1] - q[0] >= t and q[4] - q[3] >= least]
    while joined:
        a, b, _, c, d, parts = joined.pop()
        if similar(a, b, c, d):
            out.append((a, b, c, d))
        else:  # parts span no more than the whole, in both
            joined.extend([q for q in parts if q[1] - q[0] >= t and q[4] - q[3] >= least])
    return out


def verified(docs: DataFrame, found: DataFrame, t: int, similarity: float) -> DataFrame:
    """cid, start, end, other, other_start, other_end, in words: the regions' passages, verified on their runs. docs: cid, t."""
    found = found.withColumn("bucket", F.xxhash64("cid", "other", "a", "c"))
    sides = found.select("bucket", "cid", F.lit(0).alias("side"), F.col("a").alias("lo"), F.col("b").alias("hi")).unionByName(found.select("bucket", F.col("other").alias("cid"), F.lit(1).alias("side"), F.col("c").alias("lo"), F.col("d").alias("hi")))
    # A text that many ask for is read in as many rows as give each about REQUESTS of them.
    many = sides.groupBy("cid").agg(F.ceil(F.count("*") / REQUESTS).alias("n")).where("n > 1")
    salted = sides.join(many, "cid", "left").withColumn("salt", F.coalesce(F.pmod("bucket", "n"), F.lit(0)))
    asked = salted.groupBy("cid", "salt").agg(F.collect_list(F.struct("bucket", "side", "lo", "hi")).alias("asked"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for i, j, words, offs in text_words(batch["t"]):
                h, at = shingle_hashes(words, offs, K)
                small, out, size = (h >> U(32)).astype(np.uint32), [], 0
                for k, (cid, asked) in enumerate(zip(batch["cid"].slice(i, j - i).to_pylist(), batch["asked"].slice(i, j - i).to_pylist(), strict=True)):
                    own = small[at[k] : at[k + 1]]
                    for q in asked:
                        out.append((q["bucket"], q["side"], cid, q["lo"], own[q["lo"] : q["hi"] + 1].tobytes()))
                        size += len(out[-1][4]) + 64
                        if size >= 1 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*out, strict=True), kinds, strict=True)], ["bucket", "side", "cid", "lo", "runs"])
                            out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*out, strict=True), kinds, strict=True)], ["bucket", "side", "cid", "lo", "runs"])

    parts = asked.join(docs, "cid").select("cid", "asked", "t").mapInArrow(cut, "bucket long, side int, cid long, lo long, runs binary")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_buckets(batches, 1024):
            # Two rows a bucket, a region, in the order of their sides.
            table = table.combine_chunks().sort_by([("bucket", "ascending"), ("side", "ascending")])
            cid, lo = table["cid"].to_numpy().reshape(-1, 2), table["lo"].to_numpy().reshape(-1, 2)
            buf, offs = string_bytes(table["runs"].combine_chunks())
            runs, offs = buf.view(np.uint32), offs // 4
            size = np.diff(offs)
            for i, j in slices(offs[::2], ELEMENTS):
                own = np.repeat(np.arange(2 * (j - i)) % 2, size[2 * i : 2 * j]) == 0
                part = runs[offs[2 * i] : offs[2 * j]]
                at = [np.append(0, np.cumsum(size[2 * i + side : 2 * j : 2])) for side in (0, 1)]
                k, a, b, c, d = passages_of_pairs(part[own], at[0], part[~own], at[1], t, similarity).T
                k = k + i
                if len(k):
                    rows = (cid[k, 0], lo[k, 0] + a, lo[k, 0] + b + K - 1, cid[k, 1], lo[k, 1] + c, lo[k, 1] + d + K - 1)
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in rows], ["cid", "start", "end", "other", "other_start", "other_end"])

    dealt = parts.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(compare, "cid long, start long, end long, other long, other_start long, other_end long")


def exact(docs: DataFrame, crowd: DataFrame, t: int, seed: int) -> DataFrame:
    """cid, start, end, other, other_start, other_end, in words: what stands word for word, for t runs or more, in a text before too, around windows of large groups.

    All windows of t runs with one hash are equal, so the first of them stands for every other: none
    is left out, and a group gives a row for each. Hashes that are very common are few; their first
    windows go to all tasks, so that those hashes' rows aren't gathered.
    """
    known = crowd.groupBy("cid").agg(F.collect_set("pos").alias("anchors"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, words, offs in text_words(batch["t"]):
                h, at = shingle_hashes(words, offs, K)
                lists, cid = batch["anchors"].slice(i, j - i), batch["cid"].to_numpy()[i:j]
                again = np.zeros(len(h), bool)
                again[lists.flatten().to_numpy() + np.repeat(at[:-1], lists.value_lengths().to_numpy())] = True
                for part, own, r, first in pieces(h, at, t):
                    if len(part) < t:
                        continue
                    here = again[at[r] + first : at[r] + first + len(part)]
                    row = np.repeat(np.arange(len(own) - 1), np.diff(own))
                    crowded = here[lowest(part, seed, 0)]
                    keep = (row[: len(part) - t + 1] == row[t - 1 :]) & (crowded[: len(part) - t + 1] | crowded[t - seed :])
                    s = np.flatnonzero(keep)
                    if len(s):
                        key = mix(window_sums(part, t)[s], 400)
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(cid[row[s] + r]), pa.array(s - own[row[s]] + first)], ["key", "cid", "pos"])

    whole = stage(known.join(docs, "cid").select("cid", "anchors", "t").mapInArrow(run, "key long, cid long, pos long"), "whole")
    first = stage(whole.groupBy("key").agg(F.min(F.struct("cid", "pos")).alias("m"), F.max("cid").alias("last"), F.count("*").alias("n")).where("last > m.cid").select("key", F.col("m.cid").alias("other"), F.col("m.pos").alias("other_pos"), "n"), "firsts")
    limit = max(COMMON, (first.agg(F.sum("n")).first()[0] or 0) // COMMON_SHARE)
    common = F.broadcast(first.where(F.col("n") > limit).drop("n"))  # COMMON_SHARE rows at most
    rare = whole.join(common, "key", "left_anti").join(first.where(F.col("n") <= limit).drop("n"), "key")
    pairs = whole.join(common, "key").unionByName(rare).where("cid > other").withColumn("d", F.col("pos") - F.col("other_pos"))
    runs = pairs.withColumn("run", F.col("pos") - F.row_number().over(W.partitionBy("cid", "other", "d").orderBy("pos")))
    joined = runs.groupBy("cid", "other", "d", "run").agg(F.min("pos").alias("start"), (F.max("pos") + t + K - 1).alias("end"))
    return joined.select("cid", "start", "end", "other", (F.col("start") - F.col("d")).alias("other_start"), (F.col("end") - F.col("d")).alias("other_end"))


def islands(spans: DataFrame) -> DataFrame:
    """Overlapping or touching spans (cid, start, end, other, other_start) as one, with the first place they were matched with."""
    by = W.partitionBy("cid").orderBy("start", "end", "other", "other_start")
    new = spans.withColumn("new", F.when(F.col("start") <= F.max("end").over(by.rowsBetween(W.unboundedPreceding, -1)), 0).otherwise(1))
    whole = new.withColumn("island", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0))).groupBy("cid", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min(F.struct("other", "other_start")).alias("o"))
    return whole.select("cid", "start", "end", F.col("o.other").alias("other"), F.col("o.other_start").alias("other_start"))


def in_order(rows: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    """rows with uid in the order of doc_id (nulls last), then of a hash of the text."""
    order = ["_none", "_id", "_hash"]
    keyed = rows.withColumn("_none", doc_id.isNull()).withColumn("_id", doc_id).withColumn("_hash", F.xxhash64(text))
    return identified(keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop(*order), 3)


def content_hash(rows: DataFrame) -> Column:
    """A long for each text of rows (uid, t): its hash; of texts that share one, another hash. Two in 2**64 pairs of texts share one, so a few at most are looked up."""
    plain, full = F.xxhash64("t"), F.md5(F.col("t").cast("binary"))
    twice = rows.where("t is not null").groupBy(plain.alias("h")).agg(F.min(full).alias("a"), F.max(full).alias("b")).where("a <> b").select("h").collect()
    return F.when(plain.isin(*[r["h"] for r in twice]), F.xxhash64(F.lit(1), full)).otherwise(plain) if twice else plain


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with the number of words (end) in place of the last column, t."""
    for batch in batches:
        n = [np.diff(offs) for _, _, _, offs in text_words(batch["t"])]
        if n:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(n).astype(np.int64))], [*batch.schema.names[:-1], "end"])


def repeats(rows: DataFrame, least_words: int, similarity: float) -> DataFrame:
    """For rows (uid, doc_id, t), with uid in the order in which occurrences count as first: passages (uid, start, end, other, other_start, first, of) that repeat in another row, in words.

    other is the row in which the passage stands too, or null for a row that repeats a whole text;
    then `of` is the doc_id of the first row with that text. Rows with first = false have an earlier
    occurrence, which stays if those rows are cut; rows with first = true are such occurrences
    (matched with themselves), but for those that lie within a row with first = false.
    """
    spark, t = rows.sparkSession, least_words - K + 1
    seed = seed_runs(t, similarity)
    rows = rows.where("t is not null").withColumn("hash", content_hash(rows))
    heads = rows.select("uid", "hash").groupBy("hash").agg(F.min("uid").alias("cid"), F.count("*").alias("n"))
    several = stage(heads.where("n > 1").select("hash", "cid"), "several")
    again = rows.join(several, "hash").select("uid", "cid", "doc_id", "t")
    again = stage(again.mapInArrow(counted, again.withColumn("t", F.lit(0).cast("long")).withColumnRenamed("t", "end").schema), "copies")
    docs = rows.join(again.where("uid <> cid").select("uid"), "uid", "left_anti").select(F.col("uid").alias("cid"), "t")
    with Scratch() as scratch:
        with Scratch() as firsts_only:
            met = firsts_only.keep(stage(meetings(windows(docs, seed, *common_signatures(docs, seed))), "meetings"))
            near = firsts_only.keep(scratch.keep(stage(verified(docs, stage(regions(edges(met), t), "regions"), t, similarity), "passages")))
        rest = stage(unsettled(met, near), "unsettled")
        with Scratch() as pairs:
            more = pairs.keep(scratch.keep(stage(verified(docs, stage(regions(second_meetings(rest), t), "regions"), t, similarity), "passages")))
        word_for_word = scratch.keep(stage(exact(docs, rest.where("how > 0").select("cid", "pos"), t, seed), "exact"))
    near = near.unionByName(more).unionByName(word_for_word)
    again = again.where("uid <> cid").join(again.where("uid = cid").select("cid", F.col("doc_id").alias("of")), "cid")
    later = islands(near.select("cid", "start", "end", "other", "other_start")).withColumn("first", F.lit(False))
    long = again.where(F.col("end") >= least_words)
    firsts = near.select(F.col("other").alias("cid"), F.col("other_start").alias("start"), F.col("other_end").alias("end")).unionByName(long.select("cid", F.lit(0).cast("long").alias("start"), "end")).distinct()
    firsts = islands(firsts.withColumn("other", F.col("cid")).withColumn("other_start", F.col("start"))).withColumn("first", F.lit(True))
    # An occurrence that has one before it is no first one.
    cut = later.select(F.col("cid").alias("of"), F.col("start").alias("lo"), F.col("end").alias("hi"))
    firsts = firsts.join(cut, (F.col("cid") == F.col("of")) & (F.col("lo") <= F.col("start")) & (F.col("hi") >= F.col("end")), "left_anti")
    found = later.unionByName(firsts).withColumnRenamed("cid", "uid").withColumn("of", F.lit(None).cast(rows.schema["doc_id"].dataType))
    whole = long.select("uid", F.lit(0).cast("long").alias("start"), "end", F.lit(None).cast("long").alias("other"), F.lit(0).cast("long").alias("other_start"), F.lit(False).alias("first"), "of")
    return found.unionByName(whole)


def passages_of(docs: DataFrame, text: str = "text", least_words: int = 50, similarity: float = 0.8) -> DataFrame:
    """doc_id, start_word, n_words, first_doc_id, first_start and is_first, a row for each passage that repeats across rows of docs.

    A passage has at least `least_words` words and, over runs of five words, a Jaccard similarity of
    at least `similarity` to a passage of another row; overlapping passages of a row are joined. The
    first of several is that of the row with the least doc_id (nulls last, of equal ones by a hash of
    the text), and may be shorter by a few words; rows equal as a whole are passages if long enough. Null, empty and shorter texts have none, nor have passages that repeat only within
    their row. Equal or null ids are no matter. An empty table gives no rows.
    """
    rows = in_order(docs.select("doc_id", F.col(text).alias("t")), F.col("doc_id"), F.col("t"))
    with Scratch() as scratch:
        found = scratch.keep(stage(repeats(rows, least_words, similarity), "repeats"))
    ids = rows.select("uid", "doc_id")
    named = found.join(ids, "uid").join(ids.select(F.col("uid").alias("other"), F.col("doc_id").alias("other_id")), "other", "left")
    return named.select("doc_id", F.col("start").alias("start_word"), (F.col("end") - F.col("start")).alias("n_words"), F.when(F.col("other").isNull(), F.col("of")).otherwise(F.col("other_id")).alias("first_doc_id"), F.col("other_start").alias("first_start"), F.col("first").alias("is_first"))


def cut_repeats(docs: DataFrame, text: str = "text", least_words: int = 50, similarity: float = 0.8) -> DataFrame:
    """docs without the passages that have an earlier occurrence in another row; other columns as they are, rows kept.

    What is cut are the passage's words and the white space after them. A row that is cut whole has an empty text.
    """
    marked = in_order(docs.select(F.struct("*").alias("_row")), F.col("_row.doc_id"), F.col(f"_row.`{text}`"))
    with Scratch() as scratch:
        found = repeats(marked.select("uid", F.col("_row.doc_id").alias("doc_id"), F.col(f"_row.`{text}`").alias("t")), least_words, similarity)
        spans = found.where("not first").groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_cuts"))
        cuts = scratch.keep(stage(spans, "cuts"))
    joined = marked.join(cuts, "uid", "left").select(F.col(f"_row.`{text}`").alias("_text"), "_cuts", "_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, cuts in zip(batch["_text"].to_pylist(), batch["_cuts"].to_pylist(), strict=True):
                if cuts and value is not None:
                    buf, offs = string_bytes(pa.array([value]))
                    s, _, _ = word_spans(buf, offs)
                    s, data, keep, last = np.append(s, len(buf)), buf.tobytes(), [], 0
                    for c in cuts:
                        keep.append(data[last : s[min(c["start"], len(s) - 1)]])
                        last = int(s[min(c["end"], len(s) - 1)])
                    value = b"".join([*keep, data[last:]]).decode()
                out.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), batch["_row"]], ["_text", "_row"])

    done = joined.mapInArrow(run, joined.select("_text", "_row").schema)
    return done.select(*[F.col("_text").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
