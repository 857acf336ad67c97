"""Postings of an index, packed: which rows of a block hold a term, and where."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BITS = 11  # a block: rows whose numbers differ in their last bits only
MOST = 8_000_000  # bytes of text, or of packed postings, that a task takes apart at once, and a single one's more; a block of more is several
KEPT = np.zeros(256, np.uint8)  # what bytes become in tokens: 0 is none of a token; all beyond ASCII are
KEPT[128:] = np.arange(128, 256)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    KEPT[_c] = KEPT[ord(chr(_c).upper())] = _c

Batches = Iterator[pa.RecordBatch]


def _coded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (0 to 2^35 - 1) as bytes of seven bits, lowest first, all but a number's last over 127; and where each begins, and the end."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 5):
        size += values >= 1 << 7 * k
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(at[-1], np.uint8)
    out[at[:-1]] = values & 127 | (size > 1) << 7
    for k in range(1, 5):
        if not len(more := np.flatnonzero(size > k)):
            break
        out[at[more] + k] = values[more] >> 7 * k & 127 | (size[more] > k + 1) << 7
    return out, at


def _decoded(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers, and where each begins."""
    at = np.concatenate([[0], np.flatnonzero(data < 128)[:-1] + 1]) if len(data) else np.zeros(0, np.int64)
    size = np.diff(np.append(at, len(data)))
    values = (data[at] & 127).astype(np.int64)
    for k in range(1, 5):
        if not len(more := np.flatnonzero(size > k)):
            break
        values[more] |= (data[at[more] + k] & 127).astype(np.int64) << 7 * k
    return values, at


def _begins(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the sizes."""
    return np.arange(sizes.sum()) - np.repeat(_begins(sizes), sizes)


def _gaps(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of the runs of these sizes (at least 1): the first value, then what each is more than the one before."""
    out = np.diff(values, prepend=0)
    at = _begins(sizes)
    out[at] = values[at]
    return out


def _sums(gaps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total, at = np.cumsum(gaps), _begins(sizes)
    return total - np.repeat(total[at] - gaps[at], sizes)


def packed(n: np.ndarray, rows: np.ndarray, counts: np.ndarray, positions: np.ndarray | None = None) -> pa.Array:
    """One binary a term: the number of its rows, their gaps, how often each holds the term, and gaps of the positions. n: rows of each term, at least 1; counts at least 1. Without positions these are left out."""
    held = np.zeros(len(n), np.int64) if positions is None else np.add.reduceat(counts, _begins(n))
    size = 1 + 2 * n + held
    base = _begins(size)
    values = np.empty(size.sum(), np.int64)
    values[base] = n
    at = np.repeat(base + 1, n) + _within(n)
    values[at] = _gaps(rows, n)
    values[at + np.repeat(n, n)] = counts
    if positions is not None:
        values[np.repeat(base + 1 + 2 * n, held) + _within(held)] = _gaps(positions, counts)
    data, begins = _coded(values)
    offsets = begins[np.append(base, len(values))].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings or binaries, and where each begins, and the end."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def unpacked(places: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n, rows, counts, positions) of packed terms; no positions if none were packed."""
    data, offsets = _bytes(places)
    values, begins = _decoded(data)
    base = np.searchsorted(begins, offsets[:-1])
    n = values[base]
    at = np.repeat(base + 1, n) + _within(n)
    rows, counts = _sums(values[at], n), values[at + np.repeat(n, n)]
    held = np.diff(np.append(base, len(values))) - 1 - 2 * n
    gaps = values[np.repeat(base + 1 + 2 * n, held) + _within(held)]
    return n, rows, counts, _sums(gaps, counts) if len(gaps) else gaps


def _tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The terms, about sorted (a later sort is quicker for it), the number of the term of each token, one text after the other, and how many tokens each text has."""
    data, offsets = _bytes(texts)
    folded = KEPT[data]
    inside = folded != 0
    after, before = np.append(inside, False), np.append(False, inside)  # of each place between bytes: is the next one in a token, and the last one
    border = after != before
    border[offsets] = True
    starts, ends = np.flatnonzero(border & after), np.flatnonzero(border & before)
    at = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
    tokens = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(folded[inside])])
    tokens = tokens.dictionary_encode()
    order = np.argsort(_heads(tokens.dictionary))
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    return tokens.dictionary.take(pa.array(order)), rank[tokens.indices.to_numpy()], np.diff(np.searchsorted(starts, offsets))


def _heads(terms: pa.Array) -> np.ndarray:
    """The first eight bytes of terms, as numbers that sort alike."""
    data, offsets = _bytes(terms)
    data, out = np.append(data, np.zeros(8, np.uint8)), np.zeros(len(terms), np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | np.where(offsets[:-1] + k < offsets[1:], data[offsets[:-1] + k], 0).astype(np.uint64)
    return out


def _parts(sizes: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours of at most MOST bytes in all, or one alone, which begin anew at each of the cuts."""
    at, end = 0, np.cumsum(sizes)
    for cut in [*cuts.tolist(), len(sizes)]:
        while at < cut:
            to = min(cut, max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + MOST, "right"))))
            yield at, to
            at = to


def cells(batches: Batches) -> Batches:
    """Rows (_row, text) to (term, _block, places), the packed postings of each block's terms. Tokens are runs of ASCII letters and digits, as small letters, and of all that isn't ASCII.

    Term "" has the rows with tokens, and how many each has.
    """

    def batch_of(held: list[tuple[np.ndarray, pa.Array]]) -> pa.RecordBatch:
        rows, texts = np.concatenate([r for r, _ in held]), pa.concat_arrays([t for _, t in held])
        if (rows[1:] < rows[:-1]).any():
            order = np.argsort(rows)
            rows, texts = rows[order], texts.take(pa.array(order))
        block, last = rows[0] >> BITS, rows & (1 << BITS) - 1
        terms, code, lens = _tokens(texts)
        order = np.sort(code.astype(np.int64) << 32 | np.arange(len(code)))
        code, at = order >> 32, order & (1 << 32) - 1
        row, position = np.repeat(np.arange(len(rows)), lens)[at], _within(lens)[at]
        begins = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (row[1:] != row[:-1])))[: len(code)]
        counts, some = np.diff(np.append(begins, len(code))), np.flatnonzero(lens)
        if not len(some):
            return pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.string(), pa.int64(), pa.binary())], ["term", "_block", "places"])
        terms = pa.concat_arrays([terms, pa.array([""])])
        packs = pa.concat_arrays([packed(np.bincount(code[begins]), last[row[begins]], counts, position), packed(np.array([len(some)]), last[some], lens[some])])
        return pa.RecordBatch.from_arrays([terms, pa.array(np.full(len(terms), block)), packs], ["term", "_block", "places"])

    held: list[tuple[np.ndarray, pa.Array]] = []
    size = 0
    for batch in batches:
        rows, texts = batch.column(0).to_numpy(), batch.column(1)
        sizes = np.diff(_bytes(texts)[1])
        for a, b in _parts(sizes, np.flatnonzero(np.diff(rows >> BITS)) + 1):
            more = int(sizes[a:b].sum())
            if held and (rows[a] >> BITS != held[0][0][0] >> BITS or size + more > MOST):
                yield batch_of(held)
                held, size = [], 0
            held.append((rows[a:b], texts.slice(a, b - a)))
            size += more
    if held:
        yield batch_of(held)


def _slices(batches: Batches) -> Batches:
    for batch in batches:
        sizes = np.diff(_bytes(batch.column("places"))[1])
        for a, b in _parts(sizes, np.zeros(0, np.int64)):
            yield batch.slice(a, b - a)


def lengths(batches: Batches) -> Batches:
    """What `cells` has of term "", as (_row, len)."""
    for batch in _slices(batches):
        n, rows, counts, _ = unpacked(batch.column("places"))
        at = np.repeat(batch.column("_block").to_numpy(), n) << BITS | rows
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts.astype(np.int32))], ["_row", "len"])


def places(batches: Batches) -> Batches:
    """Packed postings as (term, _seg, _row, positions, _bucket)."""
    for batch in _slices(batches):
        n, rows, counts, positions = unpacked(batch.column("places"))
        which = pa.array(np.repeat(np.arange(len(n)), n))
        at = np.repeat(batch.column("_block").to_numpy(), n) << BITS | rows
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(positions.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column("term").take(which), batch.column("_seg").take(which), pa.array(at), lists, batch.column("_bucket").take(which)], ["term", "_seg", "_row", "positions", "_bucket"])


def without(batches: Batches) -> Batches:
    """Packed postings without rows that are dead: _dead has a bit for each row of the block, in longs; a term without rows goes."""
    for batch in _slices(batches):
        n, rows, counts, positions = unpacked(batch.column("places"))
        bits = np.stack(batch.column("_dead").to_numpy(zero_copy_only=False)).astype("<i8").view(np.uint8)
        dead = np.unpackbits(bits, axis=1, bitorder="little")
        which = np.repeat(np.arange(len(n)), n)
        alive = dead[which, rows] == 0
        n = np.bincount(which[alive], minlength=len(n))
        left = batch.filter(pa.array(n > 0))
        new = packed(n[n > 0], rows[alive], counts[alive], positions[np.repeat(alive, counts)]) if len(left) else left.column("places")
        yield pa.RecordBatch.from_arrays([new if name == "places" else left.column(name) for name in left.schema.names if name != "_dead"], [name for name in left.schema.names if name != "_dead"])
