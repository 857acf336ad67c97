"""Packing of tokenised documents into sequences, with a bounded number of open windows.

Each partition keeps a fixed number of open windows. A document goes whole into the window that it
fits best; if it fits none and no more may be opened, the fullest window is filled up with the
document's beginning (or padded, where only a few tokens are free) and emitted. What is open at a
partition's end is merged, first within the partition, then among partitions, a fixed number at a
time, until one window is left.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stage
from millrace.llm.text import slices, string_bytes, word_hashes, word_spans

SIZE = 4096
END_ID = 2
FAN_IN = 64


LETTERS = re.compile(rb"[a-z]+")
KIND = np.full(256, 2, np.uint8)  # of ASCII bytes: letters, digits, others
KIND[ord("a") : ord("z") + 1] = 0
KIND[ord("0") : ord("9") + 1] = 1
MARKS = np.isin(np.arange(256), np.frombuffer(b".,;:!?", np.uint8))


def _inside(size: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of `size` bytes lie in the spans."""
    edge = np.zeros(size + 1, np.int8)
    edge[start] += 1
    edge[end] -= 1
    return np.cumsum(edge[:-1], dtype=np.int8) > 0


def units(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of parts of words that the tokenizer never joins, and the offsets of the rows.

    Words of ASCII bytes are parted into runs of letters, single digits and runs of the rest. A word
    with an apostrophe (contractions), a < (special tokens, which keep their case) or other letters
    is one part, but for a mark after an ASCII letter at its end.
    """
    s, e, _ = word_spans(data, offs)
    odd, angle = (data >= 128) | (data == 0x27) | (data == 0x3C), data == 0x3C
    count = lambda flags: (lambda c: c[e] - c[s])(np.concatenate([[0], np.cumsum(flags)]))
    with_odd, with_angle = count(odd) > 0, count(angle) > 0
    lower = data.copy()
    upper = (data >= 65) & (data <= 90) & ~_inside(len(data), s[with_angle], e[with_angle])
    lower[upper] += 32
    kind = KIND[lower]
    start = np.zeros(len(data), bool)
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 1)
    start &= _inside(len(data), s[~with_odd], e[~with_odd])
    plain_end = e[with_odd & (count(angle | (data == 0x27)) == 0)] - 1
    plain_end = plain_end[MARKS[data[plain_end]] & (plain_end > 0)]
    start[plain_end[KIND[lower[plain_end - 1]] == 0]] = True
    start[s] = True
    us = np.flatnonzero(start)
    ue = np.minimum(np.append(us[1:], len(data)), e[np.searchsorted(s, us, side="right") - 1]) if len(us) else us
    return lower, us, ue, np.searchsorted(us, offs)


class WordTokens:
    """Ids of whole texts by a tokenizer whose words are independent of the white space between them.

    White space is dropped by the tokenizer and no token spans it, so a text's ids are those of the
    parts of its words in turn. Parts seen before are looked up by a 64-bit hash; the table is
    emptied when it holds `limit` parts.
    """

    def __init__(self, path: str, limit: int = 1_000_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.bar = self.tokenizer.encode("|", add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.pool, self.starts, self.sizes = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = self.known = 0

    def learn(self, keys: np.ndarray, parts: list[bytes]) -> None:
        """Adds parts, whose hashes are keys, in order."""
        found = self.encode(parts)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.uint32)
        n = self.known
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while n + len(parts) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        self.pool[self.used : self.used + len(flat)] = flat
        self.starts[n : n + len(parts)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[n : n + len(parts)] = sizes
        self.used, self.known = self.used + len(flat), n + len(parts)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.place = np.insert(self.keys, at, keys), np.insert(self.place, at, np.arange(n, n + len(parts)))

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of each word. Runs of plain lower-case letters go straight to the tokenizer's model, as nothing before it changes them; others are encoded, many at once with a bar, which has one id of its own, between them."""
        model, out = self.tokenizer.model, [b""] * len(words)
        other, alone = [], []
        for i, w in enumerate(words):
            if LETTERS.fullmatch(w):
                out[i] = np.array([t.id for t in model.tokenize(w.decode())], np.uint32).tobytes()
            elif b"|" in w or len(self.bar) != 1:
                alone.append(i)
            else:
                other.append(i)
        for a in range(0, len(other), 512):
            some = other[a : a + 512]
            ids = np.array(self.tokenizer.encode_batch_fast([" | ".join(words[i].decode() for i in some)], add_special_tokens=False)[0].ids, np.uint32)
            bars = np.flatnonzero(ids == self.bar[0])
            data = ids.tobytes()
            for i, x, y in zip(some, [0, *(bars + 1).tolist()], [*bars.tolist(), len(ids)], strict=True):
                out[i] = data[4 * x : 4 * y]
        for i, e in zip(alone, self.tokenizer.encode_batch_fast([words[i].decode() for i in alone], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, np.uint32).tobytes()
        return out

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """Places of sorted keys, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.place[at], -1)

    def ids(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each row; a null text has none."""
        buf, offs = string_bytes(column)
        for i, j in slices(offs):
            data, us, ue, rows = units(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            keys, first, where = np.unique(word_hashes(data, us, ue), return_index=True, return_inverse=True)
            at = self.look_up(keys)
            new = np.flatnonzero(at < 0)
            if len(new):
                if self.known + len(new) > self.limit and self.known:
                    self.clear()
                    new = np.arange(len(keys))
                self.learn(keys[new], [data[a:b].tobytes() for a, b in zip(us[first[new]].tolist(), ue[first[new]].tolist(), strict=True)])
                at = self.look_up(keys)
            at = at[where]
            sizes = self.sizes[at]
            ends = np.cumsum(sizes)
            flat = self.pool[np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
            bounds = np.concatenate([[0], ends])[rows]
            yield from (flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True))


@lru_cache(maxsize=1)
def word_tokens(path: str) -> WordTokens:
    """One for each Python worker, kept from task to task."""
    return WordTokens(path)


class Packer:
    """Bounded-space best fit. Pieces are (doc_id, start, ids, doc_tokens); done: windows to emit, as lists of pieces."""

    def __init__(self, windows: int = 32, size: int = SIZE, least_cut: int = 16) -> None:
        self.windows, self.size, self.least_cut = windows, size, least_cut
        self.open: list[list] = []  # [free, pieces]
        self.done: list[list[tuple]] = []

    def add(self, doc_id: object, ids: np.ndarray) -> None:
        n, start = len(ids), 0
        while n - start >= self.size:
            self.done.append([(doc_id, start, ids[start : start + self.size], n)])
            start += self.size
        while start < n:
            need = n - start
            fits = [w for w in self.open if w[0] >= need]
            if fits:
                w = min(fits, key=lambda w: w[0])
                self.put(w, (doc_id, start, ids[start:], n))
                return
            if len(self.open) < self.windows:
                self.open.append([self.size - need, [(doc_id, start, ids[start:], n)]])
                return
            w = min(self.open, key=lambda w: w[0])
            if w[0] >= self.least_cut:
                cut = w[0]
                self.put(w, (doc_id, start, ids[start : start + cut], n))
                start += cut
            else:
                self.emit(w)

    def put(self, w: list, piece: tuple) -> None:
        w[0] -= len(piece[2])
        w[1].append(piece)
        if not w[0]:
            self.emit(w)

    def emit(self, w: list) -> None:
        self.open = [x for x in self.open if x is not w]
        self.done.append(w[1])

    def merge(self) -> list[tuple]:
        """Fills the fullest open windows from the emptiest, cutting freely; returns the pieces of the one window that may be left."""
        rest = [p for w in sorted(self.open, key=lambda w: w[0]) for p in w[1]]
        self.open = []
        window, free = [], self.size
        for doc_id, start, ids, n in rest:
            while len(ids):
                part = ids[:free]
                window.append((doc_id, start, part, n))
                free, start, ids = free - len(part), start + len(part), ids[len(part) :]
                if not free:
                    self.done.append(window)
                    window, free = [], self.size
        return window


def halve(window: list[tuple], size: int = SIZE) -> list[list[tuple]]:
    """The pieces of a window as windows whose sizes are powers of two, the largest first."""
    left, out = sum(len(p[2]) for p in window), []
    pieces = list(window)
    while left:
        want = 1 << (min(left, size).bit_length() - 1)
        left, now = left - want, []
        while want:
            doc_id, start, ids, n = pieces.pop(0)
            now.append((doc_id, start, ids[:want], n))
            if len(ids) > want:
                pieces.insert(0, (doc_id, start + want, ids[want:], n))
            want -= len(now[-1][2])
        out.append(now)
    return out


FIELDS = "doc_id {0}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, ids binary"
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part", "ids"]
KINDS = [pa.int64()] * 8 + [pa.binary()]


def _rows(windows: list[list[tuple]], part: int, number: int | None) -> list[tuple]:
    """Rows of windows' pieces; number: of the first window, None for a window that is still open, whose ids are kept."""
    out = []
    for k, window in enumerate(windows):
        offset = 0
        for doc_id, start, ids, n in window:
            data = ids.astype("<u4").tobytes()
            out.append((doc_id, start, len(ids), zlib.crc32(data), n, None if number is None else number + k, offset, part, data if number is None else None))
            offset += len(ids)
    return out


def _batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [id_type, *KINDS[1:]], strict=True)], NAMES)


def pack(docs: DataFrame, tokenizer: str, text: str = "text", windows: int = 32) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of each piece of every row of docs.

    Each text (a null one is empty) is tokenised whole and ends with id 2, so no row is without a
    piece. A document longer than a sequence fills sequences of its own; its rest is packed. Rows
    with equal or null ids are packed like others. The window that is left at last is cut into
    sequences whose lengths are powers of two, so it isn't padded. An empty table gives no rows.
    The numbering is a function of the rows and their partitions.
    """
    fields = FIELDS.format(docs.schema["doc_id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, packer, tokens = TaskContext.get().partitionId(), 0, Packer(windows), word_tokens(tokenizer)
        kind = None
        for batch in batches:
            kind = batch["doc_id"].type
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), tokens.ids(batch["t"]), strict=True):
                packer.add(doc_id, np.append(ids, np.uint32(END_ID)))
                if len(packer.done) >= 64:
                    yield _batch(_rows(packer.done, part, part << 28 | number), kind)
                    number += len(packer.done)
                    packer.done = []
        left = packer.merge()
        if packer.done:
            yield _batch(_rows(packer.done, part, part << 28 | number), kind)
        if left:
            yield _batch(_rows([left], part, None), kind)

    def merge(level: int):
        def run(table: pa.Table) -> pa.Table:
            group = table["part"][0].as_py() // FAN_IN
            order = sorted(table.to_pylist(), key=lambda r: (r["part"], r["offset"]))
            packer = Packer()
            by_part: dict[int, list] = {}
            for r in order:
                by_part.setdefault(r["part"], []).append((r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"]))
            packer.open = [[SIZE - sum(len(p[2]) for p in w), w] for w in by_part.values()]
            left = packer.merge()
            first = level << 56 | group << 28
            rows = _rows(packer.done, group, first) + _rows([left], group, None)
            return pa.Table.from_batches([_batch(rows, table.schema.field("doc_id").type)])

        return run

    def last(table: pa.Table) -> pa.Table:
        window = [(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"]) for r in sorted(table.to_pylist(), key=lambda r: r["offset"])]
        return pa.Table.from_batches([_batch(_rows(halve(window), 0, 127 << 56), table.schema.field("doc_id").type)])

    out = stage(docs.select("doc_id", F.col(text).cast("binary").alias("t")).mapInArrow(run, fields), "packed")
    final = out.where("sequence_id is not null")
    left, level = out.where("sequence_id is null"), 0
    parts = left.agg(F.max("part")).first()[0]
    while parts:  # windows of FAN_IN partitions at most meet in a group
        level += 1
        left = stage(left.withColumn("g", F.floor(F.col("part") / FAN_IN)).groupBy("g").applyInArrow(merge(level), fields), f"merged{level}")
        final = final.unionByName(left.where("sequence_id is not null"))
        left, parts = left.where("sequence_id is null"), parts // FAN_IN
    final = final.unionByName(left.groupBy("part").applyInArrow(last, fields))
    return final.drop("part", "ids")
