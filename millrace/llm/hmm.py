"""A hidden Markov language model, and scores of whole texts.

Latent states emit word classes: each of the commonest words is a class of its own, other words
share a class by their last bytes and length. The probability of a text is that of its classes,
by the scaled forward recursion over all of it, times that of each word within its class: a word
of the training texts by its count there; all others of the class are one outcome, as likely as the
class's share of words seen once (Good-Turing). So the base score's one outcome for all new words
is split into one for each class of rare words, and no text is more likely than it could be there.

Training is Baum-Welch: expected counts are made in tasks, over all training texts, and added up by
Spark. The tables that go to all tasks have a bounded number of classes and states; counts of words
stay in a table that is as large as the vocabulary, and are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stage
from millrace.llm.text import U, mix, slices, string_bytes, word_hashes, word_spans

RARE = 4096
COMMON = 60_000
END = COMMON + RARE  # the class of the token that ends a text
CLASSES = END + 1
STATES = 8
SEGMENT = 8192
GROUP = 1 << 19  # tokens that are worked on together
SCALED = 8  # steps between scalings: a step takes a factor of 1e-36 at most, for up to 1e18 training tokens
ONES = np.ones(STATES)
BITS = 18  # of keys, by which common words are looked up
BINS = 256  # of word counts, for each power of two
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Words:
    """The words of rows i to j: lower-cased bytes, spans, offsets of the rows and keys."""

    i: int
    j: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    offs: np.ndarray
    keys: np.ndarray

    def rare(self, some: np.ndarray) -> np.ndarray:
        """The rare classes of some words."""
        s, e = self.start[some], self.end[some]
        tail = np.zeros(len(some), U)
        for back in range(1, 4):
            at = e - back
            tail = tail << U(8) | np.where(at >= s, self.data[np.maximum(at, 0)] if len(self.data) else 0, 0).astype(U)
        return (mix(tail << U(8) | np.minimum(e - s, 16).astype(U), 31) % U(RARE)).astype(np.int64)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct keys, their rare classes and how often they occur."""
        coded = pa.array(self.keys).dictionary_encode()
        at = coded.indices.to_numpy()  # numbered as they first occur
        first = np.flatnonzero(np.diff(np.maximum.accumulate(at), prepend=-1))
        return self.keys[first], self.rare(first), np.bincount(at, minlength=len(first))


def words_of(column: pa.Array) -> Iterator[Words]:
    buf, offs = string_bytes(column)
    for i, j in slices(offs):
        part, rel = _LOWER[buf[offs[i] : offs[j]]], offs[i : j + 1] - offs[i]
        s, e, w = word_spans(part, rel)
        yield Words(i, j, part, s, e, w, word_hashes(part, s, e).view(np.int64))


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """A table (key, rare, n) of all words of docs: counted within tasks, then summed by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        added = 0

        def merge() -> None:
            if len(held) > 1:
                coded = pa.array(np.concatenate([h[0] for h in held])).dictionary_encode()
                at = coded.indices.to_numpy()
                first = np.flatnonzero(np.diff(np.maximum.accumulate(at), prepend=-1))
                n = np.bincount(at, weights=np.concatenate([h[2] for h in held])).astype(np.int64)
                held[:] = [(coded.dictionary.to_numpy(), np.concatenate([h[1] for h in held])[first], n)]

        for batch in batches:
            for w in words_of(batch["t"]):
                held.append(w.distinct())
                added += len(held[-1][0])
                if added > max(1 << 18, len(held[0][0])):
                    merge()
                    added = 0
        merge()
        for keys, rare, n in held:
            for a in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(v[a : a + 100_000]) for v in (keys, rare, n)], ["key", "rare", "n"])

    return stage(docs.select(F.col(text).alias("t")).mapInArrow(run, "key long, rare long, n long").groupBy("key", "rare").agg(F.sum("n").alias("n")), "words")


@dataclass
class Model:
    keys: np.ndarray  # of common words, sorted
    number: np.ndarray  # their counts
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # (CLASSES, STATES): P(class | state)

    @cached_property
    def lower(self) -> np.ndarray:
        """For each value of a key's upper bits, the place of the first common word that isn't below it."""
        return np.searchsorted(self.keys >> 64 - BITS, np.arange(-1 << BITS - 1, 1 << BITS - 1))

    @cached_property
    def log(self) -> np.ndarray:
        return np.log10(self.number + 0.5)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place among the common words or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at, last = self.lower[(keys >> 64 - BITS) + (1 << BITS - 1)], len(self.keys) - 1
        below = np.arange(len(keys))
        while len(below):  # few words share their upper bits
            below = below[at[below] <= last]
            below = below[self.keys[at[below]] < keys[below]]
            at[below] += 1
        at = np.minimum(at, last)
        return np.where(self.keys[at] == keys, at, -1)


def _by_length(offs: np.ndarray, tokens: int) -> Iterator[np.ndarray]:
    """Rows in groups of similar lengths, longest first in a group, each of about `tokens` in all."""
    size = np.diff(offs)
    order = np.argsort(-size, kind="stable")
    total = np.concatenate([[0], np.cumsum(size[order])])
    for a, b in slices(total, tokens):
        yield order[a:b]


def _live(size: np.ndarray) -> np.ndarray:
    """How many sequences have a token at each place; size falling."""
    return np.searchsorted(-size, -np.arange(int(size.max(initial=0))), side="left")


def _emissions(seq: np.ndarray, first: np.ndarray, live: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """The classes of the sequences' tokens, those at one place beside each other, and their rows of emit."""
    bound = np.cumsum(live) - live
    at = np.arange(int(live.sum())) - np.repeat(bound, live)
    classes = seq[first[at] + np.repeat(np.arange(len(live)), live)]
    return classes, np.take(m.emit, classes, axis=0)


def forward(seq: np.ndarray, first: np.ndarray, size: np.ndarray, vector: np.ndarray, m: Model, moved: bool) -> tuple[np.ndarray, np.ndarray]:
    """Scaled state vectors after each sequence (size falling) and the natural log of their scales; vector: where each starts, before its first token."""
    vector, scale, live = (vector @ m.move if moved else vector).copy(), np.zeros(len(first)), _live(size)
    _, emit = _emissions(seq, first, live, m)
    ahead, bound = np.empty_like(vector), 0
    for t, n in enumerate(live.tolist()):
        v = vector[:n]
        np.multiply(v if t == 0 else np.dot(v, m.move, out=ahead[:n]), emit[bound : bound + n], out=v)
        bound += n
        if t % SCALED == SCALED - 1:
            c = np.maximum(v @ ONES, 1e-300)
            v /= c[:, None]
            scale[:n] += np.log(c)
    c = np.maximum(vector @ ONES, 1e-300)
    return vector / c[:, None], scale + np.log(c)


@dataclass
class Segments:
    """The segments after the first of rows longer than SEGMENT: row, first token, length, and for each state before it the scaled state vector after it and the log of its scale."""

    row: np.ndarray
    first: np.ndarray
    length: np.ndarray
    vectors: np.ndarray
    scales: np.ndarray

    def step(self, k: int, v: np.ndarray) -> tuple[np.ndarray, float]:
        """The state vector after segment k, from the one before it, and the log of its scale."""
        top = self.scales[k].max()
        v = (v * np.exp(self.scales[k] - top)) @ self.vectors[k]
        c = v.sum()
        return v / c, top + np.log(c)

    def back(self, k: int, beta: np.ndarray) -> np.ndarray:
        """What follows after segment k seen from before it, up to a factor."""
        out = np.exp(self.scales[k] - self.scales[k].max()) * (self.vectors[k] @ beta)
        return out / out.sum()


def segments(seq: np.ndarray, offs: np.ndarray, m: Model) -> Segments:
    size = np.diff(offs)
    long = np.flatnonzero(size > SEGMENT)
    count = -(-size[long] // SEGMENT) - 1
    row = np.repeat(long, count)
    step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + 1
    first = offs[row] + step * SEGMENT
    length = np.minimum(offs[row + 1] - first, SEGMENT)
    vectors, scales = np.zeros((len(row), STATES, STATES)), np.zeros((len(row), STATES))
    for some in _by_length(np.concatenate([[0], np.cumsum(length)]), 1 << 17):
        v, s = forward(seq, np.repeat(first[some], STATES), np.repeat(length[some], STATES), np.tile(np.eye(STATES), (len(some), 1)), m, True)
        vectors[some], scales[some] = v.reshape(-1, STATES, STATES), s.reshape(-1, STATES)
    return Segments(row, first, length, vectors, scales)


def likelihood(seq: np.ndarray, offs: np.ndarray, m: Model) -> np.ndarray:
    """The natural log probability of each row's classes. Of a row longer than SEGMENT, later segments are run from each state and chained."""
    out, size = np.zeros(len(offs) - 1), np.diff(offs)
    last = np.tile(m.start, (len(out), 1))
    for rows in _by_length(np.concatenate([[0], np.cumsum(np.minimum(size, SEGMENT))]), 1 << 20):
        last[rows], out[rows] = forward(seq, offs[rows], np.minimum(size[rows], SEGMENT), last[rows], m, False)
    later = segments(seq, offs, m)
    for k, r in enumerate(later.row.tolist()):
        last[r], more = later.step(k, last[r])
        out[r] += more
    return out


def expected(seq: np.ndarray, offs: np.ndarray, m: Model, emitted: np.ndarray, moved: np.ndarray, begun: np.ndarray) -> None:
    """Adds the expected counts of Baum-Welch over the rows to emitted, moved and begun.

    Rows are worked on in segments; a segment starts from the state vector that the ones before it
    leave, and ends with what the ones after it say, so the counts are those of whole rows.
    """
    size, later = np.diff(offs), segments(seq, offs, m)
    n, k = len(size), len(later.row)
    first, length = np.concatenate([offs[:-1], later.first]), np.concatenate([np.minimum(size, SEGMENT), later.length])
    before, after = np.tile(m.start, (n + k, 1)), np.ones((n + k, STATES))
    if k:
        last = np.tile(m.start, (n, 1))
        rows = np.unique(later.row)
        for some in slices(np.arange(len(rows) + 1) * SEGMENT, GROUP):
            part = rows[slice(*some)]
            last[part], _ = forward(seq, offs[part], np.full(len(part), SEGMENT), last[part], m, False)
        for x, r in enumerate(later.row.tolist()):
            before[n + x] = last[r]
            last[r], _ = later.step(x, last[r])
        beta = np.ones((n, STATES))
        for x in range(k - 1, -1, -1):
            r = later.row[x]
            after[n + x] = beta[r]
            beta[r] = later.back(x, beta[r])
        after[:n] = beta
    for some in _by_length(np.concatenate([[0], np.cumsum(length)]), GROUP):
        some = some[length[some] > 0]
        if not len(some):
            continue
        at, size, goes_on = first[some], length[some], some >= n
        live = _live(size)
        classes, ahead = _emissions(seq, at, live, m)
        bound, live = [0, *np.cumsum(live).tolist()], [*live.tolist(), 0]
        # States before each token, and with the step to it: alpha is the product of the second and the token's emissions.
        origin, predicted = np.empty((2, *ahead.shape))
        origin[: len(some)] = before[some]
        scale: dict[int, np.ndarray] = {}
        for t in range(len(live) - 1):
            a, b, ends = bound[t], bound[t + 1], live[t + 1]
            np.dot(origin[a:b], m.move, out=predicted[a:b])
            if t == 0:
                predicted[:b][~goes_on] = origin[:b][~goes_on]
            v = np.multiply(predicted[a : a + ends], ahead[a : a + ends], out=origin[b : b + ends])
            if t % SCALED == SCALED - 1 and ends:
                scale[t] = np.maximum(v @ ONES, 1e-300)[:, None]
                v /= scale[t]
        # What follows a row's last token, in the scale of the row.
        last = np.array(bound)[size - 1] + np.arange(len(some))
        beta = after[some]
        beta /= np.maximum((predicted[last] * ahead[last] * beta).sum(axis=1), 1e-300)[:, None]
        for t in range(len(live) - 2, -1, -1):
            a, b, ends = bound[t], bound[t + 1], live[t + 1]
            if ends:
                v = np.dot(ahead[b : b + ends], m.move.T, out=beta[:ends])
                if t in scale:
                    v /= scale[t]
            ahead[a:b] *= beta[: b - a]
        moved += (origin[len(some) :].T @ ahead[len(some) :]) * m.move
        into = np.flatnonzero(goes_on)  # the step over the border into a segment
        moved += (origin[into].T @ ahead[into]) * m.move
        predicted *= ahead  # the states of each token: adds up to 1, as beta is in the scale of the row
        begun += predicted[: len(some)][~goes_on].sum(axis=0)
        classes, of = classes.astype(np.intp), np.ascontiguousarray(predicted.T)
        for x in range(STATES):
            emitted[:, x] += np.bincount(classes, weights=of[x], minlength=CLASSES)


def _sequences(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    buf, offs = string_bytes(batch["seq"])
    return buf.view(np.uint16) if len(buf) % 2 == 0 and buf.flags.aligned and buf.ctypes.data % 2 == 0 else np.frombuffer(buf.tobytes(), np.uint16), offs // 2


def _maximise(emitted: np.ndarray, moved: np.ndarray, begun: np.ndarray, whole: np.ndarray, spread: float = 20.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, transition and emission probabilities from expected counts, drawn a little towards even ones and towards all states' emissions."""
    emit = (emitted + spread * whole[:, None]) / (emitted.sum(axis=0) + spread)
    move = moved + 1.0
    return (begun + 1.0) / (begun.sum() + STATES), move / move.sum(axis=1, keepdims=True), emit


def train(seqs: DataFrame, m: Model, whole: np.ndarray, steps: int) -> None:
    """Baum-Welch steps over all rows of seqs; m starts from a few texts drawn by hash and the counts of all."""
    spark = seqs.sparkSession
    # A fixed number of texts, the first by hash among those of some length, tells the states apart at first.
    seeds = seqs.where("length(seq) >= 400").orderBy(F.xxhash64("seq"), "seq").limit(STATES).collect()
    emitted = np.tile(whole[:, None] * 200.0, (1, STATES))
    for k, r in enumerate(seeds):
        emitted[:, k] += np.bincount(np.frombuffer(r["seq"], np.uint16), minlength=CLASSES)
    m.start, m.move, m.emit = _maximise(emitted, np.eye(STATES) * 200.0, np.ones(STATES), whole)
    fields = ", ".join(f"s{k} float" for k in range(STATES))
    for _ in range(steps):
        shared = spark.sparkContext.broadcast(m)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            emitted, moved, begun = np.zeros((CLASSES, STATES)), np.zeros((STATES, STATES)), np.zeros(STATES)
            for batch in batches:
                if batch.num_rows:
                    expected(*_sequences(batch), shared.value, emitted, moved, begun)
            table = np.concatenate([emitted, moved, begun[None, :]]).astype(np.float32)
            at = np.flatnonzero(table.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(table[at, k]) for k in range(STATES))], ["i", *(f"s{k}" for k in range(STATES))])

        sums = seqs.select("seq").mapInArrow(run, f"i long, {fields}").groupBy("i").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(STATES)])
        table = np.zeros((CLASSES + STATES + 1, STATES))
        got = sums.toArrow()  # a row for each class and state
        table[got["i"].to_numpy()] = np.stack([got[f"s{k}"].to_numpy() for k in range(STATES)], axis=1)
        m.start, m.move, m.emit = _maximise(table[:CLASSES], table[CLASSES:-1], table[-1], whole)
        shared.destroy()


def score(docs: DataFrame, held_out: Column, text: str = "text", steps: int = 5, common: int = COMMON) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs, learned from rows that aren't held out.

    Tokens are the words of the text, A-Z lower-cased, and one end. base_score adds, for each token,
    log10((c + 0.5) / (N + 0.5 * (V + 1))). A null text is an empty one and has the end alone. Rows
    with equal or null ids are scored each. Without training rows, classes are equally likely. An empty table gives an empty result.
    """
    docs = docs.select("doc_id", held_out.alias("held_out"), F.col(text).alias("t"))
    train_docs = docs.where(~F.col("held_out"))
    counts = count_words(train_docs, "t")
    n_docs = train_docs.count()
    totals = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n_all, v_all = (totals["n"] or 0) + n_docs, totals["v"] + bool(n_docs)
    # Common words are those of the highest counts: as many bins of a histogram as hold `common` words at most.
    level = F.when(F.col("n") < 1024, F.col("n")).otherwise(F.floor(F.log2("n") * BINS) - (10 * BINS - 1024)).cast("long")
    bins = counts.groupBy(level.alias("bin")).agg(F.count("*").alias("n")).orderBy(F.col("bin").desc()).collect()  # 1024 and BINS for each power of two at most
    least, words = 1 << 62, 0
    for r in bins:
        words += r["n"]
        if words > common:
            break
        least = r["bin"]
    top = counts.where(level >= least).select("key", "n").toArrow()  # `common` rows at most
    order = np.argsort(top["key"].to_numpy())
    keys, number = top["key"].to_numpy()[order], top["n"].to_numpy()[order]
    m = Model(keys, number, *[np.zeros(0)] * 3)
    spark = docs.sparkSession
    rest = counts.where(level < least)
    kinds = rest.groupBy("rare").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("once"))
    total, once = np.zeros(RARE), np.zeros(RARE)
    got = kinds.toArrow()  # RARE rows
    total[got["rare"].to_numpy()], once[got["rare"].to_numpy()] = got["total"].to_numpy(), got["once"].to_numpy()
    new = (once + 0.5) / (total + 1)
    whole = np.zeros(CLASSES)
    whole[: len(number)], whole[COMMON:END], whole[END] = number, total, n_docs
    whole = (whole + 0.5) / (whole + 0.5).sum()

    shared = spark.sparkContext.broadcast(m)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for w in words_of(batch["t"]):
                at, size = m.places(w.keys), np.diff(w.offs)
                hit = at >= 0
                rare = np.flatnonzero(~hit)
                shared_by = w.rare(rare)
                cls = at.copy()
                cls[rare] = COMMON + shared_by
                seq = np.full(len(cls) + len(size), END, np.uint16)
                seq[np.arange(len(cls)) + np.repeat(np.arange(len(size)), size)] = cls
                bounds = w.offs + np.arange(len(w.offs))
                log, known = np.zeros(len(cls) + 1), np.zeros(len(cls) + 1, np.int64)
                np.cumsum(np.append(m.log, 0.0)[at], out=log[1:])
                np.cumsum(hit, out=known[1:])
                # The row's words that aren't common, each with the times it occurs and its rare class.
                row = np.repeat(np.arange(len(size)), size)[rare]
                order = np.lexsort((w.keys[rare], row))
                rare, row, shared_by = rare[order], row[order], shared_by[order]
                new = np.ones(len(rare), bool)
                new[1:] = (row[1:] != row[:-1]) | (w.keys[rare][1:] != w.keys[rare][:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(rare)))
                offs = pa.array(np.searchsorted(row[first], np.arange(len(size) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offs, pa.array(v)) for v in (w.keys[rare[first]], times << 12 | shared_by[first])]
                cols = [batch[c].slice(w.i, w.j - w.i) for c in ("uid", "doc_id", "held_out")]
                sums = [pa.array(size + 1), pa.array(known[w.offs[1:]] - known[w.offs[:-1]]), pa.array(log[w.offs[1:]] - log[w.offs[:-1]])]
                yield pa.RecordBatch.from_arrays([*cols, *sums, pa.array([seq[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()), *lists], ["uid", "doc_id", "held_out", "n_tokens", "known", "log", "seq", "keys", "times"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    # Rows are numbered where they are written; what is rare in them is read from there, so both sides of the join below mean the same rows.
    coded = stage(docs.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(encode, f"uid long, doc_id {kind}, held_out boolean, n_tokens long, known long, log double, seq binary, keys array<long>, times array<long>"), "sequences")
    seqs = coded.drop("keys", "times")
    train(seqs.where(~F.col("held_out")).select("seq"), m, whole, steps)
    # What rare words' counts, or their absence, add to a row doesn't depend on the states.
    found = coded.select("uid", F.explode(F.arrays_zip("keys", "times")).alias("w")).select("uid", F.col("w.keys").alias("key"), F.col("w.times").alias("times")).join(rest.select("key", "n"), "key", "left")
    log_new = spark.createDataFrame(pa.table({"rare": np.arange(RARE), "new": np.log10(new), "old": np.log10(1 - new) - np.log10(np.maximum(total, 1))}))
    by_row = found.select("uid", "times", F.coalesce("n", F.lit(0)).alias("n"))
    by_row = by_row.withColumn("rare", F.expr("times & 4095")).withColumn("times", F.expr("shiftright(times, 12)")).join(F.broadcast(log_new), "rare")  # RARE rows
    inside = F.when(F.col("n") > 0, F.log10(F.col("n")) + F.col("old")).otherwise(F.col("new"))
    added = by_row.groupBy("uid").agg(F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("n") + 0.5)).alias("rare_log"), F.sum(F.col("times") * inside).alias("rare_inside"))
    final = spark.sparkContext.broadcast(m)  # CLASSES x STATES numbers

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = likelihood(*_sequences(batch), final.value) / np.log(10) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("uid", "doc_id", "held_out", "n_tokens", "known", "log")), pa.array(value)], ["uid", "doc_id", "held_out", "n_tokens", "known", "log", "states"])

    judged = seqs.mapInArrow(judge, f"uid long, doc_id {kind}, held_out boolean, n_tokens long, known long, log double, states double").join(added, "uid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    scale = float(np.log10(n_all + 0.5 * (v_all + 1)))
    base = F.col("log") + zero("rare_log") + float(np.log10(n_docs + 0.5)) - F.col("n_tokens") * F.lit(scale)
    return judged.select("doc_id", "held_out", "n_tokens", (F.col("known") + zero("rare_known") + int(n_docs > 0)).cast("long").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("states") + zero("rare_inside")).alias("score"))
