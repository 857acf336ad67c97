"""Collocations by vertical positional lists.

Documents are taken in slices; a slice holds an inverted file: for each word (of a language) the
positions where it occurs, in order, with a position left out between pieces, so that neighbours
in a text, and only they, have neighbouring positions. Phrases grow by a word at a time. An
occurrence of a frequent phrase is merge-joined, by position, with the lists of what stands one word
later: the phrase that shares all its words but the first, whose last is the adjacent word. Where
that isn't frequent, the longer phrase can't be. What comes out are the lists of longer phrases; a
list's length is how often the phrase occurs in the slice, and only lengths leave it, packed: phrases
are dealt into buckets by a hash of their two parts, and a slice's lists of a bucket are one row. A
bucket's lengths are added up over all slices by the two parts, which name a phrase exactly: words are
told apart by their text, longer phrases by the numbers of their parts, never by a hash. Each slice gets
back the numbers of its frequent phrases, packed as well (marks).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import small_batches, stage
from millrace.llm.text import U, mix, string_bytes
from millrace.storage import Scratch

TOKENS = 1 << 21
#: Lists that a bucket has at most, on average: one is unpacked at a time in a task.
LISTS = 1 << 20
# A number of a phrase is its slice's and its place there; a slice's is its task's and its place there.
PLACES, SLICES, TASKS = 26, 12, 25
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# 1 parts words, 2 parts pieces as well.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2


def packed(*columns: np.ndarray) -> bytes:
    """Columns of one length, compressed; the first bytes of a column's numbers stand together, then their second ones and so on, as most of the higher ones are 0."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.ravel() for c in columns]
    return pa.Codec("zstd").compress(np.concatenate(planes).data, asbytes=True)


def unpacked(data: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    planes = np.frombuffer(pa.Codec("zstd").decompress(data, n * sum(sizes), asbytes=True), np.uint8)
    parts = np.split(planes, np.cumsum(sizes)[:-1] * n)
    return [np.ascontiguousarray(p.reshape(size, n).T).view(k).ravel() for p, size, k in zip(parts, sizes, kinds, strict=True)]


def steps(ascending: np.ndarray, kind: str = "<i4") -> np.ndarray:
    return np.diff(ascending, prepend=0).astype(kind)


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of a batch of texts, lower-cased, the row of each and its position: one more than the last word's in the same piece, else two more."""
    buf, offs = string_bytes(column)
    buf = _LOWER[buf]
    kind = _KIND[buf]
    full = kind == 0
    first = np.zeros(len(buf) + 1, bool)
    first[offs] = True
    first = first[:-1]
    start = full & (first | np.append(True, ~full[:-1])[: len(full)])
    at = np.flatnonzero(start)
    # A word ends where the next one starts or where it is parted from it.
    inside = np.append(np.flatnonzero(full), len(buf))
    begin = np.searchsorted(inside[:-1], at)
    offsets = np.append(begin, len(inside) - 1).astype(np.int64)
    data = buf[full]
    words = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
    row = np.searchsorted(offs, at, side="right") - 1
    piece = np.cumsum(kind == 2)[at] if len(at) else np.zeros(0, np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (piece[1:] != piece[:-1]) | (row[1:] != row[:-1])
    return words, row, np.arange(len(at)) + np.cumsum(new)


def postings(docs: DataFrame, text: str, lang: str, tokens: int) -> DataFrame:
    """A row for each slice: its words with their languages, how often each occurs (n), and all their positions, list after list (packed). A slice ends with the text that brings it to `tokens` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        langs: dict[str, int] = {}
        task, made, size, end = TaskContext.get().partitionId(), 0, 0, 0

        def closed() -> pa.RecordBatch:
            if made >> SLICES or task >> TASKS:
                raise ValueError("more slices than numbers for them")
            coded = pa.concat_arrays([h[0] for h in held]).dictionary_encode()
            code = coded.indices.to_numpy().astype(np.int64) * len(langs) + np.concatenate([h[1] for h in held])
            kinds, which, n = np.unique(code, return_inverse=True, return_counts=True)
            positions = np.concatenate([h[2] for h in held])[np.argsort(which, kind="stable")]
            names, one = pa.array(list(langs)), lambda a: pa.array([a.to_pylist()], pa.list_(pa.string()))
            columns = [pa.array([task << SLICES | made]), one(names.take(pa.array(kinds % len(langs)))), one(coded.dictionary.take(pa.array(kinds // len(langs)))), pa.array([n.astype(np.int32)], pa.list_(pa.int32())), pa.array([packed(steps(positions))], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["slice", "lang", "word", "n", "positions"])

        for batch in batches:
            if not batch.num_rows:
                continue
            words, row, at = words_of(batch["t"])
            if not len(words):
                continue
            of = np.array([langs.setdefault(x, len(langs)) for x in batch["lang"].to_pylist()])
            held.append((words, of[row], at + end))
            size, end = size + len(words), end + int(at[-1]) + 1
            if size >= tokens:
                yield closed()
                held, langs, size, end, made = [], {}, 0, 0, made + 1
        if held:
            yield closed()

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("t"))
    return rows.mapInArrow(run, "slice long, lang array<string>, word array<string>, n array<int>, positions binary")


LENGTHS, MARKS = ("<i4", "<i8", "<i8", "<i4"), ("<i4", "<i8")
MARKED = "slice long, level int, m int, marks binary"


def marked(words: pa.Table) -> pa.Table:
    """The marks of a slice's frequent words (slice, j, id): how many (m), their places (steps) and numbers, packed."""
    words = words.sort_by("j")
    data = packed(steps(words["j"].to_numpy()), words["id"].to_numpy())
    return pa.table({"slice": words["slice"][:1], "level": pa.array([1], pa.int32()), "m": pa.array([len(words)], pa.int32()), "marks": pa.array([data], pa.binary())})


def grown(length: int, buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For a slice and the marks of its frequent phrases of fewer words: the phrases of `length` words in rows of a bucket each, how many it has (m) and, packed, their places in the slice (steps), prefixes (steps) and suffixes (numbers of their parts), and the lengths of their lists."""

    def run(files: pa.Table, frequent: pa.Table) -> pa.Table:
        marks = [frequent[c].to_pylist() for c in ("level", "m", "marks")]

        def numbers(k: int, n: int) -> np.ndarray:
            out = np.full(n, -1)
            for level, m, data in zip(*marks, strict=True):
                if level == k:
                    j, ids = unpacked(data, m, *MARKS)
                    out[np.cumsum(j)] = ids
            return out

        if not files.num_rows:  # a slice is never without its file
            raise ValueError("phrases of an unknown slice")
        n = files["n"].combine_chunks().flatten().to_numpy()
        at, own = np.cumsum(unpacked(files["positions"][0].as_py(), int(n.sum()), "<i4")[0], dtype=np.int32), np.repeat(numbers(1, len(n)), n)
        for k in range(2, length + 1):
            at, own = at[own >= 0], own[own >= 0]
            if k == 2:
                order = np.argsort(at)
                at, own = at[order], own[order]
            after = np.minimum(np.searchsorted(at, at + 1), max(len(at) - 1, 0))
            meet = at[after] == at + 1
            before, (a, left), (b, right) = at[meet], np.unique(own[meet], return_inverse=True), np.unique(own[after[meet]], return_inverse=True)
            kinds, which, n = np.unique(left * max(len(b), 1) + right, return_inverse=True, return_counts=True)
            if k < length:
                at, own = before, numbers(k, len(kinds))[which]
        if len(n) >> PLACES:
            raise ValueError("more phrases in a slice than numbers for them")
        prefix, suffix = a[kinds // max(len(b), 1)], b[kinds % max(len(b), 1)]
        bucket = mix(prefix.view(U) ^ mix(suffix.view(U))) % U(buckets)
        order = np.argsort(bucket.astype(np.uint16 if buckets <= 1 << 16 else np.uint32), kind="stable")
        ends = np.cumsum(np.bincount(bucket.astype(np.int64), minlength=buckets))
        rows = []
        for k in np.flatnonzero(np.diff(ends, prepend=0)).tolist():
            x = order[ends[k - 1] if k else 0 : ends[k]]  # ascending, and so are their prefixes
            rows.append((k, len(x), packed(steps(x), steps(prefix[x], "<i8"), suffix[x], n[x].astype("<i4"))))
        number, m, data = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table({"bucket": pa.array(number, pa.int32()), "slice": pa.array([files["slice"][0].as_py()] * len(rows), pa.int64()), "m": pa.array(m, pa.int32()), "lists": pa.array(data, pa.binary())})

    return run


def counted(least: int, level: int) -> Callable[[pa.Table], pa.Table]:
    """For a bucket of `grown`: a row for each slice that has frequent phrases of it (`least` times or more in all slices), with their marks. A phrase's number (id) is its first place; that place's row has id, f (how often), prefix and suffix of such phrases."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("slice")
        parts = []
        for number, m, data in zip(*(rows[c].to_pylist() for c in ("slice", "m", "lists")), strict=True):
            j, prefix, suffix, n = unpacked(data, m, *LENGTHS)
            parts.append((np.cumsum(j, dtype=np.int64) + (number << PLACES), np.cumsum(prefix), suffix, n))
        place, prefix, suffix, n = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((suffix, prefix))  # places of a phrase stay in order
        new = np.append(True, (np.diff(prefix[order]) != 0) | (np.diff(suffix[order]) != 0))
        first = np.flatnonzero(new)
        f = np.add.reduceat(n[order].astype(np.int64), first)
        of = np.cumsum(new) - 1
        ids, total = np.empty(len(place), np.int64), np.empty(len(place), np.int64)
        ids[order], total[order] = place[order[first]][of], f[of]
        x = np.flatnonzero(total >= least)  # by place, as parts are
        names = x[ids[x] == place[x]]
        bounds = np.cumsum([0, *(len(p[0]) for p in parts)])
        at, named_at = np.searchsorted(x, bounds), np.searchsorted(names, bounds)
        some = np.flatnonzero(np.diff(at))
        marks = [packed(steps(place[x[at[k] : at[k + 1]]] & ((1 << PLACES) - 1)), ids[x[at[k] : at[k + 1]]]) for k in some.tolist()]
        offsets = pa.array(np.append(named_at[some], len(names)).astype(np.int32))
        lists = {c: pa.ListArray.from_arrays(offsets, pa.array(v[names])) for c, v in (("id", ids), ("f", total), ("prefix", prefix), ("suffix", suffix))}
        return pa.table({"slice": rows["slice"].take(pa.array(some)), "level": np.full(len(some), level, np.int32), "m": np.diff(at)[some].astype(np.int32), "marks": pa.array(marks, pa.binary()), **lists})

    return run


def frequent(lists: DataFrame, key: list[str], least: int) -> DataFrame:
    """The lists (place, key, n) of words that occur `least` times or more in all slices, with their slice and j (their place in it) and id, a number: that of the first place where the word has a list. That place's row has names, and it alone f (how often) and the key. There is a list for each slice at most."""
    whole = W.partitionBy(*key)
    rows = lists.withColumn("f", F.sum("n").over(whole)).withColumn("id", F.min("place").over(whole)).where(F.col("f") >= least)
    j = F.col("place").bitwiseAND((1 << PLACES) - 1).cast("int")
    named = F.col("id") == F.col("place")
    return rows.select(F.shiftright("place", PLACES).alias("slice"), j.alias("j"), "id", named.alias("names"), *[F.when(named, F.col(c)).alias(c) for c in ("f", *key)])


def decimal(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def named(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """id, f, prefix, suffix of phrases with lang, text, last (word), heads and tails: how often their first 1, 2, ... and their last 1, 2, ... words occur."""
    first = parts.select(F.col("id").alias("prefix"), "lang", F.col("text").alias("t"), F.array_append("heads", F.col("f")).alias("heads"))
    rest = parts.select(F.col("id").alias("suffix"), "last", F.array_append("tails", F.col("f")).alias("tails"))
    return rows.join(first, "prefix").join(rest, "suffix").select("id", "f", "prefix", "suffix", "lang", F.concat_ws(" ", "t", "last").alias("text"), "last", "heads", "tails")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, longest: int = 4, top: int = 2000, tokens: int = TOKENS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the first `top` phrases of each language.

    A-Z count as a-z. Texts are split at .,;:!? and line ends into pieces, those at blanks and tabs
    into words; a phrase is 2 to `longest` words that follow each other in a piece and occur (a)
    `least` times or more, overlaps counted. Each way to cut it after its first words has l and r,
    how often both parts occur, and the score floor(2000000 a / (l + r)); the least counts, of equal
    ones that with the shortest first part. Phrases inside a longer one that occurs at least 80 % as
    often are left out. Order: score, then a, both descending, then the phrase by its bytes. n is
    the number of words of the language.

    A null text is empty, a null language is `und`. Repeated rows count as often as they occur; an
    empty table gives an empty result; other columns take no part. Texts of any length are taken
    whole, one task holds one of them at a time beside its open slice.
    """
    small_batches(docs.sparkSession)
    with Scratch() as scratch:
        with Scratch() as counting:
            files = stage(postings(docs, text, lang, tokens), "postings")
            words = files.select("slice", F.posexplode(F.arrays_zip("lang", "word", "n")).alias("j", "w"))
            words = words.select((F.shiftleft("slice", PLACES) + F.col("j")).alias("place"), "w.lang", "w.word", "w.n")
            totals = counting.keep(scratch.keep(stage(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")))
            known = counting.keep(stage(frequent(words, ["lang", "word"], least), "frequent1"))
            files = counting.keep(stage(files.select("slice", "n", "positions"), "lists"))
        none = F.array().cast("array<long>")
        levels = [known.where("names").select("id", "f", "lang", F.col("word").alias("text"), F.col("word").alias("last"), none.alias("heads"), none.alias("tails"))]
        marks, phrases = stage(known.select("slice", "j", "id").groupBy("slice").applyInArrow(marked, MARKED), "marks1"), []
        # No more lists than words.
        buckets = -(-(totals.agg(F.sum("n")).first()[0] or 1) // LISTS)
        for k in range(2, longest + 1):
            lists = files.groupBy("slice").cogroup(marks.groupBy("slice")).applyInArrow(grown(k, buckets), "bucket int, slice long, m int, lists binary")
            known = stage(lists.groupBy("bucket").applyInArrow(counted(least, k), f"{MARKED}, id array<long>, f array<long>, prefix array<long>, suffix array<long>"), f"frequent{k}")
            marks = marks.unionByName(known.select("slice", "level", "m", "marks"))
            found = known.select(F.explode(F.arrays_zip("id", "f", "prefix", "suffix")).alias("p")).select("p.*")
            levels.append(stage(named(found, levels[-1]), f"phrases{k}"))
            phrases.append(levels[-1])
        out = None
        for k, rows in enumerate(phrases, 2):
            a = F.col("f")
            cuts = []
            for m in range(1, k):
                before, after = F.col("heads")[m - 1], F.col("tails")[k - m - 1]
                both = decimal(before) + decimal(after)
                score = F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * decimal(a), both)
                cuts.append(F.struct(score.alias("score"), F.lit(m).alias("m"), before.alias("l"), after.alias("r")))
            if k < longest:
                longer = phrases[k - 1].select(F.explode(F.array("prefix", "suffix")).alias("id"), F.col("f").alias("more")).groupBy("id").agg(F.max("more").alias("more"))
                rows = rows.join(longer, "id", "left").where(F.col("more").isNull() | (decimal("more") * 100 < decimal(a) * 80))
            best = rows.select("lang", F.col("text").alias("phrase"), a.alias("a"), F.array_min(F.array(*cuts)).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
            out = best if out is None else out.unionByName(best)
        order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        first = scratch.keep(stage(out.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top), "first"))
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
