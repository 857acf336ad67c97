"""Language identification by bit-sliced Bloom filters of character n-grams.

One table of m positions holds, at each position, a bit mask over the learned languages. An n-gram
sets its languages' bits at k positions; the AND of the k masks is the set of languages that hold
it (up to false positives, whose rate is known for each language from the share of its bits that
are set). A text's hits are counted per language, corrected for false positives, and decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import stage
from millrace.llm.text import mix, slices, string_bytes

LETTER = r"\pL"
UNKNOWN = "und"
MASK_BITS = 63
BLOCK = 4096
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)


def grams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices of rows i to j: the 4-byte n-grams of the lower-cased texts, as uint32, and the rows' offsets.

    ASCII bytes other than letters count as a space, runs of spaces as one; a text has a space at each end.
    """
    space, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    padded = pc.binary_join_element_wise(space, pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")), space, none)
    buf, offs = string_bytes(padded)
    for i, j in slices(offs):
        part, rel = _FOLD[buf[offs[i] : offs[j]]], offs[i : j + 1] - offs[i]
        space = part == 0x20
        keep = np.ones(len(part), bool)
        keep[1:] = ~(space[1:] & space[:-1])
        keep[rel[:-1]] = True
        at = np.zeros(len(part) + 1, np.int64)
        np.cumsum(keep, out=at[1:])
        rel, b = at[rel], part[keep].astype(np.uint32)
        if len(b) < 4:
            yield i, j, np.zeros(0, np.uint32), np.zeros(j - i + 1, np.int64)
            continue
        code = b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24
        sizes = np.maximum(np.diff(rel) - 3, 0)
        out = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=out[1:])
        valid = np.ones(len(b), bool)
        for back in range(1, 4):
            ends = rel[1:] - back
            valid[ends[ends >= 0]] = False
        short = np.flatnonzero(np.diff(rel) < 4)
        for x in short:
            valid[rel[x] : rel[x + 1]] = False
        yield i, j, code[valid[: len(code)]], out


def positions(codes: np.ndarray, j: int, m: int) -> np.ndarray:
    return (mix(codes.astype(np.uint64), j + 1) % np.uint64(m)).astype(np.int64)


@dataclass
class LanguageFilter:
    """The fitted table: masks[w, position] for languages 63*w to 63*w+62; fill: share of set bits by language."""

    langs: list[str]
    masks: np.ndarray
    fill: np.ndarray
    hashes: int
    most: int

    def hits(self, codes: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """The number of n-grams of each row that each language holds."""
        n, out = len(offs) - 1, np.zeros((len(offs) - 1, len(self.langs)))
        at = [positions(codes, j, self.masks.shape[1]) for j in range(self.hashes)]
        row = np.repeat(np.arange(n), np.diff(offs))
        for w in range(self.masks.shape[0]):
            found = self.masks[w][at[0]]
            for p in at[1:]:
                found &= self.masks[w][p]
            for x in range(w * MASK_BITS, min((w + 1) * MASK_BITS, len(self.langs))):
                out[:, x] = np.bincount(row[(found >> np.uint64(x % MASK_BITS) & np.uint64(1)).astype(bool)], minlength=n)
        return out

    def decide(self, codes: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the language and the score of each row: the share of the best language among the corrected hits' two best, times the share of n-grams that it holds."""
        total = np.diff(offs).astype(float)[:, None]
        wrong = np.minimum(self.fill**self.hashes, 0.99)[None, :]
        own = np.clip((self.hits(codes, offs) - total * wrong) / (1 - wrong), 0, None)
        own = np.minimum(own / np.maximum(total, 1), 1.0)
        best = np.argmax(own, axis=1)
        top = own[np.arange(len(own)), best]
        best[top <= 0] = self.most
        rest = own.copy()
        rest[np.arange(len(own)), best] = 0
        second = rest.max(axis=1, initial=0)
        share = np.divide(top, top + second, out=np.zeros_like(top), where=top > 0)
        return best, share * np.sqrt(top)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", positions_log2: int = 21, hashes: int = 3, ratio: float = 0.5, least: int = 2) -> LanguageFilter:
    """Learns a LanguageFilter from all rows with a language.

    N-grams are counted within tasks, then summed by (n-gram, language). A language holds an n-gram
    that occurs at least `least` times in it and whose relative frequency there is at least `ratio`
    times its highest in any language, so a few foreign passages do not blur the sets. What reaches
    the driver is the table alone: 2**positions_log2 masks, whatever the input's size.
    """
    spark, m = docs.sparkSession, 1 << positions_log2
    pairs = docs.where(F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merge() -> None:
            if held:
                keys, where = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
                sums = np.bincount(where, weights=np.concatenate([c for _, c in held])).astype(np.int64)
                held[:] = [(keys, sums)]

        for batch in batches:
            own = np.array([names.setdefault(x, len(names)) for x in batch["l"].to_pylist()], np.uint64)
            for i, j, codes, offs in grams(batch["t"]):
                held.append(np.unique(np.repeat(own[i:j], np.diff(offs)) << np.uint64(32) | codes, return_counts=True))
                if len(held) >= 24:
                    merge()
        merge()
        if held and len(held[0][0]):
            keys, sums = held[0]
            inverse = pa.array(list(names), pa.string())
            for a in range(0, len(keys), 100_000):
                k = keys[a : a + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((k & np.uint64(0xFFFFFFFF)).astype(np.int64)), inverse.take(pa.array((k >> np.uint64(32)).astype(np.int64))), pa.array(sums[a : a + 100_000])], ["gram", "l", "n"]
                )

    counts = pairs.mapInArrow(count, "gram long, l string, n long").groupBy("gram", "l").agg(F.sum("n").alias("n"))
    learned = {r["l"]: r["n"] for r in pairs.groupBy("l").agg(F.count("*").alias("n")).collect()}  # one row per language
    langs = sorted(learned)
    if not langs:
        return LanguageFilter([], np.zeros((1, m), np.uint64), np.zeros(0), hashes, 0)
    index = F.create_map(*[F.lit(x) for p in ((l, i) for i, l in enumerate(langs)) for x in p])
    counts = stage(counts.withColumn("i", index[F.col("l")]).select("gram", "i", "n"), "grams")
    totals = {r["i"]: r["n"] for r in counts.groupBy("i").agg(F.sum("n").alias("n")).collect()}  # one row per language
    total = F.create_map(*[F.lit(x) for p in ((i, float(n)) for i, n in totals.items()) for x in p]) if totals else F.create_map(F.lit(0), F.lit(1.0))
    best = W.partitionBy("gram")
    rate = counts.withColumn("p", F.col("n") / total[F.col("i")])
    held = (
        rate.withColumn("top", F.max("p").over(best))
        .where((F.col("p") >= ratio * F.col("top")) & (F.col("n") >= least))
        .withColumn("w", F.floor(F.col("i") / MASK_BITS).cast("int"))
        .groupBy("gram", "w").agg(F.bit_or(F.expr(f"shiftleft(1L, i % {MASK_BITS})")).alias("mask"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = batch["gram"].to_numpy().astype(np.uint64)
            for j in range(hashes):
                yield pa.RecordBatch.from_arrays([pa.array(positions(g, j, m)), batch["w"], batch["mask"]], ["at", "w", "mask"])

    def pack(table: pa.Table) -> pa.Table:
        at, out = table["at"].to_numpy(), np.zeros(BLOCK, np.int64)
        out[at % BLOCK] = table["mask"].to_numpy()
        return pa.table({"b": [int(at[0]) // BLOCK], "w": [table["w"][0].as_py()], "masks": [out.tobytes()]}, pa.schema([("b", pa.int64()), ("w", pa.int32()), ("masks", pa.binary())]))

    sliced = held.mapInArrow(place, "at long, w int, mask long").groupBy("at", "w").agg(F.bit_or("mask").alias("mask"))
    blocks = sliced.withColumn("b", F.floor(F.col("at") / BLOCK)).groupBy("b", "w").applyInArrow(pack, "b long, w int, masks binary")
    masks = np.zeros((-(-len(langs) // MASK_BITS), m), np.uint64)
    for r in blocks.collect():  # m / BLOCK rows for each 63 languages
        masks[r["w"], r["b"] * BLOCK : (r["b"] + 1) * BLOCK] = np.frombuffer(r["masks"], np.uint64)
    fill = np.array([(masks[i // MASK_BITS] >> np.uint64(i % MASK_BITS) & np.uint64(1)).mean() for i in range(len(langs))])
    return LanguageFilter(langs, masks, fill, hashes, langs.index(max(langs, key=lambda x: (learned[x], x))))


def predict(docs: DataFrame, model: LanguageFilter, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds the language and the score to every row of docs, under these names; columns that have them are replaced.

    A null text, or one without a letter, gets `und` and score 0, as does every text if no language
    was learned. A text none of whose n-grams is known gets the most frequent language, score 0.
    """
    docs = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by its number of positions
    at = docs.columns.index(text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        all_langs = np.array([*model.langs, UNKNOWN], object)
        for batch in batches:
            best, sure = np.full(batch.num_rows, len(model.langs)), np.zeros(batch.num_rows)
            if model.langs:
                for i, j, codes, offs in grams(batch.column(at)):
                    best[i:j], sure[i:j] = model.decide(codes, offs)
                dumb = ~pc.fill_null(pc.match_substring_regex(batch.column(at), LETTER), False).to_numpy(zero_copy_only=False)
                best[dumb], sure[dumb] = len(model.langs), 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(all_langs[best], pa.string()), pa.array(sure)], [*batch.schema.names, *names])

    return docs.mapInArrow(score, docs.select("*", F.lit("").alias(names[0]), F.lit(0.0).alias(names[1])).schema)
