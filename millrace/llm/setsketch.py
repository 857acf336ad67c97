"""Near duplicates by SetSketch registers.

A text's set is that of its runs of two words. Register i keeps, on an exponential scale of base B,
the least value that hash function i (exponential, of rate A) gives to any element, truncated to a
byte: the register-wise maximum of two sketches is the sketch of the union, and the more alike two
sets are, the more of their registers are equal. Bands of registers are the buckets. How alike two
sets are is judged jointly: for a pair, the numbers of registers that are larger, smaller and equal,
with the sizes of both sets, have a likelihood that is concave in the Jaccard similarity, so the
estimate is at least t where its slope at t isn't negative. What passes is verified on whole sets.

Only components are asked for, so a group of near copies isn't compared pair by pair. First each
set is held against one other, the least set of the bucket that it shares most often. Then a bucket
compares sets of different components only; a bucket of one component has nothing to compare, and
one with a large component is dealt in parts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import identified, small_batches, stage
from millrace.llm.ngram_join import components, overlaps, pairs, whole_buckets
from millrace.llm.text import U, mix, shingle_hashes, slices, string_bytes, word_hashes, word_spans
from millrace.storage import Scratch

BASE, RATE, TOP = 1.1, 20.0, 255
ROWS = 6
BLOCK = 512
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOG, _PART = math.log(BASE), (BASE - 1) / BASE


def differ(x: float | np.ndarray) -> float | np.ndarray:
    """The probability that a register is larger in one set, where x is the share of the union that only that set has."""
    return -np.log1p(-x * _PART) / _LOG


def bands_for(recall: float, similarity: float, rows: int = ROWS) -> int:
    """Bands after which a pair at the similarity, of whatever sizes, has shared one with probability `recall`."""
    equal = min(1 - 2 * differ((1 - similarity) / 2), 1 - differ(1 - similarity))
    return max(1, math.ceil(math.log(1 - recall) / math.log1p(-(equal**rows))))


def salts(m: int) -> np.ndarray:
    return mix(np.arange(m, dtype=U), 1313) | U(1)


def registers(hashes: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """Registers of the sets of hashes that start at `at`, none of them empty: (sets, m) bytes."""
    low = np.empty((len(at), m), np.float64)
    for c, salt in enumerate(salts(m)):
        low[:, c] = np.minimum.reduceat(hashes * salt, at)
    with np.errstate(divide="ignore"):
        value = -np.log1p(-(low + 0.5) / 2.0**64) / RATE
        return np.clip(np.floor(1 - np.log(value) / _LOG), 0, TOP).astype(np.uint8)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the unions."""
    return np.maximum(a, b)


def cardinality(regs: np.ndarray) -> np.ndarray:
    """Estimated sizes of the sets with these registers."""
    return regs.shape[1] * _PART / (RATE * _LOG * (BASE ** -regs.astype(float)).sum(axis=1))


def slope(more: np.ndarray, fewer: np.ndarray, equal: np.ndarray, n: np.ndarray, k: np.ndarray, t: float) -> np.ndarray:
    """The slope at similarity t of the log-likelihood of pairs of sets of sizes n and k, with so many registers larger, smaller and equal. t is less than both n/k and k/n."""
    u, v = n / (n + k), k / (n + k)
    x, y = u - v * t, v - u * t
    rate = lambda z: _PART / ((1 - z * _PART) * _LOG)
    p, q = differ(x), differ(y)
    return equal * (v * rate(x) + u * rate(y)) / (1 - p - q) - more * v * rate(x) / p - fewer * u * rate(y) / q


def likely(regs: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray, t: float) -> np.ndarray:
    """Whether the estimated similarity of sets x and y is t or more."""
    a, b = regs[x], regs[y]
    equal = (a == b).sum(axis=1)
    more = (a > b).sum(axis=1)
    return slope(more, regs.shape[1] - equal - more, equal, n[x], n[y], t) >= 0


def shingles(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices of rows i to j: the distinct shingle hashes of each row in order, and their offsets."""
    buf, offs = string_bytes(column)
    for i, j in slices(offs):
        part, rel = _LOWER[buf[offs[i] : offs[j]]], offs[i : j + 1] - offs[i]
        s, e, w = word_spans(part, rel)
        h, at = shingle_hashes(word_hashes(part, s, e), w, k)
        rows = np.repeat(np.arange(j - i), np.diff(at))
        order = np.lexsort((h, rows))
        h, rows = h[order], rows[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
        yield i, j, h[new], np.searchsorted(rows[new], np.arange(j - i + 1))


def describe(docs: DataFrame, text: str, m: int, k: int) -> DataFrame:
    """uid, doc_id, n (size of the set), key and regs (null for an empty set) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, h, at in shingles(batch["t"], k):
                n = np.diff(at)
                full = np.flatnonzero(n)
                keys, regs = [None] * (j - i), [None] * (j - i)
                if len(full):
                    sums = np.stack([np.add.reduceat(mix(h, 901 + c), at[full]) for c in range(2)], axis=1)
                    for r, key, reg in zip(full.tolist(), sums, registers(h, at[full], m), strict=True):
                        keys[r], regs[r] = key.tobytes(), reg.tobytes()
                yield pa.RecordBatch.from_arrays([batch["uid"].slice(i, j - i), batch["doc_id"].slice(i, j - i), pa.array(n), pa.array(keys, pa.binary()), pa.array(regs, pa.binary())], ["uid", "doc_id", "n", "key", "regs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("uid", "doc_id", F.col(text).alias("t")).mapInArrow(run, f"uid long, doc_id {kind}, n long, key binary, regs binary")


def _registers(t: pa.Table | pa.RecordBatch, m: int) -> np.ndarray:
    return np.frombuffer(b"".join(t["regs"].to_pylist()), np.uint8).reshape(-1, m)


def buckets(nodes: DataFrame, bands: int, rows: int) -> DataFrame:
    """(bucket, band, node) for each band of each node's registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regs = _registers(batch, bands * rows)
            for b in range(bands):
                h = np.full(len(regs), b, U)
                for c in range(b * rows, (b + 1) * rows):
                    h = mix(h * U(257) + regs[:, c].astype(U), 31)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(regs), b, np.int32)), batch["node"]], ["bucket", "band", "node"])

    return nodes.select("node", "regs").mapInArrow(run, "bucket long, band int, node long")


def close(dealt: DataFrame, similarity: float, m: int, rows: int) -> DataFrame:
    """The rows (bucket, side, node, part) that may have a link in their bucket with a row of another part. dealt: those with band, n and regs; where band isn't null, a pair counts in the first band it shares."""
    least = similarity - 4 * math.sqrt(similarity * (1 - similarity) / m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_buckets(batches, 1 << 15):
            bucket, side, node, part, n = (t[c].to_numpy() for c in ("bucket", "side", "node", "part", "n"))
            band = t["band"].fill_null(-1).to_numpy()
            regs, found = _registers(t, m), np.zeros(t.num_rows, bool)
            for x, y in pairs(bucket, side):
                fit = (part[x] != part[y]) & (np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y]) - 1e-6)
                for a in range(0, len(x), 16384):
                    p, q = x[a : a + 16384][fit[a : a + 16384]], y[a : a + 16384][fit[a : a + 16384]]
                    ok = likely(regs, n, p, q, least)
                    p, q = p[ok], q[ok]
                    if len(p):
                        same = (regs[p] == regs[q]).reshape(len(p), -1, rows).all(axis=2)
                        ok = (band[p] < 0) | (same.argmax(axis=1) == band[p])
                        found[p[ok]] = found[q[ok]] = True
            at = np.flatnonzero(found)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(v[at]) for v in (bucket, side, node, part)], ["bucket", "side", "node", "part"])

    return dealt.repartition("bucket").sortWithinPartitions("bucket", "side").mapInArrow(run, "bucket long, side int, node long, part long")


def verified(found: DataFrame, similarity: float) -> DataFrame:
    """(node, root) edges that hold together what is linked: found are rows of `close` with set."""
    hundredths = round(similarity * 1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_buckets(batches, 512):
            bucket, side, node, part = (t[c].to_numpy() for c in ("bucket", "side", "node", "part"))
            sets = [np.frombuffer(s, U) for s in t["set"].to_pylist()]
            size = np.array(list(map(len, sets)))
            starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            out: list[tuple[np.ndarray, np.ndarray]] = []
            for a, b in zip(starts, np.append(starts[1:], len(bucket)), strict=True):
                s, n, names = side[a:b], size[a:b], node[a:b]
                if (s == 1).sum() == 1:  # one against all others
                    hub = int(np.flatnonzero(s == 1)[0])
                    spot = [np.minimum(np.searchsorted(sets[a + hub], x), n[hub] - 1) for x in sets[a:b]]
                    both = np.array([(sets[a + hub][i] == x).sum() for i, x in zip(spot, sets[a:b], strict=True)])
                    linked = (both * 1000 >= hundredths * (n + n[hub] - both)) & (s != 1)
                    y = np.flatnonzero(linked)
                    out.append((names[y], np.full(len(y), names[hub])))
                    continue
                both = overlaps(sets[a:b])
                other = (part[a:b, None] != part[None, a:b]) & ((s[:, None] != s[None, :]) | (s == 0)[:, None])
                linked = (both * 1000 >= hundredths * (n[:, None] + n[None, :] - both)) & other
                x, y = np.nonzero(np.triu(linked, 1))
                label = np.arange(b - a)
                while True:
                    was = label.copy()
                    np.minimum.at(label, x, label[y])
                    np.minimum.at(label, y, label[x])
                    label = label[label]
                    if (was == label).all():
                        break
                touched = np.flatnonzero(label != np.arange(b - a))
                out.append((names[touched], names[label[touched]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["node", "root"])

    return found.repartition("bucket").sortWithinPartitions("bucket", "side").mapInArrow(run, "node long, root long")


def favourites(members: DataFrame, block: int) -> DataFrame:
    """bucket, side and node of stars: each node (side 2) with the least node (side 1) of the buckets that it shares with one node most often; a star's members are dealt in parts."""
    least = members.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").select("bucket", "hub")
    shared = members.join(least, "bucket").where("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("c"))
    one = stage(shared.groupBy("node").agg(F.max_by("hub", F.struct("c", -F.col("hub"))).alias("hub")), "favourites")
    parts = one.groupBy("hub").agg(F.ceil(F.count("*") / block).alias("k"))
    members = one.join(parts, "hub").withColumn("j", F.pmod(F.xxhash64("node"), "k"))
    hubs = parts.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    star = F.xxhash64("hub", "j").alias("bucket")
    return members.select(star, F.lit(2).alias("side"), "node").unionByName(hubs.select(star, F.lit(1).alias("side"), F.col("hub").alias("node")))


def across(members: DataFrame, known: DataFrame, block: int) -> DataFrame:
    """bucket, side, band, node and part (component) of the rows of buckets that hold several components (known: node, component). A large bucket becomes pairs of blocks; blocks of its largest component aren't paired with each other."""
    labelled = members.join(known, "node", "left").select("bucket", "band", "node", F.coalesce("component", "node").alias("part"))
    sizes = labelled.groupBy("bucket", "part").agg(F.count("*").alias("c"))
    whole = sizes.groupBy("bucket").agg(F.count("*").alias("parts"), F.max(F.struct("c", "part")).alias("m"), F.sum("c").alias("n")).where("parts > 1")
    whole = stage(whole.select("bucket", "n", F.col("m.part").alias("main"), F.col("m.c").alias("c")), "mixed")
    rows = labelled.join(whole, "bucket")
    main, blocks = F.col("part") == F.col("main"), lambda n: F.ceil(n / block).cast("int")
    first, rest = blocks(F.col("c")), blocks(F.col("n") - F.col("c"))
    own = F.when(main, F.pmod(F.xxhash64("node"), first)).otherwise(first + F.pmod(F.xxhash64("node"), rest)).cast("int")
    with_ = F.explode(F.when(main, F.sequence(first, first + rest - 1)).otherwise(F.sequence(F.lit(0), first + rest - 1)))
    small = rows.where(F.col("n") <= block).select("bucket", F.lit(0).alias("side"), "band", "node", "part")
    large = rows.where(F.col("n") > block).select("*", own.alias("_b"), with_.alias("_j"))
    lo, hi = F.least("_b", "_j"), F.greatest("_b", "_j")
    side = F.when(lo == hi, 0).when(F.col("_b") == lo, 1).otherwise(2)
    return small.unionByName(large.select(F.xxhash64("bucket", lo, hi).alias("bucket"), side.alias("side"), "band", "node", "part"))


def near_duplicates(docs: DataFrame, text: str = "text", similarity: float = 0.8, recall: float = 0.9999, k: int = 2, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs.

    Rows are linked if the Jaccard similarity of their sets of k-word runs is at least `similarity`;
    words end at ASCII white space, A-Z count as a-z. A text of 1 to k-1 words has one run, of all
    its words; a null text or one without words has none and is linked with nothing. component_id is
    the least doc_id that can be reached over links, the row's own among them (null only where all
    are null); kept: doc_id is component_id. Rows with equal or null doc_id count as rows of their
    own; rows of equal ids that are linked are all kept. An empty table gives an empty result; other
    columns take no part. Texts of any length are taken whole.
    """
    small_batches(docs.sparkSession)
    bands = bands_for(recall, similarity, rows)
    source = identified(docs.select("doc_id", F.col(text).alias("_text")))
    with Scratch() as scratch:
        sketched = stage(describe(source, "_text", bands * rows, k), "registers")
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")
        nodes = sketched.where("key is not null").groupBy("key").agg(F.min(order).alias("o"), F.first("n").alias("n"), F.min("regs").alias("regs"))
        nodes = stage(nodes.select("key", F.col("o.uid").alias("node"), F.col("o.doc_id").alias("least"), F.col("o.none").alias("none"), "n", "regs"), "sets")
        with Scratch() as bucketing:
            members = stage(buckets(nodes, bands, rows), "bands")
            shared = members.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket")
            members = bucketing.keep(stage(members.join(shared, "bucket"), "shared"))

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, j, h, at in shingles(batch["t"], k):
                    yield pa.RecordBatch.from_arrays([batch["node"].slice(i, j - i), pa.array([h[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["node", "set"])

        def links(dealt: DataFrame, name: str) -> DataFrame:
            found = stage(close(dealt.join(nodes.select("node", "n", "regs"), "node"), similarity, bands * rows, rows), f"close_{name}")
            wanted = found.select("node").distinct()
            texts = source.select(F.col("uid").alias("node"), F.col("_text").alias("t")).join(wanted, "node", "left_semi").mapInArrow(sets, "node long, set binary")
            return stage(verified(found.join(texts, "node"), similarity), f"links_{name}")

        stars = favourites(members, block).select("bucket", "side", "node", F.lit(None).cast("int").alias("band"), F.col("node").alias("part"))
        first = links(stars, "stars")
        known = stage(components(first), "known")
        second = links(across(members, known, block), "across")
        member = components(first.unionByName(second))
        placed = nodes.select("key", "node", "least", "none").join(member, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = placed.groupBy("component").agg(F.min(F.struct("none", "least")).alias("c")).select("component", F.col("c.least").alias("component_id"))
        named = stage(placed.join(least, "component").select("key", "component_id"), "components")
        scratch.keep(sketched)
        scratch.keep(named)
    out = sketched.select("doc_id", "n", F.col("key").alias("k")).join(named, F.col("k") == F.col("key"), "left")
    component = F.when(F.col("k").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
