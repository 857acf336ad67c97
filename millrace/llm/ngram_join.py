"""N-gram Jaccard join by chosen paths.

A text's set is that of its runs of five words; a set is embedded as a fixed number of min-hashes,
so the share of equal min-hashes estimates the Jaccard similarity. Each run starts with all sets in
one bucket and splits buckets recursively: a bucket's path draws two coordinates, and sets with the
same min-hash there go on together. Small buckets are compared by brute force; large ones are split
again, except where nearly all members agree on the drawn coordinates (a group of near copies) or
the depth is reached: those are compared in blocks, a pair of blocks at a time. Runs are repeated
until pairs at the threshold are found with the target recall. What the min-hashes suggest is
verified on the whole sets.

A pair that meets in several buckets counts in the bucket with the smallest path that both share,
so links are counted where they are found and pairs never become rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import identified, stage
from millrace.llm.text import U, mix, shingle_hashes, text_words
from millrace.storage import Scratch

COORDS = 64
DRAWN = 2
BLOCK = 1024
_SALT = mix(np.arange(COORDS, dtype=U), 77) | U(1)


def runs_for(recall: float, similarity: float) -> int:
    """Runs after which a pair at the similarity has met in a leaf with probability `recall`, however deep the leaf."""
    alive = 1.0
    for _ in range(64):
        alive = 1 - (1 - similarity * alive) ** DRAWN
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - alive)))


def sketches(column: pa.Array, k: int = 5) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """For slices of rows i to j: shingles, their offsets, min-hashes (rows, COORDS) as uint32, and a 16-byte key of each row's set."""
    for i, j, words, offs in text_words(column):
        h, at = shingle_hashes(words, offs, k)
        rows = np.repeat(np.arange(j - i), np.diff(at))
        order = np.lexsort((h, rows))
        h, rows = h[order], rows[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
        h, rows = h[new], rows[new]
        at = np.searchsorted(rows, np.arange(j - i + 1))
        full = np.flatnonzero(np.diff(at))
        low = np.full((j - i, COORDS), 0xFFFFFFFF, np.uint32)
        keys = np.zeros((j - i, 2), U)
        if len(h):
            for c in range(COORDS):
                low[full, c] = np.minimum.reduceat(((h * _SALT[c]) >> U(32)).astype(np.uint32), at[full])
            for c in range(2):
                keys[full, c] = np.add.reduceat(mix(h, 901 + c), at[full])
        yield i, j, h, at, low, [r.tobytes() for r in keys]


def describe(docs: DataFrame, text: str) -> DataFrame:
    """uid, doc_id, n (size of the set), key and sketch (null for an empty set) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, _, at, low, keys in sketches(batch["t"]):
                n = np.diff(at)
                cols = [batch["uid"].slice(i, j - i), batch["doc_id"].slice(i, j - i), pa.array(n), pa.array([k if m else None for k, m in zip(keys, n, strict=True)], pa.binary()), pa.array([r.tobytes() if m else None for r, m in zip(low, n, strict=True)], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["uid", "doc_id", "n", "key", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("uid", "doc_id", F.col(text).alias("t")).mapInArrow(run, f"uid long, doc_id {kind}, n long, key binary, sketch binary")


def _children(paths: np.ndarray, sketch: np.ndarray) -> Iterator[np.ndarray]:
    """The paths that rows of `sketch` in buckets `paths` go on to, one for each drawn coordinate."""
    first = mix(paths, 5) % U(COORDS)
    for d in range(DRAWN):
        c = ((first + U(d) * (U(1) + mix(paths, 6) % U(COORDS - 1))) % U(COORDS)).astype(np.int64)
        yield mix(mix(paths, 7 + d) ^ (sketch[np.arange(len(c)), c].astype(U) << U(8)) ^ c.astype(U))


def _sketch(batch: pa.RecordBatch, name: str = "sketch") -> np.ndarray:
    return np.frombuffer(b"".join(batch[name].to_pylist()), np.uint32).reshape(-1, COORDS)


def split(members: DataFrame) -> DataFrame:
    """(path, node, sketch) to (parent, path, node), a row for each drawn coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for child in _children(batch["path"].to_numpy().view(U), _sketch(batch)):
                    yield pa.RecordBatch.from_arrays([batch["path"], pa.array(child.view(np.int64)), batch["node"]], ["parent", "path", "node"])

    return members.select("path", "node", "sketch").mapInArrow(run, "parent long, path long, node long")


def leaves(nodes: DataFrame, similarity: float, recall: float, limit: int, depth: int) -> DataFrame:
    """path, n (members) and node for every leaf with two members or more."""
    runs = runs_for(recall, similarity)
    roots = F.array(*[F.xxhash64(F.lit(f"run {r}")) for r in range(runs)])
    members, out = split(nodes.select("node", "sketch", F.explode(roots).alias("path"))).select("path", "node"), None
    for level in range(1, depth + 1):
        members = stage(members, f"paths{level}")
        sizes = stage(members.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"), f"sizes{level}")
        small = members.join(sizes.where(F.col("n") <= limit), "path").select("path", "n", "node")
        out = small if out is None else out.unionByName(small)
        large = sizes.where(F.col("n") > limit)
        if large.isEmpty():
            return out
        rest = members.join(large, "path")
        if level == depth:
            return out.unionByName(rest.select("path", "n", "node"))
        below = stage(split(rest.join(nodes.select("node", "sketch"), "node")), f"split{level}")
        agree = below.groupBy("parent", "path").agg(F.count("*").alias("c")).join(large.withColumnRenamed("path", "parent"), "parent")
        dense = stage(agree.groupBy("parent").agg(F.sum((F.col("c") / F.col("n")) ** 2).alias("s")).where(F.col("s") >= 0.5 * DRAWN).select("parent"), f"dense{level}")
        out = out.unionByName(rest.join(dense.withColumnRenamed("parent", "path"), "path", "left_semi").select("path", "n", "node"))
        members = below.join(dense, "parent", "left_anti").select("path", "node")
    return out


def deal(leaf: DataFrame, block: int) -> DataFrame:
    """Adds bucket and side: a leaf over `block` members becomes pairs of blocks; in a bucket of two blocks, sides 1 and 2 are compared with each other."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    rows = leaf.withColumn("_b", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("_j", F.explode(F.sequence(F.lit(0), blocks - 1)))
    lo, hi = F.least("_b", "_j"), F.greatest("_b", "_j")
    side = F.when(lo == hi, 0).when(F.col("_b") == lo, 1).otherwise(2)
    return rows.withColumn("bucket", F.when(blocks == 1, F.col("path")).otherwise(F.xxhash64("path", lo, hi))).withColumn("side", side.cast("int")).drop("_b", "_j", "n")


def whole_buckets(batches: Iterator[pa.RecordBatch], units: int = 1 << 16, most_bytes: int = 32 << 20, bucket: str = "bucket") -> Iterator[pa.Table]:
    """Tables of whole buckets from batches that are sorted by bucket, of about `units` rows or `most_bytes`; more only if one bucket has more."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        b = batch[bucket].to_numpy()
        other = np.flatnonzero(b != b[-1])
        last = int(other[-1]) + 1 if len(other) else 0  # where the batch's last bucket starts
        apart = bool(held) and held[-1][bucket][-1].as_py() != b[0]
        if held and (last or apart) and (rows + last >= units or size + batch.nbytes >= most_bytes):
            cut = last if not apart or size + batch.nbytes < 2 * most_bytes else 0
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held, rows, size = [], 0, 0
            batch = batch.slice(cut)
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
    if held:
        yield pa.Table.from_batches(held)


def pairs(bucket: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs to compare in rows that are sorted by bucket."""
    at, lag = np.arange(len(bucket)), 1
    while len(at):
        at = at[at + lag < len(bucket)]
        at = at[bucket[at] == bucket[at + lag]]
        x = at[(side[at] != side[at + lag]) | (side[at] == 0)]
        for a in range(0, len(x), 65536):
            yield x[a : a + 65536], x[a : a + 65536] + lag
        lag += 1


def first_shared(paths: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest path that rows x and y of `paths` (padded with the largest long) share."""
    most = np.iinfo(np.int64).max
    out = np.full(len(x), most)
    for c in range(paths.shape[1]):
        mine = paths[x, c]
        out = np.minimum(out, np.where((paths[y] == mine[:, None]).any(axis=1), mine, most))
    return out


def _paths(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    size, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
    out = np.full((len(size), int(size.max(initial=1))), np.iinfo(np.int64).max)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def candidates(dealt: DataFrame, similarity: float) -> DataFrame:
    """The rows (bucket, side, path, node) that may have a link in their bucket: by the min-hashes, with four standard deviations to spare."""
    least = math.floor(COORDS * similarity - 4 * math.sqrt(COORDS * similarity * (1 - similarity)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_buckets(batches):
            bucket, side, path = (t[c].to_numpy() for c in ("bucket", "side", "path"))
            sketch, paths, found = _sketch(t), None, np.zeros(t.num_rows, bool)
            for x, y in pairs(bucket, side):
                close = np.zeros(len(x), np.uint8)
                for c in range(COORDS):
                    close += sketch[x, c] == sketch[y, c]
                x, y = x[close >= least], y[close >= least]
                if len(x):
                    paths = _paths(t["paths"]) if paths is None else paths
                    own = first_shared(paths, x, y) == path[x]
                    found[x[own]] = found[y[own]] = True
            at = np.flatnonzero(found)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(v[at]) for v in (bucket, side, path, t["node"].to_numpy())], ["bucket", "side", "path", "node"])

    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "bucket long, side int, path long, node long")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sorted sets."""
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    rows = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[col]
    rows, col = rows[keep], number[col[keep]]
    out, width = np.zeros((len(sets), len(sets)), np.float32), 4096
    order = np.argsort(col, kind="stable")
    rows, col = rows[order], col[order]
    for a in range(0, int(shared.sum()), width):
        i, j = np.searchsorted(col, [a, a + width])
        m = np.zeros((len(sets), width), np.float32)
        m[rows[i:j], col[i:j] - a] = 1
        out += m @ m.T
    return out.astype(np.int64)


def verify(rows: DataFrame, similarity: float) -> DataFrame:
    """node, root and links: for each node with a link in a bucket, the least node of its component there and the documents linked to it that count there."""
    tenths = round(similarity * 1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_buckets(batches, 512):
            bucket, side, path, node, copies = (t[c].to_numpy() for c in ("bucket", "side", "path", "node", "copies"))
            sets, paths = [np.frombuffer(s, U) for s in t["shingles"].to_pylist()], _paths(t["paths"])
            starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a, b in zip(starts, np.append(starts[1:], len(bucket)), strict=True):
                if b - a < 2:
                    continue
                both = overlaps(sets[a:b])
                size = np.array(list(map(len, sets[a:b])))
                s = side[a:b]
                linked = (both * 1000 >= tenths * (size[:, None] + size[None, :] - both)) & ((s[:, None] != s[None, :]) | (s == 0)[:, None])
                x, y = np.nonzero(np.triu(linked, 1))
                if not len(x):
                    continue
                label = np.arange(b - a)
                while True:
                    was = label.copy()
                    np.minimum.at(label, x, label[y])
                    np.minimum.at(label, y, label[x])
                    label = label[label]
                    if (was == label).all():
                        break
                own = first_shared(paths, x + a, y + a) == path[a]
                links = np.bincount(x[own], weights=copies[a:b][y[own]], minlength=b - a) + np.bincount(y[own], weights=copies[a:b][x[own]], minlength=b - a)
                touched = np.union1d(x, y)
                out.append((node[a:b][touched], node[a:b][label[touched]], links[touched].astype(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["node", "root", "links"])

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "node long, root long, links long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) edges to (node, component), the least node of its component, for every node with an edge: large-star and small-star rounds until stars are left."""
    e = edges.where("node <> root").select(F.greatest("node", "root").alias("u"), F.least("node", "root").alias("v")).distinct()
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = stage(small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), "stars")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def classes(docs: DataFrame, text: str, similarity: float, recall: float, limit: int, depth: int, k: int) -> DataFrame:
    """uid, doc_id, n, head (uid of the row that stands for the class), class_id, links and copies of every row of docs (uid, doc_id, text); the last four are null for rows without words."""
    rows = stage(describe(docs, text), "sketches")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "uid")
    full = rows.where("key is not null")
    with Scratch() as scratch:
        nodes = full.groupBy("key").agg(F.min(order).alias("o"), F.count("*").alias("copies"), F.min("sketch").alias("sketch"))
        nodes = stage(nodes.select("key", F.col("o.uid").alias("node"), F.col("o.doc_id").alias("least"), F.col("o.none").alias("none"), "copies", "sketch"), "nodes")
        leaf = stage(leaves(nodes, similarity, recall, limit, depth).distinct(), "leaves")
        lists = leaf.groupBy("node").agg(F.array_sort(F.collect_list("path")).alias("paths"))
        about = stage(lists.join(nodes.select("node", "copies", "sketch"), "node"), "members")
        dealt = deal(leaf.join(about.drop("copies"), "node"), BLOCK)
        found = stage(candidates(dealt, similarity), "candidates")

        def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, j, words, offs in text_words(batch["t"]):
                    h, at = shingle_hashes(words, offs, k)
                    data = [np.unique(h[a:b]).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([batch["node"].slice(i, j - i), pa.array(data, pa.binary())], ["node", "shingles"])

        wanted = found.select("node").distinct()
        texts = docs.select(F.col("uid").alias("node"), F.col(text).alias("t")).join(wanted, "node", "left_semi").mapInArrow(shingles, "node long, shingles binary")
        linked = stage(verify(found.join(about.drop("sketch").join(texts, "node"), "node"), similarity), "links")
        links = linked.groupBy("node").agg(F.sum("links").alias("links"))
        member = components(linked.select("node", "root"))
        known = nodes.join(member, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = known.groupBy("component").agg(F.min(F.struct("none", "least", "key", "node")).alias("c"))
        result = known.join(least, "component").join(links, "node", "left").select("key", F.col("c.node").alias("head"), F.col("c.least").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
        result = scratch.keep(stage(result, "classes"))
    return rows.withColumnRenamed("key", "k").join(result, F.col("k") == F.col("key"), "left").select("uid", "doc_id", "n", "head", "class_id", "links", "copies")


def join(docs: DataFrame, text: str = "text", similarity: float = 0.8, recall: float = 0.9999, limit: int = 256, depth: int = 6, k: int = 5) -> DataFrame:
    """doc_id, class_id, n_links, n_copies and n_shingles of every row of docs.

    Rows are linked if the Jaccard similarity of their sets of k-word runs is at least `similarity`;
    words end at ASCII white space, case counts. A text of 1 to k-1 words has one run, of all its
    words; a null text or one without words has none, is linked to nothing and is its own class.
    Classes are the components of the links; class_id is the least doc_id in it (nulls last).
    n_links counts the other rows linked, copies among them; n_copies the rows with the same set.
    Rows with equal or null doc_id count as rows of their own. An empty table gives an empty result.
    """
    rows = identified(docs.select("doc_id", F.col(text).alias("_text")))
    found = classes(rows, "_text", similarity, recall, limit, depth, k)
    own = F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return found.select("doc_id", own.alias("class_id"), F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"), F.col("n").alias("n_shingles"))


def keep_first(docs: DataFrame, text: str = "text", similarity: float = 0.8, recall: float = 0.9999, limit: int = 256, depth: int = 6, k: int = 5) -> DataFrame:
    """docs with one row of each class of `join` left: that with the least doc_id, of equal ones that with the least hash of its words. Rows without words all stay."""
    rows = identified(docs.select(F.struct("*").alias("_row")))
    with Scratch() as scratch:
        found = classes(rows.select("uid", F.col("_row.doc_id").alias("doc_id"), F.col(f"_row.`{text}`").alias("_text")), "_text", similarity, recall, limit, depth, k)
        gone = scratch.keep(stage(found.where("head <> uid").select("uid"), "duplicates"))
    return rows.join(gone, "uid", "left_anti").select("_row.*")
