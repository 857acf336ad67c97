"""Merkle manifest of a table: a tree of digests for each source, and a tree of their roots.

Leaves are sorted by source and doc_id and written as runs; each has a coordinate: its tree and its
place there. Levels are built three at a time: a block of 4096 neighbours streams through a task in
order, which writes the nodes above them to a table with a folder for each level. The highest of
them are what the next three levels read. Proofs are taken the other way: a block's nodes of all
three levels, its leaves and the path of the block's own node, which the levels above have left,
meet sorted by coordinate, and one scan merges them. No task holds more than a block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import identified, small_batches, stage
from millrace.llm.ngram_join import whole_buckets
from millrace.operators.rows import numbered
from millrace.storage import written

FAN, LEVELS = 16, 3
SPAN = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<place: int, others: string>>"
Path = list[tuple[int, str]]


def digest(*texts: str) -> str:
    """Lower-case hex SHA-256 of the texts, one after the other."""
    return sha256("".join(texts).encode()).hexdigest()


def leaf(**changed: Column) -> Column:
    """The digest of a row: `-` for a null field, else its length in UTF-8 bytes, `:` and its value. changed: values to take in place of fields."""
    parts = []
    for name in FIELDS:
        value = changed.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def counts(n: int) -> list[int]:
    """Nodes of a tree of n at each level of a block, the highest of the block among them."""
    out = [n]
    for _ in range(LEVELS):
        out.append(-(-out[-1] // FAN))
    return out


def _blocks(t: pa.Table) -> Iterator[tuple[int, int]]:
    block = t["block"].to_numpy()
    starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    return zip(starts.tolist(), [*starts[1:].tolist(), len(block)], strict=True)


def climb(nodes: DataFrame) -> DataFrame:
    """The nodes (tree, n, p, digest, top, level) of the levels above nodes (tree, n, p, digest): n is what the tree has at the lowest level, top tells its root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_buckets(batches, bucket="block"):
            tree, n, p, digests = (t[c].to_pylist() for c in ("tree", "n", "p", "digest"))
            out: list[tuple] = []
            for a, b in _blocks(t):
                here, at, of = digests[a:b], p[a], counts(n[a])
                for level in range(1, LEVELS + 1):
                    if of[level - 1] == 1:
                        break
                    here, at = [digest(*here[i : i + FAN]) for i in range(0, len(here), FAN)], at // FAN
                    out += [(tree[a], n[a], at + i, d, of[level] == 1, level) for i, d in enumerate(here)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["tree", "n", "p", "digest", "top", "level"])

    dealt = nodes.select("tree", "n", "p", "digest", block("p", SPAN).alias("block"))
    return dealt.repartition("block").sortWithinPartitions("block", "p").mapInArrow(run, "tree long, n long, p long, digest string, top boolean, level long")


def block(place: str, span: int) -> Column:
    """The number of a node's block: trees are numbered by their first leaf among all, so the numbers of different trees differ."""
    return F.col("tree") + F.floor(F.col(place) / span).cast("long")


def grow(leaves: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """(lowest nodes, nodes above them) for every three levels, from the leaves up."""
    strata, lowest = [], leaves
    while True:
        store = written(climb(lowest), "nodes", by=["level"])
        strata.append((lowest, store))
        lowest = store.where((F.col("level") == LEVELS) & ~F.col("top")).select("tree", F.ceil(F.col("n") / SPAN).cast("long").alias("n"), "p", "digest")
        if lowest.isEmpty():
            return strata


def roots(strata: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """tree and digest of the root of every tree."""
    out = strata[0][0].where("n = 1").select("tree", "digest")
    for _, store in strata:
        out = out.unionByName(store.where("top").select("tree", "digest"))
    return out


def lifted(digests: list[str], parents: list[Path]) -> list[Path]:
    """The path of each node of a level: its place in its run and the others of the run, then its parent's path."""
    out = []
    for a in range(0, len(digests), FAN):
        run = "".join(digests[a : a + FAN])
        out += [[(i // 64, run[:i] + run[i + 64 :]), *parents[a // FAN]] for i in range(0, len(run), 64)]
    return out


def fold(node: str, path: Path) -> str:
    """The root that a node leads to with the others of its path."""
    for place, others in path:
        node = digest(others[: 64 * place], node, others[64 * place :])
    return node


def descend(strata: list[tuple[DataFrame, DataFrame]], above: DataFrame, last: DataFrame, final: bool) -> DataFrame:
    """The path from every leaf up. above: tree, n (leaves), path and subroot of each tree's root; last: the leaves with doc_id and changed (another digest or null) as well.

    final: doc_id, leaf, subroot, proof, folded and path of the leaves; else their tree, p, path and subroot.
    """
    columns = ["block", "level", "p", "n", "tree", "digest", "doc_id", "changed", "path", "subroot"]
    kind = last.schema["doc_id"].dataType.simpleString()
    none = {"p": "long", "n": "long", "digest": "string", "doc_id": kind, "changed": "string", "path": PATH, "subroot": "string"}

    def shaped(rows: DataFrame, level: int | Column, number: Column) -> DataFrame:
        rows = rows.withColumn("block", number).withColumn("level", (F.lit(level) if isinstance(level, int) else level).cast("long"))
        return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(none[c]).alias(c) for c in columns])

    def run(ending: bool):
        def of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in whole_buckets(batches, 16384, bucket="block"):
                level, p, n, tree, digests, ids, changed, path, subroot = (t[c].to_pylist() for c in columns[1:])
                for a, b in _blocks(t):
                    # The block's own path stands first, then its nodes, the highest first.
                    own = [[(s["place"], s["others"]) for s in path[a]]]
                    here: dict[int, list[str]] = {k: [] for k in range(LEVELS)}
                    for i in range(a + 1, b):
                        here[level[i]].append(digests[i])
                    of, paths = counts(n[b - 1]), own
                    for k in reversed(range(LEVELS)):
                        if of[k] > 1:
                            paths = lifted(here[k], paths)
                    leaves = range(b - len(here[0]), b)
                    made = pa.array([[{"place": x, "others": y} for x, y in q] for q in paths], pa.list_(pa.struct([("place", pa.int32()), ("others", pa.string())])))
                    subroots = pa.array([subroot[a]] * len(leaves), pa.string())
                    if not ending:
                        yield pa.RecordBatch.from_arrays([pa.array([tree[i] for i in leaves]), pa.array([p[i] for i in leaves]), made, subroots], ["tree", "p", "path", "subroot"])
                        continue
                    proof = [digest(*[o for _, o in q]) for q in paths]
                    folded = [fold(changed[i] or digests[i], q) for i, q in zip(leaves, paths, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in leaves], t.schema.field("doc_id").type), pa.array(here[0]), subroots, pa.array(proof), pa.array(folded), made], ["doc_id", "leaf", "subroot", "proof_sha256", "folded_root", "path"])

        return of_blocks

    below = None
    for k in reversed(range(len(strata))):
        lowest, store = strata[k]
        lowest = lowest if k else last
        ends = above.where((F.ceil(F.col("n") / float(SPAN**k)) <= SPAN) & ((F.col("n") > SPAN**k) if k else F.lit(True)))
        parents = shaped(ends.drop("n"), LEVELS, F.col("tree"))
        if below is not None:
            parents = parents.unionByName(shaped(below.drop("n"), LEVELS, F.col("tree") + F.col("p")))
        inner = shaped(store.where(F.col("level") < LEVELS).drop("n"), F.col("level"), F.col("tree") + F.floor(F.col("p") / F.pow(F.lit(float(FAN)), LEVELS - F.col("level"))).cast("long"))
        rows = parents.unionByName(inner).unionByName(shaped(lowest, 0, block("p", SPAN)))
        ending = final and k == 0
        schema = f"doc_id {kind}, leaf string, subroot string, proof_sha256 string, folded_root string, path {PATH}" if ending else f"tree long, p long, path {PATH}, subroot string"
        below = rows.repartition("block").sortWithinPartitions("block", F.desc("level"), "p").mapInArrow(run(ending), schema)
        if k:
            below = stage(below, "paths")
    return below


@dataclass(frozen=True)
class Manifest:
    """The trees of a table. leaves: tree, n, p, digest, doc_id, changed; root: null for an empty table."""

    leaves: DataFrame
    strata: list[tuple[DataFrame, DataFrame]]
    trees: DataFrame
    top: list[tuple[DataFrame, DataFrame]]
    root: str | None


def build(docs: DataFrame, changed: Column | None = None) -> Manifest:
    """The manifest of docs. changed: the text of rows as they are held against it later, null where they haven't changed.

    Leaves of a source ascend by doc_id (null first), equal ids by their digests; rows that are equal
    altogether stand beside each other, as often as they occur. A null source is a source of its own,
    the first; others follow in the order of their UTF-8 bytes. Fields may be null. Other columns
    take no part. An empty table has no root.
    """
    small_batches(docs.sparkSession)
    other = F.lit(None).cast("string") if changed is None else F.when(changed.isNotNull(), leaf(text=changed))
    rows = identified(docs.select("doc_id", "source", leaf().alias("digest"), other.alias("changed")))
    placed = stage(numbered(rows, ["source", "doc_id", "digest", "uid"], "rank").drop("uid"), "ranked")
    # One row for each source, numbered by its first leaf; that order is the order of sources.
    sources = stage(placed.groupBy("source").agg(F.count("*").alias("n"), F.min("rank").alias("tree")).withColumnRenamed("source", "name"), "sources")
    leaves = stage(placed.join(sources, F.col("source").eqNullSafe(F.col("name"))).select("tree", "n", (F.col("rank") - F.col("tree")).alias("p"), "digest", "doc_id", "changed"), "leaves")
    strata = grow(leaves)
    subroots = numbered(roots(strata), ["tree"], "p").select(F.col("tree").alias("doc_id"), "p", "digest")
    total = sources.agg(F.count("*").alias("n"))
    high = stage(subroots.join(F.broadcast(total)).select(F.lit(0).cast("long").alias("tree"), "n", "p", "digest", "doc_id", F.lit(None).cast("string").alias("changed")), "subroots")
    top = grow(high)
    row = roots(top).first()
    return Manifest(leaves, strata, sources.select("tree", "n"), top, row["digest"] if row else None)


def proofs(manifest: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified and path of every leaf.

    path: for each level, up to the root of all, the node's place in its run and the run's other
    digests, left to right. proof_sha256 is the digest of all of those; folded_root what the path
    makes of the changed leaf, where there is one, else of the leaf.
    """
    n = manifest.top[0][0].select("n").limit(1)
    start = n.select(F.lit(0).cast("long").alias("tree"), "n", F.array().cast(PATH).alias("path"), F.lit(None).cast("string").alias("subroot"))
    carried = manifest.top[0][0]
    high = stage(descend(manifest.top, start, carried, final=False), "subpaths")
    # A subroot is found by its place among all subroots.
    known = high.drop("tree", "subroot").join(carried.select("p", F.col("doc_id").alias("tree"), F.col("digest").alias("subroot")), "p").drop("p")
    above = stage(known.join(manifest.trees, "tree").select("tree", "n", "path", "subroot"), "subroots")
    out = descend(manifest.strata, above, manifest.leaves, final=True)
    root = F.lit(manifest.root).cast("string")
    return out.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"), "path")


def tampered() -> Column:
    """Texts of rows whose doc_id, in decimal, has a crc32 that 5 divides, with A-Z lower-cased; null for the others, for null texts and ids."""
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.translate("text", UPPER, LOWER))
