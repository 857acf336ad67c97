"""Exact top-k search by inner product, pruned with multi-resolution segment statistics.

A vector's segments have a mean and a deviation. By the Cauchy-Schwarz inequality the inner product
of two segments of n components is at most n * (mean * mean + deviation * deviation), so segment
statistics bound the squared distance |q|^2 + |x|^2 - 2 q.x from below. Bounds are taken from coarse
segments to fine ones; what survives them is computed exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from collections.abc import Iterator
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import stage

SAFE = float(1 << 22)  # products of integers below this add up exactly in a double, for up to 512 components
LONG = 1 << 63


def segment_stats(x: np.ndarray, segments: int) -> np.ndarray:
    """For each row, sqrt(n)*mean and sqrt(n)*deviation of each segment; the dot product of two such rows is at least that of the vectors."""
    edges = np.unique(np.linspace(0, x.shape[1], segments + 1).astype(int))
    n = np.diff(edges).astype(float)
    s1 = np.add.reduceat(x, edges[:-1], axis=1)
    s2 = np.add.reduceat(x * x, edges[:-1], axis=1)
    return np.hstack([s1 / np.sqrt(n), np.sqrt(np.maximum(s2 - s1 * s1 / n, 0))])


def _dots(q: np.ndarray, x: np.ndarray, qi: np.ndarray, xi: np.ndarray) -> np.ndarray:
    """Inner products of the pairs (qi, xi) of rows of q and x: pair by pair where they are few, else of whole blocks."""
    if len(qi) * 16 < len(q) * len(x):
        return np.concatenate([np.einsum("ij,ij->i", q[qi[b : b + 65536]], x[xi[b : b + 65536]]) for b in range(0, len(qi), 65536)] or [np.zeros(0)])
    return (q @ x.T)[qi, xi]


def _exact(q: np.ndarray, x: np.ndarray, qi: np.ndarray, xi: np.ndarray) -> np.ndarray:
    """Inner products of the pairs (qi, xi) of rows of q and x, as int64; beyond the range of a long, the nearest long."""
    if max(np.abs(q).max(initial=0), np.abs(x).max(initial=0)) < SAFE and q.shape[1] <= 512:
        return _dots(q, x, qi, xi).astype(np.int64)
    q, x = q[qi], x[xi]
    return np.array([min(max(sum(int(a) * int(b) for a, b in zip(u, v, strict=True)), -LONG), LONG - 1) for u, v in zip(q, x, strict=True)], np.int64)


def best(queries: np.ndarray, q_uids: np.ndarray, least: np.ndarray, rows: np.ndarray, uids: np.ndarray, ids: np.ndarray, k: int, levels: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of query and row, and scores, of each query's k best other rows among those that score at least its `least`; ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    rows, ids, uids = rows[order], ids[order], uids[order]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    stats = [segment_stats(rows, s) for s in levels]
    norm2, large = (rows * rows).sum(1), np.abs(rows).max(initial=0)
    for a in range(0, len(queries), 64):
        q, own = queries[a : a + 64], q_uids[a : a + 64]
        q2 = (q * q).sum(1)
        q_stats = [segment_stats(q, s) for s in levels]
        slack = 1e-9 * (q2[:, None] + norm2[None, :]) + 1.0
        lower = q2[:, None] + norm2[None, :] - 2 * (q_stats[0] @ stats[0].T) - 2 * slack  # of squared distances
        upper = (q2[:, None] + norm2[None, :] - lower) / 2  # of inner products
        upper[own[:, None] == uids[None, :]] = -np.inf
        seeds = np.argpartition(-upper, min(4 * k, upper.shape[1] - 1), axis=1)[:, : 4 * k]
        n = seeds.shape[1]
        seed_scores = _exact(q, rows, np.repeat(np.arange(len(q)), n), seeds.ravel()).reshape(seeds.shape).astype(float)
        seed_scores[np.take_along_axis(upper, seeds, 1) == -np.inf] = -np.inf
        bar = least[a : a + 64]
        if n >= k:
            bar = np.maximum(bar, np.sort(seed_scores, axis=1)[:, -k])
        if large >= SAFE:  # beyond exact doubles
            bar = bar - np.abs(bar) * 1e-12
        qi, xi = np.nonzero((upper >= bar[:, None]) & (upper > -np.inf))
        for s, qs in zip(stats[1:], q_stats[1:], strict=True):
            keep = _dots(qs, s, qi, xi) + slack[qi, xi] >= bar[qi]
            qi, xi = qi[keep], xi[keep]
        score = _exact(q, rows, qi, xi)
        keep = score >= bar[qi]
        qi, xi, score = qi[keep], xi[keep], score[keep]
        by = np.lexsort((ids[xi], -score.astype(object) if large >= SAFE else -score, qi))
        qi, xi, score = qi[by], xi[by], score[by]
        rank = np.arange(len(qi)) - np.searchsorted(qi, qi)
        top = rank < k
        out.append((qi[top] + a, order[xi[top]], score[top]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


def quantised(vectors: DataFrame, scale: float = 1024.0) -> DataFrame:
    """vec_id, dim and v: floor(scale * x) of each component, as packed doubles. Rows whose id or vector is null, or that hold a null or a component that isn't finite, are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["e"]
            if not batch.num_rows:
                continue
            flat = np.floor(np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64) * scale) + 0.0
            size = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
            offs = np.concatenate([[0], np.cumsum(size)])
            fine = np.concatenate([[0], np.cumsum(np.isfinite(flat))])
            ok = np.flatnonzero(fine[offs[1:]] - fine[offs[:-1]] == size)
            data = [flat[offs[i] : offs[i + 1]].tobytes() for i in ok]
            yield pa.RecordBatch.from_arrays([batch["vec_id"].take(pa.array(ok)), pa.array(size[ok].astype(np.int32)), pa.array(data, pa.binary())], ["vec_id", "dim", "v"])

    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull())
    return vectors.where(usable).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("e")).mapInArrow(run, "vec_id long, dim int, v binary")


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, levels: tuple[int, ...] = (4, 16), group_rows: int = 16384, query_rows: int = 16384) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every`, the k other rows with the highest inner products of quantised vectors.

    Rows are dealt evenly into groups of about group_rows and queries into blocks of about
    query_rows; each pair of a group and a block is one task's work of bounded size. The first group
    is searched first: the k-th score of each query there is what rows of all other groups must
    reach, so they return few rows. Vectors are compared with those of the same dimension. Rows that
    share a vec_id are rows, and queries, of their own. Empty tables give an empty result.
    """
    rows = stage(quantised(vectors).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    numbers = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q")).first()
    groups, blocks = -(-max(numbers["n"], 1) // group_rows), -(-max(numbers["q"], 1) // query_rows)
    deal = lambda n: F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")
    left = rows.withColumn("g", deal(groups)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    queries = rows.where(F.col("vec_id") % every == 0).withColumn("b", deal(blocks))
    queries = queries.select(*[F.col(c).alias(c) for c in queries.columns])  # both sides of a cogroup come from one table
    schema = pa.schema([("uid", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def matrix(t: pa.Table) -> np.ndarray:
        return np.frombuffer(b"".join(t["v"].to_pylist()), np.float64).reshape(t.num_rows, -1)

    def run(x: pa.Table, q: pa.Table) -> pa.Table:
        if not x.num_rows or not q.num_rows:
            return schema.empty_table()
        ids, q_ids, uids, q_uids = (t[c].to_numpy() for c in ("vec_id", "uid") for t in (x, q))
        if not x["dim"][0].as_py():
            few = np.lexsort((uids, ids))[: k + 1]
            pairs = [(u, i, ids[j], 0) for u, i in zip(q_uids.tolist(), q_ids.tolist(), strict=True) for j in few[uids[few] != u][:k]]
            return pa.Table.from_pandas(pd.DataFrame(pairs, columns=schema.names), schema, preserve_index=False)
        qi, xi, score = best(matrix(q), q_uids, q["least"].to_numpy(zero_copy_only=False), matrix(x), uids, ids, k, levels)
        return pa.table([q_uids[qi], q_ids[qi], ids[xi], score], schema=schema)

    def search(these: DataFrame, asked: DataFrame, first: int, last: int) -> DataFrame:
        each = asked.withColumn("g", F.explode(F.sequence(F.lit(first), F.lit(last))))
        return these.groupBy("g", "b", "dim").cogroup(each.groupBy("g", "b", "dim")).applyInArrow(run, "uid long, query_id long, vec_id long, score long")

    rank = F.row_number().over(W.partitionBy("uid").orderBy(F.col("score").desc(), "vec_id"))
    found = search(left.where("g = 0"), queries.withColumn("least", F.lit(float("-inf"))), 0, 0)
    if groups > 1:
        found = stage(found, "first")
        bars = found.groupBy("uid").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("least")).where(F.col("n") >= k).drop("n")
        asked = queries.join(bars, "uid", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
        found = found.unionByName(search(left.where("g > 0"), asked, 1, groups - 1))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
