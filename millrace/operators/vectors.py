"""A partitioned vector index: cells around centroids, residuals as bytes, exact re-ranking.

The index is a folder: `rows` (Parquet, a folder a cell: key, code, scale, error, vector) and `cells`
(cell, centroid, rows, reach). A search reads the codes of the cells that it probes, and full vectors
only for the rows that the codes leave. Similarity is the cosine.

Rows whose vector is null, empty, zero, or holds nulls or values that aren't finite aren't indexed. A
vector of another length is an error before anything is written. Equal vectors and repeated keys are
kept, ties go to the smaller key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Values of a cell's codes, and queries, that one task compares at a time.
VALUES, QUERIES = 1 << 23, 1 << 10
#: Values of the rows that centroids are fitted on, and of all centroids, at most.
FITTED, CENTROIDS = 1 << 25, 1 << 24
#: Added to bounds for the rounding of sums.
SLACK = 1e-5


def usable(vector: str) -> Column:
    """Whether a row has a vector with a direction."""
    v = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def stacked(vectors: pd.Series) -> np.ndarray:
    """Unit vectors as rows."""
    m = np.stack(vectors.to_numpy()).astype(np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def unit(vector: str) -> Column:
    return F.pandas_udf(lambda s: pd.Series(list(stacked(s))) if len(s) else s, "array<double>")(vector)


@dataclass(frozen=True)
class VectorIndex:
    """An index at a path, for vectors of one length."""

    path: str
    key: str = "id"
    vector: str = "embedding"

    def build(self, rows: DataFrame, dimension: int, cells: int | None = None, sample: int = 1 << 16, seed: int = 7) -> VectorIndex:
        """Writes the index over all rows (key, vector).

        Centroids are fitted on `sample` rows at most (and on FITTED values), those with the least hashes of their
        keys; every row is put into its nearest cell. cells: their number, else the root of the number of rows;
        4096 at most, and CENTROIDS values in all.
        """
        if not 1 <= dimension <= 16_000:
            raise ValueError("dimension: 1 to 16000")
        facts = rows.agg(F.count_if(F.col(self.vector).isNotNull() & (F.size(self.vector) != dimension) & (F.size(self.vector) > 0)).alias("wrong"), F.count_if(usable(self.vector)).alias("n")).first()
        if facts["wrong"]:
            raise ValueError(f"{facts['wrong']} vectors aren't of length {dimension}")
        good = rows.where(usable(self.vector)).select(self.key, self.vector)
        count = max(1, min(cells or int(facts["n"] ** 0.5), 4096, CENTROIDS // dimension, facts["n"]))
        centroids = self._fitted(good, count, min(sample, FITTED // dimension), seed) if facts["n"] else np.zeros((0, dimension))
        coded = self._coded(good, centroids)
        # Rebalanced by cell: small cells share a file, a cell with very many rows gets several.
        writer = coded.hint("rebalance", F.col("cell")).write.mode("errorifexists")
        (writer.partitionBy("cell") if facts["n"] else writer).parquet(f"{self.path}/rows")
        spark = rows.sparkSession
        written = self._rows(spark).groupBy("cell").agg(F.count("*").alias("rows"), F.min("near").alias("reach"))
        middle = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
        middle.join(written, "cell").coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/cells")
        return self

    def _fitted(self, good: DataFrame, count: int, sample: int, seed: int) -> np.ndarray:
        some = good.orderBy(F.xxhash64(self.key), self.key).limit(sample).select(array_to_vector(unit(self.vector)).alias("features"))
        model = KMeans(k=count, seed=seed, maxIter=10, distanceMeasure="cosine").fit(some)
        found = np.array([c for c in model.clusterCenters() if np.any(c)])
        return found / np.linalg.norm(found, axis=1, keepdims=True)

    def _coded(self, good: DataFrame, centroids: np.ndarray) -> DataFrame:
        """Rows with the nearest cell, near (the cosine to its centroid), the residual's code, its scale and the length of what the code leaves out."""
        shared = good.sparkSession.sparkContext.broadcast(centroids)
        types = dict(good.dtypes)

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                if not len(part):
                    continue
                m = stacked(part[self.vector])
                dots = m @ shared.value.T
                cell = dots.argmax(axis=1)
                rest = m - shared.value[cell]
                scale = np.maximum(np.abs(rest).max(axis=1), 1e-12) / 127
                code = np.rint(rest / scale[:, None]).astype(np.int8)
                error = np.linalg.norm(rest - code * scale[:, None], axis=1)
                yield pd.DataFrame({self.key: part[self.key], "code": [c.tobytes() for c in code], "scale": scale, "error": error, "near": dots[np.arange(len(m)), cell], "vector": part[self.vector], "cell": cell.astype(np.int32)})

        return good.mapInPandas(run, f"`{self.key}` {types[self.key]}, code binary, scale double, error double, near double, vector {types[self.vector]}, cell int")

    def _rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/rows")

    def _cells(self, spark: SparkSession) -> pd.DataFrame:
        """The cells, 4096 at most."""
        return spark.read.parquet(f"{self.path}/cells").orderBy("cell").toPandas()

    def _probes(self, queries: DataFrame, probes: int | None) -> DataFrame:
        """queries (query_id, q, least) once for each cell to read: the `probes` nearest ones, or all that may hold a row of similarity `least`."""
        cells = self._cells(queries.sparkSession)
        numbers = cells["cell"].to_numpy()
        shared = queries.sparkSession.sparkContext.broadcast((np.stack(cells["centroid"].to_numpy()), np.arccos(np.clip(cells["reach"].to_numpy(), -1, 1))) if len(cells) else None)

        @F.pandas_udf("array<int>")
        def chosen(q: pd.Series, least: pd.Series) -> pd.Series:
            if shared.value is None or not len(q):
                return pd.Series([[] for _ in range(len(q))])
            centroids, reach = shared.value
            near = np.stack(q.to_numpy()) @ centroids.T
            if probes is not None:
                k = min(probes, len(numbers))
                best = np.argsort(-near, axis=1, kind="stable")[:, :k]
                return pd.Series([numbers[b].tolist() for b in best])
            # The least angle between the query and a row of a cell is the one to the centroid less the cell's reach.
            angle = np.arccos(np.clip(near, -1, 1)) - reach
            could = np.cos(np.clip(angle, 0, np.pi)) >= least.to_numpy()[:, None] - SLACK
            return pd.Series([numbers[b].tolist() for b in could])

        return queries.select("*", F.posexplode(chosen("q", "least")).alias("place", "cell"))

    def _candidates(self, probed: DataFrame, keep: int) -> DataFrame:
        """query_id, cell, key and guess of the rows that the codes leave: those that may reach `least`, or the `keep` best of each group where least is null."""
        spark = probed.sparkSession
        cells = spark.read.parquet(f"{self.path}/cells").select("cell", "centroid", "rows")
        # A cell's rows are dealt into parts, its queries into blocks; each part meets each block, so a group is bounded.
        parts = F.ceil(F.col("rows") * F.size("centroid") / VALUES).cast("int")
        per_cell = probed.groupBy("cell").agg(F.count("*").alias("asked")).join(F.broadcast(cells), "cell").withColumn("parts", parts).withColumn("blocks", F.ceil(F.col("asked") / QUERIES).cast("int"))
        sizes = F.broadcast(per_cell)
        dealt = lambda n, by: F.pmod(F.xxhash64(by), n).cast("int")
        rows = self._rows(spark).select(self.key, "code", "scale", "error", "cell").join(sizes.select("cell", "parts", "blocks"), "cell")
        rows = rows.withColumn("part", dealt(F.col("parts"), self.key)).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("parts", "blocks")
        asked = probed.join(sizes.select("cell", "parts", "blocks", "centroid"), "cell")
        asked = asked.withColumn("block", dealt(F.col("blocks"), "query_id")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts", "blocks")
        by = ["cell", "part", "block"]

        def compare(qs: pd.DataFrame, rs: pd.DataFrame) -> pd.DataFrame:
            names = ["query_id", "cell", self.key, "guess"]
            if not len(qs) or not len(rs):
                return pd.DataFrame(columns=names)
            q, c = np.stack(qs["q"].to_numpy()), np.array(qs["centroid"].iloc[0])
            code = np.frombuffer(b"".join(rs["code"]), np.int8).reshape(len(rs), -1)
            scale, error = rs["scale"].to_numpy(), rs["error"].to_numpy()
            out = []
            for i in range(0, len(q), 64):
                guess = (q[i : i + 64] @ code.T.astype(np.float64)) * scale + (q[i : i + 64] @ c)[:, None]
                least = qs["least"].to_numpy(np.float64)[i : i + 64, None]
                if np.isnan(least).all():
                    k = min(keep, guess.shape[1])
                    top = np.argpartition(-guess, k - 1, axis=1)[:, :k]
                    a, b = np.repeat(np.arange(len(guess)), k), top.ravel()
                else:
                    # The query has length 1, so the code's error moves the similarity by no more than its length.
                    a, b = np.nonzero(guess + error >= least - SLACK)
                out.append(pd.DataFrame({"query_id": qs["query_id"].to_numpy()[i + a], "cell": qs["cell"].iloc[0], self.key: rs[self.key].to_numpy()[b], "guess": guess[a, b]}, columns=names))
            return pd.concat(out)

        types = dict(rows.dtypes) | dict(probed.dtypes)
        schema = f"query_id {types['query_id']}, cell int, `{self.key}` {types[self.key]}, guess double"
        return asked.groupBy(*by).cogroup(rows.groupBy(*by)).applyInPandas(compare, schema)

    def _ranked(self, queries: DataFrame, found: DataFrame, k: int) -> DataFrame:
        """query_id, rank, key and similarity of the k best candidates by whole vectors; a repeated key counts as often as it is indexed."""
        pairs = found.select("query_id", "cell", self.key).distinct()
        full = pairs.join(self._rows(queries.sparkSession).select("cell", self.key, "vector"), ["cell", self.key]).join(queries.select("query_id", "q"), "query_id")
        similarity = F.pandas_udf(lambda v, q: pd.Series((stacked(v) * np.stack(q.to_numpy())).sum(axis=1)) if len(v) else pd.Series([], dtype=float), "double")
        scored = full.select("query_id", self.key, F.round(similarity("vector", "q"), 9).alias("similarity"))
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("similarity").desc(), self.key))
        return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", self.key, "similarity")

    def _queries(self, queries: DataFrame) -> DataFrame:
        return queries.where(usable(self.vector)).select("query_id", unit(self.vector).alias("q"))

    def search(self, queries: DataFrame, k: int, probes: int, keep: int | None = None) -> DataFrame:
        """query_id, rank, key, similarity: the k nearest rows of each query (query_id, vector) among the `probes` cells nearest to it (see `probes_for`).

        keep: how many rows of a cell the codes leave for whole vectors, 4 x k unless given. Query ids are distinct.
        """
        asked = self._queries(queries)
        found = self._candidates(self._probes(asked.withColumn("least", F.lit(None).cast("double")), probes), keep or 4 * k)
        best = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("guess").desc(), self.key))
        return self._ranked(asked, found.withColumn("_n", best).where(F.col("_n") <= (keep or 4 * k)).drop("_n"), k)

    def probes_for(self, recall: float = 0.97, k: int = 10, sample: int = 256) -> int:
        """How many cells a search must probe to find a share `recall` of the k nearest rows, as measured on `sample` rows of the index (those with the least hashes) against the exact search; a row isn't its own neighbour."""
        if not 0 < recall <= 1:
            raise ValueError("recall: above 0, 1 at most")
        spark = SparkSession.active()
        some = self._rows(spark).orderBy(F.xxhash64(self.key, F.lit("sample")), self.key).limit(sample).select(F.col(self.key).alias("query_id"), F.col("vector").alias(self.vector)).dropDuplicates(["query_id"])
        near = self.search_exact(some, k + 1).where(F.col("query_id") != F.col(self.key))
        held = near.join(self._rows(spark).select(self.key, "cell"), self.key)
        order = self._probes(self._queries(some).withColumn("least", F.lit(None).cast("double")), 4096).select("query_id", "cell", "place")
        needed = held.join(order, ["query_id", "cell"]).agg(F.percentile("place", recall)).first()[0]
        return int(np.ceil(needed or 0)) + 1

    def search_exact(self, queries: DataFrame, k: int, probes: int = 4) -> DataFrame:
        """As search, but with the very k nearest rows: a first search gives each query a similarity that its k-th row reaches, a second one reads all cells and rows that may reach it."""
        asked = self._queries(queries)
        first = self.search(queries, k, probes).where(F.col("rank") == k).select("query_id", F.col("similarity").alias("least"))
        known = asked.join(first, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
        return self._ranked(asked, self._candidates(self._probes(known, None), k), k)
