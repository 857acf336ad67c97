import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import vectors


def exact(rows, queries, k):
    keys = np.array([r[0] for r in rows])
    m = np.array([r[1] for r in rows], np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    out = {}
    for i, q in queries:
        q = np.array(q, np.float64)
        s = np.round(m @ (q / np.linalg.norm(q)), 9)
        order = np.lexsort((keys, -s))[:k]
        out[i] = [(int(keys[j]), round(float(s[j]), 6)) for j in order]
    return out


def ranked(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.id, round(r.similarity, 6)))
    return out


def made(n, d, seed, groups=None):
    g = np.random.default_rng(seed)
    base = g.normal(size=(groups or n, d))
    m = base[g.integers(0, len(base), n)] + (0.3 * g.normal(size=(n, d)) if groups else 0)
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(m)]


@pytest.mark.parametrize("groups", [None, 12])
def test_exact_search_equals_brute_force(spark, written, tmp_path, monkeypatch, groups):
    monkeypatch.setattr(vectors, "VALUES", 256)  # cells in parts
    monkeypatch.setattr(vectors, "QUERIES", 3)  # queries in blocks
    rows = made(600, 16, 1, groups)
    rows += [(1000 + i, rows[5][1]) for i in range(200)]  # a third of the rows are one vector
    table = written(rows, "id long, embedding array<float>")
    index = vectors.VectorIndex(str(tmp_path / "index")).build(table, 16, cells=20)
    asked = [r for r in rows if r[0] % 50 == 0][:14]
    queries = spark.createDataFrame(asked, "query_id long, embedding array<float>")
    assert ranked(index.search_exact(queries, 7)) == exact(rows, asked, 7)


def test_recall_and_what_is_read(spark, sf, tmp_path):
    """The number of probes is measured on other queries; the test table's vectors are spread evenly, which is the worst case for cells."""
    table = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    rows = [(r.id, r.embedding) for r in table.collect()]
    index = vectors.VectorIndex(str(tmp_path / "index")).build(table, 64)
    asked = [r for r in rows if r[0] % 50 == 0]
    queries = spark.createDataFrame(asked, "query_id long, embedding array<float>")
    cells = spark.read.parquet(f"{index.path}/cells")
    assert cells.agg(F.sum("rows")).first()[0] == len(rows)
    probes = index.probes_for(0.97)
    probed = index._probes(index._queries(queries).withColumn("least", F.lit(None).cast("double")), probes)
    read = probed.join(cells, "cell").agg(F.sum("rows")).first()[0] / (len(asked) * len(rows))
    got, truth = ranked(index.search(queries, 10, probes)), exact(rows, asked, 10)
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in truth[q]}) / len(truth[q]) for q in truth])
    print("recall", recall, "probes", probes, "of", cells.count(), "read", read)
    assert recall >= 0.95 and read < 0.9


def test_vectors_in_groups_need_few_cells(spark, written, tmp_path):
    rows = made(900, 32, 3, 30)
    index = vectors.VectorIndex(str(tmp_path / "index")).build(written(rows, "id long, embedding array<float>"), 32)
    probes = index.probes_for(0.97)
    asked = [r for r in rows if r[0] % 50 == 0]
    got, truth = ranked(index.search(spark.createDataFrame(asked, "query_id long, embedding array<float>"), 10, probes)), exact(rows, asked, 10)
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in truth[q]}) / 10 for q in truth])
    print("recall", recall, "probes", probes)
    assert recall >= 0.95 and probes <= 6
    with pytest.raises(ValueError):
        index.probes_for(0)


def test_rows_without_direction_ties_and_few_rows(spark, written, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [1e-30, 1e-30])]
    table = written(rows, "id long, embedding array<double>")
    index = vectors.VectorIndex(str(tmp_path / "index")).build(table, 2)
    queries = spark.createDataFrame([(10, [3.0, 0.0]), (11, None), (12, [0.0, 0.0])], "query_id long, embedding array<double>")
    want = {10: [(1, 1.0), (2, 1.0), (8, 0.707107), (2, 0.0)]}
    assert ranked(index.search_exact(queries, 10)) == want and ranked(index.search(queries, 10, 16)) == want
    assert index.search(queries.where("false"), 3, 2).count() == 0


def test_empty_index_and_wrong_lengths(spark, written, tmp_path):
    empty = vectors.VectorIndex(str(tmp_path / "empty")).build(written([], "id long, embedding array<float>"), 3)
    queries = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id long, embedding array<float>")
    assert empty.search(queries, 3, 2).count() == 0 and empty.search_exact(queries, 3).count() == 0
    with pytest.raises(ValueError, match="1 vectors"):
        vectors.VectorIndex(str(tmp_path / "wrong")).build(written([(1, [1.0]), (2, [1.0, 2.0])], "id long, embedding array<float>"), 2)
    assert not (tmp_path / "wrong").exists()
    for dimension in (0, 16_001):
        with pytest.raises(ValueError):
            vectors.VectorIndex(str(tmp_path / "x")).build(queries, dimension)
