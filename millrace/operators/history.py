"""Questions to the tables that runs leave behind: lineage, provenance, dead letters, versions, storage, indexes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lineage_of_graph(lineage: DataFrame, runs: DataFrame, graph_id: Column | int | str, limit: int = 100) -> DataFrame:
    """The newest lineage entries (run_id, created_at, ...) of all runs (run_id, graph_id) of a graph. Of equally old ones the order is that of all columns."""
    mine = runs.where(F.col("graph_id") == graph_id).select("run_id").distinct()
    rest = [c for c in lineage.columns if c != "created_at"]
    return lineage.join(mine, "run_id", "left_semi").orderBy(F.col("created_at").desc(), *rest).limit(limit)


def owned(rows: DataFrame, runs: DataFrame, graphs: DataFrame, owner: Column | int | str) -> DataFrame:
    """rows (run_id, ...) of runs of graphs (graph_id, owner_id) of the owner; rows without a run or a graph are left out."""
    mine = runs.join(graphs.where(F.col("owner_id") == owner), "graph_id", "left_semi")
    return rows.join(mine.select("run_id"), "run_id", "left_semi")


def lineage_of_source(provenance: DataFrame, lineage: DataFrame, source_ref: str, runs: DataFrame | None = None, graphs: DataFrame | None = None, owner: Column | int | str | None = None) -> DataFrame:
    """run_id, provenance and lineage (structs) of all runs that read a source: a row for each pair, one with null lineage for a run without any. owner: of this owner's runs alone."""
    records = provenance.where(F.col("source_ref") == source_ref)
    if owner is not None:
        if runs is None or graphs is None:
            raise ValueError("an owner is found through runs and graphs")
        records = owned(records, runs, graphs, owner)
    said = records.select("run_id", F.struct(*records.columns).alias("provenance"))
    return said.join(lineage.select("run_id", F.struct(*lineage.columns).alias("lineage")), "run_id", "left")


def next_versions(versions: DataFrame, of: DataFrame, key: str) -> DataFrame:
    """key and the version that comes next: one after the last, 1 where there is none."""
    last = versions.groupBy(key).agg(F.max("version").alias("_last"))
    return of.select(key).distinct().join(last, key, "left").select(key, (F.coalesce("_last", F.lit(0)) + 1).alias("version"))


def storage_used(files: DataFrame, owner: str = "owner_id", size: str = "size") -> DataFrame:
    """owner and used, the bytes of all their files; null sizes count as 0."""
    return files.groupBy(owner).agg(F.sum(F.coalesce(size, F.lit(0))).alias("used"))


def by_price(models: DataFrame, price: str, name: str, missing: float = 999.0) -> DataFrame:
    """models from the cheapest on; those without a price count as `missing`. Equal prices go by name."""
    return models.orderBy(F.coalesce(price, F.lit(missing)), name)


def deselected(before: DataFrame, now: DataFrame, key: Sequence[str] = ("source", "stream")) -> DataFrame:
    """Streams that were selected before and aren't now, once each. Null parts are equal."""
    return before.select(*key).subtract(now.select(*key))


def unique_key(indexes: DataFrame, columns: DataFrame, fields: Sequence[str]) -> DataFrame:
    """index and names of the unique indexes (index, is_unique, positions: array) over exactly these fields. columns: position, name of the table's columns."""
    parts = indexes.where("is_unique").select("index", F.posexplode("positions").alias("nth", "position"))
    named = parts.join(columns, "position", "left")
    lists = named.groupBy("index").agg(F.array_sort(F.collect_list(F.struct("nth", "name")))["name"].alias("names"))
    return lists.where(F.array_sort("names") == F.array(*[F.lit(f) for f in sorted(fields)]))
