"""Recognised tables, as cells with spans, into rows under named columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# What a table may have at most.
MOST_ROWS_OR_COLUMNS, MOST_PLACES, MOST_CELLS = 10_000, 1_000_000, 250_000
ROWS_IN_BATCH = 500


def table_faults(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """table_id and fault of tables (table_id, row_count, column_count) that break a rule with their cells (table_id, row, column, rowspan, colspan): sizes, places out of the table, overlaps.

    Places are compared only where all cells lie within a table of allowed size, so at most a
    million are looked at for a table. Places without a cell are allowed.
    """
    size = F.when((F.col("row_count") < 0) | (F.col("column_count") < 0) | F.col("row_count").isNull() | F.col("column_count").isNull(), "sizes are 0 or more")
    size = size.when((F.col("row_count") > MOST_ROWS_OR_COLUMNS) | (F.col("column_count") > MOST_ROWS_OR_COLUMNS), "too many rows or columns")
    size = size.when((F.col("row_count") == 0) != (F.col("column_count") == 0), "rows without columns, or columns without rows")
    size = size.when(F.col("row_count").cast("long") * F.col("column_count") > MOST_PLACES, "too many places")
    counted = cells.groupBy("table_id").agg(F.count("*").alias("_cells"))
    known = tables.join(counted, "table_id", "left").withColumn("fault", F.coalesce(size, F.when(F.col("_cells") > MOST_CELLS, "too many cells")))
    sized = known.where("fault is not null").select("table_id", "fault")
    inside = cells.join(known.where("fault is null").select("table_id", "row_count", "column_count"), "table_id")
    wrong = (F.col("row") < 0) | (F.col("column") < 0) | (F.col("rowspan") < 1) | (F.col("colspan") < 1)
    over = (F.col("row") + F.col("rowspan") > F.col("row_count")) | (F.col("column") + F.col("colspan") > F.col("column_count"))
    placed = inside.groupBy("table_id").agg(F.max(F.when(F.coalesce(wrong, F.lit(True)), "a cell's place or span is wrong").when(over, "a cell leaves the table")).alias("fault"))
    outside = placed.where("fault is not null")
    rows = inside.join(outside.select("table_id"), "table_id", "left_anti").select("table_id", "column", "colspan", F.explode(F.sequence("row", F.col("row") + F.col("rowspan") - 1)).alias("row"))
    # In a row a cell overlaps the one before if it begins before that one's end, by a sweep over their beginnings.
    before = F.max(F.col("column") + F.col("colspan")).over(W.partitionBy("table_id", "row").orderBy("column", "colspan").rowsBetween(W.unboundedPreceding, -1))
    overlaps = rows.withColumn("_end", before).where(F.col("_end") > F.col("column")).select("table_id", F.lit("cells overlap").alias("fault")).distinct()
    return sized.unionByName(outside).unionByName(overlaps)


def header_rows(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """tables with header: how many rows its headers take, down to the end of the lowest header cell (header_level set); one without such cells."""
    lowest = cells.where("header_level is not null").groupBy("table_id").agg(F.max(F.col("row") + F.col("rowspan")).alias("_low"))
    return tables.join(lowest, "table_id", "left").withColumn("header", F.least(F.coalesce("_low", F.lit(1)), F.col("row_count"))).drop("_low")


def table_columns(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """table_id, col and name of each column: the texts of all cells over it in the header's rows, from top to bottom, joined by ' / '; column_1, ... without any. A name that has come before gets its count."""
    top = cells.join(header_rows(tables, cells).select("table_id", "header"), "table_id").where((F.col("row") < F.col("header")) & (F.trim("text") != ""))
    over = top.select("table_id", "row", F.trim("text").alias("text"), F.explode(F.sequence("column", F.col("column") + F.col("colspan") - 1)).alias("col"))
    named = over.groupBy("table_id", "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "text"))), lambda c: c["text"]), " / ").alias("base"))
    every = tables.where("column_count > 0").select("table_id", F.explode(F.sequence(F.lit(0), F.col("column_count") - 1)).alias("col"))
    full = every.join(named, ["table_id", "col"], "left").withColumn("base", F.coalesce("base", F.concat(F.lit("column_"), (F.col("col") + 1).cast("string"))))
    nth = F.row_number().over(W.partitionBy("table_id", "base").orderBy("col"))
    return full.select("table_id", "col", F.when(nth == 1, F.col("base")).otherwise(F.concat_ws("_", "base", nth)).alias("name"))


def table_rows(tables: DataFrame, cells: DataFrame, batch_rows: int = ROWS_IN_BATCH) -> DataFrame:
    """table_id, batch, row and values (name to text) of all rows below the headers, `batch_rows` to a batch.

    A cell's value, or else its text, stands where the cell begins; places that a span covers or
    that no cell covers are null. Of columns with one name the last counts. Tables must be without
    faults.
    """
    if batch_rows < 1:
        raise ValueError("a batch has one row at least")
    known = header_rows(tables, cells)
    body = known.where("row_count > header").select("table_id", "header", F.explode(F.sequence("header", F.col("row_count") - 1)).alias("row"))
    columns = table_columns(tables, cells)
    anchors = cells.select("table_id", "row", F.col("column").alias("col"), F.coalesce("value", "text").alias("value"))
    grid = body.join(columns, "table_id").join(anchors, ["table_id", "row", "col"], "left")
    last = grid.groupBy("table_id", "header", "row", "name").agg(F.max(F.struct("col", "value")).alias("v"))
    entries = F.array_sort(F.collect_list(F.struct(F.col("v.col").alias("col"), "name", F.col("v.value").alias("value"))))
    values = F.map_from_entries(F.transform(entries, lambda e: F.struct(e["name"], e["value"])))
    batch = F.floor((F.col("row") - F.col("header")) / batch_rows).cast("int")
    return last.groupBy("table_id", "header", "row").agg(values.alias("values")).select("table_id", batch.alias("batch"), "row", "values")
