import random

import pytest
from pyspark.sql import functions as F

from millrace.sources import tables

TABLES = "table_id string, row_count int, column_count int"
CELLS = "table_id string, row int, column int, rowspan int, colspan int, header_level int, text string, value string"


def brute(rows, columns, cells):
    cover = {(r, c): x for x in cells for r in range(x[1], x[1] + x[3]) for c in range(x[2], x[2] + x[4])}
    begins = {(x[1], x[2]): x for x in cells}
    ends = [x[1] + x[3] for x in cells if x[5] is not None]
    header = min(max(ends) if ends else 1, rows)
    names, seen = [], {}
    for c in range(columns):
        over = []
        for r in range(header):
            x = cover.get((r, c))
            if x and x not in over:
                over.append(x)
        base = " / ".join(x[6].strip() for x in over if x[6].strip()) or f"column_{c + 1}"
        seen[base] = seen.get(base, 0) + 1
        names.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    out = []
    for r in range(header, rows):
        values = {}
        for c, name in enumerate(names):
            x = begins.get((r, c))
            values[name] = None if x is None else x[7] if x[7] is not None else x[6]
        out.append((r, (r - header) // 3, values))
    return names, out


def artifact(r, name):
    rows, columns = r.randrange(1, 9), r.randrange(1, 7)
    free, cells = {(a, b) for a in range(rows) for b in range(columns)}, []
    for _ in range(30):
        a, b = r.randrange(rows), r.randrange(columns)
        h, w = min(r.choice([1, 1, 2, 3]), rows - a), min(r.choice([1, 1, 2, 3]), columns - b)
        places = {(x, y) for x in range(a, a + h) for y in range(b, b + w)}
        if places <= free:
            free -= places
            cells.append((name, a, b, h, w, r.choice([None, None, 0, 1]) if a < 2 else None, r.choice(["x", "y ", " ", "", "Year"]), r.choice([None, None, "7"])))
    return (name, rows, columns), cells


def test_rows_and_columns_against_brute_force(spark):
    r = random.Random(1)
    made = [artifact(r, f"t{i}") for i in range(60)] + [(("empty", 0, 0), []), (("bare", 2, 2), [])]
    heads, cells = spark.createDataFrame([m[0] for m in made], TABLES), spark.createDataFrame([c for m in made for c in m[1]], CELLS)
    assert tables.table_faults(heads, cells).collect() == []
    names = {}
    for x in tables.table_columns(heads, cells).orderBy("table_id", "col").collect():
        names.setdefault(x.table_id, []).append(x.name)
    got = {(x.table_id, x.row): (x.batch, x["values"]) for x in tables.table_rows(heads, cells, 3).collect()}
    want = {}
    for (name, rows, columns), own in made:
        expected, body = brute(rows, columns, own)
        assert names.get(name, []) == expected
        want |= {(name, row): (batch, values) for row, batch, values in body}
    assert got == want


def test_faults(spark):
    one = lambda t, *c: (t, *c, None, "x", None)
    heads = [("fine", 2, 2), ("overlap", 3, 3), ("leaves", 2, 2), ("negative", -1, 2), ("flat", 0, 3), ("wide", 1, 20_000), ("grid", 5000, 5000), ("span", 2, 2)]
    cells = [one("fine", 0, 0, 1, 2), one("fine", 1, 0, 1, 1), one("overlap", 0, 1, 3, 1), one("overlap", 1, 0, 1, 3), one("leaves", 1, 1, 1, 2), one("span", 0, 0, 0, 1)]
    got = {x.table_id: x.fault for x in tables.table_faults(spark.createDataFrame(heads, TABLES), spark.createDataFrame(cells, CELLS)).collect()}
    assert got == {"overlap": "cells overlap", "leaves": "a cell leaves the table", "negative": "sizes are 0 or more", "flat": "rows without columns, or columns without rows", "wide": "too many rows or columns", "grid": "too many places", "span": "a cell's place or span is wrong"}
    with pytest.raises(ValueError):
        tables.table_rows(spark.createDataFrame(heads, TABLES), spark.createDataFrame(cells, CELLS), 0)


def test_a_large_table(spark):
    heads = spark.createDataFrame([("big", 10_000, 25)], TABLES)
    cells = spark.range(250_000).select(F.lit("big").alias("table_id"), (F.col("id") / 25).cast("int").alias("row"), (F.col("id") % 25).cast("int").alias("column"), F.lit(1).alias("rowspan"), F.lit(1).alias("colspan"), F.when(F.col("id") < 25, 0).alias("header_level"), F.col("id").cast("string").alias("text"), F.lit(None).cast("string").alias("value"))
    assert tables.table_faults(heads, cells).collect() == []
    rows = tables.table_rows(heads, cells)
    assert rows.agg(F.count("*"), F.max("batch"), F.sum(F.size("values"))).first()[:] == (9_999, 19, 249_975)
    assert rows.where("row = 7").first()["values"]["3"] == "178"
    assert tables.table_faults(heads, cells.unionByName(cells.limit(1))).first()["fault"] == "too many cells"
