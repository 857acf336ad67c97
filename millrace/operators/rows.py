"""Filter, transform, split, merge and preview."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.expressions import Expression
from millrace.storage import written


def filter_rows(rows: DataFrame, condition: str) -> tuple[DataFrame, DataFrame]:
    """(matched, rejected): every row is in one of them; a row in which the condition fails is rejected."""
    p = Expression(rows.schema).condition(condition)
    return rows.where(p), rows.where(~p)


def transform_rows(rows: DataFrame, **outputs: str) -> DataFrame:
    """A column for each expression."""
    e = Expression(rows.schema)
    return rows.select(*[e.column(text).alias(name) for name, text in outputs.items()])


def in_ranges(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """rows with _p, the number of their range in order, written once: bounds of ranges are drawn anew by each plan that makes them."""
    return written(rows.repartitionByRange(*[F.col(c) for c in order]).withColumn("_p", F.spark_partition_id()), "ranges")


def running(rows: DataFrame, order: Sequence[str], size: Column, name: str) -> DataFrame:
    """Adds the sum of `size` over all rows before, in order, without gathering them: ranges of the order are summed apart, and each range starts where the ones before it end."""
    ranged = in_ranges(rows.withColumn("_size", size.cast("long")), order)
    inside = F.sum("_size").over(W.partitionBy("_p").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    # One row for each range.
    starts = ranged.groupBy("_p").agg(F.sum("_size").alias("_sum")).select("_p", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    placed = ranged.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(starts), "_p")
    return placed.withColumn(name, F.col("_start") + F.col("_inside")).drop("_p", "_size", "_inside", "_start")


def numbered(rows: DataFrame, order: Sequence[str], name: str = "idx") -> DataFrame:
    """Rows with their positions from 0 in order. Rows with equal keys have positions of their own, in any order."""
    return running(rows, order, F.lit(1), name)


def split_batches(rows: DataFrame, size: int, order: Sequence[str]) -> DataFrame:
    """batch, n and items of batches of `size` rows in order; the last may be shorter."""
    if size < 1:
        raise ValueError("a batch has one row at least")
    placed = numbered(rows, order)
    return placed.groupBy(F.floor(F.col("idx") / size).alias("batch")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("idx", *rows.columns))).alias("items"))


def merge_concat(*inputs: DataFrame, orders: Sequence[Sequence[str]] = ()) -> DataFrame:
    """Rows of all inputs with the number of the input; columns by name, missing ones null.

    orders: for each input the columns that its rows are in order of; then `ordinal` is a row's
    position in its input from 0, and (input, ordinal) the order of the whole.
    """
    if orders and len(orders) != len(inputs):
        raise ValueError("each input needs an order")
    placed = [numbered(rows, by, "ordinal") for rows, by in zip(inputs, orders, strict=True)] if orders else inputs
    out = placed[0].withColumn("input", F.lit(0))
    for n, rows in enumerate(placed[1:], 1):
        out = out.unionByName(rows.withColumn("input", F.lit(n)), allowMissingColumns=True)
    return out


def merge_zip(left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """Rows side by side by position; the shorter input ends it."""
    return numbered(left, left_order).join(numbered(right, right_order), "idx")


def merge_objects(*inputs: DataFrame, key: str) -> DataFrame:
    """Objects of equal key merged deeply: for each path the last input that has it wins; structs are merged field by field."""

    def merged(a: T.DataType | None, b: T.DataType | None, x: Column, y: Column) -> Column:
        if isinstance(a, T.StructType) and isinstance(b, T.StructType):
            fa, fb = {f.name: f.dataType for f in a}, {f.name: f.dataType for f in b}
            both = F.struct(*[(merged(fa[n], fb[n], x[n], y[n]) if n in fa and n in fb else x[n] if n in fa else y[n]).alias(n) for n in dict.fromkeys([*fa, *fb])])
            return F.when(x.isNull(), F.struct(*[(y[n] if n in fb else F.lit(None).cast(fa[n])).alias(n) for n in dict.fromkeys([*fa, *fb])])).otherwise(both)
        return F.coalesce(y, x)

    out = inputs[0]
    for rows in inputs[1:]:
        a, b = out.alias("a"), rows.alias("b")
        ta, tb = {f.name: f.dataType for f in out.schema}, {f.name: f.dataType for f in rows.schema}
        names = [n for n in dict.fromkeys([*ta, *tb]) if n != key]
        value = lambda n: merged(ta[n], tb[n], F.col(f"a.{n}"), F.col(f"b.{n}")) if n in ta and n in tb else F.col(f"a.{n}") if n in ta else F.col(f"b.{n}")  # noqa: B023, E731
        out = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *[value(n).alias(n) for n in names])
    return out


def preview(rows: DataFrame, text: str, order: Sequence[str], n: int = 10, chars: int = 200) -> DataFrame:
    """The first n rows in order, the text cut to `chars` characters with ... after it."""
    cut = F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))).otherwise(F.col(text))
    return rows.orderBy(*order).limit(n).withColumn(text, cut)
