"""Mixing sources to target weights: hash-random order, prefix sums, exact budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import identified, stage

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(by_source: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """Adds rank, weight and target to (source, source_size), a table of one row per source.

    Targets share the sum of all sizes by weight and stop at cap times the source's size; what is
    over is shared again by weight. Closed form: with sources in order of cap/weight, a source is
    capped if its ratio is at most the level that the others would then have.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    ratio = W.orderBy("ratio", "rank")
    before, after, whole = ratio.rowsBetween(W.unboundedPreceding, -1), ratio.rowsBetween(0, W.unboundedFollowing), ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = by_source.withColumn("rank", F.row_number().over(order))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    full = F.col("source_size") * F.lit(float(cap))
    levels = (
        ranked.withColumn("weight", weight.cast("double"))
        .withColumn("ratio", full / F.col("weight"))
        .withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum(full).over(before), F.lit(0.0))) / F.sum("weight").over(after))
        .withColumn("level", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "rank", "level"))).over(whole)["level"])
    )
    return levels.withColumn("target", F.coalesce(F.least(full, F.col("weight") * F.col("level")), full)).drop("ratio", "level")


def mix_sources(docs: DataFrame, text: str = "text", weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, seed: str = "mix", buckets: int = 4096, keep: tuple[str, ...] = ()) -> DataFrame:
    """Returns doc_id, size, source_size, target, taken (and the columns named in keep) for every row of docs (doc_id, source, text).

    Each row gets a random key from md5(seed, doc_id); within a source, rows are in key order. The
    mix takes whole passes over a source while the budget floor(target) allows, then rows in order
    up to the exact budget; the row at the cut is taken in part. Rows are dealt by (source, key
    range), `buckets` ranges, so a source that holds most rows is spread over as many groups; prefix
    sums over ranges are added from a table of one row per source and range.

    Null texts and texts without words have size 0 and taken 0. A null source is a source of its
    own, last in order. The key of a row whose doc_id is null is drawn from its text. Rows with equal
    keys are ordered by doc_id and size; those that are equal in both are interchangeable. An empty table gives an empty result.
    """
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))).cast("binary"))
    rows = docs.select(
        "doc_id", *keep, word_count(text).alias("size"),
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_s"), key.alias("_key"),
    ).withColumn("_b", F.pmod(F.conv(F.substring("_key", 1, 4), 16, 10).cast("int") * buckets / F.lit(65536), F.lit(buckets)).cast("int"))
    by_bucket = rows.groupBy("_s", "_b").agg(F.sum("size").alias("_sum"))
    by_source = by_bucket.groupBy("_s").agg(F.sum("_sum").alias("source_size")).withColumn("source", F.when(F.col("_s") != "n", F.substring("_s", 2, 1 << 30)))
    budget = targets(by_source, weights, cap).select(F.col("_s").alias("_t"), "source_size", "target")
    earlier = W.partitionBy("_s").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    ranges = by_bucket.withColumn("_from", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).join(budget, F.col("_s") == F.col("_t")).select("_s", "_b", "_from", "source_size", "target")
    within = W.partitionBy("_s", "_b").orderBy("_key", "doc_id", "size", *keep).rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("_in", F.coalesce(F.sum("size").over(within), F.lit(0))).join(ranges, ["_s", "_b"])
    total = F.floor("target")
    passes = F.when(F.col("source_size") > 0, F.floor(total / F.col("source_size"))).otherwise(0)
    rest = total - passes * F.col("source_size") - F.col("_from") - F.col("_in")
    taken = passes * F.col("size") + F.least(F.greatest(rest, F.lit(0)), F.col("size"))
    return placed.select("doc_id", *keep, "size", "source_size", "target", taken.cast("long").alias("taken"))


def take_mix(docs: DataFrame, text: str = "text", length: str | None = "n_chars", **options: object) -> DataFrame:
    """docs as the mix of `mix_sources` takes them: rows repeated for each pass, the row at a source's cut shortened to the words taken, rows not taken left out.

    A shortened text's words are joined by single spaces; the column `length`, if there is one, is set to its characters.
    """
    rows = identified(docs.select(F.struct("*").alias("_row"))).withColumnRenamed("uid", "_uid")
    narrow = rows.select("_row.doc_id", "_row.source", F.col(f"_row.`{text}`").alias("_text"), "_uid")
    taken = stage(mix_sources(narrow, "_text", keep=("_uid",), **options).where("taken > 0").select("_uid", "size", "taken"), "taken")
    each = rows.join(taken, "_uid").withColumn("_left", F.explode(F.expr("transform(sequence(0L, (taken - 1) div size), i -> least(size, taken - i * size))")))
    words = F.regexp_extract_all(F.col(f"_row.`{text}`"), F.lit(WORD), F.lit(0))
    short = F.when(F.col("_left") < F.col("size"), F.array_join(F.slice(words, 1, F.col("_left").cast("int")), " ")).otherwise(F.col(f"_row.`{text}`"))
    out = each.select("_row", short.alias("_text"))
    columns = {text: F.col("_text")} | ({length: F.length("_text").cast(docs.schema[length].dataType)} if length in docs.columns else {})
    return out.select(*[columns.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
