"""The corpus pipeline: five stages, each by one operator, each on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import langid, mixing, ngram_join, packing, substring
from millrace.llm.common import read, remainder, stage
from millrace.llm.queries import tokenizer_path
from millrace.storage import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Texts whose language is less sure than this are rejected: few of their n-grams occur in any language that was learned.
LEAST_SURE = 0.1


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, without text or in no known language; learns from the documents' lang."""
    model = langid.fit(docs.where(remainder("doc_id", 4) != 2))
    judged = langid.predict(docs, model, names=("_lang", "_sure"))
    return judged.where((F.col("_lang") != langid.UNKNOWN) & (F.col("_sure") >= LEAST_SURE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return ngram_join.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that have an earlier occurrence are cut; documents of which nothing is left go."""
    cut = substring.cut_repeats(docs)
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return cut.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("n_chars", length).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated and cut to their target shares."""
    return mixing.take_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("substring_dedup", substring_dedup), ("source_mix", source_mix), ("packing", pack)]

#: Min-hashes, tokenizers and the order of cuts have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents, each result written before the next one begins; what a stage made its result from is removed then. Stages that are called by themselves leave their tables, as their results are lazy."""
    docs = read(spark, sf_dir, "documents")
    with Scratch() as results:
        for name, step in STAGES[:-1]:
            with Scratch() as scratch:
                docs = scratch.keep(stage(step(spark, docs, sf_dir), name))
        results.keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
