"""Embeddings, vector tables and the responses of language models, by providers that are passed in."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.columns import confidence, cosine, fenced_json, model_cost

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def embed(chunks: DataFrame, provider: Callable[[list[str]], list[list[float]]], model: str, text: str = "text", batch: int = 32, keep: bool = False) -> DataFrame:
    """chunks with embedding, model and dimensions: the provider gets batches of texts within a task, in order.

    A batch that fails, or gets fewer or more vectors than texts, fails the job; with keep its rows have
    no embedding and the fault as error, and all other batches stand. Write the rows before good and
    failed ones are told apart, or the provider is asked for each of both.
    """

    def one(texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
        try:
            found = provider(texts)
            if len(found) != len(texts):
                raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
        except Exception as e:  # noqa: BLE001  a provider may fail in any way
            if not keep:
                raise
            return [(None, f"{type(e).__name__}: {e}")] * len(texts)
        return [(list(v), None) for v in found]

    @F.pandas_udf("embedding array<float>, error string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = part.fillna("").tolist()
            yield pd.DataFrame([r for i in range(0, len(texts), batch) for r in one(texts[i : i + batch])], columns=["embedding", "error"])

    made = chunks.withColumn("_made", run(text)).withColumn("embedding", F.col("_made.embedding")).withColumn("model", F.lit(model))
    made = made.withColumn("dimensions", F.when(F.col("embedding").isNotNull(), F.size("embedding")))
    return (made.withColumn("error", F.col("_made.error")) if keep else made).drop("_made")


def vector_rows(rows: DataFrame, dimension: int, vector: str = "embedding") -> DataFrame:
    """Rows to append to a vector table: those without a vector are left out, one of another length fails the write."""
    if not 1 <= dimension <= 16_000:
        raise ValueError("dimension: 1 to 16000")
    wrong = F.raise_error(F.concat(F.lit("vector of length "), F.size(vector).cast("string")))
    return rows.where(F.col(vector).isNotNull()).withColumn(vector, F.when(F.size(vector) == dimension, F.col(vector)).otherwise(wrong))


def vector_table(name: str) -> str:
    """A table's name, if it is an identifier."""
    if not NAME.fullmatch(name):
        raise ValueError(f"{name!r} is not an identifier")
    return name


def wrong_dimensions(rows: DataFrame, dimension: int, vector: str = "embedding") -> DataFrame:
    return rows.where(F.col(vector).isNull() | (F.size(vector) != dimension))


def cosine_top(rows: DataFrame, query: Sequence[float], k: int, key: str, vector: str = "embedding") -> DataFrame:
    """The k rows nearest to one query vector, exactly; each task keeps k."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.select(key, F.round(cosine(F.col(vector), q), 6).alias("similarity")).orderBy(F.col("similarity").desc(), key).limit(k)


def neighbours(rows: DataFrame, part: str, order: str, vector: str = "embedding") -> DataFrame:
    """order and the similarity to the row before it within a part."""
    before = F.lag(vector).over(W.partitionBy(part).orderBy(order))
    return rows.select(part, order, F.when(before.isNotNull(), F.round(cosine(F.col(vector), before), 6)).alias("similarity"))


def ask(rows: DataFrame, provider: Callable[[str], str], prompt: str, as_name: str = "response") -> DataFrame:
    """rows with a provider's answer to the prompt column, asked once for each row."""
    return rows.withColumn(as_name, F.pandas_udf(lambda s: s.map(lambda p: None if p is None else provider(p)), "string")(prompt))


def classification(rows: DataFrame, response: str, categories: Sequence[str]) -> DataFrame:
    """rows with category, confidence, expected (the category is one of those asked for) and success (the response could be read)."""
    text = fenced_json(F.col(response))
    value = F.try_parse_json(text)
    category = F.try_variant_get(value, "$.category", "string")
    sure = confidence(F.try_variant_get(value, "$.confidence", "string"))
    return rows.withColumn("category", category).withColumn("confidence", F.when(text.isNotNull(), sure)).withColumn("expected", F.coalesce(category.isin(*categories), F.lit(False))).withColumn("success", text.isNotNull())


def extraction(rows: DataFrame, response: str, schema: str) -> DataFrame:
    """rows with extracted (by the schema), success and, where the response can't be read, raw_response."""
    text = fenced_json(F.col(response))
    return rows.withColumn("extracted", F.from_json(text, schema)).withColumn("success", text.isNotNull()).withColumn("raw_response", F.when(text.isNull(), F.col(response)))


def prompt_to_classify(text: str, categories: Sequence[str]) -> str:
    return "Choose one category for the text: " + ", ".join(categories) + '. Answer as JSON: {"category": ..., "confidence": 0 to 1}.\n\n' + text


def prompt_to_extract(text: str, fields: dict[str, str]) -> str:
    return "Extract these fields as JSON: " + json.dumps(fields, sort_keys=True) + "\n\n" + text


def prompt_to_summarize(text: str, words: int) -> str:
    return f"Summarize the text in at most {words} words.\n\n{text}"


def costs(usage: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """usage (model, prompt_tokens, completion_tokens) with cost, by a table of prices per million; unknown models are free."""
    priced = usage.join(prices, model, "left")
    return priced.withColumn("cost", F.round(model_cost(F.col("prompt_tokens"), F.col("prompt_price")) + model_cost(F.col("completion_tokens"), F.col("completion_price")), 10))
