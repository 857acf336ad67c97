"""Splitters and expansions as table functions: one row in, any number out, in plans and in SQL through LATERAL."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Splitter = Callable[[str], Iterable[tuple[str, str]]]


def whole(text: str) -> Iterator[tuple[str, str]]:
    """The splitter that leaves a text as it is."""
    yield "text", text


def windows(size: int, overlap: int = 0) -> Splitter:
    """Pieces of size characters, each beginning overlap characters before the end of the one before; a text has one at least."""
    if not 0 <= overlap < size:
        raise ValueError("overlap: 0 or more, less than size")

    def split(text: str) -> Iterator[tuple[str, str]]:
        for i in range(0, max(len(text) - overlap, 1), size - overlap):
            yield "text", text[i : i + size]

    return split


def paragraphs(size: int) -> Splitter:
    """Blocks between blank lines, joined while they fit into size characters; a longer block stands alone. A block that starts with # is a heading and starts anew."""
    if size < 1:
        raise ValueError("size: 1 or more")

    def split(text: str) -> Iterator[tuple[str, str]]:
        held: list[str] = []
        length = 0
        for block in (b.strip() for b in text.split("\n\n")):
            if not block:
                continue
            heading = block.startswith("#")
            if held and (heading or length + 2 + len(block) > size):
                yield "text", "\n\n".join(held)
                held, length = [], 0
            if heading:
                yield "heading", block
                continue
            length += len(block) + (2 if held else 0)
            held.append(block)
        if held:
            yield "text", "\n\n".join(held)

    return split


def table_function(splitter: Splitter):
    """The splitter as a table function of a text: index, element_type, text. A null text gives no rows."""

    class Split:
        def eval(self, text: str | None):
            if text is not None:
                yield from ((i, kind, part) for i, (kind, part) in enumerate(splitter(text)))

    return F.udtf(Split, returnType="index int, element_type string, text string")


def register(spark: SparkSession, name: str, splitter: Splitter) -> None:
    """Makes a splitter known to SQL: SELECT ... FROM documents, LATERAL name(text)."""
    spark.udtf.register(name, table_function(splitter))


def split(docs: DataFrame, splitter: Splitter, text: str = "text") -> DataFrame:
    """A row for each part of each text: the columns of docs but text, then index, element_type and the part as text.

    Repeated rows give repeated parts; null and empty texts give none where the splitter gives none.
    """
    keep = [c for c in docs.columns if c not in (text, "index", "element_type", "text")]
    whole_text = docs.select(*keep, F.col(text).alias("_whole"))
    return whole_text.lateralJoin(table_function(splitter)(F.col("_whole").outer())).drop("_whole")


def expand(records: DataFrame, transform: Callable[[dict], Iterable[dict]], stream: str = "stream") -> DataFrame:
    """records put through a function that gives any number of records for one; all columns may change but the stream.

    The write fails, and with it the commit of its checkpoint, if a record would leave its stream.
    """
    names = records.columns

    class Expand:
        def eval(self, row):
            before = row.asDict()
            for made in transform(dict(before)):
                if made.get(stream) != before[stream]:
                    raise ValueError(f"a record of {before[stream]!r} was moved to {made.get(stream)!r}")
                yield tuple(made.get(c) for c in names)

    call = F.udtf(Expand, returnType=records.schema)
    packed = records.select(F.struct(*names).alias("_row"))
    return packed.lateralJoin(call(F.col("_row").outer())).drop("_row")
