"""Texts to chunks: windows of tokens, separators, HTML sections, topics, document elements.

Windows are expressions. The greedy splitters keep a little state from piece to piece, so they are
small functions on one text, given Arrow batches of which only some texts at a time become Python
objects. A chunk's index over all documents
comes from counts by document, not from a window over all chunks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from html.parser import HTMLParser
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import words
from millrace.operators.rows import running

DEFAULT_SEPARATORS = "\\n\\n,\\n,. , , "  # fixed: as written in settings, backslashes escaped
AT_ONCE = 1 << 20  # characters of texts whose parts are Python objects at once, and a text's more


def in_parts(split: Callable[[str | None], list], kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches (doc, text) to batches (doc, _p), the parts of each text; a batch goes out after AT_ONCE characters, however many rows came in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, held, made = 0, 0, []
            for i, value in enumerate(batch.column(1)):
                text = value.as_py()
                made.append(split(text))
                held += len(text or "")
                if held >= AT_ONCE or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(made)), pa.array(made, pa.list_(kind))], ["doc", "_p"])
                    first, held, made = i + 1, 0, []

    return run


def parts_of(docs: DataFrame, doc: str, text: str, split: Callable[[str | None], list], kind: pa.DataType, sql: str) -> DataFrame:
    """doc and _p: an array of what split makes of each text. kind and sql: the type of a part, for Arrow and for Spark."""
    schema = T.StructType([T.StructField("doc", docs.schema[doc].dataType), *T.StructType.fromDDL(f"_p array<{sql}>")])
    return docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).mapInArrow(in_parts(split, kind), schema).withColumnRenamed("doc", doc)


def windows(tokens: Column, size: int, overlap: int) -> Column:
    """Slices of `size` tokens, each starting size - overlap after the one before, while the start is within."""
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the chunk")
    n = F.size(tokens)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(tokens, i + 1, size))


def chunk_tokens(docs: DataFrame, doc: str, text: str = "text", size: int = 512, overlap: int = 50, unit: str = "words", encode: Callable[[str], Sequence[int]] | None = None, decode: Callable[[Sequence[int]], str] | None = None) -> DataFrame:
    """doc, local, text and chunk_tokens for windows over words, characters or the tokens of an encoding that is passed in."""
    if unit == "words":
        tokens, glue = words(F.col(text)), lambda t: F.array_join(t, " ")
    elif unit == "chars":
        if overlap >= size:
            raise ValueError("the overlap must be smaller than the chunk")
        n = F.length(text)
        starts = F.sequence(F.lit(0), n - 1, F.lit(size - overlap))
        rows = docs.where(F.trim(text) != "").select(doc, F.col(text).alias("_t"), F.posexplode(starts).alias("local", "_i"))
        piece = F.substring(F.col("_t"), F.col("_i") + 1, F.lit(size))
        return rows.select(doc, "local", piece.alias("text"), F.length(piece).alias("chunk_tokens"))
    elif encode and decode:
        split = lambda t: [] if t is None or not t.strip() else [{"text": decode(x := list(encode(t))[i : i + size]), "n": len(x)} for i in range(0, len(encode(t)), size - overlap)]
        made = parts_of(docs, doc, text, split, pa.struct([("text", pa.string()), ("n", pa.int32())]), "struct<text:string,n:int>")
        return made.select(doc, F.posexplode("_p").alias("local", "_c")).select(doc, "local", F.col("_c.text").alias("text"), F.col("_c.n").alias("chunk_tokens"))
    else:
        raise ValueError("tokens of an encoding need encode and decode")
    return docs.select(doc, F.posexplode(windows(tokens, size, overlap)).alias("local", "_w")).select(doc, "local", glue(F.col("_w")).alias("text"), F.size("_w").alias("chunk_tokens"))


def with_index(chunks: DataFrame, doc: str) -> DataFrame:
    """Adds chunk_index over all documents in order of doc: local plus the chunks of the documents before."""
    counts = chunks.groupBy(doc).agg(F.count("*").alias("_n"))
    starts = running(counts, [doc], F.col("_n"), "_s").select(doc, "_s")
    return chunks.join(starts, doc).withColumn("chunk_index", F.col("_s") + F.col("local")).drop("_s")


def unescape(separators: str) -> list[str]:
    """Separators between commas, with \\n, \\t, \\r and \\\\ unescaped; an empty one is an error."""
    out = [re.sub(r"\\([ntr\\])", lambda m: {"n": "\n", "t": "\t", "r": "\r", "\\": "\\"}[m[1]], s) for s in separators.split(",")]
    if "" in out:
        raise ValueError("an empty separator")
    return out


def by_separators(text: str, size: int, separators: Sequence[str]) -> list[str]:
    """Pieces of at most `size` characters: packed between the first separator, what is longer split by the next ones, at last by length."""
    if len(text) <= size:
        return [text] if text else []
    if not separators:
        return [text[i : i + size] for i in range(0, len(text), size)]
    mark, out, room = separators[0], [], 0
    for piece in text.split(mark):
        if len(piece) > size:
            out += by_separators(piece, size, separators[1:])
            room = 0
        elif room and len(mark) + len(piece) <= room:
            out[-1] += mark + piece
            room -= len(mark) + len(piece)
            room = room or -1
        elif piece:
            out.append(piece)
            room = size - len(piece) or -1
        elif room:
            room = 0
    return out


def chunk_recursive(docs: DataFrame, doc: str, text: str = "text", size: int = 1000, overlap: int = 200, separators: str = DEFAULT_SEPARATORS) -> DataFrame:
    """doc, local and text: pieces between separators, blank ones dropped, each followed by the first `overlap` characters of the next."""
    marks = unescape(separators)
    made = parts_of(docs, doc, text, lambda t: by_separators(t, size, marks) if t and t.strip() else [], pa.string(), "string")
    pieces = F.filter("_p", lambda p: F.regexp_replace(p, r"(?U)\s", "") != "")
    after = lambda p, i: F.concat(p, F.substring(F.coalesce(F.try_element_at(F.col("_p"), i + 2), F.lit("")), 1, overlap))
    rows = made.select(doc, pieces.alias("_p"))
    return rows.select(doc, F.posexplode(F.transform("_p", after) if overlap > 0 else F.col("_p")).alias("local", "text"))


class Sections(HTMLParser):
    """Sections of a page's text: each ends where one of the tags begins or ends. script and style are left out."""

    def __init__(self, tags: frozenset[str]) -> None:
        super().__init__()
        self.tags, self.found, self.parts, self.open, self.hidden = tags, [], [], [], False

    def section(self) -> None:
        if joined := "".join(self.parts).strip():
            self.found.append((joined, tuple(self.open)))
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden = True
        else:
            if tag in self.tags and self.parts:
                self.section()
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = False
        else:
            if tag in self.open:
                del self.open[-1]  # the last tag, whichever it is
            if tag in self.tags:
                self.section()

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def html_sections(html: str, size: int, tags: frozenset[str]) -> list[tuple[str, list[str]]]:
    """(text, open tags) of sections, neighbours joined by a blank line while their texts fit in `size`, longer ones cut."""
    page = Sections(tags)
    page.feed(html)
    page.section()
    joined: list[tuple[str, tuple]] = []
    for text, tags_open in page.found or [(html, ())]:
        if joined and len(joined[-1][0]) + len(text) <= size:
            joined[-1] = (f"{joined[-1][0]}\n\n{text}", tags_open or joined[-1][1])
        else:
            joined.append((text, tags_open))
    return [(text[i : i + size], list(tags_open)) for text, tags_open in joined for i in range(0, len(text), size)]


def chunk_html(docs: DataFrame, doc: str, html: str = "html", size: int = 2000, tags: str = "h1,h2,h3,p,table,section") -> DataFrame:
    """doc, local, text and tag_hierarchy of the sections of pages; blank pages have none."""
    chosen = frozenset(t.strip().lower() for t in tags.split(",") if t.strip())
    split = lambda t: [{"text": x, "tag_hierarchy": y} for x, y in html_sections(t, size, chosen)] if t and t.strip() else []
    made = parts_of(docs, doc, html, split, pa.struct([("text", pa.string()), ("tag_hierarchy", pa.list_(pa.string()))]), "struct<text:string,tag_hierarchy:array<string>>")
    return made.select(doc, F.posexplode("_p").alias("local", "_c")).select(doc, "local", "_c.text", "_c.tag_hierarchy")


def elements(text: str, limit: int = 12_000) -> list[str]:
    """Parts of at most `limit` characters, ending at the last line end, else the last space, in their second half."""
    body = "\n".join(line.rstrip() for line in text.splitlines()).strip()
    out = []
    while len(body) > limit:
        cuts = [c for c in (body.rfind("\n", 0, limit + 1), body.rfind(" ", 0, limit + 1)) if c >= limit // 2]
        cut = cuts[0] if cuts else limit
        out.append(body[:cut].strip())
        body = body[cut:].lstrip()
    return [*out, body] if body else out


def chunk_elements(docs: DataFrame, doc: str, text: str = "text", limit: int = 12_000) -> DataFrame:
    """doc, local and text of a document's elements."""
    made = parts_of(docs, doc, text, lambda t: elements(t, limit) if t else [], pa.string(), "string")
    return made.select(doc, F.posexplode("_p").alias("local", "text"))


def topics(parts: Sequence[str], near: Sequence[float], threshold: float, least: int, most: int) -> list[tuple[str, float]]:
    """(text, mean similarity) of runs of sentences. near[i]: of sentences i and i + 1. A run ends where it is low and the run long enough, or where the next sentence doesn't fit."""
    out, run, seen, length = [], [], [], 0
    close = lambda: out.append((" ".join(run), round(sum(seen) / len(seen), 4) if seen else 1.0))
    for i, s in enumerate(parts):
        low = i > 0 and near[i - 1] < threshold and length >= least
        if run and (low or length + 1 + len(s) > most):
            close()
            run, seen, length = [], [], 0
        length += len(s) + bool(run)
        run.append(s)
        if i:
            seen.append(near[i - 1])
    if run:
        close()
    return out


def chunk_semantic(docs: DataFrame, doc: str, embed: Callable[[list[str]], list[list[float]]], text: str = "text", threshold: float = 0.7, least: int = 100, most: int = 2000, batch: int = 32) -> DataFrame:
    """doc, local, text and similarity_score of runs of sentences on one topic, by embeddings from `embed` (batches of texts).

    A document whose embedding fails is cut by length alone, with no score.
    """

    def cosine(a: Sequence[float], b: Sequence[float]) -> float:
        norm = (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
        return sum(x * y for x, y in zip(a, b, strict=True)) / norm if len(a) == len(b) and norm else 0.0

    def one(value: str | None) -> list[dict]:
        parts = [s.strip() for s in re.split(r"(?<=[.!?])\s+", (value or "").strip()) if s.strip()]
        try:
            vectors = [v for i in range(0, len(parts), batch) for v in embed(parts[i : i + batch])]
            found = topics(parts, [cosine(a, b) for a, b in zip(vectors, vectors[1:])], threshold, least, most)
        except Exception:  # noqa: BLE001  whatever the provider raises
            found = [(t, None) for t, _ in topics(parts, [1.0] * len(parts), -2.0, least, most)]
        return [{"text": t, "similarity_score": s} for t, s in found]

    made = parts_of(docs, doc, text, one, pa.struct([("text", pa.string()), ("similarity_score", pa.float64())]), "struct<text:string,similarity_score:double>")
    return made.select(doc, F.posexplode("_p").alias("local", "_c")).select(doc, "local", "_c.text", "_c.similarity_score")


def hash_embedding(texts: list[str], size: int = 32) -> list[list[float]]:
    """Embeddings without a model: counts of words by hash. The same for the same text, everywhere."""
    import zlib

    out = []
    for t in texts:
        v = [0.0] * size
        for w in t.lower().split():
            v[zlib.crc32(w.encode()) % size] += 1.0
        out.append(v)
    return out


