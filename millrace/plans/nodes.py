"""The node types: each wraps an operator; sources and providers come in by their settings or by `services`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import chunking, models, rows, select, view
from millrace.plans.graph import Edge, Graph, NodeType, Registry
from millrace.sources import files, parsers


def registry(spark: SparkSession, services: dict | None = None) -> Registry:
    """All node types. services: tables (for database_source), embed and complete (providers), sink (writes a table by name)."""
    have = services or {}
    out = Registry()

    def add(name: str, inputs: dict, outputs: dict, run, required: tuple = (), many: frozenset = frozenset()) -> None:
        out.add(NodeType(name, inputs, outputs, run, required, many))

    def docs(config: dict, df: DataFrame) -> tuple[DataFrame, str]:
        return df, config.get("id", "doc_id")

    def batches(c: dict, **p: DataFrame) -> dict:
        return {"batches": rows.split_batches(p["items"], c.get("batch_size", 10), c["order"])}

    def merge(c: dict, **p: list[DataFrame]) -> dict:
        mode, many = c.get("mode", "concat"), p["inputs"]
        if mode == "concat":
            return {"merged": rows.merge_concat(*many)}
        if mode == "zip":
            return {"merged": rows.merge_zip(many[0], many[1], c["order"], c["right_order"])}
        return {"merged": rows.merge_objects(*many, key=c["key"])}

    def both(c: dict, **p: DataFrame) -> dict:
        return dict(zip(("matched", "rejected"), rows.filter_rows(p["items"], c["condition"]), strict=True))

    def sink(c: dict, **p: DataFrame) -> dict:
        have["sink"](c["table"], next(iter(p.values())), c)
        return {"written": next(iter(p.values()))}

    def parse(c: dict, **p: DataFrame) -> dict:
        good, bad = parsers.parse_files(files.contents(spark, p["files"]))
        return {"documents": good, "errors": bad}

    def prompts(c: dict, p: dict, make) -> DataFrame:
        return models.ask(p["documents"].withColumn("_prompt", F.pandas_udf(lambda s: s.map(make), "string")(c.get("text", "text"))), have["complete"], "_prompt").drop("_prompt")

    text = lambda c: c.get("text", "text")
    add("database_source", {}, {"table": "table"}, lambda c: {"table": select.select(spark, c["query"], have["tables"], c.get("batch_size", 1000))}, ("query",))
    add("file_source", {}, {"files": "file_list"}, lambda c: {"files": files.listing(spark, c["path"], c.get("glob"))}, ("path",))
    add("webhook_source", {}, {"payload": "json"}, lambda c: {"payload": spark.createDataFrame([(c["payload"],)], "payload string")}, ("payload",))
    add("file_parser", {"files": "file_list"}, {"documents": "document", "errors": "any"}, parse)
    add("filter", {"items": "any"}, {"matched": "items", "rejected": "items"}, both, ("condition",))
    add("transform", {"items": "any"}, {"items": "items"}, lambda c, **p: {"items": rows.transform_rows(p["items"], **c["outputs"])}, ("outputs",))
    add("split", {"items": "any"}, {"batches": "items"}, batches, ("order",))
    add("merge", {"inputs": "any"}, {"merged": "items"}, merge, (), frozenset({"inputs"}))
    add("chunk_preview", {"chunks": "any"}, {"preview": "items"}, lambda c, **p: {"preview": rows.preview(p["chunks"], text(c), c["order"])}, ("order",))
    add("text_chunker", {"documents": "any"}, {"chunks": "chunks"}, lambda c, **p: {"chunks": chunking.chunk_tokens(*docs(c, p["documents"]), text(c), c.get("chunk_size", 512), c.get("overlap", 50), c.get("unit", "words"))})
    add("recursive_splitter", {"documents": "any"}, {"chunks": "chunks"}, lambda c, **p: {"chunks": chunking.chunk_recursive(*docs(c, p["documents"]), text(c), c.get("chunk_size", 1000), c.get("overlap", 200), c.get("separators", chunking.DEFAULT_SEPARATORS))})
    add("html_splitter", {"documents": "any"}, {"chunks": "chunks"}, lambda c, **p: {"chunks": chunking.chunk_html(*docs(c, p["documents"]), c.get("html", "html"), c.get("max_chunk_size", 2000))})
    add("semantic_chunker", {"documents": "any"}, {"chunks": "chunks"}, lambda c, **p: {"chunks": chunking.chunk_semantic(*docs(c, p["documents"]), have.get("embed", chunking.hash_embedding), text(c))})
    add("embedder", {"chunks": "chunks"}, {"embeddings": "embeddings"}, lambda c, **p: {"embeddings": models.embed(p["chunks"], have.get("embed", chunking.hash_embedding), c.get("model", "hash"), text(c))})
    add("vector_store", {"embeddings": "embeddings"}, {"written": "embeddings"}, lambda c, **p: sink(c, rows=models.vector_rows(p["embeddings"], c["dimension"])), ("table", "dimension"))
    add("llm_classify", {"documents": "any"}, {"items": "items"}, lambda c, **p: {"items": models.classification(prompts(c, p, lambda t: models.prompt_to_classify(t or "", c["categories"])), "response", c["categories"])}, ("categories",))
    add("llm_extract", {"documents": "any"}, {"items": "items"}, lambda c, **p: {"items": models.extraction(prompts(c, p, lambda t: models.prompt_to_extract(t or "", c["fields"])), "response", ", ".join(f"{k} {v}" for k, v in c["fields"].items()))}, ("fields",))
    add("llm_summarize", {"documents": "any"}, {"items": "items"}, lambda c, **p: {"items": prompts(c, p, lambda t: models.prompt_to_summarize(t or "", c.get("words", 100)))})
    add("database_writer", {"table": "any"}, {"written": "any"}, sink, ("table",))
    add("query_store", {"items": "any"}, {"view": "any"}, lambda c, **p: {"view": view.current_view(p["items"])})

    def unsupported(c: dict) -> dict:
        raise NotImplementedError("github_source is not supported")

    add("github_source", {}, {"items": "items"}, unsupported)
    return out


def templates() -> dict[str, Graph]:
    """Ready-made graphs."""
    return {
        "files-to-chunks": Graph({"files": {"type": "file_source", "config": {"path": "documents"}}, "parse": {"type": "file_parser"}, "chunks": {"type": "recursive_splitter", "config": {"id": "path"}}}, [Edge("files", "parse", "files", "files"), Edge("parse", "chunks", "documents", "documents")]),
        "table-to-search": Graph({"rows": {"type": "database_source", "config": {"query": "SELECT * FROM {documents}"}}, "view": {"type": "query_store"}}, [Edge("rows", "view", "table", "items")]),
        "documents-to-vectors": Graph({"rows": {"type": "database_source", "config": {"query": "SELECT * FROM {documents}"}}, "chunks": {"type": "text_chunker"}, "vectors": {"type": "embedder"}, "store": {"type": "vector_store", "config": {"table": "vectors", "dimension": 32}}}, [Edge("rows", "chunks", "table", "documents"), Edge("chunks", "vectors", "chunks", "chunks"), Edge("vectors", "store", "embeddings", "embeddings")]),
    }
