"""Graphs of typed nodes, compiled into lazy DataFrames."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.storage import written

PORT_TYPES = ("any", "file_list", "table", "json", "document", "chunks", "embeddings", "text", "items")  # fixed values


@dataclass(frozen=True)
class NodeType:
    """What a node of this type takes and gives (port to port type), needs in its settings, and does."""

    name: str
    inputs: dict[str, str]
    outputs: dict[str, str]
    run: Callable[..., dict[str, DataFrame]]
    required: tuple[str, ...] = ()
    many: frozenset[str] = frozenset()


@dataclass(frozen=True)
class Edge:
    source: str
    target: str
    source_port: str = "out"
    target_port: str = "in"


@dataclass
class Registry:
    types: dict[str, NodeType] = field(default_factory=dict)

    def add(self, kind: NodeType) -> NodeType:
        if kind.name in self.types:
            raise ValueError(f"{kind.name}: registered twice")
        if wrong := [t for t in (*kind.inputs.values(), *kind.outputs.values()) if t not in PORT_TYPES]:
            raise ValueError(f"{kind.name}: no port type {wrong[0]}")
        self.types[kind.name] = kind
        return kind


@dataclass
class Graph:
    """nodes: id to {"type", "config"}."""

    nodes: dict[str, dict]
    edges: list[Edge]

    def checksum(self) -> str:
        """Of a version: SHA-256 of its canonical JSON."""
        body = {"nodes": self.nodes, "edges": sorted([e.source, e.source_port, e.target, e.target_port] for e in self.edges)}
        return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    def levels(self) -> list[list[str]]:
        """Nodes by the longest way to them; edges with unknown ends are ignored. ValueError for a cycle."""
        parents = {n: {e.source for e in self.edges if e.target == n and e.source in self.nodes} for n in self.nodes}
        level: dict[str, int] = {}
        while ready := [n for n, p in parents.items() if n not in level and p <= level.keys()]:
            level |= {n: 1 + max((level[p] for p in parents[n]), default=-1) for n in ready}
        if len(level) < len(self.nodes):
            raise ValueError("the graph has a cycle")
        return [sorted(n for n in level if level[n] == k) for k in range(max(level.values(), default=-1) + 1)]

    def errors(self, registry: Registry) -> list[str]:
        """What is wrong with the graph: ends, types, ports, settings, a cycle."""
        out = []
        for n, spec in self.nodes.items():
            if not (kind := registry.types.get(spec["type"])):
                out.append(f"{n}: no node type {spec['type']}")
            else:
                out += [f"{n}: {k} is missing" for k in kind.required if spec.get("config", {}).get(k) in (None, "")]
        for e in self.edges:
            if missing := [x for x in (e.source, e.target) if x not in self.nodes]:
                out.append(f"edge to or from {missing[0]}, which isn't there")
                continue
            a, b = registry.types.get(self.nodes[e.source]["type"]), registry.types.get(self.nodes[e.target]["type"])
            if a and b:
                given, taken = a.outputs.get(e.source_port), b.inputs.get(e.target_port)
                if given is None or taken is None:
                    out.append(f"{e.source}.{e.source_port} to {e.target}.{e.target_port}: no such port")
                elif taken not in ("any", given):
                    out.append(f"{e.source}.{e.source_port} gives {given}, {e.target}.{e.target_port} takes {taken}")
        try:
            self.levels()
        except ValueError as x:
            out.append(str(x))
        return out

    def compile(self, registry: Registry, outputs: dict[str, dict[str, DataFrame]] | None = None) -> dict[str, dict[str, DataFrame]]:
        """Each node's output by port, as plans: nothing runs but what a node itself writes. outputs: of nodes that have run before."""
        if found := self.errors(registry):
            raise ValueError("; ".join(found))
        done = dict(outputs or {})
        for level in self.levels():
            for n in level:
                if n in done:
                    continue
                kind, inputs = registry.types[self.nodes[n]["type"]], {}
                for e in (e for e in self.edges if e.target == n):
                    inputs.setdefault(e.target_port, []).append(done[e.source][e.source_port])
                args = {p: (v if p in kind.many else v[-1]) for p, v in inputs.items()}
                done[n] = kind.run(self.nodes[n].get("config", {}), **args)
        return done

    def to_rerun(self, failed: Iterable[str]) -> set[str]:
        """Failed nodes and all that depend on them."""
        out, new = set(failed), set(failed)
        while new:
            new = {e.target for e in self.edges if e.source in new} - out
            out |= new
        return out


def downstream(edges: DataFrame, failed: DataFrame) -> DataFrame:
    """The same closure over tables: edges (source, target), failed (node).

    A join for each step of the longest way; each step's new nodes are written, so a step's plan reads
    edges and tables alone, however many steps there were.
    """
    rounds = [written(failed.select("node").distinct(), "closure")]
    while True:
        new = rounds[-1].join(edges, F.col("node") == F.col("source")).select(F.col("target").alias("node")).distinct()
        seen = reduce(DataFrame.unionByName, rounds)
        new = written(new.join(seen, "node", "left_anti"), "closure")
        if new.isEmpty():
            return seen
        rounds.append(new)
        if len(rounds) == 32:
            rounds = [written(reduce(DataFrame.unionByName, rounds[:-1]), "closure"), new]


def table_levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and level, the longest way to it, over tables; ValueError for a cycle.

    Nodes that nothing leads to go, with their edges, and so on: a round for each level. Where none
    can go and some are left, those hold a cycle, so it is found after the longest way that leads to it.
    """
    left = written(nodes.select("node").unionByName(edges.select(F.col("target").alias("node"))).distinct(), "left")
    ways = written(edges.select("source", "target").join(left, F.col("source") == F.col("node"), "left_semi").distinct(), "ways")
    out, level = [], 0
    while not left.isEmpty():
        later = ways.select(F.col("target").alias("node")).distinct()
        ready = written(left.join(later, "node", "left_anti").withColumn("level", F.lit(level)), "levels")
        if ready.isEmpty():
            raise ValueError("the graph has a cycle")
        out.append(ready)
        left = written(left.join(ready, "node", "left_anti"), "left")
        ways = written(ways.join(ready, F.col("source") == F.col("node"), "left_anti"), "ways")
        level += 1
        if len(out) == 32:
            out = [written(reduce(DataFrame.unionByName, out), "levels")]
    return reduce(DataFrame.unionByName, out) if out else left.withColumn("level", F.lit(0))
