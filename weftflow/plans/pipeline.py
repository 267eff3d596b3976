"""Pipeline documents: a graph of nodes, bound to one lazy DataFrame for each node.

A document has `nodes` (id, type, config, onError, disabled) and `edges` (from, to, toPort, fromPort). Binding is lazy, and
Catalyst sees the whole graph as one plan for each result that is asked for, but for what needs to see rows beforehand: a
systematic sample numbers its input, a pivot without `values` and a map that is flattened look for their columns. Several edges into one port are united by
column name. An edge from the port `errors` carries the rows that failed in a node, with their messages.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.formula import FormulaError
from ..operators import NODES, AnalysisError, Inputs, Output
from ..operators.base import parted
from ..operators.relations import union_all

POLICIES = ("stop", "skip", "collect")
#: The milliseconds at which a row is read, by the executor's clock.
CLOCK = "CAST(java_method('java.lang.System', 'currentTimeMillis') AS LONG)"


@dataclass
class Node:
    id: str
    type: str
    config: dict[str, Any] = field(default_factory=dict)
    on_error: str = "skip"
    disabled: bool = False


@dataclass
class Edge:
    source: str
    target: str
    port: str = "in"
    source_port: str = ""


@dataclass
class Result:
    """Of each node its rows, the rows that failed, and its counts once an action has run over an observed pipeline."""

    frames: dict[str, DataFrame]
    errors: dict[str, DataFrame]
    outputs: list[str]
    observed: dict[str, Observation] = field(default_factory=dict)

    def output(self) -> DataFrame:
        if len(self.outputs) != 1:
            raise AnalysisError(f"the pipeline has {len(self.outputs)} outputs: {', '.join(self.outputs)}")
        return self.frames[self.outputs[0]]

    def metrics(self, node: str) -> dict[str, int]:
        return {k: v for k, v in self.observed[node].get.items() if k == "rows"}

    def facts(self, node: str) -> dict[str, int]:
        """What an action over an observed pipeline told of a node: `rows_in`, `rows` that went out, `errors`, and `milliseconds` from the first row in to the last row out.

        Nodes of one stage take rows from each other, so their times overlap; the times are those of the executors' clocks.
        """
        found = {k: v for name in (f"{node}.in", node) if name in self.observed for k, v in self.observed[name].get.items()}
        first, last = found.pop("first_in", None), found.pop("last_out", None)
        return found | ({"milliseconds": max(0, last - first)} if first is not None and last is not None else {})

    def counts(self, node: str) -> dict[str, int]:
        """The rows that came into a node (`rows_in`) and went out (`rows`), once an action has run over an observed pipeline."""
        return {k: v for k, v in self.facts(node).items() if k in ("rows_in", "rows")}

    def failed(self, node: str) -> int:
        """The number of rows that failed in a node: observed, or else by a job."""
        if f"{node}.in" in self.observed and (seen := self.observed[f"{node}.in"].get.get("errors")) is not None:
            return seen
        return self.errors[node].count() if node in self.errors else 0


@dataclass
class Pipeline:
    nodes: list[Node]
    edges: list[Edge]
    id: str = ""
    name: str = ""

    @classmethod
    def parse(cls, document: str | dict[str, Any]) -> Pipeline:
        d = json.loads(document) if isinstance(document, str) else document
        nodes = []
        for n in d.get("nodes", []):
            config = dict(n.get("config") or {})
            policy = n.get("onError") or config.pop("__onError", None) or "skip"
            if policy not in POLICIES:
                raise AnalysisError(f"{n['id']}: onError is {policy!r}")
            nodes.append(Node(n["id"], n["type"], config, policy, bool(n.get("disabled"))))
        edges = [Edge(e["from"], e["to"], e.get("toPort") or "in", e.get("fromPort") or "") for e in d.get("edges", [])]
        found = cls(nodes, edges, d.get("id", ""), d.get("name", ""))
        found.order()
        return found

    def order(self) -> list[Node]:
        """The nodes, each after those that feed it; raises for edges to nowhere, repeated ids, unknown types and cycles."""
        by_id = {n.id: n for n in self.nodes}
        if len(by_id) < len(self.nodes):
            raise AnalysisError("two nodes have one id")
        before: dict[str, set[str]] = {n.id: set() for n in self.nodes}
        for e in self.edges:
            for end in (e.source, e.target):
                if end not in by_id:
                    raise AnalysisError(f"an edge names {end!r}, which is no node")
            before[e.target].add(e.source)
        for n in self.nodes:
            if n.type not in NODES and n.type not in ("input", "output"):
                raise AnalysisError(f"{n.id}: there is no node type {n.type!r}")
        try:
            return [by_id[i] for i in TopologicalSorter(before).static_order()]
        except CycleError as e:
            raise AnalysisError(f"cycle detected: {' -> '.join(e.args[1])}") from None

    def bind(self, sources: dict[str, DataFrame], observe: bool = False, persist_shared: bool = False, part_errors: bool = True) -> Result:
        """DataFrames of all nodes. `persist_shared` keeps what several nodes read, for callers that use several outputs.

        Where an edge takes a node's errors, its input is read once: all rows are written as the node has judged them, parted by
        it, and both ports read their part; without `part_errors` each port reads the input by itself.
        """
        into: dict[str, dict[str, list[Edge]]] = defaultdict(lambda: defaultdict(list))
        for e in self.edges:
            into[e.target][e.port].append(e)
        readers = Counter(e.source for e in self.edges)
        asked = {e.source for e in self.edges if e.source_port == "errors"}
        done = Result({}, {}, [n.id for n in self.nodes if not readers[n.id]])

        def arriving(edges: list[Edge]) -> DataFrame:
            parts = []
            for e in edges:
                found = done.errors.get(e.source) if e.source_port == "errors" else done.frames[e.source]
                if found is None:
                    raise AnalysisError(f"{e.source} has no row errors")
                parts.append(found)
            return union_all(parts)

        for n in self.order():
            ports = {p: arriving(edges) for p, edges in into[n.id].items()}
            main = ports.pop("in", None)
            if n.type == "input":
                if n.id not in sources:
                    raise AnalysisError(f"nothing is bound to the input {n.id!r}")
                out = Output(sources[n.id])
            elif main is None:
                raise AnalysisError(f"{n.id} has no input")
            if n.type == "input":
                pass
            elif n.type == "output" or n.disabled:
                out = Output(main)
            else:
                try:
                    out = NODES[n.type](Inputs(main, ports, n.config, n.on_error))
                    if observe and not main.isStreaming:
                        done.observed[f"{n.id}.in"] = seen = Observation(f"{n.id}.in")
                        errors = [] if out.message is None else [F.count_if(out.message.isNotNull()).alias("errors")]
                        out = NODES[n.type](Inputs(main.observe(seen, F.count(F.lit(1)).alias("rows_in"), F.min(F.expr(CLOCK)).alias("first_in"), *errors), ports, n.config, n.on_error))
                except (AnalysisError, FormulaError) as e:
                    raise AnalysisError(f"{n.id}: {e}") from None
                if n.id in asked and part_errors and out.judged is not None and not main.isStreaming:
                    out = Output(*parted(out.judged))
            df = out.df
            if observe and not df.isStreaming:
                done.observed[n.id] = seen = Observation(f"{n.id}")
                df = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.max(F.expr(CLOCK)).alias("last_out"))
            if persist_shared and readers[n.id] > 1 and not df.isStreaming:
                df = df.persist(StorageLevel.MEMORY_AND_DISK)
            done.frames[n.id] = df
            if out.errors is not None:
                done.errors[n.id] = out.errors
        return done


def run(document: str | dict[str, Any], sources: dict[str, DataFrame]) -> DataFrame:
    """The rows of a pipeline's only output."""
    return Pipeline.parse(document).bind(sources).output()
