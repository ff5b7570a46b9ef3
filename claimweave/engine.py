"""Facade over a graph of nodes and edges: what users call. Results are DataFrames or small answers with a status.

Extensions: resolvers are functions of claims that return edges, registered with a precedence; hooks may look at what a
resolver gives and remove edges, but never add any.
"""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.operators import graph, reports, traverse
from claimweave.operators.control import Control
from claimweave.operators.linker import Linker
from claimweave.runtime import materialize
from claimweave.sources.artifacts import digest

Resolver = Callable[[DataFrame], DataFrame]
PHASES = ("broadcast", "join")
SHOWN = 500


@dataclass(frozen=True)
class Config:
    """Settings; unknown names raise."""

    floor: float = graph.FLOOR
    fusion_cap: float = graph.FUSION_CAP
    fanout_cap: int = graph.FANOUT_CAP
    levels: int = 4

    @classmethod
    def of(cls, **settings) -> Config:
        unknown = settings.keys() - cls.__dataclass_fields__.keys()
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**settings)


@dataclass
class Answer:
    """A bounded answer: status is present, known_empty, unknown_target or ambiguous; totals are counted before any limit."""

    status: str
    rows: list = field(default_factory=list)
    total: int = 0
    truncated: bool = False
    candidates: list = field(default_factory=list)
    snapshot: str = ""

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True, default=str)


def _wants_edges(resolver: Resolver) -> bool:
    return len(inspect.signature(resolver).parameters) > 1


class Registry:
    def __init__(self) -> None:
        self.resolvers: list[tuple[int, str, str, Resolver]] = []
        self.pre: list[Callable] = []
        self.post: list[Callable[[str, DataFrame], DataFrame]] = []
        self.failures: list[str] = []

    def register(self, name: str, resolver: Resolver, phase: str = "join", precedence: int = 500) -> None:
        if phase not in PHASES:
            raise ValueError(f"phase is one of {PHASES}")
        if not callable(resolver):
            raise ValueError("a resolver is a function of claims")
        if any(n == name for _, _, n, _ in self.resolvers):
            raise ValueError(f"{name} is registered twice")
        self.resolvers.append((precedence, phase, name, resolver))
        self.resolvers.sort(key=lambda r: (PHASES.index(r[1]), r[0], r[2]))

    def link(self, claims: DataFrame) -> DataFrame:
        """Edges of all resolvers, phase by phase and in order of precedence; every edge names its resolver in detected_by. A
        resolver of the join phase that takes two arguments also gets the edges of the broadcast phase."""
        out = None
        for _, phase, name, resolver in self.resolvers:
            for hook in self.pre:
                self._observe(hook, name, claims)
            edges = (resolver(claims, out) if phase == "join" and _wants_edges(resolver) else resolver(claims)).withColumn("detected_by", F.lit(name))
            for hook in self.post:
                try:
                    kept = hook(name, edges)
                except Exception as e:  # noqa: BLE001 - a hook that fails changes nothing
                    self.failures.append(f"{name}: {e}")
                    continue
                if kept is not None:
                    edges = edges.join(kept.select("source_id", "type", "target_id").distinct(), ["source_id", "type", "target_id"], "left_semi")
            edges = edges.select("source_id", "type", "target_id", "confidence", "claim_key", "detected_by")
            out = edges if out is None else out.unionByName(edges)
        if out is None:
            raise ValueError("no resolver is registered")
        return out

    def _observe(self, hook: Callable, name: str, claims: DataFrame) -> None:
        try:
            hook(name, claims)
        except Exception as e:  # noqa: BLE001
            self.failures.append(f"{name}: {e}")


class Engine:
    def __init__(self, nodes: DataFrame, edges: DataFrame, config: Config | None = None):
        self.config = config or Config()
        self.raw: DataFrame | None = None
        self._digest: str | None = None
        self.nodes = nodes.distinct()
        self.edges = materialize(graph.with_defaults(edges))
        self.nodes.createOrReplaceTempView("claimweave_nodes")
        self.edges.createOrReplaceTempView("claimweave_edges")

    @classmethod
    def of_claims(cls, claims: DataFrame, nodes: DataFrame, config: Config | None = None, control: Control | None = None) -> Engine:
        """An engine over the edges of a link run; floor, cap of fused confidences and fan-out cap come from the config."""
        config = config or Config()
        control = replace(control or Control(), floor=config.floor, fusion_cap=config.fusion_cap, fanout_cap=config.fanout_cap)
        linked = Linker(claims, control)
        out = cls(nodes, linked.edges(), config)
        out.raw = linked.raw
        return out

    def explain(self, source_id: str, kind: str, target_id: str, limit: int = 100) -> Answer:
        """The rows that an edge was fused from, the surest first; edges that were not linked here stand for themselves."""
        rows = reports.derivation(self.raw, source_id, kind, target_id) if self.raw is not None else self.edges.where((F.col("source_id") == source_id) & (F.col("type") == kind) & (F.col("target_id") == target_id)).select("confidence")
        return self._bounded(rows, limit, F.col("confidence").desc())

    def fused(self) -> DataFrame:
        e = graph.fuse(graph.active(self.edges), self.config.fusion_cap).withColumn("status", F.lit("active"))
        return graph.with_floor(e, self.config.floor)

    def services(self) -> DataFrame:
        return self.nodes.where("type = 'Service'").select("id", "name", "repo_id").distinct()

    def search(self, text: str, limit: int = 20) -> Answer:
        if not 1 <= limit <= 100:
            raise ValueError("limit lies between 1 and 100")
        return self._bounded(graph.search(self.nodes, text).dropDuplicates(["id"]), limit, "tier", "id")

    def node(self, ref: str) -> Answer:
        """A node by its id, or by a name that only one node has."""
        rows = self.nodes.where((F.col("id") == ref) | (F.col("name") == ref)).select("id", "name", "type", "repo_id").distinct()
        exact = rows.where(F.col("id") == ref).limit(1).collect()
        if exact:
            return Answer("present", [r.asDict() for r in exact], 1, snapshot=self.snapshot())
        found = rows.orderBy("id").limit(SHOWN + 1).collect()
        if len(found) == 1:
            return Answer("present", [found[0].asDict()], 1, snapshot=self.snapshot())
        return Answer("ambiguous" if found else "unknown_target", candidates=[r["id"] for r in found[:SHOWN]], total=len(found), truncated=len(found) > SHOWN, snapshot=self.snapshot())

    def _start(self, ref: str) -> tuple[DataFrame | None, Answer]:
        a = self.node(ref)
        if a.status != "present":
            return None, a
        return self.edges.sparkSession.createDataFrame([(a.rows[0]["id"],)], "a string"), a

    def consumers_of(self, ref: str, limit: int = 100) -> Answer:
        start, a = self._start(ref)
        if start is None:
            return a
        rows = traverse.consumers(self.edges).where(F.col("target_id") == a.rows[0]["id"]).select("consumer", "type")
        return self._bounded(rows, limit, "consumer", "type")

    def neighbours(self, ref: str, levels: int = 1, direction: str = "both", limit: int = 100) -> Answer:
        start, a = self._start(ref)
        if start is None:
            return a
        rows = traverse.neighbourhood(traverse.steps(self.edges, direction), start, levels).where("distance > 0").select("node_id", "distance")
        return self._bounded(rows, limit, "distance", "node_id")

    def impact(self, ref: str, levels: int | None = None, least: float = 0.0, limit: int = 100) -> Answer:
        start, a = self._start(ref)
        if start is None:
            return a
        rows = traverse.impact(self.edges, start, levels or self.config.levels, least).select("node_id", "distance", F.round("compounded", 4).alias("compounded"))
        return self._bounded(rows, limit, "distance", F.col("compounded").desc(), "node_id")

    def trace(self, source: str, target: str, hops: int = 6, limit: int = 3) -> Answer:
        start, a = self._start(source)
        goal, b = self._start(target)
        if start is None or goal is None:
            return a if start is None else b
        rows = traverse.paths(traverse.steps(self.edges), start, hops, goal.withColumnRenamed("a", "b")).select("path", "hops")
        return self._bounded(rows, limit, "hops", F.array_join("path", "\u0001"))

    def deprecations(self) -> DataFrame:
        """Exposed targets that nothing calls any more."""
        return graph.dead_endpoints(self.edges)

    def snapshot(self) -> str:
        """Digest of what the answers rest on: settings, nodes and edges, whatever their order; taken once."""
        if self._digest is None:
            parts = {"config": asdict(self.config), "nodes": digest(self.nodes), "edges": digest(self.edges)}
            self._digest = hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()[:16]
        return self._digest

    def _bounded(self, rows: DataFrame, limit: int, *order) -> Answer:
        total = rows.count()
        shown = [r.asDict() for r in rows.orderBy(*order).limit(limit).collect()]
        return Answer("present" if total else "known_empty", shown, total, total > limit, snapshot=self.snapshot())
