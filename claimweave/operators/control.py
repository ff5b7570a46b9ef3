"""What operators of an estate set beside the data: confidences, aliases, decisions, namespaces, vendors."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Confidence of every rule and tier (fixed values).
CONFIDENCE = {
    "r0": {"resolved_to": 0.98, "has_alias": 0.9, "built_from_build_context": 0.95, "built_from_app_name": 0.85, "built_from_descriptor": 0.75, "belongs_to": 0.95},
    "r1": {"depends_on": 0.96, "env_host": 0.95, "env_host_default": 0.85},
    "r2": {"selector_match": 0.97, "env_host": 0.95, "built_from_gitops": 0.97, "deployed_as": 0.97, "policy": 0.9},
    "r3": {"publishes": 0.98, "lockfile_resolved": 0.95, "manifest_declared": 0.9},
    "r4": {"route_declared": 0.98, "route_dev": 0.7},
    "r5": {"declared": 0.98, "exact": 0.95, "service_name": 0.9, "calls_service": 0.9},
    "r6": {"declared": 0.98, "literal": 0.9, "env_resolved": 0.85, "fanout": 0.95},
    "r7": {"hint_exact": 0.95, "hint_template": 0.85, "gateway_exact": 0.88, "gateway_template": 0.80, "exposes": 0.98},
    "r8": {"declared": 0.98, "federated": 0.95, "field_name": 0.8},
    "r9": {"env_resolved": 0.85},
    "r10": {"declared": 0.95, "literal": 0.9, "inferred": 0.75},
    "r11": {"registration": 0.95, "config": 0.85, "card": 0.95, "url_resolved": 0.9},
    "r12": {"catalog": 0.95, "codeowners": 0.9, "observability": 0.8},
    "r13": {"registered": 0.85},
    "r14": {"http_binding": 0.97, "event_schema": 0.85},
}
#: Confidence of a tier that no table names.
UNKNOWN_TIER = 0.6
#: Detectors that see the same fact and so do not confirm each other (fixed values); others stand for themselves.
CORRELATED = {
    "compose": "topology", "k8s": "topology", "env": "topology", "alias": "alias", "gateway": "route", "http": "http", "calls_rollup": "http", "grpc": "grpc", "graphql": "graphql",
    "deps_rollup": "rollup", "topic": "topic", "library": "package", "owner": "owner", "dataset": "data", "agent": "agent",
}


@dataclass
class Control:
    """Settings of a link run; every part has a default, so Control() runs."""

    confidence: dict[str, dict[str, float]] = field(default_factory=lambda: CONFIDENCE)
    floor: float = 0.6
    fusion_cap: float = 0.99
    fanout_cap: int = 32
    chain_hops: int = 3
    #: (alias, canonical), (source_id, type, target_id, decision), (ecosystem, prefix), (suffix, vendor)
    aliases: list[tuple[str, str]] = field(default_factory=list)
    decisions: list[tuple[str, str, str, str]] = field(default_factory=list)
    namespaces: list[tuple[str, str]] = field(default_factory=list)
    vendors: list[tuple[str, str]] = field(default_factory=list)

    def conf(self, rule: str, tier: str) -> float:
        return float(self.confidence.get(rule, {}).get(tier, UNKNOWN_TIER))

    def alias_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(a, c, i) for i, (a, c) in enumerate(self.aliases)], "alias string, canonical string, rank int")

    def decision_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.decisions, "source_id string, type string, target_id string, decision string")

    @classmethod
    def load(cls, folder: str) -> Control:
        """Settings of a folder with confidence.yml, service_aliases.yml, promotions.yml, internal_namespaces.yml and
        vendor_catalog.yml; a missing file leaves the default, a decision without its fields is left out."""
        import yaml

        def read(name: str) -> dict:
            path = os.path.join(folder, name)
            if not os.path.exists(path):
                return {}
            with open(path, encoding="utf-8") as f:
                return yaml.safe_load(f) or {}

        table, known = read("confidence.yml"), cls()
        own = {r: {t: float(v) for t, v in x.items()} for r, x in table.items() if r[:1] == "r" and r[1:].isdigit() and isinstance(x, dict)}
        rows = read("promotions.yml").get("promotions") or []
        spaces = read("internal_namespaces.yml").get("ecosystems") or {}
        return cls(
            confidence={r: known.confidence.get(r, {}) | own.get(r, {}) for r in known.confidence.keys() | own.keys()},
            floor=float(table.get("floor", known.floor)),
            fusion_cap=float(table.get("fusion_cap", known.fusion_cap)),
            fanout_cap=int(table.get("fanout_cap", known.fanout_cap)),
            chain_hops=int(table.get("gateway_chain_max_hops", known.chain_hops)),
            aliases=[(str(a), str(name)) for name, x in (read("service_aliases.yml").get("services") or {}).items() for a in (x or {}).get("aliases") or []],
            decisions=[(r["source"], r["type"], r["target"], r["decision"]) for r in rows if {"source", "type", "target", "decision"} <= r.keys()],
            namespaces=[(eco, str(p)) for eco, groups in spaces.items() for values in (groups or {}).values() for p in values or []],
            vendors=[(str(s), str(name)) for name, x in (read("vendor_catalog.yml").get("vendors") or {}).items() for s in (x or {}).get("suffixes") or []],
        )

    def save_decision(self, folder: str, source: str, kind: str, target: str, decision: str, note: str = "") -> None:
        """Append a decision to promotions.yml; the newest one of an edge wins when it is replayed."""
        import yaml

        if decision not in ("promote", "reject"):
            raise ValueError("a decision is promote or reject")
        path = os.path.join(folder, "promotions.yml")
        held = {}
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                held = yaml.safe_load(f) or {}
        held.setdefault("promotions", []).append({"source": source, "type": kind, "target": target, "decision": decision, "note": note})
        with open(path, "w", encoding="utf-8") as f:
            yaml.safe_dump(held, f, sort_keys=False)
        self.decisions.append((source, kind, target, decision))
