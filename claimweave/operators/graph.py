"""Relations of the evidence graph and the aggregations over them.

Everything here is a DataFrame plan without actions. Edges are one row per delivery unless a function says otherwise.
Nulls: ends that are null or blank drop the edge; a null confidence counts as 1.0 and a null status as active (the lite
envelope stores only what varies); a null detector is its own detector ''. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.runtime import blank_to_null

#: Relation types along which one thing depends on another (fixed values).
DEPENDENCE = ("BUILT_FROM", "CALLS_SERVICE", "CONSUMES_FROM", "DEPENDS_ON", "DEPENDS_ON_REPO", "EXPOSES", "INVOKES", "PUBLISHES_TO", "READS_FROM", "REGISTERS_WEBHOOK", "ROUTES_TO", "UI_CALLS", "WRITES_TO")
FUSION_CAP = 0.99
FLOOR = 0.6
FANOUT_CAP = 32
EVIDENCE_KEPT = 5


def clean_edges(edges: DataFrame) -> DataFrame:
    """Edges once per edge_id with trimmed ends and defaults filled; later deliveries of an id win."""
    s, t = blank_to_null("source_id"), blank_to_null("target_id")
    rows = edges.withColumns({"source_id": s, "target_id": t}).where("source_id is not null and target_id is not null")
    keep = [c for c in ("source_id", "target_id", "type", "repo_id", "confidence", "status", "detected_by", "evidence", "link_run_id") if c in rows.columns]
    one = rows.groupBy("edge_id").agg(F.max_by(F.struct(*keep), "loaded_at").alias("e")).select("edge_id", "e.*")
    return with_defaults(one)


def with_defaults(edges: DataFrame) -> DataFrame:
    fill: dict[str, Column] = {"confidence": F.coalesce("confidence", F.lit(1.0)), "status": F.coalesce("status", F.lit("active"))}
    if "detected_by" in edges.columns:
        fill["detected_by"] = F.coalesce("detected_by", F.lit(""))
    return edges.withColumns(fill)


def active(edges: DataFrame) -> DataFrame:
    return edges.where(F.coalesce("status", F.lit("active")) == "active")


def dependence(edges: DataFrame) -> DataFrame:
    """Allow-list of dependence types; unknown types decline."""
    return edges.where(F.col("type").isin(*DEPENDENCE))


def at_least(edges: DataFrame, confidence: float, bound: bool = False) -> DataFrame:
    """Edges of some confidence; with bound the lower end of merged edges counts where there is one."""
    if not 0 <= confidence <= 1:
        raise ValueError("confidence lies between 0 and 1")
    c = F.coalesce("min_confidence", "confidence", F.lit(0.0)) if bound else F.col("confidence")
    return edges.where(c >= confidence)


def fuse(edges: DataFrame, cap: float = FUSION_CAP, correlated: dict[str, str] | None = None) -> DataFrame:
    """One row per (source, type, target): noisy-or over the best of each detector; single rows pass uncapped. Detectors of
    one group of `correlated` see the same fact: only the best of the group counts.

    Two-level aggregation, so a pair with a third of all rows combines on the map side."""
    key = ["source_id", "type", "target_id"]
    table = F.create_map(*[F.lit(x) for kv in correlated.items() for x in kv]) if correlated else None
    group = F.coalesce(table[F.col("detected_by")], "detected_by") if correlated else F.col("detected_by")
    groups = edges.groupBy(*key, group.alias("_group"), "detected_by").agg(F.max("confidence").alias("c"), F.count("*").alias("n"))
    if correlated:
        groups = groups.groupBy(*key, "_group").agg(F.max("c").alias("c"), F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_set("detected_by")), "+").alias("detected_by"))
    fused = groups.groupBy(*key).agg(F.sum("n").alias("n_rows"), F.max("c").alias("best"), F.product(1 - F.col("c")).alias("miss"), F.array_join(F.array_sort(F.collect_set(F.nullif("detected_by", F.lit("")))), "+").alias("detected_by"))
    conf = F.when(F.col("n_rows") == 1, F.col("best")).otherwise(F.least(F.lit(cap), 1 - F.col("miss")))
    names = F.array_join(F.array_sort(F.split("detected_by", r"\+")), "+") if correlated else F.col("detected_by")
    return fused.select(*key, "n_rows", conf.alias("confidence"), names.alias("detected_by"))


def with_floor(edges: DataFrame, floor: float = FLOOR) -> DataFrame:
    """Active edges below the floor become candidates."""
    return edges.withColumn("status", F.when((F.col("confidence") < floor) & (F.col("status") == "active"), "candidate").otherwise(F.col("status")))


def replay_decisions(edges: DataFrame, decisions: DataFrame) -> DataFrame:
    """Recorded decisions (source_id, type, target_id, decision): `promote` lifts candidates only, `reject` always holds."""
    d = decisions.groupBy("source_id", "type", "target_id").agg(F.max("decision").alias("decision"))
    joined = edges.join(d, ["source_id", "type", "target_id"], "left")
    status = F.when(F.col("decision") == "reject", "rejected").when((F.col("decision") == "promote") & (F.col("status") == "candidate"), "active").otherwise(F.col("status"))
    return joined.withColumn("status", status).drop("decision")


def evidence_of(edges: DataFrame, kept: int = EVIDENCE_KEPT) -> DataFrame:
    """Distinct evidence per (source, type, target): the first `kept` in order, and the true number."""
    key = ["source_id", "type", "target_id"]
    each = edges.select(*key, F.explode("evidence").alias("e")).where("e is not null").distinct()
    n = each.groupBy(*key).agg(F.count("*").alias("n_evidence"))
    # The rank limit goes into the map side, so an edge with a third of all evidence sends `kept` rows a partition.
    first = each.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy("e"))).where(F.col("_r") <= kept)
    first = first.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list("e")), "|").alias("evidence"))
    same = F.lit(True)
    for c in key:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return n.alias("a").join(first.alias("b"), same).select(*[f"a.{c}" for c in key], "b.evidence", "a.n_evidence")


def fan(edges: DataFrame) -> DataFrame:
    """Distinct counterparties of every node over active edges: node_id, fan_in, fan_out (0 where there are none)."""
    pairs = active(edges).select("source_id", "target_id").distinct()
    ends = pairs.select(F.col("source_id").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(pairs.select(F.col("target_id").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("node_id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def repo_of(node: Column) -> Column:
    """Repository part of a node id."""
    return F.substring_index(node, ":", 1)


def kind_of(node: Column) -> Column:
    """Type part of a node id."""
    return F.when(F.size(F.split(node, ":")) >= 3, F.element_at(F.split(node, ":"), 2)).otherwise(F.lit(""))


def repo_rollup(edges: DataFrame) -> DataFrame:
    """Edges between repositories: source_repo, target_repo, types, weight, min and max confidence."""
    e = active(edges).select(repo_of(F.col("source_id")).alias("source_repo"), repo_of(F.col("target_id")).alias("target_repo"), "type", "confidence").where("source_repo <> target_repo")
    return e.groupBy("source_repo", "target_repo").agg(F.count("*").alias("weight"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"), F.round(F.min("confidence"), 4).alias("min_confidence"), F.round(F.max("confidence"), 4).alias("max_confidence"))


def group_map(edges: DataFrame, group: Column, other: Column) -> DataFrame:
    """Boxes of grouped nodes and the corridors between them: src_group, dst_group, weight, internal, min_confidence."""
    e = active(edges).select(group.alias("src_group"), other.alias("dst_group"), "confidence")
    return e.groupBy("src_group", "dst_group").agg(F.count("*").alias("weight"), (F.col("src_group") == F.col("dst_group")).cast("bigint").alias("internal"), F.round(F.min("confidence"), 4).alias("min_confidence"))


def aggregate(df: DataFrame, by: list[str], equal: dict[str, str] | None = None, limit: int | None = None) -> DataFrame:
    """Typed aggregate query: equality filters, count per group, ordered by the group where limited."""
    for c, v in (equal or {}).items():
        df = df.where(F.col(c) == v)
    out = df.groupBy(*by).count() if by else df.agg(F.count("*").alias("count"))
    return out.orderBy(*by).limit(limit) if limit is not None else out


def hot_keys(claims: DataFrame, key: str, workers: int) -> DataFrame:
    """Keys with more rows than a fair share of all rows: key, n."""
    total = claims.select(F.count("*").alias("total"))
    counted = claims.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
    # One row: the total is a single aggregate, joined on a constant.
    return counted.withColumn("one", F.lit(1)).join(F.broadcast(total.withColumn("one", F.lit(1))), "one").where(F.col("n") > F.greatest(F.lit(1), F.floor(F.col("total") / workers))).select("key", "n")


def skew_statistics(df: DataFrame, key: str) -> DataFrame:
    """One row: keys, rows, largest group, median group."""
    g = df.groupBy(key).agg(F.count("*").alias("n"))
    return g.agg(F.count("*").alias("n_keys"), F.sum("n").alias("n_rows"), F.max("n").alias("largest"), F.expr("cast(percentile(n, 0.5) as double)").alias("median"))


def fanout_guard(matches: DataFrame, call: str, contract: str, cap: int = FANOUT_CAP) -> DataFrame:
    """Calls with their number of distinct contracts and the outcome: matched, or declined beyond the cap (never cut)."""
    n = matches.groupBy(call).agg(F.count_distinct(contract).alias("n_contracts"))
    return n.withColumn("outcome", F.when(F.col("n_contracts") > cap, "declined").otherwise("matched"))


def ambiguity_guard(matches: DataFrame, call: list[str], target: str) -> DataFrame:
    """Calls with exactly one distinct target keep it; others are declined with their number of targets."""
    g = matches.groupBy(*call).agg(F.count_distinct(target).alias("n_targets"), F.min(target).alias("only"))
    return g.select(*call, F.when(F.col("n_targets") == 1, F.col("only")).alias("target"), "n_targets", F.when(F.col("n_targets") == 1, "matched").otherwise("declined").alias("outcome"))


def search(nodes: DataFrame, text: str, limit: int | None = None) -> DataFrame:
    """Nodes that contain the text in name, label, path or id, ranked: exact, exact in another case, prefix, name or label,
    path, id; ties by name length and id."""
    if not text.strip():
        raise ValueError("a search needs text")
    low = text.lower()
    name, label, path = (F.coalesce(c, F.lit("")) for c in ("name", "label", "path"))
    tier = (
        F.when(name == text, 0)
        .when(F.lower(name) == low, 1)
        .when(F.startswith(F.lower(name), F.lit(low)), 2)
        .when(F.lower(name).contains(low) | F.lower(label).contains(low), 3)
        .when(F.lower(path).contains(low), 4)
        .when(F.lower("id").contains(low), 5)
    )
    out = nodes.withColumn("tier", tier).where("tier is not null").select("id", "name", "type", "tier", F.round(1 - F.col("tier") / 6, 4).alias("score"))
    return out.orderBy("tier", F.length(F.coalesce("name", F.lit(""))), "id").limit(limit) if limit else out


def first_of(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of every group in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def occurrence(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Number of equal rows before each one in its group, from 0."""
    return df.withColumn("occurrence", (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("bigint"))


def dead_endpoints(edges: DataFrame) -> DataFrame:
    """Exposed targets that nothing calls."""
    a = active(edges)
    return a.where("type = 'EXPOSES'").select("target_id").distinct().join(a.where(F.col("type").isin("INVOKES", "CALLS", "CALLS_SERVICE")).select("target_id").distinct(), "target_id", "left_anti")


def bridges(edges: DataFrame) -> DataFrame:
    """Repositories that meet at a target: one side reads or calls it, another exposes or publishes it."""
    a = active(edges)
    use = a.where(F.col("type").isin("READS_FROM", "CONSUMES_FROM", "CALLS_SERVICE")).select(repo_of(F.col("source_id")).alias("consumer"), "target_id").distinct()
    own = a.where(F.col("type").isin("EXPOSES", "PUBLISHES_TO", "WRITES_TO")).select(repo_of(F.col("source_id")).alias("provider"), "target_id").distinct()
    return use.join(own, "target_id").where("consumer <> provider").groupBy("consumer", "provider").agg(F.count_distinct("target_id").alias("n_contracts"))
