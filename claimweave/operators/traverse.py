"""Bounded traversals of the evidence graph: simple paths, neighbourhoods, impact.

Levels are bounded by an argument, so plans are unrolled joins over the edge table; from the third level on the frontier is
written to the shared folder to cut the plan. A frontier joins by node, so hubs are split by adaptive skew joins.
Defined cases: unknown or null starts reach nothing; cycles end because paths are simple and levels drop visited nodes;
only active edges are walked; repeated edges count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimweave.operators.graph import active, dependence
from claimweave.runtime import materialize

#: Types that are walked against their direction in flow traces (fixed values).
AGAINST = ("CONSUMES_FROM", "READS_FROM")
MOST_LEVELS = 8


def check_levels(levels: int) -> None:
    if not 1 <= levels <= MOST_LEVELS:
        raise ValueError(f"levels lie between 1 and {MOST_LEVELS}")


def steps(edges: DataFrame, direction: str = "out", types: list[str] | None = None) -> DataFrame:
    """Distinct steps a -> b of active edges."""
    e = active(edges)
    if types:
        e = e.where(F.col("type").isin(*types))
    out = e.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    back = e.select(F.col("target_id").alias("a"), F.col("source_id").alias("b"))
    if direction not in ("out", "in", "both"):
        raise ValueError("direction is out, in or both")
    return (out if direction == "out" else back if direction == "in" else out.unionByName(back)).where("a <> b").distinct()


def flow_steps(edges: DataFrame) -> DataFrame:
    """Steps in the direction data flows: reading types are turned around."""
    e = active(edges)
    turn = F.col("type").isin(*AGAINST)
    return e.select(F.when(turn, F.col("target_id")).otherwise(F.col("source_id")).alias("a"), F.when(turn, F.col("source_id")).otherwise(F.col("target_id")).alias("b")).where("a <> b").distinct()


def paths(step: DataFrame, starts: DataFrame, hops: int, goals: DataFrame | None = None) -> DataFrame:
    """All simple paths of up to `hops` steps from the starts (column a): path array, hops, last node. With goals (column b)
    only paths that end there, never extended through one."""
    check_levels(hops)
    front = starts.select(F.array("a").alias("path"), F.col("a").alias("at")).distinct()
    found = None
    for k in range(1, hops + 1):
        grown = front.join(step.withColumnRenamed("a", "at"), "at").where(~F.array_contains("path", F.col("b"))).select(F.array_append("path", F.col("b")).alias("path"), F.col("b").alias("at"))
        if k >= 3:
            grown = materialize(grown)
        ends = grown if goals is None else grown.join(goals.select(F.col("b").alias("at")).distinct(), "at", "left_semi").select("path", "at")
        level = ends.select("path", F.lit(k).cast("bigint").alias("hops"), F.col("at").alias("node_id"))
        found = level if found is None else found.unionByName(level)
        front = grown if goals is None else grown.join(goals.select(F.col("b").alias("at")).distinct(), "at", "left_anti").select("path", "at")
    return found


def neighbourhood(step: DataFrame, starts: DataFrame, levels: int) -> DataFrame:
    """Nodes within `levels` steps of each start, with their distance: start, node_id, distance (the start itself at 0)."""
    check_levels(levels)
    seen = starts.select(F.col("a").alias("start"), F.col("a").alias("node_id")).distinct().withColumn("distance", F.lit(0).cast("bigint"))
    front = seen
    for k in range(1, levels + 1):
        nxt = front.join(step.withColumnRenamed("a", "node_id"), "node_id").select("start", F.col("b").alias("node_id")).distinct().join(seen.select("start", "node_id"), ["start", "node_id"], "left_anti")
        front = nxt.withColumn("distance", F.lit(k).cast("bigint"))
        if k >= 2:
            front = materialize(front)
        seen = seen.unionByName(front)
    return seen


def impact(edges: DataFrame, starts: DataFrame, levels: int, least: float = 0.0) -> DataFrame:
    """Everything that depends on a start, backwards over dependence edges: start, node_id, distance, compounded (the best
    product of confidences among the shortest ways). Distance decides first, so level by level is exact."""
    check_levels(levels)
    e = dependence(active(edges)).where(F.col("confidence") >= least)
    step = e.where("source_id <> target_id").groupBy(F.col("target_id").alias("node_id"), F.col("source_id").alias("b")).agg(F.max("confidence").alias("c"))
    seen = starts.select(F.col("a").alias("start"), F.col("a").alias("node_id")).distinct().withColumns({"distance": F.lit(0).cast("bigint"), "compounded": F.lit(1.0)})
    front = seen
    for k in range(1, levels + 1):
        grown = front.join(step, "node_id").groupBy("start", "b").agg(F.max(F.col("compounded") * F.col("c")).alias("compounded")).withColumnRenamed("b", "node_id")
        front = grown.join(seen.select("start", "node_id"), ["start", "node_id"], "left_anti").select("start", "node_id", F.lit(k).cast("bigint").alias("distance"), "compounded")
        if k >= 2:
            front = materialize(front)
        seen = seen.unionByName(front)
    return seen.where("distance > 0")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Active edges with both ends among the nodes (column node_id)."""
    n = nodes.select("node_id").distinct()
    return active(edges).join(n.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi").join(n.withColumnRenamed("node_id", "target_id"), "target_id", "left_semi")


def consumers(edges: DataFrame) -> DataFrame:
    """Direct dependents of every node: target_id, consumer, type."""
    return dependence(active(edges)).select("target_id", F.col("source_id").alias("consumer"), "type").distinct()


def components(links: DataFrame) -> DataFrame:
    """Connected components of an undirected graph (columns a, b): node, component (its smallest node).

    Alternating large-star and small-star steps; every round is written, the number of rounds grows with the logarithm of
    the size. Nothing but a count of changed links reaches the driver.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = materialize(pairs)
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p")).select("p.u", "p.v").where("u <> v").distinct()
        small = materialize(small)
        changed = small.join(pairs, ["u", "v"], "left_anti").limit(1).count() or pairs.join(small, ["u", "v"], "left_anti").limit(1).count()
        pairs = small
        if not changed:
            break
    roots = links.select(F.explode(F.array("a", "b")).alias("node")).where("node is not null").distinct()
    best = pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return roots.join(best, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def ranked_paths(found: DataFrame, limit: int) -> DataFrame:
    """The first paths per start by length, then by their nodes."""
    w = Window.partitionBy(F.col("path")[0]).orderBy("hops", F.array_join("path", "\u0001"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
