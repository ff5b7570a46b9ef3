"""Relations over time: validity intervals, comparison of states, contract drift, relinking.

Series are given by an index per group (commits of a repository); nothing is inferred from timestamps. Nulls compare as
equal values of their own; empty series give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def intervals(rows: DataFrame, group: list[str], key: list[str], index: str) -> DataFrame:
    """Runs of consecutive indexes in which a key is present (gaps and islands): group, key, first, last, n.

    `index` counts the states of a group without gaps. One window over (group, key), so no group meets in one task."""
    w = Window.partitionBy(*group, *key).orderBy(index)
    island = rows.select(*group, *key, index).distinct().withColumn("island", F.col(index) - F.row_number().over(w))
    return island.groupBy(*group, *key, "island").agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count("*").alias("n")).drop("island")


def reappeared(runs: DataFrame, group: list[str], key: list[str], last: DataFrame) -> DataFrame:
    """Per key: number of runs, whether it is present at the last state of its group, and whether it came back."""
    g = runs.groupBy(*group, *key).agg(F.count("*").alias("n_runs"), F.max("last").alias("last"))
    out = g.join(last, group)
    return out.select(*group, *key, "n_runs", (F.col("last") == F.col("last_index")).cast("bigint").alias("at_head"), (F.col("n_runs") > 1).cast("bigint").alias("reappeared"))


def changed_between(before: DataFrame, after: DataFrame, key: list[str], value: list[str]) -> DataFrame:
    """Keys of two states with added, removed, changed or kept; values compare null-safe."""
    a = before.groupBy(*key).agg(*[F.max(c).alias(f"a_{c}") for c in value], F.lit(1).alias("in_a"))
    b = after.groupBy(*key).agg(*[F.max(c).alias(f"b_{c}") for c in value], F.lit(1).alias("in_b"))
    b = b.select(*[F.col(k).alias(f"k_{k}") for k in key], *[f"b_{c}" for c in value], "in_b")
    on = [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in key]
    same = F.lit(True)
    for c in value:
        same = same & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    j = a.join(b, on, "full")
    kind = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(same, "kept").otherwise("changed")
    return j.select(*[F.coalesce(k, f"k_{k}").alias(k) for k in key], kind.alias("change_kind"))


def drift(base: DataFrame, head: DataFrame, callers: DataFrame) -> DataFrame:
    """Contracts (column key) of two states: drifted (gone but still called), removed, added or kept, with their callers."""
    b, h = base.select("key").distinct().withColumn("b", F.lit(1)), head.select("key").distinct().withColumn("h", F.lit(1))
    c = callers.groupBy("key").agg(F.count_distinct("caller").alias("n_callers"))
    j = b.join(h, "key", "full").join(c, "key", "left").withColumn("n_callers", F.coalesce("n_callers", F.lit(0)))
    kind = F.when(F.col("h").isNull() & (F.col("n_callers") > 0), "drifted").when(F.col("h").isNull(), "removed").when(F.col("b").isNull(), "added").otherwise("kept")
    return j.select("key", kind.alias("drift"), "n_callers")


def reconcile(declared: DataFrame, observed: DataFrame) -> DataFrame:
    """Declared against observed keys: matched, declared_only or observed_only."""
    d, o = declared.select("key").distinct().withColumn("d", F.lit(1)), observed.select("key").distinct().withColumn("o", F.lit(1))
    return d.join(o, "key", "full").select("key", F.when(F.col("o").isNull(), "declared_only").when(F.col("d").isNull(), "observed_only").otherwise("matched").alias("bucket"))


def fingerprints(claims: DataFrame, group: str = "repo_id", rid: str = "id") -> DataFrame:
    """Per group a digest of its distinct ids that does not depend on their order: group, fingerprint, n.

    The digest is a sum of 64-bit hashes beside the count, so it combines on the map side and never collects a group."""
    d = claims.select(group, rid).distinct()
    h = F.conv(F.substring(F.sha2(rid, 256), 1, 12), 16, 10).cast("decimal(20,0)")
    return d.groupBy(group).agg(F.sum(h).cast("string").alias("fingerprint"), F.count("*").alias("n"))


def stale_groups(now: DataFrame, stored: DataFrame, group: str = "repo_id") -> DataFrame:
    """Groups whose fingerprint is new, changed or gone."""
    j = now.select(group, F.col("fingerprint").alias("f")).join(stored.select(group, F.col("fingerprint").alias("g")), group, "full")
    return j.where(~F.col("f").eqNullSafe(F.col("g"))).select(group)


def relink(claims: DataFrame, prior_claims: DataFrame, prior_edges: DataFrame, link, group: str = "repo_id") -> DataFrame:
    """Edges after a change of claims, recomputed for the keys that changed and kept for the others.

    `link(claims)` gives edges with the column `claim_key`; equality with a full link is tested."""
    changed = claims.select("key", "id").exceptAll(prior_claims.select("key", "id")).unionByName(prior_claims.select("key", "id").exceptAll(claims.select("key", "id"))).select("key").distinct()
    fresh = link(claims.join(changed, "key", "left_semi"))
    kept = prior_edges.join(changed.withColumnRenamed("key", "claim_key"), "claim_key", "left_anti")
    return kept.select(*fresh.columns).unionByName(fresh)


def reverify(cited: DataFrame, lines: DataFrame, within: int = 3) -> DataFrame:
    """Citations (cite_id, repo_id, path, line, token) against the text (repo_id, path, pos, text): found within some lines.

    Equi-join on the file, then the line range; the text is one row per line, so long files spread."""
    near = cited.join(lines, ["repo_id", "path"], "left").where(F.col("pos").isNull() | F.col("pos").between(F.col("line") - within, F.col("line") + within))
    hit = near.groupBy("cite_id").agg(F.max(F.when(F.col("text").contains(F.col("token")), 1).otherwise(0)).alias("hit"))
    return cited.select("cite_id").distinct().join(hit, "cite_id", "left").select("cite_id", F.coalesce("hit", F.lit(0)).cast("bigint").alias("verified"))
