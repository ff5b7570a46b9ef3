"""What changed between consecutive full snapshots.

Method: EXCEPT ALL of each snapshot and the one before it, both ways, removes identical rows; the two residues are
full-joined by key and labelled. A row listed twice in a snapshot counts once, so both differences are differences of sets,
and one pass gives both: per full row, whether it is in the later and in the earlier snapshot. That shuffles every row
once for either side, where two separate EXCEPT ALL would shuffle everything twice.

Defined cases
* a delivery without version (null or blank) or with null rows is no snapshot; an empty list is one;
* of several deliveries of a version the last delivered counts (ties: the larger delivery id);
* the first snapshot of a group gives no changes; gaps in the order are skipped;
* a row listed twice in a snapshot counts once; null elements are dropped; null keys compare as equal;
* a key listed with different values in one snapshot counts as one row per value;
* numbers are compared after rounding to 4 decimals; null differs from every number.
The list of snapshots (ids and order, no rows) is sorted per group, written, and broadcast where its counted rows are few;
the rows themselves are spread over all their columns, so a group with a third of all rows stays spread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimweave.runtime import materialize, small

KEY = ("source_id", "type", "target_id")


def snapshot_series(artifacts: DataFrame) -> DataFrame:
    """Valid snapshots: repo_id, head_sha, seq (from 1, by commit_idx), last (is it the newest), artifact_id."""
    valid = artifacts.where(F.col("edges.source_id").isNotNull() & (F.trim(F.coalesce("head_sha", F.lit(""))) != ""))
    last = valid.groupBy("repo_id", "head_sha").agg(F.max(F.struct(F.coalesce("delivered_at", F.to_timestamp_ntz(F.lit("0001-01-01 00:00:00"))).alias("at"), "artifact_id", "commit_idx")).alias("d"))
    order = Window.partitionBy("repo_id").orderBy("commit_idx", "head_sha")
    flat = last.select("repo_id", "head_sha", "d.artifact_id", "d.commit_idx")
    return flat.withColumn("seq", F.row_number().over(order)).withColumn("next_sha", F.lead("head_sha").over(order)).drop("commit_idx")


def snapshot_rows(artifacts: DataFrame, series: DataFrame) -> DataFrame:
    """Rows of every snapshot, repeats included: repo_id, head_sha, next_sha, seq, source_id, type, target_id, status, confidence."""
    fields = (*KEY, "status", "confidence")
    kept = artifacts.select("artifact_id", *[F.col(f"edges.{c}").alias(c) for c in fields])
    kept = kept.join(small(materialize(series)), "artifact_id").where("source_id is not null")
    rows = kept.select("repo_id", "head_sha", "next_sha", "seq", F.inline(F.arrays_zip(*fields)))
    return rows.where(F.coalesce(*KEY).isNotNull()).withColumn("confidence", F.round("confidence", 4))


def snapshot_changes(artifacts: DataFrame) -> DataFrame:
    """repo_id, head_sha (of the later snapshot), source_id, edge_type, target_id, change_kind."""
    rows = snapshot_rows(artifacts, snapshot_series(artifacts))
    # Each row stands for its own snapshot and, one step on, for the snapshot before; the first one has none before it.
    own = F.when(F.col("seq") > 1, F.col("head_sha"))
    sides = F.array(F.struct(own.alias("at_sha"), F.lit(True).alias("now")), F.struct(F.col("next_sha").alias("at_sha"), F.lit(False).alias("now")))
    sided = rows.select("repo_id", *KEY, "status", "confidence", F.inline(sides)).where("at_sha is not null")
    found = sided.groupBy("repo_id", "at_sha", *KEY, "status", "confidence").agg(F.bool_or("now").alias("later"), F.bool_or(~F.col("now")).alias("earlier"))
    residue = materialize(found.where("later <> earlier").select("repo_id", "at_sha", *KEY, "later"))
    key = ["repo_id", "at_sha", *KEY]
    # Residues once per key; null keys meet as equal.
    side = lambda flag, name: residue.where(F.col("later") == flag).groupBy(*key).agg(F.lit(True).alias(name))
    new, old = side(True, "in_new"), side(False, "in_old")
    old = old.select(*[F.col(c).alias(f"o_{c}") for c in key], "in_old")
    match = F.lit(True)
    for c in key:
        match = match & F.col(c).eqNullSafe(F.col(f"o_{c}"))
    both = new.join(old, match, "full")
    kind = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").otherwise("changed")
    of = lambda c, name: F.when(F.col("in_new"), F.col(c)).otherwise(F.col(f"o_{c}")).alias(name)
    return both.select(of("repo_id", "repo_id"), of("at_sha", "head_sha"), of("source_id", "source_id"), of("type", "edge_type"), of("target_id", "target_id"), kind.alias("change_kind"))


def change_counts(artifacts: DataFrame) -> DataFrame:
    """Changes per repository and snapshot: repo_id, head_sha, n_added, n_removed, n_changed."""
    n = lambda k: F.count(F.when(F.col("change_kind") == k, 1)).alias(f"n_{k}")
    return snapshot_changes(artifacts).groupBy("repo_id", "head_sha").agg(n("added"), n("removed"), n("changed"))
