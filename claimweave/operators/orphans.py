"""References to records that do not exist: dangling ends of links against the life of the records.

Method: skew-aware split. References are pre-aggregated by key and period; keys that hold a large share of all
references are checked against a broadcast of their own (few) histories, the remaining keys by a shuffle join, and both
parts are united. No key's references ever meet in one task because they share the key.

Defined cases
* a null or blank key is no reference; blanks around keys are cut, comparison is case-sensitive;
* a record row with a null id or a null start never lives; a null end means "still live"; an end at or before the start
  gives a row that is never live but makes the id known;
* exact second deliveries of references or records change nothing;
* a reference with a null time is judged `missing` if the id is unknown, else `late` (nothing is live at an unknown
  time); its period is null;
* empty tables give no rows, or only `missing` rows; further columns of either table are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.runtime import blank_to_null, month_of

#: End of rows that still live.
FOREVER = "9999-12-31 00:00:00"


def references(edges: DataFrame, rid: str = "edge_id", ends: dict[str, str] | None = None, at: str = "loaded_at") -> DataFrame:
    """One row per end that names something: rid, side, key, at."""
    ends = ends or {"source": "source_id", "target": "target_id"}
    sides = F.array(*[F.struct(F.lit(side).alias("side"), blank_to_null(col).alias("key")) for side, col in ends.items()])
    return edges.select(F.col(rid).alias("rid"), F.col(at).alias("at"), F.explode(sides).alias("e")).select("rid", "e.side", "e.key", "at").where("key is not null")


def histories(nodes: DataFrame, key: str = "id", start: str = "loaded_at", end: str = "deleted_at") -> tuple[DataFrame, DataFrame]:
    """Per key the days on which rows were loaded with the latest end of each day (an array as long as the number of
    such days, however many rows a key has), and the rows themselves by key and day."""
    rows = nodes.select(blank_to_null(key).alias("key"), F.col(start).alias("lo"), F.coalesce(F.col(end), F.to_timestamp_ntz(F.lit(FOREVER))).alias("hi")).where("key is not null")
    days = rows.groupBy("key", F.to_date("lo").alias("day")).agg(F.max("hi").alias("hi"), F.min("lo").alias("lo"))
    per_key = days.groupBy("key").agg(F.min("lo").alias("first_lo"), F.collect_list(F.struct("day", "hi")).alias("days"))
    return per_key, rows.withColumn("day", F.to_date("lo"))


def _judge(refs: DataFrame) -> DataFrame:
    """live: a row loaded on an earlier day outlasts `at`; same_day: rows of that very day decide."""
    day = F.to_date("at")
    return refs.withColumn("live", F.coalesce(F.exists("days", lambda d: (d["day"] < day) & (d["hi"] > F.col("at"))), F.lit(False))).withColumn(
        "same_day", F.coalesce(F.exists("days", lambda d: (d["day"] == day) & (d["hi"] > F.col("at"))), F.lit(False))
    )


def orphans(edges: DataFrame, nodes: DataFrame, rid: str = "edge_id", ends: dict[str, str] | None = None, at: str = "loaded_at", total: int | None = None) -> DataFrame:
    """Every end without a live record at its time: rid, side, key, reason, period.

    `total`: rows of `edges`, to tell heavy keys; counted where not given.
    """
    refs = references(edges, rid, ends, at)
    total = edges.count() if total is None else total
    counted = refs.groupBy("key", month_of("at").alias("period")).count()
    heavy = _heavy(counted, 2 * total)
    per_key, rows = histories(nodes)

    flagged = refs.join(F.broadcast(heavy.withColumn("hot", F.lit(True))), "key", "left")
    hot = flagged.where("hot").join(F.broadcast(per_key.join(F.broadcast(heavy), "key", "left_semi")), "key", "left")
    rest = flagged.where("hot is null").join(per_key, "key", "left")
    judged = _judge(hot.unionByName(rest)).where("not live")

    known = judged.select("rid", "side", "key", "at", "first_lo", "same_day", F.col("days").isNotNull().alias("known"))
    # Only references of a day on which their own record was loaded need the rows of that day.
    doubt = known.where("same_day").withColumn("day", F.to_date("at"))
    kept = doubt.join(rows.withColumnRenamed("hi", "end"), (doubt["key"] == rows["key"]) & (doubt["day"] == rows["day"]) & (F.col("lo") <= F.col("at")) & (F.col("end") > F.col("at")), "left_anti").drop("day")
    gone = known.where("not same_day").unionByName(kept)
    reason = F.when(~F.col("known"), "missing").when(F.col("first_lo") <= F.col("at"), "deleted").otherwise("late")
    return gone.select("rid", "side", "key", reason.alias("reason"), month_of("at").alias("period")).distinct()


def _heavy(counted: DataFrame, total: int) -> DataFrame:
    """Heavy keys from counts per key and period; at most 256, since together they cannot hold more than `total`."""
    from claimweave.runtime import HEAVY_LEAST, HEAVY_SHARE

    return counted.groupBy("key").agg(F.sum("count").alias("n")).where(F.col("n") >= max(HEAVY_LEAST, int(total * HEAVY_SHARE))).select("key")


def orphan_report(edges: DataFrame, nodes: DataFrame, table_name: str = "edges", rid: str = "edge_id", ends: dict[str, str] | None = None, at: str = "loaded_at") -> DataFrame:
    """Orphans and references per table, end and period: table_name, side, period, n_refs, n_missing, n_deleted, n_late, n_orphans."""
    once = edges.select(rid, *(ends or {"source": "source_id", "target": "target_id"}).values(), at).distinct()
    refs = references(once, rid, ends, at).groupBy("side", month_of("at").alias("period")).agg(F.count("*").alias("n_refs"))
    n = lambda why: F.count(F.when(F.col("reason") == why, 1)).alias(f"n_{why}")
    lost = orphans(edges, nodes, rid, ends, at).groupBy("side", "period").agg(n("missing"), n("deleted"), n("late"), F.count("*").alias("n_orphans"))
    out = refs.alias("r").join(lost.alias("l"), (F.col("r.side") == F.col("l.side")) & F.col("r.period").eqNullSafe(F.col("l.period")), "left")
    zero = lambda c: F.coalesce(F.col(f"l.{c}"), F.lit(0)).cast("bigint").alias(c)
    return out.select(F.lit(table_name).alias("table_name"), "r.side", "r.period", "r.n_refs", *[zero(c) for c in ("n_missing", "n_deleted", "n_late", "n_orphans")])

