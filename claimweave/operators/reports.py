"""Reports over linked edges and claims: what a change breaks, declared against observed contracts, traces, removal, quality.

Everything is a plan without actions unless a docstring says otherwise. Null repositories are unknown ones; null evidence
cites nothing; repeated edges count once; empty inputs give empty reports (risk gives one row of zeros).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions import keys, scalars
from claimweave.operators import graph

KEY = ("source_id", "type", "target_id")


def change_impact(base: DataFrame, head: DataFrame, changed_repos: DataFrame | None = None, changed_files: DataFrame | None = None) -> DataFrame:
    """What each edge of two states means for a change: source_id, type, target_id, bucket, caused, consumer_repo,
    provider_repo, confidence, evidence (array).

    Edges have source_repo, target_repo, confidence and evidence (array). Buckets: added and kept; of the edges that are
    gone, uncitable (no evidence with a line), unattributable (a side's repository is unknown), unexplained (neither side
    changed) or break. A break is caused by the change when the provider's repository changed and the consumer's did not;
    where changed_files (repo_id, path) names files of the consumer's repository, only cited files count as its change.
    Without changed_repos (repo_id) every loss is a break of the provider's side."""
    cols = [*KEY, "source_repo", "target_repo", "confidence", "evidence"]
    one = lambda df: df.groupBy(*KEY).agg(F.max_by(F.struct(*cols[3:]), F.coalesce("confidence", F.lit(0.0))).alias("e")).select(*KEY, "e.*")
    b, h = one(base.select(*cols)), one(head.select(*cols))
    lost = b.join(h.select(*KEY), list(KEY), "left_anti")
    cited = F.array_distinct(F.filter(F.coalesce("evidence", F.array().cast("array<string>")), lambda x: F.instr(x, ":") > 0))
    lost = lost.select(*KEY, F.nullif("source_repo", F.lit("")).alias("consumer_repo"), F.nullif("target_repo", F.lit("")).alias("provider_repo"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), cited.alias("evidence"))
    if changed_repos is None:
        lost = lost.withColumn("bucket", F.when(F.size("evidence") == 0, "uncitable").otherwise("break")).withColumn("caused", F.col("bucket") == "break")
    else:
        repos = changed_repos.select("repo_id").distinct()
        flag = lambda df, end, out: df.join(repos.select(F.col("repo_id").alias(end), F.lit(True).alias(out)), end, "left").withColumn(out, F.coalesce(out, F.lit(False)))
        lost = flag(flag(lost, "provider_repo", "p_moved"), "consumer_repo", "c_moved")
        if changed_files is not None:
            files = changed_files.select(F.col("repo_id").alias("consumer_repo"), F.col("path").alias("file")).distinct()
            named = files.select("consumer_repo").distinct().withColumn("named", F.lit(True))
            each = lost.select(*KEY, "consumer_repo", F.explode("evidence").alias("x")).withColumn("file", keys.evidence_path(F.col("x")))
            hit = each.join(files, ["consumer_repo", "file"], "left_semi").select(*KEY).distinct().withColumn("hit", F.lit(True))
            lost = lost.join(named, "consumer_repo", "left").join(hit, list(KEY), "left")
            lost = lost.withColumn("c_moved", F.col("c_moved") & F.when(F.col("named"), F.coalesce("hit", F.lit(False))).otherwise(True)).drop("named", "hit")
        bucket = F.when(F.size("evidence") == 0, "uncitable").when(F.col("consumer_repo").isNull() | F.col("provider_repo").isNull(), "unattributable").when(~F.col("p_moved") & ~F.col("c_moved"), "unexplained").otherwise("break")
        lost = lost.withColumn("bucket", bucket).withColumn("caused", (F.col("bucket") == "break") & F.col("p_moved") & ~F.col("c_moved"))
    out = [*KEY, "bucket", "caused", "consumer_repo", "provider_repo", "confidence", "evidence"]
    rest = h.join(b.select(*KEY).withColumn("old", F.lit(True)), list(KEY), "left")
    rest = rest.select(*KEY, F.when(F.col("old"), "kept").otherwise("added").alias("bucket"), F.lit(False).alias("caused"), F.col("source_repo").alias("consumer_repo"), F.col("target_repo").alias("provider_repo"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), cited.alias("evidence"))
    return lost.select(*out).unionByName(rest.select(*out))


def change_risk(impact: DataFrame) -> DataFrame:
    """One row: score (sum of the confidences of caused breaks), blast_repos (their consumers' repositories), breaks."""
    c = impact.where("caused")
    return c.agg(F.round(F.coalesce(F.sum("confidence"), F.lit(0.0)), 2).alias("score"), F.count_distinct("consumer_repo").alias("blast_repos"), F.count("*").alias("breaks"))


def comment_groups(impact: DataFrame) -> DataFrame:
    """Caused breaks that cite the same lines, as one: citation, repo, consumer, lost, n_consumers, n_breaks."""
    g = impact.where("caused").groupBy(F.array_join("evidence", "|").alias("citation"))
    return g.agg(F.min("consumer_repo").alias("repo"), F.min("source_id").alias("consumer"), F.min("target_id").alias("lost"), F.count_distinct("source_id").alias("n_consumers"), F.count("*").alias("n_breaks"))


def comment(impact: DataFrame, limit: int = 20) -> str:
    """Text for a change request; what is not shown is counted. Runs the plan; at most `limit` groups come to the driver."""
    n = {r["bucket"]: r["n"] for r in impact.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    risk = change_risk(impact).first()
    groups = comment_groups(impact)
    shown = groups.orderBy("citation").limit(limit + 1).collect()
    if not shown and not n.get("unexplained"):
        return f"No consumer loses a connection ({n.get('kept', 0)} edges unchanged, {n.get('added', 0)} added). Risk: 0."
    total = len(shown) if len(shown) <= limit else groups.count()
    lines = [f"{total} connection(s) lost across {risk['blast_repos']} repo(s). Risk: {risk['score']} ({risk['breaks']} break(s), weighted by confidence)."]
    for r in shown[:limit]:
        lines.append(f"\n- **{r['repo'] or r['consumer']}** loses `{r['lost']}`" + (f" (and {r['n_consumers'] - 1} more of its consumers)" if r["n_consumers"] > 1 else ""))
        lines += [f"  - `{x}`" for x in r["citation"].split("|")]
    if total > limit:
        lines.append(f"\n{total - limit} further connection(s) not shown.")
    if n.get("unexplained"):
        lines.append(f"\n{n['unexplained']} edge(s) disappeared although neither side changed: a fault of the analysis, not of this change.")
    return "\n".join(lines)


def _meet(declared: DataFrame, observed: DataFrame) -> DataFrame:
    d, o = declared.select("key").distinct().withColumn("d", F.lit(True)), observed.select("key").distinct().withColumn("o", F.lit(True))
    return d.join(o, "key", "full").select("key", F.when(F.col("o").isNull(), "declared_only").when(F.col("d").isNull(), "observed_only").otherwise("matched").alias("bucket"))


def reconcile_http(claims: DataFrame) -> DataFrame:
    """Operations of API descriptions against routes in code, parameters by position: key (`METHOD:template`), bucket."""
    p = claims.where("kind = 'http' and direction = 'provides'")
    key = F.concat_ws(":", F.substring_index("key", ":", 1), keys.positional(F.expr("substring(key, instr(key, ':') + 1)")))
    p = p.select(key.alias("key"), (F.coalesce(F.col("attrs")["source"], F.lit("")) == "openapi").alias("said"))
    return _meet(p.where("said"), p.where("not said"))


def _names(key: str) -> Column:
    """Full and bare service name of `package.Service/Call`, lower case."""
    service = F.lower(F.substring_index(key, "/", 1))
    return F.array_distinct(F.array(service, F.element_at(F.split(service, r"\."), -1)))


def reconcile_grpc(claims: DataFrame) -> DataFrame:
    """Declared operations against implementations, which name their service only: key, bucket."""
    op = claims.where("kind = 'grpcop' and direction = 'provides'").select("key").distinct()
    served = claims.where("kind = 'grpcstub' and direction = 'provides'").select("key", F.lower("key").alias("name")).distinct()
    named = op.select("key", F.explode(_names("key")).alias("name"))
    hit = named.join(served.select("name").distinct(), "name", "left_semi").select("key").distinct().withColumn("hit", F.lit(True))
    declared = op.join(hit, "key", "left").select("key", F.when(F.col("hit"), "matched").otherwise("declared_only").alias("bucket"))
    only = served.join(named.select("name").distinct(), "name", "left_anti").select("key", F.lit("observed_only").alias("bucket"))
    return declared.unionByName(only.distinct())


def reconcile_topics(claims: DataFrame) -> DataFrame:
    """Declared topics against those at producers and consumers: key, bucket."""
    t = claims.where("kind = 'topic'").select("key", (F.coalesce(F.col("attrs")["declared"], F.lit("false")) == "true").alias("said"))
    return _meet(t.where("said"), t.where("not said"))


def topic_chain(edges: DataFrame) -> DataFrame:
    """Who stands at every topic: topic, role (publisher, consumer, and consumer of a topic that this one fans out to), node_id."""
    a = graph.active(edges)
    ends = a.where(F.col("type").isin("PUBLISHES_TO", "CONSUMES_FROM")).select(F.col("target_id").alias("topic"), F.when(F.col("type") == "PUBLISHES_TO", "publisher").otherwise("consumer").alias("role"), F.col("source_id").alias("node_id"))
    fan = a.where("type = 'FANS_OUT_TO'").select("source_id", F.col("target_id").alias("topic")).distinct()
    beyond = fan.join(ends.where("role = 'consumer'"), "topic").select(F.col("source_id").alias("topic"), F.lit("fanned_out").alias("role"), "node_id")
    return ends.unionByName(beyond).distinct()


def service_crossings(edges: DataFrame) -> DataFrame:
    """Steps of a trace between services with the contracts they cross: source_id, target_id, type, n_contracts, confidence."""
    a = graph.active(edges).where(F.col("type").isin("CALLS_SERVICE", "ROUTES_TO", "PERMITS_TRAFFIC"))
    steps = a.groupBy("source_id", "target_id", "type").agg(F.max("confidence").alias("confidence"))
    http = graph.active(edges).where(F.col("type").isin("INVOKES", "UI_CALLS")).select(F.col("source_repo").alias("s_repo"), "target_id").distinct()
    service = http.select("s_repo", F.element_at(F.split("target_id", ":"), 3).alias("name"), "target_id")
    built = graph.active(edges).where("type = 'BUILT_FROM'").select(F.col("source_id").alias("source_id"), F.col("target_id").alias("s_repo")).distinct()
    n = service.join(built, "s_repo").groupBy("source_id", F.concat(F.lit("global:Service:"), "name").alias("target_id")).agg(F.count_distinct("target_id").alias("n_contracts"))
    return steps.join(n, ["source_id", "target_id"], "left").select("source_id", "target_id", "type", F.coalesce("n_contracts", F.lit(0)).cast("bigint").alias("n_contracts"), "confidence")


def library_impact(edges: DataFrame) -> DataFrame:
    """Per library: library, n_publishers, n_dependents, least_confidence."""
    a = graph.active(edges).where(F.col("type").isin("PUBLISHES", "DEPENDS_ON"))
    n = lambda t: F.count_distinct(F.when(F.col("type") == t, F.col("source_id")))
    return a.groupBy(F.col("target_id").alias("library")).agg(n("PUBLISHES").alias("n_publishers"), n("DEPENDS_ON").alias("n_dependents"), F.min("confidence").alias("least_confidence"))


def flat_map(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and ends of edges as one list: node_id, kind, dead_end (nothing leads on), listed (is it a node)."""
    a = graph.active(edges).select("source_id", "target_id").where("source_id is not null and target_id is not null")
    ends = a.select(F.col("source_id").alias("node_id"), F.lit(1).alias("o")).unionByName(a.select(F.col("target_id").alias("node_id"), F.lit(0).alias("o"))).groupBy("node_id").agg(F.max("o").alias("o"))
    n = nodes.groupBy(F.col("id").alias("node_id")).agg(F.max("type").alias("kind"))
    j = ends.join(n, "node_id", "full")
    return j.select("node_id", F.coalesce("kind", graph.kind_of(F.col("node_id"))).alias("kind"), (F.coalesce("o", F.lit(0)) == 0).cast("bigint").alias("dead_end"), F.col("kind").isNotNull().cast("bigint").alias("listed"))


def calibration(found: DataFrame, expected: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Quality of rules over labelled edges (source_id, type, target_id, tier): tier, tp, fp, fn, precision_lo, recall.

    An expected edge that is found is a true case, one that is not a missed one; a forbidden edge that is found is a false one."""
    f = found.select(*KEY).distinct().withColumn("hit", F.lit(1))
    labels = expected.select(*KEY, "tier").distinct().withColumn("good", F.lit(True)).unionByName(forbidden.select(*KEY, "tier").distinct().withColumn("good", F.lit(False)))
    n = lambda c: F.count(F.when(c, 1))
    hit = F.col("hit").isNotNull()
    g = labels.join(f, list(KEY), "left").groupBy("tier").agg(n(F.col("good") & hit).alias("tp"), n(~F.col("good") & hit).alias("fp"), n(F.col("good") & ~hit).alias("fn"))
    return g.select("tier", "tp", "fp", "fn", scalars.wilson(F.col("tp"), F.col("tp") + F.col("fp"))["lo"].alias("precision_lo"), F.when(F.col("tp") + F.col("fn") > 0, F.round(F.col("tp") / (F.col("tp") + F.col("fn")), 4)).alias("recall"))


def review_labels(decisions: DataFrame) -> DataFrame:
    """Recorded decisions (tier, decision) as labels: tier, tp (promoted), fp (rejected), unusable (anything else)."""
    n = lambda c: F.count(F.when(c, 1))
    known = F.coalesce(F.col("decision").isin("promote", "reject"), F.lit(False))
    return decisions.groupBy("tier").agg(n(F.col("decision") == "promote").alias("tp"), n(F.col("decision") == "reject").alias("fp"), n(~known).alias("unusable"))


def merge_coverage(parts: DataFrame) -> DataFrame:
    """Coverage rows of several scans (language, n_files, n_with_hits, n_hits, tier) as one per language; the best tier counts."""
    rank = F.when(F.col("tier") == "full", 2).when(F.col("tier") == "lite", 1).otherwise(0)
    g = parts.groupBy("language").agg(F.sum("n_files").alias("n_files"), F.sum("n_with_hits").alias("n_with_hits"), F.sum("n_hits").alias("n_hits"), F.max(rank).alias("r"))
    return g.select("language", "n_files", "n_with_hits", "n_hits", F.when(F.col("r") == 2, "full").when(F.col("r") == 1, "lite").otherwise("none").alias("tier"))


def derivation(raw: DataFrame, source_id: str, kind: str, target_id: str) -> DataFrame:
    """Why an edge exists: the rows that were fused to it, the surest first."""
    rows = raw.where((F.col("source_id") == source_id) & (F.col("type") == kind) & (F.col("target_id") == target_id))
    return rows.select("detected_by", "match_type", "confidence", "claim_key", "evidence").orderBy(F.col("confidence").desc(), "detected_by", "evidence")


def config_matches(claims: DataFrame, name: str) -> DataFrame:
    """Reads and definitions of a setting, by its name or the last part of its path: repo_id, direction, key, path, line."""
    hit = claims.where(F.col("kind").isin("env", "cfgread") & ((F.col("key") == name) | F.endswith(F.col("key"), F.lit(f"/{name}"))))
    return hit.select("repo_id", "direction", "key", "path", "line")


def first_lookup(parts: list[DataFrame], column: str = "id") -> DataFrame:
    """Rows of several lookups; of an id that more than one has, the earliest lookup's row stays."""
    out = None
    for k, p in enumerate(parts):
        p = p.withColumn("_rank", F.lit(k))
        out = p if out is None else out.unionByName(p)
    return graph.first_of(out, [column], F.col("_rank")).drop("_rank")
