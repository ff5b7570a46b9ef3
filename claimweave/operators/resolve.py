"""Claims and the joins that turn them into edges.

A claim says that a repository provides or consumes a key. Providers and consumers meet at equal keys; a call with several
possible targets is declined and counted, never guessed. Claims have the columns id, repo_id, kind, direction, key,
evidence; null or blank keys and keys with variables are not matchable. Empty inputs give empty edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions import keys, scalars
from claimweave.operators import graph

CLAIM = ("repo_id", "kind", "direction", "key", "subject", "evidence")


def claims_of(df: DataFrame, kind: str, direction: str, key: Column, subject: Column, evidence: Column) -> DataFrame:
    c = df.select("repo_id", F.lit(kind).alias("kind"), F.lit(direction).alias("direction"), key.alias("key"), F.coalesce(subject, F.lit("")).alias("subject"), evidence.alias("evidence"))
    return c.withColumn("id", keys.claim_id(F.col("repo_id"), F.col("kind"), F.col("direction"), F.col("key"), keys.evidence_path(F.col("evidence")), F.col("subject")))


def matchable(key: Column) -> Column:
    """Non-empty and without variables."""
    return F.coalesce((F.trim(key) != "") & ~key.rlike(r"\$\{|process\.env|os\.environ|\{\{"), F.lit(False))


def admit(claims: DataFrame) -> DataFrame:
    """The single gate for claims: matchable keys, one row per id (the smallest evidence wins)."""
    return claims.where(matchable(F.col("key"))).groupBy("id", "repo_id", "kind", "direction", "key", "subject").agg(F.min("evidence").alias("evidence"))


def docker_claims(docker: DataFrame) -> DataFrame:
    """Service names, images and dependencies of container definitions."""
    at = F.concat_ws(":", "file_path", F.col("line").cast("string"))
    name = docker.where("trim(name) <> ''")
    provides = claims_of(name, "svcname", "provides", F.lower(F.trim("name")), F.lit(""), at)
    images = claims_of(docker.where("trim(image) <> ''"), "image", "consumes", keys.image_key(F.col("image")), F.col("name"), at)
    deps = docker.select("repo_id", "name", "file_path", "line", F.explode("depends_on").alias("dep")).where("trim(dep) <> ''")
    uses = claims_of(deps, "svcname", "consumes", F.lower(F.trim("dep")), F.col("name"), at)
    return admit(provides.unionByName(images).unionByName(uses))


def workload_claims(k8s: DataFrame) -> DataFrame:
    """Service names of workloads, images of containers and hosts in their env literals."""
    at = F.concat_ws(":", "file_path", F.col("line").cast("string"))
    provides = claims_of(k8s.where("trim(name) <> ''"), "svcname", "provides", F.lower(F.trim("name")), F.col("kind"), at)
    c = k8s.select("repo_id", "name", "file_path", "line", F.explode("containers").alias("c")).where("c is not null")
    images = claims_of(c.where("trim(c.image) <> ''"), "image", "consumes", keys.image_key(F.col("c.image")), F.col("name"), at)
    e = c.select("repo_id", "name", "file_path", "line", F.explode("c.env").alias("e")).where("e is not null and e.source = 'literal'")
    host = keys.bare_host(keys.url_class(F.col("e.value"))["host"])
    calls = claims_of(e.where(F.col("e.value").rlike("^https?://")), "svcname", "consumes", host, F.col("name"), at)
    topics = claims_of(e.where(F.col("e.name").rlike("_TOPIC$") & F.col("e.value").rlike(r"^[a-z0-9_.-]+$")), "topic", "consumes", F.concat(F.lit("channel:"), F.col("e.value")), F.col("name"), at)
    return admit(provides.unionByName(images).unionByName(calls).unionByName(topics))


def join_claims(claims: DataFrame, kind: str, edge: str, confidence: float) -> DataFrame:
    """Consumers joined to providers of the same key in another repository; several provider repositories decline.

    source_id and target_id are repositories; outcome is matched, ambiguous or unmatched per consumer and key."""
    c = claims.where(F.col("kind") == kind)
    prov = c.where("direction = 'provides'").groupBy("key").agg(F.count_distinct("repo_id").alias("n_repos"), F.min("repo_id").alias("target_id"))
    use = c.where("direction = 'consumes'").groupBy("repo_id", "key").agg(F.min("evidence").alias("evidence"), F.count("*").alias("weight"))
    j = use.join(prov, "key", "left")
    outcome = F.when(F.col("n_repos").isNull(), "unmatched").when(F.col("n_repos") > 1, "ambiguous").otherwise("matched")
    return j.select(F.col("repo_id").alias("source_id"), F.lit(edge).alias("type"), F.when(outcome == "matched", F.col("target_id")).alias("target_id"), F.col("key").alias("claim_key"), F.lit(confidence).alias("confidence"), "weight", "evidence", outcome.alias("outcome"))


def declines(resolved: DataFrame, name: str) -> DataFrame:
    """Counters per outcome, so that no decline is silent: counter, n."""
    return resolved.groupBy(F.concat_ws(".", F.lit(name), "outcome").alias("counter")).agg(F.count("*").alias("n"))


def mint_services(claims: DataFrame) -> DataFrame:
    """Services from provided names: name, repo_ids, n_repos, is_generic."""
    p = claims.where("kind = 'svcname' and direction = 'provides'").select(F.col("key").alias("name"), "repo_id").distinct()
    return p.groupBy("name").agg(F.count("*").alias("n_repos"), F.min("repo_id").alias("first_repo")).withColumn("is_generic", keys.is_generic(F.col("name")).cast("bigint"))


def dns_aliases(k8s: DataFrame) -> DataFrame:
    """Every DNS name of a workload: alias, canonical."""
    ns = F.lower(F.coalesce(F.nullif(F.trim("namespace"), F.lit("")), F.lit("default")))
    n = F.lower(F.trim("name"))
    forms = F.array(n, F.concat_ws(".", n, ns), F.concat_ws(".", n, ns, F.lit("svc")), F.concat_ws(".", n, ns, F.lit("svc.cluster.local")))
    return k8s.where("trim(name) <> ''").select(F.explode(forms).alias("alias"), n.alias("canonical")).distinct()


def selector_members(selectors: DataFrame, workloads: DataFrame) -> DataFrame:
    """Selectors whose labels are all among a workload's labels in the same namespace (sel_id, namespace, selector map;
    workload_id, namespace, labels map). The labels are exploded and counted, so the subset test is an equi-join."""
    want = selectors.select("sel_id", "namespace", F.size("selector").alias("n"), F.explode("selector").alias("k", "v"))
    have = workloads.select("workload_id", "namespace", F.explode("labels").alias("k", "v")).distinct()
    hit = want.join(have, ["namespace", "k", "v"]).groupBy("sel_id", "workload_id", "n").agg(F.count("*").alias("m"))
    return hit.where("m = n").select("sel_id", "workload_id")


def deployment_units(k8s: DataFrame) -> DataFrame:
    """Workloads as deployment units: unit, service, n_records."""
    ns = F.coalesce(F.nullif(F.trim("namespace"), F.lit("")), F.lit("default"))
    unit = F.lower(F.concat_ws("/", ns, "kind", F.trim("name")))
    rows = k8s.where(F.col("kind").isin("Deployment", "StatefulSet", "DaemonSet", "CronJob", "Job", "ReplicaSet") & (F.trim("name") != ""))
    return rows.groupBy(unit.alias("unit"), F.lower(F.trim("name")).alias("service")).agg(F.count_distinct("resource_id").alias("n_records"))


def env_index(k8s: DataFrame) -> DataFrame:
    """Distinct literal env values per scope and name with what they are: scope, name, value_class, n_values."""
    c = k8s.select(F.coalesce(F.nullif(F.trim("namespace"), F.lit("")), F.lit("default")).alias("scope"), F.explode("containers").alias("c")).where("c is not null")
    e = c.select("scope", F.explode("c.env").alias("e")).where("e is not null and e.source = 'literal' and trim(e.name) <> '' and e.value is not null")
    kind = scalars.value_class(F.col("name"), F.col("value"))
    v = e.select("scope", F.col("e.name").alias("name"), F.col("e.value").alias("value"))
    return v.groupBy("scope", "name", kind.alias("value_class")).agg(F.count_distinct("value").alias("n_values"))


def prefix_owner(items: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Longest directory prefix of each path (item, repo_id, path) among (repo_id, prefix, owner): item, owner, outcome.

    The prefixes of the paths are exploded, so this is an equi-join; several owners of the best prefix decline."""
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.struct(k.alias("depth"), F.when(k == 0, "").otherwise(F.array_join(F.slice(parts, 1, F.greatest(k, F.lit(1))), "/")).alias("prefix")))
    x = items.select("item", "repo_id", F.inline(ups))
    hit = x.join(prefixes, ["repo_id", "prefix"]).groupBy("item", "depth").agg(F.count_distinct("owner").alias("n"), F.min("owner").alias("owner"))
    best = hit.groupBy("item").agg(F.max(F.struct("depth", "n", "owner")).alias("b"))
    return best.select("item", F.when(F.col("b.n") == 1, F.col("b.owner")).alias("owner"), F.when(F.col("b.n") == 1, "matched").otherwise("ambiguous").alias("outcome"))


def ownership(catalog_entities: DataFrame) -> DataFrame:
    """Owners of catalog entities in bare lower-case form: team, n_entities."""
    team = F.lower(F.substring_index(F.regexp_replace(F.trim("owner"), r"^[^:]*:", ""), "/", -1))
    return catalog_entities.where("trim(owner) <> ''").groupBy(team.alias("team")).agg(F.count("*").alias("n_entities"))


def topic_inventory(edges: DataFrame) -> DataFrame:
    """Distinct publishers and consumers per target of publishing and consuming edges."""
    a = graph.active(edges)
    side = lambda *t: F.count_distinct(F.when(F.col("type").isin(*t), F.col("source_id")))
    return a.where(F.col("type").isin("PUBLISHES_TO", "CONSUMES_FROM")).groupBy(F.col("target_id").alias("topic")).agg(side("PUBLISHES_TO").alias("n_publishers"), side("CONSUMES_FROM").alias("n_consumers"))


def library_claims(files: DataFrame) -> DataFrame:
    """Packages of lock files: repo_id, ecosystem, name, version, purl. JSON locks by their keys, TOML locks by their blocks."""
    base = F.lower("name")
    npm = files.where(base == "package-lock.json").select("repo_id", F.explode(F.regexp_extract_all("content", F.lit(r'"node_modules/([^"]+)":\s*\{\s*"version":\s*"([^"]*)"'), F.lit(0))).alias("m"))
    npm = npm.select("repo_id", F.lit("npm").alias("ecosystem"), F.regexp_extract("m", r'node_modules/([^"]+)"', 1).alias("name"), F.regexp_extract("m", r'"version":\s*"([^"]*)"', 1).alias("version"))
    eco = F.when(base == "cargo.lock", "cargo").when(base == "poetry.lock", "pypi").otherwise("npm")
    toml = files.where(base.isin("cargo.lock", "poetry.lock", "yarn.lock")).select("repo_id", eco.alias("ecosystem"), F.explode(F.regexp_extract_all("content", F.lit(r'name = "[^"]+"\s+version = "[^"]*"'), F.lit(0))).alias("m"))
    toml = toml.select("repo_id", "ecosystem", F.regexp_extract("m", r'name = "([^"]+)"', 1).alias("name"), F.regexp_extract("m", r'version = "([^"]*)"', 1).alias("version"))
    return npm.unionByName(toml).distinct().withColumn("purl", keys.purl(F.col("ecosystem"), F.col("name")))


def library_usage(libs: DataFrame) -> DataFrame:
    """Dependents and version skew per package: purl, n_repos, n_versions."""
    return libs.groupBy("purl").agg(F.count_distinct("repo_id").alias("n_repos"), F.count_distinct("version").alias("n_versions"))
