"""Further queries over the table folder: claims of workloads, environment, search, views, streams and stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimweave.functions import keys, scalars
from claimweave.operators import graph, resolve, resolvers, temporal, traverse
from claimweave.operators.shredding import once
from claimweave.plans.graph_queries import DEP, DOCKER_CLAIMS, E, docker, edges, nodes
from claimweave.plans.registry import Registry
from claimweave.sources.tables import table

query = Registry()

ENV = """env AS (SELECT resource_id, repo_id, namespace, workload, e.name AS name, e.value AS value, e.source AS source FROM (SELECT resource_id, repo_id, namespace, workload, unnest(c.env) AS e FROM
 (SELECT resource_id, repo_id, coalesce(nullif(trim(namespace), ''), 'default') AS namespace, name AS workload, unnest(containers) AS c FROM (SELECT DISTINCT * FROM k8s_resources) WHERE containers IS NOT NULL) WHERE c IS NOT NULL) WHERE e IS NOT NULL)"""
HOST = "regexp_extract(value, '^https?://([^/:?#@]+)', 1)"


def env(spark: SparkSession, d: str) -> DataFrame:
    k = once(table(spark, d, "k8s_resources"), "resource_id")
    c = k.select("resource_id", "repo_id", F.coalesce(F.nullif(F.trim("namespace"), F.lit("")), F.lit("default")).alias("namespace"), F.col("name").alias("workload"), F.explode("containers").alias("c")).where("c is not null")
    e = c.select("resource_id", "repo_id", "namespace", "workload", F.explode("c.env").alias("e")).where("e is not null")
    return e.select("resource_id", "repo_id", "namespace", "workload", F.col("e.name").alias("name"), F.col("e.value").alias("value"), F.col("e.source").alias("source"))


@query()
def B_extract_slots(spark: SparkSession, d: str) -> DataFrame:
    """Hits of all extractors per language and slot."""
    from claimweave.sources import extractors

    f = table(spark, d, "files", "file_id", "repo_id", "path", "name", "language", "content").dropDuplicates(["file_id", "content"])
    hits = extractors.extract(f)
    return hits.groupBy("slot").agg(F.count("*").alias("n"), F.count_distinct("a").alias("n_distinct"))


@query()
def B45_coverage(spark: SparkSession, d: str) -> DataFrame:
    from claimweave.sources import extractors

    f = table(spark, d, "files", "file_id", "repo_id", "path", "name", "language", "content").dropDuplicates(["file_id", "content"])
    return extractors.coverage(f, extractors.extract(f))


@query("""WITH r AS (SELECT DISTINCT unnest(regexp_extract_all(text, '(?:GET|POST|PUT|PATCH|DELETE):/[\\w/{}.-]+')) AS r FROM documents WHERE text IS NOT NULL)
 SELECT r AS route, split_part(r, ':', 1) || ':/' || array_to_string(list_transform(list_filter(str_split(split_part(r, ':', 2), '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '^\\{[^}]*\\}$') THEN '{}' ELSE regexp_replace(s, '\\{[^}]*\\}', '{}', 'g') END), '/') AS key FROM r""")
def C1_http_keys(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "documents", "text").select(F.explode(F.regexp_extract_all("text", F.lit(r"(?:GET|POST|PUT|PATCH|DELETE):/[\w/{}.-]+"), F.lit(0))).alias("route")).distinct()
    at = lambda k: F.split_part("route", F.lit(":"), F.lit(k))
    return r.select("route", keys.http_key(at(1), at(2)).alias("key"))


@query("""SELECT DISTINCT lower(coalesce(nullif(trim(namespace), ''), 'default') || ':' || trim(name)) AS key FROM k8s_resources WHERE trim(coalesce(name, '')) <> ''""")
def C7_service_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "k8s_resources", "namespace", "name").where("trim(name) <> ''").select(keys.service_key(F.col("namespace"), F.col("name")).alias("key")).distinct()


@query("""SELECT is_internal, count(*) AS n FROM (SELECT DISTINCT name, CAST(name LIKE 'quern%' OR name LIKE 'oskel%' AS BIGINT) AS is_internal FROM (SELECT unnest(regexp_extract_all(content, '"node_modules/([^"]+)":\\s*\\{\\s*"version"', 1)) AS name FROM files WHERE lower(name) = 'package-lock.json')) GROUP BY is_internal""")
def C6_internal_libraries(spark: SparkSession, d: str) -> DataFrame:
    libs = resolve.library_claims(table(spark, d, "files", "repo_id", "name", "content").where(F.lower("name") == "package-lock.json"))
    npm = libs.where("ecosystem = 'npm'").select("name").distinct()
    return npm.select("name", keys.has_prefix(F.col("name"), ["quern", "oskel"]).cast("bigint").alias("is_internal")).groupBy("is_internal").agg(F.count("*").alias("n"))


@query(f"""WITH {ENV} SELECT lower({HOST}) AS host, count(*) AS n, CASE WHEN len(str_split(lower({HOST}), '.')) >= 2 AND regexp_matches(list_extract(str_split(lower({HOST}), '.'), -1), '^[a-z]{{2,}}$')
 AND NOT list_has_any(list_slice(str_split(lower({HOST}), '.'), 2, NULL), ['local', 'internal', 'svc', 'cluster', 'localdomain', 'lan', 'intranet']) THEN 1 ELSE 0 END AS is_external FROM env WHERE {HOST} <> '' GROUP BY ALL""")
def D9_external_hosts(spark: SparkSession, d: str) -> DataFrame:
    h = env(spark, d).select(F.lower(F.regexp_extract("value", r"^https?://([^/:?#@]+)", 1)).alias("host")).where("host <> ''")
    return h.groupBy("host").agg(F.count("*").alias("n")).select("host", "n", keys.looks_external(F.col("host")).cast("int").alias("is_external"))


@query(f"""WITH {ENV}, h AS (SELECT DISTINCT {HOST} AS host FROM env WHERE {HOST} <> ''), c(suffix, vendor) AS (VALUES ('internal.example', 'estate'), ('svc.cluster.local', 'cluster'), ('example', 'reserved')),
 x AS (SELECT host, suffix, vendor, row_number() OVER (PARTITION BY host ORDER BY length(suffix) DESC) AS rn FROM h JOIN c ON lower(host) = suffix OR ends_with(lower(host), '.' || suffix))
 SELECT host, CASE WHEN rn = 1 THEN vendor END AS vendor FROM h LEFT JOIN (SELECT * FROM x WHERE rn = 1) USING (host)""")
def E27_vendors(spark: SparkSession, d: str) -> DataFrame:
    h = env(spark, d).select(F.regexp_extract("value", r"^https?://([^/:?#@]+)", 1).alias("host")).where("host <> ''").distinct()
    c = spark.createDataFrame([("internal.example", "estate"), ("svc.cluster.local", "cluster"), ("example", "reserved")], "suffix string, vendor string")
    return resolvers.vendors(h, c).select("host", "vendor")


@query(f"""WITH {ENV}, s AS (SELECT DISTINCT lower(trim(name)) AS name FROM k8s_resources WHERE trim(coalesce(name, '')) <> ''),
 c AS (SELECT DISTINCT lower(trim(workload)) AS source, lower(split_part(regexp_replace({HOST}, '\\.svc(\\.cluster\\.local)?$', ''), '.', 1)) AS target FROM env WHERE {HOST} <> '' AND source = 'literal')
 SELECT CASE WHEN name IS NULL THEN 'unmatched' WHEN source = target THEN 'self' ELSE 'matched' END AS outcome, count(*) AS n FROM c LEFT JOIN s ON s.name = c.target GROUP BY 1""")
def E7_env_host_calls(spark: SparkSession, d: str) -> DataFrame:
    """Hosts in env literals against workload names; calls of a workload to itself are told apart."""
    s = table(spark, d, "k8s_resources", F.lower(F.trim("name")).alias("target")).where("target <> ''").distinct().withColumn("known", F.lit(1))
    e = env(spark, d).where("source = 'literal'").select(F.lower(F.trim("workload")).alias("source"), F.regexp_extract("value", r"^https?://([^/:?#@]+)", 1).alias("h")).where("h <> ''")
    c = e.select("source", keys.bare_host(F.col("h")).alias("target")).distinct().join(s, "target", "left")
    out = F.when(F.col("known").isNull(), "unmatched").when(F.col("source") == F.col("target"), "self").otherwise("matched")
    return c.groupBy(out.alias("outcome")).agg(F.count("*").alias("n"))


@query(f"""WITH {ENV}, d AS (SELECT name, count(DISTINCT repo_id) AS n_defining FROM env WHERE trim(coalesce(name, '')) <> '' GROUP BY name),
 r AS (SELECT name, count(DISTINCT repo_id) AS n_reading FROM (SELECT repo_id, unnest(regexp_extract_all(content, '(?:process\\.env\\.|os\\.environ\\[[''"]|os\\.getenv\\([''"]|System\\.getenv\\("|os\\.Getenv\\(")([A-Z][A-Z0-9_]*)', 1)) AS name FROM files WHERE content IS NOT NULL) GROUP BY name)
 SELECT coalesce(d.name, r.name) AS name, coalesce(n_defining, 0) AS n_defining, coalesce(n_reading, 0) AS n_reading, CAST(n_defining IS NULL AS BIGINT) AS orphaned FROM d FULL JOIN r ON d.name = r.name""")
def E42_config_ownership(spark: SparkSession, d: str) -> DataFrame:
    """Variables with the repositories that define and read them; reads without a definition are orphaned."""
    from claimweave.sources.extract import ENV_READ

    f = table(spark, d, "files", "repo_id", "content").select("repo_id", F.explode(F.regexp_extract_all("content", F.lit(ENV_READ), F.lit(1))).alias("name"))
    r = f.groupBy("name").agg(F.count_distinct("repo_id").alias("n_reading"))
    w = env(spark, d).where("trim(name) <> ''").groupBy("name").agg(F.count_distinct("repo_id").alias("n_defining"))
    j = w.join(r, "name", "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return j.select("name", zero("n_defining"), zero("n_reading"), F.col("n_defining").isNull().cast("bigint").alias("orphaned"))


@query("""WITH m AS (SELECT DISTINCT lower(trim(name)) AS service, CASE WHEN len(str_split(file_path, '/')) < 2 THEN '' WHEN str_split(file_path, '/')[1] IN ('projects', 'services', 'apps', 'packages', 'modules', 'libs', 'components', 'cmd', 'src') THEN CASE WHEN len(str_split(file_path, '/')) > 2 THEN str_split(file_path, '/')[1] || '/' || str_split(file_path, '/')[2] ELSE str_split(file_path, '/')[1] END
 WHEN str_split(file_path, '/')[1] IN ('deploy', 'deployment', 'deployments', 'docker', 'dockerfiles', 'k8s', 'kubernetes', 'kube', 'manifests', 'manifest', 'chart', 'charts', 'helm', 'helmfile', 'kustomize', 'overlays', 'infra', 'infrastructure', 'terraform', 'tf', 'ansible', 'ops', 'argocd', 'flux', 'skaffold', 'compose', 'ci', 'build', 'scripts', 'config', 'configs', 'etc', 'env', 'environments', '.github', '.gitlab', '.circleci') THEN '' ELSE str_split(file_path, '/')[1] END AS module FROM docker_resources WHERE trim(coalesce(name, '')) <> '')
 SELECT service, CASE WHEN count(*) FILTER (module <> '') = 1 THEN max(module) END AS module, count(*) FILTER (module <> '') AS n_modules FROM m GROUP BY service""")
def E15_service_modules(spark: SparkSession, d: str) -> DataFrame:
    """The one module a service is declared in; none or several decline."""
    m = table(spark, d, "docker_resources", "name", "file_path").where("trim(name) <> ''").select(F.lower(F.trim("name")).alias("service"), keys.module_of(F.col("file_path")).alias("module")).distinct()
    g = m.groupBy("service").agg(F.count(F.when(F.col("module") != "", 1)).alias("n_modules"), F.max("module").alias("top"))
    return g.select("service", F.when(F.col("n_modules") == 1, F.col("top")).alias("module"), "n_modules")


@query()
def E13_service_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Identities of compose services over directories as scopes."""
    p = docker(spark, d).where("trim(name) <> ''").select(F.lower(F.trim("name")).alias("name"), F.concat_ws("/", "repo_id", F.regexp_replace("file_path", "/?[^/]*$", "")).alias("scope"), "repo_id").distinct()
    return resolvers.service_clusters(p)


@query(f"""WITH {DOCKER_CLAIMS}, s AS (SELECT DISTINCT key AS name FROM claims WHERE kind = 'svcname' AND direction = 'provides'), h AS (SELECT key AS hint, count(*) AS n FROM claims WHERE kind = 'svcname' AND direction = 'consumes' AND key NOT IN (SELECT name FROM s) GROUP BY key),
 fs AS (SELECT DISTINCT name, unnest([translate(name, '-_.', ''), regexp_replace(translate(name, '-_.', ''), '^(.+)(service|server|svc|srv|api|app)$', '\\1'), regexp_replace(translate(split_part(name, '.', 1), '-_.', ''), '^(.+)(service|server|svc|srv|api|app)$', '\\1')]) AS form FROM s),
 fh AS (SELECT DISTINCT hint, unnest([translate(hint, '-_.', ''), regexp_replace(translate(hint, '-_.', ''), '^(.+)(service|server|svc|srv|api|app)$', '\\1'), regexp_replace(translate(split_part(hint, '.', 1), '-_.', ''), '^(.+)(service|server|svc|srv|api|app)$', '\\1')]) AS form FROM h),
 g AS (SELECT hint, list_sort(list(DISTINCT name)) AS c FROM fh JOIN fs USING (form) WHERE form <> '' AND hint <> name GROUP BY hint)
 SELECT h.hint, n, coalesce(array_to_string(list_slice(c, 1, 3), ','), '') AS candidates, CASE WHEN c IS NULL THEN 'none' WHEN len(c) = 1 THEN 'suggested' ELSE 'ambiguous' END AS outcome FROM h LEFT JOIN g ON g.hint = h.hint""")
def H9_alias_suggestions(spark: SparkSession, d: str) -> DataFrame:
    c = resolve.docker_claims(docker(spark, d)).where("kind = 'svcname'")
    s = c.where("direction = 'provides'").select(F.col("key").alias("name")).distinct()
    h = c.where("direction = 'consumes'").join(s.withColumnRenamed("name", "key"), "key", "left_anti").groupBy(F.col("key").alias("hint")).agg(F.count("*").alias("n"))
    return resolvers.alias_suggestions(h, s)


@query(f"""WITH {E}, a AS (SELECT DISTINCT type FROM e WHERE status = 'active'), x AS (SELECT type, target_id, count(DISTINCT source_id) FILTER (type IN ('CALLS', 'CALLS_SERVICE')) AS n FROM e WHERE status = 'active' GROUP BY ALL),
 d AS (SELECT DISTINCT target_id FROM e WHERE status = 'active' AND type = 'EXPOSES'), c AS (SELECT target_id, count(DISTINCT source_id) AS n FROM e WHERE status = 'active' AND type IN ('CALLS', 'CALLS_SERVICE') GROUP BY 1)
 SELECT target_id, coalesce(n, 0) AS n_consumers, CAST(n IS NULL AS BIGINT) AS safe_to_remove FROM d LEFT JOIN c USING (target_id)""")
def F17_removal_report(spark: SparkSession, d: str) -> DataFrame:
    """Exposed targets with the number of their active callers."""
    a = graph.active(edges(spark, d))
    c = a.where(F.col("type").isin("CALLS", "CALLS_SERVICE")).groupBy("target_id").agg(F.count_distinct("source_id").alias("n"))
    x = a.where("type = 'EXPOSES'").select("target_id").distinct().join(c, "target_id", "left")
    return x.select("target_id", F.coalesce("n", F.lit(0)).alias("n_consumers"), F.col("n").isNull().cast("bigint").alias("safe_to_remove"))


@query(f"""WITH {E}, c AS (SELECT repo_id, edge_id FROM e) SELECT repo_id, count(*) AS n FROM c GROUP BY repo_id""")
def F22_claims_per_repo(spark: SparkSession, d: str) -> DataFrame:
    """Claim fingerprints: their number per repository (the digest itself is tested against shuffled orders)."""
    f = temporal.fingerprints(edges(spark, d).select("repo_id", F.col("edge_id").cast("string").alias("id")))
    return f.select("repo_id", "n")


@query()
def F23_tree_digests(spark: SparkSession, d: str) -> DataFrame:
    from claimweave.sources.repositories import tree_digest

    return tree_digest(table(spark, d, "files", "repo_id", "path", "content").where("path is not null"))


@query("""SELECT id, name, type, tier, score FROM (SELECT DISTINCT id, name, type, CAST(tier AS INT) AS tier, round(1 - tier / 6.0, 4) AS score, length(coalesce(name, '')) AS len FROM (SELECT id, name, type, CASE WHEN coalesce(name, '') = 'lock' THEN 0 WHEN lower(coalesce(name, '')) = 'lock' THEN 1
 WHEN lower(coalesce(name, '')) LIKE 'lock%' THEN 2 WHEN contains(lower(coalesce(name, '')), 'lock') OR contains(lower(coalesce(label, '')), 'lock') THEN 3 WHEN contains(lower(coalesce(path, '')), 'lock') THEN 4
 WHEN contains(lower(id), 'lock') THEN 5 END AS tier FROM (SELECT DISTINCT id, name, label, path, type FROM nodes)) WHERE tier IS NOT NULL) ORDER BY tier, len, id LIMIT 50""")
def G1_ranked_search(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty hits of a ranked search."""
    n = table(spark, d, "nodes", "id", "name", "label", "path", "type").distinct()
    hits = graph.search(n, "lock").distinct()
    return hits.orderBy("tier", F.length(F.coalesce("name", F.lit(""))), "id").limit(50)


@query(f"""WITH {E}, c AS (SELECT source_id, target_id, confidence, edge_id, row_number() OVER (PARTITION BY source_id ORDER BY confidence DESC, target_id, edge_id) AS rn, count(*) OVER (PARTITION BY source_id) AS total FROM e WHERE status = 'active')
 SELECT source_id, target_id, rn AS rank, total, CAST(total > 3 AS BIGINT) AS truncated FROM c WHERE rn <= 3""")
def G8_bounded_with_totals(spark: SparkSession, d: str) -> DataFrame:
    """The three best targets per node, with true totals."""
    w = Window.partitionBy("source_id")
    c = graph.active(edges(spark, d)).withColumns({"rank": F.row_number().over(w.orderBy(F.col("confidence").desc(), "target_id", "edge_id")).cast("bigint"), "total": F.count("*").over(w)})
    return c.where("rank <= 3").select("source_id", "target_id", "rank", "total", (F.col("total") > 3).cast("bigint").alias("truncated"))


@query(f"""WITH {E}, h AS (SELECT type, loaded_at < TIMESTAMP '2025-07-01' AS early, source_id, target_id FROM e WHERE status = 'active'), a AS (SELECT DISTINCT type, source_id, target_id FROM h WHERE early), b AS (SELECT DISTINCT type, source_id, target_id FROM h WHERE NOT early),
 x AS ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)) SELECT type, count(*) AS n FROM x GROUP BY type""")
def H10_changed_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of relations that differ between two states."""
    from claimweave.plans.graph_queries import _halves

    a, b = (x.select("type", "source_id", "target_id").distinct() for x in _halves(spark, d))
    return a.exceptAll(b).unionByName(b.exceptAll(a)).groupBy("type").agg(F.count("*").alias("n"))


@query(f"""WITH {E}, s AS (SELECT source_id AS a, target_id AS b, max(confidence) AS c FROM e WHERE status = 'active' AND type IN ({DEP}) AND source_id <> target_id GROUP BY ALL)
 SELECT p.a AS start, q.b AS node_id, count(*) AS n_paths, round(max(round(p.c * q.c, 4)), 4) AS best, round(max(round(least(p.c, q.c), 4)), 4) AS strongest_weakest FROM s p JOIN s q ON p.b = q.a WHERE p.a <> q.b GROUP BY ALL""")
def I9_path_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Two-step ways with the product of their confidences and their weakest step."""
    s = graph.dependence(graph.active(edges(spark, d))).where("source_id <> target_id").groupBy(F.col("source_id").alias("a"), F.col("target_id").alias("b")).agg(F.max("confidence").alias("c"))
    two = s.alias("p").join(s.alias("q"), F.col("p.b") == F.col("q.a")).where("p.a <> q.b")
    pc = scalars.path_confidence(F.array("p.c", "q.c"))
    return two.select(F.col("p.a").alias("start"), F.col("q.b").alias("node_id"), pc.alias("pc")).groupBy("start", "node_id").agg(F.count("*").alias("n_paths"), F.round(F.max("pc.product"), 4).alias("best"), F.round(F.max("pc.weakest"), 4).alias("strongest_weakest"))


@query(f"""WITH RECURSIVE {E}, s AS (SELECT DISTINCT source_id AS a, target_id AS b FROM e WHERE status = 'active' AND source_id <> target_id), starts AS (SELECT DISTINCT id AS a FROM nodes WHERE type = 'Repo'),
 p AS (SELECT [a] AS path, a AS cur, 0 AS hops FROM starts UNION ALL SELECT list_append(path, s.b), s.b, hops + 1 FROM p JOIN s ON p.cur = s.a WHERE hops < 2 AND NOT list_contains(path, s.b)),
 r AS (SELECT path, hops, row_number() OVER (PARTITION BY path[1] ORDER BY hops, array_to_string(path, chr(1))) AS rank FROM p WHERE hops > 0) SELECT array_to_string(path, ' > ') AS path, CAST(hops AS BIGINT) AS hops, rank FROM r WHERE rank <= 3""")
def I6_bounded_paths(spark: SparkSession, d: str) -> DataFrame:
    """The first three paths from every repository node by length and nodes."""
    starts = table(spark, d, "nodes", "id", "type").where("type = 'Repo'").select(F.col("id").alias("a")).distinct()
    p = traverse.ranked_paths(traverse.paths(traverse.steps(edges(spark, d)), starts, 2), 3)
    return p.select(F.array_join("path", " > ").alias("path"), "hops", F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH {E}, n AS (SELECT repo_id, edge_id FROM e WHERE loaded_at >= TIMESTAMP '2025-12-01') SELECT DISTINCT repo_id FROM n""")
def J2_stale_repositories(spark: SparkSession, d: str) -> DataFrame:
    """Repositories whose claims differ from those before December."""
    e = graph.clean_edges(table(spark, d, "edges", "edge_id", "source_id", "target_id", "type", "repo_id", "loaded_at", "confidence", "status")).join(table(spark, d, "edges", "edge_id", "loaded_at").distinct(), "edge_id")
    c = e.select("repo_id", F.col("edge_id").cast("string").alias("id"), "loaded_at")
    return temporal.stale_groups(temporal.fingerprints(c), temporal.fingerprints(c.where(F.col("loaded_at") < F.to_timestamp_ntz(F.lit("2025-12-01 00:00:00")))))


@query("""WITH c AS (SELECT DISTINCT repo_id, regexp_extract(ev, '^(.*):(\\d+)', 1) AS path, CAST(nullif(regexp_extract(ev, '^(.*):(\\d+)', 2), '') AS BIGINT) AS line FROM (SELECT repo_id, unnest(evidence) AS ev FROM edges) WHERE ev IS NOT NULL),
 f AS (SELECT repo_id, name, max(len(str_split(content, chr(10)))) AS n FROM files WHERE content IS NOT NULL GROUP BY ALL)
 SELECT CASE WHEN n IS NULL THEN 'no_file' WHEN line > n THEN 'beyond_end' ELSE 'cited' END AS state, count(*) AS n FROM c LEFT JOIN f ON f.repo_id = c.repo_id AND f.name = split_part(c.path, '/', -1) GROUP BY 1""")
def J8_cited_lines(spark: SparkSession, d: str) -> DataFrame:
    """Cited lines against the files of that name in the repository: present, beyond the end, or without a file."""
    ev = table(spark, d, "edges", "repo_id", "evidence").select("repo_id", F.explode("evidence").alias("ev")).where("ev is not null")
    s = ev.select("repo_id", keys.evidence_span(F.col("ev")).alias("s")).select("repo_id", F.col("s.path").alias("path"), F.col("s.first").alias("line")).distinct()
    f = table(spark, d, "files", "repo_id", "name", "content").where("content is not null").groupBy("repo_id", "name").agg(F.max(F.size(F.split("content", "\n"))).alias("n"))
    j = s.withColumn("name", F.substring_index("path", "/", -1)).join(f, ["repo_id", "name"], "left")
    return j.groupBy(F.when(F.col("n").isNull(), "no_file").when(F.col("line") > F.col("n"), "beyond_end").otherwise("cited").alias("state")).agg(F.count("*").alias("n"))


@query("""SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def J10_tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    from claimweave.streaming.events import tumbling

    w = tumbling(table(spark, d, "events", "ts", "event_type", "value"), "ts", "1 day", ["event_type"])
    return w.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL '6 hours' THEN 1 ELSE 0 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM o)
 SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, g""")
def J10_sessions(spark: SparkSession, d: str) -> DataFrame:
    from claimweave.streaming.events import sessions

    s = sessions(table(spark, d, "events", "ts", "user_id"), "ts", "6 hours", ["user_id"])
    return s.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


@query()
def K1_keyed_digests(spark: SparkSession, d: str) -> DataFrame:
    """Distinct keyed digests of env values per variable; the digest equals Python's hmac (tested)."""
    v = env(spark, d).where("value is not null").select("name", scalars.hmac16(F.col("value"), "graph-key").alias("digest"))
    return v.groupBy("name").agg(F.count_distinct("digest").alias("n_values"))


@query(f"""WITH {E}, x AS (SELECT split_part(source_id, ':', 1) AS r, split_part(target_id, ':', 1) AS t, type FROM e WHERE status = 'active'), g AS (SELECT type, r = t AS inside FROM x)
 SELECT coalesce(type, '(all)') AS type, CASE WHEN grouping(inside) = 1 THEN '(all)' WHEN inside THEN 'inside' ELSE 'across' END AS place, count(*) AS n FROM g GROUP BY CUBE (type, inside)""")
def O_cube_of_types(spark: SparkSession, d: str) -> DataFrame:
    e = graph.active(edges(spark, d)).select("type", (graph.repo_of(F.col("source_id")) == graph.repo_of(F.col("target_id"))).alias("inside"))
    c = e.cube("type", "inside").agg(F.grouping("inside").alias("g"), F.count("*").alias("n"))
    return c.select(F.coalesce("type", F.lit("(all)")).alias("type"), F.when(F.col("g") == 1, "(all)").when(F.col("inside"), "inside").otherwise("across").alias("place"), "n")


@query("""WITH c AS (SELECT DISTINCT repo_id, committed_at, head_sha FROM artifacts WHERE trim(coalesce(head_sha, '')) <> ''), s AS (SELECT DISTINCT scan_id, repo_id, scanned_at FROM scan_meta)
 SELECT scan_id, s.repo_id, max(committed_at) AS committed_at FROM s LEFT JOIN c ON c.repo_id = s.repo_id AND c.committed_at <= s.scanned_at GROUP BY scan_id, s.repo_id""")
def O_asof_commit(spark: SparkSession, d: str) -> DataFrame:
    """The last commit before each scan, by one union and a running maximum per repository."""
    c = table(spark, d, "artifacts", "repo_id", "committed_at", "head_sha").where("trim(head_sha) <> ''").select("repo_id", F.col("committed_at").alias("at"), F.lit(None).cast("bigint").alias("scan_id"), F.col("committed_at")).distinct()
    s = table(spark, d, "scan_meta", "scan_id", "repo_id", "scanned_at").distinct().select("repo_id", F.col("scanned_at").alias("at"), "scan_id", F.lit(None).cast("timestamp_ntz").alias("committed_at"))
    w = Window.partitionBy("repo_id").orderBy("at", F.col("scan_id").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return c.unionByName(s).withColumn("committed_at", F.max("committed_at").over(w)).where("scan_id is not null").select("scan_id", "repo_id", "committed_at").groupBy("scan_id", "repo_id").agg(F.max("committed_at").alias("committed_at"))


@query(f"""WITH {E}, d AS (SELECT n AS node_id, count(*) AS degree FROM (SELECT source_id AS n FROM e WHERE status = 'active' UNION ALL SELECT target_id FROM e WHERE status = 'active') GROUP BY n), r AS (SELECT node_id, degree, split_part(node_id, ':', 1) AS repo_id, row_number() OVER (PARTITION BY split_part(node_id, ':', 1) ORDER BY degree DESC, node_id) AS rank FROM d)
 SELECT repo_id, node_id, degree, rank FROM r WHERE rank <= 5""")
def N3_group_detail(spark: SparkSession, d: str) -> DataFrame:
    """The five nodes of highest degree per repository."""
    x = graph.active(edges(spark, d)).select(F.explode(F.array("source_id", "target_id")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("degree")).withColumn("repo_id", graph.repo_of(F.col("node_id")))
    r = x.withColumn("rank", F.row_number().over(Window.partitionBy("repo_id").orderBy(F.col("degree").desc(), "node_id")).cast("bigint"))
    return r.where("rank <= 5").select("repo_id", "node_id", "degree", "rank")


@query(f"""WITH {E}, a AS (SELECT * FROM e WHERE status = 'active' AND type <> 'BUILT_FROM'), n AS (SELECT DISTINCT id FROM nodes), s AS (SELECT *, source_id IN (SELECT id FROM n) AND target_id IN (SELECT id FROM n) AS whole FROM a)
 SELECT repo_id, count(*) FILTER (whole) AS n_edges, count(*) FILTER (NOT whole) AS n_dangling FROM s GROUP BY repo_id""")
def N1_project_map(spark: SparkSession, d: str) -> DataFrame:
    """Edges of each repository's map and those that dangle."""
    a = graph.active(edges(spark, d)).where("type <> 'BUILT_FROM'")
    n = table(spark, d, "nodes", "id").distinct()
    flag = lambda c, name: n.select(F.col("id").alias(c), F.lit(True).alias(name))
    j = a.join(flag("source_id", "s"), "source_id", "left").join(flag("target_id", "t"), "target_id", "left")
    whole = F.coalesce(F.col("s") & F.col("t"), F.lit(False))
    return j.groupBy("repo_id").agg(F.count(F.when(whole, 1)).alias("n_edges"), F.count(F.when(~whole, 1)).alias("n_dangling"))


@query()
def P12_planted_recall(spark: SparkSession, d: str) -> DataFrame:
    """A synthetic estate as large as the catalogue, linked; what was planted and what was found."""
    from claimweave.sources.synthetic import estate, planted_recall

    claims, planted = estate(spark, table(spark, d, "catalog_entities", "record_id").count())
    p = claims.where("direction = 'provides'").select(F.col("repo_id").alias("provider"), "key")
    c = claims.where("direction = 'consumes'").select(F.col("repo_id").alias("consumer"), "key")
    return planted_recall(c.join(p, "key").where("consumer <> provider"), planted)


@query("""WITH o AS (SELECT p_partkey AS op_id, 'part' AS package, p_brand || p_size AS service FROM part), s AS (SELECT DISTINCT s_nationkey || ':' || p_brand || p_size AS call_id, lower(CASE WHEN p_size % 2 = 0 THEN 'part.' || p_brand || p_size ELSE p_brand || p_size END) AS name
 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey), n AS (SELECT op_id, lower(package || '.' || service) AS name FROM o UNION SELECT op_id, lower(service) FROM o), h AS (SELECT DISTINCT call_id, op_id FROM s JOIN n USING (name)), c AS (SELECT call_id, count(*) AS n FROM h GROUP BY 1)
 SELECT DISTINCT s.call_id, CASE WHEN n <= 4 THEN op_id END AS op_id, CASE WHEN n IS NULL THEN 'unmatched' WHEN n > 4 THEN 'fanout' ELSE 'matched' END AS outcome FROM s LEFT JOIN c ON c.call_id = s.call_id LEFT JOIN h ON h.call_id = s.call_id""")
def E25_grpc(spark: SparkSession, d: str) -> DataFrame:
    """Parts as operations of a service per brand and size, stubs per nation by full or bare name."""
    return resolvers.match_grpc(*_grpc(spark, d), 4)


@query(query.sql["E25_grpc"].replace("n <= 4 ", "n <= 32 ").replace("n > 4 ", "n > 32 "))
def E25_grpc_cap32(spark: SparkSession, d: str) -> DataFrame:
    """The same under the operator's own cap."""
    return resolvers.match_grpc(*_grpc(spark, d))


def _grpc(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Stubs and operations of E25."""
    p = table(spark, d, "part", "p_partkey", "p_brand", "p_size").withColumn("service", F.concat("p_brand", F.col("p_size").cast("string")))
    li, sup = table(spark, d, "lineitem", "l_partkey", "l_suppkey"), table(spark, d, "supplier", "s_suppkey", "s_nationkey")
    used = li.join(p, li.l_partkey == p.p_partkey).join(sup, li.l_suppkey == sup.s_suppkey)
    stubs = used.select(F.concat_ws(":", F.col("s_nationkey").cast("string"), "service").alias("call_id"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("part."), "service")).otherwise(F.col("service")).alias("service")).distinct()
    ops = p.select(F.col("p_partkey").alias("op_id"), F.lit("part").alias("package"), "service")
    return stubs, ops


@query("""WITH r AS (SELECT DISTINCT o_orderkey AS rid, o_orderpriority AS m, substr(CAST(o_orderdate AS VARCHAR), 1, 10) AS t FROM orders), h AS (SELECT DISTINCT o_custkey AS target, o_orderpriority AS m, substr(CAST(o_orderdate AS VARCHAR), 1, 10) AS t FROM orders WHERE o_orderstatus = 'F'),
 g AS (SELECT rid, count(DISTINCT target) AS n, min(target) AS sole FROM r JOIN h USING (m, t) GROUP BY rid)
 SELECT r.rid, CASE WHEN n = 1 THEN sole END AS target, CASE WHEN n IS NULL THEN 'unmatched' WHEN n > 1 THEN 'ambiguous' ELSE 'matched' END AS outcome FROM r LEFT JOIN g USING (rid)""")
def E34_exactly_one(spark: SparkSession, d: str) -> DataFrame:
    """The rule of webhooks, bound operations and event schemas: a single distinct target at equal columns, else a decline."""
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate", "o_orderstatus")
    day = F.to_date("o_orderdate").cast("string")
    left = o.select(F.col("o_orderkey").alias("rid"), F.col("o_orderpriority").alias("m"), day.alias("t"))
    right = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("target"), F.col("o_orderpriority").alias("m"), day.alias("t"))
    return resolvers.exactly_one(left, right, ["m", "t"], "rid", "target")


@query("""WITH c AS (SELECT DISTINCT split_part(r, ':', 2) AS path FROM (SELECT unnest(regexp_extract_all(text, '(?:GET|POST|PUT|PATCH|DELETE):/[\\w/{}.-]+')) AS r FROM documents WHERE text IS NOT NULL)), t(prefix, target) AS (VALUES ('/v1', 'a'), ('/v2', 'b'), ('/v1/co', 'c'), ('/v2/co', 'd'), ('/v2/co', 'e')),
 h AS (SELECT path, prefix, target, rank() OVER (PARTITION BY path ORDER BY length(prefix) DESC) AS k FROM c JOIN t ON starts_with(path, prefix)), g AS (SELECT path, count(DISTINCT target) AS n, min(target) AS sole, max(prefix) AS prefix FROM h WHERE k = 1 GROUP BY path)
 SELECT c.path AS call_id, prefix, CASE WHEN n = 1 THEN sole END AS target, CASE WHEN n IS NULL THEN 'unmatched' WHEN n > 1 THEN 'ambiguous' ELSE 'matched' END AS outcome FROM c LEFT JOIN g ON g.path = c.path""")
def E23_longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Routes cited in documents against gateway prefixes: raw prefixes, the longest wins, two targets decline."""
    r = table(spark, d, "documents", "text").select(F.explode(F.regexp_extract_all("text", F.lit(r"(?:GET|POST|PUT|PATCH|DELETE):/[\w/{}.-]+"), F.lit(0))).alias("r"))
    calls = r.select(F.split_part("r", F.lit(":"), F.lit(2)).alias("path")).distinct().select(F.col("path").alias("call_id"), F.lit("docs").alias("repo_id"), "path")
    routes = spark.createDataFrame([("/v1", "a", "gw"), ("/v2", "b", "gw"), ("/v1/co", "c", "gw"), ("/v2/co", "d", "gw"), ("/v2/co", "e", "gw")], "prefix string, target string, repo_id string")
    return resolvers.longest_prefix(calls, routes)


@query(f"""WITH {ENV}, v AS (SELECT DISTINCT repo_id, name, {HOST} AS host FROM env WHERE {HOST} <> '' AND trim(coalesce(name, '')) <> ''), r AS (SELECT DISTINCT repo_id || ':' || name AS read_id, repo_id, name FROM v),
 h AS (SELECT DISTINCT r.read_id, v.host, v.repo_id = r.repo_id AS same FROM r JOIN v ON v.name = r.name), b AS (SELECT read_id, bool_or(same) AS anysame FROM h GROUP BY read_id),
 g AS (SELECT h.read_id, count(DISTINCT host) AS n, min(host) AS sole FROM h JOIN b USING (read_id) WHERE same = anysame GROUP BY h.read_id)
 SELECT read_id, CASE WHEN n = 1 THEN sole END AS host, CASE WHEN n > 1 THEN 'ambiguous' ELSE 'matched' END AS outcome FROM g""")
def E29_env_calls(spark: SparkSession, d: str) -> DataFrame:
    """Variables read by each repository that configures them, resolved to one host, own values first."""
    v = env(spark, d).select("repo_id", "name", F.regexp_extract("value", r"^https?://([^/:?#@]+)", 1).alias("host")).where("host <> '' and trim(name) <> ''").distinct()
    reads = v.select(F.concat_ws(":", "repo_id", "name").alias("read_id"), "repo_id", "name").distinct()
    return resolvers.env_calls(reads, v)


QUERIES, SQL = query.queries, query.sql
