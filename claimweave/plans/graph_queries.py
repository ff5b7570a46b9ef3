"""Queries of the evidence graph over the table folder, each named by the operator it runs, with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions import keys, scalars
from claimweave.operators import graph, resolve, temporal, traverse
from claimweave.operators import snapshots as snap
from claimweave.operators.shredding import once
from claimweave.plans.registry import Registry
from claimweave.sources.tables import table

query = Registry()

#: The cleaned edges as a common table expression.
E = """e AS (SELECT DISTINCT edge_id, trim(source_id) AS source_id, trim(target_id) AS target_id, type, repo_id, coalesce(confidence, 1.0) AS confidence,
 coalesce(status, 'active') AS status, coalesce(detected_by, '') AS detected_by, loaded_at FROM edges
 WHERE trim(coalesce(source_id, '')) <> '' AND trim(coalesce(target_id, '')) <> '')"""
DEP = ", ".join(f"'{t}'" for t in graph.DEPENDENCE)


def edges(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return graph.clean_edges(table(spark, d, "edges", "edge_id", "source_id", "target_id", "type", "repo_id", "confidence", "status", "detected_by", "loaded_at", *more))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nodes").distinct()


# Sources and structure


@query("""SELECT repo_id, lower(regexp_extract(name, '\\.([^.]+)$', 1)) AS ext, count(DISTINCT file_id) AS n_files, CAST(sum(length(content)) AS BIGINT) AS n_chars
 FROM (SELECT DISTINCT * FROM files) WHERE content IS NOT NULL AND length(content) <= 1000000 AND NOT regexp_matches(path, '(^|/)(\\.git|node_modules|target|build|dist|\\.next|\\.venv|venv|__pycache__|\\.idea|\\.vscode|coverage|\\.pytest_cache|\\.gradle|\\.mvn|out|bin|obj|vendor|[^/]*\\.egg-info|\\.tox|\\.eggs|htmlcov|\\.coverage)/')
 GROUP BY ALL""")
def A1_scan_files(spark: SparkSession, d: str) -> DataFrame:
    """Directory scan: ignored directories and files over 1 MB drop out; extension from the name."""
    from claimweave.sources.repositories import scannable

    f = scannable(table(spark, d, "files").distinct())
    return f.groupBy("repo_id", F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)).alias("ext")).agg(F.count_distinct("file_id").alias("n_files"), F.sum(F.length("content")).alias("n_chars"))


@query("""WITH p AS (SELECT DISTINCT repo_id, str_split(path, '/') AS parts FROM files WHERE path IS NOT NULL),
 x AS (SELECT repo_id, parts, unnest(range(1, len(parts) + 1)) AS k FROM p)
 SELECT DISTINCT repo_id, array_to_string(list_slice(parts, 1, k - 1), '/') AS parent, array_to_string(list_slice(parts, 1, k), '/') AS child,
 CASE WHEN k = len(parts) THEN 'File' ELSE 'Folder' END AS type FROM x""")
def A3_build_structure(spark: SparkSession, d: str) -> DataFrame:
    """Folders and files of every repository with their containment."""
    from claimweave.sources.repositories import structure

    return structure(table(spark, d, "files", "repo_id", "path"))


@query(f"""WITH {E} SELECT side, count(*) AS n FROM (SELECT 'source' AS side, source_id AS id FROM e UNION ALL SELECT 'target', target_id FROM e)
 WHERE id NOT IN (SELECT id FROM nodes WHERE id IS NOT NULL) GROUP BY side""")
def A19_missing_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """Ends that a checked write would refuse."""
    e = edges(spark, d)
    ends = e.select(F.explode(F.array(F.struct(F.lit("source").alias("side"), F.col("source_id").alias("id")), F.struct(F.lit("target").alias("side"), F.col("target_id").alias("id")))).alias("x")).select("x.*")
    return ends.join(table(spark, d, "nodes", "id").distinct(), "id", "left_anti").groupBy("side").agg(F.count("*").alias("n"))


@query(f"""WITH {E} SELECT type, count(DISTINCT id) AS n_unreferenced FROM nodes WHERE id NOT IN (SELECT source_id FROM e UNION ALL SELECT target_id FROM e) GROUP BY type""")
def A21_unreferenced_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that no edge refers to: what a garbage collection would remove."""
    e = edges(spark, d)
    used = e.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    return nodes(spark, d).join(used, "id", "left_anti").groupBy("type").agg(F.count_distinct("id").alias("n_unreferenced"))


@query("""WITH a AS (SELECT DISTINCT artifact_id, repo_id, delivered_at, unnest(edges) AS x FROM artifacts WHERE edges IS NOT NULL),
 f AS (SELECT x.source_id AS source_id, x.type AS type, x.target_id AS target_id, x.status AS status, row_number() OVER (PARTITION BY x.source_id, x.type, x.target_id ORDER BY delivered_at DESC, artifact_id DESC) AS rn FROM a)
 SELECT type, status, count(*) AS n_edges FROM f WHERE rn = 1 GROUP BY type, status""")
def A13_compact_union(spark: SparkSession, d: str) -> DataFrame:
    """Union of all artifacts where the last delivery of an edge replaces earlier ones."""
    from claimweave.sources.artifacts import compact

    return compact(table(spark, d, "artifacts")).groupBy("type", "status").agg(F.count("*").alias("n_edges"))


# Extraction


@query("""WITH l AS (SELECT DISTINCT file_id, language, unnest(regexp_extract_all(content, '(?:process\\.env\\.|os\\.environ\\[[''"]|os\\.getenv\\([''"]|System\\.getenv\\("|os\\.Getenv\\(")([A-Z][A-Z0-9_]*)', 1)) AS name FROM files WHERE content IS NOT NULL)
 SELECT language, name, count(*) AS n_files FROM l GROUP BY language, name""")
def B22_env_reads(spark: SparkSession, d: str) -> DataFrame:
    """Environment variables that source files read."""
    from claimweave.sources.extract import env_reads

    return env_reads(table(spark, d, "files", "file_id", "language", "content")).groupBy("language", "name").agg(F.count_distinct("file_id").alias("n_files"))


@query("""WITH l AS (SELECT file_id, unnest(str_split(replace(content, chr(13), ''), chr(10))) AS line FROM (SELECT DISTINCT file_id, name, content FROM files) WHERE lower(name) LIKE '%.properties' AND content IS NOT NULL)
 SELECT trim(split_part(line, '=', 1)) AS key, count(*) AS n, count(DISTINCT file_id) AS n_files FROM l WHERE line LIKE '%=%' AND NOT regexp_matches(line, '^\\s*[#!]') GROUP BY ALL""")
def B30_config_keys(spark: SparkSession, d: str) -> DataFrame:
    """Flattened keys of properties files."""
    from claimweave.sources.extract import properties

    f = table(spark, d, "files", "file_id", "name", "content").distinct()
    return properties(f).groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("file_id").alias("n_files"))


@query("""WITH m AS (SELECT DISTINCT repo_id, unnest(regexp_extract_all(content, '"node_modules/([^"]+)":\\s*\\{\\s*"version":\\s*"[^"]*"', 1)) AS name FROM files WHERE lower(name) = 'package-lock.json'
 UNION SELECT repo_id, unnest(regexp_extract_all(content, 'name = "([^"]+)"\\s+version = "[^"]*"', 1)) FROM files WHERE lower(name) = 'yarn.lock')
 SELECT name, count(*) AS n_repos FROM m GROUP BY name""")
def B31_lockfile_packages(spark: SparkSession, d: str) -> DataFrame:
    """Packages that lock files of the npm ecosystem resolve: every row of the operator."""
    libs = resolve.library_claims(table(spark, d, "files", "repo_id", "name", "content")).where(F.col("ecosystem") == "npm")
    return libs.groupBy("name").agg(F.count_distinct("repo_id").alias("n_repos"))


@query("""WITH l AS (SELECT file_id, language, unnest(str_split(content, chr(10))) AS line FROM (SELECT DISTINCT file_id, language, content FROM files) WHERE content IS NOT NULL),
 s AS (SELECT language, CASE WHEN language = 'Python' THEN regexp_extract(line, '^\\s*(?:async )?def (\\w+)\\(', 1)
 WHEN language = 'Go' THEN regexp_extract(line, '^func (?:\\([^)]*\\) )?(\\w+)\\(', 1)
 WHEN language IN ('JavaScript', 'TypeScript') THEN regexp_extract(line, '^\\s*(?:export )?(?:default )?(?:async )?function (\\w+)\\(', 1)
 WHEN language = 'Java' THEN regexp_extract(line, '^\\s*(?:public|protected|private)\\b[^=;(]* (\\w+)\\([^;]*\\{', 1) END AS symbol FROM l)
 SELECT language, count(*) AS n_symbols, count(DISTINCT symbol) AS n_names FROM s WHERE symbol <> '' GROUP BY language""")
def B14_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Functions and methods declared per language, by pattern, in files with a recorded language."""
    from claimweave.sources.extract import symbols

    s = symbols(table(spark, d, "files", "file_id", "repo_id", "path", "name", "language", "content").where("language is not null").dropDuplicates(["file_id", "language", "content"]))
    return s.groupBy("language").agg(F.count("*").alias("n_symbols"), F.count_distinct("symbol").alias("n_names"))


@query(query.sql["B14_symbols"].replace("SELECT DISTINCT file_id, language, content", """SELECT DISTINCT file_id, coalesce(nullif(language, ''), CASE lower(regexp_extract(name, '\\.([^.]*)$', 1)) WHEN 'py' THEN 'Python' WHEN 'pyi' THEN 'Python' WHEN 'go' THEN 'Go' WHEN 'java' THEN 'Java'
 WHEN 'js' THEN 'JavaScript' WHEN 'mjs' THEN 'JavaScript' WHEN 'cjs' THEN 'JavaScript' WHEN 'jsx' THEN 'JavaScript' WHEN 'ts' THEN 'TypeScript' WHEN 'tsx' THEN 'TypeScript' WHEN 'mts' THEN 'TypeScript' WHEN 'cts' THEN 'TypeScript' END) AS language, content"""))
def B14_symbols_all(spark: SparkSession, d: str) -> DataFrame:
    """The same in all files; a language that is not recorded is the one that the name stands for."""
    from claimweave.sources.extract import file_language, symbols

    f = table(spark, d, "files", "file_id", "repo_id", "path", "name", "language", "content").withColumn("language", file_language())
    s = symbols(f.dropDuplicates(["file_id", "language", "content"]))
    return s.groupBy("language").agg(F.count("*").alias("n_symbols"), F.count_distinct("symbol").alias("n_names"))


@query("""WITH r AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '(?:GET|POST|PUT|PATCH|DELETE):/[\\w/{}.-]+')) AS route FROM documents WHERE text IS NOT NULL)
 SELECT split_part(route, ':', 1) AS method, regexp_replace(split_part(route, ':', 2), '\\{[^}]*\\}', '{}', 'g') AS template, count(*) AS n_docs FROM r GROUP BY ALL""")
def B8_routes_in_documents(spark: SparkSession, d: str) -> DataFrame:
    """Routes that documents cite, with canonical templates."""
    r = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?:GET|POST|PUT|PATCH|DELETE):/[\w/{}.-]+"), F.lit(0))).alias("route")).distinct()
    at = lambda k: F.split_part("route", F.lit(":"), F.lit(k))
    return r.groupBy(at(1).alias("method"), keys.positional(at(2)).alias("template")).agg(F.count("*").alias("n_docs"))


@query("""WITH v AS (SELECT DISTINCT resource_id, unnest(containers) AS c FROM k8s_resources WHERE containers IS NOT NULL), x AS (SELECT resource_id, unnest(c.env) AS e FROM v WHERE c IS NOT NULL)
 SELECT CASE WHEN regexp_matches(trim(e.value), '^lb://') THEN 'load_balanced' WHEN regexp_matches(trim(e.value), '^wss?://') THEN 'websocket' WHEN regexp_matches(trim(e.value), '^https?://') THEN 'absolute'
 WHEN regexp_matches(trim(e.value), '^\\$\\{') THEN 'variable' WHEN trim(e.value) LIKE '/%' THEN 'relative' ELSE 'opaque' END AS kind, count(*) AS n FROM x WHERE e.value IS NOT NULL GROUP BY kind""")
def B4_url_classes(spark: SparkSession, d: str) -> DataFrame:
    """What env values are as targets of calls."""
    c = once(table(spark, d, "k8s_resources"), "resource_id").select(F.explode("containers").alias("c")).where("c is not null")
    v = c.select(F.explode("c.env").alias("e")).where("e is not null").select(F.col("e.value").alias("value")).where("value is not null")
    return v.groupBy(keys.url_class(F.col("value"))["kind"].alias("kind")).agg(F.count("*").alias("n"))


@query("""SELECT repo_id, name, dep, count(*) AS n FROM (SELECT DISTINCT docker_id, repo_id, name, unnest(depends_on) AS dep FROM docker_resources) WHERE trim(coalesce(dep, '')) <> '' GROUP BY ALL""")
def B26_compose_dependencies(spark: SparkSession, d: str) -> DataFrame:
    x = once(table(spark, d, "docker_resources"), "docker_id").select("docker_id", "repo_id", "name", F.explode("depends_on").alias("dep")).where("trim(dep) <> ''").distinct()
    return x.groupBy("repo_id", "name", "dep").agg(F.count("*").alias("n"))


@query("""SELECT repo_id, count(*) AS n_images FROM (SELECT DISTINCT repo_id, lower(regexp_replace(regexp_replace(trim(image), '@sha256:[0-9a-fA-F]+$', ''), ':[^:/]*$', '')) AS image FROM docker_resources WHERE trim(coalesce(image, '')) <> '') GROUP BY repo_id""")
def C8_image_keys(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "docker_resources", "repo_id", "image").where("trim(image) <> ''").select("repo_id", keys.image_key(F.col("image")).alias("image")).distinct()
    return x.groupBy("repo_id").agg(F.count("*").alias("n_images"))


@query("""SELECT CASE WHEN is_test THEN 'test' WHEN regexp_matches(lower(path), '(^|/)(test|tests|spec|__tests__)/') OR regexp_matches(lower(name), '(_test|\\.spec|\\.test)\\.[^.]+$|^test_') THEN 'test_by_name'
 WHEN regexp_matches(lower(path), '(^|/)(vendor|third_party|node_modules|godeps|site-packages)/') THEN 'vendored' ELSE 'source' END AS class, count(DISTINCT file_id) AS n FROM files GROUP BY class""")
def B36_file_classes(spark: SparkSession, d: str) -> DataFrame:
    """Test, vendored and other files by path and name."""
    from claimweave.sources.extract import file_class

    return table(spark, d, "files", "file_id", "path", "name", "is_test").groupBy(file_class().alias("class")).agg(F.count_distinct("file_id").alias("n"))


# Keys


@query("""WITH x AS (SELECT DISTINCT edge_id, unnest(evidence) AS ev FROM edges)
 SELECT regexp_extract(ev, '\\.([A-Za-z]+):', 1) AS ext, count(*) AS n, count(DISTINCT regexp_replace(ev, ':[^:]*$', '')) AS n_paths, CAST(sum(CAST(nullif(regexp_extract(ev, '^(.*):(\\d+)(-\\d+)?$', 2), '') AS BIGINT)) AS BIGINT) AS line_sum
 FROM x WHERE ev IS NOT NULL GROUP BY ext""")
def C13_evidence_spans(spark: SparkSession, d: str) -> DataFrame:
    """Paths and lines of cited evidence."""
    x = table(spark, d, "edges", "edge_id", "evidence").select("edge_id", F.explode("evidence").alias("ev")).where("ev is not null").distinct()
    s = x.select(F.regexp_extract("ev", r"\.([A-Za-z]+):", 1).alias("ext"), keys.evidence_path(F.col("ev")).alias("p"), keys.evidence_span(F.col("ev")).alias("s"))
    return s.groupBy("ext").agg(F.count("*").alias("n"), F.count_distinct("p").alias("n_paths"), F.sum("s.first").alias("line_sum"))


@query("""WITH p AS (SELECT DISTINCT repo_id, path, str_split(path, '/') AS s FROM files WHERE path IS NOT NULL),
 m AS (SELECT repo_id, CASE WHEN len(s) < 2 THEN '' WHEN s[1] IN ('projects', 'services', 'apps', 'packages', 'modules', 'libs', 'components', 'cmd', 'src') THEN CASE WHEN len(s) > 2 THEN s[1] || '/' || s[2] ELSE s[1] END
 WHEN s[1] IN ('deploy', 'deployment', 'deployments', 'docker', 'dockerfiles', 'k8s', 'kubernetes', 'kube', 'manifests', 'manifest', 'chart', 'charts', 'helm', 'helmfile', 'kustomize', 'overlays', 'infra', 'infrastructure', 'terraform', 'tf', 'ansible', 'ops', 'argocd', 'flux', 'skaffold', 'compose', 'ci', 'build', 'scripts', 'config', 'configs', 'etc', 'env', 'environments', '.github', '.gitlab', '.circleci') THEN '' ELSE s[1] END AS module FROM p)
 SELECT repo_id, module, count(*) AS n FROM m GROUP BY ALL""")
def C14_modules(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "files", "repo_id", "path").where("path is not null").distinct()
    return p.groupBy("repo_id", keys.module_of(F.col("path")).alias("module")).agg(F.count("*").alias("n"))


@query("""SELECT split_part(repo_id, '_', 1) AS owner, coalesce(nullif(split_part(split_part(repo_id, '_', 2), '-', 1), ''), '(unnamed)') AS domain, count(DISTINCT repo_id) AS n_repos FROM nodes GROUP BY ALL""")
def C15_domains(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "nodes", "repo_id").distinct()
    part = lambda k: F.split_part("repo_id", F.lit("_"), F.lit(k))
    return r.groupBy(part(1).alias("owner"), keys.domain_of(part(2)).alias("domain")).agg(F.count("*").alias("n_repos"))


@query("""SELECT DISTINCT repo_id || ':' || type || ':' || substr(sha256(repo_id || ':' || type || ':' || coalesce(path, '') || ':' || coalesce(name, '') || ':'), 1, 16) AS node_key FROM nodes""")
def C10_node_ids(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nodes", "repo_id", "type", "path", "name")
    return n.select(keys.node_id(F.col("repo_id"), F.col("type"), F.col("path"), F.col("name")).alias("node_key")).distinct()


@query("""WITH v AS (SELECT DISTINCT resource_id, unnest(containers) AS c FROM k8s_resources WHERE containers IS NOT NULL), x AS (SELECT unnest(c.env) AS e FROM v WHERE c IS NOT NULL),
 h AS (SELECT regexp_extract(e.value, '^https?://([^/:?#@]+)', 1) AS host FROM x WHERE regexp_matches(e.value, '^https?://[^@]*$'))
 SELECT lower(split_part(regexp_replace(host, '\\.svc(\\.cluster\\.local)?$', ''), '.', 1)) AS service, count(*) AS n FROM h GROUP BY service""")
def C17_called_hosts(spark: SparkSession, d: str) -> DataFrame:
    c = once(table(spark, d, "k8s_resources"), "resource_id").select(F.explode("containers").alias("c")).where("c is not null")
    v = c.select(F.explode("c.env").alias("e")).where("e is not null").select(F.col("e.value").alias("v")).where(F.col("v").rlike("^https?://[^@]*$"))
    return v.groupBy(keys.bare_host(F.regexp_extract("v", r"^https?://([^/:?#@]+)", 1)).alias("service")).agg(F.count("*").alias("n"))


# Filters


@query(f"WITH {E} SELECT type, count(*) AS n FROM e WHERE status = 'active' AND type IN ({DEP}) AND confidence >= 0.6 GROUP BY type")
def D4_dependence_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.at_least(graph.dependence(graph.active(edges(spark, d))), 0.6).groupBy("type").agg(F.count("*").alias("n"))


@query(f"""WITH {E}, m AS (SELECT source_id, count(DISTINCT target_id) AS n_contracts FROM e WHERE status = 'active' GROUP BY source_id)
 SELECT source_id AS call, n_contracts, CASE WHEN n_contracts > 4 THEN 'declined' ELSE 'matched' END AS outcome FROM m""")
def D10_fanout_guard(spark: SparkSession, d: str) -> DataFrame:
    e = graph.active(edges(spark, d)).select(F.col("source_id").alias("call"), F.col("target_id").alias("contract"))
    return graph.fanout_guard(e, "call", "contract", 4)


@query(query.sql["D10_fanout_guard"].replace("n_contracts > 4 ", "n_contracts > 32 "))
def D10_fanout_guard_cap32(spark: SparkSession, d: str) -> DataFrame:
    """The same under the operator's own cap."""
    e = graph.active(edges(spark, d)).select(F.col("source_id").alias("call"), F.col("target_id").alias("contract"))
    return graph.fanout_guard(e, "call", "contract")


@query("""WITH p AS (SELECT key, count(DISTINCT repo_id) AS n, min(repo_id) AS r FROM (SELECT DISTINCT lower(trim(name)) AS key, repo_id FROM docker_resources WHERE trim(coalesce(name, '')) <> '') GROUP BY key)
 SELECT key, CASE WHEN n = 1 THEN r END AS target, n AS n_targets, CASE WHEN n = 1 THEN 'matched' ELSE 'declined' END AS outcome FROM p""")
def D11_ambiguity_guard(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "docker_resources", "name", "repo_id").where("trim(name) <> ''").select(F.lower(F.trim("name")).alias("key"), "repo_id").distinct()
    return graph.ambiguity_guard(x, ["key"], "repo_id")


@query(f"""WITH {E} SELECT CASE WHEN confidence < 0.6 AND status = 'active' THEN 'candidate' ELSE status END AS status, count(*) AS n FROM e GROUP BY 1""")
def D12_confidence_floor(spark: SparkSession, d: str) -> DataFrame:
    return graph.with_floor(edges(spark, d)).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""WITH {E}, d AS (SELECT source_id, type, target_id, CASE WHEN max(confidence) >= 0.9 THEN 'promote' ELSE 'reject' END AS decision FROM e WHERE status = 'candidate' GROUP BY ALL)
 SELECT CASE WHEN decision = 'reject' THEN 'rejected' WHEN decision = 'promote' AND status = 'candidate' THEN 'active' ELSE status END AS status, count(*) AS n FROM e LEFT JOIN d USING (source_id, type, target_id) GROUP BY 1""")
def D13_decision_replay(spark: SparkSession, d: str) -> DataFrame:
    """Decisions on candidates (here by their confidence) replayed over all edges."""
    e = edges(spark, d)
    key = ["source_id", "type", "target_id"]
    dec = e.where("status = 'candidate'").groupBy(*key).agg(F.when(F.max("confidence") >= 0.9, "promote").otherwise("reject").alias("decision"))
    return graph.replay_decisions(e, dec).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""WITH {E}, k AS (SELECT target_id AS key, count(*) AS n FROM e GROUP BY 1) SELECT key, n FROM k WHERE n > greatest(1, (SELECT count(*) FROM e) // 400)""")
def D14_hot_keys(spark: SparkSession, d: str) -> DataFrame:
    return graph.hot_keys(edges(spark, d), "target_id", 400)


@query("""SELECT DISTINCT id, name, type, CAST(tier AS INT) AS tier, round(1 - tier / 6.0, 4) AS score FROM (SELECT id, name, type, CASE WHEN coalesce(name, '') = 'edge' THEN 0 WHEN lower(coalesce(name, '')) = 'edge' THEN 1
 WHEN lower(coalesce(name, '')) LIKE 'edge%' THEN 2 WHEN contains(lower(coalesce(name, '')), 'edge') OR contains(lower(coalesce(label, '')), 'edge') THEN 3 WHEN contains(lower(coalesce(path, '')), 'edge') THEN 4
 WHEN contains(lower(id), 'edge') THEN 5 END AS tier FROM nodes) WHERE tier IS NOT NULL""")
def D16_search_predicate(spark: SparkSession, d: str) -> DataFrame:
    return graph.search(nodes(spark, d), "edge").distinct()


# Claims and joins


DOCKER_CLAIMS = """x AS (SELECT DISTINCT docker_id, repo_id, name, image, depends_on, file_path || ':' || line AS evidence FROM docker_resources),
 c AS (SELECT repo_id, 'svcname' AS kind, 'provides' AS direction, lower(trim(name)) AS key, '' AS subject, evidence FROM x WHERE trim(coalesce(name, '')) <> ''
 UNION ALL SELECT repo_id, 'image', 'consumes', lower(regexp_replace(regexp_replace(trim(image), '@sha256:[0-9a-fA-F]+$', ''), ':[^:/]*$', '')), coalesce(name, ''), evidence FROM x WHERE trim(coalesce(image, '')) <> ''
 UNION ALL SELECT repo_id, 'svcname', 'consumes', lower(trim(dep)), coalesce(name, ''), evidence FROM (SELECT *, unnest(depends_on) AS dep FROM x) WHERE trim(coalesce(dep, '')) <> ''),
 claims AS (SELECT repo_id, kind, direction, key, subject, regexp_replace(evidence, ':[^:]*$', '') AS path, min(evidence) AS evidence FROM c WHERE trim(key) <> '' AND NOT regexp_matches(key, '\\$\\{|\\{\\{') GROUP BY ALL)"""


def docker(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "docker_resources"), "docker_id")


@query(f"WITH {DOCKER_CLAIMS} SELECT kind, direction, key, count(*) AS n, count(DISTINCT repo_id) AS n_repos FROM claims GROUP BY ALL")
def B38_compose_claims(spark: SparkSession, d: str) -> DataFrame:
    c = resolve.docker_claims(docker(spark, d))
    return c.groupBy("kind", "direction", "key").agg(F.count("*").alias("n"), F.count_distinct("repo_id").alias("n_repos"))


@query(f"""WITH {DOCKER_CLAIMS}, p AS (SELECT key, count(DISTINCT repo_id) AS n, min(repo_id) AS r FROM claims WHERE kind = 'svcname' AND direction = 'provides' GROUP BY key),
 u AS (SELECT repo_id, key, count(*) AS weight FROM claims WHERE kind = 'svcname' AND direction = 'consumes' GROUP BY ALL)
 SELECT u.repo_id AS source_id, u.key AS claim_key, CASE WHEN n = 1 THEN r END AS target_id, weight, CASE WHEN n IS NULL THEN 'unmatched' WHEN n > 1 THEN 'ambiguous' ELSE 'matched' END AS outcome FROM u LEFT JOIN p ON u.key = p.key""")
def E17_compose_topology(spark: SparkSession, d: str) -> DataFrame:
    r = resolve.join_claims(resolve.docker_claims(docker(spark, d)), "svcname", "CALLS_SERVICE", 0.96)
    return r.select("source_id", "claim_key", "target_id", "weight", "outcome")


@query(f"""WITH {DOCKER_CLAIMS}, p AS (SELECT key, count(DISTINCT repo_id) AS n FROM claims WHERE kind = 'svcname' AND direction = 'provides' GROUP BY key),
 u AS (SELECT DISTINCT repo_id, key FROM claims WHERE kind = 'svcname' AND direction = 'consumes')
 SELECT 'r1.' || CASE WHEN n IS NULL THEN 'unmatched' WHEN n > 1 THEN 'ambiguous' ELSE 'matched' END AS counter, count(*) AS n FROM u LEFT JOIN p ON u.key = p.key GROUP BY 1""")
def F8_decline_counters(spark: SparkSession, d: str) -> DataFrame:
    return resolve.declines(resolve.join_claims(resolve.docker_claims(docker(spark, d)), "svcname", "CALLS_SERVICE", 0.96), "r1")


@query(f"""WITH {DOCKER_CLAIMS} SELECT key AS name, count(DISTINCT repo_id) AS n_repos, min(repo_id) AS first_repo, CAST(key IN ('app', 'api', 'server', 'service', 'web', 'main', 'backend', 'frontend', 'worker', 'gateway') AS BIGINT) AS is_generic
 FROM claims WHERE kind = 'svcname' AND direction = 'provides' GROUP BY key""")
def E10_service_names(spark: SparkSession, d: str) -> DataFrame:
    return resolve.mint_services(resolve.docker_claims(docker(spark, d)))


@query("""WITH n AS (SELECT DISTINCT lower(trim(name)) AS n, lower(coalesce(nullif(trim(namespace), ''), 'default')) AS ns FROM k8s_resources WHERE trim(coalesce(name, '')) <> '')
 SELECT DISTINCT unnest([n, n || '.' || ns, n || '.' || ns || '.svc', n || '.' || ns || '.svc.cluster.local']) AS alias, n AS canonical FROM n""")
def E6_dns_aliases(spark: SparkSession, d: str) -> DataFrame:
    return resolve.dns_aliases(table(spark, d, "k8s_resources", "name", "namespace"))


@query("""WITH r AS (SELECT DISTINCT resource_id, coalesce(nullif(trim(namespace), ''), 'default') AS ns, labels, kind FROM k8s_resources WHERE labels IS NOT NULL AND cardinality(labels) > 0),
 s AS (SELECT resource_id AS sel_id, ns, unnest(map_entries(labels)) AS l, cardinality(labels) AS n FROM r WHERE kind = 'Ingress'),
 w AS (SELECT DISTINCT resource_id AS workload_id, ns, unnest(map_entries(labels)) AS l FROM r WHERE kind <> 'Ingress')
 SELECT sel_id, workload_id FROM (SELECT sel_id, workload_id, n, count(*) AS m FROM s JOIN w ON s.ns = w.ns AND s.l.key = w.l.key AND s.l.value = w.l.value GROUP BY ALL) WHERE m = n""")
def E5_selector_members(spark: SparkSession, d: str) -> DataFrame:
    """Label sets of ingresses as selectors over the other workloads of their namespace."""
    r = once(table(spark, d, "k8s_resources"), "resource_id").where("labels is not null and size(labels) > 0").withColumn("namespace", F.coalesce(F.nullif(F.trim("namespace"), F.lit("")), F.lit("default")))
    sel = r.where("kind = 'Ingress'").select(F.col("resource_id").alias("sel_id"), "namespace", F.col("labels").alias("selector"))
    return resolve.selector_members(sel, r.where("kind <> 'Ingress'").select(F.col("resource_id").alias("workload_id"), "namespace", "labels"))


@query("""SELECT lower(coalesce(nullif(trim(namespace), ''), 'default') || '/' || kind || '/' || trim(name)) AS unit, lower(trim(name)) AS service, count(DISTINCT resource_id) AS n_records FROM k8s_resources
 WHERE kind IN ('Deployment', 'StatefulSet', 'DaemonSet', 'CronJob', 'Job', 'ReplicaSet') AND trim(coalesce(name, '')) <> '' GROUP BY ALL""")
def E16_deployment_units(spark: SparkSession, d: str) -> DataFrame:
    return resolve.deployment_units(table(spark, d, "k8s_resources", "resource_id", "namespace", "kind", "name"))


@query(f"""WITH {E}, a AS (SELECT * FROM e WHERE status = 'active'), u AS (SELECT DISTINCT split_part(source_id, ':', 1) AS consumer, target_id FROM a WHERE type IN ('READS_FROM', 'CONSUMES_FROM', 'CALLS_SERVICE')),
 p AS (SELECT DISTINCT split_part(source_id, ':', 1) AS provider, target_id FROM a WHERE type IN ('EXPOSES', 'PUBLISHES_TO', 'WRITES_TO'))
 SELECT consumer, provider, count(DISTINCT target_id) AS n_contracts FROM u JOIN p USING (target_id) WHERE consumer <> provider GROUP BY ALL""")
def E44_code_bridges(spark: SparkSession, d: str) -> DataFrame:
    return graph.bridges(edges(spark, d))


@query(f"""WITH {E} SELECT DISTINCT target_id FROM e WHERE status = 'active' AND type = 'EXPOSES' AND target_id NOT IN (SELECT target_id FROM e WHERE status = 'active' AND type IN ('INVOKES', 'CALLS', 'CALLS_SERVICE'))""")
def E45_dead_endpoints(spark: SparkSession, d: str) -> DataFrame:
    return graph.dead_endpoints(edges(spark, d))


@query("""WITH f AS (SELECT DISTINCT file_id AS item, repo_id, path FROM files WHERE path IS NOT NULL),
 o AS (SELECT DISTINCT repo_id, CASE WHEN contains(file_path, '/') THEN regexp_replace(file_path, '/[^/]*$', '') ELSE '' END AS prefix, name AS owner FROM docker_resources WHERE trim(coalesce(name, '')) <> ''),
 j AS (SELECT item, length(prefix) - length(replace(prefix, '/', '')) + CASE WHEN prefix = '' THEN 0 ELSE 1 END AS depth, owner FROM f JOIN o ON f.repo_id = o.repo_id AND (o.prefix = '' OR starts_with(f.path, o.prefix || '/'))),
 b AS (SELECT item, max(depth) AS depth FROM j GROUP BY item), g AS (SELECT j.item, count(DISTINCT owner) AS n, min(owner) AS owner FROM j JOIN b ON j.item = b.item AND j.depth = b.depth GROUP BY j.item)
 SELECT item, CASE WHEN n = 1 THEN owner END AS owner, CASE WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS outcome FROM g""")
def E3_module_scope(spark: SparkSession, d: str) -> DataFrame:
    """The compose service whose directory is the longest prefix of each file."""
    f = table(spark, d, "files", F.col("file_id").alias("item"), "repo_id", "path").where("path is not null").distinct()
    o = table(spark, d, "docker_resources", "repo_id", "file_path", "name").where("trim(name) <> ''")
    o = o.select("repo_id", F.when(F.col("file_path").contains("/"), F.regexp_replace("file_path", "/[^/]*$", "")).otherwise("").alias("prefix"), F.col("name").alias("owner")).distinct()
    return resolve.prefix_owner(f, o)


@query("""SELECT purl, count(DISTINCT repo_id) AS n_repos, count(DISTINCT version) AS n_versions FROM (
 SELECT repo_id, 'pkg:' || CASE lower(name) WHEN 'cargo.lock' THEN 'cargo' WHEN 'poetry.lock' THEN 'pypi' ELSE 'npm' END || '/' || CASE lower(name) WHEN 'poetry.lock' THEN replace(lower(regexp_extract(m, 'name = "([^"]+)"', 1)), '_', '-') ELSE regexp_extract(m, 'name = "([^"]+)"', 1) END AS purl,
 regexp_extract(m, 'version = "([^"]*)"', 1) AS version FROM (SELECT repo_id, name, unnest(regexp_extract_all(content, 'name = "[^"]+"\\s+version = "[^"]*"')) AS m FROM files WHERE lower(name) IN ('cargo.lock', 'poetry.lock', 'yarn.lock'))
 UNION ALL SELECT repo_id, 'pkg:npm/' || regexp_extract(m, 'node_modules/([^"]+)"', 1), regexp_extract(m, '"version":\\s*"([^"]*)"', 1) FROM (SELECT repo_id, unnest(regexp_extract_all(content, '"node_modules/([^"]+)":\\s*\\{\\s*"version":\\s*"([^"]*)"')) AS m FROM files WHERE lower(name) = 'package-lock.json')) GROUP BY purl""")
def E18_library_usage(spark: SparkSession, d: str) -> DataFrame:
    return resolve.library_usage(resolve.library_claims(table(spark, d, "files", "repo_id", "name", "content")))


@query(f"""WITH {E} SELECT target_id AS topic, count(DISTINCT CASE WHEN type = 'PUBLISHES_TO' THEN source_id END) AS n_publishers, count(DISTINCT CASE WHEN type = 'CONSUMES_FROM' THEN source_id END) AS n_consumers
 FROM e WHERE status = 'active' AND type IN ('PUBLISHES_TO', 'CONSUMES_FROM') GROUP BY target_id""")
def F12_topic_inventory(spark: SparkSession, d: str) -> DataFrame:
    return resolve.topic_inventory(edges(spark, d))


# Aggregations


@query(f"""WITH {E}, g AS (SELECT source_id, type, target_id, detected_by, max(confidence) AS c, count(*) AS n FROM e GROUP BY ALL),
 f AS (SELECT source_id, type, target_id, CAST(sum(n) AS BIGINT) AS n_rows, max(c) AS best, product(1 - c) AS miss, array_to_string(list_sort(list(DISTINCT detected_by) FILTER (detected_by <> '')), '+') AS detected_by FROM g GROUP BY ALL)
 SELECT source_id, type, target_id, n_rows, round(CASE WHEN n_rows = 1 THEN best ELSE least(0.99, 1 - miss) END, 6) AS confidence, coalesce(detected_by, '') AS detected_by FROM f""")
def F1_fuse_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.fuse(edges(spark, d)).withColumn("confidence", F.round("confidence", 6))


@query("""WITH x AS (SELECT DISTINCT trim(source_id) AS source_id, type, trim(target_id) AS target_id, unnest(evidence) AS ev FROM edges WHERE trim(coalesce(source_id, '')) <> '' AND trim(coalesce(target_id, '')) <> ''),
 g AS (SELECT source_id, type, target_id, list_sort(list(DISTINCT ev)) AS l FROM x WHERE ev IS NOT NULL GROUP BY ALL) SELECT source_id, type, target_id, array_to_string(list_slice(l, 1, 5), '|') AS evidence, CAST(len(l) AS BIGINT) AS n_evidence FROM g""")
def F2_merge_evidence(spark: SparkSession, d: str) -> DataFrame:
    return graph.evidence_of(edges(spark, d, "evidence"))


@query(f"""WITH {E}, x AS (SELECT split_part(source_id, ':', 1) AS source_repo, split_part(target_id, ':', 1) AS target_repo, type, confidence FROM e WHERE status = 'active')
 SELECT source_repo, target_repo, count(*) AS weight, array_to_string(list_sort(list(DISTINCT type)), ',') AS types, round(min(confidence), 4) AS min_confidence, round(max(confidence), 4) AS max_confidence FROM x WHERE source_repo <> target_repo GROUP BY ALL""")
def F4_repo_rollup(spark: SparkSession, d: str) -> DataFrame:
    return graph.repo_rollup(edges(spark, d))


@query(f"""WITH {E}, p AS (SELECT DISTINCT source_id, target_id FROM e WHERE status = 'active'), x AS (SELECT source_id AS node_id, 0 AS i, 1 AS o FROM p UNION ALL SELECT target_id, 1, 0 FROM p)
 SELECT node_id, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM x GROUP BY node_id""")
def F7_fan_in_out(spark: SparkSession, d: str) -> DataFrame:
    return graph.fan(edges(spark, d))


@query(f"""WITH {E}, x AS (SELECT split_part(source_id, '_', 1) AS src_group, split_part(target_id, '_', 1) AS dst_group, confidence FROM e WHERE status = 'active')
 SELECT src_group, dst_group, count(*) AS weight, CAST(src_group = dst_group AS BIGINT) AS internal, round(min(confidence), 4) AS min_confidence FROM x GROUP BY ALL""")
def F9_group_map(spark: SparkSession, d: str) -> DataFrame:
    return graph.group_map(edges(spark, d), F.substring_index("source_id", "_", 1), F.substring_index("target_id", "_", 1))


@query(f"WITH {E} SELECT type, status, count(*) AS count FROM e WHERE repo_id = 'quillfab_monolith' GROUP BY ALL")
def F11_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return graph.aggregate(edges(spark, d), ["type", "status"], {"repo_id": "quillfab_monolith"})


@query(f"""WITH {E}, x AS (SELECT repo_id, type FROM e UNION ALL SELECT repo_id, 'node:' || type FROM (SELECT DISTINCT id, repo_id, type FROM nodes)) SELECT repo_id, type, count(*) AS n FROM x GROUP BY ALL""")
def F14_graph_statistics(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nodes", "id", "repo_id", "type").distinct().select("repo_id", F.concat(F.lit("node:"), "type").alias("type"))
    return edges(spark, d).select("repo_id", "type").unionByName(n).groupBy("repo_id", "type").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT DISTINCT scan_id, repo_id, parse_failures, absence_complete, absence_reasons, capped, metadata_complete FROM scan_meta)
 SELECT repo_id, count(*) AS n_scans, CAST(sum(parse_failures) AS BIGINT) AS parse_failures, count(*) FILTER (cardinality(capped) > 0) AS n_capped, count(*) FILTER (NOT absence_complete) AS n_incomplete FROM s GROUP BY repo_id""")
def F25_scan_totals(spark: SparkSession, d: str) -> DataFrame:
    s = once(table(spark, d, "scan_meta"), "scan_id")
    when = lambda c: F.count(F.when(c, 1))
    return s.groupBy("repo_id").agg(F.count("*").alias("n_scans"), F.sum("parse_failures").alias("parse_failures"), when(F.size("capped") > 0).alias("n_capped"), when(~F.col("absence_complete")).alias("n_incomplete"))


@query("""WITH s AS (SELECT DISTINCT scan_id, repo_id, absence_reasons FROM scan_meta), x AS (SELECT repo_id, unnest(absence_reasons) AS reason FROM s) SELECT reason, count(*) AS n, count(DISTINCT repo_id) AS n_repos FROM x WHERE reason IS NOT NULL GROUP BY reason""")
def F16_absence_reasons(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "scan_meta", "scan_id", "repo_id", "absence_reasons").distinct()
    return s.select("repo_id", F.explode("absence_reasons").alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"), F.count_distinct("repo_id").alias("n_repos"))


@query(f"""WITH {E}, g AS (SELECT target_id, count(*) AS n FROM e GROUP BY 1) SELECT count(*) AS n_keys, CAST(sum(n) AS BIGINT) AS n_rows, max(n) AS largest, CAST(quantile_cont(n, 0.5) AS DOUBLE) AS median FROM g""")
def F24_skew_statistics(spark: SparkSession, d: str) -> DataFrame:
    return graph.skew_statistics(edges(spark, d), "target_id")


@query(f"""WITH {E}, g AS (SELECT DISTINCT detected_by, type, status, edge_id FROM e)
 SELECT coalesce(detected_by, '(all)') AS detected_by, coalesce(type, '(all)') AS type, count(*) FILTER (status = 'active') AS tp, count(*) AS n,
 round(greatest(0.0, ((tp / n + 1.959963984540054 * 1.959963984540054 / (2 * n)) - 1.959963984540054 * sqrt(tp / n * (1 - tp / n) / n + 1.959963984540054 * 1.959963984540054 / (4.0 * n * n)) * 1.0) / (1 + 1.959963984540054 * 1.959963984540054 / n)), 4) AS lo
 FROM g GROUP BY GROUPING SETS ((detected_by, type), (detected_by), ())""".replace("(tp / n", "(CAST(tp AS DOUBLE) / n"))
def F18_label_pooling(spark: SparkSession, d: str) -> DataFrame:
    """Active edges as confirmed labels, pooled per detector and type, per detector and overall, with the Wilson bound."""
    e = edges(spark, d).select("detected_by", "type", F.when(F.col("status") == "active", 1).otherwise(0).alias("ok"))
    g = e.groupingSets([[F.col("detected_by"), F.col("type")], [F.col("detected_by")], []], "detected_by", "type").agg(F.sum("ok").alias("tp"), F.count("*").alias("n"))
    return g.select(F.coalesce("detected_by", F.lit("(all)")).alias("detected_by"), F.coalesce("type", F.lit("(all)")).alias("type"), "tp", "n", scalars.wilson(F.col("tp"), F.col("n"))["lo"].alias("lo"))


# Orders and windows


@query("""SELECT DISTINCT id, type, repo_id, CAST(row_number() OVER (PARTITION BY repo_id, name, type ORDER BY coalesce(start_line, -1), id) - 1 AS BIGINT) AS occurrence FROM (SELECT DISTINCT id, type, repo_id, name, start_line FROM nodes WHERE deleted_at IS NULL)""")
def G5_occurrence_index(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nodes", "id", "type", "repo_id", "name", "start_line", "deleted_at").where("deleted_at is null").drop("deleted_at").distinct()
    return graph.occurrence(n, ["repo_id", "name", "type"], F.coalesce("start_line", F.lit(-1)), F.col("id")).select("id", "type", "repo_id", "occurrence").distinct()


SERIES = """v AS (SELECT DISTINCT artifact_id, repo_id, head_sha, commit_idx, delivered_at, edges FROM artifacts WHERE edges IS NOT NULL AND trim(coalesce(head_sha, '')) <> ''),
 l AS (SELECT *, row_number() OVER (PARTITION BY repo_id, head_sha ORDER BY delivered_at DESC, artifact_id DESC) AS rn FROM v),
 s AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY commit_idx, head_sha) AS seq FROM l WHERE rn = 1),
 r AS (SELECT DISTINCT repo_id, seq, x.source_id AS source_id, x.type AS type, x.target_id AS target_id FROM (SELECT repo_id, seq, unnest(edges) AS x FROM s))"""


@query(f"""WITH {SERIES}, i AS (SELECT *, seq - row_number() OVER (PARTITION BY repo_id, source_id, type, target_id ORDER BY seq) AS island FROM r)
 SELECT repo_id, source_id, type, target_id, min(seq) AS first, max(seq) AS last, count(*) AS n FROM i GROUP BY repo_id, source_id, type, target_id, island""")
def G6_validity_intervals(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "artifacts")
    rows = snap.snapshot_rows(a, snap.snapshot_series(a))
    out = temporal.intervals(rows, ["repo_id"], ["source_id", "type", "target_id"], "seq")
    return out.select("repo_id", "source_id", "type", "target_id", F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last"), "n")


@query(f"""WITH {SERIES} SELECT repo_id, seq, count(DISTINCT source_id) AS n_consumers, count(*) AS n_edges FROM r WHERE type IN ({DEP}) GROUP BY ALL""")
def G7_consumers_over_time(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "artifacts")
    rows = snap.snapshot_rows(a, snap.snapshot_series(a)).select("repo_id", "seq", "source_id", "type", "target_id").distinct()
    return graph.dependence(rows).groupBy("repo_id", F.col("seq").cast("bigint").alias("seq")).agg(F.count_distinct("source_id").alias("n_consumers"), F.count("*").alias("n_edges"))


@query(f"""WITH {E}, b AS (SELECT *, row_number() OVER (PARTITION BY source_id, type ORDER BY confidence DESC, target_id, edge_id) AS rn FROM e WHERE status = 'active') SELECT source_id, type, target_id, round(confidence, 6) AS confidence FROM b WHERE rn = 1""")
def G3_best_per_group(spark: SparkSession, d: str) -> DataFrame:
    b = graph.first_of(graph.active(edges(spark, d)), ["source_id", "type"], F.col("confidence").desc(), F.col("target_id"), F.col("edge_id"))
    return b.select("source_id", "type", "target_id", F.round("confidence", 6).alias("confidence"))


# Sets and differences


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = graph.clean_edges(table(spark, d, "edges", "edge_id", "source_id", "target_id", "type", "confidence", "status", "loaded_at")).join(table(spark, d, "edges", "edge_id", "loaded_at").distinct(), "edge_id")
    half = F.to_timestamp_ntz(F.lit("2025-07-01 00:00:00"))
    a = graph.active(e)
    return a.where(F.col("loaded_at") < half), a.where(F.col("loaded_at") >= half)


@query(f"""WITH {E}, a AS (SELECT source_id, type, target_id, max(confidence) AS c FROM e WHERE status = 'active' AND loaded_at < TIMESTAMP '2025-07-01' GROUP BY ALL),
 b AS (SELECT source_id, type, target_id, max(confidence) AS c FROM e WHERE status = 'active' AND loaded_at >= TIMESTAMP '2025-07-01' GROUP BY ALL)
 SELECT coalesce(a.source_id, b.source_id) AS source_id, coalesce(a.type, b.type) AS type, coalesce(a.target_id, b.target_id) AS target_id,
 CASE WHEN a.source_id IS NULL THEN 'added' WHEN b.source_id IS NULL THEN 'removed' WHEN a.c = b.c THEN 'kept' ELSE 'changed' END AS change_kind FROM a FULL JOIN b ON a.source_id = b.source_id AND a.type = b.type AND a.target_id = b.target_id""")
def H1_changed_between(spark: SparkSession, d: str) -> DataFrame:
    a, b = _halves(spark, d)
    return temporal.changed_between(a, b, ["source_id", "type", "target_id"], ["confidence"])


@query(f"""WITH {E}, b AS (SELECT DISTINCT target_id AS key FROM e WHERE status = 'active' AND type = 'EXPOSES' AND loaded_at < TIMESTAMP '2025-07-01'), h AS (SELECT DISTINCT target_id AS key FROM e WHERE status = 'active' AND type = 'EXPOSES' AND loaded_at >= TIMESTAMP '2025-07-01'),
 c AS (SELECT target_id AS key, count(DISTINCT source_id) AS n FROM e WHERE status = 'active' AND type = 'CALLS_SERVICE' AND loaded_at >= TIMESTAMP '2025-07-01' GROUP BY 1)
 SELECT coalesce(b.key, h.key) AS key, CASE WHEN h.key IS NULL AND coalesce(n, 0) > 0 THEN 'drifted' WHEN h.key IS NULL THEN 'removed' WHEN b.key IS NULL THEN 'added' ELSE 'kept' END AS drift, coalesce(n, 0) AS n_callers
 FROM b FULL JOIN h ON b.key = h.key LEFT JOIN c ON c.key = coalesce(b.key, h.key)""")
def H5_contract_drift(spark: SparkSession, d: str) -> DataFrame:
    a, b = _halves(spark, d)
    ex = lambda df: df.where("type = 'EXPOSES'").select(F.col("target_id").alias("key"))
    calls = b.where("type = 'CALLS_SERVICE'").select(F.col("target_id").alias("key"), F.col("source_id").alias("caller"))
    return temporal.drift(ex(a), ex(b), calls)


@query(f"""WITH {DOCKER_CLAIMS}, d AS (SELECT DISTINCT key FROM claims WHERE kind = 'svcname' AND direction = 'provides'), o AS (SELECT DISTINCT key FROM claims WHERE kind = 'svcname' AND direction = 'consumes')
 SELECT coalesce(d.key, o.key) AS key, CASE WHEN o.key IS NULL THEN 'declared_only' WHEN d.key IS NULL THEN 'observed_only' ELSE 'matched' END AS bucket FROM d FULL JOIN o ON d.key = o.key""")
def H6_reconcile(spark: SparkSession, d: str) -> DataFrame:
    c = resolve.docker_claims(docker(spark, d)).where("kind = 'svcname'")
    return temporal.reconcile(c.where("direction = 'provides'"), c.where("direction = 'consumes'"))


# Traversal


@query(f"""WITH RECURSIVE {E}, s AS (SELECT DISTINCT source_id AS a, target_id AS b FROM e WHERE status = 'active' AND source_id <> target_id),
 starts AS (SELECT DISTINCT id AS a FROM nodes WHERE type = 'Repo'),
 p AS (SELECT [a] AS path, a AS cur, 0 AS hops FROM starts UNION ALL SELECT list_append(path, s.b), s.b, hops + 1 FROM p JOIN s ON p.cur = s.a WHERE hops < 3 AND NOT list_contains(path, s.b))
 SELECT path[1] AS start, cur AS node_id, CAST(hops AS BIGINT) AS hops, count(*) AS n_paths FROM p WHERE hops > 0 GROUP BY ALL""")
def I1_find_paths(spark: SparkSession, d: str) -> DataFrame:
    """Simple paths of up to three steps from every repository node."""
    starts = table(spark, d, "nodes", "id", "type").where("type = 'Repo'").select(F.col("id").alias("a")).distinct()
    p = traverse.paths(traverse.steps(edges(spark, d)), starts, 3)
    return p.groupBy(F.col("path")[0].alias("start"), "node_id", "hops").agg(F.count("*").alias("n_paths"))


@query(f"""WITH RECURSIVE {E}, s AS (SELECT DISTINCT source_id AS a, target_id AS b FROM e WHERE status = 'active' AND source_id <> target_id UNION SELECT DISTINCT target_id, source_id FROM e WHERE status = 'active' AND source_id <> target_id),
 r AS (SELECT DISTINCT id AS start, id AS node_id, 0 AS k FROM nodes WHERE type = 'Repo' UNION SELECT r.start, s.b, k + 1 FROM r JOIN s ON r.node_id = s.a WHERE k < 2)
 SELECT start, node_id, CAST(min(k) AS BIGINT) AS distance FROM r GROUP BY start, node_id""")
def I2_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    starts = table(spark, d, "nodes", "id", "type").where("type = 'Repo'").select(F.col("id").alias("a")).distinct()
    return traverse.neighbourhood(traverse.steps(edges(spark, d), "both"), starts, 2)


@query(f"""WITH {E}, s AS (SELECT target_id AS n, source_id AS b, max(confidence) AS c FROM e WHERE status = 'active' AND type IN ({DEP}) AND source_id <> target_id GROUP BY ALL),
 st AS (SELECT DISTINCT id AS start FROM nodes WHERE type = 'File'), l1 AS (SELECT start, b AS node_id, max(c) AS p FROM st JOIN s ON st.start = s.n WHERE b <> start GROUP BY ALL),
 g2 AS (SELECT l1.start, s.b AS node_id, max(p * c) AS p FROM l1 JOIN s ON l1.node_id = s.n GROUP BY ALL), l2 AS (SELECT * FROM g2 WHERE node_id <> start AND NOT EXISTS (SELECT 1 FROM l1 WHERE l1.start = g2.start AND l1.node_id = g2.node_id))
 SELECT start, node_id, CAST(1 AS BIGINT) AS distance, round(p, 6) AS compounded FROM l1 UNION ALL SELECT start, node_id, 2, round(p, 6) FROM l2""")
def I3_transitive_impact(spark: SparkSession, d: str) -> DataFrame:
    starts = table(spark, d, "nodes", "id", "type").where("type = 'File'").select(F.col("id").alias("a")).distinct()
    return traverse.impact(edges(spark, d), starts, 2).withColumn("compounded", F.round("compounded", 6))


@query(f"WITH {E} SELECT DISTINCT target_id, source_id AS consumer, type FROM e WHERE status = 'active' AND type IN ({DEP})")
def I4_consumers_of(spark: SparkSession, d: str) -> DataFrame:
    return traverse.consumers(edges(spark, d))


@query(f"""WITH {E}, s AS (SELECT DISTINCT CASE WHEN type IN ('CONSUMES_FROM', 'READS_FROM') THEN target_id ELSE source_id END AS a, CASE WHEN type IN ('CONSUMES_FROM', 'READS_FROM') THEN source_id ELSE target_id END AS b FROM e WHERE status = 'active'),
 x AS (SELECT * FROM s WHERE a <> b) SELECT split_part(p.a, ':', 1) AS from_repo, split_part(q.b, ':', 1) AS to_repo, count(*) AS n FROM x p JOIN x q ON p.b = q.a WHERE p.a <> q.b GROUP BY ALL""")
def I8_flow_trace(spark: SparkSession, d: str) -> DataFrame:
    """Two-step flows between repositories, reading edges walked against their direction."""
    s = traverse.flow_steps(edges(spark, d))
    two = s.alias("p").join(s.alias("q"), F.col("p.b") == F.col("q.a")).where("p.a <> q.b")
    return two.groupBy(graph.repo_of(F.col("p.a")).alias("from_repo"), graph.repo_of(F.col("q.b")).alias("to_repo")).agg(F.count("*").alias("n"))


@query(f"""WITH {E}, n AS (SELECT DISTINCT id FROM nodes WHERE contains(lower(coalesce(name, '')), 'edge') OR contains(lower(coalesce(label, '')), 'edge')) SELECT type, count(*) AS n FROM e WHERE status = 'active' AND source_id IN (SELECT id FROM n) AND target_id IN (SELECT id FROM n) GROUP BY type""")
def I11_search_subgraph(spark: SparkSession, d: str) -> DataFrame:
    hit = graph.search(nodes(spark, d), "edge").where("tier <= 3").select(F.col("id").alias("node_id"))
    return traverse.induced(edges(spark, d), hit).groupBy("type").agg(F.count("*").alias("n"))


@query(f"""WITH {E}, l AS (SELECT DISTINCT split_part(source_id, ':', 1) AS a, split_part(target_id, ':', 1) AS b FROM e WHERE status = 'active' AND type = 'OWNED_BY')
 SELECT count(DISTINCT x) AS n_nodes FROM (SELECT a AS x FROM l UNION ALL SELECT b FROM l)""")
def I12_component_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Repositories that ownership edges connect, counted over their components."""
    l = graph.active(edges(spark, d)).where("type = 'OWNED_BY'").select(graph.repo_of(F.col("source_id")).alias("a"), graph.repo_of(F.col("target_id")).alias("b"))
    return traverse.components(l).agg(F.count_distinct("node").alias("n_nodes"))


@query()
def I12_components(spark: SparkSession, d: str) -> DataFrame:
    l = graph.active(edges(spark, d)).where("type = 'OWNED_BY'").select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    return traverse.components(l)


# Scalars


@query("""SELECT name, vclass AS value_class, count(*) AS n FROM (SELECT docker_id, e.key AS name, CASE WHEN v IS NULL OR v = '' THEN 'opaque'
 WHEN regexp_matches(upper(e.key), 'SECRET|TOKEN|PASSWORD|PASSWD|API_KEY|APIKEY|PRIVATE|CREDENTIAL|AUTH') THEN 'secret' WHEN regexp_matches(v, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN 'url'
 WHEN length(v) >= 20 AND NOT contains(v, ' ') AND list_entropy >= 4.0 THEN 'secret'
 WHEN lower(v) IN ('true', 'false', 'yes', 'no', 'on', 'off') THEN 'boolean' WHEN regexp_matches(v, '^-?\\d+(\\.\\d+)?$') THEN 'number'
 WHEN regexp_matches(v, '^[a-z0-9]([a-z0-9-]*[a-z0-9])?(\\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)+(:\\d+)?$') THEN 'hostname' WHEN regexp_matches(v, '^[A-Za-z][A-Za-z0-9_-]{0,31}$') THEN 'enum' ELSE 'opaque' END AS vclass
 FROM (SELECT docker_id, e, trim(e.value) AS v, list_aggregate(str_split(trim(e.value), ''), 'entropy') AS list_entropy FROM (SELECT DISTINCT docker_id, unnest(map_entries(env_pairs)) AS e FROM docker_resources))) GROUP BY ALL""")
def K2_value_classes(spark: SparkSession, d: str) -> DataFrame:
    v = docker(spark, d).select("docker_id", F.explode("env_pairs").alias("name", "value"))
    return v.groupBy("name", scalars.value_class(F.col("name"), F.col("value")).alias("value_class")).agg(F.count("*").alias("n"))


@query("""SELECT file_id, round(list_aggregate(str_split(name, ''), 'entropy'), 4) AS bits FROM (SELECT DISTINCT file_id, name FROM files WHERE name IS NOT NULL AND name <> '')""")
def K3_entropy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files", "file_id", "name").where("name is not null and name <> ''").distinct().select("file_id", F.round(scalars.entropy_bits(F.col("name")), 4).alias("bits"))


QUERIES, SQL = query.queries, query.sql
