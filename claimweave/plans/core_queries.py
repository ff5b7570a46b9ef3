"""Queries of the general data problems (p1 to p4) over the table folder, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.operators import hierarchy, orphans, shredding, snapshots
from claimweave.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = orphans.orphans(table(spark, d, "edges", "edge_id", "source_id", "target_id", "loaded_at"), table(spark, d, "nodes", "id", "loaded_at", "deleted_at"))
    return found.select(F.col("rid").alias("edge_id"), "side", "reason", "period")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(table(spark, d, "edges", "edge_id", "source_id", "target_id", "loaded_at"), table(spark, d, "nodes", "id", "loaded_at", "deleted_at"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return shredding.shred_children(table(spark, d, "k8s_resources"), table(spark, d, "catalog_entities"))


def p2_entities(spark: SparkSession, d: str) -> DataFrame:
    from claimweave.runtime import materialize

    catalog = shredding.once(table(spark, d, "catalog_entities"), "record_id")
    return shredding.catalog_entities(materialize(shredding.shred_json(catalog, "record_id", "payload")))


def p2_entity_links(spark: SparkSession, d: str) -> DataFrame:
    return shredding.entity_links(p2_entities(spark, d))


def _workloads(spark: SparkSession, d: str) -> DataFrame:
    return shredding.shred_workloads(shredding.once(table(spark, d, "k8s_resources"), "resource_id"))


def p2_containers(spark: SparkSession, d: str) -> DataFrame:
    return shredding.container_table(_workloads(spark, d)).drop("node")


def p2_env(spark: SparkSession, d: str) -> DataFrame:
    return shredding.env_table(_workloads(spark, d))


def p2_rules(spark: SparkSession, d: str) -> DataFrame:
    return shredding.rule_table(_workloads(spark, d))


def p2_lists(spark: SparkSession, d: str) -> DataFrame:
    return shredding.list_table(_workloads(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.Hierarchy(hierarchy.containment(table(spark, d, "edges", "source_id", "target_id", "type", "status"))).rows()


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    h = hierarchy.Hierarchy(hierarchy.containment(table(spark, d, "edges", "source_id", "target_id", "type", "status")))
    return h.paths()


def p3_intervals(spark: SparkSession, d: str) -> DataFrame:
    h = hierarchy.Hierarchy(hierarchy.containment(table(spark, d, "edges", "source_id", "target_id", "type", "status")))
    return h.intervals()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.snapshot_changes(table(spark, d, "artifacts"))


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.change_counts(table(spark, d, "artifacts"))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_entities, p2_entity_links, p2_containers, p2_env, p2_rules, p2_lists, p3_found, p3_paths, p3_intervals, p4_found, p4_counts)}
_REFS = """e AS (SELECT DISTINCT edge_id, source_id, target_id, loaded_at FROM edges),
 r AS (SELECT edge_id, 'source' AS side, trim(source_id) AS k, loaded_at AS t FROM e UNION ALL SELECT edge_id, 'target', trim(target_id), loaded_at FROM e),
 n AS (SELECT DISTINCT trim(id) AS k, loaded_at AS lo, deleted_at AS hi FROM nodes),
 j AS (SELECT r.edge_id, r.side, r.t, bool_or(n.k IS NOT NULL) AS known, coalesce(bool_or(lo <= t AND (hi IS NULL OR hi > t)), false) AS live, coalesce(bool_or(lo <= t), false) AS started
 FROM r LEFT JOIN n ON r.k = n.k WHERE coalesce(r.k, '') <> '' GROUP BY r.edge_id, r.side, r.t),
 x AS (SELECT edge_id, side, live, CASE WHEN NOT known THEN 'missing' WHEN started THEN 'deleted' ELSE 'late' END AS reason, strftime(t, '%Y-%m') AS period FROM j)"""
_K8S = """k AS (SELECT DISTINCT * FROM k8s_resources),
 c AS (SELECT resource_id, i, c FROM (SELECT resource_id, unnest(containers) AS c, CAST(unnest(range(0, len(containers))) AS BIGINT) AS i FROM k WHERE containers IS NOT NULL) WHERE c IS NOT NULL)"""
_SNAPS = """v AS (SELECT DISTINCT artifact_id, repo_id, head_sha, commit_idx, delivered_at, edges FROM artifacts WHERE edges IS NOT NULL AND trim(coalesce(head_sha, '')) <> ''),
 l AS (SELECT *, row_number() OVER (PARTITION BY repo_id, head_sha ORDER BY delivered_at DESC, artifact_id DESC) AS rn FROM v),
 s AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY commit_idx, head_sha) AS seq FROM l WHERE rn = 1),
 r AS (SELECT DISTINCT repo_id, seq, x.source_id AS source_id, x.type AS type, x.target_id AS target_id, coalesce(x.status, '') || '/' || coalesce(CAST(round(x.confidence, 4) AS VARCHAR), 'null') AS val FROM (SELECT repo_id, seq, unnest(edges) AS x FROM s)),
 a AS (SELECT r.*, s.head_sha FROM r JOIN s USING (repo_id, seq) WHERE seq > 1),
 b AS (SELECT r.repo_id, r.seq + 1 AS seq, r.source_id, r.type, r.target_id, r.val, s.head_sha FROM r JOIN s ON s.repo_id = r.repo_id AND s.seq = r.seq + 1),
 c AS (SELECT coalesce(a.repo_id, b.repo_id) AS repo_id, coalesce(a.head_sha, b.head_sha) AS head_sha, coalesce(a.source_id, b.source_id) AS source_id, coalesce(a.type, b.type) AS edge_type, coalesce(a.target_id, b.target_id) AS target_id,
 CASE WHEN b.val IS NULL THEN 'added' WHEN a.val IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
 FROM a FULL JOIN b ON a.repo_id = b.repo_id AND a.seq = b.seq AND a.source_id = b.source_id AND a.type = b.type AND a.target_id = b.target_id WHERE a.val IS DISTINCT FROM b.val)"""

SQL: dict[str, str] = {
    "p1_found": f"WITH {_REFS} SELECT edge_id, side, reason, period FROM x WHERE NOT live",
    "p1_report": f"""WITH {_REFS} SELECT 'edges' AS table_name, side, period, count(*) AS n_refs, count(*) FILTER (NOT live AND reason = 'missing') AS n_missing, count(*) FILTER (NOT live AND reason = 'deleted') AS n_deleted,
 count(*) FILTER (NOT live AND reason = 'late') AS n_late, count(*) FILTER (NOT live) AS n_orphans FROM x GROUP BY side, period""",
    "p2_found": """WITH k AS (SELECT DISTINCT * FROM k8s_resources), c AS (SELECT resource_id, unnest(containers) AS c FROM k WHERE containers IS NOT NULL),
 env AS (SELECT resource_id, c.name AS parent, unnest(range(0, len(c.env))) AS pos, c.env AS l FROM c WHERE c IS NOT NULL AND c.env IS NOT NULL),
 ing AS (SELECT resource_id, unnest(range(0, len(ingress_rules))) AS pos, ingress_rules AS l FROM k WHERE ingress_rules IS NOT NULL),
 t AS (SELECT record_id, t.* FROM (SELECT DISTINCT record_id, payload, repo_id, file_path, received_at FROM catalog_entities WHERE json_valid(payload)) c, json_tree(c.payload) t),
 pa AS (SELECT record_id, id, type, value, parent FROM t WHERE key = 'provides_apis'),
 own AS (SELECT pa.*, CASE WHEN h.key = 'spec' THEN h.parent ELSE pa.parent END AS ent FROM pa JOIN t h ON h.record_id = pa.record_id AND h.id = pa.parent),
 named AS (SELECT own.*, n.value ->> '$' AS ent_name FROM own LEFT JOIN t n ON n.record_id = own.record_id AND n.parent = own.ent AND n.key = 'name'),
 el AS (SELECT a.record_id, a.ent_name, CAST(x.key AS BIGINT) AS pos, x.type, x.value FROM named a JOIN t x ON x.record_id = a.record_id AND x.parent = a.id WHERE a.type = 'ARRAY'
 UNION ALL SELECT record_id, ent_name, 0, type, value FROM named WHERE type <> 'ARRAY'),
 api AS (SELECT record_id, ent_name, pos, CASE WHEN type = 'VARCHAR' THEN value ->> '$' WHEN type = 'OBJECT' THEN value ->> '$.name' END AS full_name FROM el)
 SELECT 'env' AS child, resource_id AS rec_id, parent, CAST(pos AS BIGINT) AS pos, l[pos + 1].name AS child_name FROM env WHERE trim(coalesce(l[pos + 1].name, '')) <> ''
 UNION ALL SELECT 'ingress', resource_id, l[pos + 1].host, CAST(pos AS BIGINT), l[pos + 1].backend_service FROM ing WHERE trim(coalesce(l[pos + 1].backend_service, '')) <> ''
 UNION ALL SELECT 'api', record_id, ent_name, pos, trim(regexp_replace(regexp_replace(full_name, '^[^:]*:', ''), '^.*/', '')) FROM api WHERE trim(regexp_replace(regexp_replace(coalesce(full_name, ''), '^[^:]*:', ''), '^.*/', '')) <> ''""",
    "p2_entity_links": """WITH t AS (SELECT record_id, t.* FROM (SELECT DISTINCT record_id, payload, repo_id, file_path, received_at FROM catalog_entities WHERE json_valid(payload)) c, json_tree(c.payload) t),
 s AS (SELECT record_id, parent, max(CASE WHEN key = 'kind' THEN value ->> '$' END) AS kind, max(CASE WHEN key = 'name' THEN value ->> '$' END) AS name, max(CASE WHEN key = 'owner' THEN value ->> '$' END) AS owner,
 max(CASE WHEN key = 'lifecycle' THEN value ->> '$' END) AS lifecycle FROM t WHERE key IN ('kind', 'name', 'owner', 'lifecycle') AND type NOT IN ('OBJECT', 'ARRAY', 'NULL') GROUP BY record_id, parent),
 e AS (SELECT t.record_id, t.id, t.parent, s.kind, s.name, s.owner, s.lifecycle FROM t JOIN s ON s.record_id = t.record_id AND s.parent = t.id WHERE t.type = 'OBJECT' AND s.kind IS NOT NULL AND s.name IS NOT NULL)
 SELECT e.record_id AS rec_id, e.kind, e.name, e.owner, e.lifecycle, a.name AS parent_name FROM e LEFT JOIN t l ON l.record_id = e.record_id AND l.id = e.parent LEFT JOIN e a ON a.record_id = e.record_id AND a.id = l.parent""",
    "p2_containers": f"WITH {_K8S} SELECT resource_id AS rec_id, i AS pos, c.name AS name, c.image AS image, CAST(c.is_init AS VARCHAR) AS is_init FROM c",
    "p2_env": f"""WITH {_K8S}, e AS (SELECT resource_id, i, unnest(c.env) AS e, CAST(unnest(range(0, len(c.env))) AS BIGINT) AS pos FROM c WHERE c.env IS NOT NULL)
 SELECT resource_id AS rec_id, i AS container, pos, e.name AS name, e.source AS source, e.value AS value, e.ref_name AS ref_name, e.ref_key AS ref_key, e.prefix AS prefix, CAST(e.optional AS VARCHAR) AS optional FROM e WHERE e IS NOT NULL""",
    "p2_rules": f"""WITH {_K8S}, r AS (SELECT resource_id, unnest(ingress_rules) AS r, CAST(unnest(range(0, len(ingress_rules))) AS BIGINT) AS pos FROM k WHERE ingress_rules IS NOT NULL)
 SELECT resource_id AS rec_id, pos, r.host AS host, r.path AS path, r.path_type AS path_type, r.backend_service AS backend_service, r.backend_port AS backend_port FROM r WHERE r IS NOT NULL""",
    "p2_lists": f"""WITH {_K8S}, l AS (SELECT resource_id, i, 'ports' AS label, CAST(unnest(c.ports) AS VARCHAR) AS value, CAST(unnest(range(0, len(c.ports))) AS BIGINT) AS pos FROM c
 UNION ALL SELECT resource_id, i, 'command', unnest(c.command), CAST(unnest(range(0, len(c.command))) AS BIGINT) FROM c) SELECT resource_id AS rec_id, i AS container, label, pos, value FROM l WHERE value IS NOT NULL""",
    "p3_found": """WITH RECURSIVE l AS (SELECT DISTINCT trim(CASE WHEN type = 'MEMBER_OF' THEN source_id ELSE target_id END) AS c, trim(CASE WHEN type = 'MEMBER_OF' THEN target_id ELSE source_id END) AS p FROM edges
 WHERE status = 'active' AND type IN ('CONTAINS', 'DECLARES', 'MEMBER_OF') AND trim(coalesce(source_id, '')) <> '' AND trim(coalesce(target_id, '')) <> ''),
 u AS (SELECT c AS v, p AS a FROM l UNION SELECT u.v, l.p FROM u JOIN l ON u.a = l.c), n AS (SELECT c AS v FROM l UNION SELECT p FROM l), loops AS (SELECT v FROM u WHERE v = a),
 lost AS (SELECT v FROM loops UNION SELECT v FROM u WHERE a IN (SELECT v FROM loops)), d AS (SELECT v, count(*) AS depth, max(CASE WHEN a NOT IN (SELECT c FROM l) THEN a END) AS root FROM u GROUP BY v),
 b AS (SELECT a AS v, count(*) FILTER (v <> a) AS n_below FROM u GROUP BY a)
 SELECT n.v AS node_id, CASE WHEN n.v IN (SELECT v FROM lost) THEN '' ELSE coalesce(root, n.v) END AS root_id, CASE WHEN n.v IN (SELECT v FROM lost) THEN -1 ELSE coalesce(depth, 0) END AS depth,
 coalesce(n_below, 0) AS n_below, CAST(n.v IN (SELECT v FROM loops) AS BIGINT) AS in_cycle FROM n LEFT JOIN d ON d.v = n.v LEFT JOIN b ON b.v = n.v""",
    "p3_paths": """WITH RECURSIVE l AS (SELECT DISTINCT trim(CASE WHEN type = 'MEMBER_OF' THEN source_id ELSE target_id END) AS c, trim(CASE WHEN type = 'MEMBER_OF' THEN target_id ELSE source_id END) AS p FROM edges
 WHERE status = 'active' AND type IN ('CONTAINS', 'DECLARES', 'MEMBER_OF') AND trim(coalesce(source_id, '')) <> '' AND trim(coalesce(target_id, '')) <> ''),
 w AS (SELECT DISTINCT p AS v, p AS path FROM l WHERE p NOT IN (SELECT c FROM l) UNION ALL SELECT l.c, w.path || ' > ' || l.c FROM w JOIN l ON l.p = w.v)
 SELECT n.v AS node_id, coalesce(w.path, '') AS path FROM (SELECT c AS v FROM l UNION SELECT p FROM l) n LEFT JOIN w ON w.v = n.v""",
    "p4_found": f"WITH {_SNAPS} SELECT * FROM c",
    "p4_counts": f"WITH {_SNAPS} SELECT repo_id, head_sha, count(*) FILTER (change_kind = 'added') AS n_added, count(*) FILTER (change_kind = 'removed') AS n_removed, count(*) FILTER (change_kind = 'changed') AS n_changed FROM c GROUP BY repo_id, head_sha",
}
