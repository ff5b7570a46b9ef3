"""Queries of the link run and of the reports over its edges, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions import keys
from claimweave.operators import emit, graph, linker, reports, temporal
from claimweave.operators.shredding import once
from claimweave.plans.graph_queries import E, edges, nodes
from claimweave.plans.registry import Registry
from claimweave.sources.tables import table

query = Registry()


def star_claims(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as services, each with one operation; whoever delivers a part calls the service that the part's number names."""
    s = table(spark, d, "supplier", "s_suppkey").withColumn("name", F.concat(F.lit("svc"), "s_suppkey")).withColumn("repo_id", F.concat(F.lit("supplier-"), "s_suppkey"))
    n = s.agg(F.count("*").alias("n")).withColumn("one", F.lit(1))
    li = table(spark, d, "lineitem", "l_suppkey", "l_partkey").distinct().withColumn("one", F.lit(1)).join(F.broadcast(n), "one")
    pairs = li.select("l_suppkey", (F.col("l_partkey") % F.col("n")).alias("p")).distinct()
    none, no = F.lit(None).cast("string"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))

    def claim(df: DataFrame, repo, kind: str, direction: str, key, hint, path: str, attrs, node) -> DataFrame:
        return df.select(F.concat_ws("|", repo, F.lit(kind), F.lit(direction), key).alias("id"), repo.alias("repo_id"), F.lit(kind).alias("kind"), F.lit(direction).alias("direction"), key.alias("key"), hint.alias("hint"), F.lit(path).alias("path"), F.lit(1).alias("line"), attrs.alias("attrs"), node.alias("node_id"))

    repo = F.col("repo_id")
    route = lambda c: F.concat(F.lit("GET:/parts"), c, F.lit("/{id}"))
    names = claim(s, repo, "svcname", "provides", F.concat(F.lit("default:"), "name"), none, "compose.yml", F.create_map(F.lit("source"), F.lit("compose"), F.lit("build_context"), F.lit(".")), none)
    shown = claim(s, repo, "http", "provides", route(F.col("s_suppkey")), none, "src/routes.py", no, F.concat(repo, F.lit(":route")))
    caller = F.concat(F.lit("supplier-"), "l_suppkey")
    used = claim(pairs, caller, "http", "consumes", F.concat(F.lit("httpcall:"), route(F.col("p"))), F.concat(F.lit("svc"), "p"), "src/client.py", no, F.concat(caller, F.lit(":client")))
    return names.unionByName(shown).unionByName(used)


@query("""WITH p AS (SELECT DISTINCT l_suppkey AS c, l_partkey % (SELECT count(*) FROM supplier) AS p FROM lineitem), s AS (SELECT s_suppkey AS s FROM supplier)
 SELECT 'global:Service:svc' || c AS source_id, 'CALLS_SERVICE' AS type, 'global:Service:svc' || p AS target_id, CAST(0.95 AS DOUBLE) AS confidence, 'calls_rollup' AS detected_by, 'active' AS status FROM p WHERE c <> p
 UNION ALL SELECT 'supplier-' || c, 'DEPENDS_ON_REPO', 'supplier-' || p, 0.95, 'deps_rollup', 'active' FROM p WHERE c <> p
 UNION ALL SELECT 'supplier-' || c || ':client', 'INVOKES', 'global:HttpContract:svc' || p || ':GET:/parts' || p || '/{}', 0.95, 'http', 'active' FROM p
 UNION ALL SELECT 'supplier-' || s || ':route', 'EXPOSES', 'global:HttpContract:svc' || s || ':GET:/parts' || s || '/{}', 0.98, 'http', 'active' FROM s
 UNION ALL SELECT 'global:Service:svc' || s, 'BUILT_FROM', 'supplier-' || s, 0.95, 'alias', 'active' FROM s
 UNION ALL SELECT 'global:Service:svc' || s, 'HAS_ALIAS', 'global:ServiceName:default:svc' || s, 0.9, 'alias', 'active' FROM s
 UNION ALL SELECT 'supplier-' || s || '|svcname|provides|default:svc' || s, 'RESOLVED_TO', 'global:ServiceName:default:svc' || s, 0.98, 'alias', 'active' FROM s""")
def E1_link(spark: SparkSession, d: str) -> DataFrame:
    """A whole link run: services, calls to their contracts, rollups, fusion."""
    out = linker.link(star_claims(spark, d))
    return out.select("source_id", "type", "target_id", F.round("confidence", 6).alias("confidence"), "detected_by", "status")


@query()
def E1_link_estate(spark: SparkSession, d: str) -> DataFrame:
    """A link run over the container and workload records: edges and surest confidence per type."""
    claims = emit.claims_of_tables(once(table(spark, d, "docker_resources"), "docker_id"), once(table(spark, d, "k8s_resources"), "resource_id"))
    return linker.link(claims).groupBy("type", "status").agg(F.count("*").alias("n"), F.round(F.max("confidence"), 4).alias("most"))


ENDS = "split_part(source_id, ':', 1) AS source_repo, split_part(target_id, ':', 1) AS target_repo"
HALVES = f"""{E}, ev AS (SELECT edge_id, min(x) AS x FROM (SELECT edge_id, unnest(evidence) AS x FROM edges) WHERE x IS NOT NULL GROUP BY edge_id),
 h AS (SELECT source_id, type, target_id, {ENDS}, loaded_at < TIMESTAMP '2025-07-01' AS old, max(confidence) AS confidence, min(x) AS x FROM e LEFT JOIN ev USING (edge_id) WHERE status = 'active' GROUP BY ALL),
 b AS (SELECT * FROM h WHERE old), n AS (SELECT * FROM h WHERE NOT old), ch AS (SELECT DISTINCT repo_id FROM scan_meta WHERE absence_complete),
 lost AS (SELECT b.*, source_repo IN (SELECT repo_id FROM ch) AS cm, target_repo IN (SELECT repo_id FROM ch) AS pm FROM b WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.source_id = b.source_id AND n.type = b.type AND n.target_id = b.target_id)),
 i AS (SELECT source_id, type, target_id, CASE WHEN x IS NULL THEN 'uncitable' WHEN source_repo = '' OR target_repo = '' THEN 'unattributable' WHEN NOT pm AND NOT cm THEN 'unexplained' ELSE 'break' END AS bucket, pm AND NOT cm AS free, source_repo AS consumer_repo, confidence, x FROM lost
 UNION ALL SELECT n.source_id, n.type, n.target_id, CASE WHEN b.source_id IS NULL THEN 'added' ELSE 'kept' END, false, n.source_repo, n.confidence, n.x FROM n LEFT JOIN b ON n.source_id = b.source_id AND n.type = b.type AND n.target_id = b.target_id)"""


def _impact(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "edges", "edge_id", "evidence").select("edge_id", F.explode("evidence").alias("x")).where("x is not null").groupBy("edge_id").agg(F.min("x").alias("x"))
    when = table(spark, d, "edges", "edge_id", "loaded_at").distinct()
    e = graph.active(edges(spark, d)).select("edge_id", "source_id", "type", "target_id", "confidence").join(when, "edge_id").join(ev, "edge_id", "left")
    old = F.col("loaded_at") < F.to_timestamp_ntz(F.lit("2025-07-01 00:00:00"))
    g = e.groupBy("source_id", "type", "target_id", old.alias("old")).agg(F.max("confidence").alias("confidence"), F.min("x").alias("x"))
    g = g.withColumns({"source_repo": graph.repo_of(F.col("source_id")), "target_repo": graph.repo_of(F.col("target_id")), "evidence": F.array_compact(F.array("x"))})
    changed = table(spark, d, "scan_meta", "repo_id", "absence_complete").where("absence_complete").select("repo_id").distinct()
    return reports.change_impact(g.where("old"), g.where("not old"), changed)


@query(f"WITH {HALVES} SELECT source_id, type, target_id, bucket, CAST(bucket = 'break' AND free AS BIGINT) AS caused, round(confidence, 6) AS confidence FROM i")
def H2_change_impact(spark: SparkSession, d: str) -> DataFrame:
    i = _impact(spark, d)
    return i.select("source_id", "type", "target_id", "bucket", F.col("caused").cast("bigint").alias("caused"), F.round("confidence", 6).alias("confidence"))


@query(f"WITH {HALVES} SELECT x AS citation, min(consumer_repo) AS repo, min(source_id) AS consumer, min(target_id) AS lost, count(DISTINCT source_id) AS n_consumers, count(*) AS n_breaks FROM i WHERE bucket = 'break' AND free GROUP BY x")
def H3_comment_groups(spark: SparkSession, d: str) -> DataFrame:
    return reports.comment_groups(_impact(spark, d))


@query(f"WITH {HALVES} SELECT round(coalesce(sum(confidence), 0.0), 2) AS score, count(DISTINCT consumer_repo) AS blast_repos, count(*) AS breaks FROM i WHERE bucket = 'break' AND free")
def F21_change_risk(spark: SparkSession, d: str) -> DataFrame:
    return reports.change_risk(_impact(spark, d))


def _part_claims(spark: SparkSession, d: str) -> DataFrame:
    """Parts as declarations, delivered parts as what code does."""
    p = table(spark, d, "part", "p_partkey", "p_brand", "p_size", "p_type")
    sold = table(spark, d, "lineitem", "l_partkey", "l_quantity").where("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey")).distinct().join(p, "p_partkey")
    brand = F.translate("p_brand", "#", "")
    make = lambda df, kind, key, said: df.select(F.lit(kind).alias("kind"), F.lit("provides").alias("direction"), key.alias("key"), F.create_map(*[F.lit(x) for kv in said.items() for x in kv] or [F.lit("code"), F.lit("true")]).alias("attrs")).dropDuplicates(["key"])
    path = lambda name: F.concat(F.lit("GET:/"), brand, F.lit("/"), "p_size", F.lit("/{%s}" % name))
    service = F.concat(brand, F.lit("S"), "p_size")
    return (
        make(p, "http", path("id"), {"source": "openapi"}).unionByName(make(sold, "http", path("part"), {}))
        .unionByName(make(p.where("p_size > 10"), "grpcop", F.concat(F.lit("part."), service, F.lit("/"), F.translate("p_type", " ", "")), {})).unionByName(make(sold, "grpcstub", service, {}))
        .unionByName(make(p.where("p_size % 2 = 0"), "topic", F.concat(F.lit("kafka:"), service), {"declared": "true"})).unionByName(make(sold, "topic", F.concat(F.lit("kafka:"), service), {}))
    )


_SOLD = "p AS (SELECT *, replace(p_brand, '#', '') AS br FROM part), sold AS (SELECT * FROM p WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40))"
_BUCKET = "SELECT coalesce(d.key, o.key) AS key, CASE WHEN o.key IS NULL THEN 'declared_only' WHEN d.key IS NULL THEN 'observed_only' ELSE 'matched' END AS bucket FROM d FULL JOIN o ON d.key = o.key"


@query(f"WITH {_SOLD}, d AS (SELECT DISTINCT 'GET:/' || br || '/' || p_size || '/{{}}' AS key FROM p), o AS (SELECT DISTINCT 'GET:/' || br || '/' || p_size || '/{{}}' AS key FROM sold) {_BUCKET}")
def H6_http_operations(spark: SparkSession, d: str) -> DataFrame:
    return reports.reconcile_http(_part_claims(spark, d))


@query(f"""WITH {_SOLD}, op AS (SELECT DISTINCT 'part.' || br || 'S' || p_size || '/' || replace(p_type, ' ', '') AS key, lower(br || 'S' || p_size) AS name FROM p WHERE p_size > 10), s AS (SELECT DISTINCT br || 'S' || p_size AS key FROM sold)
 SELECT key, CASE WHEN name IN (SELECT lower(key) FROM s) THEN 'matched' ELSE 'declared_only' END AS bucket FROM op UNION ALL SELECT key, 'observed_only' FROM s WHERE lower(key) NOT IN (SELECT name FROM op)""")
def H7_grpc_operations(spark: SparkSession, d: str) -> DataFrame:
    return reports.reconcile_grpc(_part_claims(spark, d))


@query(f"WITH {_SOLD}, d AS (SELECT DISTINCT 'kafka:' || br || 'S' || p_size AS key FROM p WHERE p_size % 2 = 0), o AS (SELECT DISTINCT 'kafka:' || br || 'S' || p_size AS key FROM sold) {_BUCKET}")
def H8_topics(spark: SparkSession, d: str) -> DataFrame:
    return reports.reconcile_topics(_part_claims(spark, d))


@query(f"""WITH {E}, a AS (SELECT DISTINCT source_id, type, target_id FROM e WHERE status = 'active'), s AS (SELECT target_id AS topic, CASE type WHEN 'PUBLISHES_TO' THEN 'publisher' ELSE 'consumer' END AS role, source_id AS node_id FROM a WHERE type IN ('PUBLISHES_TO', 'CONSUMES_FROM'))
 SELECT * FROM s UNION SELECT f.source_id, 'fanned_out', s.node_id FROM a f JOIN s ON f.target_id = s.topic WHERE f.type = 'FANS_OUT_TO' AND s.role = 'consumer'""")
def F13_topic_chain(spark: SparkSession, d: str) -> DataFrame:
    return reports.topic_chain(edges(spark, d))


@query(f"""WITH {E}, a AS (SELECT source_id, target_id FROM e WHERE status = 'active'), x AS (SELECT node_id, max(o) AS o FROM (SELECT source_id AS node_id, 1 AS o FROM a UNION ALL SELECT target_id, 0 FROM a) GROUP BY 1), n AS (SELECT id, max(type) AS kind FROM nodes WHERE id IS NOT NULL GROUP BY id)
 SELECT coalesce(x.node_id, n.id) AS node_id, coalesce(kind, CASE WHEN len(str_split(x.node_id, ':')) >= 3 THEN split_part(x.node_id, ':', 2) ELSE '' END) AS kind, CAST(coalesce(o, 0) = 0 AS BIGINT) AS dead_end, CAST(kind IS NOT NULL AS BIGINT) AS listed FROM x FULL JOIN n ON x.node_id = n.id""")
def F10_flat_map(spark: SparkSession, d: str) -> DataFrame:
    return reports.flat_map(nodes(spark, d).where("id is not null"), edges(spark, d))


@query(f"""WITH {E} SELECT target_id AS library, count(DISTINCT source_id) FILTER (type = 'PUBLISHES') AS n_publishers, count(DISTINCT source_id) FILTER (type = 'DEPENDS_ON') AS n_dependents, round(min(confidence), 6) AS least_confidence
 FROM e WHERE status = 'active' AND type IN ('PUBLISHES', 'DEPENDS_ON') GROUP BY 1""")
def E43_library_impact(spark: SparkSession, d: str) -> DataFrame:
    return reports.library_impact(edges(spark, d)).withColumn("least_confidence", F.round("least_confidence", 6))


@query(f"""WITH {E}, f AS (SELECT DISTINCT source_id, type, target_id FROM e WHERE confidence >= 0.7), l AS (SELECT DISTINCT source_id, type, target_id, status FROM e WHERE status IN ('active', 'rejected')),
 j AS (SELECT l.type AS tier, l.status, f.source_id IS NOT NULL AS hit FROM l LEFT JOIN f ON f.source_id = l.source_id AND f.type = l.type AND f.target_id = l.target_id),
 g AS (SELECT tier, count(*) FILTER (status = 'active' AND hit) AS tp, count(*) FILTER (status = 'rejected' AND hit) AS fp, count(*) FILTER (status = 'active' AND NOT hit) AS fn FROM j GROUP BY tier)
 SELECT tier, tp, fp, fn, CASE WHEN tp + fp = 0 THEN 0.0 ELSE round(greatest(0.0, (tp / (tp + fp) + 3.8414588206941227 / (2 * (tp + fp)) - 1.959963984540054 * sqrt(tp / (tp + fp) * (1 - tp / (tp + fp)) / (tp + fp) + 3.8414588206941227 / (4.0 * (tp + fp) * (tp + fp)))) / (1 + 3.8414588206941227 / (tp + fp))), 4) END AS precision_lo,
 CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 4) END AS recall FROM g""")
def F19_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Edges of 0.7 and more against active edges as expected and rejected ones as forbidden, per type."""
    e = edges(spark, d).withColumn("tier", F.col("type"))
    return reports.calibration(e.where("confidence >= 0.7"), e.where("status = 'active'"), e.where("status = 'rejected'"))


@query(f"""WITH RECURSIVE {E}, l AS (SELECT DISTINCT source_id AS a, target_id AS b FROM e WHERE status = 'active' AND type = 'OWNED_BY'), u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
 r AS (SELECT a AS node, a AS x FROM u UNION SELECT b, b FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.x = u.a) SELECT node, min(x) AS component FROM r GROUP BY node""")
def I12_component_labels(spark: SparkSession, d: str) -> DataFrame:
    """Everything that ownership connects, labelled by its smallest member."""
    from claimweave.operators.traverse import components

    return components(graph.active(edges(spark, d)).where("type = 'OWNED_BY'").select(F.col("source_id").alias("a"), F.col("target_id").alias("b")))


@query("""WITH c AS (SELECT DISTINCT repo_id, split_part(regexp_extract(ev, '^(.*):(\\d+)', 1), '/', -1) AS path, CAST(nullif(regexp_extract(ev, '^(.*):(\\d+)', 2), '') AS BIGINT) AS line FROM (SELECT repo_id, unnest(evidence) AS ev FROM edges) WHERE ev IS NOT NULL),
 f AS (SELECT DISTINCT repo_id, name, content FROM files WHERE content IS NOT NULL AND name IS NOT NULL), l AS (SELECT repo_id, name, unnest(str_split(content, chr(10))) AS text, unnest(range(1, len(str_split(content, chr(10))) + 1)) AS pos FROM f)
 SELECT c.repo_id || '|' || c.path || '|' || c.line AS cite_id, CAST(coalesce(max(CASE WHEN l.pos BETWEEN c.line - 3 AND c.line + 3 AND contains(l.text, '(') THEN 1 ELSE 0 END), 0) AS BIGINT) AS verified
 FROM c LEFT JOIN l ON l.repo_id = c.repo_id AND l.name = c.path WHERE c.line IS NOT NULL AND c.repo_id IS NOT NULL GROUP BY c.repo_id, c.path, c.line""")
def J8_reverified(spark: SparkSession, d: str) -> DataFrame:
    """Citations whose file of that name has a call within three lines."""
    ev = table(spark, d, "edges", "repo_id", "evidence").select("repo_id", F.explode("evidence").alias("ev")).where("ev is not null")
    s = ev.select("repo_id", keys.evidence_span(F.col("ev")).alias("s")).select("repo_id", F.substring_index("s.path", "/", -1).alias("path"), F.col("s.first").alias("line")).where("line is not null and repo_id is not null").distinct()
    f = table(spark, d, "files", "repo_id", "name", "content").where("content is not null and name is not null").distinct()
    lines = f.select("repo_id", F.col("name").alias("path"), F.posexplode(F.split("content", "\n")).alias("p", "text")).select("repo_id", "path", (F.col("p") + 1).cast("bigint").alias("pos"), "text")
    cited = s.select(F.concat_ws("|", "repo_id", "path", F.col("line").cast("string")).alias("cite_id"), "repo_id", "path", "line", F.lit("(").alias("token"))
    return temporal.reverify(cited, lines)


@query(f"""WITH {E} SELECT repo_id, CAST(CAST(sum(CAST('0x' || substr(sha256(CAST(edge_id AS VARCHAR)), 1, 12) AS BIGINT)) AS HUGEINT) AS VARCHAR) AS fingerprint, count(*) AS n FROM (SELECT DISTINCT repo_id, edge_id FROM e) GROUP BY repo_id""")
def F22_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Digest of the ids of every repository, whatever their order."""
    return temporal.fingerprints(edges(spark, d).select("repo_id", F.col("edge_id").cast("string").alias("id")))


@query("""WITH f AS (SELECT DISTINCT repo_id, path, content FROM files WHERE path IS NOT NULL)
 SELECT repo_id, CAST(CAST(sum(CAST('0x' || substr(sha256(path || ':' || sha256(coalesce(content, ''))), 1, 12) AS BIGINT)) AS HUGEINT) AS VARCHAR) AS digest, count(*) AS n_files FROM f GROUP BY repo_id""")
def F23_tree_digest(spark: SparkSession, d: str) -> DataFrame:
    from claimweave.sources.repositories import tree_digest

    return tree_digest(table(spark, d, "files", "repo_id", "path", "content").where("path is not null"))


@query(f"WITH {E} SELECT repo_id, type, status, count(*) AS count FROM e GROUP BY ALL")
def F11_aggregate_all(spark: SparkSession, d: str) -> DataFrame:
    return graph.aggregate(edges(spark, d), ["repo_id", "type", "status"])


QUERIES, SQL = query.queries, query.sql
