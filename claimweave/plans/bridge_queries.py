"""Join rules over the star-schema tables, read as claims: suppliers provide contracts, customers' nations call them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions import keys, scalars
from claimweave.operators import graph, resolvers, temporal
from claimweave.plans.registry import Registry
from claimweave.sources.tables import table

query = Registry()

CONTRACTS = """ct AS (SELECT DISTINCT 'supplier:' || l_suppkey || ':' || p_brand AS contract_id, 'nation:' || s_nationkey AS repo_id, CASE WHEN l_suppkey % 7 = 0 THEN 'ANY' ELSE 'GET' END AS method,
 '/brand/' || p_brand || '/{part}' AS template, 'supplier:' || l_suppkey AS service FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""
CALLS = """ca AS (SELECT DISTINCT 'nation:' || c_nationkey || ':' || l_suppkey || ':' || p_brand AS call_id, 'nation:' || c_nationkey AS repo_id, 'GET' AS method,
 CASE WHEN l_suppkey % 2 = 0 THEN '/brand/' || p_brand || '/{part}' ELSE '/brand/' || p_brand || '/{id}' END AS template, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE 'supplier:' || l_suppkey END AS service
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey)"""


def contracts(spark: SparkSession, d: str) -> DataFrame:
    li, p, s = table(spark, d, "lineitem", "l_suppkey", "l_partkey"), table(spark, d, "part", "p_partkey", "p_brand"), table(spark, d, "supplier", "s_suppkey", "s_nationkey")
    j = li.join(p, li.l_partkey == p.p_partkey).select("l_suppkey", "p_brand").distinct().join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    service = F.concat(F.lit("supplier:"), "l_suppkey")
    return j.select(
        F.concat_ws(":", service, "p_brand").alias("contract_id"), F.concat(F.lit("nation:"), "s_nationkey").alias("repo_id"), F.when(F.col("l_suppkey") % 7 == 0, "ANY").otherwise("GET").alias("method"), F.concat(F.lit("/brand/"), "p_brand", F.lit("/{part}")).alias("template"), service.alias("service")
    )


def calls(spark: SparkSession, d: str) -> DataFrame:
    li, o = table(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_partkey"), table(spark, d, "orders", "o_orderkey", "o_custkey")
    c, p = table(spark, d, "customer", "c_custkey", "c_nationkey"), table(spark, d, "part", "p_partkey", "p_brand")
    j = li.join(p, li.l_partkey == p.p_partkey).join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "l_suppkey", "p_brand").distinct()
    end = F.when(F.col("l_suppkey") % 2 == 0, "/{part}").otherwise("/{id}")
    repo = F.concat(F.lit("nation:"), "c_nationkey")
    return j.select(F.concat_ws(":", repo, "l_suppkey", "p_brand").alias("call_id"), repo.alias("repo_id"), F.lit("GET").alias("method"), F.concat(F.lit("/brand/"), "p_brand", end).alias("template"), F.when(F.col("l_suppkey") % 3 != 0, F.concat(F.lit("supplier:"), "l_suppkey")).alias("service"))


@query(f"""WITH {CONTRACTS}, {CALLS}, h AS (SELECT call_id, ca.repo_id, contract_id, ct.repo_id AS pr, ca.template = ct.template AS ex FROM ca JOIN ct ON regexp_replace(ca.template, '\\{{[^}}]*\\}}', '{{}}', 'g') = regexp_replace(ct.template, '\\{{[^}}]*\\}}', '{{}}', 'g')
 AND ct.method IN (ca.method, 'ANY') AND (ca.service IS NULL OR ca.service = ct.service)), b AS (SELECT call_id, bool_or(repo_id = pr) AS any_same FROM h GROUP BY call_id),
 k AS (SELECT h.call_id, contract_id, bool_or(ex) AS ex, min(pr) AS pr FROM h JOIN b USING (call_id) WHERE (repo_id = pr) = any_same GROUP BY h.call_id, contract_id), n AS (SELECT call_id, count(*) AS n FROM k GROUP BY call_id)
 SELECT ca.call_id, ca.repo_id, contract_id, pr AS provider_repo, CAST(CASE WHEN contract_id IS NULL THEN NULL WHEN ex THEN 0.95 ELSE 0.9 END AS DOUBLE) AS confidence, coalesce(n, 0) AS n_contracts,
 CASE WHEN n IS NULL THEN 'unmatched' WHEN n > 32 THEN 'fanout' ELSE 'matched' END AS outcome FROM ca LEFT JOIN n ON n.call_id = ca.call_id LEFT JOIN k ON k.call_id = ca.call_id AND n.n <= 32""")
def E26_http_join(spark: SparkSession, d: str) -> DataFrame:
    return resolvers.match_http(calls(spark, d), contracts(spark, d))


@query("""WITH c AS (SELECT DISTINCT 'nation:' || s_nationkey AS repo_id, CASE WHEN l_suppkey % 2 = 0 THEN 'provides' ELSE 'consumes' END AS direction, CASE WHEN l_suppkey % 5 = 0 THEN 'channel' WHEN p_size % 2 = 0 THEN 'kafka' ELSE 'sqs' END || ':' || p_brand || p_size AS key
 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey), t AS (SELECT *, split_part(key, ':', 1) AS s, split_part(key, ':', 2) AS n FROM c),
 k AS (SELECT n, count(DISTINCT s) AS c, min(s) AS sole FROM t WHERE s <> 'channel' GROUP BY n)
 SELECT repo_id AS source_id, CASE direction WHEN 'provides' THEN 'PUBLISHES_TO' ELSE 'CONSUMES_FROM' END AS type, 'global:Topic:' || CASE WHEN s = 'channel' AND k.c = 1 THEN sole || ':' || t.n ELSE key END AS target_id, count(*) AS weight FROM t LEFT JOIN k ON k.n = t.n GROUP BY ALL""")
def E30_topics(spark: SparkSession, d: str) -> DataFrame:
    """Topics with their unknown systems folded into the only concrete one (E31)."""
    li, p, s = table(spark, d, "lineitem", "l_suppkey", "l_partkey"), table(spark, d, "part", "p_partkey", "p_brand", "p_size"), table(spark, d, "supplier", "s_suppkey", "s_nationkey")
    j = li.join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey)
    system = F.when(F.col("l_suppkey") % 5 == 0, "channel").when(F.col("p_size") % 2 == 0, "kafka").otherwise("sqs")
    t = j.select(F.concat(F.lit("nation:"), "s_nationkey").alias("repo_id"), F.when(F.col("l_suppkey") % 2 == 0, "provides").otherwise("consumes").alias("direction"), F.concat(system, F.lit(":"), "p_brand", F.col("p_size").cast("string")).alias("key")).distinct()
    return resolvers.topic_edges(t)


@query("""WITH c AS (SELECT DISTINCT 'nation:' || s_nationkey AS repo_id, CASE WHEN l_suppkey % 2 = 0 THEN 'provides' ELSE 'consumes' END AS direction, CASE WHEN p_size < 10 THEN 's3:' ELSE 'table:' END || p_brand || p_size AS key, l_suppkey % 50 = 0 AS declares
 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey), g AS (SELECT key, count(DISTINCT repo_id) AS r, count(DISTINCT CASE WHEN declares THEN repo_id END) AS nd, min(CASE WHEN declares THEN repo_id END) AS owner FROM c GROUP BY key)
 SELECT DISTINCT repo_id AS source_id, CASE direction WHEN 'provides' THEN 'WRITES_TO' ELSE 'READS_FROM' END AS type, CASE WHEN key NOT LIKE 'table:%' OR r = 1 OR nd = 1 THEN 'global:Data:' || key END AS target_id, owner,
 CASE WHEN key NOT LIKE 'table:%' OR r = 1 OR nd = 1 THEN 'matched' ELSE 'ambiguous' END AS outcome, key FROM c JOIN g USING (key)""")
def E37_datasets(spark: SparkSession, d: str) -> DataFrame:
    li, p, s = table(spark, d, "lineitem", "l_suppkey", "l_partkey"), table(spark, d, "part", "p_partkey", "p_brand", "p_size"), table(spark, d, "supplier", "s_suppkey", "s_nationkey")
    j = li.join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey)
    key = F.concat(F.when(F.col("p_size") < 10, "s3:").otherwise("table:"), "p_brand", F.col("p_size").cast("string"))
    c = j.select(F.concat(F.lit("nation:"), "s_nationkey").alias("repo_id"), F.when(F.col("l_suppkey") % 2 == 0, "provides").otherwise("consumes").alias("direction"), key.alias("key"), (F.col("l_suppkey") % 50 == 0).alias("declares")).distinct()
    return resolvers.match_datasets(c)


@query("""WITH p AS (SELECT DISTINCT lower(p_brand || '.' || p_type) AS k, 'nation:' || s_nationkey AS repo_id, l_suppkey % 40 = 0 AS federated FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
 c AS (SELECT DISTINCT 'segment:' || c_mktsegment AS source_id, lower(p_brand || '.' || p_type) AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey),
 g AS (SELECT k, count(DISTINCT repo_id) AS n, bool_or(federated) AS fed FROM p GROUP BY k)
 SELECT DISTINCT source_id, p.repo_id AS target_id, c.k AS key, round(CASE WHEN fed THEN 0.95 WHEN n > 1 THEN 0.8 / n ELSE 0.8 END, 6) AS confidence FROM c JOIN g USING (k) JOIN p ON p.k = c.k""")
def E28_graphql(spark: SparkSession, d: str) -> DataFrame:
    li, p, s = table(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_partkey"), table(spark, d, "part", "p_partkey", "p_brand", "p_type"), table(spark, d, "supplier", "s_suppkey", "s_nationkey")
    o, c = table(spark, d, "orders", "o_orderkey", "o_custkey"), table(spark, d, "customer", "c_custkey", "c_mktsegment")
    j = li.join(p, li.l_partkey == p.p_partkey).withColumn("key", F.concat_ws(".", "p_brand", "p_type"))
    prov = j.join(s, j.l_suppkey == s.s_suppkey).select(F.concat(F.lit("nation:"), "s_nationkey").alias("repo_id"), "key", (F.col("l_suppkey") % 40 == 0).alias("federated")).distinct()
    cons = j.join(o, j.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.concat(F.lit("segment:"), "c_mktsegment").alias("repo_id"), "key").distinct()
    return resolvers.match_graphql(cons, prov)


@query("""WITH a AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderpriority AS p, o_custkey AS c FROM orders), d AS (SELECT DISTINCT day, p FROM a), i AS (SELECT p, day, date_diff('day', DATE '1992-01-01', day) AS n, date_diff('day', DATE '1992-01-01', day) - row_number() OVER (PARTITION BY p ORDER BY day) AS island FROM d)
 SELECT p AS priority, min(n) AS first, max(n) AS last, count(*) AS n FROM i GROUP BY p, island""")
def G6_intervals_of_days(spark: SparkSession, d: str) -> DataFrame:
    """Runs of consecutive days on which an order priority occurs."""
    o = table(spark, d, "orders", "o_orderdate", "o_orderpriority")
    days = o.select(F.lit(0).alias("g"), F.col("o_orderpriority").alias("priority"), F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01")).cast("bigint").alias("day"))
    return temporal.intervals(days, ["g"], ["priority"], "day").select("priority", "first", "last", "n")


@query("""SELECT o_orderpriority AS priority, count(*) FILTER (o_orderstatus = 'F') AS s, count(*) AS n, round(greatest(0.0, ((s / n + 1.9207294103470777 / n) - 1.959963984540054 * sqrt((s / n) * (1 - s / n) / n + 0.9603647051735314 / (n * CAST(n AS DOUBLE)))) / (1 + 3.841458820694124 / n)), 4) AS lo,
 round(least(1.0, ((s / n + 1.9207294103470777 / n) + 1.959963984540054 * sqrt((s / n) * (1 - s / n) / n + 0.9603647051735314 / (n * CAST(n AS DOUBLE)))) / (1 + 3.841458820694124 / n)), 4) AS hi FROM orders GROUP BY 1""")
def K5_wilson_interval(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "orders", "o_orderpriority", "o_orderstatus").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("s"), F.count("*").alias("n"))
    w = scalars.wilson(F.col("s"), F.col("n"))
    return g.select("priority", "s", "n", w["lo"].alias("lo"), w["hi"].alias("hi"))


@query("""WITH l AS (SELECT l_suppkey AS key, count(*) AS n_left FROM lineitem GROUP BY 1), r AS (SELECT s_suppkey AS key, count(*) AS n_right FROM supplier GROUP BY 1), j AS (SELECT * FROM l JOIN r USING (key)), t AS (SELECT greatest(1, CAST(floor(sum(n_left + n_right) / 120) AS BIGINT)) AS fair FROM j)
 SELECT key, n_left, n_right, CAST(greatest(n_left, n_right) > fair AS BIGINT) AS hot, CAST(least(64, greatest(1, ceil(greatest(n_left, n_right) / fair))) AS BIGINT) AS pieces FROM j, t""")
def E47_skew_plan(spark: SparkSession, d: str) -> DataFrame:
    return resolvers.skew_plan(table(spark, d, "lineitem", F.col("l_suppkey").alias("key")), table(spark, d, "supplier", F.col("s_suppkey").alias("key")), "key", 120)


@query("""SELECT customer, supplier, n_rows, round(CASE WHEN n_rows = 1 THEN best ELSE least(0.99, 1 - miss) END, 6) AS confidence FROM (SELECT customer, supplier, CAST(sum(n) AS BIGINT) AS n_rows, max(c) AS best, product(1 - c) AS miss FROM (
 SELECT o_custkey AS customer, l_suppkey AS supplier, l_linenumber % 3 AS det, max(round(0.40 + ((l_partkey * 31 + l_suppkey * 17 + l_linenumber * 7) % 60) / 100.0, 2)) AS c, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL) GROUP BY customer, supplier)""")
def F1_fuse_bridge(spark: SparkSession, d: str) -> DataFrame:
    """Noisy-or fusion of customer and supplier pairs with the line number as the detector."""
    li, o = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), table(spark, d, "orders", "o_orderkey", "o_custkey")
    conf = F.round(F.lit(0.40) + ((F.col("l_partkey") * 31 + F.col("l_suppkey") * 17 + F.col("l_linenumber") * 7) % 60) / 100.0, 2)
    e = li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("source_id"), F.lit("CALLS_SERVICE").alias("type"), F.col("l_suppkey").alias("target_id"), (F.col("l_linenumber") % 3).cast("string").alias("detected_by"), conf.alias("confidence"))
    return graph.fuse(e).select(F.col("source_id").alias("customer"), F.col("target_id").alias("supplier"), "n_rows", F.round("confidence", 6).alias("confidence"))


@query("""SELECT lower(replace(replace(replace(p_name, '-', ''), '_', ''), '.', '')) AS squashed, 'pkg:' || CASE p_size % 3 WHEN 0 THEN 'npm' WHEN 1 THEN 'pypi' ELSE 'golang' END || '/' || CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN replace(lower(p_name), '_', '-') ELSE lower(p_name) END AS purl, count(*) AS n FROM part GROUP BY ALL""")
def C5_package_urls(spark: SparkSession, d: str) -> DataFrame:
    eco = F.when(F.col("p_size") % 3 == 0, "npm").when(F.col("p_size") % 3 == 1, "pip").otherwise("go")
    return table(spark, d, "part", "p_name", "p_size").groupBy(keys.squash(F.col("p_name")).alias("squashed"), keys.purl(eco, F.col("p_name")).alias("purl")).agg(F.count("*").alias("n"))


QUERIES, SQL = query.queries, query.sql
