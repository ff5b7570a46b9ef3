"""Hits of the extractors to claims, in the shape that a link run takes: one expression per slot, no shuffle but for selectors.

A hit (repo_id, path, slot, line, a, b, c) becomes at most one claim; slots without a rule give none. The site of a claim is
its file node. Blank parts count as null; claims whose key is null or blank are dropped here, those with variables when
they are linked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions import keys

#: Method words of route helpers that take any method (fixed values).
ANY_METHOD = ("ALL", "USE", "ANY", "ROUTE", "HANDLE", "HANDLEFUNC", "REQUEST", "EXCHANGE")
#: Calls of Spring's client by the method that they send (fixed values).
CLIENT_CALLS = {"GETFOROBJECT": "GET", "GETFORENTITY": "GET", "POSTFOROBJECT": "POST", "POSTFORENTITY": "POST"}
WORKLOADS = ("Deployment", "StatefulSet", "DaemonSet", "CronJob", "Job", "ReplicaSet", "Pod")

def _part(c: str) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _method(c: Column) -> Column:
    up = F.upper(c)
    named = F.when(up.isin(*ANY_METHOD), "ANY")
    for word, method in CLIENT_CALLS.items():
        named = named.when(up == word, method)
    return named.otherwise(F.when(up.isNull(), "GET").otherwise(up))


def _http(method: Column, path: Column) -> Column:
    return F.concat(_method(method), F.lit(":"), keys.path_template(F.coalesce(path, F.lit("/"))))


def _host(url: Column) -> Column:
    """Service that an absolute URL names; null for relative ones."""
    return keys.bare_host(keys.url_class(url)["host"])


def _table(name: Column) -> Column:
    return F.concat(F.lit("table:"), F.lower(name))


def _rules() -> list[tuple[Column, str, str, Column, Column | None, dict[str, Column]]]:
    """Condition, kind, direction, key, hint, attributes."""
    a, b, c = _part("a"), _part("b"), _part("c")
    slot = lambda *names: F.col("slot").isin(*names)
    lit = F.lit
    lock = F.lower(F.substring_index("path", "/", -1))
    eco = F.when(a.isNotNull(), a).when(lock == "cargo.lock", "cargo").when(lock == "poetry.lock", "pypi").otherwise("npm")
    operation = F.concat(F.initcap(F.coalesce(a, lit("query"))), lit("."), b)
    system = F.when(F.lower(a).contains("kafka"), "kafka").otherwise("channel")
    return [
        (slot("compose_service"), "svcname", "provides", F.concat(lit("default:"), a), None, {"source": lit("compose"), "build_context": c}),
        (slot("compose_dependency"), "svcname", "consumes", F.concat(lit("default:"), b), None, {"from": a}),
        (slot("compose_env"), "env", "provides", b, a, {"value": c}),
        (slot("k8s") & F.col("a").isin(*WORKLOADS), "svcname", "provides", F.concat_ws(":", b, c), None, {"source": lit("k8s"), "scope": b, "namespace": b, "workload": c, "workload_kind": a}),
        (slot("k8s") & (F.col("a") == "Service"), "svcname", "provides", F.concat_ws(":", b, c), None, {"source": lit("k8s_service"), "scope": b, "namespace": b}),
        (slot("k8s_env") & ~F.startswith("c", lit("ref:")), "env", "provides", b, a, {"value": c}),
        (slot("gateway"), "route", "provides", a, None, {"target": F.lower(F.substring_index(b, ":", 1)), "strip": c}),
        (slot("k8s_route"), "route", "provides", b, None, {"target": c, "service": F.nullif(keys.bare_host(a), lit(""))}),
        (slot("route"), "http", "provides", _http(a, b), None, {}),
        (slot("declared"), "http", "provides", _http(a, b), None, {"source": lit("openapi"), "deprecated": c}),
        (slot("http_call"), "http", "consumes", F.concat(lit("httpcall:"), _http(a, b)), _host(b), {"ui": F.when(F.col("path").rlike(r"\.[jt]sx$|\.vue$|(^|/)(ui|frontend|web)/"), "true")}),
        (slot("webhook"), "webhook", "consumes", _http(lit("POST"), b), _host(b), {}),
        (slot("publish"), "topic", "provides", F.concat_ws(":", system, b), None, {}),
        (slot("consume"), "topic", "consumes", F.concat_ws(":", system, b), None, {}),
        (slot("channel"), "topic", "provides", F.concat(lit("channel:"), a), None, {"declared": lit("true")}),
        (slot("rpc"), "grpcop", "provides", F.concat_ws("/", a, b), None, {"package": F.nullif(F.regexp_replace(a, r"\.?[^.]*$", ""), lit(""))}),
        (slot("grpc_server"), "grpcstub", "provides", a, None, {}),
        (slot("grpc_stub"), "grpcstub", "consumes", a, None, {}),
        (slot("field"), "gql", "provides", F.concat_ws(".", a, b), None, {"federated": c}),
        (slot("graphql_use"), "gql", "consumes", operation, None, {}),
        (slot("table", "model"), "dataset", "provides", _table(F.coalesce(F.when(slot("table"), b), a)), None, {"tier": lit("declared")}),
        (slot("sql") & F.col("a").isin("create", "alter"), "dataset", "provides", _table(b), None, {"tier": lit("declared")}),
        (slot("sql") & F.col("a").isin("write"), "dataset", "provides", _table(b), None, {}),
        (slot("sql") & F.col("a").isin("read"), "dataset", "consumes", _table(b), None, {}),
        (slot("source_table"), "dataset", "consumes", _table(F.concat_ws(".", a, b)), None, {}),
        (slot("bucket"), "dataset", "consumes", F.concat(lit("bucket:"), F.lower(b)), None, {}),
        (slot("spark_io") & F.col("a").isin("saveAsTable", "insertInto"), "dataset", "provides", _table(b), None, {}),
        (slot("spark_io") & F.col("a").isin("table", "parquet"), "dataset", "consumes", _table(b), None, {}),
        (slot("dependency"), "lib", "consumes", keys.purl(a, b), None, {"version": c}),
        (slot("locked"), "lib", "consumes", keys.purl(eco, b), None, {"version": c, "lock": lit("true")}),
        (slot("publish_identity"), "lib", "provides", keys.purl(a, b), None, {"private": c}),
        (slot("mcp_tool"), "mcpop", "provides", F.concat_ws("/", F.concat(lit("mcp:"), a), b), None, {"server": a, "tool": F.concat_ws("/", F.concat(lit("mcp:"), a), b)}),
        (slot("entity") & c.isNotNull(), "owner", "provides", c, None, {"team": F.substring_index(F.regexp_replace(c, "^[^:]*:", ""), "/", -1), "tier": lit("catalog"), "entity": b}),
        (slot("owner"), "owner", "provides", b, None, {"team": b, "tier": lit("codeowners")}),
        (slot("env"), "cfgread", "consumes", F.coalesce(a, b), None, {}),
    ]


def claims_of_hits(hits: DataFrame) -> DataFrame:
    """Claims of all hits that have a rule, and one claim per service that selects workloads."""
    kind = direction = key = hint = attrs = None
    nothing = F.lit(None).cast("string")
    for when, k, d, value, service, extra in _rules():
        pairs = [x for name, c in extra.items() for x in (F.lit(name), c.cast("string"))]
        made = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
        service = nothing if service is None else service
        if kind is None:
            kind, direction, key, hint, attrs = F.when(when, k), F.when(when, d), F.when(when, value), F.when(when, service), F.when(when, made)
        else:
            kind, direction, key, hint, attrs = kind.when(when, k), direction.when(when, d), key.when(when, value), hint.when(when, service), attrs.when(when, made)
    rows = hits.select("repo_id", kind.alias("kind"), direction.alias("direction"), key.alias("key"), hint.alias("hint"), "path", F.col("line").cast("int").alias("line"), attrs.alias("attrs"))
    chosen = hits.where("slot = 'k8s_selector'").groupBy("repo_id", "path", "a").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("=", "b", "c"))), ",").alias("selector"), F.min("line").cast("int").alias("line"))
    chosen = chosen.select("repo_id", F.lit("svcname").alias("kind"), F.lit("provides").alias("direction"), F.concat(F.lit("default:"), "a").alias("key"), nothing.alias("hint"), "path", "line", F.create_map(F.lit("source"), F.lit("k8s_service"), F.lit("selector"), F.col("selector")).alias("attrs"))
    out = rows.unionByName(chosen).where("kind is not null and trim(key) <> ''")
    rid = keys.claim_id(F.col("repo_id"), F.col("kind"), F.col("direction"), F.col("key"), F.concat_ws(":", "path", F.col("line").cast("string")), F.coalesce("hint", F.lit("")))
    node = keys.node_id(F.col("repo_id"), F.lit("File"), F.col("path"), F.lit(None).cast("string"))
    return out.select(rid.alias("id"), "repo_id", "kind", "direction", "key", "hint", "path", "line", "attrs", node.alias("node_id"))


def claims_of_tables(docker: DataFrame, k8s: DataFrame) -> DataFrame:
    """Claims of container definitions and workload records that are tables already."""
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    hit = lambda df, slot, a, b, c: df.select("repo_id", F.col("file_path").alias("path"), F.lit(slot).alias("slot"), F.coalesce("line", F.lit(1)).alias("line"), a.alias("a"), b.alias("b"), c.alias("c"))
    none = F.lit("")
    d = docker.where(text("name").isNotNull())
    parts = [
        hit(d, "compose_service", F.lower(text("name")), F.coalesce("image", none), F.when(F.col("image").isNull(), ".").otherwise("")),
        hit(d.withColumn("x", F.explode("depends_on")), "compose_dependency", F.lower(text("name")), F.lower(F.trim("x")), none),
        hit(d.select("*", F.explode("env_pairs").alias("k", "v")), "compose_env", F.lower(text("name")), F.col("k"), F.coalesce("v", none)),
    ]
    w = k8s.where(text("name").isNotNull()).withColumn("ns", F.coalesce(text("namespace"), F.lit("default")))
    e = w.select("repo_id", "file_path", "line", "name", F.explode("containers").alias("x")).select("repo_id", "file_path", "line", "name", F.explode("x.env").alias("e")).where("e.source = 'literal'")
    parts += [hit(w, "k8s", F.col("kind"), F.col("ns"), F.lower(text("name"))), hit(e, "k8s_env", F.lower(text("name")), F.col("e.name"), F.coalesce("e.value", none))]
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    return claims_of_hits(hits)
