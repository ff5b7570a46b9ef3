"""Join rules between claims of one kind: HTTP, gRPC, GraphQL, topics, datasets, environment, gateways, agents, owners.

Every rule takes DataFrames and gives rows with an `outcome`, so nothing is declined silently: matched, ambiguous (several
targets, none taken), fanout (more contracts than the cap), unmatched. Joins are equi-joins on final keys; prefix conditions
are exploded. Null keys match nothing; repeated claims count once; empty inputs give empty outputs; columns that a rule does
not name are dropped. Confidences are arguments with defaults, not part of the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.functions import keys
from claimweave.runtime import materialize

CAP = 32


def canonical(names: DataFrame, aliases: DataFrame, column: str = "name") -> DataFrame:
    """Names with their canonical form: one hop over (alias, canonical, rank), lowest rank wins, unknown names stay."""
    best = aliases.groupBy(F.lower("alias").alias("_alias")).agg(F.min_by("canonical", F.struct("rank", "canonical")).alias("_to"))
    return names.withColumn("_alias", F.lower(column)).join(best, "_alias", "left").withColumn("canonical", F.coalesce("_to", "_alias")).drop("_alias", "_to")


def same_repo_first(candidates: DataFrame, call: list[str]) -> DataFrame:
    """Where a call has candidates inside and outside of its repository, only those inside stay."""
    same = (F.col("repo_id") == F.col("provider_repo")).cast("int")
    w = Window.partitionBy(*call)
    return candidates.withColumn("_same", same).withColumn("_any", F.max("_same").over(w)).where("_same = _any").drop("_same", "_any")


#: Stands for "no service named" in the keys of calls and contracts.
ANY_SERVICE = "\u0001"


def match_http(calls: DataFrame, contracts: DataFrame, cap: int = CAP, exact: float = 0.95, template: float = 0.9) -> DataFrame:
    """Calls (call_id, repo_id, method, template, service or null) with contracts (contract_id, repo_id, method, template, service).

    Methods are equal or the contract takes ANY; templates are equal up to the names of their parameters; a named service
    must be the contract's. One row per matched contract, or one row per call that has none or too many.

    Contracts are grouped by key, and by key and repository, before they meet a call: counts, and lists where there are no
    more than `cap`. A call meets one row of either, so no call or key ever has more rows than the cap."""
    c = calls.select("call_id", "repo_id", keys.http_method(F.col("method")).alias("m"), F.col("template").alias("t"), F.coalesce("service", F.lit(ANY_SERVICE)).alias("s")).distinct()
    c = c.withColumn("p", keys.positional(F.col("t")))
    on = ["p", "m", "s"]
    own = contracts.select("contract_id", F.col("repo_id").alias("provider_repo"), keys.positional(F.col("template")).alias("p"), F.struct(F.upper("method").alias("m"), F.col("service").alias("s"), F.col("template").alias("t")).alias("row"))
    own = own.where(F.col("contract_id").isNotNull()).groupBy("p", "contract_id", "provider_repo").agg(F.collect_set("row").alias("rows"))
    own = materialize(own)
    every = own.groupBy("p", "contract_id").agg(F.min("provider_repo").alias("provider_repo"), F.flatten(F.collect_list("rows")).alias("rows"))
    listed = _listed(_by_key(every), on, cap).withColumnsRenamed({"n": "n_all", "l": "l_all"})
    inside = _listed(_by_key(own), [*on, "provider_repo"], cap).withColumnsRenamed({"n": "n_same", "l": "l_same", "provider_repo": "repo_id"})
    j = c.join(inside, [*on, "repo_id"], "left").join(listed, on, "left")
    n = F.coalesce("n_same", "n_all", F.lit(0)).cast("bigint")
    chosen = F.when(F.col("n_same").isNotNull(), F.col("l_same")).otherwise(F.col("l_all"))
    outcome = F.when(n == 0, "unmatched").when(n > cap, "fanout").otherwise("matched")
    rows = j.select("call_id", "repo_id", "t", n.alias("n_contracts"), outcome.alias("outcome"), F.explode_outer(chosen).alias("x"))
    conf = F.when(F.col("x").isNotNull(), F.when(F.array_contains("x.cts", F.col("t")), exact).otherwise(template))
    return rows.select("call_id", "repo_id", "x.contract_id", "x.provider_repo", conf.alias("confidence"), "n_contracts", "outcome")


def _by_key(own: DataFrame) -> DataFrame:
    """Contracts once for every method and service under which a call can ask for them, with the templates that apply."""
    methods = lambda r: F.when(r["m"] == "ANY", F.array(*[F.lit(x) for x in keys.METHODS])).otherwise(F.array(r["m"]))
    services = lambda r: F.array_compact(F.array(F.lit(ANY_SERVICE), r["s"]))
    asked = F.transform("rows", lambda r: F.flatten(F.transform(methods(r), lambda m: F.transform(services(r), lambda s: F.struct(m.alias("m"), s.alias("s"))))))
    rows = own.select("p", "contract_id", "provider_repo", "rows", F.inline(F.array_distinct(F.flatten(asked))))
    applies = lambda r: ((r["m"] == F.col("m")) | (r["m"] == "ANY")) & ((F.col("s") == ANY_SERVICE) | (r["s"] == F.col("s")))
    return rows.select("p", "m", "s", "contract_id", "provider_repo", F.transform(F.filter("rows", applies), lambda r: r["t"]).alias("cts"))


def _listed(rows: DataFrame, on: list[str], cap: int) -> DataFrame:
    """Per key the number of contracts (n) and, up to `cap` of them, the list l."""
    counted = rows.groupBy(*on).agg(F.count("*").alias("n"))
    few = rows.join(counted.where(F.col("n") <= cap), on, "left_semi")
    lists = few.groupBy(*on).agg(F.collect_list(F.struct("contract_id", "provider_repo", "cts")).alias("l"))
    return counted.join(lists, on, "left")


def match_grpc(stubs: DataFrame, operations: DataFrame, cap: int = CAP) -> DataFrame:
    """Client stubs (call_id, service) with operations (op_id, package, service, rpc): by full or bare service name.

    Operations are counted per name first; a stub of a name beyond the cap is declined from the count."""
    full = F.lower(F.concat_ws(".", F.nullif("package", F.lit("")), "service"))
    names = operations.select("op_id", F.explode(F.array_distinct(F.array(full, F.lower("service")))).alias("name")).distinct()
    counted = names.groupBy("name").agg(F.count("*").alias("per_name"))
    lists = names.join(counted.where(F.col("per_name") <= cap), "name", "left_semi").groupBy("name").agg(F.collect_list("op_id").alias("ops"))
    j = stubs.select("call_id", F.lower("service").alias("name")).distinct().join(counted.join(lists, "name", "left"), "name", "left")
    one = j.groupBy("call_id").agg(F.max("per_name").alias("most"), F.array_distinct(F.flatten(F.collect_list("ops"))).alias("ops"))
    outcome = F.when(F.col("most").isNull(), "unmatched").when((F.col("most") > cap) | (F.size("ops") > cap), "fanout").otherwise("matched")
    return one.select("call_id", F.explode_outer(F.when(outcome == "matched", F.col("ops"))).alias("op_id"), outcome.alias("outcome"))


def match_graphql(consumers: DataFrame, providers: DataFrame, federated: float = 0.95, field: float = 0.8) -> DataFrame:
    """Field uses (repo_id, key) with providers (repo_id, key, federated): keys fold case; a field that several repositories
    provide without federation divides the confidence by their number instead of declining."""
    p = providers.groupBy(F.lower("key").alias("k")).agg(F.count_distinct("repo_id").alias("n_repos"), F.bool_or(F.coalesce("federated", F.lit(False))).alias("fed"))
    repos = providers.select(F.lower("key").alias("k"), F.col("repo_id").alias("target_id")).distinct()
    c = consumers.select(F.col("repo_id").alias("source_id"), F.lower("key").alias("k")).distinct()
    conf = F.when(F.col("fed"), federated).when(F.col("n_repos") > 1, field / F.col("n_repos")).otherwise(field)
    return c.join(p, "k").join(repos, "k").select("source_id", "target_id", F.col("k").alias("key"), F.round(conf, 6).alias("confidence"))


def fold_topics(topics: DataFrame) -> DataFrame:
    """Keys `channel:name` of an unknown system become the one concrete system that uses the name; none or several keep it."""
    t = topics.withColumns({"_sys": F.substring_index("key", ":", 1), "_name": F.expr("substring(key, instr(key, ':') + 1)")})
    known = t.where("_sys <> 'channel'").groupBy("_name").agg(F.count_distinct("_sys").alias("_n"), F.min("_sys").alias("_only"))
    j = t.join(known, "_name", "left")
    return j.withColumn("key", F.when((F.col("_sys") == "channel") & (F.col("_n") == 1), F.concat_ws(":", "_only", "_name")).otherwise(F.col("key"))).drop("_sys", "_name", "_n", "_only")


def topic_edges(topics: DataFrame) -> DataFrame:
    """Publishing and consuming edges of folded topics: source_id, type, target_id, weight."""
    kind = F.when(F.col("direction") == "provides", "PUBLISHES_TO").otherwise("CONSUMES_FROM")
    return fold_topics(topics).groupBy(F.col("repo_id").alias("source_id"), kind.alias("type"), F.concat(F.lit("global:Topic:"), "key").alias("target_id")).agg(F.count("*").alias("weight"))


def indirect_topics(refs: DataFrame, values: DataFrame) -> DataFrame:
    """Topics named by a variable (ref_id, name) over configured values (name, value): one distinct value resolves."""
    v = values.where("value is not null").select("name", "value").distinct().groupBy("name").agg(F.count("*").alias("n"), F.min("value").alias("only"))
    j = refs.join(v, "name", "left")
    return j.select("ref_id", F.when(F.col("n") == 1, F.col("only")).alias("topic"), F.when(F.col("n").isNull(), "unmatched").when(F.col("n") > 1, "ambiguous").otherwise("matched").alias("outcome"))


def match_datasets(claims: DataFrame) -> DataFrame:
    """Readers and writers of datasets (repo_id, direction, key, declares): bare `table:` keys over several repositories need
    exactly one that declares them."""
    g = claims.groupBy("key").agg(F.count_distinct("repo_id").alias("n_repos"), F.count_distinct(F.when(F.col("declares"), F.col("repo_id"))).alias("n_declaring"), F.min(F.when(F.col("declares"), F.col("repo_id"))).alias("owner"))
    open_ = ~F.col("key").startswith("table:") | (F.col("n_repos") == 1) | (F.col("n_declaring") == 1)
    kind = F.when(F.col("direction") == "provides", "WRITES_TO").otherwise("READS_FROM")
    j = claims.select("repo_id", "direction", "key").distinct().join(g, "key")
    return j.select(F.col("repo_id").alias("source_id"), kind.alias("type"), "key", F.when(open_, F.concat(F.lit("global:Data:"), "key")).alias("target_id"), "owner", F.when(open_, "matched").otherwise("ambiguous").alias("outcome"))


def _single(rid: str, low: str, high: str, target: str, rows: DataFrame) -> DataFrame:
    """rid, target, outcome from the smallest and largest target of each row: equal ends are the one target."""
    g = rows.groupBy(rid).agg(F.min(low).alias("_lo"), F.max(high).alias("_hi"))
    outcome = F.when(F.col("_lo").isNull(), "unmatched").when(F.col("_lo") != F.col("_hi"), "ambiguous").otherwise("matched")
    return g.select(rid, F.when(outcome == "matched", F.col("_lo")).alias(target), outcome.alias("outcome"))


def env_calls(reads: DataFrame, values: DataFrame) -> DataFrame:
    """Reads of variables (read_id, repo_id, name) over values (repo_id, name, host): values of the own repository first; one
    distinct host resolves. Values are reduced per name, and per name and repository, before a read meets them."""
    ends = lambda p: (F.min("host").alias(f"{p}lo"), F.max("host").alias(f"{p}hi"))
    v = values.where("host is not null")
    j = reads.select("read_id", "repo_id", "name").distinct().join(v.groupBy("name", "repo_id").agg(*ends("s")), ["name", "repo_id"], "left").join(v.groupBy("name").agg(*ends("a")), "name", "left")
    own = j.groupBy("read_id").agg(F.min("slo").alias("slo"), F.max("shi").alias("shi"), F.min("alo").alias("alo"), F.max("ahi").alias("ahi"))
    near = F.col("slo").isNotNull()
    return _single("read_id", "lo", "hi", "host", own.select("read_id", F.when(near, F.col("slo")).otherwise(F.col("alo")).alias("lo"), F.when(near, F.col("shi")).otherwise(F.col("ahi")).alias("hi")))


def exactly_one(left: DataFrame, right: DataFrame, on: list[str], rid: str, target: str) -> DataFrame:
    """Left rows (rid) joined to right rows (target) on equal columns; only a single distinct target is taken. The rule of
    webhooks, of operations bound to HTTP routes and of event schemas. Targets are reduced per key before the join."""
    ends = right.where(F.col(target).isNotNull()).groupBy(*on).agg(F.min(target).alias("_a"), F.max(target).alias("_b"))
    return _single(rid, "_a", "_b", target, left.select(rid, *on).distinct().join(ends, on, "left"))


def match_tools(consumers: DataFrame, tools: DataFrame, cap: int = CAP) -> DataFrame:
    """Agent calls (call_id, server, tool or `*`) with tools (server, tool, repo_id): a server in several repositories
    declines; `*` fans out to all its tools up to the cap."""
    servers = tools.groupBy("server").agg(F.count_distinct("repo_id").alias("n_repos"), F.count_distinct("tool").alias("n_tools"))
    c = consumers.select("call_id", "server", F.col("tool").alias("want")).distinct().join(servers, "server", "left")
    t = tools.select("server", "tool").distinct()
    one = F.when(F.col("n_repos").isNull(), "unmatched").when(F.col("n_repos") > 1, "ambiguous").when((F.col("want") == "*") & (F.col("n_tools") > cap), "fanout").otherwise("matched")
    j = c.withColumn("o", one).join(t, "server", "left").where((F.col("o") != "matched") | (F.col("want") == "*") | (F.col("want") == F.col("tool")))
    hit = j.select("call_id", F.when(F.col("o") == "matched", F.col("tool")).alias("tool"), F.col("o").alias("outcome")).distinct()
    missed = c.select("call_id").distinct().join(hit, "call_id", "left_anti").select("call_id", F.lit(None).cast("string").alias("tool"), F.lit("unmatched").alias("outcome"))
    return hit.unionByName(missed)


def longest_prefix(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """Route rule of each call (call_id, repo_id, path) among (prefix, target, repo_id): the longest raw prefix wins, rules of
    the caller's repository first where both exist, several targets decline. Prefixes of the path are exploded by character,
    so the theta join is an equi-join with the (few) route prefixes."""
    ups = calls.select("call_id", "repo_id", "path", F.explode(F.sequence(F.lit(1), F.greatest(F.length("path"), F.lit(1)))).alias("n")).select("call_id", "repo_id", F.expr("substring(path, 1, n)").alias("prefix"))
    hit = ups.join(routes.select("prefix", "target", F.col("repo_id").alias("provider_repo")).distinct(), "prefix")
    best = hit.withColumn("_r", F.rank().over(Window.partitionBy("call_id").orderBy(F.length("prefix").desc()))).where("_r = 1")
    g = same_repo_first(best, ["call_id"]).groupBy("call_id").agg(F.count_distinct("target").alias("n"), F.min("target").alias("only"), F.max("prefix").alias("prefix"))
    out = calls.select("call_id").distinct().join(g, "call_id", "left")
    return out.select("call_id", "prefix", F.when(F.col("n") == 1, F.col("only")).alias("target"), F.when(F.col("n").isNull(), "unmatched").when(F.col("n") > 1, "ambiguous").otherwise("matched").alias("outcome"))


def gateway_chain(calls: DataFrame, routes: DataFrame, hops: int = 3) -> DataFrame:
    """Calls (call_id, gateway, path) through routes (gateway, prefix, strip, target) until a target that is no gateway.

    `strip` says whether the matched prefix is cut. Result per call: service, path, hops, outcome (landed, ambiguous, cycle,
    too_deep, unmatched). The hops are unrolled; the gateways seen are carried, so a cycle ends."""
    gates = routes.select(F.col("gateway").alias("g")).distinct()
    state = calls.select("call_id", F.col("gateway").alias("at"), "path", F.array("gateway").alias("seen"), F.lit(0).alias("hops"), F.lit("open").alias("outcome"))
    for _ in range(hops + 1):
        open_ = state.where("outcome = 'open'")
        hit = open_.join(routes, (F.col("at") == F.col("gateway")) & F.startswith("path", F.col("prefix")))
        best = hit.withColumn("_r", F.rank().over(Window.partitionBy("call_id").orderBy(F.length("prefix").desc()))).where("_r = 1")
        g = best.groupBy("call_id").agg(F.count_distinct("target").alias("n"), F.min("target").alias("to"), F.max("prefix").alias("pre"), F.bool_or("strip").alias("cut"))
        nxt = open_.join(g, "call_id", "left").join(gates.withColumnRenamed("g", "to").withColumn("is_gate", F.lit(True)), "to", "left")
        cut = F.concat(F.lit("/"), F.ltrim(F.expr("substring(path, length(pre) + 1)"), F.lit("/")))
        path = F.when(F.col("cut"), cut).otherwise(F.col("path"))
        outcome = (
            F.when(F.col("n").isNull(), "unmatched").when(F.col("n") > 1, "ambiguous").when(F.array_contains("seen", F.col("to")), "cycle").when(F.col("hops") >= hops, "too_deep").when(F.col("is_gate"), "open").otherwise("landed")
        )
        moved = nxt.select("call_id", F.coalesce("to", "at").alias("at"), F.when(outcome.isin("open", "landed"), path).otherwise(F.col("path")).alias("path"), F.when(outcome == "open", F.array_append("seen", F.col("to"))).otherwise(F.col("seen")).alias("seen"), F.when(outcome.isin("open", "landed"), F.col("hops") + 1).otherwise(F.col("hops")).alias("hops"), outcome.alias("outcome"))
        state = materialize(state.where("outcome <> 'open'").unionByName(moved))
    return state.select("call_id", F.when(F.col("outcome") == "landed", F.col("at")).alias("service"), "path", F.col("hops").cast("bigint").alias("hops"), F.when(F.col("outcome") == "open", "too_deep").otherwise(F.col("outcome")).alias("outcome"))


def config_target(calls: DataFrame, reads: DataFrame) -> DataFrame:
    """Service of a call without a hint (call_id, repo_id, path, base_var) from configuration read in the deepest directory
    above it (reads: repo_id, path, name, service). One service decides, else the variable that the call names."""
    parts = F.split(F.regexp_replace("path", "/?[^/]*$", ""), "/")
    dirs = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.when(k == 0, "").otherwise(F.array_join(F.slice(parts, 1, F.greatest(k, F.lit(1))), "/")).alias("dir")))
    up = calls.select("call_id", "repo_id", "base_var", F.inline(dirs)).distinct()
    here = reads.select("repo_id", F.regexp_replace("path", "/?[^/]*$", "").alias("dir"), "name", "service").distinct()
    hit = up.join(here, ["repo_id", "dir"])
    deep = hit.withColumn("_d", F.max("depth").over(Window.partitionBy("call_id"))).where("depth = _d")
    g = deep.groupBy("call_id").agg(F.count_distinct("service").alias("n"), F.min("service").alias("only"), F.count_distinct(F.when(F.col("name") == F.col("base_var"), F.col("service"))).alias("nv"), F.min(F.when(F.col("name") == F.col("base_var"), F.col("service"))).alias("var_only"))
    out = calls.select("call_id").distinct().join(g, "call_id", "left")
    service = F.when(F.col("n") == 1, F.col("only")).when(F.col("nv") == 1, F.col("var_only"))
    return out.select("call_id", service.alias("service"), F.when(F.col("n").isNull(), "unmatched").when(service.isNull(), "ambiguous").otherwise("matched").alias("outcome"))


def service_clusters(provided: DataFrame) -> DataFrame:
    """Identities of service names over scopes (name, scope, repo_id): scopes of a name merge when a repository provides it in
    both. One cluster keeps the bare name, several are named `scope/name`: name, scope, service_id."""
    from claimweave.operators.traverse import components

    node = F.concat_ws("\u0001", "name", "scope")
    p = provided.select("name", "scope", "repo_id", node.alias("a")).distinct()
    hub = F.concat_ws("\u0001", "name", F.lit("\u0002repo"), "repo_id")
    comp = components(p.select("a", hub.alias("b")))
    named = p.select("name", "scope", "a").distinct().join(comp.withColumnRenamed("node", "a"), "a")
    first = named.groupBy("name", "component").agg(F.min("scope").alias("first_scope"))
    n = named.groupBy("name").agg(F.count_distinct("component").alias("n"))
    j = named.join(first, ["name", "component"]).join(n, "name")
    return j.select("name", "scope", F.when((F.col("n") > 1) | keys.is_generic(F.col("name")), F.concat_ws("/", "first_scope", "name")).otherwise(F.col("name")).alias("service_id"))


def alias_suggestions(hints: DataFrame, services: DataFrame, most: int = 3) -> DataFrame:
    """Unmatched hints (hint, n) against service names in equal squashed, suffix-free or first-label form: hint, n,
    candidates, outcome (suggested, ambiguous, none)."""
    forms = lambda c: F.array_distinct(F.array(keys.squash(c), keys.bare_name(c), keys.bare_name(F.substring_index(c, ".", 1))))
    s = services.select("name", F.explode(forms(F.col("name"))).alias("form")).where("form <> ''").distinct()
    # The first names of a form are enough: what is shown, one that may be the hint itself, and one more.
    first = s.withColumn("_r", F.row_number().over(Window.partitionBy("form").orderBy("name"))).where(F.col("_r") <= most + 2)
    first = first.groupBy("form").agg(F.collect_list("name").alias("names"))
    h = hints.select("hint", "n", F.explode(forms(F.col("hint"))).alias("form")).where("form <> ''").distinct()
    g = h.join(first, "form").select("hint", F.explode("names").alias("name")).where("hint <> name").groupBy("hint").agg(F.array_sort(F.collect_set("name")).alias("c"))
    j = hints.select("hint", "n").distinct().join(g, "hint", "left")
    return j.select("hint", "n", F.array_join(F.slice(F.coalesce("c", F.array().cast("array<string>")), 1, most), ",").alias("candidates"), F.when(F.col("c").isNull(), "none").when(F.size("c") == 1, "suggested").otherwise("ambiguous").alias("outcome"))


def owners(claims: DataFrame) -> DataFrame:
    """Ownership edges, once per repository and team (the best confidence, then the first evidence)."""
    return claims.groupBy(F.col("repo_id").alias("source_id"), F.concat(F.lit("global:Team:"), F.lower("team")).alias("target_id")).agg(F.max("confidence").alias("confidence"), F.min("evidence").alias("evidence"))


def vendors(hosts: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Vendor of external hosts (host) by the longest suffix of (suffix, vendor). Suffixes of the host are exploded by label."""
    labels = F.split(F.lower("host"), r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    x = hosts.select("host", F.explode(tails).alias("suffix")).distinct()
    best = x.join(catalogue, "suffix").groupBy("host").agg(F.max_by("vendor", F.struct(F.length("suffix"), "vendor")).alias("vendor"))
    return hosts.select("host").distinct().join(best, "host", "left").select("host", "vendor", F.when(F.col("vendor").isNotNull(), "vendor").when(keys.looks_external(F.col("host")), "external").otherwise("internal").alias("kind"))


def skew_plan(left: DataFrame, right: DataFrame, key: str, workers: int, most: int = 64) -> DataFrame:
    """How a join would be split: per key rows of both sides, whether it is hot, and in how many pieces the larger side goes
    while the smaller is replicated. AQE does the same at run time; this reports it."""
    l, r = left.groupBy(key).agg(F.count("*").alias("n_left")), right.groupBy(key).agg(F.count("*").alias("n_right"))
    j = l.join(r, key)
    total = j.agg(F.sum(F.col("n_left") + F.col("n_right")).alias("total")).withColumn("one", F.lit(1))
    fair = F.greatest(F.lit(1), F.floor(F.col("total") / workers))
    j = j.withColumn("one", F.lit(1)).join(F.broadcast(total), "one")
    larger = F.greatest("n_left", "n_right")
    return j.select(key, "n_left", "n_right", (larger > fair).cast("bigint").alias("hot"), F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(larger / fair))).cast("bigint").alias("pieces"))
