"""A link run: claims to edges, through all rules, as one composition of plans.

Claims have the columns of CLAIMS. Phases: services and their scopes; calls brought to their final keys (hint, then
configuration above the file, then gateways); join rules; names to services; rollups; fusion, floor and decisions. Keys are final
before the joins begin, so every join is an equi-join whose provider side is reduced per key first. Frames that several
rules read are written once; the rules themselves run when the caller asks for the edges.

Attributes (map of text; lists are sorted and joined by commas)
* svcname: scope, source, build_context, workload, workload_kind, namespace, labels, selector, from, default
* env: scope, value; cfgread: none; http: ui, base_var, source; route: service, target, strip, dev; grpcop: package, http_method, http_path, output
* grpcstub: none; gql: federated; topic: declared, subscriber, schema; dataset: tier; lib: ecosystem, private, lock, url
* mcpop, a2aop: server, tool, agent, skill, url; policy: namespace, target_selector, source_kind, source_ref, action
* declared: source_repo; owner: team, tier, entity; webhook: none

Defined cases: claims with an equal id count once; null or blank keys and keys with variables match nothing; several possible
targets decline; self calls give no edge; empty claims give empty edges; further columns are not read.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions import keys
from claimweave.operators import graph, hubs, resolve, resolvers
from claimweave.operators.control import CORRELATED, Control
from claimweave.runtime import materialize, noted, together

CLAIMS = "id string, repo_id string, kind string, direction string, key string, hint string, path string, line int, attrs map<string,string>, node_id string"
EDGES = ("source_id", "source_label", "type", "target_id", "target_label", "source_repo", "target_repo", "confidence", "match_type", "via", "evidence", "claim_key", "detected_by")
#: Sources of a service name that names the service of its own file, and those that name another one (fixed values).
OWNING = ("spring.application.name", "otel-env")
REFERENCING = ("config-filename", "prometheus-job")
#: Kinds of claims, and the rules that need one of some kinds to give anything.
KINDS = ("svcname", "env", "cfgread", "http", "route", "grpcop", "grpcstub", "gql", "topic", "dataset", "lib", "mcpop", "a2aop", "policy", "declared", "owner", "webhook")
NEEDS = {
    "members": "svcname", "env_hosts": "env", "policies": "policy", "gitops": "declared", "built_from": "svcname", "modules": "svcname", "deployments": "svcname", "compose": "svcname", "libraries": "lib", "gateways": "route",
    "grpc": "grpcop grpcstub", "http": "http", "graphql": "gql", "env_reads": "cfgread", "topics": "topic", "webhooks": "webhook", "same_operations": "grpcop", "datasets": "dataset", "agents": "mcpop a2aop", "ownership": "owner",
}


def service_node(name: Column) -> Column:
    return keys.rendezvous_id(F.lit("Service"), name)


class Linker:
    def __init__(self, claims: DataFrame, control: Control | None = None):
        self.control = control or Control()
        self.spark = claims.sparkSession
        c = claims.select(*[x.split()[0] for x in CLAIMS.split(", ")]).dropDuplicates(["id"])
        self.claims = materialize(c.where(resolve.matchable(F.col("key"))), **{k: F.count_if(F.col("kind") == k) for k in KINDS})
        #: Kinds of which there are claims: rules and steps of other kinds need not run.
        self.kinds = {k for k in KINDS if noted(self.claims, k)}
        self.conf = self.control.conf

    # Parts of claims

    def of(self, kind: str, direction: str) -> DataFrame:
        rows = self.claims.where((F.col("kind") == kind) & (F.col("direction") == direction))
        return rows.withColumn("evidence", F.concat_ws(":", "path", F.col("line").cast("string")))

    def edge(self, rows: DataFrame, detector: str, kind: str, source: Column, source_label: str, target: Column, target_label: str, conf, match: str, via: str | None = None, source_repo=None, target_repo=None) -> DataFrame:
        """Edge rows; ends that are null or equal give none."""
        text = lambda c: F.lit(None).cast("string") if c is None else F.col(c) if isinstance(c, str) else c
        out = rows.select(
            source.alias("source_id"), F.lit(source_label).alias("source_label"), F.lit(kind).alias("type"), target.alias("target_id"), F.lit(target_label).alias("target_label"),
            text(source_repo).alias("source_repo"), text(target_repo).alias("target_repo"), (conf if isinstance(conf, Column) else F.lit(conf)).cast("double").alias("confidence"), F.lit(match).alias("match_type"),
            F.lit(via or match).alias("via"), (F.col("evidence") if "evidence" in rows.columns else F.lit(None).cast("string")).alias("evidence"),
            (F.col("key") if "key" in rows.columns else F.lit(None).cast("string")).alias("claim_key"), F.lit(detector).alias("detected_by"),
        )
        return out.where("source_id is not null and target_id is not null and source_id <> target_id")

    # Services, names and scopes

    def canonical(self, rows: DataFrame, column: str) -> DataFrame:
        """Rows with the canonical form of a name; without aliases there is nothing to join."""
        if not self.control.aliases:
            return rows.withColumn("canonical", F.lower(column))
        return resolvers.canonical(rows, F.broadcast(self.control.alias_frame(self.spark)), column)

    @cached_property
    def names(self) -> DataFrame:
        """Provided service names: id, repo_id, scope, name (canonical), attrs, path, evidence, key."""
        p = self.of("svcname", "provides").withColumn("raw", F.substring_index("key", ":", -1))
        scope = F.lower(F.coalesce(F.nullif(F.trim(F.col("attrs")["scope"]), F.lit("")), F.lit("default")))
        out = self.canonical(p.withColumn("scope", scope), "raw")
        return materialize(out.withColumn("name", F.col("canonical")).drop("canonical", "raw"))

    @cached_property
    def services(self) -> DataFrame:
        """name, scope, service_id (node id)."""
        s = resolvers.service_clusters(self.names.select("name", "scope", "repo_id"))
        return materialize(s.select("name", "scope", service_node(F.col("service_id")).alias("service_id")))

    @cached_property
    def by_name(self) -> DataFrame:
        """name, service_id: the first service of a name; `scope/name` names one exactly."""
        bare = self.services.groupBy("name").agg(F.min("service_id").alias("service_id"))
        exact = self.services.select(F.substring_index("service_id", ":", -1).alias("name"), "service_id").distinct()
        return materialize(bare.unionByName(exact.join(bare, "name", "left_anti")))

    def service_of(self, rows: DataFrame, column: str, out: str) -> DataFrame:
        """Rows with the service that the name in `column` stands for (null where none was minted)."""
        low = rows.withColumn("_n", F.lower(F.trim(column)))
        named = self.canonical(low, "_n").drop("_n")
        return named.join(self.by_name.select(F.col("name").alias("canonical"), F.col("service_id").alias(out)), "canonical", "left").drop("canonical")

    @cached_property
    def scopes(self) -> DataFrame:
        """Directories that belong to a service: repo_id, prefix, owner (name); of several claims of a directory only those
        of the highest rank count. Rank 2: the build context; 1: the file's own service; 0: the whole repository."""
        context, source = F.col("attrs")["build_context"], F.coalesce(F.col("attrs")["source"], F.lit(""))
        folder = F.regexp_replace("path", "/?[^/]*$", "")
        joined = F.concat_ws("/", folder, F.trim(context))
        depth = lambda c: F.size(F.filter(F.split(c, "/"), lambda s: ~s.isin("", ".", "..")))
        ups = F.size(F.filter(F.split(F.trim(context), "/"), lambda s: s == ".."))
        outside = ups > depth(folder)
        placed = self.names.where(~source.isin(*REFERENCING) | context.isNotNull()).select(
            "repo_id", "name",
            F.when(context.isNotNull(), F.when(outside, "").otherwise(keys.safe_path(joined))).when(source.isin(*OWNING), folder).otherwise("").alias("prefix"),
            F.when(context.isNotNull() & ~outside, 2).when(context.isNull() & source.isin(*OWNING), 1).otherwise(0).alias("rank"),
        )
        best = placed.groupBy("repo_id", "prefix").agg(F.max("rank").alias("rank"))
        return materialize(placed.join(best, ["repo_id", "prefix", "rank"]).select("repo_id", "prefix", F.col("name").alias("owner")).distinct())

    @cached_property
    def sites(self) -> DataFrame:
        """The service of every file that a claim cites: repo_id, path, site_service."""
        at = self.claims.where("path is not null").select("repo_id", "path").distinct().withColumn("item", F.concat_ws("\u0001", "repo_id", "path"))
        owner = resolve.prefix_owner(at, self.scopes).where("owner is not null")
        named = at.join(owner, "item").join(self.by_name.withColumnRenamed("name", "owner"), "owner")
        return materialize(named.select("repo_id", "path", F.col("service_id").alias("site_service")))

    def at_site(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.sites, ["repo_id", "path"], "left")

    @cached_property
    def service_repos(self) -> DataFrame:
        """service_id, repo_id from the repositories that services are built from."""
        both = [self.built_from(), *([self.gitops()] if "declared" in self.kinds else [])]
        pairs = [x.select(F.col("source_id").alias("service_id"), F.col("target_id").alias("repo_id")) for x in both]
        return materialize(reduce(DataFrame.unionByName, pairs).distinct())

    @cached_property
    def sole_repo(self) -> DataFrame:
        """service_id, repo: only services of exactly one repository."""
        g = self.service_repos.groupBy("service_id").agg(F.min("repo_id").alias("repo"), F.max("repo_id").alias("hi"))
        return g.where("repo = hi").select("service_id", "repo")

    def _minted(self) -> DataFrame:
        return self.names.join(self.services, ["name", "scope"])

    # Identity (r0)

    def aliases(self) -> DataFrame:
        one = self._minted().groupBy("service_id", "scope", "name").agg(F.min("evidence").alias("evidence"))
        name = keys.rendezvous_id(F.lit("ServiceName"), F.concat_ws(":", "scope", "name"))
        has = self.edge(one, "alias", "HAS_ALIAS", F.col("service_id"), "Service", name, "ServiceName", self.conf("r0", "has_alias"), "alias")
        resolved = self.edge(self.names, "alias", "RESOLVED_TO", F.col("id"), "ContractClaim", name, "ServiceName", self.conf("r0", "resolved_to"), "alias", source_repo="repo_id")
        return has.unionByName(resolved)

    def built_from(self) -> DataFrame:
        """The best tier of each service and repository."""
        source = F.col("attrs")["source"]
        tier = F.when(F.col("attrs")["build_context"].isNotNull(), "build_context").when(source == "spring.application.name", "app_name").when(source.isin("compose", "k8s"), "descriptor")
        price = reduce(lambda acc, t: acc.when(F.col("tier") == t, self.conf("r0", f"built_from_{t}")), ("build_context", "app_name", "descriptor"), F.when(F.lit(False), 0.0))
        rows = self._minted().withColumn("tier", tier).where("tier is not null").withColumn("price", price)
        best = rows.groupBy("service_id", "repo_id").agg(F.max_by(F.struct("tier", "price", "evidence", "key"), F.struct("price", F.concat_ws(":", "evidence", "key"))).alias("b"))
        return self.edge(best.select("service_id", "repo_id", "b.*"), "alias", "BUILT_FROM", F.col("service_id"), "Service", F.col("repo_id"), "Repo", F.col("price"), "alias", target_repo="repo_id")

    def modules(self) -> DataFrame:
        """BELONGS_TO where all claims of a service lie in one module."""
        m = self._minted().withColumn("module", keys.module_of(F.col("path"))).where("module <> ''").groupBy("service_id").agg(F.min("module").alias("lo"), F.max("module").alias("hi"), F.min("repo_id").alias("repo_id"), F.max("repo_id").alias("other"), F.min("evidence").alias("evidence"))
        node = keys.rendezvous_id(F.lit("Module"), F.concat_ws(":", "repo_id", "lo"))
        return self.edge(m.where("lo = hi and repo_id = other"), "alias", "BELONGS_TO", F.col("service_id"), "Service", node, "Module", self.conf("r0", "belongs_to"), "module", source_repo="repo_id")

    def deployments(self) -> DataFrame:
        kind, work = F.col("attrs")["workload_kind"], F.col("attrs")["workload"]
        unit = keys.rendezvous_id(F.lit("DeploymentUnit"), F.lower(F.concat_ws("/", F.coalesce(F.col("attrs")["namespace"], F.lit("default")), kind, work)))
        return self.edge(self._minted().where(kind.isNotNull() & work.isNotNull()), "k8s", "DEPLOYED_AS", F.col("service_id"), "Service", unit, "DeploymentUnit", self.conf("r2", "deployed_as"), "manifest", source_repo="repo_id")

    # Topology (r1, r2)

    def compose(self) -> DataFrame:
        """Dependencies of container definitions on a name that some repository provides."""
        c = self.of("svcname", "consumes").where(F.col("attrs")["from"].isNotNull()).withColumn("to", F.substring_index("key", ":", -1)).withColumn("frm", F.col("attrs")["from"])
        j = self.service_of(self.service_of(c, "frm", "s"), "to", "t")
        source = F.coalesce(F.col("attrs")["source"], F.lit("depends_on"))
        conf = F.when(source == "env_host", F.when(F.col("attrs")["default"] == "true", self.conf("r1", "env_host_default")).otherwise(self.conf("r1", "env_host"))).otherwise(self.conf("r1", "depends_on"))
        j = j.join(self.sole_repo.select(F.col("service_id").alias("t"), F.col("repo").alias("t_repo")), "t", "left")
        return self.edge(j, "compose", "CALLS_SERVICE", F.col("s"), "Service", F.col("t"), "Service", conf, "compose", source_repo="repo_id", target_repo="t_repo")

    def members(self) -> DataFrame:
        """Selectors of services whose labels a workload has: claim to claim."""
        labels = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
        p = self.of("svcname", "provides").withColumn("ns", F.coalesce(F.col("attrs")["namespace"], F.lit("default")))
        want = p.where(F.col("attrs")["selector"].isNotNull()).withColumn("l", F.explode(F.array_distinct(labels(F.col("attrs")["selector"])))).select(F.col("id").alias("sel"), "ns", "l", F.size(F.array_distinct(labels(F.col("attrs")["selector"]))).alias("n"), "repo_id", "evidence", "key")
        have = p.where(F.col("attrs")["labels"].isNotNull()).select(F.col("id").alias("work"), "ns", F.explode(F.array_distinct(labels(F.col("attrs")["labels"]))).alias("l"))
        hit = want.join(have, ["ns", "l"]).groupBy("sel", "work", "n", "repo_id", "evidence", "key").agg(F.count("*").alias("m")).where("n = m")
        return self.edge(hit, "k8s", "MEMBER_OF", F.col("sel"), "ContractClaim", F.col("work"), "ContractClaim", self.conf("r2", "selector_match"), "selector", source_repo="repo_id")

    def env_hosts(self) -> DataFrame:
        """Workloads whose environment names the host of a service."""
        v = self.of("env", "provides").where(F.col("hint").isNotNull() & F.col("attrs")["value"].rlike("^[a-z]+://"))
        v = v.withColumn("host", keys.bare_host(keys.url_class(F.col("attrs")["value"])["host"]))
        j = self.service_of(self.service_of(v, "hint", "s"), "host", "t")
        return self.edge(j, "k8s", "CALLS_SERVICE", F.col("s"), "Service", F.col("t"), "Service", self.conf("r2", "env_host"), "k8s_env_host", source_repo="repo_id")

    def policies(self) -> DataFrame:
        """Who may talk to whom: policies whose selectors (or service account) name workloads of their namespace. Sources and
        targets of a policy are both few by its selectors; each is matched by counted labels, not by trying all pairs."""
        labels = lambda c: F.array_distinct(F.filter(F.split(c, ","), lambda x: x != ""))
        ns = lambda: F.lower(F.coalesce(F.col("attrs")["namespace"], F.lit("default")))
        pods = self.names.where(F.col("attrs")["labels"].isNotNull()).select(ns().alias("ns"), "name", F.explode(labels(F.col("attrs")["labels"])).alias("l")).distinct()
        p = self.of("policy", "provides").select("id", "repo_id", "key", "evidence", ns().alias("ns"), F.lower(F.coalesce(F.col("attrs")["action"], F.lit("ALLOW"))).alias("action"), F.col("attrs")["target_selector"].alias("to"), F.col("attrs")["source_kind"].alias("sk"), F.col("attrs")["source_ref"].alias("ref"))

        def matched(rows: DataFrame, column: str) -> DataFrame:
            want = rows.select("id", "ns", F.size(labels(F.col(column))).alias("n"), F.explode(labels(F.col(column))).alias("l"))
            return want.join(pods, ["ns", "l"]).groupBy("id", "name", "n").agg(F.count("*").alias("m")).where("n = m").select("id", "name")

        account = p.where("sk = 'service_account'").select("id", "ns", F.lower("ref").alias("name")).join(pods.select("ns", "name").distinct(), ["ns", "name"], "left_semi").select("id", "name")
        sources = account.unionByName(matched(p.where("coalesce(sk, '') <> 'service_account'"), "ref")).withColumnRenamed("name", "frm")
        j = p.join(sources, "id").join(matched(p, "to"), "id").where("frm <> name")
        j = self.service_of(self.service_of(j, "frm", "s"), "name", "t")
        out = self.edge(j.withColumn("via", F.concat(F.lit("mesh_policy_"), "action")), "k8s", "PERMITS_TRAFFIC", F.col("s"), "Service", F.col("t"), "Service", self.conf("r2", "policy"), "mesh_policy", source_repo="repo_id")
        return out

    def gitops(self) -> DataFrame:
        """Declared source repositories of deployed services, where the URL is one of a repository with claims."""
        d = self.of("declared", "provides").where(F.col("hint").isNotNull()).withColumn("repo", keys.git_repo(F.col("attrs")["source_repo"]))
        known = self.claims.select(F.col("repo_id").alias("repo")).distinct()
        j = self.service_of(d.join(known, "repo", "left_semi"), "hint", "s")
        return self.edge(j, "k8s", "BUILT_FROM", F.col("s"), "Service", F.col("repo"), "Repo", self.conf("r2", "built_from_gitops"), "gitops", target_repo="repo")

    # Libraries (r3), gateways (r4)

    def libraries(self) -> DataFrame:
        pub = self.of("lib", "provides").where(F.coalesce(F.col("attrs")["private"], F.lit("false")) != "true")
        use = self.of("lib", "consumes")
        node = keys.rendezvous_id(F.lit("Library"), F.col("key"))
        published = self.edge(pub, "library", "PUBLISHES", F.col("repo_id"), "Repo", node, "Library", self.conf("r3", "publishes"), "manifest", source_repo="repo_id")
        owner = pub.groupBy("key").agg(F.min("repo_id").alias("owner"), F.max("repo_id").alias("hi"))
        inside = [F.startswith(F.col("key"), F.concat(F.lit("pkg:"), F.lit(eco), F.lit("/"), F.lit(p))) for eco, p in self.control.namespaces]
        internal = reduce(lambda a, b: a | b, inside, F.lit(False))
        j = use.join(owner, "key", "left").where(F.col("owner").isNotNull() | internal)
        conf = F.when(F.col("attrs")["lock"] == "true", self.conf("r3", "lockfile_resolved")).otherwise(self.conf("r3", "manifest_declared"))
        depends = self.edge(j, "library", "DEPENDS_ON", F.col("repo_id"), "Repo", node, "Library", conf, "coordinate", source_repo="repo_id", target_repo=F.when(F.col("owner") == F.col("hi"), F.col("owner")))
        one = j.where("owner = hi and owner <> repo_id").withColumn("c", conf).groupBy("repo_id", "owner").agg(F.max("c").alias("c"), F.min("evidence").alias("evidence"))
        repos = self.edge(one, "library", "DEPENDS_ON_REPO", F.col("repo_id"), "Repo", F.col("owner"), "Repo", F.col("c"), "library", source_repo="repo_id", target_repo="owner")
        return published.unionByName(depends).unionByName(repos)

    @cached_property
    def routes(self) -> DataFrame:
        """Rewrite rules: gateway (service name), prefix, strip, target (service name), repo_id."""
        site = F.substring_index("site_service", ":", -1)
        r = self.at_site(self.of("route", "provides")).select(F.lower(F.coalesce(F.col("attrs")["service"], "hint", site)).alias("gateway"), F.col("key").alias("prefix"), (F.col("attrs")["strip"] == "true").alias("strip"), F.lower(F.col("attrs")["target"]).alias("target"), F.coalesce(F.col("attrs")["dev"], F.lit("false")).alias("dev"), "repo_id", "evidence")
        return materialize(r.where("target is not null"))

    def gateways(self) -> DataFrame:
        j = self.service_of(self.service_of(self.routes, "gateway", "s"), "target", "t")
        conf = F.when(F.col("dev") == "true", self.conf("r4", "route_dev")).otherwise(self.conf("r4", "route_declared"))
        return self.edge(j, "gateway", "ROUTES_TO", F.col("s"), "Service", F.col("t"), "Service", conf, "route", source_repo="repo_id")

    # Calls to their final keys

    @cached_property
    def calls(self) -> DataFrame:
        """HTTP calls with a service: id, repo_id, method, template, service (name), how (hint, config or gateway), hops, path, evidence, node_id, ui."""
        c = self.of("http", "consumes").withColumn("k", F.regexp_replace("key", "^httpcall:", ""))
        c = c.select("id", "repo_id", F.substring_index("k", ":", 1).alias("method"), F.expr("substring(k, instr(k, ':') + 1)").alias("template"), F.lower("hint").alias("hint"), F.col("attrs")["base_var"].alias("base_var"), F.coalesce(F.col("attrs")["ui"], F.lit("false")).alias("ui"), "path", "evidence", "node_id")
        c = materialize(c)
        open_ = c.where("hint is null")
        nothing = c.where("false").select("id")
        conf, gate = nothing.withColumn("from_config", F.lit("")), nothing.select("id", F.lit("").alias("prefix"), F.lit("").alias("from_gate"))
        if "env" in self.kinds:
            env = self.service_of(self.of("env", "provides").where(F.col("attrs")["value"].rlike("^[a-z]+://")).withColumn("host", keys.bare_host(keys.url_class(F.col("attrs")["value"])["host"])), "host", "sid").where("sid is not null")
            read = env.select("repo_id", "path", F.col("key").alias("name"), F.col("host").alias("service")).distinct()
            conf = resolvers.config_target(open_.select(F.col("id").alias("call_id"), "repo_id", "path", "base_var"), read).where("service is not null").select(F.col("call_id").alias("id"), F.col("service").alias("from_config"))
        routed = "route" in self.kinds
        if routed:
            gate = resolvers.longest_prefix(open_.select(F.col("id").alias("call_id"), "repo_id", F.col("template").alias("path")), self.routes.select("prefix", "target", "repo_id"))
            gate = gate.where("target is not null").select(F.col("call_id").alias("id"), "prefix", F.col("target").alias("from_gate"))
        rule = self.routes.groupBy("prefix", F.col("target").alias("from_gate")).agg(F.bool_or("strip").alias("strip")) if routed else gate.select("prefix", "from_gate", F.lit(False).alias("strip"))
        j = c.join(conf, "id", "left").join(gate, "id", "left").join(rule, ["prefix", "from_gate"], "left")
        how = F.when(F.col("hint").isNotNull(), "hint").when(F.col("from_config").isNotNull(), "config").when(F.col("from_gate").isNotNull(), "gateway")
        cut = F.concat(F.lit("/"), F.ltrim(F.expr("substring(template, length(prefix) + 1)"), F.lit("/")))
        template = F.when((how == "gateway") & F.col("strip"), cut).otherwise(F.col("template"))
        first = j.select("id", "repo_id", "method", template.alias("template"), F.coalesce("hint", "from_config", "from_gate").alias("service"), how.alias("how"), "path", "evidence", "node_id", "ui").where("service is not null")
        if not routed:
            return materialize(first.select("id", "repo_id", "method", "template", "service", "how", F.lit(1).alias("hops"), "path", "evidence", "node_id", "ui"))
        # A service that is a gateway itself sends the call on.
        gates = self.routes.select(F.col("gateway").alias("service")).distinct()
        through = first.join(gates, "service", "left_semi")
        chained = resolvers.gateway_chain(through.select(F.col("id").alias("call_id"), F.col("service").alias("gateway"), F.col("template").alias("path")), self.routes.select("gateway", "prefix", "strip", "target"), self.control.chain_hops)
        landed = chained.where("outcome = 'landed'").select(F.col("call_id").alias("id"), F.col("service").alias("to"), F.col("path").alias("to_path"), "hops")
        out = first.join(landed, "id", "left")
        done = out.select("id", "repo_id", "method", F.coalesce("to_path", "template").alias("template"), F.coalesce("to", "service").alias("service"), F.when(F.col("to").isNotNull(), "gateway").otherwise(F.col("how")).alias("how"), F.coalesce("hops", F.lit(1)).alias("hops"), "path", "evidence", "node_id", "ui")
        return materialize(done)

    # Join rules

    @cached_property
    def contracts(self) -> DataFrame:
        """Provided HTTP operations: id, repo_id, method, template, service, node, contract_id, evidence, key."""
        p = self.at_site(self.of("http", "provides").where(F.coalesce(F.col("attrs")["source"], F.lit("")) != "openapi"))
        service = F.coalesce(F.lower("hint"), F.substring_index("site_service", ":", -1), F.col("repo_id"))
        rows = p.select("id", "repo_id", F.substring_index("key", ":", 1).alias("method"), F.expr("substring(key, instr(key, ':') + 1)").alias("template"), service.alias("service"), "node_id", "evidence", "key", "path")
        contract = keys.rendezvous_id(F.lit("HttpContract"), F.concat_ws(":", "service", "method", keys.positional(F.col("template"))))
        return materialize(rows.withColumn("contract_id", contract))

    def http(self) -> DataFrame:
        c, p = self.calls, self.contracts
        exposes = self.edge(p.where("node_id is not null"), "http", "EXPOSES", F.col("node_id"), "GraphNode", F.col("contract_id"), "HttpContract", self.conf("r7", "exposes"), "declared", source_repo="repo_id")
        own = p.select("contract_id", "repo_id", "method", "template", "service")
        hit = resolvers.match_http(c.select(F.col("id").alias("call_id"), "repo_id", "method", "template", "service"), own, self.control.fanout_cap).where("outcome = 'matched'")
        j = hit.select(F.col("call_id").alias("id"), "contract_id", "provider_repo", (F.col("confidence") > 0.92).alias("exact")).join(c, "id")
        price = {h: (self.conf("r7", f"{h}_exact"), self.conf("r7", f"{h}_template")) for h in ("hint", "gateway")}
        gate = F.col("how") == "gateway"
        base = F.when(gate, F.when(F.col("exact"), price["gateway"][0]).otherwise(price["gateway"][1])).otherwise(F.when(F.col("exact"), price["hint"][0]).otherwise(price["hint"][1]))
        j = j.withColumn("conf", F.when(F.col("hops") > 1, F.round(F.pow(base, F.col("hops")), 4)).otherwise(base)).withColumn("site", F.coalesce("node_id", "id"))
        out = exposes
        for kind, test in (("UI_CALLS", "ui = 'true'"), ("INVOKES", "ui <> 'true'")):
            out = out.unionByName(self.edge(j.where(test), "http", kind, F.col("site"), "GraphNode", F.col("contract_id"), "HttpContract", F.col("conf"), "http", source_repo="repo_id", target_repo="provider_repo"))
        return out

    def grpc(self) -> DataFrame:
        ops = self.of("grpcop", "provides").select("id", "repo_id", "key", "evidence", "node_id", F.col("attrs")["package"].alias("package"), F.substring_index("key", "/", 1).alias("service"), F.substring_index("key", "/", -1).alias("rpc"), keys.rendezvous_id(F.lit("ContractOperation"), F.col("key")).alias("op_id"))
        ops = materialize(ops)
        stubs = self.of("grpcstub", "consumes")
        bare = ops.select("op_id", F.when(F.col("package").isNotNull(), F.col("package")).alias("package"), F.element_at(F.split("service", r"\."), -1).alias("service"), "rpc")
        hit = resolvers.match_grpc(stubs.select(F.col("id").alias("call_id"), F.col("key").alias("service")), bare, self.control.fanout_cap).where("outcome = 'matched'")
        owner = ops.groupBy("op_id").agg(F.min("repo_id").alias("provider_repo"))
        j = hit.withColumnRenamed("call_id", "id").join(stubs, "id").join(owner, "op_id").withColumn("site", F.coalesce("node_id", "id"))
        conf = F.when(F.instr("key", ".") > 0, self.conf("r5", "exact")).otherwise(self.conf("r5", "service_name"))
        calls = self.edge(j, "grpc", "INVOKES", F.col("site"), "GraphNode", F.col("op_id"), "ContractOperation", conf, "grpc", source_repo="repo_id", target_repo="provider_repo")
        declares = self.edge(ops.withColumn("site", F.coalesce("node_id", "id")), "grpc", "DECLARES_CONTRACT", F.col("site"), "GraphNode", F.col("op_id"), "ContractOperation", self.conf("r5", "declared"), "proto", source_repo="repo_id")
        pending = self.service_of(self.at_site(stubs).withColumn("t_name", keys.kebab(F.col("key"))), "t_name", "t")
        to = self.edge(pending, "grpc", "CALLS_SERVICE", F.col("site_service"), "Service", F.col("t"), "Service", self.conf("r5", "calls_service"), "grpc_stub", source_repo="repo_id")
        return calls.unionByName(declares).unionByName(to)

    def graphql(self) -> DataFrame:
        p = self.of("gql", "provides").withColumn("federated", F.col("attrs")["federated"] == "true")
        hit = resolvers.match_graphql(self.of("gql", "consumes").select("repo_id", "key"), p.select("repo_id", "key", "federated"), self.conf("r8", "federated"), self.conf("r8", "field_name"))
        node = keys.rendezvous_id(F.lit("ContractOperation"), F.concat(F.lit("graphql:"), "k"))
        use = self.of("gql", "consumes").withColumn("k", F.lower("key")).join(hit.select(F.col("source_id").alias("repo_id"), F.col("key").alias("k"), "target_id", F.col("confidence").alias("c")), ["repo_id", "k"]).withColumn("site", F.coalesce("node_id", "id"))
        calls = self.edge(use, "graphql", "INVOKES", F.col("site"), "GraphNode", node, "ContractOperation", F.col("c"), "graphql", source_repo="repo_id", target_repo="target_id")
        shown = self.edge(p.withColumn("k", F.lower("key")).withColumn("site", F.coalesce("node_id", "id")), "graphql", "EXPOSES", F.col("site"), "GraphNode", node, "ContractOperation", self.conf("r8", "declared"), "sdl", source_repo="repo_id")
        return calls.unionByName(shown)

    def topics(self) -> DataFrame:
        t = resolvers.fold_topics(self.claims.where("kind = 'topic'").withColumn("evidence", F.concat_ws(":", "path", F.col("line").cast("string"))))
        t = self.at_site(t).withColumn("topic", keys.rendezvous_id(F.lit("Topic"), F.col("key"))).withColumn("site", F.coalesce("node_id", "id"))
        out = None
        for direction, kind in (("provides", "PUBLISHES_TO"), ("consumes", "CONSUMES_FROM")):
            rows = t.where((F.col("direction") == direction) & (F.coalesce(F.col("attrs")["declared"], F.lit("false")) != "true"))
            for end, label in (("site", "GraphNode"), ("site_service", "Service")):
                e = self.edge(rows, "topic", kind, F.col(end), label, F.col("topic"), "Topic", self.conf("r6", "literal"), "topic", source_repo="repo_id")
                out = e if out is None else out.unionByName(e)
        declared = self.edge(t.where(F.col("attrs")["declared"] == "true"), "topic", "DECLARES_TOPIC", F.col("site"), "GraphNode", F.col("topic"), "Topic", self.conf("r6", "declared"), "declared", source_repo="repo_id")
        fan = t.where(F.col("attrs")["subscriber"].isNotNull()).withColumn("to", keys.rendezvous_id(F.lit("Topic"), F.col("attrs")["subscriber"]))
        fans = self.edge(fan, "topic", "FANS_OUT_TO", F.col("topic"), "Topic", F.col("to"), "Topic", self.conf("r6", "fanout"), "sns_subscription", via="terraform", source_repo="repo_id")
        return out.unionByName(declared).unionByName(fans)

    def env_reads(self) -> DataFrame:
        """Code that reads a variable whose configured value is the host of a service."""
        reads = self.of("cfgread", "consumes")
        v = self.of("env", "provides").where(F.col("attrs")["value"].rlike("^[a-z]+://")).select("repo_id", F.col("key").alias("name"), keys.bare_host(keys.url_class(F.col("attrs")["value"])["host"]).alias("host"))
        hit = resolvers.env_calls(reads.select(F.col("id").alias("read_id"), "repo_id", F.col("key").alias("name")), v).where("outcome = 'matched'").select(F.col("read_id").alias("id"), "host")
        j = self.service_of(self.at_site(reads.join(hit, "id")), "host", "t")
        return self.edge(j, "env", "CALLS_SERVICE", F.col("site_service"), "Service", F.col("t"), "Service", self.conf("r9", "env_resolved"), "env", source_repo="repo_id")

    def datasets(self) -> DataFrame:
        c = self.claims.where("kind = 'dataset'").withColumn("declares", F.coalesce(F.col("attrs")["tier"] == "declared", F.lit(False)))
        open_ = resolvers.match_datasets(c.select("repo_id", "direction", "key", "declares")).where("outcome = 'matched'").select("key", F.col("target_id").alias("node"), "owner").distinct()
        tier = F.coalesce(F.col("attrs")["tier"], F.lit("literal"))
        conf = F.when(tier == "declared", self.conf("r10", "declared")).when(tier == "inferred", self.conf("r10", "inferred")).otherwise(self.conf("r10", "literal"))
        j = self.at_site(c.withColumn("evidence", F.concat_ws(":", "path", F.col("line").cast("string")))).join(open_, "key").withColumn("site", F.coalesce("node_id", "id"))
        out = None
        for direction, kind in (("provides", "WRITES_TO"), ("consumes", "READS_FROM")):
            for end, label in (("site", "GraphNode"), ("site_service", "Service")):
                e = self.edge(j.where(F.col("direction") == direction), "dataset", kind, F.col(end), label, F.col("node"), "Dataset", conf, "dataset", source_repo="repo_id", target_repo="owner")
                out = e if out is None else out.unionByName(e)
        return out

    def agents(self) -> DataFrame:
        """Tools of servers (mcpop) and skills of agents (a2aop)."""
        node = lambda c: keys.rendezvous_id(F.lit("ContractOperation"), F.col(c))
        tools = self.of("mcpop", "provides").withColumn("site", F.coalesce("node_id", "id"))
        shown = self.edge(tools, "agent", "EXPOSES", F.col("site"), "GraphNode", node("key"), "ContractOperation", self.conf("r11", "registration"), "mcp_registration", source_repo="repo_id")
        use = self.of("mcpop", "consumes").withColumn("site", F.coalesce("node_id", "id"))
        server, tool = F.col("attrs")["server"], F.col("attrs")["tool"]
        own = tools.select(server.alias("server"), F.col("key").alias("tool"), "repo_id")
        hit = resolvers.match_tools(use.select(F.col("id").alias("call_id"), server.alias("server"), F.coalesce(tool, F.lit("*")).alias("tool")), own, self.control.fanout_cap).where("outcome = 'matched'")
        repo = own.groupBy("server").agg(F.min("repo_id").alias("provider_repo"))
        j = hit.select(F.col("call_id").alias("id"), F.col("tool").alias("op")).join(use.withColumn("server", server), "id").join(repo, "server", "left")
        calls = self.edge(j, "agent", "INVOKES", F.col("site"), "GraphNode", node("op"), "ContractOperation", self.conf("r11", "config"), "mcp_config", source_repo="repo_id", target_repo="provider_repo")
        skills = self.of("a2aop", "provides").withColumn("site", F.coalesce("node_id", "id"))
        cards = self.edge(skills, "agent", "EXPOSES", F.col("site"), "GraphNode", node("key"), "ContractOperation", self.conf("r11", "card"), "a2a_card", source_repo="repo_id")
        card_repo = skills.groupBy(F.col("attrs")["agent"].alias("agent")).agg(F.min("repo_id").alias("lo"), F.max("repo_id").alias("hi"))
        by_url = skills.where(F.col("attrs")["url"].isNotNull()).select(F.concat(F.lit("a2a:url:"), F.col("attrs")["url"]).alias("key"), F.col("key").alias("op"), F.col("attrs")["agent"].alias("agent")).distinct().join(card_repo, "agent", "left")
        asked = self.of("a2aop", "consumes").join(by_url, "key").withColumn("site", F.coalesce("node_id", "id"))
        urls = self.edge(asked, "agent", "INVOKES", F.col("site"), "GraphNode", node("op"), "ContractOperation", self.conf("r11", "url_resolved"), "a2a_url", source_repo="repo_id", target_repo=F.when(F.col("lo") == F.col("hi"), F.col("lo")))
        return shown.unionByName(calls).unionByName(cards).unionByName(urls)

    def ownership(self) -> DataFrame:
        o = self.of("owner", "provides").withColumn("team", F.lower(F.coalesce(F.col("attrs")["team"], "key")))
        tier = F.coalesce(F.col("attrs")["tier"], F.lit("codeowners"))
        o = o.withColumn("confidence", F.when(tier == "catalog", self.conf("r12", "catalog")).when(tier == "observability", self.conf("r12", "observability")).otherwise(self.conf("r12", "codeowners")))
        team = keys.rendezvous_id(F.lit("Team"), F.col("team"))
        repo = o.groupBy("repo_id", "team").agg(F.max("confidence").alias("confidence"), F.min("evidence").alias("evidence"))
        repos = self.edge(repo, "owner", "OWNED_BY", F.col("repo_id"), "Repo", team, "Team", F.col("confidence"), "owner", source_repo="repo_id")
        named = self.service_of(o.where(F.col("attrs")["entity"].isNotNull()).withColumn("entity", F.col("attrs")["entity"]), "entity", "s")
        return repos.unionByName(self.edge(named, "owner", "OWNED_BY", F.col("s"), "Service", team, "Team", F.col("confidence"), "owner", source_repo="repo_id"))

    def webhooks(self) -> DataFrame:
        w = self.of("webhook", "consumes").withColumn("method", F.substring_index("key", ":", 1)).withColumn("p", keys.positional(F.expr("substring(key, instr(key, ':') + 1)"))).withColumn("service", F.lower("hint"))
        own = self.contracts.select("method", keys.positional(F.col("template")).alias("p"), "service", "contract_id")
        hit = resolvers.exactly_one(w.select("id", "method", "p", "service"), own, ["method", "p", "service"], "id", "contract_id").where("outcome = 'matched'").select("id", "contract_id")
        j = self.at_site(w.join(hit, "id"))
        return self.edge(j, "webhook", "REGISTERS_WEBHOOK", F.col("site_service"), "Service", F.col("contract_id"), "HttpContract", self.conf("r13", "registered"), "webhook", source_repo="repo_id")

    def same_operations(self) -> DataFrame:
        """Operations declared in two protocols: by their HTTP binding, and by the schema that a topic carries."""
        op = self.of("grpcop", "provides").withColumn("op", keys.rendezvous_id(F.lit("ContractOperation"), F.col("key")))
        bound = op.where(F.col("attrs")["http_path"].isNotNull()).select("op", F.upper(F.col("attrs")["http_method"]).alias("method"), keys.positional(keys.path_template(F.col("attrs")["http_path"])).alias("p")).distinct()
        own = self.contracts.select("method", keys.positional(F.col("template")).alias("p"), "contract_id")
        http = resolvers.exactly_one(bound, own, ["method", "p"], "op", "contract_id").where("outcome = 'matched'")
        a = self.edge(http, "operation", "SAME_OPERATION", F.col("op"), "ContractOperation", F.col("contract_id"), "HttpContract", self.conf("r14", "http_binding"), "http_binding")
        topic = self.claims.where("kind = 'topic'").where(F.col("attrs")["schema"].isNotNull()).select(keys.rendezvous_id(F.lit("Topic"), F.col("key")).alias("topic"), F.col("attrs")["schema"].alias("schema")).distinct()
        out = op.where(F.col("attrs")["output"].isNotNull()).select("op", F.concat_ws(".", F.nullif(F.col("attrs")["package"], F.lit("")), F.col("attrs")["output"]).alias("schema"))
        event = resolvers.exactly_one(topic, out, ["schema"], "topic", "op").where("outcome = 'matched'")
        b = self.edge(event, "operation", "SAME_OPERATION", F.col("op"), "ContractOperation", F.col("topic"), "Topic", self.conf("r14", "event_schema"), "event_schema")
        return a.unionByName(b)

    # Rollups and the whole run

    def rules(self) -> dict[str, DataFrame]:
        """Edges of every rule that has claims to work on, in order of precedence; the first always gives (empty) edges."""
        order = (self.members, self.env_hosts, self.policies, self.gitops, self.aliases, self.built_from, self.modules, self.deployments, self.compose, self.libraries, self.gateways, self.grpc, self.http, self.graphql, self.env_reads, self.topics, self.webhooks, self.same_operations, self.datasets, self.agents, self.ownership)
        return {f.__name__: f() for f in order if f.__name__ not in NEEDS or self.kinds & set(NEEDS[f.__name__].split())}

    def calls_rollup(self, edges: DataFrame) -> DataFrame:
        """INVOKES and UI_CALLS to calls between services: the service of the citing file, the service of the contract."""
        use = edges.where(F.col("type").isin("INVOKES", "UI_CALLS") & (F.col("target_label") == "HttpContract")).withColumn("path", keys.evidence_path(F.col("evidence"))).withColumn("repo_id", F.col("source_repo"))
        j = self.service_of(self.at_site(use).withColumn("to", F.element_at(F.split("target_id", ":"), 3)), "to", "t").where("site_service is not null and t is not null and site_service <> t")
        g = j.groupBy("site_service", "t").agg(F.count("*").alias("weight"), F.max("confidence").alias("c"), F.min("evidence").alias("evidence"))
        repo = lambda end, out: self.sole_repo.select(F.col("service_id").alias(end), F.col("repo").alias(out))
        g = g.join(repo("site_service", "s_repo"), "site_service", "left").join(repo("t", "t_repo"), "t", "left")
        return self.edge(g, "calls_rollup", "CALLS_SERVICE", F.col("site_service"), "Service", F.col("t"), "Service", F.col("c"), "rollup", via="http", source_repo="s_repo", target_repo="t_repo")

    def repo_rollup(self, edges: DataFrame) -> DataFrame:
        """Everything that crosses repositories to one edge per pair of them. Calls between services without one repository
        each stand for all pairs of theirs, which may be nearly all pairs there are: these are listed when they are read."""
        direct = edges.where(F.col("type").isin("INVOKES", "UI_CALLS", "CALLS_SERVICE") & F.col("source_repo").isNotNull() & F.col("target_repo").isNotNull()).select("source_repo", "target_repo", "confidence", "evidence")
        best = (F.max("confidence").alias("confidence"), F.min("evidence").alias("evidence"))
        wide = edges.where("type = 'ROUTES_TO' or type = 'CALLS_SERVICE' and (source_repo is null or target_repo is null)")
        wide = materialize(wide.groupBy("source_id", "target_id").agg(*best))
        g = direct.where("source_repo <> target_repo").groupBy("source_repo", "target_repo").agg(*best)
        if noted(wide):
            # Services that many repositories build are hubs: target repositories to source services, then these to source
            # repositories. A repository is the hub of what it calls directly.
            built = self.service_repos.select(F.col("service_id").alias("hub"), F.col("repo_id").alias("source"))
            to = hubs.pairs(built, wide.select(F.col("target_id").alias("hub"), F.col("source_id").alias("target"), "confidence", "evidence"))
            own = F.concat(F.lit("\u0001"), "source_repo").alias("hub")
            to = to.select(F.col("target").alias("hub"), F.col("source").alias("target"), "confidence", "evidence").unionByName(g.select(own, F.col("target_repo").alias("target"), "confidence", "evidence"))
            g = hubs.pairs(built.unionByName(g.select(own, F.col("source_repo").alias("source"))), to).select(F.col("source").alias("source_repo"), F.col("target").alias("target_repo"), "confidence", "evidence").where("source_repo <> target_repo")
        return self.edge(g, "deps_rollup", "DEPENDS_ON_REPO", F.col("source_repo"), "Repo", F.col("target_repo"), "Repo", F.col("confidence"), "rollup", source_repo="source_repo", target_repo="target_repo")

    @cached_property
    def found(self) -> DataFrame:
        """Edges of all rules and calls between services; each rule is written by itself, so no plan holds all of them."""
        # What rules share is written first; then the rules, which do not wait for each other.
        for shared, kind in (("by_name", None), ("sites", None), ("sole_repo", None), ("routes", "route"), ("calls", "http"), ("contracts", "http"), ("contracts", "webhook"), ("contracts", "grpcop")):
            if kind is None or kind in self.kinds:
                getattr(self, shared)
        # Few at a time: the driver holds the plans and broadcasts of all that run.
        with ThreadPoolExecutor(3) as pool:
            found = list(pool.map(materialize, self.rules().values()))
        return together([*found, materialize(self.calls_rollup(together(found)))])

    @cached_property
    def between_repos(self) -> DataFrame:
        """The rollup to repositories, one row per pair. Where the library rule finds such edges as well, it is read several
        times and so written."""
        deps = self.repo_rollup(self.found)
        return materialize(deps) if "lib" in self.kinds else deps

    @cached_property
    def raw(self) -> DataFrame:
        """Edges of all rules and rollups before fusion."""
        return self.found.unionByName(self.between_repos)

    def edges(self) -> DataFrame:
        """Fused edges with status: one row per (source, type, target)."""
        key, deps = ["source_id", "type", "target_id"], self.between_repos
        many = self.found
        if "lib" in self.kinds:
            # Pairs that another rule has found too are fused with it; all others are single rows already.
            shared = self.found.where("type = 'DEPENDS_ON_REPO'").select(*key).distinct()
            many, deps = many.unionByName(deps.join(shared, key, "left_semi").select(*deps.columns)), deps.join(shared, key, "left_anti")
        fused = graph.fuse(many, self.control.fusion_cap, CORRELATED)
        first = many.groupBy(*key).agg(F.max_by(F.struct("source_label", "target_label", "source_repo", "target_repo", "match_type"), F.struct("confidence", "detected_by")).alias("b"), F.min("evidence").alias("evidence"))
        j = fused.join(first, key).select(*key, "b.*", "confidence", "n_rows", "detected_by", "evidence")
        alone = deps.withColumn("n_rows", F.lit(1).cast("bigint")).select(*j.columns)
        out = graph.with_floor(j.unionByName(alone).withColumn("status", F.lit("active")), self.control.floor)
        return graph.replay_decisions(out, F.broadcast(self.control.decision_frame(self.spark))) if self.control.decisions else out

    def counters(self) -> DataFrame:
        """Rows that every detector gave, zero included: counter, n."""
        names = self.spark.createDataFrame([(f"yield.{d}",) for d in sorted({*CORRELATED, "webhook", "operation"})], "counter string")
        n = self.raw.groupBy(F.concat(F.lit("yield."), "detected_by").alias("counter")).agg(F.count("*").alias("n"))
        return names.join(n, "counter", "left").select("counter", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def link(claims: DataFrame, control: Control | None = None) -> DataFrame:
    return Linker(claims, control).edges()
