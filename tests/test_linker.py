import pytest
from pyspark.sql import functions as F

from claimweave.operators import emit
from claimweave.operators.control import Control
from claimweave.operators.linker import CLAIMS, Linker
from claimweave.sources import extractors
from claimweave.sources.synthetic import estate_claims, planted_recall


def claim(repo, kind, direction, key, hint=None, path="a/b.txt", line=1, node=None, **attrs):
    return (f"{repo}:{kind}:{direction}:{key}:{path}:{hint}:{sorted(attrs.items())}", repo, kind, direction, key, hint, path, line, {k: str(v) for k, v in attrs.items()}, node)


def frame(spark, claims):
    return spark.createDataFrame(claims, CLAIMS)


SVC = lambda n: f"global:Service:{n}"
BASE = [
    claim("r1", "svcname", "provides", "default:orders", path="services/orders/compose.yml", build_context=".", source="compose"),
    claim("r1", "svcname", "provides", "default:billing", path="services/billing/compose.yml", build_context=".", source="compose"),
    claim("r2", "svcname", "provides", "default:stock", path="compose.yml", build_context=".", source="compose"),
    claim("r3", "svcname", "provides", "default:edge", path="compose.yml", build_context=".", source="compose"),
]


@pytest.fixture(scope="module")
def estate(spark):
    claims = BASE + [
        claim("r2", "http", "provides", "GET:/items/{id}", path="src/routes.py", node="r2:route"),
        claim("r1", "http", "consumes", "httpcall:GET:/items/{x}", hint="stock", path="services/orders/client.py", node="r1:site"),
        claim("r1", "http", "consumes", "httpcall:GET:/api/items/{id}", path="services/billing/ui.ts", ui="true"),
        claim("r3", "route", "provides", "/api/", path="nginx.conf", service="edge", target="stock", strip="true"),
        claim("r1", "svcname", "consumes", "default:stock", path="services/orders/compose.yml", **{"from": "orders"}),
        claim("r9", "declared", "provides", "argo:stock", hint="stock", source_repo="https://github.com/r/1"),
        claim("r_1", "cfgread", "consumes", "NOTHING"),
        claim("r1", "env", "provides", "STOCK_URL", hint="orders", value="http://stock.prod.svc.cluster.local/v1"),
        claim("r1", "cfgread", "consumes", "STOCK_URL", path="services/billing/conf.py"),
        claim("r2", "grpcop", "provides", "shop.Stock/Get", package="shop", http_method="get", http_path="/items/{n}", output="Item"),
        claim("r1", "grpcstub", "consumes", "Stock", path="services/orders/grpc.py"),
        claim("r2", "topic", "provides", "kafka:events", path="src/pub.py", schema="shop.Item"),
        claim("r1", "topic", "consumes", "channel:events", path="services/orders/sub.py", subscriber="sqs:copy"),
        claim("r2", "gql", "provides", "Query.item", federated="true"),
        claim("r1", "gql", "consumes", "query.ITEM"),
        claim("r2", "dataset", "provides", "table:items", tier="declared"),
        claim("r1", "dataset", "consumes", "table:items"),
        claim("r2", "mcpop", "provides", "mcp:srv/get", server="srv", tool="mcp:srv/get"),
        claim("r1", "mcpop", "consumes", "mcp:srv", server="srv"),
        claim("r2", "a2aop", "provides", "a2a:bot/ask", agent="bot", skill="ask", url="http://bot"),
        claim("r1", "a2aop", "consumes", "a2a:url:http://bot"),
        claim("r2", "owner", "provides", "core", team="Core", tier="catalog", entity="stock"),
        claim("r1", "webhook", "consumes", "GET:/items/{q}", hint="stock", path="services/orders/hook.py"),
        claim("r2", "lib", "provides", "pkg:npm/lib"), claim("r1", "lib", "consumes", "pkg:npm/lib", lock="true"), claim("r1", "lib", "consumes", "pkg:npm/left"),
        claim("r2", "svcname", "provides", "default:pod-a", path="k8s.yml", namespace="n", labels="app=a,tier=x", source="k8s", workload="pod-a", workload_kind="Deployment"),
        claim("r2", "svcname", "provides", "default:pod-b", path="k8s.yml", namespace="n", labels="app=b,tier=x", source="k8s"),
        claim("r2", "svcname", "provides", "default:svc-b", path="k8s.yml", namespace="n", source="k8s_service", selector="app=b"),
        claim("r2", "policy", "provides", "allow", namespace="n", target_selector="app=b", source_ref="tier=x", source_kind="selector"),
        claim("r1", "http", "consumes", "httpcall:GET:${BASE}/x", hint="stock"),
    ]
    return Linker(frame(spark, claims + claims[:3]))


def test_rules_meet(estate):
    got = {(r.source_id, r.type, r.target_id): (round(r.confidence, 4), r.detected_by, r.source_repo, r.target_repo) for r in estate.edges().collect()}
    edge = lambda *k: got.get(k)
    contract = "global:HttpContract:stock:GET:/items/{}"
    assert edge("r2:route", "EXPOSES", contract)[0] == 0.98
    # Another parameter name is a template match; the call over the gateway is cheaper still.
    assert edge("r1:site", "INVOKES", contract) == (0.85, "http", "r1", "r2")
    ui = [k for k in got if k[1] == "UI_CALLS"]
    assert len(ui) == 1 and ui[0][2] == contract and got[ui[0]][0] == 0.88
    # Compose, the environment of the workload and the rollup see orders call stock; the first two are one group.
    seen = edge(SVC("orders"), "CALLS_SERVICE", SVC("stock"))
    assert seen[1].split("+") == ["calls_rollup", "compose", "grpc", "k8s"] and seen[0] == 0.99
    assert edge(SVC("billing"), "CALLS_SERVICE", SVC("stock"))[1] == "calls_rollup+env"
    assert edge("r1", "DEPENDS_ON_REPO", "r2") and edge("r1", "DEPENDS_ON", "global:Library:pkg:npm/lib")[0] == 0.95
    assert edge("r1", "DEPENDS_ON", "global:Library:pkg:npm/left") is None
    assert edge(SVC("edge"), "ROUTES_TO", SVC("stock"))[0] == 0.98
    assert edge(SVC("stock"), "BUILT_FROM", "r2")[0] == 0.95 and edge(SVC("stock"), "BUILT_FROM", "r_1")[0] == 0.97
    assert edge(SVC("pod-a"), "PERMITS_TRAFFIC", SVC("pod-b"))[0] == 0.9 and edge(SVC("pod-b"), "PERMITS_TRAFFIC", SVC("pod-b")) is None
    assert edge(SVC("pod-a"), "DEPLOYED_AS", "global:DeploymentUnit:n/deployment/pod-a")
    op = "global:ContractOperation:shop.Stock/Get"
    assert edge(op, "SAME_OPERATION", contract)[0] == 0.97 and edge(op, "SAME_OPERATION", "global:Topic:kafka:events")[0] == 0.85
    assert edge(SVC("orders"), "CONSUMES_FROM", "global:Topic:kafka:events") and edge(SVC("stock"), "PUBLISHES_TO", "global:Topic:kafka:events")
    assert edge("global:Topic:kafka:events", "FANS_OUT_TO", "global:Topic:sqs:copy")
    assert edge(SVC("orders"), "REGISTERS_WEBHOOK", contract)[0] == 0.85
    assert edge(SVC("stock"), "OWNED_BY", "global:Team:core") and edge("r2", "OWNED_BY", "global:Team:core")[0] == 0.95
    kinds = {k[1] for k in got}
    assert {"HAS_ALIAS", "RESOLVED_TO", "BELONGS_TO", "MEMBER_OF", "WRITES_TO", "READS_FROM", "PUBLISHES", "DECLARES_CONTRACT"} <= kinds
    agent = {(k[1], k[2]) for k in got if k[2].startswith("global:ContractOperation:mcp") or k[2].startswith("global:ContractOperation:a2a")}
    assert {t for t, _ in agent} == {"EXPOSES", "INVOKES"} and len(agent) == 4
    n = {r.counter: r.n for r in estate.counters().collect()}
    assert n["yield.gateway"] == 1 and n["yield.http"] == 3


def test_planted_calls_come_back(spark):
    claims, planted = estate_claims(spark, 60)
    edges = Linker(claims).edges().where("type = 'CALLS_SERVICE' and status = 'active'")
    name = lambda c: F.substring_index(c, ":", -1)
    found = edges.select(name("source_id").alias("consumer"), name("target_id").alias("provider"))
    r = planted_recall(found, planted).first()
    assert r.n_planted > 100 and (r.n_missed, r.n_invented) == (0, 0)


def test_decisions_and_empty(spark):
    control = Control(decisions=[(SVC("orders"), "CALLS_SERVICE", SVC("stock"), "reject")], aliases=[("warehouse", "stock")])
    claims = BASE + [claim("r1", "svcname", "consumes", "default:Warehouse", path="services/orders/compose.yml", **{"from": "orders"})]
    got = {(r.source_id, r.target_id): r.status for r in Linker(frame(spark, claims), control).edges().where("type = 'CALLS_SERVICE'").collect()}
    assert got == {(SVC("orders"), SVC("stock")): "rejected"}
    assert Linker(frame(spark, [])).edges().count() == 0


def test_hits_become_claims_and_edges(spark):
    """Texts of files, through the extractors and emitters, to edges between services."""
    files = [
        ("a", "compose.yml", "services:\n  orders:\n    build: .\n    depends_on: [stock]\n    environment:\n      STOCK_URL: http://stock:80/\n"),
        ("a", "src/client.py", "import requests\nrequests.get('http://stock/items/{id}')\nx = os.getenv('STOCK_URL')\nproducer.send('sold')\n"),
        ("b", "compose.yml", "services:\n  stock:\n    build: .\n"),
        ("b", "src/app.py", "@app.get('/items/{item}')\ndef get(): pass\nKafkaConsumer('sold')\n"),
        ("b", "package.json", '{"name": "@own/stock", "dependencies": {}}'), ("a", "package.json", '{"name": "orders", "private": true, "dependencies": {"@own/stock": "^1"}}'),
        ("b", "api.proto", "package shop;\nservice Stock { rpc Get (A) returns (B); }\n"), ("a", "src/g.py", "s = StockStub(ch)\n"),
        ("b", "CODEOWNERS", "* @core\n"), ("b", "k8s.yaml", "apiVersion: apps/v1\nkind: Deployment\nmetadata: {name: stock, namespace: prod}\nspec: {template: {spec: {containers: []}}}\n"),
    ]
    rows = [(r, p, p.rsplit("/", 1)[-1], None, t) for r, p, t in files]
    hits = extractors.extract(spark.createDataFrame(rows, "repo_id string, path string, name string, language string, content string"))
    claims = emit.claims_of_hits(hits).cache()
    assert {r.kind for r in claims.collect()} == {"svcname", "env", "http", "cfgread", "topic", "lib", "grpcop", "grpcstub", "owner"}
    got = {(r.source_id, r.type, r.target_id) for r in Linker(claims).edges().where("status = 'active'").collect()}
    assert (SVC("orders"), "CALLS_SERVICE", SVC("stock")) in got and ("a", "DEPENDS_ON_REPO", "b") in got and ("a", "DEPENDS_ON", "global:Library:pkg:npm/@own/stock") in got
    assert {t for s, t, _ in got} >= {"EXPOSES", "INVOKES", "PUBLISHES_TO", "CONSUMES_FROM", "BUILT_FROM", "OWNED_BY", "DECLARES_CONTRACT", "DEPLOYED_AS", "PUBLISHES"}
    assert not [x for x in got if x[1] == "CALLS_SERVICE" and x[0] == SVC("stock")]


def test_control_files(tmp_path):
    (tmp_path / "confidence.yml").write_text("floor: 0.5\nr1:\n  depends_on: 0.8\n")
    (tmp_path / "service_aliases.yml").write_text("services:\n  stock:\n    aliases: [warehouse]\n")
    (tmp_path / "promotions.yml").write_text("promotions:\n- {source: a, type: T, target: b, decision: promote}\n- {source: a}\n")
    (tmp_path / "internal_namespaces.yml").write_text("ecosystems:\n  npm:\n    scopes: ['@own/']\n")
    (tmp_path / "vendor_catalog.yml").write_text("vendors:\n  mail:\n    suffixes: [mail.example]\n")
    c = Control.load(str(tmp_path))
    assert c.floor == 0.5 and c.conf("r1", "depends_on") == 0.8 and c.conf("r1", "env_host") == 0.95 and c.conf("r1", "no") == 0.6
    assert c.aliases == [("warehouse", "stock")] and c.decisions == [("a", "T", "b", "promote")] and c.namespaces == [("npm", "@own/")] and c.vendors == [("mail.example", "mail")]
    c.save_decision(str(tmp_path), "x", "T", "y", "reject")
    assert Control.load(str(tmp_path)).decisions[-1] == ("x", "T", "y", "reject")
    with pytest.raises(ValueError):
        c.save_decision(str(tmp_path), "x", "T", "y", "maybe")
