from claimweave.operators import resolve as R
from claimweave.operators import resolvers as V


def out(df, *cols):
    return {r[0]: tuple(r[1:]) for r in df.select(*cols).collect()}


def test_http(spark):
    calls = spark.createDataFrame([("c1", "r1", "get", "/a/{x}", None), ("c2", "r1", "GET", "/a/{id}", "s2"), ("c3", "r9", "POST", "/a/{id}", None), ("c4", "r1", "GET", "/none", None), ("c5", "r9", "GET", "/hot", None)], "call_id string, repo_id string, method string, template string, service string")
    con = [("k1", "r1", "GET", "/a/{id}", "s1"), ("k2", "r2", "ANY", "/a/{id}", "s2"), ("k2", "r2", "ANY", "/a/{id}", "s2")] + [(f"h{i}", f"q{i}", "GET", "/hot", "s") for i in range(40)]
    contracts = spark.createDataFrame(con, "contract_id string, repo_id string, method string, template string, service string")
    got = out(V.match_http(calls, contracts), "call_id", "contract_id", "confidence", "n_contracts", "outcome")
    assert got == {"c1": ("k1", 0.9, 1, "matched"), "c2": ("k2", 0.95, 1, "matched"), "c3": ("k2", 0.95, 1, "matched"), "c4": (None, None, 0, "unmatched"), "c5": (None, None, 40, "fanout")}


def test_grpc_and_single_targets(spark):
    stubs = spark.createDataFrame([("a", "p.S"), ("b", "s"), ("c", "T")], "call_id string, service string")
    ops = spark.createDataFrame([("o1", "p", "S", "Get"), ("o2", "p", "S", "Put")], "op_id string, package string, service string, rpc string")
    assert sorted(map(tuple, V.match_grpc(stubs, ops).collect()), key=repr) == sorted([("a", "o1", "matched"), ("a", "o2", "matched"), ("b", "o1", "matched"), ("b", "o2", "matched"), ("c", None, "unmatched")], key=repr)
    assert {r.call_id: r.outcome for r in V.match_grpc(stubs, ops, cap=1).collect()} == {"a": "fanout", "b": "fanout", "c": "unmatched"}
    left = spark.createDataFrame([(1, "GET", "/a"), (2, "GET", "/b"), (3, "GET", None)], "rid int, m string, t string")
    right = spark.createDataFrame([("x", "GET", "/a"), ("y", "GET", "/b"), ("z", "GET", "/b"), ("w", "GET", None)], "target string, m string, t string")
    assert out(V.exactly_one(left, right, ["m", "t"], "rid", "target"), "rid", "target", "outcome") == {1: ("x", "matched"), 2: (None, "ambiguous"), 3: (None, "unmatched")}


def test_topics(spark):
    t = spark.createDataFrame([("r1", "provides", "kafka:a"), ("r2", "consumes", "channel:a"), ("r3", "consumes", "channel:b"), ("r4", "provides", "sqs:c"), ("r5", "provides", "sns:c"), ("r6", "consumes", "channel:c")], "repo_id string, direction string, key string")
    assert {(r.source_id, r.target_id) for r in V.topic_edges(t).collect()} == {("r1", "global:Topic:kafka:a"), ("r2", "global:Topic:kafka:a"), ("r3", "global:Topic:channel:b"), ("r4", "global:Topic:sqs:c"), ("r5", "global:Topic:sns:c"), ("r6", "global:Topic:channel:c")}
    refs = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "ref_id int, name string")
    vals = spark.createDataFrame([("A", "x"), ("A", "x"), ("B", "x"), ("B", "y"), ("C", None)], "name string, value string")
    assert out(V.indirect_topics(refs, vals), "ref_id", "topic", "outcome") == {1: ("x", "matched"), 2: (None, "ambiguous"), 3: (None, "unmatched")}


def test_env_prefix_gateway(spark):
    reads = spark.createDataFrame([(1, "r1", "U"), (2, "r9", "U"), (3, "r1", "N")], "read_id int, repo_id string, name string")
    vals = spark.createDataFrame([("r1", "U", "h1"), ("r2", "U", "h2"), ("r3", "U", "h3")], "repo_id string, name string, host string")
    assert out(V.env_calls(reads, vals), "read_id", "host", "outcome") == {1: ("h1", "matched"), 2: (None, "ambiguous"), 3: (None, "unmatched")}
    calls = spark.createDataFrame([(1, "r", "/api/veterans"), (2, "r", "/api/x"), (3, "r", "/zzz"), (4, "r", "/dup")], "call_id int, repo_id string, path string")
    routes = spark.createDataFrame([("/api", "a", "q"), ("/api/vet", "b", "q"), ("/dup", "x", "q"), ("/dup", "y", "q")], "prefix string, target string, repo_id string")
    assert out(V.longest_prefix(calls, routes), "call_id", "target", "outcome") == {1: ("b", "matched"), 2: ("a", "matched"), 3: (None, "unmatched"), 4: (None, "ambiguous")}
    rt = spark.createDataFrame([("g1", "/api", True, "g2"), ("g2", "/", False, "svc"), ("l1", "/", False, "l2"), ("l2", "/", False, "l1"), ("d0", "/", False, "d1"), ("d1", "/", False, "d2"), ("d2", "/", False, "d3"), ("d3", "/", False, "d4"), ("d4", "/", False, "end")], "gateway string, prefix string, strip boolean, target string")
    gc = spark.createDataFrame([(1, "g1", "/api/x"), (2, "l1", "/x"), (3, "d0", "/x"), (4, "g1", "/none"), (5, "nogate", "/x")], "call_id int, gateway string, path string")
    assert out(V.gateway_chain(gc, rt), "call_id", "service", "path", "hops", "outcome") == {1: ("svc", "/x", 2, "landed"), 2: (None, "/x", 1, "cycle"), 3: (None, "/x", 3, "too_deep"), 4: (None, "/none", 0, "unmatched"), 5: (None, "/x", 0, "unmatched")}


def test_config_tools_aliases(spark):
    calls = spark.createDataFrame([(1, "r", "src/a/b/x.py", "BASE"), (2, "r", "src/z.py", "BASE"), (3, "r", "q.py", None)], "call_id int, repo_id string, path string, base_var string")
    reads = spark.createDataFrame([("r", "src/a/c.py", "U", "billing"), ("r", "src/y.py", "BASE", "orders"), ("r", "src/y.py", "OTHER", "stock")], "repo_id string, path string, name string, service string")
    assert out(V.config_target(calls, reads), "call_id", "service", "outcome") == {1: ("billing", "matched"), 2: ("orders", "matched"), 3: (None, "unmatched")}
    tools = spark.createDataFrame([("s", "t1", "r"), ("s", "t2", "r"), ("dup", "t", "r1"), ("dup", "t", "r2")], "server string, tool string, repo_id string")
    use = spark.createDataFrame([("a", "s", "*"), ("b", "s", "t1"), ("c", "s", "nope"), ("d", "dup", "t"), ("e", "x", "t")], "call_id string, server string, tool string")
    got = sorted((r.call_id, r.tool, r.outcome) for r in V.match_tools(use, tools).collect())
    assert got == [("a", "t1", "matched"), ("a", "t2", "matched"), ("b", "t1", "matched"), ("c", None, "unmatched"), ("d", None, "ambiguous"), ("e", None, "unmatched")]
    n = spark.createDataFrame([("Bill",), ("x",), (None,)], "name string")
    al = spark.createDataFrame([("bill", "billing", 2), ("BILL", "first", 1)], "alias string, canonical string, rank int")
    assert {r.name: r.canonical for r in V.canonical(n, al).collect()} == {"Bill": "first", "x": "x", None: None}
    h = spark.createDataFrame([("order_service", 3), ("zzz", 1)], "hint string, n int")
    s = spark.createDataFrame([("order-api",), ("other",)], "name string")
    assert out(V.alias_suggestions(h, s), "hint", "candidates", "outcome")["zzz"] == ("", "none")


def test_clusters_vendors_selectors(spark):
    p = spark.createDataFrame([("web", "s1", "r1"), ("bill", "s1", "r1"), ("bill", "s2", "r1"), ("bill", "s3", "r9"), ("one", "s1", "r1")], "name string, scope string, repo_id string")
    got = {(r.name, r.scope): r.service_id for r in V.service_clusters(p).collect()}
    assert got == {("web", "s1"): "s1/web", ("bill", "s1"): "s1/bill", ("bill", "s2"): "s1/bill", ("bill", "s3"): "s3/bill", ("one", "s1"): "one"}
    hosts = spark.createDataFrame([("api.pay.example.com",), ("x.org",), ("db.svc",)], "host string")
    cat = spark.createDataFrame([("example.com", "ex"), ("pay.example.com", "pay")], "suffix string, vendor string")
    assert out(V.vendors(hosts, cat), "host", "vendor", "kind") == {"api.pay.example.com": ("pay", "vendor"), "x.org": (None, "external"), "db.svc": (None, "internal")}
    sel = spark.createDataFrame([(1, "n", {"a": "1"}), (2, "n", {"a": "1", "b": "2"}), (3, "m", {"a": "1"}), (4, "n", {})], "sel_id int, namespace string, selector map<string,string>")
    wl = spark.createDataFrame([(10, "n", {"a": "1", "c": "3"}), (11, "n", {"b": "2", "a": "1"})], "workload_id int, namespace string, labels map<string,string>")
    assert {tuple(r) for r in R.selector_members(sel, wl).collect()} == {(1, 10), (1, 11), (2, 11)}


def test_claims_gate(spark):
    docker = spark.createDataFrame([(1, "r", "Web", "I:1", ["db", None, "${X}"], "f.yml", 3), (2, "q", "db", "", None, "g.yml", 1), (3, "r", " ", None, [], "f.yml", 9)], "docker_id int, repo_id string, name string, image string, depends_on array<string>, file_path string, line int")
    c = R.docker_claims(docker)
    assert sorted((r.kind, r.direction, r.key) for r in c.collect()) == [("image", "consumes", "i"), ("svcname", "consumes", "db"), ("svcname", "provides", "db"), ("svcname", "provides", "web")]
    e = R.join_claims(c, "svcname", "CALLS_SERVICE", 0.9).collect()
    assert [(r.source_id, r.target_id, r.outcome) for r in e] == [("r", "q", "matched")]
