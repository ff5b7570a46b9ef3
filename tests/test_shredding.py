import json

from claimweave.operators.shredding import _rows, bare_ref, catalog_apis, catalog_entities, once, pivot_scalars, read_deep, shred_children, shred_json
from pyspark.sql import functions as F

K8S = """resource_id bigint, repo_id string, label string, containers array<struct<name string, image string, ports array<int>, env array<struct<name string, source string, value string, ref_name string,
 ref_key string, prefix string, optional boolean>>, command array<string>, is_init boolean>>, ingress_rules array<struct<host string, path string, path_type string, backend_service string, backend_port string>>"""
ENV = lambda n: (n, "literal", "v", None, None, "", None)


def catalog(spark, *payloads):
    return spark.createDataFrame([(i, p, "x", "y") for i, p in enumerate(payloads)], "record_id bigint, payload string, node string, parent string")


def test_workloads_keep_positions(spark, rows):
    c = ("c1", "img", None, [ENV("A"), None, ENV(" "), ENV(None), ENV("B")], None, False)
    data = [(1, "r", "l", [None, c, ("c2", None, None, None, None, None)], [("h", "/", None, "svc", "80"), None, ("h2", "/", None, "", None), ("", "/", None, "z", None)]), (2, "r", "l", None, None), (3, "r", "l", [], [])]
    k8s = spark.createDataFrame(data + data[:1], K8S)
    out = rows(shred_children(k8s, catalog(spark)))
    assert out == sorted([("env", 1, "c1", 0, "A"), ("env", 1, "c1", 4, "B"), ("ingress", 1, "h", 0, "svc"), ("ingress", 1, "", 3, "z")], key=repr)


def test_catalog_shapes(spark, rows):
    deep = {"kind": "S", "name": "top", "items": [{"kind": "C", "name": "in", "spec": {"provides_apis": "API:ns/lone"}, "members": [{"kind": "C", "name": "low", "provides_apis": [None, "", {"name": "api:x"}, {"version": 1}, 7, "a/b"]}]}]}
    wrapper = {"items": [{"kind": "C", "name": "w", "provides_apis": {"name": "ns/obj"}}], "next": None}
    cat = catalog(spark, json.dumps(deep), json.dumps([wrapper, {"kind": "C", "provides_apis": ["x"]}]), "{broken", "", None, "null", "[" * 100_000)
    out = rows(catalog_apis(shred_json(cat, "record_id", "payload")))
    assert out == sorted([("api", 0, "in", 0, "lone"), ("api", 0, "low", 2, "x"), ("api", 0, "low", 5, "b"), ("api", 1, "w", 0, "obj"), ("api", 1, None, 0, "x")], key=repr)
    ent = {r.name: r.parent_node for r in catalog_entities(shred_json(cat, "record_id", "payload")).collect()}
    assert ent["top"] == -1 and ent["in"] >= 0 and ent["low"] > ent["in"]


def test_adjacency_round_trip(spark):
    value = {"a": [1, {"b": None, "c": [True, "x", 2.5]}], "d": {}, "e": []}
    rows = shred_json(catalog(spark, json.dumps(value)), "record_id", "payload").collect()
    kids = {}
    for r in rows:
        kids.setdefault(r.parent, []).append(r)

    def build(r):
        own = sorted(kids.get(r.node, []), key=lambda x: x.ordinal)
        if r.kind == "object":
            return {x.label: build(x) for x in own}
        if r.kind == "array":
            return [build(x) for x in own]
        return r.scalar if r.kind == "string" else None if r.kind == "null" else json.loads(r.scalar)

    assert build(kids[-1][0]) == value


def test_small_parts(spark):
    df = spark.createDataFrame([("api:default/x",), ("a/b",), (" x ",), ("k:",), (None,)], "s string")
    assert [r[0] for r in df.select(bare_ref(F.col("s"))).collect()] == ["x", "b", "x", None, None]
    d = spark.createDataFrame([(1, [1]), (1, [1]), (1, None)], "i int, l array<int>")
    assert once(d, "i").count() == 2
    adj = shred_json(catalog(spark, '{"name": "n", "kind": {"name": "m"}}'), "record_id", "payload")
    assert sorted(r.name for r in pivot_scalars(adj, "name").collect()) == ["m", "n"]


def test_deep_reader_equals_the_library():
    texts = ['{"a": [1, -2.5e3, {"b": null, "a": true, "a": false}], "c": "x\\u00e9\\n"}', "[]", "{}", " [ [ ] , { } ] ", "3", '"s"', "[NaN, -Infinity]"]
    for t in texts:
        assert repr(read_deep(t)) == repr(json.loads(t))
    for t in ["", "[", "[1,]", "{", '{"a"}', '{"a":1,}', "[1] 2", "{1:2}", "nul", '"open', "[01]", "+1", '["\t"]'.replace("\\t", "\t")]:
        for read in (read_deep, json.loads):
            try:
                read(t)
                raise AssertionError(t)
            except ValueError:
                pass


def test_nesting_has_no_limit():
    depth = 20_000
    text = ''.join('{"kind": "C", "name": "n%d", "items": [' % i for i in range(depth)) + "]}" * depth
    out = []
    _rows(1, text, out)
    assert len(out) == 4 * depth
    assert [r[6] for r in out if r[3] == "name"] != [] and sum(r[5] == "object" for r in out) == depth
