import pytest
from pyspark.sql import functions as F

from claimweave.engine import Config, Engine, Registry
from claimweave.operators import graph as G
from claimweave.operators import temporal as T
from claimweave.operators import traverse as V
from claimweave.sources import artifacts as A
from claimweave.sources import repositories as P
from claimweave.streaming import events as S

E = "source_id string, target_id string, type string, confidence double, status string, detected_by string"


def edges(spark, rows):
    return spark.createDataFrame([(*r, *([0.9, "active", "d"][len(r) - 3 :])) for r in rows], E)


def test_fusion_floor_decisions(spark):
    e = edges(spark, [("a", "b", "T", 0.5, "active", "x"), ("a", "b", "T", 0.6, "active", "x"), ("a", "b", "T", 0.5, "active", "y"), ("c", "d", "T", 1.0, "active", "x")])
    f = {r.source_id: (r.n_rows, round(r.confidence, 6), r.detected_by) for r in G.fuse(e).collect()}
    assert f == {"a": (3, 0.8, "x+y"), "c": (1, 1.0, "x")}
    assert {r.status for r in G.with_floor(edges(spark, [("a", "b", "T", 0.1)])).collect()} == {"candidate"}
    dec = spark.createDataFrame([("a", "T", "b", "promote"), ("c", "T", "d", "reject")], "source_id string, type string, target_id string, decision string")
    got = G.replay_decisions(edges(spark, [("a", "b", "T", 0.1, "rejected"), ("a", "b", "T", 0.1, "candidate"), ("c", "d", "T")]), dec)
    assert sorted(r.status for r in got.collect()) == ["active", "rejected", "rejected"]
    assert G.fuse(e.limit(0)).count() == 0
    with pytest.raises(ValueError):
        G.at_least(e, 2)


def test_traversals(spark):
    e = edges(spark, [("a", "b", "DEPENDS_ON", 0.5), ("b", "c", "DEPENDS_ON", 0.5), ("a", "c", "CALLS_SERVICE", 0.4), ("c", "a", "DEPENDS_ON", 1.0), ("c", "d", "DEPENDS_ON", 1.0), ("x", "d", "OWNED_BY", 1.0), ("a", "z", "DEPENDS_ON", 1.0, "rejected")])
    start = spark.createDataFrame([("a",), ("a",), (None,)], "a string")
    p = {tuple(r.path) for r in V.paths(V.steps(e), start, 3).collect()}
    assert p == {("a", "b"), ("a", "c"), ("a", "b", "c"), ("a", "c", "d"), ("a", "b", "c", "d")}
    goal = spark.createDataFrame([("c",)], "b string")
    assert {tuple(r.path) for r in V.paths(V.steps(e), start, 4, goal).collect()} == {("a", "c"), ("a", "b", "c")}
    n = {r.node_id: r.distance for r in V.neighbourhood(V.steps(e, "both"), start.where("a is not null"), 2).collect()}
    assert n == {"a": 0, "b": 1, "c": 1, "d": 2}
    d = spark.createDataFrame([("d",)], "a string")
    i = {r.node_id: (r.distance, round(r.compounded, 6)) for r in V.impact(e, d, 3).collect()}
    assert i == {"c": (1, 1.0), "b": (2, 0.5), "a": (2, 0.4)}
    with pytest.raises(ValueError):
        V.paths(V.steps(e), start, 9)
    assert {(r.a, r.b) for r in V.flow_steps(edges(spark, [("r", "t", "CONSUMES_FROM")])).collect()} == {("t", "r")}


def test_components(spark):
    links = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(30)] + [("x", "y"), ("z", "z"), ("y", "x")], "a string, b string")
    got = {r.node: r.component for r in V.components(links).collect()}
    assert got == {f"n{i:02}": "n00" for i in range(31)} | {"x": "x", "y": "x", "z": "z"}


def test_history(spark):
    rows = spark.createDataFrame([("r", "k", i) for i in (1, 2, 4, 5, 5)] + [("r", "j", 3)], "g string, k string, i int")
    runs = T.intervals(rows, ["g"], ["k"], "i")
    assert sorted((r.k, r.first, r.last, r.n) for r in runs.collect()) == [("j", 3, 3, 1), ("k", 1, 2, 2), ("k", 4, 5, 2)]
    last = spark.createDataFrame([("r", 5)], "g string, last_index int")
    assert {r.k: (r.n_runs, r.at_head, r.reappeared) for r in T.reappeared(runs, ["g"], ["k"], last).collect()} == {"j": (1, 0, 0), "k": (2, 1, 1)}
    a = spark.createDataFrame([("x", 1), ("y", 1), (None, 1), ("w", None)], "k string, v int")
    b = spark.createDataFrame([("x", 2), ("z", 1), (None, 1), ("w", None)], "k string, v int")
    assert {r.k: r.change_kind for r in T.changed_between(a, b, ["k"], ["v"]).collect()} == {"x": "changed", "y": "removed", "z": "added", None: "kept", "w": "kept"}


def test_relink_equals_a_full_link(spark):
    claims = lambda rows: spark.createDataFrame(rows, "id string, key string, repo_id string")
    link = lambda c: c.groupBy(F.col("key").alias("claim_key")).agg(F.min("repo_id").alias("source_id"), F.count("*").alias("n"))
    old = claims([("1", "a", "r1"), ("2", "a", "r2"), ("3", "b", "r3"), ("4", "c", "r4")])
    new = claims([("1", "a", "r1"), ("3", "b", "r3"), ("5", "b", "r0"), ("6", "d", "r9")])
    got, full = T.relink(new, old, link(old), link), link(new)
    assert got.exceptAll(full).count() == 0 and full.exceptAll(got).count() == 0
    f = T.fingerprints(old)
    assert T.stale_groups(f, T.fingerprints(old.orderBy(F.rand()))).count() == 0
    assert {r.repo_id for r in T.stale_groups(T.fingerprints(new), f).collect()} == {"r2", "r4", "r0", "r9"}
    cited = spark.createDataFrame([(1, "r", "f", 5, "tok"), (2, "r", "f", 50, "tok"), (3, "r", "g", 1, "tok")], "cite_id int, repo_id string, path string, line int, token string")
    lines = spark.createDataFrame([("r", "f", i, "x tok" if i == 7 else "x") for i in range(60)], "repo_id string, path string, pos int, text string")
    assert {r.cite_id: r.verified for r in T.reverify(cited, lines).collect()} == {1: 1, 2: 0, 3: 0}


def test_artifacts_and_scans(spark, tmp_path):
    e = edges(spark, [("a", "b", "T"), ("c", "d", "T")])
    one = A.write_artifact(e, str(tmp_path / "store"), "r", "sha")
    assert A.write_artifact(e.orderBy(F.rand()), str(tmp_path / "store"), "r", "sha") == one
    back, meta = A.read_artifact(spark, one)
    assert back.count() == 2 and meta["repo_id"] == "r" and "evidence" not in e.columns
    assert set(A.migrate(spark.createDataFrame([("a",)], "source_id string"), (1, 0)).columns) == {"source_id", "status", "confidence", "evidence"}
    for v in ((2, 0), (1, 9)):
        with pytest.raises(ValueError):
            A.migrate(e, v)
    assert sorted(r.confidence for r in A.upsert(e, edges(spark, [("a", "b", "T", 0.1)]), ["source_id", "type", "target_id"]).collect()) == [0.1, 0.9]
    src = tmp_path / "src"
    (src / "pkg").mkdir(parents=True)
    (src / "node_modules").mkdir()
    (src / "pkg/a.py").write_text("x = 1\n")
    (src / "b.bin").write_bytes(b"\0\1")
    (src / "node_modules/c.js").write_text("x")
    files = P.scan_directory(spark, str(src), "r")
    assert {r.path: r.content for r in files.collect()} == {"pkg/a.py": "x = 1\n", "b.bin": None}
    assert {(r.parent, r.child, r.type) for r in P.structure(files).collect()} == {("", "pkg", "Folder"), ("pkg", "pkg/a.py", "File"), ("", "b.bin", "File")}
    assert P.tree_digest(files).collect() == P.tree_digest(files.orderBy(F.rand())).collect()


def test_engine_and_registry(spark):
    nodes = spark.createDataFrame([("a", "svc-a", "Service", "r1", None, None), ("b", "svc-b", "Service", "r2", "l", "p"), ("c", "dup", "File", "r2", None, None), ("d", "dup", "File", "r2", None, None)], "id string, name string, type string, repo_id string, label string, path string")
    eng = Engine(nodes, edges(spark, [("a", "b", "DEPENDS_ON", None, None), ("c", "a", "READS_FROM", 0.5)]))
    assert eng.node("svc-a").rows[0]["id"] == "a" and eng.node("dup").status == "ambiguous" and eng.node("nope").status == "unknown_target"
    assert [r["consumer"] for r in eng.consumers_of("b").rows] == ["a"] and eng.consumers_of("c").status == "known_empty"
    assert [(r["node_id"], r["compounded"]) for r in eng.impact("b").rows] == [("a", 1.0), ("c", 0.5)]
    assert eng.trace("c", "b").rows[0]["path"] == ["c", "a", "b"] and eng.neighbours("a").total == 2
    assert eng.search("svc").total == 2 and eng.search("svc", 1).truncated and eng.services().count() == 2
    assert '"status": "present"' in eng.search("svc").to_json()
    with pytest.raises(ValueError):
        Config.of(flor=1)
    reg = Registry()
    rule = lambda c: c.select(F.col("repo_id").alias("source_id"), F.lit("X").alias("type"), F.col("key").alias("target_id"), F.lit(0.9).alias("confidence"), F.col("key").alias("claim_key"))
    reg.register("one", rule)
    with pytest.raises(ValueError):
        reg.register("one", rule)
    with pytest.raises(ValueError):
        reg.register("two", rule, phase="late")
    reg.post.append(lambda name, df: df.where("target_id <> 'k2'").unionByName(df.withColumn("target_id", F.lit("added"))))
    reg.post.append(lambda name, df: 1 / 0)
    claims = spark.createDataFrame([("r", "k1"), ("r", "k2")], "repo_id string, key string")
    assert [r.target_id for r in reg.link(claims).collect()] == ["k1"] and reg.failures


def test_streams(spark, tmp_path):
    ev = "key string, repo_id string, at timestamp, value double"
    src, folder = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("k", "r1", "2025-01-01 00:00:10", 1.0), ("k", "r2", "2025-01-01 00:01:10", 2.0), ("j", "r1", "2025-01-01 01:00:00", 3.0)]
    df = spark.createDataFrame(rows, "key string, repo_id string, at string, value double").withColumn("at", F.col("at").cast("timestamp"))
    df.limit(2).write.parquet(src)
    link = lambda c: c.groupBy(F.col("key").alias("claim_key")).agg(F.count_distinct("repo_id").alias("n"))
    run = lambda: S.relink_stream(spark.readStream.schema(ev).parquet(src), link, folder, str(tmp_path / "ck")).awaitTermination()
    run()
    df.subtract(df.limit(2)).unionByName(df.limit(1).withColumn("repo_id", F.lit("r3"))).write.mode("append").parquet(src)
    run()
    got = {r.claim_key: r.n for r in S.current_edges(spark.read.parquet(folder + "/edges")).collect()}
    assert got == {"k": 3, "j": 1}
    assert sorted(r.n for r in S.sessions(df, "at", "5 minutes", []).collect()) == [1, 2]
    assert sorted((r.n, r.total) for r in S.tumbling(df, "at", "1 hour", []).collect()) == [(1, 3.0), (2, 3.0)]
    stream = S.tumbling(spark.readStream.schema(ev).parquet(src), "at", "1 minute", ["key"], late="1 minute")
    q = stream.writeStream.format("memory").queryName("tumbled").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("tumbled").count() >= 1


def test_snapshot_follows_the_data(spark):
    from claimweave.engine import Config, Engine

    nodes = spark.createDataFrame([("a", "r", "Service", "a", "a")], "id string, repo_id string, type string, name string, label string")
    edge = lambda c: spark.createDataFrame([("a", "CALLS_SERVICE", "b", c)], "source_id string, type string, target_id string, confidence double").withColumn("status", F.lit("active"))
    ids = [Engine(nodes, edge(0.7)).snapshot(), Engine(nodes, edge(0.7)).snapshot(), Engine(nodes, edge(0.8)).snapshot(), Engine(nodes, edge(0.7), Config.of(floor=0.5)).snapshot()]
    assert ids[0] == ids[1] and len(set(ids)) == 3


def test_phases_order_resolvers(spark):
    from claimweave.engine import Registry

    r, seen = Registry(), []
    claims = spark.createDataFrame([("a", "b")], "source_id string, target_id string")
    shape = lambda df: df.select("source_id", F.lit("T").alias("type"), "target_id", F.lit(0.9).alias("confidence"), F.lit("k").alias("claim_key"))

    def late(c, edges):
        seen.append(edges.count())
        return shape(c)

    r.register("late", late, "join", 1)
    r.register("early", shape, "broadcast", 900)
    assert {x.detected_by for x in r.link(claims).collect()} == {"late", "early"} and seen == [1]


def test_skipped_files_are_counted(spark):
    rows = [("r", "a.py", 3, "x=1"), ("r", "big.py", 9, "y" * 50), ("r", "node_modules/a.js", 1, "z"), ("r", "b.bin", 7, None), ("s", "c.min.egg-info/d", 2, "zz")]
    f = spark.createDataFrame(rows, "repo_id string, path string, size_bytes bigint, content string")
    got = {(r.repo_id, r.reason): (r.n_files, r.n_bytes) for r in P.skipped(f, largest=20).collect()}
    assert got == {("r", "too_large"): (1, 50), ("r", "ignored"): (1, 1), ("r", "unreadable"): (1, 7), ("s", "ignored"): (1, 2)}
    assert [r.path for r in P.scannable(f, largest=20).collect()] == ["a.py"]
