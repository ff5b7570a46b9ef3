from pyspark.sql import functions as F

from claimweave.operators import reports as R
from claimweave.operators.linker import CLAIMS
from claimweave.sources.ledger import Ledger

E = "source_id string, type string, target_id string, source_repo string, target_repo string, confidence double, evidence array<string>"


def test_change_impact_and_comment(spark):
    e = lambda s, t, sr, tr, ev, c=0.9: (s, "CALLS", t, sr, tr, c, ev)
    base = spark.createDataFrame([e("a", "x", "ca", "p", ["f.py:1", "f.py:1"]), e("b", "x", "cb", "p", ["g.py:2"], 0.5), e("c", "x", "cc", "p", None), e("d", "x", None, "p", ["h:1"]), e("f", "y", "q", "r", ["h:1"]), e("k", "y", "q", "r", ["z:1"]), e("m", "x", "mono", "mono", ["src/a.py:3"]), e("n", "x", "ca2", "p", ["f.py:1"])], E)
    head = spark.createDataFrame([e("k", "y", "q", "r", ["z:1"]), e("new", "y", "q", "r", ["z:9"])], E)
    repos = spark.createDataFrame([("p",), ("cb",), ("mono",)], "repo_id string")
    files = spark.createDataFrame([("mono", "src/other.py"), ("cb", "g.py")], "repo_id string, path string")
    i = R.change_impact(base, head, repos, files)
    got = {r.source_id: (r.bucket, r.caused) for r in i.collect()}
    assert got == {"a": ("break", True), "b": ("break", False), "c": ("uncitable", False), "d": ("unattributable", False), "f": ("unexplained", False), "k": ("kept", False), "m": ("break", True), "n": ("break", True), "new": ("added", False)}
    assert tuple(R.change_risk(i).first()) == (2.7, 3, 3)
    groups = {r.citation: (r.repo, r.n_consumers) for r in R.comment_groups(i).collect()}
    assert groups == {"f.py:1": ("ca", 2), "src/a.py:3": ("mono", 1)}
    text = R.comment(i, limit=1)
    assert "2 connection(s) lost" in text and "1 further" in text and "neither side changed" in text
    assert R.comment(R.change_impact(head, head, repos)).startswith("No consumer loses")
    assert {r.source_id: r.bucket for r in R.change_impact(base, head).where("caused").collect()}.keys() == {"a", "b", "d", "f", "m", "n"}


def test_reconciliation(spark):
    c = lambda kind, direction, key, **a: (key + kind, "r", kind, direction, key, None, "p", 1, a, None)
    claims = spark.createDataFrame([c("http", "provides", "GET:/a/{id}", source="openapi"), c("http", "provides", "GET:/a/{x}"), c("http", "provides", "GET:/b", source="openapi"), c("http", "provides", "PUT:/c"), c("grpcop", "provides", "p.S/A"), c("grpcop", "provides", "p.T/B"), c("grpcstub", "provides", "S"), c("grpcstub", "provides", "Lost"), c("topic", "provides", "k:a", declared="true"), c("topic", "consumes", "k:b")], CLAIMS)
    rows = lambda df: {r.key: r.bucket for r in df.collect()}
    assert rows(R.reconcile_http(claims)) == {"GET:/a/{}": "matched", "GET:/b": "declared_only", "PUT:/c": "observed_only"}
    assert rows(R.reconcile_grpc(claims)) == {"p.S/A": "matched", "p.T/B": "declared_only", "Lost": "observed_only"}
    assert rows(R.reconcile_topics(claims)) == {"k:a": "declared_only", "k:b": "observed_only"}
    assert R.config_matches(claims, "x").count() == 0


def test_small_reports(spark):
    e = spark.createDataFrame([("a", "PUBLISHES_TO", "t"), ("b", "CONSUMES_FROM", "u"), ("t", "FANS_OUT_TO", "u")], "source_id string, type string, target_id string").withColumn("status", F.lit("active"))
    assert sorted(map(tuple, R.topic_chain(e).collect())) == [("t", "fanned_out", "b"), ("t", "publisher", "a"), ("u", "consumer", "b")]
    n = spark.createDataFrame([("a", "Service"), ("z", "Repo")], "id string, type string")
    assert {r.node_id: (r.dead_end, r.listed) for r in R.flat_map(n, e).collect()} == {"a": (0, 1), "b": (0, 0), "t": (0, 0), "u": (1, 0), "z": (1, 1)}
    lab = lambda rows: spark.createDataFrame(rows, "source_id string, type string, target_id string, tier string")
    cal = {r.tier: (r.tp, r.fp, r.fn, r.recall) for r in R.calibration(e, lab([("a", "PUBLISHES_TO", "t", "x"), ("a", "Q", "t", "x")]), lab([("b", "CONSUMES_FROM", "u", "x")])).collect()}
    assert cal == {"x": (1, 1, 1, 0.5)}
    d = spark.createDataFrame([("x", "promote"), ("x", "reject"), ("x", None)], "tier string, decision string")
    assert tuple(R.review_labels(d).first()) == ("x", 1, 1, 1)
    cov = spark.createDataFrame([("Go", 1, 1, 2, "lite"), ("Go", 2, 1, 1, "full")], "language string, n_files int, n_with_hits int, n_hits int, tier string")
    assert tuple(R.merge_coverage(cov).first()) == ("Go", 3, 2, 3, "full")
    assert {r.id: r.name for r in R.first_lookup([n.withColumn("name", F.lit(1)), n.withColumn("name", F.lit(2))]).collect()} == {"a": 1, "z": 1}


def test_ledger(spark, tmp_path):
    ran = []
    claims = spark.createDataFrame([("1", "r"), ("2", "s")], "id string, repo_id string")

    def run(c):
        ran.append(1)
        return c.select(F.col("id").alias("source_id"))

    led = Ledger(spark, f"file://{tmp_path}/led")
    assert led.last() is None
    assert led.link(claims, run)[1] is False and led.link(claims, run)[1] is True and len(ran) == 1
    edges, reused = led.link(claims.where("id = '1'"), run)
    assert not reused and edges.count() == 1 and [r.n_stale for r in led.rows().orderBy("seq").collect()] == [2, 0, 1]
