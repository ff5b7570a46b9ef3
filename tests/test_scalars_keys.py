import hashlib
import hmac
import math

from claimweave.functions import keys as K
from claimweave.functions import scalars as S
from pyspark.sql import functions as F


def col(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_paths(spark):
    assert col(spark, ["http://h:1/a//b/{id}?q", "/a/:x/<y>/*", "a/v{n}.json", "", None, "${X}"], K.path_template) == ["/a/b/{}", "/a/{}/{}/{}", "/a/v{}.json", "/", None, "/{}"]
    assert col(spark, ["/a/{id}/{x}", None], K.positional) == ["/a/{}/{}", None]
    assert col(spark, ["get", " Any ", "FETCH", None], K.http_method) == ["GET", "ANY", "GET", "GET"]
    assert col(spark, ["a/../../b/./c", "/x//y", "..", ""], K.safe_path) == ["b/c", "x/y", "", ""]
    assert col(spark, ["services/a/b.py", "services/a", "deploy/x/y", "K8s/x", "src/m/n", "docs/x", "top", "/a//b"], K.module_of) == ["services/a", "services", "", "", "src/m", "docs", "", "a"]
    assert col(spark, ["a-b-c", "-x", "", "abc"], K.domain_of) == ["a", "(unnamed)", "(unnamed)", "abc"]


def test_names(spark):
    assert col(spark, ["p.q.OrdersService/Get", "HTTPGateway", "x"], K.kebab) == ["orders-service", "httpgateway", "x"]
    assert col(spark, ["A.svc.cluster.local", "a.b.svc", "x"], K.bare_host) == ["a", "a", "x"]
    assert col(spark, ["R/Img:1.2", "r:5000/img", "i@sha256:abc"], K.image_key) == ["r/img", "r:5000/img", "i"]
    assert col(spark, ["https://github.com/o/r.git", "git@host.io:o/r", "-x", "ftp://a/b/c", None], K.git_repo) == ["o_r", "host-io_o_r", None, None, None]
    assert col(spark, ["a.com", "db.internal", "x.svc.local", "localhost", "1.2.3.4", None], K.looks_external) == [True, False, False, False, False, False]
    assert col(spark, ["lb://a/x", "wss://b", "http://u:p@H:1/p?q", "${X}", "/r", "zz"], lambda c: K.url_class(c)["kind"]) == ["load_balanced", "websocket", "absolute", "variable", "relative", "opaque"]
    assert col(spark, ["a/b.c:12", "a:b:3-9", "x", None], lambda c: K.evidence_span(c)["last"]) == [12, 9, None, None]


def test_ids_and_hmac(spark):
    want = "r:File:" + hashlib.sha256(b"r:File:p:n:").hexdigest()[:16]
    assert col(spark, ["p"], lambda c: K.node_id(F.lit("r"), F.lit("File"), c, F.lit("n")))[0] == want
    for key in ("k", "x" * 100):
        assert col(spark, ["väl", ""], lambda c: S.hmac16(c, key)) == [hmac.new(key.encode(), v.encode(), hashlib.sha256).hexdigest()[:16] for v in ("väl", "")]


def test_numbers(spark):
    assert [round(x, 6) for x in col(spark, ["", "aaaa", "abcd", "aab"], S.entropy_bits)] == [0.0, 0.0, 2.0, round(-(2 / 3) * math.log2(2 / 3) - (1 / 3) * math.log2(1 / 3), 6)]
    w = spark.createDataFrame([(0, 0), (5, 10), (10, 10), (3, 2)], "s int, n int").select(S.wilson(F.col("s"), F.col("n")).alias("w")).collect()
    assert [tuple(r.w) if r.w else None for r in w] == [(0.0, 1.0), (0.2366, 0.7634), (0.7225, 1.0), None]
    one = spark.createDataFrame([([0.5, 0.5],), ([],)], "a array<double>")
    assert [r[0] for r in one.select(S.noisy_or(F.col("a"))).collect()] == [0.75, 0.0]
    assert [tuple(r[0]) for r in one.select(S.path_confidence(F.col("a"))).collect()] == [(0.25, 0.5), (0.0, 0.0)]
    vals = [("A_TOKEN", "x"), ("A", "http://h"), ("A", "true"), ("A", "-1.5"), ("A", "a.b:80"), ("A", "lenient"), ("A", ""), ("A", None), ("A", "aB3$kQ9!zX7@wE5^rT1&")]
    df = spark.createDataFrame(vals, "n string, v string").select(S.value_class(F.col("n"), F.col("v")))
    assert [r[0] for r in df.collect()] == ["secret", "url", "boolean", "number", "hostname", "enum", "opaque", "opaque", "secret"]
