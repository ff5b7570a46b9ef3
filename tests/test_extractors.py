import pytest

from claimweave.sources import extract as X
from claimweave.sources import extractors as E

pytest.importorskip("yaml")
CASES = [
    ("a.py", "Python", "r = requests.get(f'http://billing/v1/x')\n", ("http_call", 1, "get", "http://billing/v1/x", "")),
    ("a.py", "Python", "\n@app.post('/v1/{id}')\nasync def f(): pass", ("route", 2, "post", "/v1/{id}", "")),
    ("a.py", "Python", "x = os.environ.get('A_URL')", ("env", 1, "A_URL", "", "")), ("a.py", "Python", "import os.path", ("import", 1, "os.path", "", "")),
    ("a.ts", "TypeScript", "await fetch(`/api/x`)", ("http_call", 1, "", "/api/x", "")), ("a.js", "JavaScript", "app.get('/x/:id', h)", ("route", 1, "get", "/x/:id", "")), ("a.js", "JavaScript", "const x = require('y')", ("import", 1, "y", "", "")),
    ("A.java", "Java", '@GetMapping("/v1/{id}")', ("route", 1, "Get", "/v1/{id}", "")), ("A.java", "Java", 'kafkaTemplate.send("orders.v1", x)', ("publish", 1, "kafka", "orders.v1", "")), ("A.java", "Java", '@FeignClient(name = "billing")', ("feign", 1, "billing", "", "")),
    ("a.go", "Go", 'r.GET("/x", h)', ("route", 1, "GET", "/x", "")), ("a.go", "Go", "pb.NewOrdersClient(c)", ("grpc_stub", 1, "Orders", "", "")),
    ("a.proto", None, "package p.q;\nservice S {\n  rpc Get(A) returns (stream B) {}\n}\n", ("rpc", 3, "p.q.S", "Get", "server")), ("a.graphql", None, "type Query {\n  order(id: ID): Order\n}", ("field", 2, "Query", "order", "false")),
    ("Dockerfile", None, "FROM a/b:1 AS x\nENV A=1", ("base_image", 1, "a/b:1", "x", "")), ("main.tf", None, 'resource "aws_sqs_queue" "q" {', ("iac", 1, "resource", "aws_sqs_queue", "q")), ("nginx.conf", None, "location /api/ {\n proxy_pass http://up:80/;\n}", ("gateway", 1, "/api/", "up:80", "true")),
    ("m.sql", None, "CREATE TABLE IF NOT EXISTS Orders (id int);", ("sql", 1, "create", "orders", "")), ("m.sql", None, "select * from {{ ref('stg') }}", ("lineage", 1, "ref", "stg", "")), ("CODEOWNERS", None, "# c\n*.py @Org/Team-A", ("owner", 2, "*.py", "org/team-a", "")),
    ("requirements.txt", None, "requests[x]==2.1 # c", ("dependency", 1, "pypi", "requests", "2.1")), ("go.mod", None, "module a\nrequire github.com/x/y v1.2.3", ("dependency", 2, "golang", "github.com/x/y", "v1.2.3")),
    ("package.json", None, '{"name": "n",\n "dependencies": {"left-pad": "^1"}}', ("dependency", 2, "npm", "left-pad", "^1")), ("pom.xml", None, "<dependency><groupId>g</groupId><artifactId>a</artifactId></dependency>", ("dependency", 1, "maven", "g:a", "")),
    ("docker-compose.yml", "YAML", "services:\n  web:\n    build: .\n    depends_on: [db]\n    environment: ['A=1']", ("compose_dependency", 1, "web", "db", "")),
    ("k.yaml", "YAML", "apiVersion: v1\nkind: Service\nmetadata: {name: s}\nspec: {selector: {app: s}}\n---\nx: 1", ("k8s_selector", 1, "s", "app", "s")),
    ("d.yaml", "YAML", "apiVersion: apps/v1\nkind: Deployment\nmetadata: {name: d}\nspec: {template: {spec: {containers: [{name: c, image: i, env: [{name: A, valueFrom: {secretKeyRef: {name: n, key: k}}}]}]}}}", ("k8s_env", 1, "d", "A", "ref:n/k")),
    ("o.yaml", "YAML", "openapi: 3.0.0\npaths: {/v1/x: {get: {deprecated: true}}}", ("declared", 1, "GET", "/v1/x", "true")), ("s.json", "JSON", '{"type": "record", "name": "R", "fields": [1]}', ("schema", 1, "", "R", "1")),
]


@pytest.mark.parametrize("name,language,text,want", CASES)
def test_hits(name, language, text, want):
    assert want in list(E.extract_file(name, language, text))


def test_frame_counts_errors_and_coverage(spark):
    rows = [("r", "a.json", "a.json", "JSON", "{broken", 1), ("r", "b.py", "b.py", "Python", "import os\n", 1), ("r", "n.py", "n.py", "Python", None, 1), (None, None, None, None, "x", 1), ("r", "e.go", "e.go", "Go", "", 1)]
    f = spark.createDataFrame(rows, "repo_id string, path string, name string, language string, content string, line int")
    hits = E.extract(f)
    assert sorted((r.path, r.slot, r.a) for r in hits.collect()) == [("a.json", "error", "JSONDecodeError"), ("b.py", "import", "os")]
    cov = {r.language: (r.n_files, r.n_with_hits, r.tier) for r in E.coverage(f, hits).collect()}
    assert cov["Python"] == (2, 1, "full") and cov["Unknown"] == (1, 0, "none")


def test_registered_parser_goes_first(spark, monkeypatch):
    monkeypatch.setattr(E, "REGISTERED", [])
    E.register_parser(lambda t: iter([("mine", 1, t, "", "")]), (".py",))
    assert list(E.extract_file("x.py", "Python", "z")) == [("mine", 1, "z", "", "")]
    with pytest.raises(ValueError):
        E.register_parser(lambda t: iter(()), ())


def test_expressions(spark):
    sql = spark.createDataFrame([(1, "insert into A.b select * from `C` join d on 1"), (2, None)], "id int, q string")
    assert sorted((r.action, r.table_name) for r in X.sql_tables(sql, "id", "q").collect()) == [("read", "c"), ("read", "d"), ("write", "a.b")]
    calls = spark.createDataFrame([(1, "axios.post('/x', y); fetch(\"/z\")")], "file_id int, content string")
    assert sorted((r.method, r.url) for r in X.http_calls(calls).collect()) == [("GET", "/z"), ("POST", "/x")]
    own = spark.createDataFrame([("r", "CODEOWNERS", "# x\n* @a @b # c\n")], "repo_id string, name string, content string")
    assert sorted((r.pattern, r.owner) for r in X.codeowners(own).collect()) == [("*", "@a"), ("*", "@b")]


def test_call_graph(spark):
    sites = spark.createDataFrame([(1, "r", "a", 12, "g"), (2, "r", "a", 3, "h"), (3, "r", "b", 1, "nope")], "site_id int, repo_id string, path string, line int, callee string")
    sym = spark.createDataFrame([("r", "a", "f", 10, 20), ("r", "a", "inner", 11, 13), ("r", "b", "g", 1, 2), ("r", "c", "h", 1, 2), ("r", "d", "h", 9, 9), ("r", "b", "x", 1, 5)], "repo_id string, path string, name string, start int, end int")
    out = {r.site_id: (r.caller, r.callee_path, r.confidence) for r in E.call_graph(sites, sym).collect()}
    assert out[1] == ("inner", "b", 0.9) and out[2] == (None, "c", 0.7) and out[3][1:] == (None, None)


def test_missing_language_comes_from_the_name(spark):
    for name, language, text, want in CASES[:11]:
        assert want in list(E.extract_file(name.upper(), None, text)) and want in list(E.extract_file(name, "", text))
    assert list(E.extract_file("a.txt", None, "import os")) == [] and list(E.extract_file(None, None, "import os")) == []
    rows = [(1, "r", "a.py", "a.py", None, "import os\n\ndef f(x):\n"), (2, "r", "B.GO", "B.GO", None, "func g() {"), (3, "r", "c.js", "c.js", "TypeScript", "function h() {"), (4, "r", "d", "d", None, "def i(x):"), (5, None, None, None, None, "def j(x):")]
    f = spark.createDataFrame(rows, "file_id int, repo_id string, path string, name string, language string, content string")
    assert sorted((r.file_id, r.language, r.symbol, r.pos) for r in X.symbols(f).collect()) == [(1, "Python", "f", 3), (2, "Go", "g", 1), (3, "TypeScript", "h", 1)]
    cov = {r.language: (r.n_files, r.n_with_hits) for r in E.coverage(f, E.extract(f)).collect()}
    assert cov["Python"] == (1, 1) and cov["Go"] == (1, 1) and cov["Unknown"] == (2, 0)
