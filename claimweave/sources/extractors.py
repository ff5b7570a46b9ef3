"""Extraction of sites and declarations from files: one Arrow pass, one row per hit.

A hit has a slot (what it is), up to three values (a, b, c) and the line it stands on. Pattern extractors are a table of
regular expressions for a language; structured formats (YAML, JSON, lock files, proto, GraphQL, CODEOWNERS) have functions.
Files are routed by language, extension and name before any pattern runs. A file that cannot be read in its format gives no
rows and one row in the slot `error`; no extractor ever fails a task. Texts are read whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.runtime import ship_package
from claimweave.sources.extract import LANGUAGES, file_language

Hit = tuple[str, int, str, str, str]
SCHEMA = "repo_id string, path string, slot string, line bigint, a string, b string, c string"
JS = ("JavaScript", "TypeScript")
JVM = ("Java", "Kotlin")

#: (slot, languages, pattern, groups that become a, b, c); fixed values of public frameworks.
PATTERNS: list[tuple[str, tuple[str, ...], str, tuple[int, ...]]] = [
    ("http_call", ("Python",), r"\b(?:requests|httpx|session|client|aiohttp)\.(get|post|put|patch|delete|head)\(\s*f?[\"']([^\"'\s]+)[\"']", (1, 2)),
    ("http_call", JS, r"\b(?:axios|got|ky|superagent|http|\$http|client)\.(get|post|put|patch|delete|head)\(\s*[\"'`]([^\"'`\s]+)[\"'`]", (1, 2)),
    ("http_call", JS, r"()\bfetch\(\s*[\"'`]([^\"'`\s]+)[\"'`]", (1, 2)),
    ("websocket", JS, r"new (WebSocket|EventSource)\(\s*[\"'`]([^\"'`\s]+)[\"'`]", (1, 2)),
    ("http_call", JVM, r"\.(getForObject|getForEntity|postForObject|postForEntity|exchange)\(\s*\"([^\"]+)\"", (1, 2)),
    ("http_call", JVM, r"\.(get|post|put|patch|delete)\(\)\s*\.uri\(\s*\"([^\"]+)\"", (1, 2)),
    ("http_call", ("Go",), r"\bhttp\.(Get|Post|Head)\(\s*\"([^\"]+)\"", (1, 2)),
    ("http_call", ("Go",), r"\bhttp\.NewRequest(?:WithContext)?\((?:\w+,\s*)?\"?(?:http\.Method)?(\w+)\"?,\s*\"([^\"]+)\"", (1, 2)),
    ("http_call", ("Ruby",), r"\b(?:Faraday|HTTParty|RestClient)\.(get|post|put|patch|delete)\(?\s*[\"']([^\"']+)[\"']", (1, 2)),
    ("http_call", ("PHP",), r"\b(?:Http::|->)(get|post|put|patch|delete)\(\s*[\"'](https?://[^\"']+)[\"']", (1, 2)),
    ("http_call", ("CSharp",), r"\.(Get|Post|Put|Patch|Delete)(?:String|FromJson|AsJson)?Async\(\s*\"([^\"]+)\"", (1, 2)),
    ("http_call", ("Rust",), r"reqwest::(?:Client::new\(\)\.)?(get|post|put|patch|delete)\(\s*\"([^\"]+)\"", (1, 2)),
    ("feign", JVM, r"@FeignClient\([^)]*?(?:name|value)?\s*=?\s*\"([\w.-]+)\"", (1,)),
    ("webhook", ("Python", *JS, *JVM, "Go"), r"(?i)\b(callback_?url|webhook_?url)[\"']?\s*[:=]\s*[\"'](https?://[^\"']+)[\"']", (1, 2)),
    ("route", ("Python",), r"@\w+\.(get|post|put|patch|delete|route)\(\s*[\"']([^\"']+)[\"']", (1, 2)),
    ("route", JS, r"\b(?:app|router|server|fastify)\.(get|post|put|patch|delete|all|use)\(\s*[\"'`](/[^\"'`]*)[\"'`]", (1, 2)),
    ("route", JS, r"@(Get|Post|Put|Patch|Delete|All)\(\s*[\"'`]?([^\"'`)]*)[\"'`]?\s*\)", (1, 2)),
    ("route", JVM, r"@(Get|Post|Put|Patch|Delete|Request)Mapping\(\s*(?:(?:value|path)\s*=\s*)?\{?\s*\"([^\"]*)\"", (1, 2)),
    ("route", ("Go",), r"\.(GET|POST|PUT|PATCH|DELETE|Get|Post|Put|Patch|Delete|HandleFunc|Handle)\(\s*\"(/[^\"]*)\"", (1, 2)),
    ("route", ("Ruby",), r"^\s*(get|post|put|patch|delete)\s+[\"']([^\"']+)[\"']", (1, 2)),
    ("route", ("PHP",), r"Route::(get|post|put|patch|delete|any)\(\s*[\"']([^\"']+)[\"']", (1, 2)),
    ("route", ("CSharp",), r"\[Http(Get|Post|Put|Patch|Delete)\(\s*\"([^\"]*)\"", (1, 2)),
    ("publish", JVM, r"\b(kafka)Template\.send\(\s*\"([\w.-]+)\"", (1, 2)),
    ("consume", JVM, r"@(Kafka)Listener\([^)]*topics\s*=\s*\{?\s*\"([\w.-]+)\"", (1, 2)),
    ("publish", ("Python",), r"\b(producer)\.(?:send|produce)\(\s*[\"']([\w.-]+)[\"']", (1, 2)),
    ("consume", ("Python",), r"\b(?:Kafka)?(C|c)onsumer(?:\(|\.subscribe\(\[?)\s*[\"']([\w.-]+)[\"']", (1, 2)),
    ("publish", JS, r"\b(producer)\.send\(\{\s*topic:\s*[\"'`]([\w.-]+)[\"'`]", (1, 2)),
    ("consume", JS, r"\b(consumer)\.subscribe\(\{\s*topics?:\s*\[?[\"'`]([\w.-]+)[\"'`]", (1, 2)),
    ("publish", ("Go",), r"(Topic):\s*\"([\w.-]+)\"", (1, 2)),
    ("env", ("Python",), r"os\.(?:environ(?:\.get\(|\[)|getenv\()\s*[\"']([A-Z][A-Z0-9_]*)[\"']", (1,)),
    ("env", JS, r"process\.env\.([A-Z][A-Z0-9_]*)", (1,)),
    ("env", JVM, r"System\.getenv\(\s*\"([A-Z][A-Z0-9_]*)\"|\$\{([A-Z][A-Z0-9_]*)(?::[^}]*)?\}", (1, 2)),
    ("env", ("Go",), r"os\.(?:Getenv|LookupEnv)\(\s*\"([A-Z][A-Z0-9_]*)\"", (1,)),
    ("table", JVM, r"@(Table)\([^)]*name\s*=\s*\"(\w+)\"", (1, 2)),
    ("table", ("Python",), r"__(tablename)__\s*=\s*[\"'](\w+)[\"']", (1, 2)),
    ("table", JS, r"@(Entity)\(\s*[\"'`](\w+)[\"'`]", (1, 2)),
    ("table", ("Go",), r"func \(\*?\w+\) (TableName)\(\) string \{\s*return \"(\w+)\"", (1, 2)),
    ("bucket", ("Python", *JS, *JVM, "Go"), r"(?i)\b(bucket)(?:_?name)?[\"']?\s*[:=]\s*[\"']([a-z0-9][a-z0-9.-]{2,62})[\"']", (1, 2)),
    ("spark_io", ("Python",), r"\.(table|saveAsTable|parquet|insertInto)\(\s*[\"']([^\"']+)[\"']", (1, 2)),
    ("grpc_server", ("Python",), r"\badd_(\w+)Servicer_to_server\(", (1,)),
    ("grpc_server", ("Go",), r"\.Register(\w+)Server\(", (1,)),
    ("grpc_server", JVM, r"extends (\w+)Grpc\.\w+ImplBase", (1,)),
    ("grpc_stub", ("Python",), r"\b(\w+)Stub\(", (1,)),
    ("grpc_stub", ("Go",), r"\.New(\w+)Client\(", (1,)),
    ("grpc_stub", JVM, r"(\w+)Grpc\.new(?:Blocking|Future)?Stub\(", (1,)),
    ("graphql_use", JS, r"\bgql`\s*(query|mutation|subscription)\s+(\w+)", (1, 2)),
    ("flag", ("Python", *JS, *JVM, "Go"), r"\b(?:isEnabled|is_enabled|variation|boolVariation|BoolVariation)\(\s*[\"']([\w.-]+)[\"']", (1,)),
    ("mcp_tool", ("Python",), r"@(\w+)\.tool\(\)?[^\n]*\n\s*(?:async )?def (\w+)\(", (1, 2)),
    ("llm_call", ("Python", *JS), r"\b(?:model)[\"']?\s*[:=]\s*[\"']([\w./-]+)[\"']", (1,)),
    ("import", ("Python",), r"^(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))", (1, 2)),
    ("import", JS, r"\bfrom\s+[\"']([^\"']+)[\"']|\brequire\(\s*[\"']([^\"']+)[\"']\s*\)", (1, 2)),
    ("import", JVM, r"^import\s+(?:static\s+)?([\w.]+)", (1,)),
    ("import", ("Go",), r"^\s*(?:import\s+)?(?:\w+\s+)?\"([\w./-]+)\"\s*$", (1,)),
    ("class", ("Python",), r"^\s*class\s+(\w+)", (1,)),
    ("class", (*JS, *JVM), r"\b(?:class|interface|enum)\s+(\w+)", (1,)),
    ("class", ("Go",), r"^type\s+(\w+)\s+(struct|interface)", (1, 2)),
    ("function", ("Python",), r"^\s*(?:async\s+)?def\s+(\w+)\s*\(", (1,)),
    ("function", JS, r"\bfunction\s+(\w+)\s*\(", (1,)),
    ("function", ("Go",), r"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*[(\[]", (1,)),
    ("function", JVM, r"^\s*(?:public|protected|private)\b[^=;(\n]*\s(\w+)\s*\([^;{]*\{", (1,)),
]
_COMPILED = [(slot, langs, re.compile(p, re.M), groups) for slot, langs, p, groups in PATTERNS]


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def by_patterns(language: str, text: str) -> Iterator[Hit]:
    """Hits of all patterns of a language; groups that did not take part are skipped."""
    for slot, langs, pattern, groups in _COMPILED:
        if language in langs:
            for m in pattern.finditer(text):
                v = [m.group(g) or "" for g in groups]
                if len(groups) == 2 and not v[0] and slot in ("env", "import"):
                    v = [v[1], ""]
                v += [""] * (3 - len(v))
                yield (slot, _line(text, m.start()), *v)


def proto(text: str) -> Iterator[Hit]:
    """Services and their calls: rpc(service, method, streaming)."""
    package = m.group(1) if (m := re.search(r"^\s*package\s+([\w.]+)\s*;", text, re.M)) else ""
    for s in re.finditer(r"\bservice\s+(\w+)\s*\{", text):
        depth, end = 1, s.end()
        while end < len(text) and depth:
            depth += (text[end] == "{") - (text[end] == "}")
            end += 1
        for r in re.finditer(r"\brpc\s+(\w+)\s*\(\s*(stream\s+)?[\w.]+\s*\)\s*returns\s*\(\s*(stream\s+)?", text[s.end() : end]):
            mode = ("client" if r.group(2) else "") + ("server" if r.group(3) else "") or "unary"
            yield ("rpc", _line(text, s.end() + r.start()), f"{package}.{s.group(1)}" if package else s.group(1), r.group(1), mode)


def graphql_schema(text: str) -> Iterator[Hit]:
    """Fields of the root types: field(type, name, federated)."""
    federated = str(bool(re.search(r"@key\b|@link\b|extend\s+type", text))).lower()
    for t in re.finditer(r"(?:extend\s+)?\btype\s+(Query|Mutation|Subscription)\b[^{]*\{", text):
        end = text.find("}", t.end())
        for f in re.finditer(r"^\s*(\w+)\s*(?:\([^)]*\))?\s*:", text[t.end() : end if end >= 0 else len(text)], re.M):
            yield ("field", _line(text, t.end() + f.start(1)), t.group(1), f.group(1), federated)


def dockerfile(text: str) -> Iterator[Hit]:
    for m in re.finditer(r"(?im)^FROM\s+(?:--\S+\s+)?(\S+)(?:\s+AS\s+(\S+))?", text):
        yield ("base_image", _line(text, m.start()), m.group(1), m.group(2) or "", "")
    for m in re.finditer(r"(?im)^(?:ENV|ARG)\s+([A-Za-z_]\w*)[= ]?(.*)$", text):
        yield ("docker_env", _line(text, m.start()), m.group(1), m.group(2).strip(), "")


def terraform(text: str) -> Iterator[Hit]:
    for m in re.finditer(r"(?m)^\s*(resource|module|data)\s+\"([\w-]+)\"(?:\s+\"([\w-]+)\")?", text):
        yield ("iac", _line(text, m.start()), m.group(1), m.group(2), m.group(3) or "")


def nginx(text: str) -> Iterator[Hit]:
    """Locations and where they are passed on to: gateway(prefix, target, strip)."""
    for m in re.finditer(r"location\s+(?:[=~^*]+\s+)?(\S+)\s*\{([^}]*)\}", text):
        if p := re.search(r"proxy_pass\s+https?://([^/;\s]+)(/[^;\s]*)?\s*;", m.group(2)):
            yield ("gateway", _line(text, m.start()), m.group(1), p.group(1), str(bool(p.group(2))).lower())


def migration(text: str) -> Iterator[Hit]:
    for action, pattern in (("create", r"create\s+table\s+(?:if\s+not\s+exists\s+)?"), ("alter", r"alter\s+table\s+(?:only\s+)?"), ("drop", r"drop\s+table\s+(?:if\s+exists\s+)?"), ("write", r"(?:insert\s+into|delete\s+from)\s+"), ("read", r"(?:from|join)\s+")):
        for m in re.finditer(r"(?i)\b" + pattern + r"[\"`\[]?([\w.]+)", text):
            yield ("sql", _line(text, m.start()), action, m.group(1).lower(), "")


def codeowners(text: str) -> Iterator[Hit]:
    for n, line in enumerate(text.split("\n"), 1):
        parts = line.split("#")[0].split()
        for owner in parts[1:]:
            yield ("owner", n, parts[0], owner.lstrip("@").lower(), "")


def requirements(text: str) -> Iterator[Hit]:
    for n, line in enumerate(text.split("\n"), 1):
        if m := re.match(r"\s*([A-Za-z0-9][\w.-]*)(?:\[[^\]]*\])?\s*(?:([=<>!~]=?)\s*([\w.*-]+))?", line.split("#")[0]):
            yield ("dependency", n, "pypi", m.group(1), m.group(3) or "")


def go_mod(text: str) -> Iterator[Hit]:
    for m in re.finditer(r"(?m)^\s*(?:require\s+)?([\w.-]+\.[\w./-]+)\s+(v[\w.+-]+)", text):
        yield ("dependency", _line(text, m.start()), "golang", m.group(1), m.group(2))


def package_json(text: str) -> Iterator[Hit]:
    root = json.loads(text)
    if isinstance(root, dict):
        if root.get("name"):
            yield ("publish_identity", _key_line(text, "name"), "npm", str(root["name"]), str(bool(root.get("private"))).lower())
        for group in ("dependencies", "devDependencies", "peerDependencies"):
            for name, version in (root.get(group) or {}).items():
                yield ("dependency", _key_line(text, name), "npm", name, str(version))


def _key_line(text: str, key: str) -> int:
    """Line that declares a key, not one that mentions it."""
    m = re.search(r"\"" + re.escape(key) + r"\"\s*:", text)
    return _line(text, m.start()) if m else 1


def pom(text: str) -> Iterator[Hit]:
    for m in re.finditer(r"<dependency>(.*?)</dependency>", text, re.S):
        part = lambda t: (x.group(1).strip() if (x := re.search(rf"<{t}>(.*?)</{t}>", m.group(1), re.S)) else "")  # noqa: B023, E731
        yield ("dependency", _line(text, m.start()), "maven", f"{part('groupId')}:{part('artifactId')}", part("version"))


def lock(text: str) -> Iterator[Hit]:
    for m in re.finditer(r"name = \"([^\"]+)\"\s+version = \"([^\"]*)\"", text):
        yield ("locked", _line(text, m.start()), "", m.group(1), m.group(2))
    for m in re.finditer(r"\"node_modules/([^\"]+)\":\s*\{\s*\"version\":\s*\"([^\"]*)\"", text):
        yield ("locked", _line(text, m.start()), "npm", m.group(1), m.group(2))


def _documents(text: str) -> Iterable:
    import yaml

    return [d for d in yaml.load_all(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader)) if isinstance(d, dict)]


def _as_list(x) -> list:
    return x if isinstance(x, list) else [] if x is None else [x]


def compose(doc: dict) -> Iterator[Hit]:
    for name, s in (doc.get("services") or {}).items():
        s = s if isinstance(s, dict) else {}
        build = s.get("build")
        yield ("compose_service", 1, str(name), str(s.get("image") or ""), str(build.get("context") if isinstance(build, dict) else build or ""))
        deps = s.get("depends_on")
        for d in deps if isinstance(deps, (list, dict)) else []:
            yield ("compose_dependency", 1, str(name), str(d), "")
        env = s.get("environment") or {}
        pairs = env.items() if isinstance(env, dict) else [str(x).partition("=")[::2] for x in env]
        for k, v in pairs:
            yield ("compose_env", 1, str(name), str(k), "" if v is None else str(v))


def kubernetes(doc: dict) -> Iterator[Hit]:
    kind, meta, spec = str(doc.get("kind")), doc.get("metadata") or {}, doc.get("spec") or {}
    name, ns = str(meta.get("name") or ""), str(meta.get("namespace") or "default")
    yield ("k8s", 1, kind, ns, name)
    pod = (((spec.get("jobTemplate") or {}).get("spec") or spec).get("template") or {}).get("spec") or (spec if kind == "Pod" else {})
    for c in [*_as_list(pod.get("initContainers")), *_as_list(pod.get("containers"))]:
        yield ("k8s_image", 1, name, str(c.get("image") or ""), str(c.get("name") or ""))
        for e in _as_list(c.get("env")):
            ref = e.get("valueFrom") or {}
            r = ref.get("secretKeyRef") or ref.get("configMapKeyRef") or {}
            yield ("k8s_env", 1, name, str(e.get("name")), str(e.get("value") if "value" in e else f"ref:{r.get('name')}/{r.get('key')}"))
    if kind == "Service":
        for k, v in (spec.get("selector") or {}).items():
            yield ("k8s_selector", 1, name, str(k), str(v))
    for rule in _as_list(spec.get("rules")) if kind in ("Ingress", "HTTPRoute") else []:
        for p in ((rule.get("http") or {}).get("paths") or []):
            back = ((p.get("backend") or {}).get("service") or {}).get("name")
            yield ("k8s_route", 1, str(rule.get("host") or ""), str(p.get("path") or "/"), str(back or ""))
    for k, v in (doc.get("data") or {}).items() if kind == "ConfigMap" else ():
        yield ("k8s_config", 1, name, str(k), str(v))


def openapi(doc: dict) -> Iterator[Hit]:
    for path, item in (doc.get("paths") or {}).items():
        for method, op in item.items() if isinstance(item, dict) else ():
            if method.lower() in ("get", "post", "put", "patch", "delete", "head", "options"):
                yield ("declared", 1, method.upper(), str(path), str(bool(isinstance(op, dict) and op.get("deprecated"))).lower())


def asyncapi(doc: dict) -> Iterator[Hit]:
    for name, ch in (doc.get("channels") or {}).items():
        ch = ch if isinstance(ch, dict) else {}
        yield ("channel", 1, str(ch.get("address") or name), ",".join(k for k in ("publish", "subscribe") if k in ch), "")


def catalog(doc: dict) -> Iterator[Hit]:
    spec, meta = doc.get("spec") or {}, doc.get("metadata") or {}
    yield ("entity", 1, str(doc.get("kind")), str(meta.get("name") or ""), str(spec.get("owner") or ""))
    for api in _as_list(spec.get("providesApis")):
        yield ("entity_api", 1, str(meta.get("name") or ""), str(api), "provides")


def avro(doc: dict) -> Iterator[Hit]:
    if doc.get("type") == "record":
        yield ("schema", 1, str(doc.get("namespace") or ""), str(doc.get("name") or ""), str(len(doc.get("fields") or [])))


def dbt(doc: dict) -> Iterator[Hit]:
    for m in _as_list(doc.get("models")):
        yield ("model", 1, str(m.get("name")), "", "")
    for s in _as_list(doc.get("sources")):
        for t in _as_list(s.get("tables")):
            yield ("source_table", 1, str(s.get("name")), str(t.get("name")), "")


def structured(name: str, text: str) -> Iterator[Hit]:
    """Documents of YAML or JSON text, by their shape."""
    for doc in [json.loads(text)] if name.endswith((".json", ".avsc")) else _documents(text):
        if not isinstance(doc, dict):
            continue
        if "apiVersion" in doc and "backstage" in str(doc["apiVersion"]):
            yield from catalog(doc)
        elif "apiVersion" in doc and "kind" in doc:
            yield from kubernetes(doc)
        elif isinstance(doc.get("services"), dict):
            yield from compose(doc)
        if "openapi" in doc or "swagger" in doc:
            yield from openapi(doc)
        if "asyncapi" in doc:
            yield from asyncapi(doc)
        if doc.get("type") == "record":
            yield from avro(doc)
        if "models" in doc or "sources" in doc and isinstance(doc["sources"], list) and "version" in doc and "mappings" not in doc:
            yield from dbt(doc)


def sql_templates(text: str) -> Iterator[Hit]:
    """Lineage of SQL templates: ref and source calls."""
    for m in re.finditer(r"\{\{\s*(ref|source)\(\s*['\"]([\w.]+)['\"](?:\s*,\s*['\"]([\w.]+)['\"])?\s*\)\s*\}\}", text):
        yield ("lineage", _line(text, m.start()), m.group(1), m.group(2), m.group(3) or "")


#: Extractors by file name or extension; registered ones come first.
BY_NAME: dict[str, Callable[[str], Iterator[Hit]]] = {
    "dockerfile": dockerfile, "codeowners": codeowners, "requirements.txt": requirements, "go.mod": go_mod, "package.json": package_json, "pom.xml": pom, "cargo.lock": lock, "poetry.lock": lock, "yarn.lock": lock, "package-lock.json": lock, "nginx.conf": nginx,
}
BY_EXTENSION: dict[str, Callable[[str], Iterator[Hit]]] = {".proto": proto, ".graphql": graphql_schema, ".gql": graphql_schema, ".tf": terraform, ".sql": migration}
REGISTERED: list[tuple[tuple[str, ...], Callable[[str], Iterator[Hit]]]] = []


def register_parser(parser: Callable[[str], Iterator[Hit]], extensions: tuple[str, ...]) -> None:
    """Add a parser for extensions; the newest one goes first and replaces built-in ones."""
    if not extensions:
        raise ValueError("a parser needs extensions")
    REGISTERED.insert(0, (tuple(x.lower() for x in extensions), parser))


def language_of(language: str | None, name: str | None) -> str | None:
    """The language of a file; where none is recorded, the one that its name stands for."""
    return language or (LANGUAGES.get(name.rsplit(".", 1)[-1].lower()) if name and "." in name else None)


def extract_file(name: str, language: str | None, text: str) -> Iterator[Hit]:
    low = (name or "").lower()
    language = language_of(language, name)
    ext = "." + low.rsplit(".", 1)[-1] if "." in low else ""
    for exts, parser in REGISTERED:
        if ext in exts:
            yield from parser(text)
            return
    if low in BY_NAME or low.startswith("dockerfile"):
        yield from BY_NAME.get(low, dockerfile)(text)
        return
    if ext in BY_EXTENSION:
        yield from BY_EXTENSION[ext](text)
        if ext == ".sql":
            yield from sql_templates(text)
    elif ext in (".yaml", ".yml", ".json", ".avsc"):
        yield from structured(low, text)
    elif language:
        yield from by_patterns(language, text)


def extract(files: DataFrame) -> DataFrame:
    """All hits of files (repo_id, path, name, language, content)."""
    spare = list(REGISTERED)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        REGISTERED[:] = spare
        for b in batches:
            out = []
            for repo, path, name, language, text in zip(b["repo_id"], b["path"], b["name"], b["language"], b["content"]):
                if not text:
                    continue
                try:
                    out.extend((repo, path, *h) for h in extract_file(name, language, text))
                except Exception as e:  # noqa: BLE001 - a file that cannot be read is counted, not fatal
                    out.append((repo, path, "error", 1, type(e).__name__, "", ""))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    ship_package(files.sparkSession)
    return files.select("repo_id", "path", "name", "language", "content").where("content is not null").mapInPandas(run, SCHEMA)


def coverage(files: DataFrame, hits: DataFrame) -> DataFrame:
    """Per language: files, files with hits, hits, and the tier (full, lite or none) of its extractors."""
    full = ("Python", *JS, *JVM, "Go")
    f = files.select("repo_id", "path", F.coalesce(file_language(), F.lit("Unknown")).alias("language")).distinct()
    n = hits.where("slot <> 'error'").groupBy("repo_id", "path").agg(F.count("*").alias("n"))
    g = f.join(n, ["repo_id", "path"], "left").groupBy("language").agg(F.count("*").alias("n_files"), F.count("n").alias("n_with_hits"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_hits"))
    return g.withColumn("tier", F.when(F.col("language").isin(*full), "full").when(F.col("language").isin("YAML", "JSON", "XML", "Properties", "Ruby", "PHP", "CSharp", "Rust"), "lite").otherwise("none"))


def call_graph(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """Callee of call sites (site_id, repo_id, path, line, callee) among symbols (repo_id, path, name, start, end): the smallest
    symbol around the site is the caller. A callee of the same file goes before others, the nearest one first; among
    other files, where distance says nothing, the first by path and line. Symbols of other files are reduced per name and
    repository before a site meets them, so a name that everything uses makes no pairs."""
    from pyspark.sql import Window

    around = sites.join(symbols.select("repo_id", "path", F.col("name").alias("caller"), "start", "end"), ["repo_id", "path"], "left").where(F.col("start").isNull() | F.col("line").between(F.col("start"), F.col("end")))
    caller = around.withColumn("_r", F.row_number().over(Window.partitionBy("site_id").orderBy(F.col("end") - F.col("start"), "caller"))).where("_r = 1").select("site_id", "caller")
    named = symbols.select("repo_id", "path", F.col("name").alias("callee"), F.col("start").alias("at"))
    here = sites.join(named, ["repo_id", "path", "callee"]).groupBy("site_id").agg(F.min(F.struct(F.abs(F.col("line") - F.col("at")).alias("d"), "path", "at")).alias("h"), F.count("*").alias("n_here"))
    there = named.groupBy("repo_id", "callee").agg(F.min(F.struct("path", "at")).alias("t"), F.count("*").alias("n_there"))
    hit = sites.select("site_id", "repo_id", "callee").distinct().join(here, "site_id", "left").join(there, ["repo_id", "callee"], "left")
    n = F.coalesce("n_here", "n_there")
    hit = hit.where(n.isNotNull()).select("site_id", F.coalesce("h.path", "t.path").alias("callee_path"), F.when(n == 1, 0.9).otherwise(0.7).alias("confidence"))
    return sites.select("site_id", "callee").distinct().join(caller, "site_id", "left").join(hit, "site_id", "left")
