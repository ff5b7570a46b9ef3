"""Canonical keys and identities as column expressions: null in, null out unless a docstring says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: HTTP methods that stay as they are; all others become GET (fixed values).
METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS", "ANY")
#: Names too common to identify anything (fixed values).
GENERIC_NAMES = ("app", "api", "server", "service", "web", "main", "backend", "frontend", "worker", "gateway")
#: Ecosystem names and their package-URL types (fixed values).
ECOSYSTEMS = {"npm": "npm", "yarn": "npm", "pnpm": "npm", "pip": "pypi", "pypi": "pypi", "poetry": "pypi", "maven": "maven", "gradle": "maven", "go": "golang", "golang": "golang", "cargo": "cargo", "composer": "composer", "gem": "gem", "rubygems": "gem", "nuget": "nuget"}
#: Host labels that mean the inside of a cluster or network (fixed values).
INTERNAL_TAILS = ("local", "internal", "svc", "cluster", "localdomain", "lan", "intranet")
#: Suffixes that services are named with or without (fixed values).
NAME_SUFFIXES = ("service", "server", "svc", "srv", "api", "app")
#: Directories that hold modules, and directories that are no module (fixed values).
CONTAINER_DIRS = ("projects", "services", "apps", "packages", "modules", "libs", "components", "cmd", "src")
INFRA_DIRS = ("deploy", "deployment", "deployments", "docker", "dockerfiles", "k8s", "kubernetes", "kube", "manifests", "manifest",
 "chart", "charts", "helm", "helmfile", "kustomize", "overlays", "infra", "infrastructure", "terraform", "tf", "ansible",
 "ops", "argocd", "flux", "skaffold", "compose", "ci", "build", "scripts", "config", "configs", "etc", "env", "environments", ".github", ".gitlab", ".circleci")


def path_template(path: Column) -> Column:
    """A route with every parameter as `{}`: scheme and host cut, slashes collapsed, one leading slash."""
    bare = F.regexp_replace(F.trim(path), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    bare = F.regexp_replace(bare, r"[?#].*$", "")
    parts = F.filter(F.split(bare, "/"), lambda s: s != "")
    param = r"^(\$?\{[^}]*\}|:[A-Za-z_]\w*|<[^>]*>|\*+)$"
    inner = r"\$?\{[^}]*\}|<[^>]*>"
    return F.concat(F.lit("/"), F.array_join(F.transform(parts, lambda s: F.when(s.rlike(param), F.lit("{}")).otherwise(F.regexp_replace(s, inner, "{}"))), "/"))


def positional(template: Column) -> Column:
    """Only braces are replaced: `{id}` to `{}`."""
    return F.regexp_replace(template, r"\{[^}]*\}", "{}")


def http_method(method: Column) -> Column:
    """Upper case; unknown, blank and null methods become GET."""
    m = F.upper(F.trim(method))
    return F.when(m.isin(*METHODS), m).otherwise(F.lit("GET"))


def squash(name: Column) -> Column:
    """For comparisons only: lower case without `-`, `_` and `.`."""
    return F.translate(F.lower(name), "-_.", "")


def bare_name(name: Column) -> Column:
    """The squashed name without a service suffix; a name that is nothing else keeps it."""
    return F.regexp_replace(squash(name), "^(.+)(?:" + "|".join(NAME_SUFFIXES) + ")$", "$1")


def is_generic(name: Column) -> Column:
    return F.coalesce(F.lower(F.trim(name)).isin(*GENERIC_NAMES), F.lit(False))


def purl(ecosystem: Column, name: Column) -> Column:
    """Package URL without version; unknown ecosystems are generic; names fold case where their registry does, `_` is `-` for pypi."""
    table = F.create_map(*[F.lit(x) for kv in ECOSYSTEMS.items() for x in kv])
    eco = F.coalesce(table[F.lower(ecosystem)], F.lit("generic"))
    n = F.when(eco == "pypi", F.translate(F.lower(name), "_", "-")).when(eco.isin("nuget", "gem", "golang"), F.lower(name)).otherwise(name)
    return F.concat(F.lit("pkg:"), eco, F.lit("/"), F.when(eco == "maven", F.translate(n, ":", "/")).otherwise(n))


def has_prefix(name: Column, prefixes: list[str]) -> Column:
    """Whether the name starts with any prefix of a configured list."""
    return F.exists(F.array(*[F.lit(p) for p in prefixes]), lambda p: F.startswith(name, p)) if prefixes else F.lit(False)


def service_key(scope: Column, name: Column) -> Column:
    return F.lower(F.concat_ws(":", F.coalesce(F.nullif(F.trim(scope), F.lit("")), F.lit("default")), F.trim(name)))


def http_key(method: Column, path: Column) -> Column:
    return F.concat(http_method(method), F.lit(":"), path_template(path))


def scoped_key(kind: Column, name: Column) -> Column:
    return F.concat_ws(":", kind, name)


def image_key(image: Column) -> Column:
    """Image reference without digest and tag, lower case."""
    bare = F.regexp_replace(F.trim(image), r"@sha256:[0-9a-fA-F]+$", "")
    return F.lower(F.regexp_replace(bare, r":[^:/]*$", ""))


def node_id(repo: Column, kind: Column, path: Column, name: Column, extra: Column | None = None) -> Column:
    """repo:Type:first 16 hex digits of a SHA-256 over the parts; null parts count as empty."""
    parts = [F.coalesce(c, F.lit("")) for c in (repo, kind, path, name, extra if extra is not None else F.lit(""))]
    return F.concat_ws(":", repo, kind, F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16))


def symbol_extra(name: Column, arity: Column, occurrence: Column) -> Column:
    return F.concat_ws(":", F.substring(F.sha1(F.concat_ws("#", name, arity.cast("string"))), 1, 8), occurrence.cast("string"))


def claim_id(repo: Column, kind: Column, direction: Column, key: Column, path: Column, subject: Column) -> Column:
    parts = [F.coalesce(c, F.lit("")) for c in (kind, direction, key, path, subject)]
    return F.concat_ws(":", repo, F.lit("ContractClaim"), F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16))


def rendezvous_id(label: Column, key: Column) -> Column:
    return F.concat_ws(":", F.lit("global"), label, key)


def evidence_path(e: Column) -> Column:
    """Everything before the last colon."""
    return F.regexp_replace(e, r":[^:]*$", "")


def evidence_span(e: Column) -> Column:
    """struct(path, first, last) of `path:n` or `path:a-b`; lines are null where none is given."""
    at = lambda i: F.regexp_extract(e, r"^(.*):(\d+)(?:-(\d+))?$", i)
    number = lambda c: F.nullif(c, F.lit("")).cast("bigint")
    return F.struct(F.when(at(1) == "", e).otherwise(at(1)).alias("path"), number(at(2)).alias("first"), F.coalesce(number(at(3)), number(at(2))).alias("last"))


def safe_path(path: Column) -> Column:
    """Segments resolved: `.` and empty ones go, `..` takes the one before with it and never leaves the root."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    none = F.array().cast("array<string>")
    step = lambda acc, s: F.when(s.isin("", "."), acc).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, s))
    return F.array_join(F.aggregate(parts, none, step), "/")


def module_of(path: Column) -> Column:
    """The module a file lies in: '' for files of the root and of infrastructure, two segments below container directories."""
    p = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.when(F.size(p) < 2, "").when(p[0].isin(*CONTAINER_DIRS) & (F.size(p) > 2), F.concat_ws("/", p[0], p[1])).when(F.lower(p[0]).isin(*INFRA_DIRS), "").otherwise(p[0])


def domain_of(name: Column) -> Column:
    """Text before the first dash; '(unnamed)' for nothing."""
    return F.coalesce(F.nullif(F.substring_index(name, "-", 1), F.lit("")), F.lit("(unnamed)"))


def kebab(name: Column) -> Column:
    """Last part of a dotted PascalCase name in kebab case, without the method behind a slash."""
    short = F.substring_index(F.substring_index(name, "/", 1), ".", -1)
    return F.lower(F.regexp_replace(short, r"(?<=[a-z0-9])(?=[A-Z])", "-"))


def bare_host(host: Column) -> Column:
    """First label of a host without the cluster suffix, lower case."""
    return F.lower(F.substring_index(F.regexp_replace(host, r"\.svc(\.cluster\.local)?$", ""), ".", 1))


def git_repo(url: Column) -> Column:
    """owner_repo of an https or scp-like git URL (host slug in front for hosts other than github.com); null for others."""
    pat = r"^(?:https?://|git@|ssh://git@)([A-Za-z0-9.-]+)[:/]([\w.-]+)/([\w.-]+?)(?:\.git)?/?$"
    at = lambda i: F.regexp_extract(F.trim(url), pat, i)
    plain = F.concat_ws("_", at(2), at(3))
    return F.when(url.isNull() | (at(1) == ""), None).when(F.lower(at(1)) == "github.com", plain).otherwise(F.concat_ws("_", F.translate(F.lower(at(1)), ".", "-"), plain))


def url_class(url: Column) -> Column:
    """struct(kind, host, path) of a literal: load_balanced, websocket, absolute, variable, relative or opaque."""
    u = F.trim(url)
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1))
    path = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    kind = F.when(u.rlike(r"^lb://"), "load_balanced").when(u.rlike(r"^wss?://"), "websocket").when(u.rlike(r"^https?://"), "absolute").when(u.rlike(r"^\$\{"), "variable").when(u.rlike(r"^/"), "relative").otherwise("opaque")
    return F.struct(kind.alias("kind"), F.nullif(host, F.lit("")).alias("host"), F.when(kind == "relative", u).otherwise(F.nullif(path, F.lit(""))).alias("path"))


def looks_external(host: Column) -> Column:
    """Two labels or more, none after the first internal, and a top-level domain of letters."""
    labels = F.split(F.lower(host), r"\.")
    inside = F.arrays_overlap(F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(1))), F.array(*[F.lit(x) for x in INTERNAL_TAILS]))
    return F.coalesce((F.size(labels) >= 2) & F.element_at(labels, -1).rlike(r"^[a-z]{2,}$") & ~inside, F.lit(False))
