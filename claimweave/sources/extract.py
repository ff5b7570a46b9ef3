"""Extraction from file text, as JVM expressions over whole texts: one row per match. Null content gives no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Languages with patterns by file extension, for files without a recorded language (fixed values).
LANGUAGES = {
    "py": "Python", "pyi": "Python", "js": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "jsx": "JavaScript", "ts": "TypeScript", "tsx": "TypeScript", "mts": "TypeScript", "cts": "TypeScript",
    "java": "Java", "kt": "Kotlin", "kts": "Kotlin", "go": "Go", "rb": "Ruby", "php": "PHP", "cs": "CSharp", "rs": "Rust", "yaml": "YAML", "yml": "YAML", "json": "JSON", "xml": "XML", "properties": "Properties",
}
#: How languages read the environment (fixed values).
ENV_READ = r"""(?:process\.env\.|os\.environ\[['"]|os\.getenv\(['"]|System\.getenv\("|os\.Getenv\(")([A-Z][A-Z0-9_]*)"""
#: Declarations of functions and methods per language (fixed values).
SYMBOL = {
    "Python": r"^\s*(?:async )?def (\w+)\(",
    "Go": r"^func (?:\([^)]*\) )?(\w+)\(",
    "JavaScript": r"^\s*(?:export )?(?:default )?(?:async )?function (\w+)\(",
    "TypeScript": r"^\s*(?:export )?(?:default )?(?:async )?function (\w+)\(",
    "Java": r"^\s*(?:public|protected|private)\b[^=;(]* (\w+)\([^;]*\{",
}
#: Client calls with a literal URL: method in group 1 where the call names it, URL in group 2 (fixed values).
HTTP_CALL = r"""(?:requests|httpx|axios|http|client|session)\.(get|post|put|patch|delete|head)\(\s*f?["'`]([^"'`\s]+)["'`]"""
FETCH_CALL = r"""\bfetch\(\s*["'`]([^"'`\s]+)["'`]"""
#: Tables in SQL text by what is done with them (fixed values).
SQL_TABLE = {
    "read": r"(?i)\b(?:from|join)\s+([\w.\"`\[\]]+)",
    "write": r"(?i)\b(?:insert\s+into|update|merge\s+into|delete\s+from)\s+([\w.\"`\[\]]+)",
    "create": r"(?i)\bcreate\s+table\s+(?:if\s+not\s+exists\s+)?([\w.\"`\[\]]+)",
    "alter": r"(?i)\balter\s+table\s+([\w.\"`\[\]]+)",
    "drop": r"(?i)\bdrop\s+table\s+(?:if\s+exists\s+)?([\w.\"`\[\]]+)",
}
SQL_WORDS = ("select", "where", "set", "values", "on", "as", "lateral", "unnest", "only", "if", "the", "a", "an")


def lines(files: DataFrame) -> DataFrame:
    """One row per line: the other columns, pos (from 1), line."""
    rest = [c for c in files.columns if c != "content"]
    return files.where("content is not null").select(*rest, F.posexplode(F.split("content", "\n")).alias("p", "line")).select(*rest, (F.col("p") + 1).cast("bigint").alias("pos"), "line")


def env_reads(files: DataFrame) -> DataFrame:
    return files.select("file_id", "language", F.explode(F.regexp_extract_all("content", F.lit(ENV_READ), F.lit(1))).alias("name"))


def properties(files: DataFrame) -> DataFrame:
    """Keys and values of properties files; comments and lines without `=` are skipped."""
    p = files.where(F.lower("name").endswith(".properties") & F.col("content").isNotNull())
    rows = p.select("file_id", F.explode(F.split(F.translate("content", "\r", ""), "\n")).alias("line")).where(F.col("line").contains("=") & ~F.col("line").rlike(r"^\s*[#!]"))
    return rows.select("file_id", F.trim(F.substring_index("line", "=", 1)).alias("key"), F.trim(F.expr("substring(line, instr(line, '=') + 1)")).alias("value"))


def file_language() -> Column:
    """The recorded language; where there is none, the one that the name stands for."""
    by_name = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.nullif("language", F.lit("")), F.element_at(by_name, F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1))))


def symbols(files: DataFrame) -> DataFrame:
    """Declared functions and methods with their line; the pattern is chosen by language before any matching."""
    l = lines(files.withColumn("language", file_language()).where(F.col("language").isin(*SYMBOL)))
    found = F.lit("")
    for language, pattern in SYMBOL.items():
        found = F.when(F.col("language") == language, F.regexp_extract("line", pattern, 1)).otherwise(found)
    return l.withColumn("symbol", found).where("symbol <> ''")


def http_calls(files: DataFrame) -> DataFrame:
    """Client calls with literal URLs: file_id, method, url."""
    named = files.select("file_id", F.explode(F.regexp_extract_all("content", F.lit(HTTP_CALL), F.lit(0))).alias("m"))
    named = named.select("file_id", F.upper(F.regexp_extract("m", HTTP_CALL, 1)).alias("method"), F.regexp_extract("m", HTTP_CALL, 2).alias("url"))
    plain = files.select("file_id", F.explode(F.regexp_extract_all("content", F.lit(FETCH_CALL), F.lit(1))).alias("url")).select("file_id", F.lit("GET").alias("method"), "url")
    return named.unionByName(plain)


def sql_tables(df: DataFrame, rid: str, text: str) -> DataFrame:
    """Tables that SQL text names: rid, action, table_name (lower case, without quotes). Keywords are no tables."""
    out = None
    for action, pattern in SQL_TABLE.items():
        t = df.select(rid, F.lit(action).alias("action"), F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("t"))
        out = t if out is None else out.unionByName(t)
    name = F.lower(F.translate("t", '"`[]', ""))
    return out.select(rid, "action", name.alias("table_name")).where(~F.col("table_name").isin(*SQL_WORDS) & (F.col("table_name") != "")).distinct()


def file_class() -> Column:
    """test, test_by_name, vendored or source from is_test, path and name."""
    path, name = F.lower("path"), F.lower("name")
    by_name = path.rlike(r"(^|/)(test|tests|spec|__tests__)/") | name.rlike(r"(_test|\.spec|\.test)\.[^.]+$|^test_")
    return F.when(F.col("is_test"), "test").when(by_name, "test_by_name").when(path.rlike(r"(^|/)(vendor|third_party|node_modules|godeps|site-packages)/"), "vendored").otherwise("source")


def codeowners(files: DataFrame) -> DataFrame:
    """Rules of CODEOWNERS files: repo_id, pattern, owner, pos; later rules win."""
    l = lines(files.where(F.lower("name") == "codeowners")).where(~F.col("line").rlike(r"^\s*(#|$)"))
    parts = F.split(F.trim(F.regexp_replace("line", r"\s+#.*$", "")), r"\s+")
    return l.select("repo_id", parts[0].alias("pattern"), "pos", F.explode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1)))).alias("owner")).where("owner <> ''")
