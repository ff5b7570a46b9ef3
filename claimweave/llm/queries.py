"""Queries of the text problems (p5 to p10) over the table folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimweave.llm import credentials, encoding, handwritten, leakage, repetition, syntax
from claimweave.sources.tables import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials.credentials(
        table(spark, d, "k8s_resources", "resource_id", "containers"), table(spark, d, "docker_resources", "docker_id", "env_pairs"), table(spark, d, "files", "file_id", "content"), table(spark, d, "documents", "doc_id", "text")
    )


def p5_redacted_files(spark: SparkSession, d: str) -> DataFrame:
    return credentials.redacted_texts(table(spark, d, "files", "file_id", "content"), "file_id", "content")


def p5_redacted_docs(spark: SparkSession, d: str) -> DataFrame:
    return credentials.redacted_texts(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def p5_redacted_values(spark: SparkSession, d: str) -> DataFrame:
    k8s = credentials.k8s_values(table(spark, d, "k8s_resources", "resource_id", "containers"))
    return credentials.redacted_values(k8s.unionByName(credentials.docker_values(table(spark, d, "docker_resources", "docker_id", "env_pairs"))))


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files", "file_id", "repo_id", "path", "name", "language", "content")


def _marked_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files", "file_id", "repo_id", "path", "name", "content", "is_test", "size_bytes")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid_files(_files(spark, d))


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.rates(_files(spark, d), table(spark, d, "scan_meta", "scan_id", "repo_id", "parse_failures", "scanned_at", "delivered_at"))


def p6_causes(spark: SparkSession, d: str) -> DataFrame:
    return syntax.causes(_files(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_handwritten(_marked_files(spark, d))


def p7_labels(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.beliefs(_marked_files(spark, d)).distinct()


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode_corpus(table(spark, d, "documents", "doc_id", "text"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "passage"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetitive(table(spark, d, "documents", "doc_id", "text"))


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetition(table(spark, d, "documents", "doc_id", "text"))


def p10_line_frequency(spark: SparkSession, d: str) -> DataFrame:
    return repetition.line_frequency(table(spark, d, "documents", "doc_id", "text", "repo_id"))


QUERIES = {
    f.__name__: f
    for f in (p5_found, p5_redacted_files, p5_redacted_docs, p5_redacted_values, p6_found, p6_rates, p6_causes, p7_found, p7_labels, p8_ids, p9_found, p10_found, p10_shares, p10_line_frequency)
}
_TENS = """d AS (SELECT doc_id, regexp_extract_all(lower(text), '\\p{L}+') AS w FROM documents WHERE text IS NOT NULL AND text <> ''),
 g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 9), ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 8, 1))) AS i FROM d)),
 r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(i) OVER (PARTITION BY doc_id, run) AS first FROM g) WHERE i > first),
 c AS (SELECT doc_id, count(DISTINCT i + k) AS hit FROM r, (SELECT unnest(range(0, 10)) AS k) GROUP BY doc_id),
 n AS (SELECT doc_id, coalesce(len(w), 0) AS n FROM d)"""

SQL: dict[str, str] = {
    "p9_found": """WITH i AS (SELECT item_id, regexp_extract_all(lower(passage), '[\\p{L}\\p{N}]+') AS w FROM (SELECT DISTINCT item_id, passage FROM eval_items) WHERE passage IS NOT NULL),
 ir AS (SELECT item_id, k, array_to_string(list_slice(w, k, k + 5), ' ') AS run FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1))) AS k FROM i)),
 s AS (SELECT run FROM ir GROUP BY run HAVING count(DISTINCT item_id) > 1), off AS (SELECT unnest(range(0, 6)) AS o),
 lost AS (SELECT DISTINCT item_id, k + o AS p FROM ir JOIN s USING (run), off), pos AS (SELECT item_id, unnest(range(1, len(w) + 1)) AS p FROM i),
 own AS (SELECT item_id, p FROM pos EXCEPT SELECT item_id, p FROM lost), n AS (SELECT item_id, count(*) AS n FROM own GROUP BY item_id),
 d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
 dr AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 5), ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1))) AS k FROM d)),
 hit AS (SELECT DISTINCT doc_id, item_id, k + o AS p FROM dr JOIN (SELECT * FROM ir WHERE run NOT IN (SELECT run FROM s)) USING (run), off)
 SELECT doc_id, item_id FROM (SELECT doc_id, hit.item_id, count(*) AS c FROM hit JOIN own ON own.item_id = hit.item_id AND own.p = hit.p GROUP BY ALL) JOIN n USING (item_id) WHERE c * 3 >= n""",
    "p10_found": f"WITH {_TENS} SELECT n.doc_id FROM n JOIN c USING (doc_id) WHERE hit >= 0.30 * n",
    "p10_shares": f"WITH {_TENS} SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(hit, 0) AS n_repeated, CASE WHEN coalesce(n, 0) = 0 THEN 0.0 ELSE CAST(coalesce(hit, 0) AS DOUBLE) / n END AS share FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)",
    "p10_line_frequency": """WITH l AS (SELECT doc_id, coalesce(repo_id, '') AS host, unnest(regexp_split_to_array(text, '\\r?\\n')) AS line FROM documents WHERE text IS NOT NULL),
 p AS (SELECT doc_id, host, lower(regexp_replace(trim(line), '[\\s\\d]+', ' ', 'g')) AS h, count(*) AS n FROM l WHERE length(trim(line)) > 0 GROUP BY ALL), hosts AS (SELECT coalesce(repo_id, '') AS host, count(DISTINCT doc_id) AS n_docs FROM documents GROUP BY 1),
 k AS (SELECT host, h FROM (SELECT host, h, count(*) AS docs FROM p GROUP BY ALL) JOIN hosts USING (host) WHERE docs > 20 AND (docs > 0.5 * n_docs OR docs > 200))
 SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN k.h IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS n_common, sum(CASE WHEN k.h IS NULL THEN n ELSE 0 END) < 0.5 * sum(n) AS rejected FROM p LEFT JOIN k ON p.host = k.host AND p.h = k.h GROUP BY doc_id""",
}
