"""Source repositories: directory scan and structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Directories that a scan skips (fixed values).
IGNORED = (".git", "node_modules", "target", "build", "dist", ".next", ".venv", "venv", "__pycache__", ".idea", ".vscode", "coverage", ".pytest_cache", ".gradle", ".mvn", "out", "bin", "obj", "vendor", "*.egg-info", ".tox", ".eggs", "htmlcov", ".coverage")
#: Bytes of the largest file that a scan reads, unless the caller says otherwise.
LARGEST = 1_000_000


def scan_directory(spark: SparkSession, root: str, repo_id: str, largest: int = LARGEST) -> DataFrame:
    """Text files below a directory: repo_id, path, name, extension, size_bytes, content. Binary files (with a NUL byte in
    them) and files above `largest` bytes have null content; skipped() counts them. A missing root raises."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^file:", "")
    path = F.ltrim(F.replace(F.regexp_replace("path", "^file:(//)?", ""), base, F.lit("")), F.lit("/"))
    text = F.decode("content", "utf-8")
    rows = raw.select(F.lit(repo_id).alias("repo_id"), path.alias("path"), F.col("length").alias("size_bytes"), F.when((F.col("length") <= largest) & (F.instr(text, "\u0000") == 0), text).alias("content"))
    named = rows.withColumn("name", F.substring_index("path", "/", -1))
    return named.withColumn("extension", F.lower(F.regexp_extract("name", r"(\.[^.]+)$", 1))).where(~F.col("path").rlike(_ignored()))


def _ignored() -> str:
    return "(^|/)(" + "|".join(x.replace(".", r"\.").replace("*", "[^/]*") for x in IGNORED) + ")/"


def scannable(files: DataFrame, largest: int = LARGEST) -> DataFrame:
    """Files that a scan keeps: with content, not too large, outside ignored directories."""
    return files.where(F.col("content").isNotNull() & (F.length("content") <= largest) & ~F.col("path").rlike(_ignored()))


def skipped(files: DataFrame, largest: int = LARGEST) -> DataFrame:
    """What a scan leaves out, by reason: repo_id, reason (ignored, too_large, unreadable), n_files, n_bytes."""
    size = F.coalesce(F.length("content").cast("bigint"), F.col("size_bytes").cast("bigint"), F.lit(0).cast("bigint"))
    reason = F.when(F.coalesce(F.col("path").rlike(_ignored()), F.lit(False)), "ignored").when(size > largest, "too_large").when(F.col("content").isNull(), "unreadable")
    rows = files.select("repo_id", reason.alias("reason"), size.alias("size")).where("reason is not null")
    return rows.groupBy("repo_id", "reason").agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"))


def structure(files: DataFrame) -> DataFrame:
    """Containment of folders and files: repo_id, parent ('' at the top), child, type. Null paths drop out."""
    parts = F.split("path", "/")
    step = lambda k: F.struct(
        F.when(k == 1, "").otherwise(F.array_join(F.slice(parts, 1, F.greatest(k - 1, F.lit(1))), "/")).alias("parent"), F.array_join(F.slice(parts, 1, k), "/").alias("child"), F.when(k == F.size(parts), "File").otherwise("Folder").alias("type")
    )
    return files.where("path is not null").select("repo_id", "path").distinct().select("repo_id", F.inline(F.transform(F.sequence(F.lit(1), F.size(parts)), step))).distinct()


def tree_digest(files: DataFrame) -> DataFrame:
    """Per repository a digest of its paths and contents that does not depend on row order: repo_id, digest, n_files."""
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", "path", F.sha2(F.coalesce("content", F.lit("")), 256)), 256), 1, 12), 16, 10).cast("decimal(20,0)")
    return files.select("repo_id", "path", "content").distinct().groupBy("repo_id").agg(F.sum(h).cast("string").alias("digest"), F.count("*").alias("n_files"))
