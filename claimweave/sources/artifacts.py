"""Stored artifacts: content-addressed writes, reads, compaction and schema steps."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.operators.graph import first_of

VERSION = (1, 3)
#: Steps from one minor version to the next, by the version they start from.
STEPS: dict[tuple[int, int], Callable[[DataFrame], DataFrame]] = {}


def register_step(version: tuple[int, int]) -> Callable:
    """Register the step that leads from a version to the next minor one; a second one for a version raises."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        if version in STEPS:
            raise ValueError(f"step from {version} exists")
        STEPS[version] = f
        return f

    return add


@register_step((1, 0))
def _with_status(df: DataFrame) -> DataFrame:
    return df if "status" in df.columns else df.withColumn("status", F.lit("active"))


@register_step((1, 1))
def _with_confidence(df: DataFrame) -> DataFrame:
    return df if "confidence" in df.columns else df.withColumn("confidence", F.lit(1.0))


@register_step((1, 2))
def _with_evidence(df: DataFrame) -> DataFrame:
    return df if "evidence" in df.columns else df.withColumn("evidence", F.array().cast("array<string>"))


def migrate(df: DataFrame, version: tuple[int, int]) -> DataFrame:
    """Edges of an older minor version with the fields of the current one; other majors and newer minors raise."""
    if version[0] != VERSION[0] or version[1] > VERSION[1]:
        raise ValueError(f"version {version} cannot be read by {VERSION}")
    while version < VERSION:
        if version not in STEPS:
            raise ValueError(f"no step from {version}")
        df = STEPS[version](df)
        version = (version[0], version[1] + 1)
    return df


def digest(df: DataFrame) -> str:
    """A digest of the rows that does not depend on their order or on file bytes."""
    h = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    row = df.agg(F.sum(h).cast("string").alias("h"), F.count("*").alias("n")).first()
    return f"{int(row['h'] or 0):x}-{row['n']}"


def write_artifact(df: DataFrame, folder: str, repo_id: str, head_sha: str) -> str:
    """Edges of one repository under a name made of their digest; equal content gives the same path and is not written again."""
    spark = df.sparkSession
    name = f"{folder.rstrip('/')}/{repo_id}-{digest(df)}"
    path = spark._jvm.org.apache.hadoop.fs.Path(name + "/_SUCCESS")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        meta = json.dumps({"repo_id": repo_id, "head_sha": head_sha, "version": list(VERSION)})
        df.withColumn("_meta", F.lit(meta)).write.mode("overwrite").parquet(name)
    return name


def read_artifact(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    df = spark.read.parquet(path)
    head = df.select("_meta").limit(1).collect()
    meta = json.loads(head[0][0]) if head else {"version": list(VERSION)}
    return migrate(df.drop("_meta"), tuple(meta["version"])), meta


def compact(artifacts: DataFrame) -> DataFrame:
    """Union of the edge lists of all deliveries: the last delivery of (source, type, target) replaces earlier ones."""
    rows = artifacts.where("edges is not null").select("artifact_id", "repo_id", "delivered_at", F.inline("edges"))
    return first_of(rows, ["source_id", "type", "target_id"], F.col("delivered_at").desc(), F.col("artifact_id").desc())


def upsert(stored: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """Stored rows with those of equal key replaced."""
    return stored.join(fresh.select(*key).distinct(), key, "left_anti").unionByName(fresh)
