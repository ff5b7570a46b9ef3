"""Synthetic estates with planted calls, from ranges: services, repositories, calls, a hot provider."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def estate(spark: SparkSession, services: int, calls: int = 3, hot_share: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """Claims (repo_id, direction, key) and the planted pairs (consumer, provider): each service calls `calls` others; the
    given share of the services also calls service 0."""
    s = spark.range(services).select(F.col("id").alias("i"))
    pick = F.pmod(F.xxhash64("i", "k"), F.lit(services))
    pairs = s.select("i", F.explode(F.sequence(F.lit(1), F.lit(calls))).alias("k")).select("i", pick.alias("j")).where("i <> j")
    hot = s.where((F.pmod(F.xxhash64("i"), F.lit(1000)) < int(hot_share * 1000)) & (F.col("i") > 0)).select("i", F.lit(0).cast("bigint").alias("j"))
    planted = pairs.unionByName(hot).distinct()
    name = lambda c: F.concat(F.lit("svc-"), F.col(c).cast("string"))
    repo = lambda c: F.concat(F.lit("repo-"), F.col(c).cast("string"))
    provides = s.select(repo("i").alias("repo_id"), F.lit("provides").alias("direction"), name("i").alias("key"))
    consumes = planted.select(repo("i").alias("repo_id"), F.lit("consumes").alias("direction"), name("j").alias("key"))
    return provides.unionByName(consumes), planted.select(repo("i").alias("consumer"), repo("j").alias("provider"))


def planted_recall(found: DataFrame, planted: DataFrame) -> DataFrame:
    """One row: pairs planted, found, missed and invented (columns consumer, provider of both)."""
    f, p = found.select("consumer", "provider").distinct().withColumn("f", F.lit(1)), planted.distinct().withColumn("p", F.lit(1))
    j = f.join(p, ["consumer", "provider"], "full")
    n = lambda c: F.count(F.when(c, 1))
    return j.agg(n(F.col("p").isNotNull()).alias("n_planted"), n(F.col("f").isNotNull()).alias("n_found"), n(F.col("f").isNull()).alias("n_missed"), n(F.col("p").isNull()).alias("n_invented"))


def estate_claims(spark: SparkSession, services: int, calls: int = 3, hot_share: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """Claims of a whole estate in the shape that a link run takes, and the planted pairs (consumer, provider) as service
    names: each service is built from its repository, exposes one operation and calls those of its planted providers."""
    pairs, planted = estate(spark, services, calls, hot_share)
    number = lambda c: F.regexp_extract(c, r"(\d+)$", 1)
    own = pairs.where("direction = 'provides'")
    none = F.lit(None).cast("string")

    def claim(df: DataFrame, kind: str, direction: str, key, hint, path, attrs) -> DataFrame:
        return df.select(F.concat_ws(":", "repo_id", F.lit(kind), F.lit(direction), key).alias("id"), "repo_id", F.lit(kind).alias("kind"), F.lit(direction).alias("direction"), key.alias("key"), hint.alias("hint"), F.lit(path).alias("path"), F.lit(1).alias("line"), attrs.alias("attrs"), none.alias("node_id"))

    no = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    route = lambda c: F.concat(F.lit("GET:/items"), number(c), F.lit("/{id}"))
    names = claim(own, "svcname", "provides", F.concat(F.lit("default:"), "key"), none, "compose.yml", F.create_map(F.lit("source"), F.lit("compose"), F.lit("build_context"), F.lit(".")))
    shown = claim(own, "http", "provides", route("key"), none, "src/routes.py", no)
    used = claim(pairs.where("direction = 'consumes'"), "http", "consumes", F.concat(F.lit("httpcall:"), route("key")), F.col("key"), "src/client.py", no)
    name = lambda c: F.concat(F.lit("svc-"), number(c)).alias(c)
    return names.unionByName(shown).unionByName(used), planted.select(name("consumer"), name("provider"))
