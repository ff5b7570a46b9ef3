"""Session, scratch storage and skew helpers that every operator shares."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A key is heavy when it holds at least this share of the rows, so there are at most 1 / HEAVY_SHARE heavy keys.
HEAVY_SHARE = 1 / 256
#: Keys with fewer rows than this are never heavy.
HEAVY_LEAST = 2_000


def session(app: str = "claimweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators expect; on a cluster the submitted settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of the application, once; needed where it is not installed on executors.

    session() and every operator with a Python stage call it, so plain sessions work as well."""
    context = spark.sparkContext
    if getattr(context, "_claimweave_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="claimweave-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "claimweave.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, os.path.join("claimweave", str(p.relative_to(root))))
    context.addPyFile(path)
    context._claimweave_shipped = True


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediates: spark.checkpoint.dir. Where it is unset, a folder of this machine on a
    local master (tests), and an error on a cluster, whose executors could not read each other's folders."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "claimweave-scratch")
    return base.rstrip("/")


def materialize(df: DataFrame, by: str | None = None, **metrics: Column) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts the lineage, survives lost executors. `by`: a column with few
    values whose rows get a folder each, so that a filter on it reads no other rows.

    The number of rows and further `metrics` (aggregates) are taken while writing; noted() and noted(out, name) give them.
    The files go when the application ends; drop_table() may remove them earlier.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/claimweave/{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in metrics.items()]).write.parquet(path, partitionBy=by)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    out._claimweave_path = path
    out._claimweave_noted = seen.get
    return out


def together(frames: list[DataFrame]) -> DataFrame:
    """Materialized frames of equal columns as one read of all their files: a plan has one scan, not a union of scans."""
    return frames[0].sparkSession.read.schema(frames[0].schema).parquet(*[f._claimweave_path for f in frames])


def noted(df: DataFrame, metric: str = "rows") -> int:
    """A number taken while `df` was written by materialize(); null sums of empty tables are 0."""
    return int(df._claimweave_noted[metric] or 0)


def table_files(df: DataFrame) -> list[str]:
    """Data files of a materialized table; their names are unique."""
    spark = df.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(df._claimweave_path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True)
    out = []
    while files.hasNext():
        path = files.next().getPath()
        if path.getName().startswith("part-"):
            out.append(path.toUri().toString())
    return sorted(out)


#: Rows of ids and small columns up to which a written side may be broadcast.
SMALL_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """A materialized side, marked for broadcast only where its counted rows stay below SMALL_ROWS; else joined by shuffle."""
    return F.broadcast(df) if noted(df) <= SMALL_ROWS else df


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where the input has fewer partitions than there are cores (a few unsplittable files); else as it is.

    For frames straight from a scan: the partitions are known from the plan, nothing runs. The Python stage that follows
    gets the package."""
    ship_package(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def drop_table(df: DataFrame | None) -> None:
    """Remove the files of a materialized frame that nothing will read again."""
    path = getattr(df, "_claimweave_path", None)
    if path:
        spark = df.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def heavy_bound(total: int, share: float = HEAVY_SHARE, least: int = HEAVY_LEAST) -> int:
    """Rows from which a key is heavy."""
    return max(least, int(total * share))


def heavy_keys(rows: DataFrame, key: str, total: int, share: float = HEAVY_SHARE, least: int = HEAVY_LEAST) -> DataFrame:
    """Keys that hold at least max(least, share * total) rows: one column `key`, at most 1/share rows."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") >= heavy_bound(total, share, least)).select(key)


def lookup_join(left: DataFrame, right: DataFrame, key: str, total: int, how: str = "left", share: float = HEAVY_SHARE, least: int = HEAVY_LEAST, heavy: DataFrame | None = None) -> DataFrame:
    """Join `left` to `right`, which has one row per key, without sending a heavy key to one task.

    Heavy keys of `left` are found by a pre-aggregated count. There are at most 1/share of them, so their rows of
    `right` are broadcast; the rest is joined by shuffle. Both parts are united. Null keys match nothing. `heavy`: the
    heavy keys (column `key`) where they are known already.
    """
    heavy = heavy_keys(left, key, total, share, least) if heavy is None else heavy
    few = right.join(F.broadcast(heavy), key, "left_semi")
    flagged = left.join(F.broadcast(heavy.withColumn("_heavy", F.lit(True))), key, "left")
    hot = flagged.where("_heavy").drop("_heavy").join(F.broadcast(few), key, how)
    rest = flagged.where("_heavy is null").drop("_heavy").join(right, key, how)
    return hot.unionByName(rest)


def month_of(ts) -> F.Column:
    """`YYYY-MM` of a timestamp without zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.concat(F.lpad(F.year(c).cast("string"), 4, "0"), F.lit("-"), F.lpad(F.month(c).cast("string"), 2, "0"))


def blank_to_null(c) -> F.Column:
    """Trim blanks (space, tab, line ends, no-break space); nothing left counts as null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.trim(c, F.lit(" \t\r\n\u00a0")), F.lit(""))
