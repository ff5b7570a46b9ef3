"""Link runs that are repeated only where claims changed: a folder with a ledger, fingerprints, claims and edges per run.

A run writes its own folder and then one ledger row; a run that dies before the row leaves no trace that counts. Equal
fingerprints of all repositories reuse the last run's edges."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.operators import temporal

ROW = "run_id string, seq long, n_repos long, n_stale long, reused boolean, edges_path string, prints_path string"


class Ledger:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def rows(self) -> DataFrame:
        path = f"{self.folder}/ledger"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], ROW)
        return self.spark.read.schema(ROW).parquet(path)

    def last(self):
        """The newest run's row, or None."""
        return next(iter(self.rows().orderBy(F.col("seq").desc()).limit(1).collect()), None)

    def link(self, claims: DataFrame, run: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, bool]:
        """Edges of the claims (id, repo_id) and whether they are those of the run before; `run` links all claims."""
        now = temporal.fingerprints(claims)
        before = self.last()
        stale = None
        if before is not None:
            stale = temporal.stale_groups(now, self.spark.read.parquet(before["prints_path"])).count()
            if stale == 0:
                self._note(before["seq"] + 1, before["n_repos"], 0, True, before["edges_path"], before["prints_path"])
                return self.spark.read.parquet(before["edges_path"]), True
        at = f"{self.folder}/runs/{uuid.uuid4().hex}"
        run(claims).write.parquet(f"{at}/edges")
        now.write.parquet(f"{at}/prints")
        prints = self.spark.read.parquet(f"{at}/prints")
        n = prints.count()
        self._note(0 if before is None else before["seq"] + 1, n, n if stale is None else stale, False, f"{at}/edges", f"{at}/prints")
        return self.spark.read.parquet(f"{at}/edges"), False

    def _note(self, seq: int, n: int, stale: int, reused: bool, edges: str, prints: str) -> None:
        self.spark.createDataFrame([(uuid.uuid4().hex, seq, n, stale, reused, edges, prints)], ROW).coalesce(1).write.mode("append").parquet(f"{self.folder}/ledger")
