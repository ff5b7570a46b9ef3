"""Pairs that meet at hubs: each pair is listed once, whatever number of hubs it meets at.

A join over the hubs lists a pair per hub and takes the repetitions out afterwards. Here the targets are cut into blocks; a
task has the targets of one block by hub and reads the sources in order, so the best values of a source are two arrays as
long as the block, and what leaves the task are distinct pairs. Nothing is shuffled but the two inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.runtime import materialize, noted, ship_package

#: Rows of targets in a block at most (on average), and those from which a block of its own pays.
BLOCK_MOST, BLOCK_LEAST = 500_000, 10_000
#: Rows of a batch that leaves a task.
BATCH = 65_536
SCHEMA = "source string, target string, confidence double, evidence string"


class Block:
    """Targets of a block by hub, as arrays: those of hub h are the rows start[h] to start[h + 1]."""

    def __init__(self, batches: list[pa.RecordBatch]):
        t = pa.Table.from_batches(batches).combine_chunks()
        coded = lambda c: t[c].combine_chunks().dictionary_encode()
        hub, target, evidence = coded("key"), coded("other"), coded("evidence")
        self.hubs, self.targets = hub.dictionary, target.dictionary
        self.start = np.append(0, np.cumsum(np.bincount(hub.indices.to_numpy(), minlength=len(self.hubs))))
        self.target = target.indices.to_numpy()
        # Evidence by its rank, so that the smallest text is the smallest number; null is above all.
        order = pc.sort_indices(evidence.dictionary).to_numpy()
        self.evidence, self.none = evidence.dictionary.take(pa.array(order)), len(order)
        rank = np.empty(len(order) + 1, dtype=np.int64)
        rank[order], rank[-1] = np.arange(len(order)), self.none
        self.rank = rank[evidence.indices.fill_null(self.none).to_numpy()]
        self.confidence = t["confidence"].combine_chunks().cast(pa.float64()).fill_null(-np.inf).to_numpy()
        n = len(self.targets)
        self.best, self.least, self.seen = np.empty(n), np.empty(n, dtype=np.int64), np.empty(n, dtype=bool)

    def of(self, hubs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Targets at any of the hubs, with their largest confidence and smallest evidence."""
        self.best.fill(-np.inf)
        self.least.fill(self.none)
        self.seen.fill(False)
        for h in hubs:
            at = slice(self.start[h], self.start[h + 1])
            t = self.target[at]  # a hub has a target once
            self.best[t] = np.maximum(self.best[t], self.confidence[at])
            self.least[t] = np.minimum(self.least[t], self.rank[at])
            self.seen[t] = True
        hit = np.flatnonzero(self.seen)
        return hit, self.best[hit], self.least[hit]

    def rows(self, sources: list[str], found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        target, best, least = (np.concatenate(x) for x in zip(*found))
        source = pa.array(sources, pa.string()).take(pa.array(np.repeat(np.arange(len(sources)), [len(x[0]) for x in found])))
        evidence = self.evidence.take(pa.array(least, mask=least == self.none))
        return pa.RecordBatch.from_arrays([source, self.targets.take(pa.array(target)), pa.array(best, mask=np.isneginf(best)), evidence], names=["source", "target", "confidence", "evidence"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one block: first targets (key: hub, other: target) by hub, then sources (key: source, other: hub) by source."""
    held: list[pa.RecordBatch] = []
    block, name, hubs = None, None, []
    sources: list[str] = []
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n = 0
    for b in batches:
        cut = int(np.searchsorted(b.column("side").to_numpy(), 1))
        if cut:
            held.append(b.slice(0, cut))
        if cut == len(b):
            continue
        if block is None:
            if not held:
                return
            block, held = Block(held), []
        b = b.slice(cut)
        at = pc.index_in(b.column("other"), block.hubs).to_numpy(zero_copy_only=False)
        runs = b.column("key").dictionary_encode()
        code = runs.indices.to_numpy()
        edges = np.append(np.append(0, np.flatnonzero(np.diff(code)) + 1), len(code))
        for lo, hi in zip(edges[:-1], edges[1:]):
            key = runs.dictionary[int(code[lo])].as_py()
            if hubs and key != name:
                sources.append(name)
                found.append(block.of(np.concatenate(hubs)))
                n, hubs = n + len(found[-1][0]), []
                if n >= BATCH:
                    yield block.rows(sources, found)
                    sources, found, n = [], [], 0
            name = key
            hubs.append(at[lo:hi])
    if hubs:
        sources.append(name)
        found.append(block.of(np.concatenate(hubs)))
        yield block.rows(sources, found)


def pairs(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Distinct pairs of a source and a target that share a hub: source, target, confidence (the largest), evidence (the smallest).

    sources: hub, source; targets: hub, target, confidence, evidence. Rows may repeat; null hubs and ends match nothing. The
    reduced targets are written, the pairs are made when they are read."""
    spark = targets.sparkSession
    ship_package(spark)
    t = targets.where("hub is not null and target is not null").groupBy("hub", "target").agg(F.max("confidence").cast("double").alias("confidence"), F.min("evidence").alias("evidence"))
    t = materialize(t)
    rows = noted(t)
    n = max(1, -(-rows // BLOCK_MOST), min(2 * spark.sparkContext.defaultParallelism, rows // BLOCK_LEAST))
    t = t.withColumn("block", F.pmod(F.hash("target"), F.lit(n)))
    s = sources.where("hub is not null and source is not null").select("hub", "source").distinct().join(t.select("hub", "block").distinct(), "hub")
    none = F.lit(None)
    both = t.select("block", F.lit(0).alias("side"), F.col("hub").alias("key"), F.col("target").alias("other"), "confidence", "evidence").unionByName(
        s.select("block", F.lit(1).alias("side"), F.col("source").alias("key"), F.col("hub").alias("other"), none.cast("double").alias("confidence"), none.cast("string").alias("evidence"))
    )
    return both.repartitionById(n, F.col("block")).sortWithinPartitions("side", "key").drop("block").mapInArrow(_blocks, SCHEMA)
