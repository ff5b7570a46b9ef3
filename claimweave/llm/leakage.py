"""Evaluation passages inside training text, by Wu-Manber multi-pattern search over words.

Patterns are all six-word runs that exactly one item has. A block of two words ends every window: the shift table says
how far the window may move when the block cannot end a pattern (five words for a block that no pattern has), a shift of
zero leads to the bucket of patterns that end in the block, and the six words are compared directly. Found runs are laid
over the item's passage; a document is a case when they cover a third of the item's own words.

The items are a stated query set. Which runs are shared between items is found by Spark; the items with the places of
their shared runs are written in blocks of bounded text, whose files the executors fetch. Each task builds the tables of
one block after the other for a batch of documents, so there is one pass over the documents, what a worker holds is
bounded however many items there are, and neither items nor runs come to the driver.

Defined cases
* null, empty and short texts hold nothing; an item of fewer than six words or without own words is never a case;
* a run that occurs at several places of one passage covers all of them; exact copies of a text are cases each;
* repeated item rows count once; documents are read whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.runtime import lookup_join, materialize, noted, ship_package, spread, table_files

RUN = 6
SHARE = 1 / 3
#: Characters of passages in one block of the query set, and blocks whose tables a worker keeps between batches.
BLOCK_CHARS = 2_000_000
KEPT_BLOCKS = 2
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


@dataclass
class Patterns:
    """Search tables of one block of items."""

    shift: dict[str, dict[str, int]] = field(default_factory=dict)
    bucket: dict[tuple[str, str], dict[tuple[str, ...], list[tuple[int, int]]]] = field(default_factory=dict)
    own: dict[int, frozenset[int]] = field(default_factory=dict)

    @classmethod
    def build(cls, items: Iterator[tuple[int, str, list[int]]]) -> Patterns:
        """Tables of items, each with its passage and the places of the runs that other items have too."""
        p = cls()
        for item, passage, shared in items:
            words = words_of(passage)
            p.own[item] = frozenset(range(len(words))) - {k for i in shared for k in range(i, i + RUN)}
            skip = set(shared)
            for i in range(len(words) - RUN + 1):
                if i in skip:
                    continue
                run = tuple(words[i : i + RUN])
                p.bucket.setdefault(run[-2:], {}).setdefault(run, []).append((item, i))
                for j in range(1, RUN):
                    ends = p.shift.setdefault(run[j - 1], {})
                    ends[run[j]] = min(ends.get(run[j], RUN), RUN - 1 - j)
        return p

    def search(self, words: list[str]) -> dict[int, set[int]]:
        """Covered positions of each item's passage."""
        covered: dict[int, set[int]] = {}
        shift, bucket, n = self.shift, self.bucket, len(words)
        none: dict[str, int] = {}
        end = RUN - 1
        while end < n:
            step = shift.get(words[end - 1], none).get(words[end], RUN - 1)
            if step:
                end += step
                continue
            hits = bucket.get((words[end - 1], words[end]))
            if hits and (at := hits.get(tuple(words[end - RUN + 1 : end + 1]))):
                for item, i in at:
                    covered.setdefault(item, set()).update(range(i, i + RUN))
            end += 1
        return covered

    def cases(self, words: list[str]) -> list[int]:
        return [item for item, at in self.search(words).items() if (own := self.own[item]) and len(at & own) >= SHARE * len(own)]


def item_runs(items: DataFrame, item: str, passage: str) -> DataFrame:
    """All six-word runs of the items: item, at (place in the passage), run (words joined by blanks)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, " ".join(w[i : i + RUN])) for k, t in zip(batch[item], batch[passage]) for w in [words_of(t)] for i in range(len(w) - RUN + 1)]
            yield pd.DataFrame(rows, columns=["item", "at", "run"])

    ship_package(items.sparkSession)
    return items.mapInPandas(run, "item bigint, at int, run string")


def item_blocks(items: DataFrame, item: str = "item_id", passage: str = "passage") -> DataFrame:
    """The items with the places of their shared runs, written as one file for each block of about BLOCK_CHARS."""
    once = items.where(F.col(item).isNotNull() & F.col(passage).isNotNull()).select(F.col(item).cast("bigint").alias(item), passage).distinct()
    once = materialize(once, chars=F.sum(F.length(passage)))
    runs = materialize(item_runs(once, item, passage))
    shared = runs.groupBy("run").agg(F.min("item").alias("a"), F.max("item").alias("b")).where("a < b").select("run", F.lit(True).alias("shared"))
    places = lookup_join(runs, shared, "run", noted(runs), "inner").groupBy(F.col("item").alias(item)).agg(F.collect_list("at").alias("shared"))
    n = max(1, math.ceil(noted(once, "chars") / BLOCK_CHARS))
    out = once.join(places, item, "left").select(item, passage, F.coalesce("shared", F.array().cast("array<int>")).alias("shared"))
    return materialize(out.repartition(n, item))


_KEPT: dict[str, Patterns] = {}


def _tables(name: str, item: str, passage: str) -> Patterns:
    """Search tables of the block in this fetched file; the last KEPT_BLOCKS stay."""
    import pyarrow.parquet as pq

    if name not in _KEPT:
        while len(_KEPT) >= KEPT_BLOCKS:
            del _KEPT[next(iter(_KEPT))]
        rows = pq.ParquetFile(SparkFiles.get(name)).read(columns=[item, passage, "shared"]).to_pydict()
        _KEPT[name] = Patterns.build(zip(rows[item], rows[passage], rows["shared"]))
    return _KEPT[name]


def leaks(docs: DataFrame, items: DataFrame, rid: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "passage") -> DataFrame:
    """Every pair of a document and an item that leaked into it: rid, item."""
    context = docs.sparkSession.sparkContext
    files = table_files(item_blocks(items, item, passage))
    for path in files:
        context.addFile(path)
    blocks = [x.rsplit("/", 1)[-1] for x in files]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [words_of(t) for t in batch["text"]]
            for name in blocks:
                found = _tables(name, item, passage)
                hits = [(d, i) for d, w in zip(batch["rid"], words) for i in found.cases(w)]
                yield pd.DataFrame(hits, columns=[rid, item]).astype("int64")

    slim = docs.select(F.col(rid).cast("bigint").alias("rid"), F.col(text).alias("text")).where("length(text) > 10")
    return spread(slim).mapInPandas(run, f"{rid} bigint, {item} bigint").distinct()
