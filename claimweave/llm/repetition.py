"""Repetition: inside one document, and of lines across documents.

`repetition` measures the share of words that lie in a run of ten words which began earlier in the same text. Each text
is judged on its own: words get exact numbers, runs are hashed with a rolling sum over a batch, equal hashes are sorted
together, and every hit is compared word by word with the first occurrence; where two different runs share a hash, the
text is counted again by the runs themselves.

`line_frequency` is the cross-document method: normalised lines are hashed, distinct documents are counted per host and
line, lines above the limits are removed and documents that lose too much are rejected. It cannot tell repetition inside
one document, which is why p10_found does not use it.

Defined cases
* null, empty and blank texts have no words, a share of 0 and are no case; texts of fewer than eleven words likewise;
* words are runs of letters of any script, case ignored; texts are read whole;
* a null host is a host of its own; blank lines are no lines; repeated document rows count once per id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.runtime import lookup_join, spread

RUN = 10
LIMIT = 0.30
_ASCII = re.compile(r"[a-z]+")
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(RUN)], dtype=np.uint64)


def _words(text: str) -> list[str]:
    low = text.lower()
    if low.isascii():
        return _ASCII.findall(low)
    import regex

    return regex.findall(r"\p{L}+", low)


def repeated_words(lists: list[list[str]]) -> np.ndarray:
    """Per word list the number of repeated words."""
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    total = int(sizes.sum())
    out = np.zeros(len(lists), dtype=np.int64)
    if total < RUN:
        return out
    numbers: dict[str, int] = {}
    h = np.fromiter((numbers.setdefault(w, len(numbers)) for x in lists for w in x), dtype=np.uint64, count=total)
    doc = np.repeat(np.arange(len(lists)), sizes)
    n = total - RUN + 1
    with np.errstate(over="ignore"):
        run = doc[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        mixed = (h + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(31)
        for k in range(RUN):
            run += mixed[k : k + n] * _FACTORS[k]
        run ^= run >> np.uint64(29)
    inside = np.flatnonzero(doc[:n] == doc[RUN - 1 :])
    order = inside[np.argsort(run[inside], kind="stable")]
    key = run[order]
    same = np.flatnonzero(key[1:] == key[:-1]) + 1
    if not len(same):
        return out
    starts = np.zeros(len(key), dtype=np.int64)
    fresh = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    starts[fresh] = fresh
    first = order[np.maximum.accumulate(starts)[same]]
    later = order[same]
    again: dict[int, int] = {}
    equal = doc[first] == doc[later]
    for k in range(RUN):
        equal &= h[first + k] == h[later + k]
    for x in np.unique(doc[later[~equal]]):
        again[int(x)] = _by_runs(lists[x])
    mark = np.zeros(total + 1, dtype=np.int64)
    np.add.at(mark, later[equal], 1)
    np.add.at(mark, later[equal] + RUN, -1)
    covered = np.cumsum(mark[:total]) > 0
    np.add.at(out, doc[covered], 1)
    for x, hit in again.items():
        out[x] = hit
    return out


def _by_runs(words: list[str]) -> int:
    """Repeated words of one text, by a set of its runs."""
    seen: set[tuple[str, ...]] = set()
    hit = bytearray(len(words))
    for i in range(len(words) - RUN + 1):
        run = tuple(words[i : i + RUN])
        if run in seen:
            hit[i : i + RUN] = b"\1" * RUN
        seen.add(run)
    return sum(hit)


def repetition(docs: DataFrame, rid: str = "doc_id", text: str = "text") -> DataFrame:
    """rid, n_words, n_repeated, share of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1_000):
                part = batch.iloc[at : at + 1_000]
                lists = [_words(t) if t else [] for t in part["text"]]
                n = np.array([len(x) for x in lists], dtype=np.int64)
                hit = repeated_words(lists)
                yield pd.DataFrame({rid: part["rid"].to_numpy(), "n_words": n, "n_repeated": hit, "share": hit / np.maximum(n, 1)})

    slim = docs.select(F.col(rid).cast("bigint").alias("rid"), F.col(text).alias("text"))
    return spread(slim).mapInPandas(run, f"{rid} bigint, n_words bigint, n_repeated bigint, share double")


def repetitive(docs: DataFrame, rid: str = "doc_id", text: str = "text", limit: float = LIMIT) -> DataFrame:
    """Ids of documents whose repeated share reaches the limit."""
    return repetition(docs, rid, text).where((F.col("n_words") > 0) & (F.col("share") >= limit)).select(rid).distinct()


def line_frequency(docs: DataFrame, rid: str = "doc_id", text: str = "text", host: str = "repo_id", most_docs: int = 20, most_share: float = 0.5, least_kept: float = 0.5) -> DataFrame:
    """Lines that too many documents of one host share: rid, n_lines, n_common, rejected.

    A line is common when more than `most_docs` documents of the host have it and these are more than `most_share` of
    them, or more than ten times `most_docs`. A document is rejected when less than `least_kept` of its lines remain.
    """
    norm = F.lower(F.regexp_replace(F.trim(F.col("line")), r"[\s\d]+", " "))
    lines = docs.select(F.col(rid).alias("rid"), F.coalesce(host, F.lit("")).alias("host"), F.explode(F.split(text, r"\r?\n")).alias("line"))
    hashed = lines.select("rid", "host", F.xxhash64(norm).alias("h")).where(F.length(F.trim("line")) > 0)
    per_doc = hashed.groupBy("rid", "host", "h").agg(F.count("*").alias("n"))
    hosts = docs.groupBy(F.coalesce(host, F.lit("")).alias("host")).agg(F.count_distinct(rid).alias("n_docs"))
    counted = per_doc.groupBy("host", "h").agg(F.count("*").alias("docs")).where(F.col("docs") > most_docs).join(hosts, "host")
    common = counted.where((F.col("docs") > most_share * F.col("n_docs")) | (F.col("docs") > 10 * most_docs))
    key = F.concat_ws(":", F.col("h").cast("string"), "host")
    marked = lookup_join(per_doc.withColumn("k", key), common.select(key.alias("k"), F.lit(1).alias("hit")), "k", docs.count())
    out = marked.groupBy("rid").agg(F.sum("n").alias("n_lines"), F.sum(F.when(F.col("hit") == 1, F.col("n")).otherwise(0)).alias("n_common"))
    return out.select(F.col("rid").alias(rid), "n_lines", "n_common", ((F.col("n_lines") - F.col("n_common")) < least_kept * F.col("n_lines")).alias("rejected"))
