"""Whole-corpus encoding with a byte-level BPE vocabulary, by a trie of distinct words.

Distinct words are kept in one trie per Python worker. Walking it depth first (sorted words share the states of their
common prefix), every byte position gets the last token of the encoding of the prefix that ends there: the only
vocabulary suffix whose pair with the state before it would not have been merged differently. Prefixes shared by several
words are computed once; an encoding is read back from the states. The texts never leave their partition.

Defined cases
* a null or empty text gives an empty list; one output row for each input row, in any order;
* texts are encoded whole, without special tokens; their written forms are ordinary text;
* lone surrogates cannot occur in Spark strings; other columns are dropped.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from claimweave.runtime import spread

TOKENIZER_DIR = os.environ.get("CLAIMWEAVE_TOKENIZERS", "/opt/tokenizers")
#: Pre-tokenizer of the vocabulary, as published with it (fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks between single blanks are encoded alike wherever they stand.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Entries of the per-worker cache; beyond them it starts anew, so its memory is bounded.
CACHE_SIZE = 400_000
#: Longer chunks are encoded without being kept.
CACHE_CHARS = 48


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieEncoder:
    """Encoder of one vocabulary; `path` is the tokenizer's JSON file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        to_byte = byte_chars()
        raw = lambda s: bytes(to_byte[c] for c in s)
        self.ids = {raw(s): i for s, i in model["vocab"].items() if all(c in to_byte for c in s)}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        # Tokens are compared by the rank of the merge that makes them; single bytes come before all merges.
        self.rank = {b: -1 for b in self.ids if len(b) == 1}
        self.parts: dict[bytes, tuple[bytes, bytes]] = {}
        self.joined: dict[tuple[bytes, bytes], int] = {}
        for k, (a, b) in enumerate(merges):
            left, right = raw(a), raw(b)
            self.joined[left, right] = k
            if left + right not in self.parts:
                self.parts[left + right] = (left, right)
                self.rank[left + right] = k
        self.longest = max(map(len, self.rank))
        self.stands: dict[tuple[bytes, bytes], bool] = {}
        self.words = regex.compile(WORDS)
        self.cache: dict[str, tuple[int, ...]] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def _holds(self, left: bytes, right: bytes) -> bool:
        """Whether `left`, `right` stay two tokens side by side: no merge across the border comes before the merges
        that build the tokens themselves."""
        pair = (left, right)
        if (known := self.stands.get(pair)) is not None:
            return known
        limit, a, b = 1 << 60, left, right
        rank, parts, joined = self.rank, self.parts, self.joined
        while True:
            k = joined.get((a, b))
            if k is not None and k < limit:
                ok = False
                break
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                ok = True
                break
            # Undo the later of the two merges. At a tie the one further left was made first: a merge across the
            # border would come after one of its own rank in `left`, but before one in `right`.
            if ra > rb:
                limit, a = ra, parts[a][1]
            else:
                limit, b = rb + 1, parts[b][0]
        self.stands[pair] = ok
        return ok

    def encode_words(self, words: Iterable[str]) -> None:
        """Encode distinct words into self.known, in the order of a depth-first walk over their trie."""
        last: list[bytes] = [b""]
        before = b""
        ids, rank, holds, longest = self.ids, self.rank, self._holds, self.longest
        for data, word in sorted((w.encode(), w) for w in words):
            n = len(data)
            shared = 0
            for x, y in zip(before, data):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, n + 1):
                for start in range(max(0, end - longest), end):
                    token = data[start:end]
                    if token in rank and (start == 0 or holds(last[start], token)):
                        last.append(token)
                        break
            before, out, end = data, [], n
            while end:
                out.append(ids[last[end]])
                end -= len(last[end])
            self.known[word] = tuple(reversed(out))

    def _learn(self, chunks: set[str]) -> dict[str, tuple[int, ...]]:
        cut = {c: self.words.findall(c) for c in chunks}
        fresh = {w for ws in cut.values() for w in ws} - self.known.keys()
        self.encode_words(fresh)
        return {c: tuple(chain.from_iterable(self.known[w] for w in ws)) for c, ws in cut.items()}

    def encode_batch(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of a batch."""
        if len(self.cache) > CACHE_SIZE or len(self.known) > CACHE_SIZE or len(self.stands) > 4 * CACHE_SIZE:
            self.cache, self.known, self.stands = {}, {}, {}
        cut = CUT.split
        pieces = []
        for t in texts:
            if not t:
                pieces.append([])
                continue
            p = cut(t)
            p[1:] = [" " + x for x in p[1:]]
            pieces.append(p)
        distinct = set(chain.from_iterable(pieces))
        new = distinct - self.cache.keys()
        found = self._learn(new)
        self.cache.update({c: v for c, v in found.items() if len(c) <= CACHE_CHARS})
        table = self.cache if all(len(c) <= CACHE_CHARS for c in found) else self.cache | found
        get = table.__getitem__
        values: list[np.ndarray] = []
        sizes = np.zeros(len(pieces) + 1, dtype=np.int64)
        for i, p in enumerate(pieces):
            row = np.fromiter(chain.from_iterable(map(get, p)), dtype=np.int32)
            values.append(row)
            sizes[i + 1] = len(row)
        return np.cumsum(sizes), np.concatenate(values) if values else np.zeros(0, np.int32)


_ENCODERS: dict[str, TrieEncoder] = {}


def encoder(path: str) -> TrieEncoder:
    """The worker's encoder of a vocabulary file, built once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TrieEncoder(path)
    return _ENCODERS[path]


def encode_corpus(docs: DataFrame, rid: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.json", folder: str | None = None) -> DataFrame:
    """rid, ids: the token ids of every text."""
    path = os.path.join(folder or TOKENIZER_DIR, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = batch.column(1)
            step = 2_000
            for at in range(0, batch.num_rows, step):
                offsets, ids = enc.encode_batch(texts.slice(at, step).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, step), lists], names=[rid, "ids"])

    slim = docs.select(docs[rid].cast("bigint").alias(rid), docs[text].alias("text"))
    return spread(slim).mapInArrow(run, f"{rid} bigint, ids array<int>")
