"""Credentials in configuration and text: found, placed and redacted.

Literals near an assignment are segmented into dictionary words by Viterbi; a long unexplained residual is a secret unless
the literal has a known hash format or stands under a name that announces a hash. Names that announce a credential make
any written-out value one, unless it is a placeholder, a reference or a path. Connection strings with a password and
private key blocks are found by their form. The dictionary is the whole-word part of a public tokenizer's vocabulary: of
fixed size, ranked by frequency, read by each worker from its own disk. One pass over the data, no shuffle.

Defined cases
* null and empty texts, values and names hold nothing and come back unchanged;
* a literal split into concatenated parts is judged as a whole and redacted in every part;
* a key block is one credential at the line of its first line; a block that is cut off reaches to the end of its literal;
* redaction replaces only the secret characters, so quotes, names, line ends and the text around them stay;
* the same spot is reported once, however many credentials or repeated rows it has; texts are read whole.
"""

from __future__ import annotations

import json
import math
import os
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.encoding import TOKENIZER_DIR
from claimweave.runtime import ship_package, spread

VOCABULARY = "byte_bpe_50k.json"
#: Letters of a literal that no dictionary word explains, from which it counts as random.
RESIDUAL = 8
MASK = "[REDACTED]"

#: Last words of names that announce a credential, and of names that announce a hash, an id or public matter (fixed values).
SECRET_WORDS = frozenset("password passwd pwd pass passphrase secret token apikey credential credentials passcode pin".split())
SECRET_PAIRS = frozenset((("api", "key"), ("secret", "key"), ("access", "key"), ("signing", "key"), ("private", "key"), ("x", "key"), ("account", "key"), ("encryption", "key"), ("auth", "key")))
HASH_WORDS = frozenset("checksum sha sha1 sha256 sha512 md5 digest hash integrity revision commit etag fingerprint mappings id uuid guid pb cert certificate version signature nonce names sources".split())

_CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_CREDENTIAL_NAME = re.compile(r"(?i)(?:passw(?:or)?d|passwd|pwd|passphrase|passcode|pass|secret|token|key|credentials?)(?=[\"'`\])}]*\s*(?:[:=|>]|is\s)|[\"']\s+value=)")
_URI = re.compile(r"\b[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@\"'`<>|]*:([^\s@/\"'`|]+)@[\w.-]")
_BLOCK = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----")
_HEX = re.compile(r"[0-9a-fA-F]+\Z")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
_HASH_LEAD = re.compile(r"(?i)(?:sha(?:1|224|256|384|512)|md5)[-:=]\Z")
_HASH_FORM = re.compile(r"(?i)sha(?:1|224|256|384|512)-|md5-")
#: What encoded certificates and public keys begin with, and rows of literals behind one.
_PUBLIC_LEAD = re.compile(r"LS0tLS1CRUdJTi(?:BDRVJU|BQVUJM)")
_ROWS = re.compile(r"""[^\n]{0,4}(?:\r?\n[ \t]*[bBrR]?(["'])[A-Za-z0-9+/=_-]{40,}\1[ \t]*[,+\\)]?[ \t]*(?=\r?\n|\Z)){3}""")
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_VARIABLE = re.compile(r"\$\{|\$\(|\$[A-Za-z_]|\{\{|%[A-Za-z_]+%|<[^>]*>|\A%\w|\A\*+\Z|\A[xX*.#_-]+\Z|\A@")
_PLACEHOLDER = re.compile(r"(?i)(?:change[_ -]?(?:me|it|this)|replace[_ -]?(?:me|this)?|todo|tbd|fixme|not[_ -]?set|unset|none|null|nil|true|false|example|dummy|placeholder|\[?redacted\]?|masked|your[_ -].*|insert[_ -].*|x{3,}|\*{3,}|password|passwd|user_password|secret|token|undefined|empty|optional|required|default|env|vault.*|file.*)\Z")
_JOIN = re.compile(r"(['\"])[ \t]*\+?[ \t]*(?:\\?\r?\n[ \t]*)?\+?[ \t]*\1(?=[^\s'\"])")
_CLOSE = re.compile(r"[\s\"'`<>|,;)\]}]")
_SCHEME = re.compile(r"(?:Bearer|Basic|Token)\Z")
_OWN_NAME = re.compile(r"(?:-e|--env)?=?([A-Za-z_][\w.-]*)[=:]")
_INNER_NAME = re.compile(r"([A-Za-z_][\w.-]*)=")
_OPEN_END = re.compile(r"\r?\n\s*\r?\n|[\"'`]|\Z")
#: Characters that end the word of a literal, beside blanks.
_SEPARATORS = frozenset("\"'`<>|,([{")


@lru_cache(maxsize=4)
def dictionary(path: str) -> tuple[dict[str, float], int]:
    """Cost of each whole word of the vocabulary, and the length of the longest."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    words: dict[str, float] = {}
    for token, rank in vocab.items():
        w = token[1:].lower() if token[:1] == "\u0120" else ""
        if len(w) >= 3 and w.isascii() and w.isalpha():
            words[w] = min(words.get(w, 99.0), math.log(rank + 50))
    return words, max(map(len, words))


class Segmenter:
    """Viterbi segmentation; an unexplained letter costs more than its share of any common word."""

    def __init__(self, path: str):
        self.words, self.longest = dictionary(path)
        self.seen: dict[str, int] = {}

    def unexplained(self, piece: str) -> int:
        """Letters of a piece that lie in no word of the cheapest segmentation."""
        piece = piece.lower()
        if (known := self.seen.get(piece)) is not None:
            return known
        n = len(piece)
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, n + 1):
            cost, rest = best[end - 1]
            top = (cost + 7.0, rest + 1)
            for start in range(max(0, end - self.longest), end - 2):
                c = self.words.get(piece[start:end])
                if c is not None and best[start][0] + c + 2.0 < top[0]:
                    top = (best[start][0] + c + 2.0, best[start][1])
            best.append(top)
        if len(self.seen) > 200_000:
            self.seen = {}
        self.seen[piece] = best[n][1]
        return best[n][1]

    def residual(self, literal: str) -> int:
        return sum(len(p) if len(p) < 3 else self.unexplained(p) for p in _PIECES.findall(literal))


def name_words(name: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]


@lru_cache(maxsize=50_000)
def kind_of_name(name: str) -> str:
    """secret, hash or other."""
    words = name_words(name)
    while words and words[-1].isdigit() and words[-2:-1] != ["sha"]:
        words.pop()
    if not words:
        return "other"
    if "public" in words or words[-1] in HASH_WORDS or words[-1].isdigit():
        return "hash"
    if words[-1] in SECRET_WORDS or tuple(words[-2:]) in SECRET_PAIRS:
        return "secret"
    return "other"


def written_out(value: str) -> bool:
    """Whether a value under a credential's name is a credential and not a placeholder, reference, path or word."""
    if _VARIABLE.search(value) or _PLACEHOLDER.match(value) or _UUID.match(value):
        return False
    if re.match(r"(?:/|\.{1,2}/|~/|[A-Za-z]:\\|https?://|[a-z]+:[a-z]+/|vault:|arn:|file:)", value):
        return False
    if re.fullmatch(r"[A-Za-z]+=[a-z-]+", value):
        return False
    if re.match(r"[A-Za-z_][\w.]*[(\[]|[a-z_]+(?:\.[a-z_]+)+\Z", value) or value.isdigit():
        return False
    digit = any(c.isdigit() for c in value)
    upper, lower = any(c.isupper() for c in value), any(c.islower() for c in value)
    letters = upper or lower
    if digit and letters:
        return len(value) >= 8
    return upper and lower and (len(value) >= 16 or any(not c.isalnum() for c in value) and len(value) >= 12)


class Finder:
    """Spans of credentials in texts and values."""

    def __init__(self, path: str):
        self.words = Segmenter(path)

    def random(self, literal: str) -> bool:
        """A long unexplained residual outside the known hash formats."""
        bare = literal.rstrip("=")
        if _HEX.match(bare) or _UUID.match(bare):
            return False
        flips = sum(a.islower() and b.isupper() for a, b in zip(bare, bare[1:]))
        if not any(c.isdigit() for c in bare) and flips < 3:
            # Key ids can be capitals alone: one unbroken run that is mostly no words.
            return bare.isalpha() and bare.isupper() and self.words.residual(bare) >= 0.6 * len(bare)
        return self.words.residual(bare) >= RESIDUAL

    def value(self, name: str, value: str | None, reference: bool = False) -> list[tuple[int, int]]:
        """Spans of credentials in the value of a named setting."""
        if not value or not value.strip():
            return []
        spans = self.forms(value)
        if spans or "-----BEGIN" in value:
            return spans
        kind = kind_of_name(name or "")
        bare = value.strip()
        at = value.index(bare)
        if kind == "secret" and written_out(bare) and (not reference or not re.fullmatch(r"[A-Za-z]+(?:[-_.][A-Za-z]+)*(?:[-_.]\d+)?", bare) or kind_of_reference(bare)):
            return [(at, at + len(bare))]
        if kind == "hash":
            return []
        return self.tokens(value, whole=True)

    def forms(self, text: str) -> list[tuple[int, int]]:
        """Private key blocks and passwords of connection strings."""
        spans = []
        if "-----BEGIN" in text:
            ends = [m.start() for m in re.finditer("-----END", text)]
            begins = [m.start() for m in re.finditer("-----BEGIN", text)]
            for m in _BLOCK.finditer(text):
                if "PRIVATE" not in m.group(1):
                    continue
                end, nxt = _after(ends, m.end()), _after(begins, m.end())
                if end is None or nxt is not None and nxt < end:
                    stop = _OPEN_END.search(text, m.end())
                    spans.append((m.end(), stop.start()))
                else:
                    spans.append((m.end(), end))
        for m in _URI.finditer(text) if "://" in text else ():
            pw = m.group(1)
            if not _VARIABLE.search(pw) and not _PLACEHOLDER.match(pw) and "<" not in pw:
                spans.append(m.span(1))
        return spans

    def tokens(self, text: str, whole: bool = False) -> list[tuple[int, int]]:
        """Random literals; outside of a whole value they must follow an assignment. One walk: `word` is where the text
        without separators in which a literal stands begins, looked for behind the literal before only."""
        spans = []
        word = seen = 0
        for m in _CANDIDATE.finditer(text):
            start = m.start()
            k = start
            while k > seen and text[k - 1] not in _SEPARATORS and not text[k - 1].isspace():
                k -= 1
            if k > seen:
                word = k
            seen = start
            if not self.random(m.group()):
                continue
            if _in_data_uri(text, start) or _PUBLIC_LEAD.match(text, start) or _ROWS.match(text, m.end()):
                continue
            if _HASH_LEAD.search(text[max(0, start - 8) : start]) or _HASH_FORM.match(text, start):
                continue
            if not whole and not self.assigned(text, word, start):
                continue
            spans.append((start, m.end()))
        return spans

    def assigned(self, text: str, word: int, start: int) -> bool:
        """Whether the literal at `start`, in the word that begins at `word`, is given to a name by a mark in front."""
        k = word
        while k and text[k - 1] in " \t":
            k -= 1
        if k < word and (scheme := _SCHEME.search(text[max(0, k - 6) : k])):
            word, bearer = k - len(scheme.group()), word == start and scheme.group() != "Token"
        else:
            bearer = False
        name = _xml_name(text, word)
        if name is None and (mark := _mark(text, word)) is not None:
            name = _name_before(text, mark)
        own = _OWN_NAME.match(text, word, start)
        if name is None and own:
            name = own.group(1)
        if name is None and not bearer:
            return False
        if (inner := _INNER_NAME.match(text, word, start)) and kind_of_name(inner.group(1)) == "hash":
            return False
        return kind_of_name(name or "") != "hash"

    def named(self, text: str, masked: Cover) -> list[tuple[int, int]]:
        """Values that follow a name which announces a credential."""
        spans = []
        for m in _CREDENTIAL_NAME.finditer(text):
            end = m.end()
            start = m.start()
            while start and (text[start - 1].isalnum() or text[start - 1] in "_-."):
                start -= 1
            name = text[start:end]
            if kind_of_name(name) != "secret":
                continue
            v = _ASSIGNED.match(text, end)
            if not v:
                continue
            at = v.end()
            quote = v.group("q") or ""
            if quote and quote in "\"'`":
                stop = at
                while stop < len(text) and text[stop] not in quote + "\n":
                    stop += 2 if text[stop] == "\\" else 1
                stop = min(stop, len(text))
                # A quoted list or a sentence is no value.
                if re.search(r"\s", text[at:stop].strip()):
                    if not re.match(r"(?:Bearer|Basic)\s+\S+\Z", text[at:stop].strip()):
                        continue
            else:
                close = _CLOSE.search(text, at)
                stop = close.start() if close else len(text)
                if v.group("m") == "is":
                    while stop > at and text[stop - 1] in ".,;:!?":
                        stop -= 1
            value = text[at:stop]
            if written_out(value) and "://" not in value and not masked.meets(at, stop):
                spans.append((at, stop))
        return spans

    def text(self, text: str | None) -> list[tuple[int, int]]:
        """Spans in a whole text, in order, not overlapping; several spans can belong to one split literal."""
        if not text:
            return []
        joined, at = _collapse(text)
        blocks = _blocks(joined) if "-----BEGIN" in joined else []
        spans = self.forms(joined)
        known = Cover(spans + blocks)
        spans += [s for s in self.tokens(joined) if not known.meets(*s)]
        spans += self.named(joined, Cover(spans + blocks))
        return [x for s in sorted(set(spans)) for x in at(s)]


def kind_of_reference(value: str) -> bool:
    """A key of a referenced object that is itself a pass phrase: words with a number behind."""
    return re.fullmatch(r"[a-z]+(?:[-_][a-z]+){2,}[-_]\d+", value) is not None


_ASSIGNED = re.compile(r"(?:[\"'`\])}]*\s*(?P<m>=>|:=|[:=|>]|is\b|[\"']\s+value=)\s*)(?P<q>[\"'`])?")


def _blocks(text: str) -> list[tuple[int, int]]:
    """Key and certificate blocks with their marks; one that is cut off reaches to the end of the text."""
    ends = [m.end() for m in re.finditer(r"-----END(?s:.*?)-----", text)]
    out = []
    for m in _BLOCK.finditer(text):
        end = _after(ends, m.end() + 1)
        out.append((m.start(), len(text) if end is None else end))
    return out


def _after(at: list[int], least: int) -> int | None:
    """The first of sorted positions that is not before `least`."""
    k = bisect_left(at, least)
    return at[k] if k < len(at) else None


class Cover:
    """The union of spans, to ask whether another one meets it."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b) - 1
        return k >= 0 and self.ends[k] > a


def _in_data_uri(text: str, start: int) -> bool:
    """Whether the literal is the data of a URI: `data:TYPE,` or `;base64,` in front."""
    if text[start - 1 : start] != ",":
        return False
    k = start - 1
    while k and (text[k - 1].isalnum() or text[k - 1] in "_.+/;=-"):
        k -= 1
    return text[max(0, start - 8) : start].lower() == ";base64," or text[max(0, k - 5) : k].lower() == "data:"


def _mark(text: str, k: int) -> int | None:
    """Where the assignment mark in front of k begins, over quotes, blanks and prefixes of literals; None without one."""
    while k and text[k - 1] in "\"'`brf( \t":
        k -= 1
    two, one = text[max(0, k - 2) : k], text[k - 1 : k]
    if two in ("=>", ":="):
        return k - 2
    if one and one in ":=>|":
        return k - 1
    return k - 2 if two == "is" and not (k > 2 and (text[k - 3].isalnum() or text[k - 3] == "_")) else None


def _name_before(text: str, k: int) -> str:
    """The name that ends in front of k, over quotes, brackets and blanks; '' without one."""
    while k and text[k - 1] in "\"'`])} \t":
        k -= 1
    end = k
    while k and (text[k - 1].isalnum() or text[k - 1] in "_.-"):
        k -= 1
    while k < end and not (text[k].isalpha() or text[k] == "_"):
        k += 1
    return text[k:end]


def _xml_name(text: str, k: int) -> str | None:
    """The name of `name="NAME" value="` in front of k."""
    k -= k > 0 and text[k - 1] in "\"'"
    if text[max(0, k - 6) : k] != "value=" or not text[k - 7 : k - 6].isspace():
        return None
    k -= 6
    while k and text[k - 1].isspace():
        k -= 1
    if text[k - 1 : k] not in ("'", '"'):
        return None
    end = k = k - 1
    while k and text[k - 1] not in "\"'":
        k -= 1
    return text[k:end] if k < end and text[max(0, k - 6) : k - 1] == "name=" else None


def _collapse(text: str):
    """The text with concatenated string literals joined, and a function from its spans to spans of the original."""
    cuts = [(m.start(), m.end()) for m in _JOIN.finditer(text) if "+" in m.group() or "\n" in m.group()] if "+" in text else []
    if not cuts:
        return text, lambda s: [s]
    parts, starts, pos, length = [], [], 0, 0
    for a, b in cuts:
        parts.append(text[pos:a])
        starts.append((length, pos))
        length += a - pos
        pos = b
    parts.append(text[pos:])
    starts.append((length, pos))

    def back(span: tuple[int, int]) -> list[tuple[int, int]]:
        out = []
        for k, (new, old) in enumerate(starts):
            stop = starts[k + 1][0] if k + 1 < len(starts) else length + len(parts[-1])
            a, b = max(span[0], new), min(span[1], stop)
            if a < b:
                out.append((a - new + old, b - new + old))
        return out

    return "".join(parts), back


def redact(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text with the spans masked; line ends inside a span stay."""
    if not spans:
        return text
    out, pos = [], 0
    for a, b in spans:
        if a < pos:
            continue
        out.append(text[pos:a])
        breaks = re.findall(r"\r?\n", text[a:b])
        out.append(MASK + "".join(breaks))
        pos = b
    return "".join(out) + text[pos:]


_FINDERS: dict[str, Finder] = {}


def finder(folder: str | None = None) -> Finder:
    path = os.path.join(folder or TOKENIZER_DIR, VOCABULARY)
    if path not in _FINDERS:
        _FINDERS[path] = Finder(path)
    return _FINDERS[path]


def in_texts(df: DataFrame, origin: str, rid: str, text: str, folder: str | None = None) -> DataFrame:
    """Lines of texts that hold credentials: origin, rec_id, spot (line number as text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = finder(folder)
        for b in batches:
            rows = []
            for rec, t in zip(b["rec_id"], b["text"]):
                at = line = 0
                lines = {}
                for start, _ in f.text(t):  # in order; a key block begins with its mark, in front of the masked part
                    line += t.count("\n", at, start)
                    at = start
                    lines[line + 1] = None
                rows += [(origin, rec, str(n)) for n in lines]
            yield pd.DataFrame(rows, columns=["origin", "rec_id", "spot"])

    return spread(df.select(F.col(rid).cast("bigint").alias("rec_id"), F.col(text).alias("text")).where("text is not null")).mapInPandas(run, "origin string, rec_id bigint, spot string")


def in_values(df: DataFrame, origin: str, folder: str | None = None) -> DataFrame:
    """Named values (rec_id, spot, name, value, reference) that hold credentials: origin, rec_id, spot."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = finder(folder)
        for b in batches:
            rows = [(origin, r, s) for r, s, n, v, ref in zip(b["rec_id"], b["spot"], b["name"], b["value"], b["reference"]) if f.value(n or "", v, bool(ref))]
            yield pd.DataFrame(rows, columns=["origin", "rec_id", "spot"])

    ship_package(df.sparkSession)
    return df.select("rec_id", "spot", "name", "value", "reference").where("value is not null and value <> ''").mapInPandas(run, "origin string, rec_id bigint, spot string")


def k8s_values(k8s: DataFrame) -> DataFrame:
    """Env values and keys of references of workloads, with their spot."""
    c = k8s.select(F.col("resource_id").cast("bigint").alias("rec_id"), F.explode("containers").alias("c")).where("c is not null")
    e = c.select("rec_id", F.coalesce("c.name", F.lit("")).alias("container"), F.explode("c.env").alias("e")).where("e is not null")
    spot = F.concat_ws("/", "container", F.coalesce("e.name", F.lit("")))
    both = F.array(F.struct(F.col("e.value").alias("value"), F.lit(False).alias("reference")), F.struct(F.col("e.ref_key").alias("value"), F.lit(True).alias("reference")))
    return e.select("rec_id", spot.alias("spot"), F.coalesce("e.name", F.lit("")).alias("name"), F.inline(both))


def docker_values(docker: DataFrame) -> DataFrame:
    """Env pairs of container definitions, with their key as the spot."""
    pairs = docker.select(F.col("docker_id").cast("bigint").alias("rec_id"), F.explode("env_pairs").alias("spot", "value"))
    return pairs.select("rec_id", "spot", F.col("spot").alias("name"), "value", F.lit(False).alias("reference"))


def credentials(k8s: DataFrame, docker: DataFrame, files: DataFrame, docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Every place with a credential: origin, rec_id, spot."""
    found = in_values(k8s_values(k8s), "k8s", folder).unionByName(in_values(docker_values(docker), "docker", folder))
    found = found.unionByName(in_texts(files, "file", "file_id", "content", folder)).unionByName(in_texts(docs, "doc", "doc_id", "text", folder))
    return found.distinct()


def redacted_texts(df: DataFrame, rid: str, text: str, folder: str | None = None) -> DataFrame:
    """rid, the text with its credentials masked, n_masked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = finder(folder)
        for b in batches:
            spans = [f.text(t) for t in b["text"]]
            yield pd.DataFrame({rid: b["rec_id"], text: [redact(t, s) for t, s in zip(b["text"], spans)], "n_masked": [len(s) for s in spans]})

    return spread(df.select(F.col(rid).cast("bigint").alias("rec_id"), F.col(text).alias("text"))).mapInPandas(run, f"{rid} bigint, {text} string, n_masked bigint")


def redacted_values(values: DataFrame, folder: str | None = None) -> DataFrame:
    """Named values with their credentials masked: rec_id, spot, name, value, reference, n_masked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = finder(folder)
        for b in batches:
            spans = [f.value(n or "", v, bool(r)) for n, v, r in zip(b["name"], b["value"], b["reference"])]
            yield b.assign(value=[redact(v, sorted(s)) for v, s in zip(b["value"], spans)], n_masked=[len(s) for s in spans])

    ship_package(values.sparkSession)
    return values.select("rec_id", "spot", "name", "value", "reference").mapInPandas(run, "rec_id bigint, spot string, name string, value string, reference boolean, n_masked bigint")
