"""Generated, minified, vendored and data files, by belief propagation over directory trees.

Variables are the labels of directories, of groups of siblings (the files of one kind in one directory) and of files.
Files have evidence of their own (marks in their comments, name, size, test mark, shape of their text), directories have
some (their name). Compatibilities tie a directory to its parent, a group of siblings to its directory and a file to its
group, so siblings speak to each other through their group and, further off, through the directory. The graph is a tree:
two passes of sum-product messages (from the deepest level up, and down again) give the exact marginals of all files.
Beliefs add up log messages, so a directory with a third of all files is summed by partial aggregation, and its one row
is looked up by broadcast.

Evidence has no thresholds in size: what a mark, a number table or a dense line says grows with their share and amount.

Defined cases
* null or empty content leaves the evidence of path, name, size and test mark; null paths lie in the root directory of
  their repository; null or missing sizes and test marks say nothing;
* a notice of the repository's own owner is no third-party notice; marks count only in comments, wherever they stand in a file;
* repeated file rows count once in the result (each repeat adds its evidence to the group); ties go to handwritten.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.runtime import lookup_join, materialize, noted, spread

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
#: Log potentials of a file without evidence, and of a directory without a telling name.
FILE_PRIOR = (0.0, -6.0, -6.0, -6.0, -6.0)
DIR_PRIOR = (0.0, -12.0, -12.0, -12.0, -12.0)
STRONG = 14.0
#: Evidence of a telling directory name for vendored, and of a name of output directories for generated and minified.
NAMED, OUTPUT = 28.0, 4.0
#: Log compatibilities of a group of siblings (row) with a file in it (column). Among generated, minified or data files a
#: file without evidence is unlikely, and each file with evidence makes the next one likelier; a vendored group holds
#: vendored things.
SIBLING = (
    (0.0, 0.0, 0.0, 0.0, 0.0),
    (-5.5, 1.0, 0.0, 0.0, 0.0),
    (-5.5, 0.0, 1.0, 0.0, 0.0),
    (-5.0, 0.0, 0.0, 4.0, 0.0),
    (-5.5, 0.0, 0.0, 0.0, 1.0),
)
#: The same between a directory and a group of siblings in it.
GROUP = (
    (0.0, -4.0, -4.0, -12.0, -4.0),
    (-3.0, 0.0, -4.0, -12.0, -4.0),
    (-3.0, -4.0, 0.0, -12.0, -4.0),
    (-12.0, -4.0, -4.0, 0.0, -4.0),
    (-3.0, -4.0, -4.0, -12.0, 0.0),
)
#: The same between a directory and a directory in it. A directory with a telling name starts a tree of its own: it says
#: nothing about the directory above it, nor that one about it.
BETWEEN = (
    (0.0, 0.0, 0.0, 0.0, 0.0),
    (0.0, 2.0, 0.0, 0.0, 0.0),
    (0.0, 0.0, 2.0, 0.0, 0.0),
    (-5.0, 0.0, 0.0, 12.0, 0.0),
    (0.0, 0.0, 0.0, 0.0, 2.0),
)
#: Names of directories that tools write (fixed values).
OUTPUT_DIRS = ("generated", "__generated__", "gen", "dist")
#: Directory names of third-party code (fixed values).
VENDOR_DIRS = ("vendor", "vendored", "third_party", "third-party", "thirdparty", "node_modules", "bower_components", "godeps", "site-packages", "dist-packages", "deps", "external", "externals", "contrib", ".bundle", "jspm_packages")
#: File names of lock files (fixed values).
LOCK_FILES = frozenset("package-lock.json npm-shrinkwrap.json yarn.lock pnpm-lock.yaml cargo.lock poetry.lock composer-lock.json composer.lock gemfile.lock pipfile.lock go.sum podfile.lock mix.lock flake.lock uv.lock bun.lock".split())

_COMMENT = re.compile(r"^\s*(?://|#|/\*|\*|<!--|--|;|\"\"\")")
_MADE = re.compile(r"(?i)code generated\b.*\bdo not edit|@generated\b|\bauto-?generated (?:file|by|from|code)\b|\bautogenerated[.!]|\b(?:produced|generated|created|written) automatically\b|\bautomatically (?:produced|generated) by\b|\bdo not (?:edit|modify|change)(?: this file)?(?: by hand| manually|[.!]?\s*(?:\*/|-->)?$)|changes will be (?:overwritten|lost)")
_NOTICE = re.compile(r"(?i)copyright\s+(?:\(c\)|©)?\s*(?:\d{4}[\d, -]*)?\s*(?:the\s+)?(.*)")
_LICENCE = re.compile(r"(?i)spdx-license-identifier|licensed under|see license\.")
_ORIGIN = re.compile(r"^\s*(?://|#|/\*!?|\*)\s*([\w.-]+) v?\d+\.\d+[\w.]*\s*(?:-\s*https?://|\*/|$)")
_MACHINE = re.compile(r"\.uint32\(\d+\)\.|\bbitField\w*_|\) ProtoMessage\(\)|_serialized_(?:start|end)\b|\bserialized_pb=|\) Reset\(\) \{ \*x = |^export function decode\w+\(\w+(?:: any)?\) \{ return ", re.M)
_NUMBER = re.compile(r"(?<![\w.])-?(?:0x[0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)(?![\w.])")
_LOCK = re.compile(r'"lockfileVersion"\s*:\s*\d')
_WORD = re.compile(r"(?<!\w)[A-Za-z_]\w*")
_BYTES = re.compile(r"""(?m)^\s*[bBrR]?(['"])[A-Za-z0-9+/=]{48,}\1\s*[,+\\]?\s*$""")


def evidence(repo: str, path: str, name: str, text: str | None, is_test: bool | None = None, size: float | None = None) -> tuple[float, ...]:
    """Log potentials of the labels from the file alone."""
    base = (name or path.rsplit("/", 1)[-1]).lower()
    body = text or ""
    lines = body.split("\n")
    comments = [x.strip() for x in lines if _COMMENT.match(x)]
    made = any(_MADE.search(x) for x in comments)
    made |= base in LOCK_FILES or body.lstrip("\ufeff \t\r\n").startswith("{") and _LOCK.search(body) is not None or body.count("[[package]]") > 1 and "checksum" in body
    made |= base.endswith(".map") or bool(re.match(r'\s*\{\s*"version"\s*:\s*\d+\s*,\s*"(?:file|sources|names|mappings)"', body)) and '"mappings"' in body
    used = max(1, sum(1 for x in lines if x.strip()))
    made |= sum(1 for _ in _MACHINE.finditer(body)) >= 0.15 * used
    made |= bool(re.search(r"(?:_pb2?|\.pb|_pb2_grpc|outerclass|\.g|\.generated|_generated|\.designer)\.\w+$", base))
    owner = (repo or "").split("_", 1)[0].lower()
    own = foreign = False
    for x in comments:
        if m := _NOTICE.search(x):
            holder = m.group(1).lower()
            if owner and re.search(rf"(?<![\w-]){re.escape(owner)}(?![\w-])", holder):
                own = True
            elif holder.strip(" ."):
                foreign = True
    if not own:
        foreign |= any(_LICENCE.search(x) or _ORIGIN.match(x) for x in comments)
    # Numbers beyond four to a word, and rows of encoded bytes where they are most of the file.
    data = min(STRONG, 0.25 * max(0, sum(1 for _ in _NUMBER.finditer(body)) - 4 * sum(1 for _ in _WORD.finditer(body))))
    rows = sum(1 for _ in _BYTES.finditer(body))
    if rows >= 0.6 * used:
        data = max(data, min(STRONG, 3.0 * rows))
    small = 0.0
    if re.search(r"\.(?:[cm]?jsx?|css|tsx?)$", base) and data < -FILE_PRIOR[4]:
        # Characters in dense lines (hardly a blank, many marks, no long literals); each line counts for what it adds to 80.
        small = min(STRONG, sum(max(0, len(x) - 80) for x in lines if _dense(x)) / 20)
        if re.search(r"\.(?:min|bundle|chunk)\.(?:[cm]?js|css)$|\.[0-9a-f]{8,}\.(?:js|css)$", base):
            small = max(small, STRONG if not body else min(STRONG, max(map(len, lines)) / 15))
    hand = 2.0 if own and not (made or small > -FILE_PRIOR[2]) else 0.0
    hand += 0.5 if is_test else 0.0
    # Without a text, a large size speaks for output or data rather than for a hand.
    large = min(2.0, 0.5 * math.log2(size / 65_536)) if not body and size is not None and size > 65_536 else 0.0
    found = (hand, STRONG * made + large, small + large, STRONG * foreign, data + large)
    return tuple(p + f for p, f in zip(FILE_PRIOR, found))


def _dense(line: str) -> bool:
    n = len(line)
    if n <= 80 or sum(line.count(c) for c in " \t") >= 0.1 * n or line.count('"') + line.count("'") + line.count("`") >= 0.05 * n:
        return False
    return sum(line.count(c) for c in ";,(){}=:.!?&|[]") >= 0.2 * n


def file_evidence(files: DataFrame) -> DataFrame:
    """file_id, repo_id, dir (path of the directory, '' at the root), kind (extension of the name), e0 to e4."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for fid, repo, path, name, text, test, size in zip(b["file_id"], b["repo_id"], b["path"], b["name"], b["content"], b["is_test"], b["size_bytes"]):
                path = path or ""
                base = (name or path.rsplit("/", 1)[-1]).lower()
                found = evidence(repo or "", path, name or "", text, None if pd.isna(test) else bool(test), None if pd.isna(size) else float(size))
                rows.append((fid, repo or "", path.rpartition("/")[0], base.rpartition(".")[2] if "." in base else "", *found))
            yield pd.DataFrame(rows, columns=["file_id", "repo_id", "dir", "kind", "e0", "e1", "e2", "e3", "e4"])

    given = lambda c, kind: (F.col(c) if c in files.columns else F.lit(None)).cast(kind).alias(c)
    slim = files.select(F.col("file_id").cast("bigint").alias("file_id"), "repo_id", "path", "name", "content", given("is_test", "boolean"), given("size_bytes", "double"))
    return spread(slim).mapInPandas(run, "file_id bigint, repo_id string, dir string, kind string, e0 double, e1 double, e2 double, e3 double, e4 double")


FIVE = range(5)


def _sum(terms: list[Column]) -> Column:
    """log of the sum of exponentials."""
    top = F.greatest(*terms)
    total = F.exp(terms[0] - top)
    for t in terms[1:]:
        total = total + F.exp(t - top)
    return top + F.log(total)


def _up(cols: list[Column], ties) -> list[Column]:
    """Message from a member with log beliefs `cols` to what holds it: summed over the labels of the member."""
    return [_sum([c + F.lit(ties[p][k]) for k, c in enumerate(cols)]) for p in FIVE]


def _down(cols: list[Column], ties) -> list[Column]:
    """Message from a holder with log beliefs `cols` (without the member's own) to a member."""
    return [_sum([c + F.lit(ties[p][k]) for p, c in enumerate(cols)]) for k in FIVE]


def _named(cols: list[Column], prefix: str) -> list[Column]:
    return [c.alias(f"{prefix}{i}") for i, c in enumerate(cols)]


def _sums(prefix: str) -> list[Column]:
    return [F.sum(f"{prefix}{i}").alias(f"s{i}") for i in FIVE]


def _all(prefix: str) -> list[Column]:
    return [F.col(f"{prefix}{i}") for i in FIVE]


def beliefs(files: DataFrame) -> DataFrame:
    """file_id, label and the log odds of the label against handwritten."""
    e, b, o, m, g = (_all(x) for x in "ebomg")
    leaf = materialize(file_evidence(files).select("file_id", "repo_id", "dir", "kind", *e, *_named(_up(e, SIBLING), "m")))
    # Groups of siblings: what their files say together, and what they tell the directory.
    groups = leaf.groupBy("repo_id", "dir", "kind").agg(*[F.sum(f"m{i}").alias(f"g{i}") for i in FIVE])
    groups = materialize(groups.select("repo_id", "dir", "kind", *g, *_named(_up(g, GROUP), "m")))
    own = groups.groupBy("repo_id", "dir").agg(*_sums("m"))
    # All directories, with the sum of their groups' messages.
    parts = F.split("dir", "/")
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(parts))
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.when(k == 0, "").otherwise(F.array_join(F.slice(parts, 1, F.greatest(k, F.lit(1))), "/")))
    every = own.select("repo_id", F.explode(F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(above)).alias("dir")).distinct()
    last = F.lower(F.element_at(parts, -1))
    named, output = last.isin(*VENDOR_DIRS), last.isin(*OUTPUT_DIRS)
    says = {3: F.when(named, NAMED).otherwise(0.0), 1: F.when(output, OUTPUT).otherwise(0.0), 2: F.when(output, OUTPUT).otherwise(0.0)}
    unary = [F.lit(DIR_PRIOR[i]) + says.get(i, F.lit(0.0)) for i in FIVE]
    parent = F.when(depth <= 1, "").otherwise(F.regexp_replace("dir", r"/[^/]*$", ""))
    dirs = every.join(own, ["repo_id", "dir"], "left").select("repo_id", "dir", parent.alias("parent"), depth.alias("depth"), named.alias("named"), *[(unary[i] + F.coalesce(f"s{i}", F.lit(0.0))).alias(f"b{i}") for i in FIVE])
    dirs = materialize(dirs, by="depth", deepest=F.max("depth"))
    deepest = noted(dirs, "deepest")
    # Up: a level's directories are complete when all deeper ones have sent their messages.
    done: dict[int, DataFrame] = {}
    sent = None
    for k in range(deepest, -1, -1):
        level = dirs.where(F.col("depth") == k).drop("depth")
        if sent is not None:
            got = sent.groupBy("repo_id", F.col("parent").alias("dir")).agg(*_sums("m"))
            level = level.join(got, ["repo_id", "dir"], "left").select("repo_id", "dir", "parent", "named", *[(b[i] + F.coalesce(f"s{i}", F.lit(0.0))).alias(f"b{i}") for i in FIVE])
        said = [F.when(F.col("named"), 0.0).otherwise(x) for x in _up(b, BETWEEN)]
        done[k] = sent = materialize(level.select("repo_id", "dir", "named", "parent", *b, *_named(said, "m")))
    # Down: each directory hears from its parent what its own message did not say.
    full = total = done[0].select("repo_id", "dir", *b)
    for k in range(1, deepest + 1):
        over = full.select("repo_id", F.col("dir").alias("parent"), *_named(b, "o"))
        heard = [F.when(F.col("named"), 0.0).otherwise(x) for x in _down([o[i] - m[i] for i in FIVE], BETWEEN)]
        full = done[k].join(over, ["repo_id", "parent"]).select("repo_id", "dir", *[(b[i] + heard[i]).alias(f"b{i}") for i in FIVE])
        full = materialize(full)
        total = total.unionByName(full)
    # Groups hear from their directory, files from their group.
    heard = _down([o[i] - m[i] for i in FIVE], GROUP)
    told = groups.join(total.select("repo_id", "dir", *_named(b, "o")), ["repo_id", "dir"]).select("repo_id", "dir", "kind", *[(g[i] + heard[i]).alias(f"o{i}") for i in FIVE])
    key = F.concat_ws("\u0001", "repo_id", "dir", "kind")
    at = lookup_join(leaf.withColumn("key", key), told.select(key.alias("key"), *o), "key", noted(leaf), "inner")
    heard = _down([o[i] - m[i] for i in FIVE], SIBLING)
    final = materialize(at.select("file_id", *[(e[i] + heard[i]).alias(f"f{i}") for i in FIVE]))
    f = _all("f")
    best = F.greatest(*f)
    label = F.when(f[0] >= best, LABELS[0])
    for i in range(1, 5):
        label = label.when(f[i] >= best, LABELS[i])
    return final.select("file_id", label.alias("label"), F.round(best - f[0], 4).alias("log_odds"))


def not_handwritten(files: DataFrame) -> DataFrame:
    return beliefs(files).where("label <> 'handwritten'").select("file_id").distinct()
