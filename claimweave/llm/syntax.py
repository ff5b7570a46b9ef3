"""Source files that do not parse.

The languages of a file are ranked by tokens typical of each; the file is parsed with the grammar of its own language and,
where that fails, with all other grammars in ranked order. A foreign grammar that accepts it points to a wrong extension,
failure of all to corruption (truncation, conflict marks). Files that parse are not tried further: no other result could
change theirs. One pass, no shuffle, whole texts.

Defined cases
* null content and languages without a grammar are never invalid; a null language is the one that the name stands for;
* empty content is invalid where the grammar needs something (JSON, XML, Go) and valid elsewhere;
* repeated file rows count once; parse failures that a scan does not report (null) stay null in the rates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm import grammars
from claimweave.runtime import spread

#: Tokens that speak for a language, one count each (fixed values).
_TOKENS = {
    "Python": r"^\s*(?:def |class \w+[:(]|from \w[\w.]* import |import \w+$|elif |self\.)|:\s*$",
    "JavaScript": r"\b(?:const|let|function|=>|===|export|async)\b|\) => |;\s*$",
    "TypeScript": r"\b(?:interface|readonly|string\[\]|: (?:string|number|boolean|any|void)\b)|Record<",
    "Java": r"\b(?:public|private|protected|static|void|final)\b|^import java|;\s*$",
    "Go": r"^(?:package \w+$|func |type \w+ (?:struct|interface))|:=|\bnil\b",
    "YAML": r"^\s*(?:- )?[\w.-]+:(?:\s|$)",
    "JSON": r'^\s*"[^"]*":\s|^\s*[\[{]$|^\s*[}\]],?$',
    "XML": r"</?\w+[^>]*>|<!--|^<\?xml",
}
_RANK = {k: re.compile(v, re.M) for k, v in _TOKENS.items()}
MARKS = re.compile(r"^(?:<{7}|>{7}|={7}|\|{7})(?: |$)", re.M)


def language_of(language: str | None, name: str | None) -> str | None:
    if language:
        return language
    return grammars.EXTENSIONS.get(name.rsplit(".", 1)[-1].lower()) if name and "." in name else None


def ranked(text: str) -> list[str]:
    """Languages by the number of their tokens, most first, ties by name."""
    counts = {k: sum(1 for _ in p.finditer(text)) for k, p in _RANK.items()}
    return sorted(counts, key=lambda k: (-counts[k], k))


def diagnose(own: str, text: str) -> tuple[str, str | None]:
    """Why a file that is invalid for its language is so: foreign (and the language), conflict, or corrupt."""
    for other in ranked(text):
        if other == own or {other, own} == {"JavaScript", "TypeScript"} and MARKS.search(text):
            continue
        # Nearly any prose is one plain YAML scalar; only text that ranks YAML first counts as YAML.
        if other == "YAML" and ranked(text)[0] != "YAML":
            continue
        if grammars.check(other, text):
            return "foreign", other
    return ("conflict" if MARKS.search(text) else "corrupt"), None


def verdicts(files: DataFrame, explain: bool = False) -> DataFrame:
    """Files of languages with a grammar: file_id, repo_id, lang, invalid (0 or 1), and with explain: cause, parses_as."""
    extra = ", cause string, parses_as string" if explain else ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for fid, repo, lang, name, text in zip(batch["file_id"], batch["repo_id"], batch["language"], batch["name"], batch["content"]):
                own = language_of(lang, name)
                if text is None or own not in grammars.GRAMMARS:
                    continue
                bad = grammars.check(own, text) is False
                row = (fid, repo, own, int(bad))
                rows.append(row + (diagnose(own, text) if bad else (None, None)) if explain else row)
            yield pd.DataFrame(rows, columns=["file_id", "repo_id", "lang", "invalid"] + (["cause", "parses_as"] if explain else []))

    slim = files.select(F.col("file_id").cast("bigint").alias("file_id"), "repo_id", "language", "name", "content")
    return spread(slim).mapInPandas(run, "file_id bigint, repo_id string, lang string, invalid bigint" + extra)


def invalid_files(files: DataFrame) -> DataFrame:
    return verdicts(files, True).where("invalid = 1").select("file_id").distinct()


def rates(files: DataFrame, scans: DataFrame) -> DataFrame:
    """Per repository and language: repo_id, lang, n_files, n_invalid, rate, and the last scan's parse_failures."""
    once = verdicts(files, True).groupBy("repo_id", "lang", "file_id").agg(F.max("invalid").alias("invalid"))
    per = once.groupBy("repo_id", "lang").agg(F.count("*").alias("n_files"), F.sum("invalid").alias("n_invalid"))
    last = scans.groupBy("repo_id").agg(F.max_by("parse_failures", F.struct("scanned_at", "delivered_at", "scan_id")).cast("bigint").alias("reported_failures"))
    total = per.groupBy("repo_id").agg(F.sum("n_invalid").alias("repo_invalid"))
    out = per.join(total, "repo_id").join(last, "repo_id", "left")
    return out.select("repo_id", "lang", "n_files", "n_invalid", F.round(F.col("n_invalid") / F.col("n_files"), 6).alias("rate"), "repo_invalid", "reported_failures")


def causes(files: DataFrame) -> DataFrame:
    """Invalid files with their cause: file_id, lang, cause, parses_as."""
    return verdicts(files, True).where("invalid = 1").select("file_id", "lang", "cause", "parses_as").distinct()


__all__ = ["verdicts", "invalid_files", "rates", "causes"]
