"""Syntax checks: does a text belong to a language? check(language, text) is True, False, or None for other languages."""

from __future__ import annotations

import ast
import json
import sys
import warnings
import xml.parsers.expat

from claimweave.llm.grammars.base import Invalid
from claimweave.llm.grammars.golang import golang
from claimweave.llm.grammars.java import java
from claimweave.llm.grammars.script import javascript, typescript
from claimweave.llm.grammars.yamls import yaml
from claimweave.operators.shredding import read_deep


def python(text: str) -> None:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text)
        except (SyntaxError, ValueError, MemoryError) as e:
            raise Invalid(str(e)) from None
        except RecursionError:
            pass  # parsed; only the tree is too deep to be handed out


def _no(constant: str) -> None:
    raise ValueError(constant)


def strict_json(text: str) -> None:
    try:
        json.loads(text, parse_constant=_no)
    except RecursionError:
        try:
            read_deep(text, constants=False)
        except ValueError as e:
            raise Invalid(str(e)) from None
    except ValueError as e:
        raise Invalid(str(e)) from None


def xml_document(text: str) -> None:
    try:
        xml.parsers.expat.ParserCreate("utf-8").Parse(text.encode("utf-8", "surrogatepass"), True)
    except xml.parsers.expat.ExpatError as e:
        raise Invalid(str(e)) from None


#: Languages with a grammar, by the names that the files table uses (fixed values).
GRAMMARS = {"Python": python, "JavaScript": javascript, "TypeScript": typescript, "Java": java, "Go": golang, "YAML": yaml, "JSON": strict_json, "XML": xml_document}
#: Languages with a recogniser of this package.
OWN = frozenset(("JavaScript", "TypeScript", "Java", "Go"))
#: Languages by file extension (fixed values).
EXTENSIONS = {"py": "Python", "pyi": "Python", "js": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "ts": "TypeScript", "mts": "TypeScript", "cts": "TypeScript", "java": "Java", "go": "Go", "yaml": "YAML", "yml": "YAML", "json": "JSON", "xml": "XML"}
#: Python frames that one character of text can nest at most, and frames around that. The recognisers are Python functions
#: that call each other, so the limit may grow with the text: their frames lie on the heap.
FRAMES, AROUND = 32, 5_000


def check(language: str | None, text: str) -> bool | None:
    """True, False, or None for other languages; nesting of any depth is followed."""
    rule = GRAMMARS.get(language or "")
    if rule is None:
        return None
    held = sys.getrecursionlimit()
    if language in OWN:
        sys.setrecursionlimit(max(held, AROUND + FRAMES * len(text)))
    try:
        rule(text)
    except Invalid:
        return False
    except RecursionError:
        return True  # not shown to be invalid; only a recogniser that leaves Python for C could come here
    finally:
        sys.setrecursionlimit(held)
    return True
