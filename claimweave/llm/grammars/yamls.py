"""YAML syntax: the event parser of the YAML library where it can be imported, else a structural check."""

from __future__ import annotations

import re

from claimweave.llm.grammars.base import Invalid

try:
    import yaml as _yaml
except ImportError:
    _yaml = None
_LOADER = _yaml and getattr(_yaml, "CLoader", _yaml.Loader)


def yaml(text: str) -> None:
    if _yaml is None:
        return structural(text)
    try:
        for _ in _yaml.parse(text, Loader=_LOADER):
            pass
    except (_yaml.YAMLError, ValueError) as e:
        raise Invalid(str(e)[:80]) from None


_QUOTED = re.compile(r"""(?:'(?:[^']|'')*'|"(?:[^"\\]|\\.)*")""", re.S)


def structural(text: str) -> None:
    """Without the library: tabs in indentation, conflict marks, open quotes and brackets in flow values."""
    block = -1
    for line in text.splitlines():
        bare = line.strip()
        depth = len(line) - len(line.lstrip(" "))
        if block >= 0 and (not bare or depth > block):
            continue
        block = -1
        if line[: len(line) - len(line.lstrip())].count("\t") or re.match(r"(<{7}|>{7}|={7}$|\|{7})", bare):
            raise Invalid(bare[:40])
        rest = re.sub(r"(^|\s)#.*$", "", _QUOTED.sub("q", bare))
        if re.search(r"[:-]\s*[|>][+-]?\d*$", rest):
            block = depth
        value = re.sub(r"^(?:- )*[^\s:\[{]+:\s", "", rest)
        if value[:1] in "[{" and value:
            if sum(value.count(x) for x in "[{") != sum(value.count(x) for x in "]}"):
                raise Invalid(bare[:40])
        if value[:1] in ("'", '"'):
            raise Invalid(bare[:40])
