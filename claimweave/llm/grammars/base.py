"""What the recursive-descent recognisers share: tokens, lookahead, trial parses."""

from __future__ import annotations

import re


class Invalid(Exception):
    """The text is not in the language."""


class Recogniser:
    """Tokens are parallel lists: kind (id, num, str, re, tpl, op, eof), text, and whether a line end comes before."""

    def __init__(self, kinds: list[str], texts: list[str], breaks: list[bool]):
        self.kinds, self.texts, self.breaks = kinds, texts, breaks
        kinds.append("eof")
        texts.append("")
        breaks.append(True)
        self.i = 0
        #: Tokens that gave up a first `>`: index, text, break; taken back when a trial fails.
        self.cuts: list[tuple[int, str, bool]] = []

    def at(self, *texts: str) -> bool:
        return self.texts[self.i] in texts and self.kinds[self.i] in ("op", "id")

    def ahead(self, n: int = 1) -> str:
        j = self.i + n
        return self.texts[j] if j < len(self.texts) and self.kinds[j] != "str" else ""

    def kind(self, n: int = 0) -> str:
        j = self.i + n
        return self.kinds[j] if j < len(self.kinds) else "eof"

    def fail(self) -> None:
        raise Invalid(f"at token {self.i}: {self.texts[self.i]!r}")

    def next(self) -> str:
        t = self.texts[self.i]
        if self.kinds[self.i] == "eof":
            self.fail()
        self.i += 1
        return t

    def take(self, *texts: str) -> bool:
        if self.at(*texts):
            self.i += 1
            return True
        return False

    def need(self, *texts: str) -> None:
        if not self.take(*texts):
            self.fail()

    def attempt(self, rule) -> bool:
        """Try a rule; on failure nothing is consumed."""
        start, cuts = self.i, len(self.cuts)
        try:
            rule()
            return True
        except Invalid:
            self.i = start
            while len(self.cuts) > cuts:
                at, text, broke = self.cuts.pop()
                self.texts[at], self.breaks[at] = text, broke
            return False

    def listed(self, rule, close: str, sep: str = ",", trailing: bool = True) -> None:
        """rule (sep rule)* close, with the close token consumed."""
        while not self.take(close):
            rule()
            if not self.take(sep):
                self.need(close)
                return
            if not trailing and self.at(close):
                self.fail()

    def at_angle(self) -> bool:
        """Whether the token at the cursor begins with `>`."""
        return self.kinds[self.i] == "op" and self.texts[self.i][:1] == ">"

    def need_angle(self) -> None:
        """Take one `>`; of `>>`, `>=`... the rest stays at the cursor."""
        if not self.at_angle():
            self.fail()
        t = self.texts[self.i]
        if len(t) == 1:
            self.i += 1
        else:
            self.cuts.append((self.i, t, self.breaks[self.i]))
            self.texts[self.i], self.breaks[self.i] = t[1:], False


def balanced(kinds: list[str], texts: list[str]) -> bool:
    """Brackets outside literals pair up."""
    pairs = {")": "(", "]": "[", "}": "{"}
    stack: list[str] = []
    for k, t in zip(kinds, texts):
        if k == "op":
            if t in "([{" and t:
                stack.append(t)
            elif t in pairs and (not stack or stack.pop() != pairs[t]):
                return False
    return not stack


def scan(text: str, rules: re.Pattern, lines: bool = True) -> tuple[list[str], list[str], list[bool]]:
    """Tokens by a pattern with the groups sp (blanks, comments), id, num, str, op; anything else is invalid."""
    kinds, texts, breaks = [], [], []
    pos, n, broke = 0, len(text), False
    match = rules.match
    while pos < n:
        m = match(text, pos)
        if not m:
            raise Invalid(f"character {text[pos]!r}")
        kind = m.lastgroup
        if kind == "sp":
            broke = broke or "\n" in m.group()
        else:
            kinds.append(kind)
            texts.append(m.group())
            breaks.append(broke)
            broke = False
        pos = m.end()
    return kinds, texts, breaks
