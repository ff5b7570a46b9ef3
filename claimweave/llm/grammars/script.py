"""Recogniser of JavaScript (ES2023 modules and scripts) and TypeScript."""

from __future__ import annotations

import re

from claimweave.llm.grammars.base import Invalid, Recogniser

_RULES = re.compile(
    r"""(?P<sp>[\s﻿]+|//[^\n\r  ]*|/\*.*?\*/)
    |(?P<num>0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[bB][01](?:_?[01])*n?|0[oO][0-7](?:_?[0-7])*n?
      |(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?n?)(?![\w$])
    |(?P<id>\#?(?:[^\W\d]|[$_]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$‌‍]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*)
    |(?P<str>"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')
    |(?P<op>>>>=|\.\.\.|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|===|!==|=>|==|!=|<=|>=|\?\?|\?\.(?!\d)|&&|\|\||\+\+|--|\*\*|<<|>>
      |[+\-*/%&|^]=|[{}()\[\];,<>+\-*/%&|^!~?:=.@])""",
    re.S | re.X,
)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[a-z]*")
#: Reserved words (fixed values of the language).
RESERVED = frozenset("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split())
_VALUE_WORDS = frozenset("this null true false super".split())
ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
BINARY = frozenset("+ - * / % ** << >> >>> & | ^ && || ?? == != === !== < > <= >= in instanceof".split())


def tokens(text: str) -> tuple[list[str], list[str], list[bool], list[str]]:
    """Tokens, and the sources of the expressions inside template literals."""
    kinds: list[str] = []
    texts: list[str] = []
    breaks: list[bool] = []
    inner: list[str] = []
    pos, n, broke = 0, len(text), False
    if text.startswith("#!"):
        pos = text.find("\n") if "\n" in text else n
    match = _RULES.match
    while pos < n:
        c = text[pos]
        if c == "`":
            end = _template(text, pos, inner)
            kinds.append("tpl")
            texts.append("`")
        elif c == "/" and text[pos + 1 : pos + 2] not in ("/", "*") and _regex_here(kinds, texts):
            m = _REGEX.match(text, pos)
            if not m:
                raise Invalid("regular expression")
            end = m.end()
            kinds.append("re")
            texts.append("/re/")
        else:
            m = match(text, pos)
            if not m:
                raise Invalid(f"character {c!r}")
            end = m.end()
            if m.lastgroup == "sp":
                t = m.group()
                broke = broke or "\n" in t or "\r" in t
                pos = end
                continue
            kinds.append(m.lastgroup)
            texts.append(m.group())
        breaks.append(broke)
        broke = False
        pos = end
    return kinds, texts, breaks, inner


def _regex_here(kinds: list[str], texts: list[str]) -> bool:
    if not kinds:
        return True
    k, t = kinds[-1], texts[-1]
    if k == "op":
        return t not in (")", "]", "}", "++", "--")
    if k == "id":
        return t in RESERVED and t not in _VALUE_WORDS
    return False


def _template(text: str, pos: int, inner: list[str]) -> int:
    """End of the template literal that starts at pos."""
    i, n = pos + 1, len(text)
    while i < n:
        c = text[i]
        if c == "\\":
            i += 2
        elif c == "`":
            return i + 1
        elif c == "$" and text[i + 1 : i + 2] == "{":
            start = i = i + 2
            depth = 1
            while i < n and depth:
                c = text[i]
                if c == "`":
                    i = _template(text, i, [])
                    continue
                if c in "'\"":
                    m = _RULES.match(text, i)
                    if not m:
                        raise Invalid("string in template")
                    i = m.end()
                    continue
                depth += (c == "{") - (c == "}")
                i += 1
            if depth:
                break
            inner.append(text[start : i - 1])
        else:
            i += 1
    raise Invalid("template literal")


def _closes(kinds: list[str], texts: list[str]) -> dict[int, int]:
    """The closing bracket of every bracket that has one."""
    open_: list[int] = []
    closes: dict[int, int] = {}
    for j, (k, t) in enumerate(zip(kinds, texts)):
        if k == "op":
            if t in ("(", "[", "{"):
                open_.append(j)
            elif t in (")", "]", "}") and open_:
                closes[open_.pop()] = j
    return closes


class Script(Recogniser):
    def __init__(self, text: str, typed: bool):
        kinds, texts, breaks, inner = tokens(text)
        super().__init__(kinds, texts, breaks)
        self.typed = typed
        self.inner = inner
        self.closes = _closes(kinds, texts)
        #: Function bodies around the cursor.
        self.bodies = 0

    def program(self) -> None:
        while self.kinds[self.i] != "eof":
            self.statement()
        for source in self.inner:
            sub = Script(source, self.typed)
            sub.expression()
            if sub.kinds[sub.i] != "eof":
                sub.fail()
            sub.i = 0
            for s in sub.inner:
                Script(s, self.typed).expression()

    # Statements

    def semicolon(self) -> None:
        if not self.take(";") and not self.at("}") and self.kind() != "eof" and not self.breaks[self.i]:
            self.fail()

    def name(self) -> None:
        t = self.texts[self.i]
        if self.kinds[self.i] != "id" or t in RESERVED or t[0] == "#":
            self.fail()
        self.i += 1

    def block(self) -> None:
        self.need("{")
        while not self.take("}"):
            self.statement()

    def body(self) -> None:
        """Block of a function."""
        self.bodies += 1
        try:
            self.block()
        finally:
            self.bodies -= 1

    def statement(self) -> None:
        k, t = self.kinds[self.i], self.texts[self.i]
        if k == "op":
            if t == "{":
                return self.block()
            if t == ";":
                self.i += 1
                return None
            if t == "@":
                self.decorators()
                return self.statement()
        elif k == "id":
            rule = getattr(self, "s_" + t, None) if t in _STATEMENTS else None
            if rule:
                return rule()
            if t == "let" and (self.kind(1) == "id" and self.ahead() not in ("in", "instanceof", "of") or self.ahead() in ("[", "{")):
                return self.s_var()
            if t == "async" and self.ahead() == "function" and not self.breaks[self.i + 1]:
                self.i += 1
                return self.s_function()
            if t not in RESERVED and self.ahead() == ":" and self.kind(1) == "op":
                self.i += 2
                return self.statement()
            if self.typed and self.typed_statement(t):
                return None
        self.expression()
        self.semicolon()

    def typed_statement(self, t: str) -> bool:
        nxt = self.kind(1) == "id" and not self.breaks[self.i + 1]
        if t == "interface" and nxt:
            self.i += 1
            self.name()
            self.type_params()
            if self.take("extends"):
                self.type_()
                while self.take(","):
                    self.type_()
            self.object_type()
        elif t == "type" and nxt:
            self.i += 1
            self.name()
            self.type_params()
            self.need("=")
            self.type_()
            self.semicolon()
        elif t in ("namespace", "module", "global") and (nxt or self.kind(1) == "str" or t == "global" and self.ahead() == "{"):
            self.i += 1
            if not self.at("{"):
                self.next()
                while self.take("."):
                    self.name()
            if self.at("{"):
                self.block()
            else:
                self.semicolon()
        elif t in ("declare", "abstract") and nxt:
            self.i += 1
            self.statement()
        else:
            return False
        return True

    def s_enum(self) -> None:
        if not self.typed:
            self.fail()
        self.i += 1
        self.name()
        self.need("{")
        self.listed(self.enum_member, "}")

    def enum_member(self) -> None:
        self.property_name()
        if self.take("="):
            self.assignment()

    def s_var(self, in_for: bool = False) -> None:
        const = self.next() == "const"
        if const and self.typed and self.at("enum"):
            return self.s_enum()
        while True:
            pattern = self.at("{", "[")
            self.target()
            if self.typed:
                self.take("!")
                if self.take(":"):
                    self.type_()
            if self.take("="):
                self.assignment(not in_for)
            elif (const or pattern) and not in_for and not self.typed:
                self.fail()
            if not self.take(","):
                break
        if not in_for:
            self.semicolon()

    s_const = s_var

    def target(self) -> None:
        """A binding: name or pattern."""
        if self.take("["):
            while not self.take("]"):
                if self.take(","):
                    continue
                self.take("...")
                self.target()
                if self.take("="):
                    self.assignment()
                if not self.at("]"):
                    self.need(",")
        elif self.take("{"):
            while not self.take("}"):
                if self.take("..."):
                    self.target()
                elif self.kind() == "id" and self.ahead() != ":":
                    self.name()
                    if self.take("="):
                        self.assignment()
                else:
                    self.property_name()
                    self.need(":")
                    self.target()
                    if self.take("="):
                        self.assignment()
                if not self.at("}"):
                    self.need(",")
        else:
            self.name()

    def s_function(self, named: bool = True) -> None:
        self.need("function")
        self.take("*")
        if named or not self.at("(", "<"):
            self.name()
        self.function_rest()

    def function_rest(self, body: bool = True) -> None:
        if self.typed:
            self.type_params()
        self.params()
        if self.typed and self.take(":"):
            self.return_type()
        if self.typed and not self.at("{"):
            self.semicolon()
        else:
            self.body()

    def params(self) -> None:
        self.need("(")
        self.listed(self.param, ")")

    def param(self) -> None:
        self.decorators()
        if self.typed:
            while self.at("public", "private", "protected", "readonly", "override") and (self.kind(1) == "id" or self.ahead() in ("{", "[")):
                self.i += 1
            if self.at("this"):
                self.i += 1
                self.need(":")
                return self.type_()
        rest = self.take("...")
        self.target()
        if self.typed:
            self.take("?")
            if self.take(":"):
                self.type_()
        if not rest and self.take("="):
            self.assignment()
        if rest and not self.at(")"):
            self.fail()

    def decorators(self) -> None:
        while self.take("@"):
            if self.take("("):
                self.expression()
                self.need(")")
            else:
                self.next()
                while self.take("."):
                    self.next()
                if self.take("("):
                    self.listed(self.argument, ")")

    def s_class(self) -> None:
        self.need("class")
        if not self.at("{", "extends"):
            self.name()
        if self.typed:
            self.type_params()
        if self.take("extends"):
            self.unary()
            if self.typed and self.at("<"):
                self.type_args()
        if self.typed and self.take("implements"):
            self.type_()
            while self.take(","):
                self.type_()
        self.need("{")
        while not self.take("}"):
            if not self.take(";"):
                self.member()

    def member(self) -> None:
        self.decorators()
        words = ("static", "async", "get", "set", "accessor") + (("public", "private", "protected", "readonly", "abstract", "override", "declare") if self.typed else ())
        while self.at(*words) and self.ahead() not in ("(", "=", ";", "}", ":", "?", "!", "<", ","):
            if self.texts[self.i] == "static" and self.ahead() == "{":
                self.i += 1
                return self.block()
            self.i += 1
        self.take("*")
        if self.typed and self.at("[") and self.kind(1) == "id" and self.ahead(2) == ":":
            self.index_signature()
            return self.semicolon()
        self.property_name()
        if self.typed and not self.take("?"):
            self.take("!")
        if self.at("(", "<"):
            return self.function_rest()
        if self.typed and self.take(":"):
            self.type_()
        if self.take("="):
            self.assignment()
        self.semicolon()

    def s_if(self) -> None:
        self.i += 1
        self.condition()
        self.statement()
        if self.take("else"):
            self.statement()

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def s_while(self) -> None:
        self.i += 1
        self.condition()
        self.statement()

    s_with = s_while

    def s_do(self) -> None:
        self.i += 1
        self.statement()
        self.need("while")
        self.condition()
        self.take(";")

    def s_for(self) -> None:
        self.i += 1
        self.take("await")
        self.need("(")
        if not self.at(";"):
            if self.at("var", "const") or self.at("let") and (self.kind(1) == "id" or self.ahead() in ("[", "{")):
                self.s_var(True)
            else:
                self.expression(False)
            if self.take("of"):
                self.assignment()
                self.need(")")
                return self.statement()
            if self.take("in"):
                self.expression()
                self.need(")")
                return self.statement()
        self.need(";")
        if not self.at(";"):
            self.expression()
        self.need(";")
        if not self.at(")"):
            self.expression()
        self.need(")")
        self.statement()

    def s_try(self) -> None:
        self.i += 1
        self.block()
        caught = self.take("catch")
        if caught:
            if self.take("("):
                self.target()
                if self.typed and self.take(":"):
                    self.type_()
                self.need(")")
            self.block()
        if self.take("finally"):
            self.block()
        elif not caught:
            self.fail()

    def s_switch(self) -> None:
        self.i += 1
        self.condition()
        self.need("{")
        while not self.take("}"):
            if self.take("case"):
                self.expression()
            else:
                self.need("default")
            self.need(":")
            while not self.at("case", "default", "}"):
                self.statement()

    def s_return(self) -> None:
        if not (self.bodies or self.typed):
            self.fail()
        self.i += 1
        if not self.at(";", "}") and self.kind() != "eof" and not self.breaks[self.i]:
            self.expression()
        self.semicolon()

    def s_throw(self) -> None:
        self.i += 1
        if self.breaks[self.i]:
            self.fail()
        self.expression()
        self.semicolon()

    def s_break(self) -> None:
        self.i += 1
        if self.kind() == "id" and not self.breaks[self.i] and not self.at("case", "default"):
            self.name()
        self.semicolon()

    s_continue = s_break

    def s_debugger(self) -> None:
        self.i += 1
        self.semicolon()

    def s_import(self) -> None:
        if self.ahead() in ("(", "."):
            self.expression()
            return self.semicolon()
        self.i += 1
        if self.kind() != "str":
            if self.typed and self.at("type") and self.ahead() not in ("from", ","):
                self.i += 1
            if self.kind() == "id":
                self.name()
                if self.typed and self.take("="):
                    self.expression()
                    return self.semicolon()
                if not self.at("from"):
                    self.need(",")
            if self.take("*"):
                self.need("as")
                self.name()
            elif self.take("{"):
                self.listed(self.specifier, "}")
            self.need("from")
        self.source()
        self.semicolon()

    def source(self) -> None:
        if self.kind() != "str":
            self.fail()
        self.i += 1
        if self.at("with", "assert") and self.ahead() == "{":
            self.i += 1
            self.object_literal()

    def specifier(self) -> None:
        if self.typed and self.at("type") and self.kind(1) == "id" and self.ahead() != "as":
            self.i += 1
        if self.kind() not in ("id", "str"):
            self.fail()
        self.i += 1
        if self.take("as"):
            if self.kind() not in ("id", "str"):
                self.fail()
            self.i += 1

    def s_export(self) -> None:
        self.i += 1
        if self.take("default"):
            if self.at("function") or self.at("async") and self.ahead() == "function":
                self.take("async")
                return self.s_function(False)
            if self.at("class"):
                return self.s_class()
            if self.typed and self.at("interface", "abstract"):
                return self.statement()
            self.assignment()
            return self.semicolon()
        if self.typed and self.take("="):
            self.expression()
            return self.semicolon()
        if self.typed and self.at("type") and self.ahead() in ("{", "*"):
            self.i += 1
        if self.take("*"):
            if self.take("as"):
                self.next()
            self.need("from")
            self.source()
            return self.semicolon()
        if self.take("{"):
            self.listed(self.specifier, "}")
            if self.take("from"):
                self.source()
            return self.semicolon()
        typed_words = ("interface", "type", "enum", "namespace", "module", "declare", "abstract") if self.typed else ()
        if self.at("var", "let", "const", "function", "class", "async", "@", *typed_words):
            return self.statement()
        self.fail()

    # Expressions

    def expression(self, allow_in: bool = True) -> None:
        self.assignment(allow_in)
        while self.take(","):
            self.assignment(allow_in)

    def close_of(self, at: int) -> int:
        """Index of the bracket that closes the one at `at`."""
        if at not in self.closes:
            raise Invalid("bracket")
        return self.closes[at]

    def arrow(self) -> bool:
        """An arrow function at the cursor, if there is one."""
        start = self.i
        if self.at("async") and not self.breaks[self.i + 1] and (self.kind(1) == "id" and self.ahead(2) == "=>" or self.ahead() in ("(", "<")):
            self.i += 1
        if self.kind() == "id" and self.ahead() == "=>":
            self.name()
        elif self.at("("):
            end = self.close_of(self.i)
            after = self.texts[end + 1]
            if after != "=>" and not (self.typed and after == ":"):
                self.i = start
                return False
            if not self.attempt(self.arrow_head):
                self.i = start
                return False
        elif self.typed and self.at("<"):
            if not self.attempt(self.arrow_head):
                self.i = start
                return False
        else:
            self.i = start
            return False
        if self.breaks[self.i]:
            self.fail()
        self.need("=>")
        if self.at("{"):
            self.body()
        else:
            self.assignment()
        return True

    def arrow_head(self) -> None:
        if self.typed:
            self.type_params()
        self.params()
        if self.typed and self.take(":"):
            self.return_type()
        if not self.at("=>"):
            self.fail()

    def assignment(self, allow_in: bool = True) -> None:
        if self.kind() in ("id", "op"):
            if self.at("(", "async", "<") or self.ahead() == "=>":
                if self.arrow():
                    return
            if self.at("yield"):
                self.i += 1
                if not self.breaks[self.i] and not self.at(")", "]", "}", ",", ";", ":") and self.kind() != "eof":
                    self.take("*")
                    self.assignment(allow_in)
                return
        place = self.unary()
        plain = place
        while True:
            t = self.texts[self.i]
            if self.kinds[self.i] not in ("op", "id"):
                break
            if t in BINARY:
                if t == "in" and not allow_in:
                    break
                self.i += 1
                self.unary()
                plain = False
            elif self.typed and t in ("as", "satisfies") and not self.breaks[self.i]:
                self.i += 1
                if not self.take("const"):
                    self.type_()
            else:
                break
        if self.kinds[self.i] != "op":
            return
        t = self.texts[self.i]
        if t == "?":
            self.i += 1
            self.assignment()
            self.need(":")
            self.assignment(allow_in)
        elif t in ASSIGN:
            if not plain:
                self.fail()
            self.i += 1
            self.assignment(allow_in)

    def unary(self) -> bool:
        """A unary expression; True where it can be assigned to."""
        prefixed = False
        while self.kind() == "op" and self.at("!", "~", "+", "-", "++", "--") or self.kind() == "id" and self.at("typeof", "void", "delete", "await") and not (self.at("await") and self.ahead() in (")", ";", ",", "=", ".")):
            self.i += 1
            prefixed = True
        if self.typed and self.at("<") and not prefixed:
            self.type_args()
            self.unary()
            return False
        place = self.postfix()
        if self.at("++", "--") and not self.breaks[self.i]:
            if not place:
                self.fail()
            self.i += 1
            return False
        return place and not prefixed

    def postfix(self) -> bool:
        place = self.primary()
        while True:
            k, t = self.kinds[self.i], self.texts[self.i]
            if k == "tpl":
                self.i += 1
                place = False
                continue
            if k != "op":
                return place
            if t == ".":
                self.i += 1
                if self.kind() != "id":
                    self.fail()
                self.i += 1
                place = True
            elif t == "?.":
                self.i += 1
                if self.take("("):
                    self.listed(self.argument, ")")
                elif self.take("["):
                    self.expression()
                    self.need("]")
                elif self.kind() == "id":
                    self.i += 1
                elif self.kind() != "tpl":
                    self.fail()
                place = False
            elif t == "[":
                self.i += 1
                self.expression()
                self.need("]")
                place = True
            elif t == "(":
                self.i += 1
                self.listed(self.argument, ")")
                place = False
            elif self.typed and t == "!" and not self.breaks[self.i]:
                self.i += 1
            elif self.typed and t == "<" and self.attempt(self.typed_call):
                place = False
            else:
                return place

    def typed_call(self) -> None:
        self.type_args()
        if self.kind() == "tpl":
            self.i += 1
            return
        self.need("(")
        self.listed(self.argument, ")")

    def argument(self) -> None:
        self.take("...")
        self.assignment()

    def primary(self) -> bool:
        k, t = self.kinds[self.i], self.texts[self.i]
        if k in ("num", "str", "tpl", "re"):
            self.i += 1
            return False
        if k == "op":
            if t == "(":
                self.i += 1
                self.expression()
                self.need(")")
                return True
            if t == "[":
                self.i += 1
                while not self.take("]"):
                    if self.take(","):
                        continue
                    self.argument()
                    if not self.at("]"):
                        self.need(",")
                return True
            if t == "{":
                self.object_literal()
                return True
            if t == "@":
                self.decorators()
                self.s_class()
                return False
            self.fail()
        if k != "id":
            self.fail()
        if t == "function" or t == "async" and self.ahead() == "function" and not self.breaks[self.i + 1]:
            self.take("async")
            self.s_function(False)
            return False
        if t == "class":
            self.s_class()
            return False
        if t == "new":
            self.i += 1
            if self.take("."):
                self.next()
                return False
            if self.at("new"):
                self.primary()
            else:
                self.callee()
            if self.typed and self.at("<"):
                self.attempt(self.type_args)
            if self.take("("):
                self.listed(self.argument, ")")
            return False
        if t == "import":
            self.i += 1
            if self.take("."):
                self.next()
            elif self.at("("):
                self.i += 1
                self.listed(self.argument, ")")
            else:
                self.fail()
            return False
        if t in _VALUE_WORDS:
            self.i += 1
            return False
        if t[0] == "#" and self.ahead() != "in" or t in RESERVED:
            self.fail()
        self.i += 1
        return True

    def callee(self) -> None:
        self.primary()
        while True:
            if self.take("."):
                if self.kind() != "id":
                    self.fail()
                self.i += 1
            elif self.take("["):
                self.expression()
                self.need("]")
            else:
                return

    def object_literal(self) -> None:
        self.need("{")
        while not self.take("}"):
            self.prop()
            if not self.at("}"):
                self.need(",")

    def prop(self) -> None:
        if self.take("..."):
            return self.assignment()
        while self.at("async", "get", "set") and self.ahead() not in ("(", ":", ",", "}", "=", "<"):
            self.i += 1
        star = self.take("*")
        lone = self.kind() == "id" and self.texts[self.i] not in RESERVED
        self.property_name()
        if self.at("(", "<") and (self.typed or self.at("(")):
            return self.function_rest()
        if star:
            self.fail()
        if self.take(":"):
            return self.assignment()
        if lone:
            if self.take("="):
                self.assignment()
            return None
        self.fail()

    def property_name(self) -> None:
        if self.take("["):
            self.assignment()
            self.need("]")
        elif self.kind() in ("id", "str", "num"):
            self.i += 1
        else:
            self.fail()

    # Types

    def type_params(self) -> None:
        if self.take("<"):
            while not self.at(">"):
                self.take("const")
                self.take("in")
                self.take("out")
                self.name()
                if self.take("extends"):
                    self.type_()
                if self.take("="):
                    self.type_()
                if not self.take(","):
                    break
            self.need_angle()

    def type_args(self) -> None:
        self.need("<")
        self.type_()
        while self.take(","):
            self.type_()
        self.need_angle()

    def return_type(self) -> None:
        if self.at("asserts") and self.kind(1) == "id" and not self.breaks[self.i + 1]:
            self.i += 1
        if self.kind() == "id" and self.ahead() == "is":
            self.i += 2
        self.type_()

    def type_(self) -> None:
        self.union_type()
        if self.at("extends") and not self.breaks[self.i]:
            start = self.i
            self.i += 1
            self.union_type()
            if not self.take("?"):
                self.i = start
                return
            self.type_()
            self.need(":")
            self.type_()

    def union_type(self) -> None:
        self.take("|", "&")
        self.unary_type()
        while self.take("|", "&"):
            self.unary_type()

    def unary_type(self) -> None:
        while self.at("keyof", "readonly", "unique", "infer") and (self.kind(1) == "id" or self.ahead() in ("(", "[", "{")):
            self.i += 1
        self.primary_type()
        while self.at("[") and not self.breaks[self.i]:
            self.i += 1
            if not self.take("]"):
                self.type_()
                self.need("]")

    def primary_type(self) -> None:
        k, t = self.kinds[self.i], self.texts[self.i]
        if k in ("num", "str", "tpl"):
            self.i += 1
        elif t == "-" and self.kind(1) == "num":
            self.i += 2
        elif t == "(" or t == "<" or t in ("new", "abstract") and self.ahead() in ("(", "<", "new"):
            if not self.attempt(self.function_type):
                self.need("(")
                self.type_()
                self.need(")")
        elif t == "{":
            if not self.attempt(self.object_type):
                self.mapped_type()
        elif t == "[":
            self.i += 1
            self.listed(self.tuple_member, "]")
        elif t == "typeof":
            self.i += 1
            self.next()
            while self.take("."):
                self.next()
        elif t == "import":
            self.i += 1
            self.need("(")
            self.next()
            self.need(")")
            while self.take("."):
                self.next()
        elif k == "id" and (t not in RESERVED or t in ("void", "null", "true", "false", "this")):
            self.i += 1
            while self.take("."):
                self.next()
            if self.at("<") and not self.breaks[self.i]:
                self.type_args()
        else:
            self.fail()

    def tuple_member(self) -> None:
        self.take("...")
        if self.kind() == "id" and self.ahead() in (":", "?"):
            self.i += 1
            self.take("?")
            if self.take(":"):
                self.type_()
            return
        self.type_()
        self.take("?")

    def function_type(self) -> None:
        self.take("abstract")
        self.take("new")
        self.type_params()
        self.params()
        self.need("=>")
        self.return_type()

    def index_signature(self) -> None:
        self.need("[")
        self.name()
        self.need(":")
        self.type_()
        self.need("]")
        self.take("?")
        self.need(":")
        self.type_()

    def object_type(self) -> None:
        self.need("{")
        while not self.take("}"):
            while self.at("readonly", "get", "set") and self.ahead() not in ("(", ":", "?", ",", ";", "}", "<"):
                self.i += 1
            if self.at("[") and self.kind(1) == "id" and self.ahead(2) == ":":
                self.index_signature()
            elif self.at("(", "<") or self.at("new") and self.ahead() in ("(", "<"):
                self.take("new")
                self.signature()
            else:
                self.property_name()
                self.take("?")
                if self.at("(", "<"):
                    self.signature()
                elif self.take(":"):
                    self.type_()
            if not self.take(",", ";") and not self.at("}") and not self.breaks[self.i]:
                self.fail()

    def signature(self) -> None:
        self.type_params()
        self.params()
        if self.take(":"):
            self.return_type()

    def mapped_type(self) -> None:
        self.need("{")
        self.take("+", "-")
        self.take("readonly")
        self.need("[")
        self.name()
        self.need("in")
        self.type_()
        if self.take("as"):
            self.type_()
        self.need("]")
        self.take("+", "-")
        self.take("?")
        if self.take(":"):
            self.type_()
        self.take(";")
        self.need("}")


_STATEMENTS = frozenset("var const function class if while with do for try switch return throw break continue debugger import export enum".split())


def javascript(text: str) -> None:
    Script(text, False).program()


def typescript(text: str) -> None:
    Script(text, True).program()
