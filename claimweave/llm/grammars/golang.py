"""Recogniser of Go source files, with automatic semicolons and type parameters."""

from __future__ import annotations

import re

from claimweave.llm.grammars.base import Invalid, Recogniser

_RULES = re.compile(
    r"""(?P<sp>[ \t\r]+|//[^\n]*)
    |(?P<nl>\n)
    |(?P<cm>/\*.*?\*/)
    |(?P<num>(?:0[xX](?:_?[0-9a-fA-F])*(?:\.(?:[0-9a-fA-F](?:_?[0-9a-fA-F])*)?)?(?:[pP][+-]?\d+)?|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+
      |(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d+)?)i?)(?!\w)
    |(?P<id>[^\W\d]\w*)
    |(?P<str>`[^`]*`|"(?:[^"\\\n]|\\[abfnrtv\\"]|\\[0-7]{3}|\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8})*"
      |'(?:[^'\\\n]|\\[abfnrtv\\']|\\[0-7]{3}|\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8})')
    |(?P<op>&\^=|<<=|>>=|\.\.\.|&\^|<<|>>|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|[+\-*/%&|^]=|[{}()\[\];,<>+\-*/%&|^!~:=.])""",
    re.S | re.X,
)
#: Reserved words (fixed values of the language).
RESERVED = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
ASSIGN = frozenset("= := += -= *= /= %= &= |= ^= <<= >>= &^=".split())
BINARY = frozenset("+ - * / % & | ^ << >> &^ && || == != < <= > >=".split())
_ENDS = frozenset(("break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"))


def tokens(text: str) -> tuple[list[str], list[str], list[bool]]:
    kinds: list[str] = []
    texts: list[str] = []
    pos, n = 0, len(text)
    match = _RULES.match
    if text.startswith("﻿"):
        pos = 1

    def line_end() -> None:
        if kinds and (kinds[-1] in ("num", "str") or kinds[-1] == "id" and texts[-1] not in RESERVED or texts[-1] in _ENDS and kinds[-1] != "str"):
            kinds.append("op")
            texts.append(";")

    while pos < n:
        m = match(text, pos)
        if not m:
            raise Invalid(f"character {text[pos]!r}")
        k = m.lastgroup
        if k == "nl" or k == "cm" and "\n" in m.group():
            line_end()
        elif k not in ("sp", "cm"):
            kinds.append(k)
            texts.append(m.group())
        pos = m.end()
    line_end()
    return kinds, texts, [False] * len(kinds)


class Go(Recogniser):
    def __init__(self, text: str):
        super().__init__(*tokens(text))
        #: Composite literals of bare type names are not read while this is set (heads of if, for, switch).
        self.head = False
        #: Whether the cursor is in the head of a switch, the only place of a type guard.
        self.switching = False

    def file(self) -> None:
        self.need("package")
        self.name()
        self.end()
        while self.take("import"):
            self.group(self.import_spec)
            self.end()
        while self.kind() != "eof":
            self.declaration(True)
            self.end()

    def end(self) -> None:
        if not self.take(";") and not self.at(")", "}") and self.kind() != "eof":
            self.fail()

    def name(self) -> None:
        if self.kind() != "id" or self.texts[self.i] in RESERVED:
            self.fail()
        self.i += 1

    def group(self, spec) -> None:
        if self.take("("):
            while not self.take(")"):
                spec()
                self.end()
        else:
            spec()

    def import_spec(self) -> None:
        if not self.take("."):
            if self.kind() == "id":
                self.name()
        if self.kind() != "str":
            self.fail()
        self.i += 1

    def declaration(self, top: bool = False) -> None:
        if self.take("const"):
            self.group(self.const_spec)
        elif self.take("var"):
            self.group(self.var_spec)
        elif self.take("type"):
            self.group(self.type_spec)
        elif top and self.take("func"):
            if self.at("("):
                self.params()
            self.name()
            if self.take("["):
                self.type_params()
            self.signature()
            if self.at("{"):
                self.body()
        else:
            self.fail()

    def names(self) -> None:
        self.name()
        while self.take(","):
            self.name()

    def const_spec(self) -> None:
        self.names()
        if not self.at("=", ";", ")"):
            self.type_()
        if self.take("="):
            self.expressions()

    def var_spec(self) -> None:
        self.names()
        if not self.at("="):
            self.type_()
        if self.take("="):
            self.expressions()

    def type_spec(self) -> None:
        self.name()
        if self.at("["):
            self.attempt(self.bracketed_params)
        self.take("=")
        self.type_()

    def bracketed_params(self) -> None:
        self.need("[")
        self.type_params()
        if self.at(";", ")"):
            self.fail()

    def type_params(self) -> None:
        while not self.take("]"):
            self.names()
            self.constraint()
            if not self.take(","):
                self.need("]")
                return

    def constraint(self) -> None:
        while True:
            self.take("~")
            self.type_()
            if not self.take("|"):
                return

    def signature(self) -> None:
        self.params()
        if self.at("("):
            self.params()
        elif not self.at("{", ";", ")", ",", "]", "}", "=", ":=", ":", ".") and self.kind() not in ("str", "eof"):
            self.type_()

    def params(self) -> None:
        self.need("(")
        self.listed(self.param, ")")

    def param(self) -> None:
        if self.take("..."):
            return self.type_()
        if self.kind() == "id" and self.texts[self.i] not in RESERVED and self.ahead() not in (",", ")", "."):
            start = self.i
            self.i += 1
            self.take("...")
            if self.attempt(self.type_) and self.at(",", ")"):
                return None
            self.i = start
        self.type_()

    def type_(self) -> None:
        k, t = self.kinds[self.i], self.texts[self.i]
        if k == "id":
            if t == "func":
                self.i += 1
                return self.signature()
            if t == "struct":
                return self.struct()
            if t == "interface":
                return self.interface()
            if t == "map":
                self.i += 1
                self.need("[")
                self.type_()
                self.need("]")
                return self.type_()
            if t == "chan":
                self.i += 1
                self.take("<-")
                return self.type_()
            self.name()
            if self.take("."):
                self.name()
            if self.at("["):
                self.attempt(self.type_args)
            return None
        if t == "*":
            self.i += 1
            return self.type_()
        if t == "(":
            self.i += 1
            self.type_()
            return self.need(")")
        if t == "<-":
            self.i += 1
            self.need("chan")
            return self.type_()
        if t == "[":
            self.i += 1
            if not self.take("]"):
                if not self.take("..."):
                    self.expression()
                self.need("]")
            return self.type_()
        self.fail()

    def type_args(self) -> None:
        self.need("[")
        self.type_()
        while self.take(","):
            self.type_()
        self.need("]")

    def struct(self) -> None:
        self.need("struct")
        self.need("{")
        while not self.take("}"):
            if self.take("*"):
                self.type_()
            elif self.kind() == "id" and (self.ahead() in (";", "}", ".") or self.kind(1) == "str"):
                self.type_()
            else:
                self.names()
                self.type_()
            if self.kind() == "str":
                self.i += 1
            self.end()

    def interface(self) -> None:
        self.need("interface")
        self.need("{")
        while not self.take("}"):
            if self.kind() == "id" and self.ahead() == "(":
                self.name()
                self.signature()
            else:
                self.constraint()
            self.end()

    # Statements

    def body(self) -> None:
        held, self.head = self.head, False
        self.block()
        self.head = held

    def block(self) -> None:
        self.need("{")
        while not self.take("}"):
            self.statement()
            self.end()

    def statement(self) -> None:
        t = self.texts[self.i]
        if self.kind() == "id":
            if t in ("const", "var", "type"):
                return self.declaration()
            rule = getattr(self, "s_" + t, None) if t in RESERVED else None
            if rule:
                return rule()
            if t not in RESERVED and self.ahead() == ":":
                self.i += 2
                if not self.at("}"):
                    self.statement()
                return None
        elif self.at("{"):
            return self.block()
        elif self.at(";", "}"):
            return None
        self.simple()

    def simple(self) -> None:
        """Expression, send, increment, assignment or short declaration."""
        self.expressions()
        if self.take("++", "--"):
            return
        if self.take("<-"):
            return self.expression()
        if self.kind() == "op" and self.texts[self.i] in ASSIGN:
            self.i += 1
            if self.take("range"):
                return self.expression()
            self.expressions()

    def clause(self, rule) -> None:
        held, self.head = self.head, True
        rule()
        self.head = held

    def s_if(self) -> None:
        self.need("if")
        self.clause(self.if_head)
        self.body()
        if self.take("else"):
            if self.at("if"):
                self.s_if()
            else:
                self.body()

    def if_head(self) -> None:
        if not self.at(";"):
            self.simple()
        if self.take(";"):
            self.simple()

    def s_for(self) -> None:
        self.need("for")
        self.clause(self.for_head)
        self.body()

    def for_head(self) -> None:
        if self.at("{"):
            return
        if self.take("range"):
            return self.expression()
        if not self.at(";"):
            self.simple()
        if self.take(";"):
            if not self.at(";"):
                self.simple()
            if self.take(";") and not self.at("{"):
                self.simple()

    def s_switch(self) -> None:
        self.need("switch")
        self.clause(self.switch_head)
        self.cases()

    def switch_head(self) -> None:
        if self.at("{"):
            return
        self.switching = True
        if not self.at(";"):
            self.simple()
        if self.take(";") and not self.at("{"):
            self.simple()
        self.switching = False

    def cases(self) -> None:
        held, self.head = self.head, False
        self.need("{")
        while not self.take("}"):
            if self.take("case"):
                while True:
                    if not self.attempt(self.case_expression):
                        self.type_()
                    if not self.take(","):
                        break
                if self.kind() == "op" and self.texts[self.i] in ASSIGN:
                    self.i += 1
                    self.expressions()
                elif self.take("<-"):
                    self.expression()
            else:
                self.need("default")
            self.need(":")
            while not self.at("case", "default", "}"):
                self.statement()
                self.end()
        self.head = held

    def case_expression(self) -> None:
        self.expression()
        if not (self.at(",", ":", "<-") or self.texts[self.i] in ASSIGN):
            self.fail()

    def s_select(self) -> None:
        self.need("select")
        self.cases()

    def s_go(self) -> None:
        self.i += 1
        self.expression()
        if self.texts[self.i - 1] != ")":
            self.fail()

    s_defer = s_go

    def s_return(self) -> None:
        self.i += 1
        if not self.at(";", "}"):
            self.expressions()

    def s_break(self) -> None:
        self.i += 1
        if self.kind() == "id":
            self.name()

    s_continue = s_break

    def s_goto(self) -> None:
        self.i += 1
        self.name()

    def s_fallthrough(self) -> None:
        self.i += 1

    # Expressions

    def expressions(self) -> None:
        self.expression()
        while self.take(","):
            self.expression()

    def expression(self) -> None:
        self.unary()
        while self.kind() == "op" and self.texts[self.i] in BINARY:
            self.i += 1
            self.unary()

    def unary(self) -> None:
        while self.at("+", "-", "!", "^", "*", "&", "<-"):
            if self.at("<-") and self.ahead() == "chan":
                break
            self.i += 1
        self.operand()
        while self.kind() == "op":
            if self.take("."):
                if self.take("("):
                    guard = self.take("type")
                    if not guard:
                        self.type_()
                    self.need(")")
                    if guard and not (self.switching and self.at("{")):
                        self.fail()
                else:
                    self.name()
            elif self.at("("):
                self.arguments()
            elif self.at("["):
                self.index()
            elif self.at("{") and self.literal_here:
                self.literal_value()
                self.literal_here = False
                continue
            else:
                break
            self.literal_here = self.literal_here and not self.head and self.texts[self.i - 1] != ")"

    literal_here = False

    def operand(self) -> None:
        k, t = self.kinds[self.i], self.texts[self.i]
        self.literal_here = False
        if k in ("num", "str"):
            self.i += 1
            return
        if k == "op":
            if t == "(":
                self.i += 1
                held, self.head = self.head, False
                if not self.attempt(self.parenthesised):
                    self.type_()
                    self.need(")")
                self.head = held
                self.literal_here = False
                return
            if t in ("[", "<-"):
                self.type_()
                self.literal_here = True
                if not self.at("{", "("):
                    self.fail()
                return
            self.fail()
        if t == "func":
            self.i += 1
            self.signature()
            if self.at("{"):
                self.body()
            self.literal_here = False
            return
        if t in ("struct", "map", "chan", "interface"):
            self.type_()
            self.literal_here = True
            return
        self.name()
        self.literal_here = not self.head

    def parenthesised(self) -> None:
        self.expression()
        self.need(")")

    def arguments(self) -> None:
        self.need("(")
        held, self.head = self.head, False
        self.listed(self.argument, ")")
        self.head = held
        self.literal_here = False

    def argument(self) -> None:
        if self.at("[", "*", "map", "chan", "struct", "interface", "func") and self.attempt(self.type_argument):
            return
        self.expression()
        self.take("...")

    def type_argument(self) -> None:
        self.type_()
        if not self.at(",", ")"):
            self.fail()

    def index(self) -> None:
        self.need("[")
        here = self.literal_here
        held, self.head = self.head, False
        if not self.at(":"):
            if not self.attempt(self.index_expression):
                self.type_()
            while self.take(","):
                if self.at("]"):
                    break
                self.type_()
        while self.take(":"):
            if not self.at(":", "]"):
                self.expression()
        self.need("]")
        self.head = held
        self.literal_here = here and not held

    def index_expression(self) -> None:
        self.expression()
        if not self.at(":", "]", ","):
            self.fail()

    def literal_value(self) -> None:
        self.need("{")
        held, self.head = self.head, False
        self.listed(self.element, "}")
        self.head = held

    def element(self) -> None:
        self.element_value()
        if self.take(":"):
            self.element_value()

    def element_value(self) -> None:
        if self.at("{"):
            self.literal_value()
        else:
            self.expression()


def golang(text: str) -> None:
    Go(text).file()
