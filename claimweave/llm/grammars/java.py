"""Recogniser of Java compilation units (up to records, switch expressions, text blocks and patterns)."""

from __future__ import annotations

import re

from claimweave.llm.grammars.base import Recogniser, scan

_RULES = re.compile(
    r'''(?P<sp>\s+|//[^\n]*|/\*.*?\*/)
    |(?P<num>0[xX][0-9a-fA-F](?:_*[0-9a-fA-F])*[lL]?|0[bB][01](?:_*[01])*[lL]?
      |(?:\d(?:_*\d)*\.?(?:\d(?:_*\d)*)?|\.\d(?:_*\d)*)(?:[eE][+-]?\d+)?[fFdDlL]?)(?![\w$])
    |(?P<id>[^\W\d][\w$]*|\$[\w$]*)
    |(?P<str>"""[ \t\f]*\r?\n(?:[^\\]|\\.)*?"""|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\(?:u+[0-9a-fA-F]{4}|[0-7]{1,3}|.))')
    |(?P<op>>>>=|\.\.\.|<<=|>>=|->|::|==|!=|<=|>=|&&|\|\||\+\+|--|<<|[+\-*/%&|^]=|[{}()\[\];,<>+\-*/%&|^!~?:=.@])''',
    re.S | re.X,
)
#: Reserved words (fixed values of the language).
RESERVED = frozenset("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split())
PRIMITIVE = frozenset("boolean byte char double float int long short".split())
MODIFIER = frozenset("public private protected static final abstract native synchronized transient volatile strictfp default".split())
ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= >>>=".split())
BINARY = frozenset("+ - * / % << & | ^ && || == != < > <= >=".split())


class Java(Recogniser):
    def __init__(self, text: str):
        super().__init__(*scan(text, _RULES))

    def unit(self) -> None:
        start = self.i
        self.annotations()
        if self.take("package"):
            self.qualified()
            self.need(";")
        else:
            self.i = start
        while self.take("import") or self.take(";"):
            if self.texts[self.i - 1] == "import":
                self.take("static")
                self.qualified(True)
                self.need(";")
        while self.kind() != "eof":
            if not self.take(";"):
                self.modifiers()
                self.type_declaration()

    def name(self) -> None:
        if self.kind() != "id" or self.texts[self.i] in RESERVED:
            self.fail()
        self.i += 1

    def qualified(self, star: bool = False) -> None:
        self.name()
        while self.take("."):
            if star and self.take("*"):
                return
            self.name()

    def annotations(self) -> None:
        while self.at("@") and self.ahead() != "interface":
            self.i += 1
            self.qualified()
            if self.take("("):
                self.listed(self.annotation_value, ")")

    def annotation_value(self) -> None:
        if self.kind() == "id" and self.ahead() == "=":
            self.i += 2
        if self.take("{"):
            return self.listed(self.annotation_value, "}")
        if self.at("@"):
            return self.annotations()
        self.expression()

    def modifiers(self) -> None:
        while True:
            self.annotations()
            t = self.texts[self.i]
            if self.kind() == "id" and t in MODIFIER and not (t == "default" and self.ahead() in (":", "->")):
                self.i += 1
            elif t in ("sealed", "non") and self.kind(1) in ("id", "op") and (self.ahead() in ("class", "interface", "abstract", "public") or t == "non" and self.ahead() == "-" and self.ahead(2) == "sealed"):
                self.i += 3 if t == "non" else 1
            else:
                return

    def is_type_declaration(self) -> bool:
        t = self.texts[self.i]
        return self.kind() == "id" and (t in ("class", "interface", "enum") or t == "record" and self.kind(1) == "id" and self.ahead(2) in ("(", "<")) or t == "@" and self.ahead() == "interface"

    def type_declaration(self) -> None:
        if not self.is_type_declaration():
            self.fail()
        self.take("@")
        word = self.next()
        self.name()
        self.type_params()
        if word == "record":
            self.params()
        for clause in ("extends", "implements", "permits"):
            if self.take(clause):
                self.type_()
                while self.take(","):
                    self.type_()
        self.need("{")
        if word == "enum":
            while not self.at(";", "}"):
                self.annotations()
                self.name()
                if self.take("("):
                    self.listed(self.expression, ")", trailing=False)
                if self.at("{"):
                    self.body()
                if not self.take(","):
                    break
            if not self.take(";"):
                self.need("}")
                return
        self.members()

    def body(self) -> None:
        self.need("{")
        self.members()

    def members(self) -> None:
        while not self.take("}"):
            if not self.take(";"):
                self.member()

    def member(self) -> None:
        if self.at("static") and self.ahead() == "{":
            self.i += 1
        if self.at("{"):
            return self.block()
        self.modifiers()
        if self.is_type_declaration():
            return self.type_declaration()
        self.type_params()
        self.annotations()
        if self.kind() == "id" and self.ahead() in ("(", "{") and self.texts[self.i] not in RESERVED:
            self.name()
            if self.at("{"):
                return self.block()
            return self.method_rest()
        if not self.take("void"):
            self.type_()
        self.name()
        if self.at("("):
            return self.method_rest()
        self.declarators()
        self.need(";")

    def method_rest(self) -> None:
        self.params()
        self.dims()
        if self.take("throws"):
            self.type_()
            while self.take(","):
                self.type_()
        if self.take("default"):
            self.annotation_value()
        if self.at("{"):
            self.block()
        else:
            self.need(";")

    def params(self) -> None:
        self.need("(")
        self.listed(self.param, ")", trailing=False)

    def param(self) -> None:
        self.modifiers()
        self.type_()
        self.annotations()
        self.take("...")
        if self.take("this"):
            return
        self.name()
        self.dims()

    def dims(self) -> None:
        while self.at("[") and self.ahead() == "]":
            self.i += 2

    def declarators(self) -> None:
        """What follows the first name of a variable declaration."""
        while True:
            self.dims()
            if self.take("="):
                self.initialiser()
            if not self.take(","):
                return
            self.name()

    def initialiser(self) -> None:
        if self.take("{"):
            self.listed(self.initialiser, "}")
        else:
            self.expression()

    def type_params(self) -> None:
        if self.take("<"):
            while True:
                self.annotations()
                self.name()
                if self.take("extends"):
                    self.type_()
                    while self.take("&"):
                        self.type_()
                if not self.take(","):
                    break
            self.need_angle()

    def type_(self, dims: bool = True) -> None:
        self.annotations()
        if self.kind() == "id" and self.texts[self.i] in PRIMITIVE:
            self.i += 1
        else:
            self.name()
            self.type_args()
            while self.at(".") and self.kind(1) == "id" and self.ahead() not in RESERVED:
                self.i += 1
                self.name()
                self.type_args()
        if dims:
            self.annotations()
            self.dims()

    def type_args(self) -> None:
        if self.at("<"):
            self.i += 1
            if self.at_angle():
                return self.need_angle()
            while True:
                self.annotations()
                if self.take("?"):
                    if self.take("extends", "super"):
                        self.type_()
                else:
                    self.type_()
                if not self.take(","):
                    break
            self.need_angle()

    # Statements

    def block(self) -> None:
        self.need("{")
        while not self.take("}"):
            self.statement()

    def local(self) -> None:
        """The head of a local variable declaration: modifiers, type, name, and what shows that it is one."""
        self.modifiers()
        self.type_()
        self.name()
        if not self.at("=", ";", ",", ":", "["):
            self.fail()

    def statement(self) -> None:
        k, t = self.kinds[self.i], self.texts[self.i]
        if k == "op":
            if t == "{":
                return self.block()
            if self.take(";"):
                return None
        if k == "id" and t in _STATEMENTS:
            rule = getattr(self, "s_" + t)
            if not (t == "yield" and self.ahead() in ("=", ".", "(", "++", "--")):
                return rule()
        if self.is_type_declaration() or t in ("final", "abstract", "static", "@") and k in ("id", "op"):
            start = self.i
            self.modifiers()
            if self.is_type_declaration():
                return self.type_declaration()
            self.i = start
        if k == "id" and self.ahead() == ":" and t not in RESERVED:
            self.i += 2
            return self.statement()
        if (k == "id" and (t in PRIMITIVE or t not in RESERVED or t == "final") or t == "@") and self.attempt(self.local):
            self.declarators()
            return self.need(";")
        self.expression_statement()
        self.need(";")

    def expression_statement(self) -> None:
        if not self.expression():
            self.fail()

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

    def s_do(self) -> None:
        self.i += 1
        self.statement()
        self.need("while")
        self.condition()
        self.need(";")

    def s_for(self) -> None:
        self.i += 1
        self.need("(")
        if not self.take(";"):
            if self.attempt(self.local):
                if self.take(":"):
                    self.expression()
                    self.need(")")
                    return self.statement()
                self.declarators()
            else:
                self.expression_list()
            self.need(";")
        if not self.at(";"):
            self.expression()
        self.need(";")
        if not self.at(")"):
            self.expression_list()
        self.need(")")
        self.statement()

    def expression_list(self) -> None:
        self.expression_statement()
        while self.take(","):
            self.expression_statement()

    def s_try(self) -> None:
        self.i += 1
        resources = self.take("(")
        if resources:
            while not self.take(")"):
                if self.attempt(self.local):
                    self.declarators()
                else:
                    self.expression()
                if not self.take(";") and not self.at(")"):
                    self.fail()
        self.block()
        handled = resources
        while self.take("catch"):
            self.need("(")
            self.modifiers()
            self.type_()
            while self.take("|"):
                self.type_()
            self.name()
            self.need(")")
            self.block()
            handled = True
        if self.take("finally"):
            self.block()
        elif not handled:
            self.fail()

    def s_switch(self) -> None:
        self.i += 1
        self.condition()
        self.need("{")
        while not self.take("}"):
            if self.take("case"):
                while True:
                    self.case_label()
                    if not self.take(","):
                        break
                if self.kind() == "id" and self.take("when"):
                    self.expression()
            else:
                self.need("default")
            if self.take("->"):
                if self.at("{", "throw"):
                    self.statement()
                else:
                    self.expression()
                    self.need(";")
            else:
                self.need(":")
                while not self.at("case", "default", "}"):
                    self.statement()

    def case_label(self) -> None:
        if self.take("default"):
            return
        if not self.attempt(self.pattern_label):
            self.ternary()

    def pattern_label(self) -> None:
        self.pattern()
        if not self.at("->", ":", ",", "when"):
            self.fail()

    def pattern(self) -> None:
        self.modifiers()
        self.type_()
        if self.take("("):
            self.listed(self.pattern, ")", trailing=False)
            if self.kind() == "id" and not self.at("when"):
                self.name()
        else:
            self.name()

    def s_return(self) -> None:
        self.i += 1
        if not self.at(";"):
            self.expression()
        self.need(";")

    def s_throw(self) -> None:
        self.i += 1
        self.expression()
        self.need(";")

    s_yield = s_throw

    def s_break(self) -> None:
        self.i += 1
        if not self.at(";"):
            self.name()
        self.need(";")

    s_continue = s_break

    def s_assert(self) -> None:
        self.i += 1
        self.expression()
        if self.take(":"):
            self.expression()
        self.need(";")

    def s_synchronized(self) -> None:
        self.i += 1
        self.condition()
        self.block()

    # Expressions: the rules give True where the expression may stand as a statement.

    def lambda_(self) -> None:
        if self.take("("):
            self.listed(self.lambda_param, ")", trailing=False)
        else:
            self.name()
        self.need("->")

    def lambda_param(self) -> None:
        if self.kind() == "id" and self.ahead() in (",", ")"):
            return self.name()
        self.param()

    def expression(self) -> bool:
        if (self.at("(") or self.kind() == "id" and self.ahead() == "->") and self.attempt(self.lambda_):
            if self.at("{"):
                self.block()
            else:
                self.expression()
            return False
        effect = self.ternary()
        if self.kind() == "op":
            t = self.texts[self.i]
            if t == ">" and self.ahead() == ">=":
                t = ">>="
                self.i += 1
            if t in ASSIGN:
                if not self.place:
                    self.fail()
                self.i += 1
                self.expression()
                return True
        return effect

    def ternary(self) -> bool:
        effect = self.unary()
        while True:
            t, k = self.texts[self.i], self.kinds[self.i]
            if k == "id" and t == "instanceof":
                self.i += 1
                if not self.attempt(self.pattern):
                    self.modifiers()
                    self.type_()
            elif k == "op" and t in BINARY:
                if t == ">" and self.ahead() == ">=" and not self.breaks[self.i + 1]:
                    return effect
                self.i += 1
                while t == ">" and self.at(">"):
                    self.i += 1
                self.unary()
            else:
                break
            effect = self.place = False
        if self.take("?"):
            self.expression()
            self.need(":")
            if not ((self.at("(") or self.ahead() == "->") and self.attempt(self.lambda_)):
                self.ternary()
            elif self.at("{"):
                self.block()
            else:
                self.expression()
            effect = self.place = False
        return effect

    place = False

    def unary(self) -> bool:
        if self.at("++", "--"):
            self.i += 1
            self.unary()
            self.place = False
            return True
        if self.at("+", "-", "!", "~"):
            self.i += 1
            self.unary()
            self.place = False
            return False
        if self.at("(") and self.attempt(self.cast):
            self.place = False
            return False
        return self.postfix()

    def cast(self) -> None:
        self.need("(")
        primitive = self.texts[self.i] in PRIMITIVE
        self.type_()
        array = self.texts[self.i - 1] == "]"
        while self.take("&"):
            self.type_()
        self.need(")")
        if primitive and not array:
            self.unary()
        elif self.kind() in ("num", "str") or self.at("(", "!", "~") or self.kind() == "id" and self.texts[self.i] != "instanceof":
            if not ((self.at("(") or self.ahead() == "->") and self.attempt(self.cast_lambda)):
                self.unary()
        else:
            self.fail()

    def cast_lambda(self) -> None:
        self.lambda_()
        if self.at("{"):
            self.block()
        else:
            self.expression()

    def postfix(self) -> bool:
        effect = self.primary()
        while True:
            if self.kinds[self.i] != "op":
                return effect
            if self.take("."):
                self.type_args()
                if self.at("new"):
                    effect = self.primary()
                elif self.take("class", "this", "super"):
                    effect = self.place = False
                else:
                    self.name()
                    effect, self.place = False, True
            elif self.at("("):
                self.i += 1
                self.listed(self.expression, ")", trailing=False)
                effect, self.place = True, False
            elif self.at("["):
                self.i += 1
                if self.take("]"):
                    self.dims()
                    if not self.take("::"):
                        self.need(".")
                        self.need("class")
                    else:
                        self.need("new")
                    effect = self.place = False
                    continue
                self.expression()
                self.need("]")
                effect, self.place = False, True
            elif self.take("::"):
                self.type_args()
                if not self.take("new"):
                    self.name()
                effect = self.place = False
            elif self.at("++", "--"):
                if not self.place:
                    self.fail()
                self.i += 1
                effect, self.place = True, False
            elif self.at("<") and self.attempt(self.generic_reference):
                effect = self.place = False
            else:
                return effect

    def generic_reference(self) -> None:
        self.type_args()
        self.dims()
        self.need("::")
        if not self.take("new"):
            self.name()

    def primary(self) -> bool:
        k, t = self.kinds[self.i], self.texts[self.i]
        self.place = False
        if k in ("num", "str"):
            self.i += 1
            return False
        if t == "(" and k == "op":
            self.i += 1
            self.expression()
            self.need(")")
            return False
        if k != "id":
            self.fail()
        if t in ("this", "super", "true", "false", "null"):
            self.i += 1
            return False
        if t == "switch":
            self.s_switch()
            return True
        if t == "new":
            return self.creation()
        if t in PRIMITIVE or t == "void":
            self.i += 1
            self.dims()
            if not self.take("::"):
                self.need(".")
                self.need("class")
            else:
                self.need("new")
            return False
        self.name()
        self.place = True
        return False

    def creation(self) -> bool:
        self.need("new")
        self.annotations()
        self.type_args()
        self.type_(False)
        if self.at("["):
            sized = False
            while self.take("["):
                if not self.take("]"):
                    self.expression()
                    self.need("]")
                    sized = True
            if self.at("{"):
                if sized:
                    self.fail()
                self.initialiser()
            elif not sized:
                self.fail()
            return False
        self.need("(")
        self.listed(self.expression, ")", trailing=False)
        if self.at("{"):
            self.body()
        return True


_STATEMENTS = frozenset("if while do for try switch return throw yield break continue assert synchronized".split())


def java(text: str) -> None:
    Java(text).unit()
