import ast
import random

import pytest

from claimweave.llm import grammars as G
from claimweave.llm import syntax

GOOD = {
    "JavaScript": [
        "", "import a, {b as c} from './x';\nexport default class A extends B { #p = 1; static { x(); } get y() { return this.#p } async *z() {} }",
        "!function(e,t){if(e.x>97)for(var g=0;g<9;g++)t.l(g);e.p=function(s,d){return s?d(s):void 0};t.g={v:!0,n:!1}}(this,{});",
        "const f = async ({a, b = 2, ...c}, [d,,e] = []) => { for await (const x of y) label: while (1) { continue label } };", "a = b\n++c\nlet r = /[/\\]]+/g.test(`x${a + `n${1}`}y`) ? 1 : {}", "x?.y?.[0]?.(1) ?? z ** 2; do x(); while (0) y()",
        "if (a) b; else c\nswitch (x) { case 1: default: y() }", "/*\n<<<<<<< HEAD\nleft\n>>>>>>> b\n*/", "var yield_ = function* () { yield* g(); }; new X.Y(...z).w = 1", "return1 = 0; a = (1, 2); ({a, b} = c)",
    ],
    "TypeScript": [
        "export interface A<T extends B = C> extends D, E<F> { readonly a?: string; [k: string]: any; m<U>(x: U): x is V; new (y: number): A<T> }", "export function f(a: Record<string, string>, b: string[] = []): any { return a as unknown as B[] }",
        "type M<T> = { readonly [K in keyof T]?: T[K] extends infer U ? U : never } | [a: string, ...b: number[]];", "enum E { A = 1, B }\ndeclare module 'x' { export const y: (a: typeof z, ...b: any[]) => void }",
        "abstract class A<T> implements B { constructor(private readonly x: number, public y?: string) { super() } abstract m(): Promise<Array<T>>; z!: string }", "const x = f<string>(y)!.z satisfies Q; let g = <T,>(a: T): a is T => a", "export async function h(regionIn, list = []) { return list; }",
    ],
    "Java": [
        "", "package a.b;\nimport java.util.*;\nimport static x.Y.z;\n/** d */\n@A(b = {1, 2}) public final class C<T extends D & E> extends F<G<H>> implements I { int[] a = {1, 2}, b[]; static { x(); } C(int... x) throws Y { super(x); } <U> U m(final Map<String, List<? extends U>> p) { return null; } }",
        "enum E implements X { A(1) { void f() {} }, B; int y; }\ninterface I { default int x() { return 1; } int y(); }\nrecord R(int a, String... b) { R { check(a); } }\n@interface Q { int v() default 3; }",
        'class A { void f() { for (String k : keys) total += in.getOrDefault(k, 33); var x = (Runnable & S) () -> {}; int y = (int) z >>> 2; Object o = new int[3][]; String s = """\n a "b"\n """; List<int[]> l = new ArrayList<>(); x = a < b ? c : d -> e; } }',
        "class A { int f(Object o) { return switch (o) { case String s when s.isEmpty() -> 1; case Integer i -> { yield 2; } default -> 3; }; } void g() { try (var r = x()) { } catch (A | B e) { } finally { } a.b[c++].d(Foo::bar, int[]::new); if (!(o instanceof P(int q, var w))) return; } }",
        "class B { static final int[] D = {\n 0x7c, 0x25,\n }; }",
    ],
    "Go": [
        "package a\n\nimport (\n\t\"fmt\"\n\tx \"y\"\n)\n\n// c\nfunc F(keys []string, limit int) (string, error) {\n\tfor i, k := range keys {\n\t\tkeys[i] = strings.TrimSpace(k)\n\t}\n\tif v, ok := m[k]; ok && v > 1 {\n\t\treturn \"\", fmt.Errorf(\"x %d\", limit)\n\t} else if x {\n\t}\n\treturn strings.Join(keys, \",\"), nil\n}\n",
        "package a\ntype S[T any, U ~int | string] struct {\n\tA, B int `json:\"a\"`\n\t*E\n\tf func(int, ...string) (n int, err error)\n\tm map[string][]chan<- int\n}\ntype I interface {\n\tM(x int) error\n\t~int | S[int, int]\n}\nfunc (x *S[T, U]) Reset() { *x = S[T, U]{} }\nfunc (*S[T, U]) P() {}\n",
        "package a\nvar (\n\tx = []T{{1, 2}, {A: 3}}\n\ty = map[string]int{\"a\": 1,}\n)\nconst (\n\tA = iota\n\tB\n)\nfunc f() {\n\tswitch x := y.(type) {\n\tcase int, *T:\n\t\tgo func() { <-c }()\n\tdefault:\n\t}\n\tselect {\n\tcase v, ok := <-c:\n\t\tc <- v\n\tcase d <- 1:\n\t}\nL:\n\tfor ; i < 3; i++ {\n\t\tcontinue L\n\t}\n\tdefer f(a...)\n\ta, b = b[1:], c[:2:3]\n\tfor x := range (T{1}) {\n\t}\n\tvar k = `raw\nx`\n}\n",
    ],
    "Python": ["", "def f(x, /, *, y: int = 1) -> str:\n    return f'{x!r:>{y}}'\n", "match x:\n    case [1, *_] if y: pass\n", "return 1\n"],
    "JSON": ['{"a": [1, -2.5e3, null, true, "\\u00e9"]}', "3"],
    "XML": ['<?xml version="1.0"?>\n<a b="c"><!-- x --><d/>t&amp;</a>'],
    "YAML": ["", "a: 1\nb: [x, {c: d}]\n---\n- |\n  <<<<<<< HEAD\n  x\n", "plain text\n", "a: &x 1\nb: *x\n"],
}
BAD = {
    "JavaScript": ["function f( {", "let x = ;", "a b", "export function f(a: string) {}", "interface A { b: string }", "}", "x = {a: 1", "'open", "try { }", "const a;", "<<<<<<< HEAD\nx\n=======\ny\n>>>>>>> z", "f() = 1", "<a>b</a>", "package a;", "for (x of) {}", "`open ${1"],
    "TypeScript": ["interface A { b: }", "function f(a: ) {}", "let x: string = ;", "def f(): pass", "type A = ;", "}", "class A { m( }"],
    "Java": ["class A { void f() { int x = 1 } }", "class A {", "int total", "class A { } }", "package a\nclass B {}", "class A { void f() { x + 1; } }", "def f(): pass", "class A { void f() { tota } }", "class A { String s = \"open; }", "<a/>"],
    "Go": ["", "func f() {}", "package a\nfunc f() {\n\tx :=\n}\n", "package a\nfunc f() {", "package a;\nimport java.util.List;\n", "package a\n}\n", "package a\nx := 1\n", "package a\nfunc f()\n{\n}\n", "package a\nvar s = \"open\n"],
    "Python": ["def f(:\n", "x = 'open\n", "if x:\npass\n", "<<<<<<< HEAD\n", "a b\n", "x\0"],
    "JSON": ["", "{'a': 1}", '{"a": 1,}', "[NaN]", '{"a": 1} x', "// c\n{}", '"\n"'],
    "XML": ["", "<a>", "<a></b>", "<a/><b/>", "x", "<a b=c/>"],
    "YAML": ["a: [1, 2", "a: 'open\n", "a: 1\n<<<<<<< HEAD\nb: 2\n", "a: b: c: d\n\t- x"],
}


@pytest.mark.parametrize("lang,text", [(k, t) for k, v in GOOD.items() for t in v])
def test_valid(lang, text):
    assert G.check(lang, text) is True


@pytest.mark.parametrize("lang,text", [(k, t) for k, v in BAD.items() for t in v])
def test_invalid(lang, text):
    assert G.check(lang, text) is False


@pytest.mark.parametrize("text", ["f(a < b, c >> d);", "foo(i < len, bits >> 1);", "f(a < b, c >>> d)", "let x: A<B<C<D>>>= y;", "const y = f<A<B>>(z) >> 1;"])
def test_shifts_after_a_failed_type_argument(text):
    assert G.check("TypeScript", text) is True


@pytest.mark.parametrize("lang,text", [("JavaScript", "return 1;"), ("Go", "package a\nfunc f() { x := y.(type) }\n"), ("Go", "package a\nfunc f() { if y.(type) { } }\n")])
def test_words_out_of_their_place(lang, text):
    assert G.check(lang, text) is False


@pytest.mark.parametrize("lang,text", [
    ("JavaScript", "x = {};", ), ("TypeScript", "let x: any = {};"), ("Java", "class A {{ int x = {}; }}"), ("Go", "package a\n\nvar x = {}\n"), ("JSON", "{}")])
def test_deep_nesting_is_linear(lang, text):
    import time

    for n in (8_000, 60_000):
        deep = ("[" * n + "]" * n) if lang == "JSON" else "(" * n + "1" + ")" * n
        begun = time.time()
        assert G.check(lang, text.replace("{}", deep).replace("{{", "{").replace("}}", "}")) is True
        assert n > 8_000 or time.time() - begun < 3


def test_other_languages_and_depth():
    assert G.check("Markdown", "x") is None and G.check(None, "x") is None
    assert G.check("JavaScript", "x = " + "[" * 30_000) is False
    assert G.check("Java", "class A { int[] x = {" + "1, " * 50_000 + "}; }") is True


def test_cutting_python_never_crashes_and_agrees():
    random.seed(2)
    text = GOOD["Python"][1] * 20
    for _ in range(60):
        cut = text[: random.randrange(len(text))]
        try:
            ast.parse(cut)
            ok = True
        except SyntaxError:
            ok = False
        assert G.check("Python", cut) is ok


@pytest.mark.parametrize("lang", ["JavaScript", "TypeScript", "Java", "Go"])
def test_random_cuts_never_crash(lang):
    random.seed(3)
    for text in GOOD[lang]:
        for _ in range(40):
            a, b = sorted(random.randrange(len(text) + 1) for _ in range(2))
            assert G.check(lang, text[:a] + text[b:]) in (True, False)


def test_frames(spark):
    rows = [(1, "r", "a.py", "Python", "x = ("), (1, "r", "a.py", "Python", "x = ("), (2, "r", "a.JSON", None, "{}"), (3, "r", "b.js", "JavaScript", "<a>b</a>"), (4, "r", "x.md", "Markdown", "("), (5, None, None, None, "("), (6, "r", "n.py", "Python", None), (7, "r", "c.go", "Go", "package a\n<<<<<<< HEAD\n")]
    f = spark.createDataFrame([(*r, "z") for r in rows], "file_id bigint, repo_id string, name string, language string, content string, invalid string")
    assert sorted(r[0] for r in syntax.invalid_files(f).collect()) == [1, 3, 7]
    assert {r.file_id: (r.cause, r.parses_as) for r in syntax.causes(f).collect()} == {1: ("corrupt", None), 3: ("foreign", "XML"), 7: ("conflict", None)}
    scans = spark.createDataFrame([(1, "r", 1, 1, 1), (2, "r", 3, 2, 2), (2, "r", 3, 2, 2)], "scan_id bigint, repo_id string, parse_failures int, scanned_at int, delivered_at int")
    out = {(r.repo_id, r.lang): (r.n_files, r.n_invalid, r.reported_failures) for r in syntax.rates(f, scans).collect()}
    assert out[("r", "Python")] == (1, 1, 3) and out[("r", "JSON")] == (1, 0, 3)
    assert syntax.invalid_files(f.limit(0)).count() == 0


def test_found_and_rates_run_the_foreign_grammars(spark):
    f = spark.createDataFrame([(1, "r", "Go", "a.go", "def f(:")], "file_id bigint, repo_id string, language string, name string, content string")
    scans = spark.createDataFrame([], "scan_id string, repo_id string, parse_failures int, scanned_at timestamp, delivered_at timestamp")
    for df in (syntax.invalid_files(f), syntax.rates(f, scans)):
        assert "parses_as" in df._jdf.queryExecution().toString()
