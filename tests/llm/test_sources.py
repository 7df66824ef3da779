"""Source files: syntax, and what nobody wrote by hand."""

import ast

import pytest

from tallyweave.llm import handwritten as H
from tallyweave.llm import parsing, syntax

VALID = {
    "Python": [
        "", "x = 1\n", "match = 3\nmatch x:\n    case [1, *r] if r: pass\n    case {'a': A(b=1)} | None as q: pass\n", "async def f(a, /, b: int = 1, *, c=2, **k) -> list[int]:\n\tasync with a as b, c: await d\n\tyield from (x async for x in y if x)\n",
        "f'{a!r:>{w}} {\"x\"}' rf\"{x['a']}\"\n", "@d(1)\nclass A[T: int](B, m=C):\n    x: int = 1; y = lambda *a, b=2: (yield)\n", "try:\n  pass\nexcept* (A, B) as e:\n  raise X from None\nelse: pass\nfinally: pass\n", "print(*a, (d := 2), c=1, **b) if a else b\n",
        "x[1:2, ::3, *a] = [*b, *c]\ndel x, y\nwith (open(a) as f, g): pass\n", "type X[T] = list[T]\nif x:\n    # only\n    pass\n  # odd comment\n\n", "a = b if c else d or not e is not f not in g\n", "def f(): return\nlambda: 0\n",
    ],
    "Json": ["{}", "[1, -2.5e+3, \"\\u00e9\", null]", " true\n", "{\"a\": {\"b\": []}}"],
    "C": [
        "", "#include <a.h>\n#define X(a) \\\n  (a)\nint main(void) { return 0; }\n", "typedef struct s { int a : 3; union { char *b[2]; }; } s_t;\nstatic const s_t x[] = { [0] = { .a = 1 }, };\n", "#if A\nint f() {\n#else\nint g() {\n#endif\n  for (int i = 0, j; i < 3; i++) if (a) b(); else { c: goto c; }\n  return (int) x ? -y : sizeof(struct s) * (a)(b);\n}\n",
        "void (*f(int, char *[]))(void);\nenum e { A = 1, B, };\nint x = 0x1Fu + 'a' + L'\\n', *y = &x;\n", "int f(a_t b) { a_t *c = (a_t *) d; switch (c->x) { case 1: case 2 ... 4: { } default: break; } do { } while (0); return *c++; }\n", "char *s = \"a\" PRIu64 \"b\"; /* x */ // y\n",
    ],
    "Java": [
        "", "package a.b;\nimport static a.B.*;\n@A(x = {1, 2}) public final class C<T extends D & E<?>> extends F implements G, H { int[] a = new int[]{1}, b[]; { } static { } C() throws X { this(1); } <U> U f(final T... t) { return (U) t[0]; } }\n",
        "enum E { A(1) { void f() { } }, B; E(int... x) { } }\ninterface I { default int f() { return 1; } int g(); }\nrecord R(int a, @N String b) { R { } }\n@interface A { int x() default 1; }\n",
        "class A { void f() { for (var x : y) { } for (int i = 0, j = 1; i < 3; i++, j--) continue; try (var a = b(); c) { } catch (A | B e) { } finally { } label: while (a instanceof B b && b.x > 1) break label; } }\n",
        "class A { Object o = (a, b) -> { }; X y = A::new; Z z = (int a) -> a >>> 2; int s = switch (x) { case 1, 2 -> 3; case P(var q) when q > 1 -> { yield 4; } default -> throw new E(); }; String t = \"\"\"\n  a \"b\"\n  \"\"\"; }\n", "class A { java.util.List<String>[] f(int[] a) { return a.length < b ? (List<String>[]) c : new B<>() { int d; }.e; } }\n",
    ],
    "Go": [
        "package a\n", "package a\n\nimport (\n\t\"fmt\"\n\tx \"y\"\n)\n\ntype T[K comparable, V int | ~string] struct {\n\ta, b int `json:\"a\"`\n\t*E\n\tm map[K][]V\n}\n\nfunc (t *T[K, V]) f(a, b int, c ...string) (x int, err error) {\n\tif v, ok := t.m[k]; ok && v != nil {\n\t\treturn\n\t} else if x {\n\t}\n\tfor i := range 10 {\n\t}\n\tfor {\n\t\tbreak\n\t}\n\treturn\n}\n",
        "package a\nfunc f() {\n\tswitch x := y.(type) {\n\tcase int, []string:\n\t\tfallthrough\n\tdefault:\n\t}\n\tselect {\n\tcase v := <-c:\n\tcase c <- 1:\n\t}\n\tgo func() { defer g() }()\n\tx := []T{{a: 1}, {}}\n\tvar y = map[string]func(int) error{\"a\": nil}\nL:\n\tfor i := 0; i < 3; i++ {\n\t\tcontinue L\n\t}\n\ta, b = b, a[1:2:3]\n\tz := 'x' + `raw\n` + 0x1p-2\n}\n",
        "package a\nconst (\n\tA = iota\n\tB\n)\nvar _ I = (*T)(nil)\ntype I interface {\n\tf(int) error\n\tJ\n}\nfunc g[T any](x T) T { return h[T](x) }\n",
    ],
    "Rust": [
        "", "#![allow(x)]\nuse a::{b::*, c as d, self};\npub(crate) mod m;\n#[derive(A)]\npub struct S<'a, T: 'a + B<C = D>, const N: usize>(pub &'a [T; N], ()) where T: Fn(i32) -> u8;\n", "fn f<T>(mut self: Box<Self>, (a, b): (u8, &mut [u8])) -> impl Fn() -> Result<(), Box<dyn E + 'static>> where T: X { let x: Vec<Vec<u8>> = vec![1; 2]; let Some(y) = z else { return Err(w)?; }; move || { x.len() as u64 >= 3 } }\n",
        "impl<T> A for B<T> { type C = D; const E: u8 = 1; async unsafe fn g(&self) { match x { 1..=2 | 3 if a => b, Some(ref c @ d) => { e } S { f, g: _, .. } => (), [h, .., i] => i.0.1, _ => unreachable!(\"{}\", x), } } }\n",
        "fn main() { for i in 0..10 { if let Some(x) = y && z { continue 'a; } else { } } 'a: loop { break 'a 1; } let c = |a: i32, &b| -> i32 { a + b }; x.y::<Z>().await?; let r = r#\"a\"b\"#; let b = b'\\n'; S { a, ..d }; -x.y(); &*z; a = b << 2 >> 1; }\n",
        "macro_rules! m { ($a:expr) => { $a + 1 }; }\nextern \"C\" { fn p(x: *const u8, ...); }\nstatic mut X: Option<fn(u8) -> u8> = None;\nunion U { a: u8 }\ntrait T: A + ?Sized { fn f(&self) -> u8 { 1 } }\n/* a /* b */ c */\n",
    ],
    "JavaScript": [
        "", "\"use strict\";\nimport a, { b as c, default as d } from \"x\"\nexport default class extends B { #p = 1; static { } get x() { return this.#p } static async *y() { yield* z } 'q'() {} }\n", "var a = b\n(function () { })()\nconst { x, y: [z = 1, ...w], ...r } = await f?.(`a${b}c${`d${e}`}`)\n",
        "for (const [k, v] of m) if (/[/\\]]+/g.test(k)) continue; else break\nl: do x++; while (x < 3)\nswitch (a) { case 1: { b } default: c() }\ntry { throw a } catch { } finally { }\n", "x = async (a, { b }) => ({ c: a ?? b, [d]: 1, get e() { return 1 }, async *f() { }, if: 2, ...g })\ny = a ? b : c => d, e => { }\n", "if (a) return\nb\n++c\nnew A\nnew (B())(1)\na = b / c / d; var r = a\n/b/g\n".replace("if (a) return\n", ""),
        "!function (e, t) { \"object\" == typeof exports ? module.exports = t() : e.x = t() }(this, function () { return 1 });a = (b, c) => b < c ? -1 : b > c ? 1 : 0;\n", "export * as n from 'm'; export { a as b }; label: for (;;) { }\nlet async; async = of + get;\nclass A { static async = 1; get; set = 2; delete() { } }\n",
    ],
    "TypeScript": [
        "", "import type { A } from './a';\nexport abstract class B<T extends object = {}> extends C<T> implements D, E { private readonly x?: Map<string, T>[] = new Map<string, T>(); constructor(public a: number, b?: string) { super() } abstract f(): void; get y(): T | undefined { return this.x!.get(1)! as T } static z<K extends keyof T>(this: B<K>, ...r: K[]): asserts r is K[] { } [k: string]: any }\n",
        "type A = { kind: 'a' } | { readonly kind: \"b\"; c?: (x: number) => string, [k: string]: unknown };\ntype F<T> = T extends (infer U)[] ? U : { [K in keyof T]?: T[K] };\nenum E { A = 1, B }\ndeclare module 'x' { export const y: number; }\nnamespace N.M { }\n",
        "const f = <T,>(x: T): x is T => true;\nfunction g(a: string): string;\nfunction g(a: any) { return <any>a; }\nlet t: [a: number, b?: string] = h<number>(1) satisfies X;\nfor (const x of y as Z[]) { }\nlet u = `a${b}` as const; @dec class K { @p() x = 1 }\nexport interface I extends J<K>, L { (a: number): string; new (): I; m?(): void }\n",
    ],
}
INVALID = {
    "Python": ["def f()\n    pass\n", "if x:\npass\n", "x = (1,\n", "<<<<<<< HEAD\nx = 1\n=======\n", "def f():\n\tx\n        y\n", "x = 'a\n", "print 1\n", "int main() { }\n", "  x = 1\ny = 2\n", "f'{a'\n", "x = 1_\n"],
    "Json": ["", "{'a': 1}", "[1,]", "{\"a\" 1}", "01", "NaN", "[1] x", "\"a\nb\"", "// c\n{}", "﻿".strip("﻿") + "{a: 1}", "[1"],
    "C": ["int f( { }", "int f() { return 1 }", "int f() { char *s = \"a; }\n", "diff --git a b\n", "int f() { }\n}", "#if A\nint x;\n", "x y z;", "def f(): pass", "/* open", "int a[3 = 1;"],
    "Java": ["class A {", "class A { int f() { return 1 } }", "class A { } }", "import a.b\nclass A { }", "#include <x>\n", "class A { void f() { if (a { } } }", "class A { String s = \"a; }", "class A { int x = ; }"],
    "Go": ["", "package a\nfunc f() {\n", "package a\nx := 1\n", "package a\nfunc f() { return 1 2 }\n", "func f() { }\n", "package a\nfunc f() {\n}\n)\n", "package a\nvar x = \"a\n", "package a\nimport fmt\n"][1:],
    "Rust": ["fn f( { }", "fn f() { let x = 1 let y = 2; }", "fn f() { } }", "struct S { a: u8 b: u8 }", "fn f() { \"a }", "package a;\n", "fn f() { x[1; }", "let x = 1;", "use a::b"],
    "JavaScript": ["function f( { }", "x = {", "const a = 1 const b = 2", "interface A { x: number }", "let s = \"a;\nb\";", "if (a { }", "`a${b", "def f():\n  pass", "<html></html>", "});"],
    "TypeScript": ["interface A { x: }", "let x: = 1", "class A { f( { } }", "type A = | ;", "#include <a>\n", "const x: number = ;", "enum E { A B }", "}"],
}


@pytest.mark.parametrize("language", VALID)
def test_valid_files(language):
    for text in VALID[language]:
        assert syntax.error_line(text, language) is None, text
        assert syntax.error_line(text.replace("\n", "\r\n"), language) is None, text


@pytest.mark.parametrize("language", INVALID)
def test_invalid_files(language):
    for text in INVALID[language]:
        assert syntax.error_line(text, language) is not None, text


_F = "int f(void)\n{\n%s\n  return 0;\n}\n"


@pytest.mark.parametrize(
    ("text", "line"),
    [
        (_F % "#ifdef _WIN32\n  a();\n#else\n  b(;\n#endif", 6), (_F % "#if A\n  a();\n#elif B\n  b();\n#else\n  char *s = \"x;\n#endif", 8), (_F % "#if 0\n  a();\n#else\n<<<<<<< HEAD\n#endif", 6), (_F % "#ifdef A\n  a();\n#else\n# ifdef B\n  b();\n# else\n  {\n# endif\n#endif", 14),
        (_F % "#if 0\n  don't parse (this\n#endif", None), (_F % "#if 0\n a b c\n#else\n  b();\n#endif", None), (_F % "#if 1\n  b();\n#else\n a b (\n#endif", None), (_F % "#if 0 /* #else */\n /*\n#else\n a b ( */\n#endif", None),
        (_F % "#ifdef A\n  if (a) {\n#else\n#endif\n  b();\n#ifndef A\n#else\n  }\n#endif", None), (_F % "#if defined(A)\n  {\n#else\n  b();\n#endif\n#ifdef A\n  }\n#endif", None), ("#ifndef H\n#define H\nint x;\n#else\nint y;\n#endif\n", None),
    ],
)
def test_every_branch_of_a_c_file(text, line):
    assert syntax.error_line(text, "C") == line


def test_own_python_grammar_agrees_with_the_language():
    for text in (*VALID["Python"], *INVALID["Python"]):
        try:
            ast.parse(text)
            good = True
        except SyntaxError:
            good = False
        assert (syntax.error_line(text, "Python") is None) == good, text


def test_ambiguous_grammars_are_followed_side_by_side():
    t = parsing.Tables(parsing.Grammar("file = e ;\n e = e '+' e | X | X? Y ;", "file"))
    assert parsing.first_error(t, ["X", "+", "X", "Y", "+", "Y"]) is None
    assert parsing.first_error(t, ["X", "+", "+"]) == 2
    assert parsing.first_error(t, ["X", "+"]) == 2


def test_first_error_line_and_depth():
    assert syntax.error_line("[\n1,\n2\n3]", "Json") == 4
    assert syntax.error_line("[" * 20_000 + "]" * 20_000, "Json") is None


def test_check_table(spark):
    rows = [(1, "Go", "package a\n", "x.go"), (2, None, "x = (", "x.py"), (3, "Json", "", "x"), (4, "C", None, "x"), (5, "Cobol", "?", "x"), (6, "Rust", "", "x"), (6, "Rust", "}", "x"), (7, "Python", "x = 1\n" * 30_000, None), (8, None, "x", None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "file_id bigint, language string, content string, path string, _valid string")
    got = sorted((r.file_id, r._valid) for r in syntax.check_files(df, ["file_id"]).collect() if r._valid is not None)
    assert got == [(1, True), (2, False), (3, False), (6, False), (6, True), (7, True)]
    rates = {r.language: r.share for r in syntax.invalid_rates(syntax.check_files(df, ["path"]), ["path"]).collect() if r.path == "x"}
    assert rates == {"Json": 1.0, "Rust": 0.5}
    assert syntax.check_files(df.limit(0), ["file_id"]).count() == 0


HAND = """
def parse_table(source, limit=3):
    total_count = 0
    for item in source:
        if item is None or item > limit:
            continue
        total_count += item * 2
    return total_count


class MergeStack:
    def __init__(self, first_name):
        self.first_name = first_name.strip()

    def fold_queue(self, other_side):
        with open(other_side) as handle:
            return sorted(handle, key=lambda row: (len(row), row))[::-1]


def trim_frame(left_part, right_part):
    while left_part and not right_part:
        left_part, right_part = walk_cell(right_part), seek_node(left_part)
    raise ValueError(f"no {left_part!r}")
"""
MINIFIED = "".join(f"function {a}({b}){{if(!{b})throw new Error('x');return {b}({i})}}var {b}=[],{a}1={{}};" for i, (a, b) in enumerate(["ab", "qz", "xk", "vj", "wq", "zx"]))


@pytest.mark.parametrize(
    ("text", "path", "repository", "reason"),
    [
        ("\n".join(f"void set_{n}(int *m, int v) {{ m[{i}] = v; }}" for i, n in enumerate("abcdefghijkl")), "a.c", "r", "generated"),
        ("// Code generated by tool. DO NOT EDIT.\n" + HAND, "a.py", "r", "generated"),
        ("# Unlike the generated files next door, this one is written by hand.\n" + HAND, "a.py", "r", None),
        ("x = [\n" + "    1, 22, 333, 4444, 55555,\n" * 40 + "]\n", "a.py", "r", "data"),
        ("x = [\n" + "    1, 22, 333,\n" * 4 + "]\n" + HAND, "a.py", "r", None),
        (MINIFIED, "a.js", "r", "mangled?"),
        (HAND, "vendor/lib/lib.py", "r", "copied"), (HAND, "vendor/lib/lib.py", "lib", None), (HAND, "src/vendor_list/a.py", "r", None), (HAND, "app/external/node_client.py", "r", None),
        ("# quicklib v1.2.3\n" + HAND, "a.py", "r", "copied"), ("# quicklib v1.2.3\n" + HAND, "a.py", "my-quicklib", None), (HAND, "a.py", "r", None), ("", "a.py", None, None),
    ],
)
def test_reasons(text, path, repository, reason):
    assert (H._judge("Python", text, path, repository, None)[0] if text else None) == reason


def test_copies_and_homes(spark):
    lib = HAND.replace("table", "atlas")
    rows = [(1, "orbit-orbit", "src/orbit.py", lib), (2, "orbit-orbit", "src/orbit.py", lib + "\nx = 1\n"), (3, "other", "a/b.py", lib), (4, "third", "c.py", lib.replace("\n", "\r\n")), (5, "other", "d.py", HAND.replace("_", "_own_")), (6, None, "e.py", None), (7, None, "", ""), (8, "third", "big.py", HAND * 300), (3, "other", "a/b.py", lib)]
    df = spark.createDataFrame([(i, r, p, "Python", c, "clash") for i, r, p, c in rows], "file_id bigint, repository string, path string, language string, content string, reason string")
    got = sorted((r.file_id, r.reason) for r in H.judged_files(df).collect() if r.reason)
    assert [x for x in got if x[0] < 8] == [(3, "copied"), (3, "copied"), (4, "copied")]
    assert H.judged_files(df).count() == 9
    assert H.judged_files(df.limit(0)).count() == 0


def test_doubled_rows_and_hot_triples_change_nothing(spark, monkeypatch):
    """A file of which a part is another project's: given once, twice, and with its triples in several parts."""
    lib = HAND.replace("table", "atlas")
    own = HAND.replace("_", "_own_") + HAND.replace("_", "_mine_")
    rows = [(1, "lib-lib", "lib.py", lib), (2, "other", "a.py", own + lib), (3, "other", "b.py", "x_value = 1\n" + lib)]
    schema = "file_id bigint, repository string, path string, language string, content string"
    once = spark.createDataFrame([(i, r, p, "Python", c) for i, r, p, c in rows], schema)
    want = {1: None, 2: None, 3: "copied"}
    assert {r.file_id: r.reason for r in H.judged_files(once).collect()} == want
    twice = once.unionAll(once)
    assert sorted((r.file_id, r.reason or "") for r in H.judged_files(twice).collect()) == sorted((i, w or "") for i, w in want.items() for _ in range(2))
    monkeypatch.setattr(H, "HOT_FILES", 1)
    assert {r.file_id: r.reason for r in H.judged_files(twice).collect()} == want


def test_a_copier_is_no_home_because_it_sorts_last(spark):
    """One copy names its project, whose own repository isn't there: then no holder is at home."""
    lib, own = HAND.replace("table", "atlas"), HAND.replace("_", "_own_")
    rows = [(1, "a-a", "external/argsplit-src/index.py", "# argsplit: splits (version 3.9.7)\n" + lib), (2, "z-z", "core/count.py", lib), (3, "y-y", "core/other.py", own), (4, "argsplit-kit", "x.py", lib)]
    schema = "file_id bigint, repository string, path string, language string, content string"
    df = spark.createDataFrame([(i, r, p, "Python", c) for i, r, p, c in rows], schema)
    assert sorted((r.file_id, r.reason) for r in H.judged_files(df.filter("file_id < 4")).collect() if r.reason) == [(1, "copied"), (2, "copied")]
    assert sorted(r.file_id for r in H.judged_files(df).collect() if r.reason) == [1, 2]


def test_mangled_names_stand_out(spark):
    rows = [(i, "r", f"f{i}.js", HAND.replace("def", f"f{i}")) for i in range(30)] + [(99, "r", "m.js", MINIFIED * 3)]
    df = spark.createDataFrame([(i, r, p, "JavaScript", c) for i, r, p, c in rows], "file_id bigint, repository string, path string, language string, content string")
    found = {r.file_id: r.reason for r in H.judged_files(df).collect()}
    assert found[99] == "mangled" and found[3] is None


def test_pieces_that_are_looked_up_change_nothing(monkeypatch):
    """Every text three times, with as much memory as there is and with next to none."""
    everything = [(t, name) for name in VALID for t in (*VALID[name], *INVALID[name])]
    tables = syntax.build_tables()
    first = [syntax.error_line(t, name, tables) for t, name in everything]
    assert [syntax.error_line(t, name, tables) for t, name in everything] == first
    monkeypatch.setattr(parsing, "MOST_KNOWN", 3)
    assert [syntax.error_line(t, name, tables) for t, name in everything] == first
    monkeypatch.setattr(parsing, "PIECE_ENDS", frozenset())
    monkeypatch.setattr(parsing, "PIECE", 1)
    assert [syntax.error_line(t, name, syntax.build_tables()) for t, name in everything] == first


def test_braces_after_backslashes_in_formatted_strings():
    for text in ('x = rf"\\.\\{y}"\n', 'x = f"\\{y}"\n', 'x = f"\\N{EM DASH}"\n', 'x = rf"\\"\n'.replace('\\"', '\\""')):
        try:
            ast.parse(text)
            good = True
        except SyntaxError:
            good = False
        assert (syntax.error_line(text, "Python") is None) == good, text
