"""Problem 2: grammars against the parsers of Python's library on all given files, and rows of files laid out."""

import ast
import json
import tomllib
import warnings

import pytest
from conftest import SMALL, clashing

from auditloom.llm import invalid_files as I
from auditloom.llm.syntax.grammars import verdict
from auditloom.tables import table

CHUNK = "chunk_id bigint, repo string, file_path string, content string, start_line int, end_line int, chunk_type string, name string, docstring string, indexed_at timestamp"


def chunk_rows(spark, rows):
    names = [c.strip().split()[0] for c in CHUNK.split(", ")]
    return clashing(spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], CHUNK))


PYTHON = [
    ("x = 1\n", True), ("", True), ("def f(a, b=1, /, c=2, *args, d, e=3, **kw) -> int:\n    return a\n", True), ("def f(a=1, b):\n    pass\n", False), ("f(a=1, 2)\n", False), ("f(*a, b, **c)\n", True), ("f(x for x in y)\n", True), ("f(x for x in y, 1)\n", False),
    ("match x:\n    case {'a': [1, *r], **k} if r: pass\n    case A(b=1) | None: pass\n", True), ("match = 1\nprint(match)\n", True), ("type X[T] = list[T]\n", True), ("a, *b = c\n", True), ("1 = x\n", False), ("f() = 1\n", False), ("x += yield\n", True), ("if x:\npass\n", False), ("if x:\n\tpass\n        pass\n", False),
    ("with (open(a) as f, open(b) as g):\n    pass\n", True), ("try:\n    pass\n", False), ("try:\n    pass\nexcept* E as e:\n    pass\n", True), ("lambda x, *y, z=1: x\n", True), ("x = [i async for i in y if i if j]\n", True), ("print 'x'\n", False), ("s = 'abc\n", False), ("s = f'{a!r:>{w}} {d[\"k\"]}'\n", True), ("x = 01\n", False), ("x = (1,\n", False),
    ("async def f():\n    async with a as b, c: await d\n", True), ("@a.b(c)\nclass A(B, metaclass=C): x: int = 1\n", True), ("a = b = c\n", True), ("del a, b[0], c.d\n", True), ("x = a if b else c\n", True), ("(y := 1)\n", True), ("y := 1\n", False), ("\ufeffx = 1\n", True), ("x = 1\r\nif x:\r\n    y = 2\r\n", True), ("global x, y\n", True), ("from . import a as b, c\n", True), ("from .. import *\n", True),
    ("x = {**a, 'b': 1}\n", True), ("x = {*a, 1}\n", True), ("x = {1: 2 for k in v}\n", True), ("raise A from b\n", True), ("return\n", True), ("not x\n", True), ("x is not y not in z\n", True), ("x[1:2, ::3, ...]\n", True), ("<<<<<<< HEAD\n", False), ("x = 1 ;\n", True), ("for x, in y: pass\nelse: pass\n", True),
]


@pytest.mark.parametrize("text,ok", PYTHON)
def test_python(text, ok):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text.lstrip("\ufeff"))
            assert ok
        except SyntaxError:
            assert not ok
    assert verdict(text, "python")[0] == ok


SCRIPT = [
    ("const a = 1, b = { c, d: 2, [e]: 3, get f() { return 1 }, async *g() {} };", True), ("const a;", False), ("let x\nx = 1\n++x", True), ("export default class A extends B { #p = 1; static { } static async m() { return this.#p } }", True), ("import a, { b as c } from './x.js'; export * as d from \"y\";", True),
    ("for (const [k, v] of m) { if (k) continue; else break }", True), ("for await (const x of y) z();", True), ("const f = async ({ a, ...r }, b = 2) => ({ a });", True), ("x => { return x }", True), ("a ? b : c ? d : e", True), ("`a ${b + `c ${d}`} e`", True), ("`a ${b", False), ("/re[/]x/g.test(s) ? 1 : 2 / 3", True), ("function f() {", False), ("try { a() } catch { b() } finally { c() }", True), ("switch (a) { case 1: b(); default: c() }", True),
    ("a?.b?.[c]?.(d) ?? e", True), ("return1 = 1", True), ("const s: string = 'x'", False), ("{\"a\": 1}", False), ("new A.B(c).d", True), ("label: while (1) break label", True), ("import.meta.url; import('x')", True), ("x = <T>y", False), ("'use strict'; with (a) {}", False), ("", True), ("// only\n/* this */", True), ("let a = 1 let b = 2", False),
]
TYPED = [
    ("interface A<T extends B = C> extends D { readonly a?: string; [k: string]: number; m(x: T): void; new (): A }", True), ("type U = | 'a' | { b: number[] } & C | (new (x: D) => E);", True), ("enum E { A = 1, B }", True), ("abstract class A<T> implements B { private readonly x?: T; constructor(public y: number) { super() } abstract m(): void; get z(): T { return this.x! } }", True),
    ("function f(this: A, x?: number, ...r: string[]): x is number { return x as any }", True), ("const f = <T,>(x: T): T => x satisfies T;", True), ("namespace A.B { export const c: typeof d = e }", True), ("declare module 'x' { export function f(a: number): void; }", True), ("type M = { [K in keyof T]?: T[K] extends infer U ? U : never }", True), ("let x = f<number>(1)", True), ("export type { A } from './a'; import type B from 'b'", True), ("function f(x: number", False),
    ("@dec() class A { @inject() b: C; }", True), ("let t: [a: string, b?: number, ...c: boolean[]]", True), ("async m(a: string = 'x', b: string[]): Promise<void> {}", False),
]


@pytest.mark.parametrize("text,ok", SCRIPT)
def test_javascript(text, ok):
    assert verdict(text, "javascript")[0] == ok


@pytest.mark.parametrize("text,ok", TYPED)
def test_typescript(text, ok):
    assert verdict(text, "typescript")[0] == ok


def test_deep_and_long_texts():
    assert verdict("[" * 100_000 + "]" * 100_000, "json")[0]
    assert verdict("f(" * 5_000 + ")" * 5_000, "javascript")[0]
    assert verdict("(" * 20_000 + "1" + ")" * 20_000, "python")[0]
    assert verdict("x = " + "[" * 20_000 + "]" * 20_000, "toml")[0]
    assert verdict("[" * 20_000 + "]" * 19_999, "json") == (False, 39_999, "truncated")
    assert verdict("x = 1\n" * 20_000, "python")[0]


def test_given_files_agree_with_the_library(spark):
    rows = table(spark, SMALL, "code_chunks").collect()
    files = {}
    for r in rows:
        files.setdefault((r.repo, r.file_path), []).append((r.start_line, r.content))
    checks = {"py": ast.parse, "json": json.loads, "toml": tomllib.loads}
    names = {"py": "python", "json": "json", "toml": "toml"}
    seen = 0
    for (_, path), parts in files.items():
        ext = path.rsplit(".", 1)[-1].lower()
        if ext not in checks:
            continue
        parts = sorted(set(parts))
        text = I.assemble([s for s, _ in parts], [c for _, c in parts])
        try:
            checks[ext](text.lstrip("\ufeff"))
            ok = True
        except Exception:
            ok = False
        assert verdict(text, names[ext])[0] == ok, path
        seen += 1
    assert seen > 10


def test_rows_of_a_file(spark):
    rows = [
        {"chunk_id": 1, "repo": "r", "file_path": "a.py", "content": "def f():", "start_line": 1},
        {"chunk_id": 2, "repo": "r", "file_path": "a.py", "content": "    return 1\n", "start_line": 3},
        {"chunk_id": 3, "repo": "r", "file_path": "a.py", "content": "    return 1\n", "start_line": 3},
        {"chunk_id": 4, "repo": "r", "file_path": "b.JSON", "content": None, "start_line": None},
        {"chunk_id": 5, "repo": None, "file_path": "c.ts", "content": "let x: = 1"},
        {"chunk_id": 6, "repo": "r", "file_path": None, "content": "("},
        {"chunk_id": 7, "repo": "r", "file_path": "d.unknown", "content": "("},
        {"chunk_id": 8, "repo": "r", "file_path": "e.toml", "content": "a = 1\n<<<<<<< HEAD\nb = 2", "start_line": 1},
        {"chunk_id": 9, "repo": "r", "file_path": "f.py", "content": "x = (1,", "start_line": 1},
        {"chunk_id": 10, "repo": "r", "file_path": "g.json", "content": "import os\nx = [1]\n", "start_line": 1},
        {"chunk_id": 11, "repo": "r", "file_path": "h.py", "content": "", "start_line": 1},
    ]
    df = chunk_rows(spark, rows)
    v = {(r.repo, r.file_path): r for r in I.file_verdicts(df).collect()}
    assert v[("r", "a.py")].valid and v[("r", "h.py")].valid
    assert not v[("r", "b.JSON")].valid and not v[(None, "c.ts")].valid
    assert v[("r", None)].valid is None and v[("r", "d.unknown")].valid is None
    assert v[("r", "e.toml")].cause == "merge_conflict" and v[("r", "e.toml")].fail_line == 2
    assert v[("r", "f.py")].cause == "truncated" and v[("r", "g.json")].cause == "wrong_language"
    assert {(r.repo, r.file_path) for r in I.invalid_files(df).collect()} == {("r", "b.JSON"), (None, "c.ts"), ("r", "e.toml"), ("r", "f.py"), ("r", "g.json")}
    rates = {(r.repo, r.language): (r.n_files, r.n_invalid) for r in I.invalid_rates(df).collect()}
    assert rates[("r", "python")] == (3, 1) and rates[("r", "json")] == (2, 2)
    far = [{"chunk_id": 20, "repo": "r", "file_path": "z.py", "content": "x = 1", "start_line": 1}, {"chunk_id": 21, "repo": "r", "file_path": "z.py", "content": "y = 1\nz = = 2", "start_line": 2_000_000}]
    z = I.file_verdicts(chunk_rows(spark, far)).first()
    assert (z.valid, z.fail_line, z.fail_at) == (False, 2_000_001, len("x = 1") + 1_999_999 + len("y = 1\nz = "))
    hot = chunk_rows(spark, [{"chunk_id": i, "repo": None, "file_path": None, "content": f"({i}"} for i in range(500)] + [{"chunk_id": 900, "repo": None, "file_path": "a.py", "content": "("}])
    assert sorted((r.repo, r.file_path, r.valid) for r in I.file_verdicts(hot).where("file_path IS NOT NULL").collect()) == [(None, "a.py", False)]
    assert I.file_verdicts(hot).where("file_path IS NULL").count() == 1 and [(r.repo, r.file_path) for r in I.invalid_files(hot).collect()] == [(None, "a.py")]
    assert I.invalid_rates(df.where("false")).count() == 0 and I.invalid_files(df.where("false")).count() == 0
