"""Problem 5: definitions against Python's own parser, documentation texts, templates."""

import ast
import random

import pytest
from conftest import SMALL
from test_syntax import chunk_rows

from auditloom.llm import function_docs as D
from auditloom.llm.syntax.gll import Gll
from auditloom.llm.syntax.islands import js_functions, python_functions
from auditloom.tables import table

GOOD = "Reads every row of the table and keeps the newest one."


def test_gll_recognises_ambiguous_and_left_recursive_grammars():
    g = Gll({"S": [("S", "S"), ("a",), ("b", "S", "c")]}, "S", {"S"})
    spans = g.spans(["a", "b", "a", "a", "c", "EOF"])
    assert ("S", 0, 5) in spans and ("S", 2, 4) in spans and ("S", 0, 4) not in spans


def test_gll_equals_brute_force_on_random_strings():
    g = Gll({"S": [("(", "S", ")", "S"), ()]}, "S", {"S"})
    rng = random.Random(4)
    for _ in range(200):
        s = [rng.choice("()") for _ in range(rng.randrange(0, 9))]
        depth, ok = 0, True
        for c in s:
            depth += 1 if c == "(" else -1
            ok &= depth >= 0
        assert (("S", 0, len(s)) in g.spans([*s, "EOF"])) == (ok and depth == 0)


def test_python_functions_equal_the_library(spark):
    n = 0
    for r in table(spark, SMALL, "code_chunks").where("chunk_type <> 'block' AND lower(file_path) LIKE '%.py'").collect():
        try:
            tree = ast.parse(r.content.lstrip("\ufeff"))
        except SyntaxError:
            continue
        want = sorted((f.name, ast.get_docstring(f, clean=False) or "") for f in ast.walk(tree) if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)))
        assert sorted((f["name"], f["doc"]) for f in python_functions(r.content)) == want
        n += len(want)
    assert n > 20


def test_functions_of_broken_files():
    text = 'def a():\n    """Doc a."""\n    return 1\n\ndef broken(:\n    x = (\n\n'
    assert [f["name"] for f in python_functions(text)] == ["a"]
    js = "class A {\n  m(x) { return 1 }\n\nfunction g() { return {a: 1} }\n<<<<<<< HEAD\nconst h = async (a: {b: number}) => a;\n"
    assert {f["name"] for f in js_functions(js)} == {"m", "g", "h"}


def test_javascript_shapes():
    text = "/** Doc one. */\nexport default async function one() {}\n// trailing\n\nconst two = function () {};\nif (x) { y() }\nfoo(bar);\nobj = { three() {}, four: (a) => a, get five() { return 1 } };\nclass K { static async six(a = { b: 1 }) { while (z) {} } #seven() {} }\n/* not a doc: function eight() {} */\nlet s = `function nine() {} ${x}`;\n"
    got = {f["name"]: f["comment"].strip(" *") for f in js_functions(text)}
    assert set(got) == {"one", "two", "three", "four", "five", "six", "#seven"} and got["one"] == "Doc one." and got["two"] == ""


PROSE = [
    (GOOD, GOOD), ("Args:\n    x: the first value that is read here\nReturns:\n    int: many words that do not count", ""), (f"{GOOD}\n\n:param x: more words than five in here\n:return: and again some more words here", GOOD), ("Parameters\n----------\nx : int\n    the value that is used for all\n", ""),
    (f"\n * {GOOD}\n * @param {{string}} a the words of a tag do not count\n * @returns {{number}} nor do these words here\n ", GOOD), (">>> f(1)\nmany words of output that do not count\n", ""), (f"{GOOD}\n\nExample::\n\n    def f(x):\n        # some comment with many words in it\n        return x\n", GOOD), ("@description Reads every row of the table", "Reads every row of the table"),
]


@pytest.mark.parametrize("doc,want", PROSE)
def test_prose(doc, want):
    assert D.prose(doc) == want.strip(" */#-")


def test_documented_rows(spark):
    rows = [
        {"chunk_id": 1, "repo": "r", "file_path": "a.py", "start_line": 1, "chunk_type": "module", "content": f'def f():\n    """{GOOD}"""\n\n\n# {GOOD}\ndef g():\n    pass\n\n# {GOOD}\n\ndef blank_between():\n    pass\n\ndef short():\n    """Too short."""\n'},
        {"chunk_id": 2, "repo": "r", "file_path": "b.py", "start_line": 1, "chunk_type": "function", "content": "def h():\n    pass\n", "docstring": GOOD},
        {"chunk_id": 3, "repo": "r", "file_path": "c.py", "start_line": 1, "chunk_type": "class", "content": "class C:\n    def k(self):\n        pass\n", "docstring": GOOD},
        {"chunk_id": 4, "repo": "r", "file_path": "d.py", "start_line": 1, "chunk_type": "block", "content": f'def z():\n    """{GOOD}"""\n'},
        {"chunk_id": 5, "repo": "r", "file_path": "e.py", "start_line": 1, "chunk_type": "module", "content": f'def ok():\n    """{GOOD}"""\n\ndef bad(:\n'},
        {"chunk_id": 6, "repo": None, "file_path": "f.ts", "start_line": 1, "chunk_type": "module", "content": f"// {GOOD}\nexport const t = (a: number): void => {{}};\n"},
        {"chunk_id": 7, "repo": "r", "file_path": None, "content": "def q(): pass"},
        {"chunk_id": 8, "repo": "r", "file_path": "g.py", "content": None, "chunk_type": None},
        {"chunk_id": 9, "repo": "r", "file_path": "h.py", "start_line": 1, "chunk_type": None, "content": f'@deco\nasync def dup():\n    """{GOOD}"""\n'},
        {"chunk_id": 10, "repo": "r", "file_path": "h.py", "start_line": 1, "chunk_type": None, "content": f'@deco\nasync def dup():\n    """{GOOD}"""\n'},
    ]
    df = chunk_rows(spark, rows)
    assert sorted((r.chunk_id, r.func_name) for r in D.documented_valid(df).collect()) == [(1, "f"), (1, "g"), (2, "h"), (6, "t"), (9, "dup"), (10, "dup")]
    assert (5, "ok") in {(r.chunk_id, r.func_name) for r in D.documented(df).collect()}
    assert D.documented_valid(df.where("false")).count() == 0


def test_corpus_repeated_templates_are_dropped(spark):
    many = "".join(f'def load_{i}():\n    """Loads the number {i} of load_{i} from the old store."""\n\n' for i in range(40))
    rows = [{"chunk_id": 1, "repo": "r", "file_path": "a.py", "start_line": 1, "chunk_type": "module", "content": many}, {"chunk_id": 2, "repo": "r", "file_path": "b.py", "start_line": 1, "chunk_type": "module", "content": f'def real():\n    """{GOOD}"""\n'}]
    assert [r.func_name for r in D.function_pairs(chunk_rows(spark, rows)).collect()] == ["real"]


def test_repeated_templates_go_in_a_large_corpus(spark):
    word = lambda i: "".join(chr(97 + int(c)) for c in f"{i:04d}")
    many = "".join(f'def load_{i}():\n    """Loads the number {i} of load_{i} from the old store."""\n\n' for i in range(10))
    other = "".join(f'def f_{word(i)}():\n    """Takes {word(i)} out of {word(i + 3)} and keeps the rest."""\n\n' for i in range(1_200))
    rows = [{"chunk_id": k, "repo": "r", "file_path": f"{k}.py", "start_line": 1, "chunk_type": "module", "content": c} for k, c in enumerate((many, other))]
    names = [r.func_name for r in D.function_pairs(chunk_rows(spark, rows)).collect()]
    assert len(names) == 1_200 and not any(n.startswith("load_") for n in names)
