"""Problems 1, 2 and 4 on small fixtures: nulls, empty and very long texts, repeated rows, odd columns."""

import itertools
import random

import pytest

from graphloom.functions.lexing import mask, pairs
from graphloom.llm import docpairs, handwritten, syntax

GO = "package p\n\nimport (\n\t\"log\"\n)\n\n// Pop blocks until a row arrives.\nfunc Pop(k int) string {\n\tx := `{ raw`\n\treturn \"}\" + x // }\n}\n"
JS = "const a = `x ${b ? `}` : \"{\"} y`;\nconst r = /[/}]/g.test(s) / 2;\nfunction f() { return a; }\n"
RS = "fn f<'a>(x: &'a str) -> char {\n    let s = r#\"}\"#; /* { /* { */ */ let c = '{'; c\n}\n"


def test_masks_keep_positions():
    for text, lang in ((GO, "go"), (JS, "javascript"), (RS, "rust"), ("s = '''{'''\nx = \"a\\\n{\" # }\n", "python"), ('char c = \'"\'; // "\n', "c")):
        m = mask(text, lang)
        assert len(m.code) == len(text) and not m.errors and not pairs(m.code)[1], (lang, m.code)
        assert m.code.count("\n") == text.count("\n")
    assert mask("x = 'abc", "python").errors and mask("/* a", "go").errors and mask("`a", "javascript").errors


@pytest.mark.parametrize(
    ("doc", "name", "says"),
    [
        (None, "f", False), ("", "f", False), ("  \n", "f", False), ("Drops ties.", "f", True), ("Thread-safe.", None, True), ("loads the ledger", "loadLedger", False), ("Load ledger.", "LoadLedger", False),
        ("loadLedger loads each ledger that was renamed.", "loadLedger", True), ("TODO: document", "f", False), ("TODO(a): later.\nKeeps the oldest row when two collide.", "f", True),
        ("Copyright (c) 2020 X\nLicensed under Y.", "f", False), ("@param x\n@returns", "f", False), ("x = run(y)\nreturn x", "f", False), ("See docs.", "f", False), ("===== Public API =====", "f", False),
        ("nolint:errcheck", "f", False), ("# Compacts rows\n# only when idle.", "f", True), ("この関数は古い行を削除します。", "f", True), ("Счётчик пересчитает имя пакета на каждом шаге.", "f", True), ("for i in range(3):\n    push(i)\n// isn't shared", "f", False),
        ("Owner: team-a. Ticket: A-1.", "f", False), ("Function f.\nInput: x\nOutput: see signature", "f", False), ("***", "f", False), ("Never returns nil. " * 5000, "f", True),
    ],
)
def test_descriptions(doc, name, says):
    assert bool(docpairs.description(doc, name)) == says


def test_functions_and_their_comments():
    ((name, first, last, doc, code),) = docpairs.functions_of(GO, "go")
    assert (name, first, last, doc) == ("Pop", 8, 11, "Pop blocks until a row arrives.") and code.endswith("}")
    assert docpairs.functions_of(None, "go") == [] and docpairs.functions_of("", None) == []
    (python,) = docpairs.functions_of('@cached\ndef f(a: int = "):") -> str:\n    """Says."""\n    return 1\n\nx = 1\n', "python")
    assert python[:4] == ("f", 2, 4, "Says.")
    js = "/** Says. */function a(x){return x}var b=1;function c(){}\nconst d = (x) => x.map(y => y)\nconst e = () => {\n  return 1;\n};\n"
    assert [(f[0], f[1], f[2], f[3]) for f in docpairs.functions_of(js, "javascript")] == [("a", 1, 1, "Says."), ("c", 1, 1, None), ("d", 2, 2, None), ("e", 3, 5, None)]
    (go,) = docpairs.functions_of("package p\n\nfunc f(x struct{}) interface{} {\n\treturn x\n}\n", "go")
    assert go[:3] == ("f", 3, 5)


def test_time_grows_with_the_text():
    import time

    def took(n):
        text = "".join(f"# Says {i}.\ndef f{i}(a: int = (1)) -> dict[str, int]:\n    return g((a))\n" for i in range(n))
        begun = time.perf_counter()
        assert len(docpairs.functions_of(text, "python")) == n
        return time.perf_counter() - begun

    took(200)
    assert took(8000) < 12 * took(2000) + 0.5


def test_pairs(spark):
    schema = "id string, kind string, name string, signature string, file_path string, language string, start_line int, end_line int, docstring string, updated_at bigint, path string"
    row = lambda i, kind="function", doc="Blocks until a row arrives.", at=1, name="Pop": (i, kind, name, "(k int) string", "r/p.go", "go", 8, 11, doc, at, "clash")
    nodes = spark.createDataFrame([row("a", doc="Pop blocks until a row arrives."), row("a", doc="Pop blocks until a row arrives."), row("b"), row("b", doc="TODO", at=2), row("c", "class"), row(None), row("d", None), row("e", doc=None), row("f", name=None)], schema)
    texts = spark.createDataFrame([("r/p.go", GO, 1), (None, GO, 1), ("r/q.go", None, 1)], "path string, content string, docstring int")
    nodes = nodes.union(spark.createDataFrame([row("later", doc="Never returns nil.", at=3), row("gone", name="Lost")], schema))
    rows = {r.node_id: r for r in docpairs.function_pairs(nodes, texts).collect()}
    assert {r.node_id for r in docpairs.documented(nodes, texts).collect()} == set(rows) == {"a", "later"}
    assert all(r.code.startswith("func Pop") for r in rows.values()) and (rows["a"].origin, rows["later"].origin) == ("source", "row")
    assert docpairs.documented(nodes, texts.where("path <> 'r/p.go'")).count() == 0  # what the lexer doesn't delimit is no pair
    assert docpairs.documented(nodes.limit(0), texts.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "lang", "bad"),
    [
        (None, "go", False), ("", "go", False), ("\n", "rust", False), (GO, "go", False), (JS, "javascript", False), (RS, "rust", False), (GO[:-3], "go", True), (GO, None, False), (GO, "rust", True), (GO, "python", True),
        ("def f():\nreturn 1\n", "python", True), ("def f():\n    return 1\n", "python", False), ("x = '<<<<<<< a'\n", "python", False), ("package p\n\nvar s = `\n<<<<<<< a\n=======\n`\n", "go", False),
        ("package p\n<<<<<<< a\n=======\n>>>>>>> b\n", "go", True), ("const a: number = 1;\n", "javascript", True), ("const a: number = 1;\n", "typescript", False), ("version x-spec v1\noid sha256:1\nsize 3\n", "typescript", True),
        ("int f(void) { return 1; }\n", "c", False), ("int f(void) { return 1; \n", "c", True), ("#include <a.h>\n// only\n", "c", False), ("class A { char c = '\"'; }\n", "java", False), ("class A { String s = \"a; }\n", "java", True),
        ("var a=[" + "1," * 50000 + "2];", "javascript", False), ("x = [a, (b]\n", "python", True), ("<!doctype html>\n<p>", "java", True),
    ],
)
def test_syntax(text, lang, bad):
    assert bool(syntax.first_error(text, lang)) == bad


def test_python_layout_against_the_parser():
    """Lines of a valid program are dropped, doubled, indented and cut; the verdict is that of the interpreter's parser."""
    import ast
    import warnings

    base = "import os\nfrom m import *\n\nclass A:\n    x: int = 1\n\n    def f(self, a=(1,\n  2)) -> dict:\n        if a:\n            return {1: [a\n]}\n        else: pass\n        y = 'a' 'b' \\\n            if a else 0x1F\n        match y:\n            case 1: return -1\n            case _:\n                pass\n        for i in a:\n            try:\n                print(i); continue\n            finally:\n                del y\n        with open(a) as g, h: g.b\n        lambda q: q\n"
    rng = random.Random(3)
    lines = base.split("\n")
    texts = [base, "", "x = 1", "\tx = 1\n", "if x:\n# c\n\n  y\n z\n", "def f():\n", "x = 1 2\n", "a b\n", "x = 9z\n", "print 'x'\n", "x = (1\n2)\n", "class A\n  x\n", "foo:\n  x\n", "x = 5 if y else\n", "@a\ndef f(): ...\n"]
    for _ in range(300):
        k, new = rng.randrange(len(lines)), [*lines]
        new[k : k + 1] = rng.choice([[], [new[k], new[k]], ["    " + new[k]], [new[k][2:]], [new[k].rstrip(":")], [new[k] + " word"]])
        texts.append("\n".join(new[: rng.choice([len(new), len(new), k + 1])]))
    for t in texts:
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(t)
            bad = False
        except SyntaxError:
            bad = True
        found = syntax.first_error(t, "python")
        assert bad or not found, (t, found)
        if bad and not found:
            assert "else" in t or "try" in t or "finally" in t or "word" in t or "import" in t, t  # order of clauses is beyond a lexer


def test_syntax_tables(spark):
    files = spark.createDataFrame([("r/a.go", "go", "x"), ("r/a.go", "go", "y"), ("s/b.py", "python", None), (None, "go", ""), ("r/none.go", "go", "")], "path string, language string, error string")
    texts = spark.createDataFrame([("r/a.go", GO[:-3], 1), ("s/b.py", "x = 1\n", 1), (None, "x", 1), ("lost.go", "x", 1)], "path string, content string, language int")
    checked = syntax.check_files(files, texts)
    assert [r.path for r in syntax.broken_files(checked).collect()] == ["r/a.go"]
    assert {(r.repo, r.language, r.files, r.broken, r.rate) for r in syntax.error_rates(checked).collect()} == {("r", "go", 1, 1, 1.0), ("s", "python", 1, 0, 0.0)}
    assert syntax.error_rates(syntax.check_files(files.limit(0), texts.limit(0))).count() == 0


@pytest.mark.parametrize(
    ("path", "text", "lang", "rule"),
    [
        ("r/a.go", "// Code generated by x v1. DO NOT EDIT.\n" + GO, "go", "generated"), ("r/a.go", GO.replace("Pop blocks", "Code generated by x. DO NOT EDIT."), "go", None), ("r/emit.go", GO.replace("{ raw", "// Code generated by %s. DO NOT EDIT."), "go", None),
        ("r/vendor/l/a.go", GO, "go", "vendored"), ("vendor/a.go", GO, "go", None), ("r/vendors/a.go", GO, "go", None), ("r/a_pb2.py", "x = 1\n", "python", "generated"), ("r/a.py", "# lib 1.2.3 - upstream release\nx = 1\n", "python", "vendored"),
        ("r/a.js", "var a=[1,2],b={c:!0};function d(e){return e+1}" * 20, "javascript", "minified"), ("r/a.go", "package p\n\nvar D = []int{\n" + "\t1, 2, 3, 4,\n" * 40 + "}\n", "go", "data"), ("r/a.go", None, None, None), (None, "", "go", None), ("r/a.go", GO, "go", None),
    ],
)
def test_rules(path, text, lang, rule):
    assert handwritten.judge(path, text, lang)[0] == rule


def test_copies(spark):
    body = "".join(f"    value_{i} = compute_{i}(input)\n" for i in range(30))
    rows = [(f"r{k}/lib/a.py", body if k else body.replace("value_3 ", "other_3 "), 1) for k in range(12)]
    rows += [("r1/own.py", "".join(f"    mine_{i} = compute({i})\n" for i in range(30)), 1), ("r1/a2.py", "x\n", 1), ("r2/null.py", None, 1), (None, body, 1)]
    texts = spark.createDataFrame(rows, "path string, content string, repo int")
    files = texts.select("path", F_lit("python"))
    got = {r.path for r in handwritten.not_handwritten(files.withColumnRenamed("x", "language"), texts).collect()}
    assert got == {f"r{k}/lib/a.py" for k in range(12)}
    assert handwritten.not_handwritten(files.withColumnRenamed("x", "language").limit(0), texts.limit(0)).count() == 0


def brute_copies(texts):
    lines = {p: {x.strip(" ") for x in t.splitlines() if len(x.strip(" ")) >= handwritten.MIN_LINE} for p, t in texts.items()}
    repo = lambda p: p.split("/")[0]
    return {p for p, x in lines.items() if len(x) >= handwritten.MIN_LINES and any(repo(q) != repo(p) and len(x & y) >= handwritten.CONTAINED * len(x) for q, y in lines.items())}


def copies_of(spark, texts):
    held, classes = handwritten.line_classes(spark.createDataFrame(list(texts.items()), "path string, content string"))
    return {r.path: (r.other, r.share) for r in handwritten.copied_lines(held, classes, handwritten.class_links(classes)).collect()}


def test_copies_of_any_version(spark):
    """Whatever the order of names: v1 stands in two repositories, v2 with 70 of its 100 lines in a third."""
    v1 = "".join(f"    value_{i} = compute_{i}(input)\n" for i in range(100))
    v2 = "".join(f"    value_{i} = compute_{i}({'input' if i < 70 else 'changed'})\n" for i in range(100))
    texts = {}
    for k, names in enumerate(itertools.permutations("ABC")):
        texts |= {f"{names[j]}{k}/f{k}.py": f"# group {k} of all\n" + t.replace("compute", f"compute{k}") for j, t in enumerate((v1, v1, v2))}
    frame = spark.createDataFrame([(p, t, "python") for p, t in texts.items()], "path string, content string, language string")
    assert {r.path for r in handwritten.not_handwritten(frame.select("path", "language"), frame.select("path", "content")).collect()} == brute_copies(texts)
    got = copies_of(spark, texts)
    assert set(got) == brute_copies(texts) == {f"{n}{k}/f{k}.py" for k, names in enumerate(itertools.permutations("ABC")) for n in names[:2]}
    assert all(share == 1.0 and other.split("/")[1] == path.split("/")[1] for path, (other, share) in got.items())


def test_one_original_per_group_of_copies(spark):
    """Original, header-less copy, a third version and a vendored copy, in all orders of names; a group without a mark, and one with one unmarked file."""
    text = lambda k, other=0: "".join(f"    value_{i} = compute{k}_{i}({'input' if i >= other else 'changed'})\n" for i in range(100))
    texts, groups = {}, []
    for k, names in enumerate(itertools.permutations("ABCD")):
        groups.append([f"{names[0]}{k}/o.py", f"{names[1]}{k}/c.py", f"{names[2]}{k}/e.py", f"{names[3]}{k}/vendor/v.py"])
        texts |= dict(zip(groups[-1], (text(k), text(k), text(k, 15), text(k))))
    texts |= {"E/o.py": text("x"), "F/o.py": text("x", 9), "G/o.py": text("y"), "H/vendor/o.py": text("y")}
    frame = spark.createDataFrame([(p, t, "python") for p, t in texts.items()], "path string, content string, language string")
    got = {r.path for r in handwritten.not_handwritten(frame.select("path", "language"), frame.select("path", "content")).collect()}
    for g in groups:
        assert {min(g[:2])} == set(g) - got, g
    assert got >= {"E/o.py", "F/o.py", "H/vendor/o.py"} and "G/o.py" not in got


def test_groups_of_copies(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    rng.shuffle(pairs)
    want = {x: x for p in pairs for x in p}
    for _ in want:
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    got = handwritten.copy_groups(spark.createDataFrame(pairs, "class bigint, other bigint"))
    assert {r["class"]: r["group"] for r in got.collect()} == want


def test_copies_against_brute_force(spark):
    rng = random.Random(6)
    texts = {}
    for k in range(120):
        start, size = rng.randrange(3) * 100, rng.choice([4, 5, 6, 30, 40])
        lines = [f"    value_{start + i} = compute(input)" for i in range(size)]
        texts[f"r{rng.randrange(6)}/f{k}.py"] = "\n".join(x if rng.random() > rng.choice([0, 0.1, 0.3]) else f"    own_{k}_{rng.randrange(10**6)} = 1" for x in lines)
    assert set(copies_of(spark, texts)) == brute_copies(texts)


def F_lit(value):
    from pyspark.sql import functions as F

    return F.lit(value).alias("x")
