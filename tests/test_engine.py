"""The facade over the smallest tables."""

from graphloom.engine import Engine


def test_answers(spark):
    e = Engine(spark, "/root/testdata/sf0.001")
    top = e.nodes.where("kind = 'function' and end_line is not null").orderBy("id").first()
    assert e.search(top["name"], limit=3).first()["name"] == top["name"]
    assert top["id"] in {r.id for r in e.code(top["name"]).collect()}
    assert e.callers(top["name"]).count() <= 20 and e.callers("no such name").count() == 0
    assert e.trace(top["name"], top["name"])[:1] and e.trace(top["name"], "no such name") == []
    assert e.file(top["file_path"]) == [top["file_path"]] and e.file("no/such") == []
    assert top["name"] in {r.name for r in e.symbols(top["file_path"]).collect()}


GO = "package util\n\n// Run starts it.\nfunc Run(s *Store) error {\n\ts.Open()\n\treturn nil\n}\n\ntype Store struct {\n\tn int\n}\n\nfunc (s *Store) Open() {}\n"
MAIN = "package main\n\nimport (\n\t\"ex.com/m/util\"\n)\n\nfunc main() {\n\tutil.Run(nil)\n}\n"


def test_index_of_a_repository(spark, tmp_path):
    from graphloom.index import Index, index_repository, reindex
    from graphloom.server import MISSING, handle
    from graphloom.sources.repository import ignored, project_words

    root = tmp_path / "repo"
    (root / "util").mkdir(parents=True)
    (root / "gen").mkdir()
    for path, text in {"util/run.go": GO, "main.go": MAIN, "go.mod": "module ex.com/m\n", "gen/x.go": "package x\n", "util/old.py": "x = 1\n", ".gitignore": "gen/\n*.tmp\n", "util/.gitignore": "/old.py\n"}.items():
        (root / path).write_text(text)
    assert project_words(str(root)) == frozenset() and ignored("a/b.tmp", ["*.tmp"]) and not ignored("a/b", ["/b"]) and ignored("a/x/y/b", ["a/**/b"]) and not ignored("a/xb", ["a/*/b"])
    empty = Engine(spark, str(tmp_path / "none"))
    call = lambda e, tool, **a: handle(e, {"id": 1, "method": "tools/call", "params": {"name": tool, "arguments": a}})["result"]["content"][0]["text"]
    assert call(empty, "search", query="x") == MISSING and handle(empty, {"id": 2, "method": "tools/list"})["result"]["tools"] == [] and handle(empty, {"method": "x"}) is None
    index = index_repository(spark, str(root), str(tmp_path / "index"))
    assert {r.path for r in index.table("files").collect()} == {"util/run.go", "main.go"}
    names = {r.id: r.name for r in index.table("nodes").collect()}
    edges = {(names.get(r.source), names.get(r.target), r.kind) for r in index.table("edges").collect()}
    assert {("Run", "Open", "calls"), ("Store", "Open", "contains"), ("Run", "Store", "references")} <= edges
    e = Engine(spark, str(tmp_path / "index"))
    assert e.search("Run").first()["name"] == "Run" and "func Run" in call(e, "node", symbol="Run", includeCode=True) and "calls: Open" in call(e, "node", symbol="Run")
    assert "1\tpackage main" in call(e, "node", file="main.go") and "No indexed file" in call(e, "node", file="zz") and "Say also" in call(e, "search")
    assert "Run" in call(e, "callers", symbol="Open") and handle(e, {"id": 3, "method": "nope"})["error"]["code"] == -32601
    index = Index(spark, str(tmp_path / "index"))
    reindex(index, spark.createDataFrame([("util/run.go", GO.replace("Run", "Walk"))], "path string, content string"), spark.createDataFrame([("main.go",)], "path string"))
    assert {r.name for r in index.table("nodes").where("kind in ('function', 'method')").collect()} == {"Walk", "Open"}
    assert {r.path for r in index.table("files").collect()} == {"util/run.go"} and index.table("postings").where("term = 'walk'").count() == 1
    assert index.table("postings").join(index.table("nodes"), "id", "left_anti").count() == 0 == index.table("lengths").join(index.table("nodes"), "id", "left_anti").count()

    from graphloom.streaming.incremental import follow

    source = str(tmp_path / "arriving")
    spark.createDataFrame([("util/new.go", "package util\n\nfunc Fresh() { Walk() }\n"), ("util/run.go", GO.replace("Run", "Walk"))], "path string, content string").write.parquet(source)
    follow(spark, source, index, str(tmp_path / "progress")).awaitTermination(200)
    assert {r.name for r in index.table("nodes").where("kind in ('function', 'method')").collect()} == {"Walk", "Open", "Fresh"}
    assert {r.path for r in index.table("files").collect()} == {"util/run.go", "util/new.go"}
