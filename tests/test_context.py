"""Questions, retrieval and exploring on a small graph; the parts that need no session as they are."""

import pytest

from graphloom.context import explore as E
from graphloom.context import questions as Q
from graphloom.context import render, retrieve
from graphloom.context.store import Store
from graphloom.operators import graph


def test_symbols_of_a_question():
    assert Q.symbols_of("How does parseConfig use MAX_RETRIES and HTTP via app.server in run_all?") == ["parseConfig", "run_all", "MAX_RETRIES", "HTTP", "app.server", "app", "server", "via"] or set(
        Q.symbols_of("How does parseConfig use MAX_RETRIES and HTTP via app.server in run_all?")
    ) >= {"parseConfig", "MAX_RETRIES", "HTTP", "app.server", "run_all"}
    assert Q.symbols_of("") == [] and "find" not in Q.symbols_of("find the ledger") and "ledger" in Q.symbols_of("find the ledger")
    assert (Q.title("bATCH"), Q.folder("a/b/c.go"), Q.folder("c.go"), Q.title("")) == ("Batch", "a/b", ".", "")
    assert Q.is_type_name("DataRequest") and not Q.is_type_name("HTTP") and not Q.is_type_name("Abc")
    assert Q.identifiers_of("call Foo::bar, (baz)? ab 9x") == ["call", "Foo::bar", "baz"]
    assert Q.shortened("é" * 5, 5) == "éé\n... (truncated) ..." and Q.shortened("ab", 2) == "ab" and Q.numbered("a\nb", 7) == "7\ta\n8\tb"


def test_concepts_and_windows():
    assert retrieve.concepts(["cache", "caches", "ledger", "led"]) == [["caches", "cache"], ["ledger", "led"]]
    assert E.windows([(10, 12), (1, 3), (5, 6), (11, 40)], 2) == [(1, 6), (10, 40)] and E.windows([], 3) == []
    assert [E.budget(n).files for n in (0, 150, 500, 9000)] == [4, 5, 8, 8] and E.calls_recommended(20000) == 4


def node(i, name, kind="function", path="r/src/a.go", first=1, last=3, **more):
    return {"id": i, "kind": kind, "name": name, "qualified_name": name, "file_path": path, "language": "go", "start_line": first, "end_line": last, "signature": None, "docstring": None, "is_test": "_test." in path, "is_generated": False} | more


def subgraph(ids, calls, roots):
    sg = retrieve.Subgraph({i: node(i, i.upper()) for i in ids}, roots=roots)
    for a, b in calls:
        sg.link({"source": a, "target": b, "kind": "calls"})
    return sg


def test_call_chains():
    sg = subgraph("abcdef", [("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("d", "e"), ("e", "f")], ["a", "d"])
    assert render.call_chains(sg) == [["a", "b", "d", "e", "f"]]
    sg.edges["a", "b", "calls"] |= {"provenance": "heuristic", "metadata": {"synthesizedBy": "callback", "via": "on", "registeredAt": "x:1"}}
    assert "A →[callback via `on` @x:1] B → D" in render.call_paths(sg) and render.call_paths(subgraph("ab", [("a", "b")], ["a"])) == ""
    assert "Low confidence" in render.caution(sg)


def test_walk_on_a_subgraph_equals_the_one_on_tables(spark):
    edges = [("a", "b", "calls"), ("a", "b", "calls"), ("b", "c", "returns"), ("c", "c", "calls"), ("a", "d", "contains"), ("x", "a", "calls")]
    ids = ["a", "b", "c", "d"]
    frame = spark.createDataFrame([(k, *e) for k, e in enumerate(edges)], "edge_id bigint, source string, target string, kind string")
    rows = graph.random_walk(frame, spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame([("a",)], "id string"), rounds=6)
    small = E.walk(ids, edges, {"a"}, rounds=6)
    assert {r.node_id: pytest.approx(r.mass, abs=1e-9) for r in rows.collect()} == small and sum(small.values()) == pytest.approx(1.0)
    assert E.walk([], [], set()) == {}


def test_files_are_ranked():
    sg = subgraph("abc", [("a", "b")], ["a"])
    sg.nodes["b"]["file_path"], sg.nodes["c"]["file_path"] = "r/src/b.go", "r/src/c_test.go"
    sg.nodes["c"]["is_test"] = True
    got = E.ranked_files(sg, "what is ledger", ["b"])
    assert [f["file_path"] for f in got] == ["r/src/b.go", "r/src/a.go"] and got[0]["score"] == 50.0 and got[1]["score"] == 10.0


TEXT = "package p\n\nfunc renderQuota() {\n\twalkRelay()\n}\n\nfunc walkRelay() {\n}\n"


@pytest.fixture(scope="module")
def store(spark):
    rows = [
        ("f1", "function", "renderQuota", "r/src/a.go", 3, 5), ("f2", "function", "walkRelay", "r/src/a.go", 7, 8), ("t1", "struct", "BatchReader", "r/src/b.go", 1, 9), ("t2", "interface", "Reader", "r/src/b.go", 10, 12),
        ("t3", "struct", "LedgerCacheReader", "r/src/c.go", 1, 9), ("i1", "import", "renderQuota", "r/src/c.go", 1, 1), ("x1", "function", "renderQuota", "r/src/a_test.go", 1, 2), ("n0", None, None, None, None, None),
    ]
    nodes = spark.createDataFrame([(*r[:3], r[2], r[3], "go", *r[4:], None, None, None, 1) for r in rows] + [("f1", "function", "old", "old", "r/src/a.go", "go", 1, 1, None, None, None, 0)], "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, signature string, docstring string, name_split string, updated_at bigint")
    edges = [("f1", "f2", "calls"), ("f1", "f2", "calls"), ("t1", "t2", "implements"), ("t3", "t2", "implements"), ("i1", "f1", "imports"), ("f1", "gone", "calls"), (None, "f1", "calls"), ("f2", "t1", "references")]
    frame = spark.createDataFrame([(k, *e) for k, e in enumerate(edges)], "edge_id bigint, source string, target string, kind string")
    texts = spark.createDataFrame([("r/src/a.go", TEXT, "clash"), ("r/src/b.go", None, ""), (None, "x", "")], "path string, content string, kind string")
    return Store(nodes, frame, texts.select("path"), texts)


def test_retrieval(store):
    sg = retrieve.relevant(store, "how does renderQuota reach walkRelay", retrieve.RETRIEVAL)
    assert {"f1", "f2"} <= set(sg.roots) and "t1" in sg.nodes and sg.sure and "gone" not in sg.nodes
    assert ("f1", "f2", "calls") in sg.edges and all(a in sg.nodes and b in sg.nodes for a, b, _ in sg.edges)
    text = render.markdown(store, "how does renderQuota reach walkRelay", retrieve.RETRIEVAL, sg)
    assert "func renderQuota() {\n\twalkRelay()\n}" in text and text.startswith("## Code Context")
    answer, files = E.explore(store, "renderQuota walkRelay")
    assert files[0]["file_path"] == "r/src/a.go" and "3\tfunc renderQuota() {" in answer
    assert retrieve.hits_of(store, "  ") == ([], True) and E.explore(store, "zzzzqqq")[1] == []


def test_definitions_take_the_place_of_imports(store):
    rows = store.by_ids(["i1", "t1"])
    got = retrieve.definitions_of_imports(store, [rows["i1"] | {"score": 2.0}, rows["t1"] | {"score": 1.0}])
    assert [(r["id"], r["score"]) for r in got] == [("f1", 2.0), ("t1", 1.0)]
    ids, tree = retrieve.traverse(store, "f1", depth=2)
    assert ids == ["f1", "f2", "t1"] and len(tree) == 2 and retrieve.traverse(store, "nobody") == ([], [])
    assert set(retrieve.type_family(store, "t2", 5)[0]) == {"t2", "t1", "t3"}


def test_callers_depth_first(spark):
    """Parallel edges come once each at the last level, and are left out above it once their end was gone into."""
    edges = [("a", "b", "calls"), ("a", "b", "calls"), ("b", "c", "calls"), ("b", "c", "references"), ("c", "a", "calls"), ("a", "c", "calls"), ("a", "d", "contains")]
    nodes = spark.createDataFrame([(i, "function", i, i, "r/a.go", "go", 1, 2, None, None, None) for i in "abcd"], "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, signature string, docstring string, name_split string")
    frame = spark.createDataFrame([(k, *e) for k, e in enumerate(edges)], "edge_id bigint, source string, target string, kind string")
    s = Store(nodes, frame, nodes.select("file_path"), nodes.limit(0).select("id"))
    assert [(e["other"], e["depth"], e["edge_id"]) for e in retrieve.hops(s, "a", 2, "out")] == [("b", 0, 0), ("c", 1, 2), ("c", 1, 3), ("c", 0, 5)]
    assert [(e["other"], e["depth"]) for e in retrieve.hops(s, "a", 1, "out")] == [("b", 0), ("b", 0), ("c", 0)]
    assert [e["other"] for e in retrieve.hops(s, "a", 1, "in")] == ["c"] and retrieve.hops(s, "nobody", 2) == []
    pairs = graph.closure(frame.where("kind = 'calls'").select(graph.F.col("source").alias("a"), graph.F.col("target").alias("b")))
    assert {tuple(r) for r in pairs.collect()} == {(x, y) for x in "abc" for y in "abc"}
