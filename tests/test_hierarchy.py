"""Hierarchies against a plain walk over random forests with cycles, dirt and all piece sizes."""

import random
from collections import defaultdict

import pytest

from graphloom.operators import hierarchy as H

SCHEMA = "edge_id bigint, source string, target string, kind string, id string"


def walk(pairs):
    parents, children = defaultdict(set), defaultdict(set)
    for s, t in pairs:
        if s is not None and t is not None:
            parents[t].add(s)
            children[s].add(t)
    ids = {x for p in pairs for x in p if x is not None}
    left = {n: len(parents[n]) for n in ids}
    ready = [n for n in ids if not left[n]]
    at = {n: (n, 0) for n in ready}
    while ready:
        n = ready.pop()
        for c in children[n]:
            left[c] -= 1
            if not left[c]:
                depth, root, _ = max((at[p][1] + 1, at[p][0], p) for p in parents[c])
                at[c] = (root, depth)
                ready.append(c)
    return {n: at.get(n, ("cycle", -1)) for n in ids}


def frame(spark, pairs):
    rows = [(i, s, t, "contains", "other") for i, (s, t) in enumerate(pairs)] + [(10**6, "x", "y", "calls", None)]
    return spark.createDataFrame(rows, SCHEMA)


def found(df):
    rows = df.collect()
    assert len(rows) == len({r.node_id for r in rows})
    return {r.node_id: (r.root_id, r.depth) for r in rows}


def dirty(seed):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(max(1, i))}" if rng.random() < 0.7 else f"n{i - 1}", f"n{i}") for i in range(1, 160)]
    pairs += [(f"n{rng.randrange(160)}", f"n{rng.randrange(160)}") for _ in range(4)]
    pairs += rng.sample(pairs, 10) + [("n5", "n5"), (None, "lonely"), ("alone", None), (None, None), (None, "n7")]
    return pairs + [("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("c3", "below"), ("below", "further")]


@pytest.mark.parametrize(("seed", "rows"), [(1, 30), (3, 10**6)])
def test_random_forests(spark, seed, rows):
    pairs = dirty(seed)
    assert found(H.hierarchy(frame(spark, pairs), rows_per_task=rows)) == walk(pairs)


def test_long_chain_in_small_pieces(spark):
    """Every level leaves three quarters of the chain or less (and some, as coins fall), so few levels do; paths are put together on the way."""
    pairs = [(f"k{i}", f"k{i + 1}") for i in range(150)]
    random.Random(4).shuffle(pairs)
    levels = []
    climb = H.climb
    H.climb = lambda *a, **k: (levels.append(1), climb(*a, **k))[1]
    try:
        tree = H.hierarchy(frame(spark, pairs), rows_per_task=30, with_parent=True)
        assert found(tree) == {f"k{i}": ("k0", i) for i in range(151)}
    finally:
        H.climb = climb
    assert len(levels) < 12
    for r in H.paths(tree, rows_per_task=60).collect():
        assert r.path == [f"k{i}" for i in range(r.depth + 1)]


@pytest.mark.parametrize("ways_per_task", [3, 10**6])
def test_ladder_of_several_parents(spark, ways_per_task):
    pairs = [("top", "a0"), ("top", "b0")] + [(f"{p}{i}", f"{c}{i + 1}") for i in range(4) for p in "ab" for c in "ab"] + [("b4", "leaf"), ("q", "q2"), ("q2", "q"), ("q", "a1")]
    links = frame(spark, pairs)
    whole = links.where("kind = 'contains'")
    ways = whole.groupBy("target").agg(H.F.count("*").alias("n")).where("n > 1").join(whole, "target").select(H.F.col("target").alias("head"), "source", H.F.col("source").alias("top"), H.F.lit(1).cast("bigint").alias("dist"), H.F.lit(False).alias("looped"))
    assert found(H.hierarchy(links)) == walk(pairs)
    assert {r.head: r.depth for r in H._join_heads(ways, ways_per_task).collect()} == {"a1": 1, "b1": 1} | {f"{x}{i}": i for x in "ab" for i in (2, 3, 4)}


def test_paths_and_descendants(spark):
    pairs = [("a", "b"), ("b", "c"), ("a", "d"), ("x", "x")]
    rows = {r.node_id: (r.path, r.descendants, r.depth) for r in H.with_descendants(frame(spark, pairs).where("kind = 'contains'")).collect()}
    assert rows == {"a": (["a"], 3, 0), "b": (["a", "b"], 1, 1), "c": (["a", "b", "c"], 0, 2), "d": (["a", "d"], 0, 1), "x": (None, 0, -1)}


def test_several_parents_without_cycle(spark):
    pairs = [("r", "a"), ("a", "b"), ("r", "m"), ("b", "m"), ("m", "leaf")]
    assert found(H.hierarchy(frame(spark, pairs))) == walk(pairs)


def below(pairs):
    """ancestor, node, fewest steps: a search from every id over all its links."""
    children = defaultdict(set)
    for s, t in pairs:
        if s is not None and t is not None:
            children[s].add(t)
    out = set()
    for start in list(children):
        seen, level, k = {start}, {start}, 0
        while level:
            level, k = {c for n in level for c in children.get(n, ())} - seen, k + 1
            seen |= level
            out |= {(start, n, k) for n in level}
    return out


@pytest.mark.parametrize("pairs", [[("r", "a"), ("r", "b"), ("b", "c"), ("a", "m"), ("c", "m"), ("m", "leaf")], dirty(1)])
def test_descendants_over_all_parents(spark, tmp_path, pairs):
    from graphloom.plans import links

    frame(spark, pairs).write.parquet(str(tmp_path / "edges.parquet"))
    want = below(pairs)
    rows = [tuple(r) for r in links.queries()["p3_descendants"](spark, str(tmp_path)).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    got = {r.node_id: r.descendants for r in links.queries()["p3_paths"](spark, str(tmp_path)).collect()}
    assert all(n == sum(a == i for a, *_ in want) for i, n in got.items()) and {a for a, *_ in want} <= set(got)


def test_empty(spark):
    assert H.hierarchy(frame(spark, [])).where("node_id <> 'x'").count() == 0
    assert H.paths(H.hierarchy(frame(spark, []), with_parent=True)).count() == 0
