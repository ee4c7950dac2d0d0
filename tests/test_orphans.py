"""Orphan references against a plain look-up, with hot keys, ties, nulls and odd strings."""

import random

import pytest

from graphloom.operators import orphans as O

EDGES = "edge_id bigint, source string, target string, kind string, indexed_at bigint, id string"


def plain(edges, nodes, removals):
    seen, life = set(), {}
    for i, at in nodes:
        seen.add(i)
        life.setdefault(i, []).append((at if at is not None else 10**30, 0))
    for i, at in removals:
        if at is not None:
            life.setdefault(i, []).append((at, 1))
    out = set()
    for e, s, t, _, when, _ in edges:
        for end, i in (("source", s), ("target", t)):
            if i is None:
                continue
            up_to = sorted(x for x in life.get(i, []) if x[0] <= (when if when is not None else -(10**30)))
            if i not in seen:
                out.add((e, end, "missing"))
            elif not up_to:
                out.add((e, end, "late"))
            elif up_to[-1][1]:
                out.add((e, end, "deleted"))
    return out


@pytest.mark.parametrize(("events", "references", "hashed"), [(5, 20, O.F.xxhash64), (10**6, 10**6, O.F.xxhash64), (30, 100, O.F.length)])
def test_random(spark, monkeypatch, events, references, hashed):
    """The last case gives all ids of one length the same hash."""
    monkeypatch.setattr(O, "EVENTS_PER_RANGE", events)
    rng = random.Random(9)
    ids = ["", "a", "a\x00", "é", "é", "日本", "A", "hot", *(f"k{i}" for i in range(40))]
    nodes = [(rng.choice(ids), rng.randrange(50)) for _ in range(70)] + [("k1", 3), ("k1", 3), (None, 5), ("k2", None)]
    removals = [(rng.choice(ids), rng.randrange(50)) for _ in range(40)] + [("ghost", 4), (None, 1), ("k3", None), ("k1", 3)]
    edges = [(i, rng.choice([*ids, "hot", "hot", None, "never"]), "hot" if i % 3 == 0 else rng.choice(ids), rng.choice(["calls", None]), rng.choice([None, *range(50)]), "other") for i in range(300)]
    got = O.orphans(
        spark.createDataFrame(edges, EDGES).repartition(3),
        spark.createDataFrame(nodes, "id string, updated_at bigint").repartition(3),
        spark.createDataFrame(removals, "id string, removed_at bigint"),
        events,
        references,
        hashed=hashed,
    ).collect()
    assert {(r.edge_id, r.endpoint, r.reason) for r in got} == plain(edges, nodes, removals)


def test_empty(spark):
    e, n, r = spark.createDataFrame([], EDGES), spark.createDataFrame([], "id string, updated_at bigint"), spark.createDataFrame([], "id string, removed_at bigint")
    assert O.orphans(e, n, r).count() == 0
    one = spark.createDataFrame([(1, "a", "b", "calls", 5, None)], EDGES)
    assert {(x.endpoint, x.reason) for x in O.orphans(one, n, r).collect()} == {("source", "missing"), ("target", "missing")}
    assert O.orphan_rates(O.orphans(one, n, r)).collect()[0]["month"] == "1970-01"
