"""Problem 3: parent-child links to full hierarchies.

Each partition takes its links in pieces of bounded size and follows the chains
of a piece up to where they leave it (the fragment's exit); the exits and the
links between fragments form a smaller forest, which is solved in the same way,
and its answers are put in front of the fragments.  A chain that comes back to
itself inside a piece is a local cycle; one that runs through several shows up
in a smaller forest.

Links of the smaller forests are placed by a coin per id and level: a node that
shows tails goes where its parent is if that shows heads.  Nodes nobody hangs
below drop out, a quarter of the nodes with one child are joined with it, and
nodes with several children are fewer than the ends, so a forest shrinks to
three quarters or less whatever its shape, without any join.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut_lineage, in_batches

ROWS_PER_TASK = 150_000  # links that one task holds
WAYS_PER_TASK = 400_000  # ways into nodes with several parents that one task puts in order
FRAGMENT = "node string, top string, dist bigint, looped boolean"
LINK = ("node", "top", "dist", "looped")


def _climb(node: np.ndarray, top: np.ndarray, dist: np.ndarray, way: list | None = None) -> pd.DataFrame:
    """Follow links inside one partition: per node the exit, the distance to it, and whether the way up never ends (and the ids passed, if wanted)."""
    codes, names = pd.factorize(np.concatenate([node, top]))
    n, m = len(node), len(names)
    up = np.arange(m)
    far = np.zeros(m, dtype=np.int64)
    up[codes[:n]] = codes[n:]
    far[codes[:n]] = dist
    here = np.zeros(m, dtype=bool)
    here[codes[:n]] = True
    hops = here.astype(np.int64)
    for _ in range(max(1, math.ceil(math.log2(m + 1)))):
        if not here[up[codes[:n]]].any():
            break
        hops = hops + np.where(here[up], hops[up], 0)
        far = far + np.where(here[up], far[up], 0)
        up = np.where(here[up], up[up], up)
    at = codes[:n]
    looped = here[up[at]]
    out = pd.DataFrame({"node": node, "top": np.asarray(names, dtype=object)[up[at]], "dist": np.where(looped, -1, far[at]), "looped": looped})
    if way is not None:
        passed: list = [None] * m
        for i in np.argsort(np.where(looped, -1, hops[at]), kind="stable"):  # what is nearer to the exit comes first
            above = passed[codes[n + i]]
            passed[at[i]] = [] if looped[i] else [*above, *way[i]] if above is not None else list(way[i])
        out["way"] = [passed[c] for c in at]
    return out


def _fragments(rows_per_task: float, ways: bool):  # noqa: ANN202
    """A function for batches that solves its partition in pieces. Rows without a top (heads of several parents) pass through."""

    def solve(parts: list[pd.DataFrame]) -> pd.DataFrame:
        whole = pd.concat(parts, ignore_index=True)
        return _climb(whole["node"].to_numpy(dtype=object), whole["top"].to_numpy(dtype=object), whole["dist"].to_numpy(dtype=np.int64), list(whole["way"]) if ways else None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: list[pd.DataFrame] = []
        held = 0
        for b in batches:
            alone = b["top"].isna().to_numpy()
            if alone.any():
                yield b[alone]
                b = b[~alone]
            parts.append(b)
            held += len(b)
            if held >= rows_per_task:
                yield solve(parts)
                parts, held = [], 0
        if held:
            yield solve(parts)

    return run


def _coin(name: str, level: int) -> Column:
    return F.xxhash64(name, F.lit(level)) % 2 == 0


def climb(links: DataFrame, rows_per_task: int = ROWS_PER_TASK, ways: bool = False, level: int = 0) -> DataFrame:
    """node, top, dist, looped for links (node, top, dist, looped) of which each node has one; a null top stays as it is.

    ways: with the ids from below the top down to the node, as ``way``, which the links must have too.
    """
    schema = FRAGMENT + (", way array<string>" if ways else "")
    columns = [*LINK, "way"] if ways else [*LINK]
    fragments = cut_lineage(in_batches(links.select(*columns), _fragments(rows_per_task, ways), schema))
    exits = fragments.where("not looped and top is not null").select(F.col("top").alias("node")).distinct()
    between = fragments.where("top is not null").join(exits, "node", "left_semi")
    # What is on or below a local cycle stays there: a link to itself says so in the quotient.
    across = cut_lineage(between.withColumn("top", F.when(F.col("looped"), F.col("node")).otherwise(F.col("top"))))
    m = across.count()
    if not m:
        return fragments
    if m <= rows_per_task:
        quotient = in_batches(across.coalesce(1), _fragments(math.inf, ways), schema)
    else:
        key = F.when(_coin("node", level) & ~_coin("top", level), F.col("top")).otherwise(F.col("node"))
        # By range of key and node, so that a parent of very many is cut, too; what is cut is joined at a later level.
        placed = across.repartitionByRange(-(-m // rows_per_task), key, F.xxhash64("node"))
        quotient = cut_lineage(climb(placed, rows_per_task, ways, level + 1))
    above = quotient.select(F.col("node").alias("exit"), F.col("top").alias("further"), F.col("dist").alias("more"), F.col("looped").alias("endless"), *([F.col("way").alias("before")] if ways else []))
    whole = [F.concat(F.coalesce("before", F.array().cast("array<string>")), "way").alias("way")] if ways else []
    return fragments.join(above, F.col("top") == F.col("exit"), "left").select(
        "node",
        F.coalesce("further", "top").alias("top"),
        (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"),
        (F.col("looped") | F.coalesce("endless", F.lit(False))).alias("looped"),
        *whole,
    )


def _ways(tops: DataFrame, several: DataFrame) -> DataFrame:
    """head, source, top, dist, looped, known: for each parent of a head, where the way over it leads."""
    up = tops.select(F.col("node").alias("source"), "top", "dist", "looped", F.lit(True).alias("known"))
    return several.join(up, "source", "left").select(
        F.col("target").alias("head"),
        "source",
        F.coalesce("top", "source").alias("top"),
        (F.coalesce("dist", F.lit(0)) + 1).alias("dist"),
        F.coalesce("looped", F.lit(False)).alias("looped"),
        F.coalesce("known", F.lit(False)).alias("known"),
    )


HEAD = "head string, root string, depth bigint, cyclic boolean, parent string"


def _in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Heads of one partition in an order in which each comes after the heads above it; those that have none lie on or below a cycle."""
    ways = defaultdict(list)
    for b in batches:
        for head, *way in zip(b["head"], b["source"], b["top"], b["dist"].tolist(), b["looped"].tolist()):
            ways[head].append(way)
    below, waits = defaultdict(list), {}
    for head, several in ways.items():
        tops = {top for _, top, _, looped in several if not looped and top in ways}
        waits[head] = len(tops)
        for top in tops:
            below[top].append(head)
    solved: dict[str, tuple] = {}
    ready = [h for h, n in waits.items() if not n]
    while ready:
        head = ready.pop()
        best, bad = None, False
        for source, top, dist, looped in ways[head]:
            root, depth, cyclic, _ = solved.get(top, (top, 0, False, None))
            bad |= looped or cyclic
            best = max(best or (-1,), (dist + depth, root, source))
        solved[head] = ("", -1, True, None) if bad else (best[1], best[0], False, best[2])
        for h in below[head]:
            waits[h] -= 1
            if not waits[h]:
                ready.append(h)
    yield pd.DataFrame([(h, *solved.get(h, ("", -1, True, None))) for h in ways], columns=["head", "root", "depth", "cyclic", "parent"])


def _join_heads(ways: DataFrame, ways_per_task: int = WAYS_PER_TASK) -> DataFrame:
    """head, root, depth, cyclic, parent of nodes with several parents.

    As long as the ways that are open are too many for one task, rounds solve the heads that have no open head above
    them and put their answers into the other ways.
    """
    solved: list[DataFrame] = []
    open_ways = ways.select("head", "source", "top", "dist", "looped")
    while open_ways.count() > ways_per_task:
        waiting = open_ways.select(F.col("head").alias("top"), F.lit(True).alias("waits")).distinct()
        state = open_ways.join(waiting, "top", "left").withColumn("waits", F.coalesce("waits", F.lit(False)) & ~F.col("looped"))
        way = F.struct("dist", "top", "source")
        new = cut_lineage(
            state.groupBy("head").agg(F.max("waits").alias("waits"), F.max("looped").alias("cyclic"), F.max(way).alias("way")).where("cyclic or not waits")
            .select("head", F.when(F.col("cyclic"), "").otherwise(F.col("way.top")).alias("root"), F.when(F.col("cyclic"), F.lit(-1).cast("bigint")).otherwise(F.col("way.dist")).alias("depth"), "cyclic", F.when(~F.col("cyclic"), F.col("way.source")).alias("parent"))
        )
        if not new.limit(1).count():  # all that is left lies on or below a cycle
            solved.append(open_ways.select("head").distinct().select("head", F.lit("").alias("root"), F.lit(-1).cast("bigint").alias("depth"), F.lit(True).alias("cyclic"), F.lit(None).cast("string").alias("parent")))
            break
        solved.append(new)
        known = new.select(F.col("head").alias("top"), "root", F.col("depth").alias("more"), "cyclic")
        open_ways = cut_lineage(
            open_ways.join(new.select("head"), "head", "left_anti").join(known, "top", "left").select(
                "head", "source", F.when(F.col("cyclic"), F.col("top")).otherwise(F.coalesce("root", "top")).alias("top"),
                (F.col("dist") + F.when(F.col("more") > 0, F.col("more")).otherwise(0)).alias("dist"), (F.col("looped") | F.coalesce("cyclic", F.lit(False))).alias("looped"),
            )
        )
    else:
        solved.append(in_batches(open_ways.coalesce(1), _in_order, HEAD))
    out = solved[0]
    for part in solved[1:]:
        out = out.unionByName(part)
    return out


def hierarchy(edges: DataFrame, kind: str = "contains", rows_per_task: int = ROWS_PER_TASK, with_parent: bool = False) -> DataFrame:
    """node_id, root_id, depth (and parent_id) of every id that ends a link of the kind.

    Repeated links count once.  An id on a cycle or below one has root 'cycle', depth -1 and no parent.  A node with
    several parents that are on no cycle hangs below the one with the longest way up (of equal ones, that with the
    greatest root and id).  A null end makes no link, and its other end is a node nonetheless.
    """
    links = edges.where(F.col("kind") == kind).select("source", "target")
    whole = links.where(F.col("source").isNotNull() & F.col("target").isNotNull())
    per = whole.groupBy("target").agg(F.min("source").alias("parent"), F.max("source").alias("other"))
    one = F.when(F.col("parent") == F.col("other"), F.col("parent"))
    tops = cut_lineage(climb(per.select(F.col("target").alias("node"), one.alias("top"), F.lit(1).cast("bigint").alias("dist"), F.lit(False).alias("looped")), rows_per_task))
    head_ids = tops.where("top is null").select(F.col("node").alias("target"))
    tops = tops.where("top is not null")
    several = whole.join(head_ids, "target", "left_semi").distinct()
    ways = cut_lineage(_ways(tops, several))
    heads = cut_lineage(_join_heads(ways))
    roots = (
        tops.where("not looped").select(F.col("top").alias("node"))
        .unionByName(ways.where("not known").select(F.col("source").alias("node")))
        .distinct().join(head_ids.select(F.col("target").alias("node")), "node", "left_anti")
    )
    # The other ends of links with a null end that nothing else mentions.
    ends = links.where(F.col("source").isNull() != F.col("target").isNull()).select(F.coalesce("source", "target").alias("node")).distinct()
    if ends.limit(1).count():
        known = tops.select("node").unionByName(head_ids.select(F.col("target").alias("node"))).unionByName(roots)
        roots = roots.unionByName(ends.join(known, "node", "left_anti"))
    placed = (
        tops.unionByName(roots.select("node", F.col("node").alias("top"), F.lit(0).cast("bigint").alias("dist"), F.lit(False).alias("looped")))
        .unionByName(head_ids.select(F.col("target").alias("node"), F.col("target").alias("top"), F.lit(0).cast("bigint").alias("dist"), F.lit(False).alias("looped")))
    )
    final = placed.join(heads, F.col("top") == F.col("head"), "left")
    cyclic = F.col("looped") | F.coalesce("cyclic", F.lit(False))
    found = final.select(
        F.col("node").alias("node_id"),
        F.when(cyclic, F.lit("cycle")).otherwise(F.coalesce("root", "top")).alias("root_id"),
        F.when(cyclic, F.lit(-1).cast("bigint")).otherwise(F.col("dist") + F.coalesce("depth", F.lit(0).cast("bigint"))).alias("depth"),
        F.when(~cyclic & (F.col("node") == F.col("head")), F.col("parent")).alias("chosen"),
    )
    if not with_parent:
        return found.drop("chosen")
    own = per.select(F.col("target").alias("t"), one.alias("own"))
    return found.join(own, F.col("node_id") == F.col("t"), "left").select(
        "node_id", "root_id", "depth", F.when(F.col("depth") >= 0, F.coalesce("chosen", "own")).alias("parent_id")
    )


def paths(tree: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """node_id, root_id, depth, path from the rows of ``hierarchy`` with parents: ids from the root down, put together from the paths of fragments.

    Ids on or below a cycle have a null path.
    """
    tree = cut_lineage(tree)
    links = tree.where("parent_id is not null").select(F.col("node_id").alias("node"), F.col("parent_id").alias("top"), F.lit(1).cast("bigint").alias("dist"), F.lit(False).alias("looped"), F.array("node_id").alias("way"))
    below = climb(links, rows_per_task, ways=True).select(F.col("node").alias("node_id"), F.concat(F.array("top"), "way").alias("way"))
    return tree.join(below, "node_id", "left").select(
        "node_id", "root_id", "depth", "parent_id", F.when(F.col("depth") >= 0, F.coalesce("way", F.array("node_id"))).alias("path")
    )


def _shortest(pairs: DataFrame, *key: str) -> DataFrame:
    return pairs.groupBy(*key).agg(F.min("steps").alias("steps"))


def descendants_of(placed: DataFrame, edges: DataFrame, kind: str = "contains") -> DataFrame:
    """ancestor_id, node_id, steps (the fewest) from the rows of ``paths``: every id and all others below it over any of their parents, through cycles too.

    Paths give the pairs of the tree without a shuffle.  The links that the tree leaves out (further parents, and all
    into ids on or below a cycle) are closed among themselves by doubling, and their pairs are met with those of the
    tree for the ids below them only.  No id is below itself.  As many rows as there are such pairs.
    """
    own = placed.select("node_id", "parent_id", F.coalesce("path", F.array("node_id")).alias("path"))
    links = edges.where(F.col("kind") == kind).where("source is not null and target is not null and source <> target").select("source", "target").distinct()
    left_out = cut_lineage(links.join(own.select(F.col("node_id").alias("target"), "parent_id"), "target").where("parent_id is null or parent_id <> source").select("source", "target"))
    inside = own.select("node_id", F.posexplode(F.reverse("path")).alias("steps", "ancestor_id")).withColumn("steps", F.col("steps").cast("bigint"))
    if not left_out.limit(1).count():
        return inside.where("steps > 0").select("ancestor_id", "node_id", "steps")
    # Tables of known size, so that where they are small the paths need not be shuffled to meet them.
    targets = cut_lineage(left_out.select(F.col("target").alias("ancestor_id")).distinct())
    sources = cut_lineage(left_out.select(F.col("source").alias("node_id")).distinct())
    above = own.join(sources, "node_id", "left_semi").select(F.col("node_id").alias("source"), F.posexplode(F.reverse("path")).alias("steps", "ancestor_id"))
    into = cut_lineage(_shortest(left_out.join(above, "source").select("ancestor_id", "target", (F.col("steps") + 1).cast("bigint").alias("steps")), "ancestor_id", "target"))
    # From target to target, each time over one link that the tree leaves out; then over 2, 4, ...
    closed = cut_lineage(into.join(targets, "ancestor_id", "left_semi"))
    while True:
        far = closed.select("ancestor_id", F.col("target").alias("mid"), F.col("steps").alias("first")).join(closed.select(F.col("ancestor_id").alias("mid"), "target", F.col("steps").alias("then")), "mid")
        more = cut_lineage(_shortest(far.select("ancestor_id", "target", (F.col("first") + F.col("then")).alias("steps")).unionByName(closed), "ancestor_id", "target"))
        same = more.join(closed, ["ancestor_id", "target", "steps"], "left_anti").limit(1).count() == 0
        closed = more
        if same:
            break
    beyond = into.join(closed.select(F.col("ancestor_id").alias("mid"), F.col("target").alias("further"), F.col("steps").alias("then")), F.col("target") == F.col("mid"))
    all_into = cut_lineage(_shortest(into.unionByName(beyond.select("ancestor_id", F.col("further").alias("target"), (F.col("steps") + F.col("then")).alias("steps"))), "ancestor_id", "target"))
    under = cut_lineage(inside.join(targets, "ancestor_id", "left_semi").select(F.col("ancestor_id").alias("target"), "node_id", F.col("steps").alias("then")))
    touched = cut_lineage(under.select("node_id").distinct())
    further = all_into.join(under, "target").where("ancestor_id <> node_id").select("ancestor_id", "node_id", (F.col("steps") + F.col("then")).alias("steps"))
    tree_pairs = lambda rows: rows.select("node_id", F.posexplode(F.reverse("path")).alias("steps", "ancestor_id")).where("steps > 0").select("ancestor_id", "node_id", F.col("steps").cast("bigint").alias("steps"))
    both = _shortest(further.unionByName(tree_pairs(own.join(touched, "node_id", "left_semi"))), "ancestor_id", "node_id")
    return tree_pairs(own.join(touched, "node_id", "left_anti")).unionByName(both)


def descendants(edges: DataFrame, kind: str = "contains") -> DataFrame:
    """The pairs of ``descendants_of`` from the links alone."""
    return descendants_of(cut_lineage(paths(hierarchy(edges, kind, with_parent=True))), edges, kind)


def with_descendants(edges: DataFrame, kind: str = "contains") -> DataFrame:
    """node_id, root_id, depth, path and descendants (the number of ids below, over all parents)."""
    placed = cut_lineage(paths(hierarchy(edges, kind, with_parent=True)))
    counts = descendants_of(placed, edges, kind).groupBy(F.col("ancestor_id").alias("node_id")).agg(F.count("*").alias("descendants"))
    return placed.join(counts, "node_id", "left").select("node_id", "root_id", "depth", "path", F.coalesce("descendants", F.lit(0).cast("bigint")).alias("descendants"))
