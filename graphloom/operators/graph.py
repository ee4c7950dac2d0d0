"""Graph operators on nodes and edges: level by level, each level one join and one anti join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import names
from graphloom.session import cut_lineage

# Kinds of edges that calls, type hierarchies and random walks follow.
CALL_KINDS = ("calls", "references", "imports", "instantiates")
TYPE_KINDS = ("extends", "implements")
WALK_KINDS = ("calls", "references", "imports", "instantiates", "extends", "implements", "overrides", "type_of", "returns")


def in_force(nodes: DataFrame) -> DataFrame:
    """One row per id: the one written last (of equal times, the one with the later end and the greater docstring)."""
    order = F.struct("updated_at", F.coalesce("end_line", F.lit(-1)), F.coalesce("docstring", F.lit("")))
    rest = [c for c in nodes.columns if c != "id"]
    best = nodes.where("id is not null").groupBy("id").agg(F.max_by(F.struct(*rest), order).alias("row"))
    return best.select("id", *(F.col(f"row.{c}").alias(c) for c in rest))


def of_kinds(edges: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Edges of some kinds; no kinds means all."""
    return edges.where(F.col("kind").isin(*kinds)) if kinds else edges


def adjacent(edges: DataFrame, ids: DataFrame, direction: str = "out", kinds: Sequence[str] = ()) -> DataFrame:
    """Edges at the given ids (column id), with that end as ``at`` and the other as ``other``; 'both' lists outgoing and incoming."""
    chosen = of_kinds(edges, kinds)
    out = chosen.withColumn("at", F.col("source")).withColumn("other", F.col("target"))
    into = chosen.withColumn("at", F.col("target")).withColumn("other", F.col("source"))
    ways = {"out": out, "in": into, "both": out.unionByName(into)}[direction]
    return ways.join(ids.select(F.col("id").alias("at")).distinct(), "at", "left_semi")


def reach(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, depth: int, direction: str = "out", kinds: Sequence[str] = (), node_kinds: Sequence[str] = ()) -> DataFrame:
    """seed, node_id, depth of all nodes within ``depth`` steps of each seed (column id), at their least depth.

    Ends that are no node are left out; the seed itself is there at depth 0.  node_kinds limits the neighbours, not the
    seeds.  Unknown seeds give nothing.
    """
    known = nodes.select("id", "kind").where(F.col("kind").isin(*node_kinds)).select("id") if node_kinds else nodes.select("id")
    chosen = of_kinds(edges, kinds).where("source is not null and target is not null")
    out, into = chosen.select(F.col("source").alias("a"), F.col("target").alias("b")), chosen.select(F.col("target").alias("a"), F.col("source").alias("b"))
    steps = {"out": out, "in": into, "both": out.unionByName(into)}[direction].distinct().join(known, F.col("b") == F.col("id"), "left_semi")
    steps = cut_lineage(steps) if depth > 1 else steps
    seen = seeds.join(nodes.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("seed"), F.col("id").alias("node_id"), F.lit(0).alias("depth"))
    seen = level = cut_lineage(seen.distinct())
    for k in range(1, depth + 1):
        level = level.join(steps, F.col("node_id") == F.col("a")).select("seed", F.col("b").alias("node_id"), F.lit(k).alias("depth")).distinct()
        level = level.join(seen.select("seed", "node_id"), ["seed", "node_id"], "left_anti")
        if k < depth:
            level = cut_lineage(level)
            if not level.limit(1).count():
                return seen
        seen = seen.unionByName(level)
    return seen


def shortest_path(edges: DataFrame, nodes: DataFrame, start: str, end: str, kinds: Sequence[str] = ()) -> list[str] | None:
    """Ids from start to end along outgoing edges, or None; of equal ways the one over the least (kind, edge_id) back from the end."""
    known = nodes.select("id").distinct()
    if known.where(F.col("id").isin(start, end)).count() < len({start, end}):
        return None
    if start == end:
        return [start]
    spark = edges.sparkSession
    chosen = of_kinds(edges, kinds).join(known, F.col("target") == F.col("id"), "left_semi").select("edge_id", "source", "target", "kind")
    seen = level = spark.createDataFrame([(start,)], "node_id string")
    parents: DataFrame | None = None
    while True:
        found = chosen.join(level, F.col("source") == F.col("node_id")).drop("node_id").join(seen, F.col("target") == F.col("node_id"), "left_anti")
        best = cut_lineage(found.groupBy("target").agg(F.min(F.struct("kind", "edge_id", "source")).alias("p")).select(F.col("target").alias("node_id"), F.col("p.source").alias("parent")))
        if not best.limit(1).count():
            return None
        parents = best if parents is None else parents.unionByName(best)
        if best.where(F.col("node_id") == end).count():
            way = [end]
            while way[-1] != start:
                way.append(parents.where(F.col("node_id") == way[-1]).first()["parent"])
            return way[::-1]
        seen, level = seen.unionByName(best.select("node_id")), best.select("node_id")  # each level is a table already


def closure(links: DataFrame) -> DataFrame:
    """start, reached: the pairs that links (a, b) connect in one step or more, by doubling; cycles end when nothing is new."""
    seen = cut_lineage(links.select(F.col("a").alias("start"), F.col("b").alias("reached")).where("start is not null and reached is not null").distinct())
    fresh = seen
    while True:
        further = fresh.select("start", F.col("reached").alias("mid")).join(seen.select(F.col("start").alias("mid"), "reached"), "mid").select("start", "reached").distinct()
        fresh = cut_lineage(further.join(seen, ["start", "reached"], "left_anti"))
        if not fresh.limit(1).count():
            return seen
        seen = seen.unionByName(fresh)


def type_hierarchy(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """type_id, relation ('ancestor' or 'descendant'), other_id for all types, over extends and implements."""
    known = nodes.select("id").distinct()
    up = of_kinds(edges, TYPE_KINDS).join(known, F.col("source") == F.col("id"), "left_semi").join(known, F.col("target") == F.col("id"), "left_semi")
    pairs = closure(up.select(F.col("source").alias("a"), F.col("target").alias("b"))).where("start <> reached")
    above = pairs.select(F.col("start").alias("type_id"), F.lit("ancestor").alias("relation"), F.col("reached").alias("other_id"))
    return above.unionByName(pairs.select(F.col("reached").alias("type_id"), F.lit("descendant").alias("relation"), F.col("start").alias("other_id")))


def edges_between(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges both ends of which are among the ids."""
    chosen = ids.select("id").distinct()
    return edges.join(chosen, F.col("source") == F.col("id"), "left_semi").join(chosen, F.col("target") == F.col("id"), "left_semi")


def dependents(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """file_path, dependent: files with an edge, other than contains, into another file."""
    where = nodes.select("id", "file_path")
    src, tgt = where.select(F.col("id").alias("source"), F.col("file_path").alias("dependent")), where.select(F.col("id").alias("target"), "file_path")
    return edges.where("kind <> 'contains'").join(src, "source").join(tgt, "target").where("dependent <> file_path").select("file_path", "dependent").distinct()


def dominant_files(edges: DataFrame, nodes: DataFrame, least: int = 20, top: int = 20) -> DataFrame:
    """Of the ``top`` files with most inner edges, those that are neither tests nor generated and have ``least`` or more: rank, file_path, edges."""
    where = nodes.select("id", "file_path")
    src, tgt = where.select(F.col("id").alias("source"), "file_path"), where.select(F.col("id").alias("target"), F.col("file_path").alias("there"))
    inner = edges.select("source", "target").join(src, "source").join(tgt, "target").where("file_path = there").groupBy("file_path").agg(F.count("*").alias("edges"))
    best = inner.orderBy(F.desc("edges"), "file_path").limit(top).where(~names.is_low_value(F.col("file_path")) & (F.col("edges") >= least))
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("edges"), "file_path"))).select("rank", "file_path", "edges")


def random_walk(edges: DataFrame, ids: DataFrame, seeds: DataFrame, alpha: float = 0.25, rounds: int = 25, kinds: Sequence[str] = WALK_KINDS) -> DataFrame:
    """node_id, mass of a random walk with restart on the undirected multigraph among ids.

    Each round a node passes its mass to its neighbours by the number of edges, a node without any keeps it, and a share
    alpha starts again at the seeds (at all nodes if no seed is among them).
    """
    nodes = cut_lineage(ids.select(F.col("id").alias("node_id")).distinct())
    among = edges_between(of_kinds(edges, kinds), ids).where("source <> target").select("source", "target")
    both = among.unionByName(among.select(F.col("target").alias("source"), F.col("source").alias("target")))
    weights = both.groupBy("source", "target").agg(F.count("*").alias("w"))
    degree = weights.groupBy("source").agg(F.sum("w").alias("d"))
    alone = nodes.join(degree.select(F.col("source").alias("node_id")), "node_id", "left_anti")
    still = alone.select(F.col("node_id").alias("source"), F.col("node_id").alias("target"), F.lit(1.0).alias("p"))
    moves = cut_lineage(weights.join(degree, "source").select("source", "target", (F.col("w") / F.col("d")).alias("p")).unionByName(still))
    # Kept by source for all rounds, so that a round shuffles the mass that moves and nothing else.
    moves = moves.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions") or 200), "source").persist()
    started = nodes.join(seeds.select(F.col("id").alias("node_id")).distinct(), "node_id", "left_semi")
    n = started.count()
    start = cut_lineage((started if n else nodes).withColumn("mass", F.lit(1.0 / (n or max(1, nodes.count())))))
    again = start.select("node_id", (F.lit(alpha) * F.col("mass")).alias("mass"))
    mass = start
    for k in range(rounds):
        moved = mass.join(moves, F.col("node_id") == F.col("source")).select(F.col("target").alias("node_id"), (F.lit(1 - alpha) * F.col("mass") * F.col("p")).alias("mass"))
        mass = moved.unionByName(again).groupBy("node_id").agg(F.sum("mass").alias("mass"))
        if k % 5 == 4 or k == rounds - 1:
            mass = cut_lineage(mass)
    moves.unpersist()
    return nodes.join(mass, "node_id", "left").select("node_id", F.coalesce("mass", F.lit(0.0)).alias("mass"))
