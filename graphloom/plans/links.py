"""Queries on parent-child links and references, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import hierarchy, orphans
from graphloom.session import checkpoint_folder
from graphloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    checkpoint_folder(spark)
    return hierarchy.hierarchy(table(spark, folder, "edges"))


def p3_paths(spark: SparkSession, folder: str) -> DataFrame:
    checkpoint_folder(spark)
    found = hierarchy.with_descendants(table(spark, folder, "edges"))
    return found.select("node_id", "root_id", "depth", F.array_join("path", " > ").alias("path"), "descendants")


def p3_descendants(spark: SparkSession, folder: str) -> DataFrame:
    checkpoint_folder(spark)
    return hierarchy.descendants(table(spark, folder, "edges"))


def _orphans(spark: SparkSession, folder: str, **more: bool) -> DataFrame:
    checkpoint_folder(spark)
    return orphans.orphans(*(table(spark, folder, t) for t in ("edges", "nodes", "node_removals")), **more)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder, with_kind=False).distinct()


def p5_rates(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.orphan_rates(_orphans(spark, folder))


_CLIMB = """
WITH RECURSIVE links AS (SELECT DISTINCT source, target FROM edges WHERE kind = 'contains' AND source IS NOT NULL AND target IS NOT NULL),
ids AS (SELECT source AS id FROM links UNION SELECT target FROM links),
up AS (
  SELECT id, id AS here, [id] AS way, false AS circling FROM ids
  UNION ALL
  SELECT u.id, l.source, list_append(u.way, l.source), list_contains(u.way, l.source)
  FROM up u JOIN links l ON l.target = u.here WHERE NOT u.circling
),
caught AS (SELECT DISTINCT id FROM up WHERE circling),
tops AS (SELECT id, here, way FROM up WHERE NOT circling AND here NOT IN (SELECT target FROM links)),
best AS (SELECT id, max({'n': len(way), 'root': here, 'way': way}) AS b FROM tops WHERE id NOT IN (SELECT id FROM caught) GROUP BY id)
"""

_STATES = """
WITH ends AS (
  SELECT edge_id, kind, indexed_at, 'source' AS endpoint, source AS id FROM edges WHERE source IS NOT NULL
  UNION ALL SELECT edge_id, kind, indexed_at, 'target', target FROM edges WHERE target IS NOT NULL
),
life AS (
  SELECT DISTINCT id, updated_at AS at, 0 AS gone FROM nodes WHERE id IS NOT NULL
  UNION SELECT DISTINCT id, removed_at, 1 FROM node_removals WHERE id IN (SELECT id FROM nodes)
),
judged AS (
  SELECT e.edge_id, e.kind, e.indexed_at, e.endpoint,
         count(l.id) AS n, count(CASE WHEN l.at <= e.indexed_at THEN 1 END) AS before,
         max(CASE WHEN l.at <= e.indexed_at THEN l.at * 2 + l.gone END) % 2 AS gone
  FROM ends e LEFT JOIN life l ON l.id = e.id GROUP BY ALL
),
cases AS (
  SELECT edge_id, kind, indexed_at, endpoint,
         CASE WHEN n = 0 THEN 'missing' WHEN before = 0 THEN 'late' WHEN gone = 1 THEN 'deleted' END AS reason
  FROM judged
)
"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p3_found, p3_paths, p3_descendants, p5_found, p5_rates)}


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": _CLIMB
        + """SELECT i.id AS node_id, CASE WHEN c.id IS NOT NULL THEN 'cycle' ELSE b.b.root END AS root_id,
        CASE WHEN c.id IS NOT NULL THEN -1 ELSE b.b.n - 1 END AS depth
        FROM ids i LEFT JOIN caught c ON c.id = i.id LEFT JOIN best b ON b.id = i.id""",
        "p3_paths": _CLIMB
        + """, below AS (SELECT here AS id, count(DISTINCT id) AS n FROM up WHERE here <> id GROUP BY here)
        SELECT i.id AS node_id, CASE WHEN c.id IS NOT NULL THEN 'cycle' ELSE b.b.root END AS root_id,
        CASE WHEN c.id IS NOT NULL THEN -1 ELSE b.b.n - 1 END AS depth,
        CASE WHEN c.id IS NULL THEN array_to_string(list_reverse(b.b.way), ' > ') END AS path, coalesce(d.n, 0) AS descendants
        FROM ids i LEFT JOIN caught c ON c.id = i.id LEFT JOIN best b ON b.id = i.id LEFT JOIN below d ON d.id = i.id""",
        "p3_descendants": _CLIMB + "SELECT here AS ancestor_id, id AS node_id, min(len(way) - 1) AS steps FROM up WHERE here <> id GROUP BY here, id",
        "p5_found": _STATES + "SELECT DISTINCT edge_id, endpoint, reason FROM cases WHERE reason IS NOT NULL",
        "p5_rates": _STATES
        + """SELECT kind, strftime(epoch_ms(indexed_at), '%Y-%m') AS month, endpoint, reason, count(*) AS orphans
        FROM cases WHERE reason IS NOT NULL GROUP BY 1, 2, 3, 4""",
    }
