"""The model's words and lists, staleness, episodes and communities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import codecs
from graphloom.operators import learned, resolve
from graphloom.plans.base import NOW, Registry, Tables

R = Registry()


@R.query(
    f"""WITH {NOW} SELECT id, CASE WHEN kind IN ('file', 'module', 'class', 'struct', 'interface', 'trait', 'protocol', 'function', 'method', 'property', 'field', 'variable', 'constant', 'enum', 'enum_member',
'type_alias', 'namespace', 'parameter', 'import', 'export', 'route', 'component') THEN kind ELSE 'file' END AS kind,
CASE WHEN visibility IN ('public', 'private', 'protected', 'internal') THEN visibility END AS visibility, coalesce(len(decorators), 0) AS decorators FROM now"""
)
def decoded_nodes(t: Tables) -> DataFrame:
    kept = codecs.list_of(codecs.list_text(F.col("decorators")))
    return t.now.select("id", codecs.node_kind(F.col("kind")).alias("kind"), codecs.visibility(F.col("visibility")).alias("visibility"), F.when(kept.isNull(), 0).otherwise(F.size(kept)).cast("bigint").alias("decorators"))


@R.query(
    """SELECT edge_id, CASE WHEN kind IN ('contains', 'calls', 'imports', 'exports', 'extends', 'implements', 'references', 'type_of', 'returns', 'instantiates', 'overrides', 'decorates') THEN kind ELSE 'contains' END AS kind,
CASE WHEN provenance IN ('tree-sitter', 'scip', 'heuristic') THEN provenance ELSE 'tree-sitter' END AS provenance, metadata.confidence AS confidence, metadata.via AS via FROM edges"""
)
def decoded_edges(t: Tables) -> DataFrame:
    told = codecs.metadata_of(codecs.metadata_text(F.col("metadata")))
    return t.edges.select("edge_id", codecs.edge_kind(F.col("kind")).alias("kind"), codecs.provenance(F.col("provenance")).alias("provenance"), told["confidence"].alias("confidence"), told["via"].alias("via"))


@R.query(
    f"""WITH {NOW}, f AS (SELECT path, max(modified_at) AS modified_at FROM files WHERE path IS NOT NULL GROUP BY path)
SELECT n.id, 1 AS files, f.modified_at AS changed FROM now n LEFT JOIN f ON f.path = n.file_path WHERE n.file_path IS NOT NULL AND (f.path IS NULL OR f.modified_at > n.updated_at)"""
)
def stale_nodes(t: Tables) -> DataFrame:
    n = t.now.select("id", F.col("file_path").alias("path"), F.col("updated_at").alias("written_at"))
    return learned.stale(n.select("id", "written_at"), n.select("id", "path"), t.files)


@R.query("SELECT event_id, user_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS episode FROM events")
def event_episodes(t: Tables) -> DataFrame:
    return learned.episodes(t.events.select("event_id", "user_id", "ts", "event_type"), "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "user_id", "episode")


_ROUND = """l{1} AS (SELECT a AS id, community FROM (SELECT v.*, row_number() OVER (PARTITION BY a ORDER BY n DESC, community) AS k FROM (
SELECT b.a, l.community, count(*) AS n FROM both_ways b JOIN l{0} l ON l.id = b.b GROUP BY 1, 2) v) WHERE k = 1)"""


@R.query(
    "WITH one AS (SELECT source AS a, target AS b FROM edges WHERE kind = 'calls' AND source IS NOT NULL AND target IS NOT NULL AND source <> target), both_ways AS (SELECT a, b FROM one UNION SELECT b, a FROM one), "
    "l0 AS (SELECT DISTINCT a AS id, a AS community FROM both_ways), " + ", ".join(_ROUND.format(k, k + 1) for k in range(3)) + " SELECT id, community FROM l3"
)
def call_communities(t: Tables) -> DataFrame:
    return learned.communities(t.edges.where("kind = 'calls'").select(F.col("source").alias("a"), F.col("target").alias("b")), 3)


@R.query()
def resolve_stats(t: Tables) -> DataFrame:
    """References in all, resolved and by which rule (of the stored references)."""
    found = resolve.resolve(t.unresolved_refs, t.now, t.files, t.file_content)
    by = t.unresolved_refs.select("ref_id").join(found.select("ref_id", "resolved_by"), "ref_id", "left")
    return by.groupBy(F.coalesce("resolved_by", F.lit("none")).alias("resolved_by")).agg(F.count("*").alias("n"))
