"""Queries on scans, predicates, joins, aggregations and traversals of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import names
from graphloom.operators import graph, ranking
from graphloom.plans.base import NOW, PATHS, Registry, Tables

R = Registry()
SEED_SQL = "seeds AS (SELECT {end} AS id FROM edges WHERE kind = 'calls' AND {end} IN (SELECT id FROM nodes) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5)"


def _seeds(t: Tables, end: str) -> DataFrame:
    """The five nodes with most calls into (target) or out of (source) them: a top-k."""
    calls = t.edges.where("kind = 'calls'").groupBy(F.col(end).alias("id")).agg(F.count("*").alias("n"))
    return calls.join(t.nodes.select("id").distinct(), "id", "left_semi").orderBy(F.desc("n"), "id").limit(5).select("id")


@R.query(f"WITH {NOW} SELECT (SELECT count(*) FROM now) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(DISTINCT path) FROM files) AS files, (SELECT count(*) FROM unresolved_refs) AS refs")
def stats(t: Tables) -> DataFrame:
    one = lambda df, c, name: df.agg(c.cast("bigint").alias(name)).withColumn("one", F.lit(1))
    parts = [one(t.nodes, F.countDistinct("id"), "nodes"), one(t.edges, F.count("*"), "edges"), one(t.files, F.countDistinct("path"), "files"), one(t.unresolved_refs, F.count("*"), "refs")]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "one")
    return out.drop("one")


@R.query(f"WITH {NOW} SELECT kind, count(*) AS n FROM now GROUP BY kind")
def node_counts_by_kind(t: Tables) -> DataFrame:
    return t.now.groupBy("kind").agg(F.count("*").alias("n"))


@R.query(f"WITH {NOW} SELECT id, kind || ':' || substr(sha256(file_path || ':' || kind || ':' || name || ':' || start_line), 1, 32) AS computed FROM now WHERE kind IN ('function', 'method') AND file_path IS NOT NULL AND name IS NOT NULL AND start_line IS NOT NULL")
def node_id_hash(t: Tables) -> DataFrame:
    n = t.now.where("kind in ('function', 'method') and file_path is not null and name is not null and start_line is not null")
    return n.select("id", names.node_id(F.col("file_path"), F.col("kind"), F.col("name"), F.col("start_line")).alias("computed"))


@R.query(
    r"""WITH a AS (SELECT DISTINCT name FROM nodes WHERE name IS NOT NULL),
b AS (SELECT name, list_filter(string_split(regexp_replace(lower(regexp_replace(regexp_replace(name, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')), '[^a-z0-9]', ' ', 'g'), ' '), lambda x: length(x) >= 2) AS parts FROM a)
SELECT name, CASE WHEN len(parts) <= 1 THEN '' ELSE array_to_string(parts, ' ') END AS split, lower(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')) AS token, regexp_matches(name, '[_0-9]|^.+[A-Z]') AS is_distinctive FROM b"""
)
def name_parts(t: Tables) -> DataFrame:
    n = t.nodes.where("name is not null").select("name").distinct()
    return n.select("name", names.camel_split(F.col("name")).alias("split"), names.normalized(F.col("name")).alias("token"), names.is_distinctive(F.col("name")).alias("is_distinctive"))


def _sql_regex(pattern: str) -> str:
    return pattern.replace("'", "''")


@R.query(
    f"""WITH {PATHS} SELECT path,
regexp_matches(path, '{_sql_regex(names.TEST_NAME)}') OR regexp_matches(path, '{names.TEST_CAMEL}') OR regexp_matches(path, '{names.TEST_DIR}') OR regexp_matches(path, '{names.TEST_CAMEL_DIR}') OR regexp_matches(path, '{names.SIDE_DIR}') AS is_test,
regexp_matches(path, '{names.GENERATED}') AS is_generated, regexp_matches(path, '{names.LOW_VALUE}') OR regexp_matches(path, '{names.GENERATED}') AS is_low_value,
regexp_extract(path, '[^/]*$') AS base, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM paths"""
)
def file_flags(t: Tables) -> DataFrame:
    p = F.col("path")
    return t.files.where("path is not null").select("path").distinct().select(
        "path", names.is_test(p).alias("is_test"), names.is_generated(p).alias("is_generated"), names.is_low_value(p).alias("is_low_value"), names.base_name(p).alias("base"), names.directory(p).alias("dir")
    )


@R.query(f"""WITH {PATHS} SELECT path, CASE lower(regexp_extract(path, '\\.([^./]+)$', 1)) {" ".join(f"WHEN '{e}' THEN '{k}'" for k, v in names.LANGUAGE_EXTENSIONS.items() for e in v.split())} ELSE 'unknown' END AS language FROM paths""")
def file_languages(t: Tables) -> DataFrame:
    return t.files.where("path is not null").select("path").distinct().select("path", names.language(F.col("path")).alias("language"))


@R.query("SELECT DISTINCT repo, language, sum(n) AS files, sum(size) AS bytes FROM (SELECT string_split(path, '/')[1] AS repo, language, 1 AS n, max(size) AS size FROM files GROUP BY path, language) GROUP BY repo, language")
def files_by_repo(t: Tables) -> DataFrame:
    one = t.files.groupBy("path", "language").agg(F.max("size").alias("size"))
    return one.groupBy(F.substring_index("path", "/", 1).alias("repo"), "language").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@R.query(f"WITH {NOW}, hot AS (SELECT name FROM now WHERE name IS NOT NULL GROUP BY name ORDER BY count(*) DESC, name LIMIT 3) SELECT id, name, file_path FROM now WHERE name IN (SELECT name FROM hot)")
def exact_name(t: Tables) -> DataFrame:
    n = t.now
    hot = n.where("name is not null").groupBy("name").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "name").limit(3)
    return n.join(F.broadcast(hot.select("name")), "name", "left_semi").select("id", "name", "file_path")


@R.query(f"WITH {NOW} SELECT id, name, kind, CASE WHEN lower(name) = 'ledger' THEN 1.0 WHEN lower(name) LIKE 'ledger%' THEN 0.9 WHEN lower(name) LIKE '%ledger%' THEN 0.8 ELSE 0.7 END AS score FROM now WHERE lower(name) LIKE '%ledger%' OR lower(qualified_name) LIKE '%ledger%'")
def like_search(t: Tables) -> DataFrame:
    from graphloom.operators.search import like

    return like(t.now, "ledger").select("id", "name", "kind", "score")


@R.query(f"WITH {NOW} SELECT id, name FROM now WHERE lower(name) LIKE '%cursor%' AND lower(name) NOT LIKE 'cursor%' AND kind IN ('function', 'method', 'class')")
def substring_search(t: Tables) -> DataFrame:
    from graphloom.operators.search import substring

    return substring(t.now.where(F.col("kind").isin("function", "method", "class")), "cursor", not_prefix=True).select("id", "name")


@R.query("WITH " + SEED_SQL.format(end="target") + " SELECT edge_id, source, target, kind FROM edges WHERE target IN (SELECT id FROM seeds)")
def incoming(t: Tables) -> DataFrame:
    return graph.adjacent(t.edges, _seeds(t, "target"), "in").select("edge_id", "source", "target", "kind")


@R.query("WITH " + SEED_SQL.format(end="source") + " SELECT edge_id, source, target, kind FROM edges WHERE source IN (SELECT id FROM seeds)")
def outgoing(t: Tables) -> DataFrame:
    return graph.adjacent(t.edges, _seeds(t, "source"), "out").select("edge_id", "source", "target", "kind")


def _reach_sql(end: str, depth: int, step: str) -> str:
    return f"""WITH RECURSIVE {SEED_SQL.format(end=end)}, ids AS (SELECT DISTINCT id FROM nodes),
steps AS ({step}),
walk AS (SELECT id AS seed, id AS node_id, 0 AS depth FROM seeds UNION SELECT w.seed, s.b, w.depth + 1 FROM walk w JOIN steps s ON s.a = w.node_id WHERE w.depth < {depth})
SELECT seed, node_id, min(depth) AS depth FROM walk GROUP BY seed, node_id"""


_CALLS = "kind IN ('calls', 'references', 'imports', 'instantiates')"


@R.query(_reach_sql("target", 2, f"SELECT DISTINCT target AS a, source AS b FROM edges WHERE {_CALLS} AND source IN (SELECT id FROM ids)"))
def callers_d2(t: Tables) -> DataFrame:
    return graph.reach(t.edges, t.nodes, _seeds(t, "target"), 2, "in", graph.CALL_KINDS)


@R.query(_reach_sql("source", 2, f"SELECT DISTINCT source AS a, target AS b FROM edges WHERE {_CALLS} AND target IN (SELECT id FROM ids)"))
def callees_d2(t: Tables) -> DataFrame:
    return graph.reach(t.edges, t.nodes, _seeds(t, "source"), 2, "out", graph.CALL_KINDS)


@R.query(_reach_sql("source", 5, "SELECT DISTINCT source AS a, target AS b FROM edges WHERE target IN (SELECT id FROM ids)"))
def reach_levels(t: Tables) -> DataFrame:
    return graph.reach(t.edges, t.nodes, _seeds(t, "source"), 5)


@R.query(
    f"""WITH RECURSIVE {NOW}, kinds AS (SELECT id FROM now WHERE kind IN ('function', 'method')), {SEED_SQL.format(end="target")},
steps AS (SELECT DISTINCT target AS a, source AS b FROM edges UNION SELECT DISTINCT source, target FROM edges),
walk AS (SELECT id AS seed, id AS node_id, 0 AS depth FROM seeds UNION SELECT w.seed, s.b, w.depth + 1 FROM walk w JOIN steps s ON s.a = w.node_id WHERE w.depth < 2 AND s.b IN (SELECT id FROM kinds))
SELECT seed, node_id, min(depth) AS depth FROM walk GROUP BY seed, node_id"""
)
def neighbourhood(t: Tables) -> DataFrame:
    return graph.reach(t.edges, t.now, _seeds(t, "target"), 2, "both", node_kinds=("function", "method"))


@R.query(
    """WITH RECURSIVE ids AS (SELECT DISTINCT id FROM nodes),
up AS (SELECT DISTINCT source AS a, target AS b FROM edges WHERE kind IN ('extends', 'implements') AND source IN (SELECT id FROM ids) AND target IN (SELECT id FROM ids)),
c AS (SELECT a, b FROM up UNION SELECT c.a, u.b FROM c JOIN up u ON u.a = c.b)
SELECT a AS type_id, 'ancestor' AS relation, b AS other_id FROM c WHERE a <> b UNION ALL SELECT b, 'descendant', a FROM c WHERE a <> b"""
)
def type_hierarchy(t: Tables) -> DataFrame:
    return graph.type_hierarchy(t.edges, t.nodes)


@R.query(f"WITH {NOW}, s AS (SELECT id FROM now WHERE kind IN ('class', 'struct', 'method')) SELECT edge_id, kind FROM edges WHERE source IN (SELECT id FROM s) AND target IN (SELECT id FROM s)")
def edges_between(t: Tables) -> DataFrame:
    return graph.edges_between(t.edges, t.now.where(F.col("kind").isin("class", "struct", "method"))).select("edge_id", "kind")


@R.query(f"WITH {NOW} SELECT DISTINCT m.file_path, n.file_path AS dependent FROM edges e JOIN now n ON n.id = e.source JOIN now m ON m.id = e.target WHERE e.kind <> 'contains' AND n.file_path <> m.file_path")
def dependents(t: Tables) -> DataFrame:
    return graph.dependents(t.edges, t.now)


@R.query(
    f"""WITH {NOW}, inner_edges AS (SELECT n.file_path, count(*) AS edges FROM edges e JOIN now n ON n.id = e.source JOIN now m ON m.id = e.target WHERE n.file_path = m.file_path GROUP BY 1),
best AS (SELECT * FROM inner_edges ORDER BY edges DESC, file_path LIMIT 20)
SELECT row_number() OVER (ORDER BY edges DESC, file_path) AS rank, file_path, edges FROM best WHERE edges >= 20 AND NOT (regexp_matches(file_path, '{names.LOW_VALUE}') OR regexp_matches(file_path, '{names.GENERATED}'))"""
)
def dominant_files(t: Tables) -> DataFrame:
    return graph.dominant_files(t.edges, t.now)


@R.query(
    f"""WITH {NOW}, p AS (SELECT DISTINCT n.file_path, e.kind, concat_ws(' -> ', n.name, m.name) AS pair FROM edges e JOIN now n ON n.id = e.source JOIN now m ON m.id = e.target WHERE e.kind <> 'contains'),
k AS (SELECT *, row_number() OVER (PARTITION BY file_path, kind ORDER BY pair) AS k FROM p)
SELECT file_path, kind, string_agg(CASE WHEN k <= 5 THEN pair END, '; ' ORDER BY pair) AS pairs, greatest(0, count(*) - 5) AS more FROM k GROUP BY file_path, kind"""
)
def relationships_topk(t: Tables) -> DataFrame:
    return ranking.relationship_lists(t.edges, t.now)


@R.query(
    f"""WITH {NOW}, s AS (SELECT file_path, start_line AS first, coalesce(end_line, start_line) AS last FROM now WHERE kind IN ('function', 'method') AND file_path IS NOT NULL AND start_line IS NOT NULL),
m AS (SELECT *, CASE WHEN first <= max(last) OVER (PARTITION BY file_path ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 3 THEN 0 ELSE 1 END AS fresh FROM s),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY file_path ORDER BY first, last ROWS UNBOUNDED PRECEDING) AS cluster FROM m)
SELECT file_path, min(first) AS first, max(last) AS last, count(*) AS spans FROM c GROUP BY file_path, cluster"""
)
def line_clusters(t: Tables) -> DataFrame:
    spans = t.now.where("kind in ('function', 'method') and file_path is not null and start_line is not null").select("file_path", F.col("start_line").alias("first"), F.coalesce("end_line", "start_line").alias("last"))
    return ranking.line_clusters(spans, ["file_path"], 3)


@R.query(
    f"""WITH {NOW}, p AS (SELECT id, file_path, CASE WHEN kind IN ('class', 'struct', 'interface') THEN 3 WHEN kind IN ('function', 'method') THEN 1 ELSE 0 END AS priority, start_line FROM now WHERE file_path IS NOT NULL)
SELECT id, file_path, rank FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY priority DESC, start_line NULLS FIRST, id) AS rank FROM p) WHERE rank <= 5"""
)
def file_diversity_cap(t: Tables) -> DataFrame:
    priority = F.when(F.col("kind").isin("class", "struct", "interface"), 3).when(F.col("kind").isin("function", "method"), 1).otherwise(0)
    rows = t.now.where("file_path is not null").withColumn("priority", priority)
    return ranking.top_per(rows, ["file_path"], [F.desc("priority"), F.asc_nulls_first("start_line"), F.asc("id")], 5).select("id", "file_path", "rank")


_WALK = ", ".join(
    f"r{k + 1} AS (SELECT node_id, sum(mass) AS mass FROM (SELECT m.target AS node_id, 0.75 * r.mass * m.p AS mass FROM r{k} r JOIN moves m ON m.source = r.node_id UNION ALL SELECT node_id, 0.25 * mass FROM r0) GROUP BY node_id)" for k in range(25)
)


@R.query(
    f"""WITH ids AS (SELECT DISTINCT id FROM nodes WHERE id IS NOT NULL), {SEED_SQL.format(end="target")},
e AS (SELECT source, target FROM edges WHERE kind IN ('calls', 'references', 'imports', 'instantiates', 'extends', 'implements', 'overrides', 'type_of', 'returns') AND source <> target AND source IN (SELECT id FROM ids) AND target IN (SELECT id FROM ids)),
w AS (SELECT source, target, count(*) AS w FROM (SELECT * FROM e UNION ALL SELECT target, source FROM e) GROUP BY 1, 2), d AS (SELECT source, sum(w) AS d FROM w GROUP BY 1),
moves AS MATERIALIZED (SELECT w.source, w.target, w.w / d.d AS p FROM w JOIN d ON d.source = w.source UNION ALL SELECT id, id, 1.0 FROM ids WHERE id NOT IN (SELECT source FROM d)),
r0 AS MATERIALIZED (SELECT id AS node_id, 1.0::DOUBLE / (SELECT count(*) FROM seeds) AS mass FROM seeds), {_WALK}
SELECT i.id AS node_id, round(coalesce(r.mass, 0), 9) AS mass FROM ids i LEFT JOIN r25 r ON r.node_id = i.id"""
)
def rwr_25(t: Tables) -> DataFrame:
    """Random walk over all nodes from the five most called ones."""
    mass = graph.random_walk(t.edges, t.nodes.select("id").distinct(), _seeds(t, "target"))
    return mass.select("node_id", F.round("mass", 9).alias("mass"))
