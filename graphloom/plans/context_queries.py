"""Answers to questions: the channels of retrieval, the subgraph, exploring; with SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.context import explore, questions, render, retrieve
from graphloom.context.store import Store
from graphloom.functions import names
from graphloom.plans.base import NOW, Registry, Tables


R = Registry()
QUESTION = "how does renderQuota merge the ledger cache of a BatchReader in walkRelay"
SYMBOLS = questions.symbols_of(QUESTION)
TITLES = list(dict.fromkeys(t for t in map(questions.title, SYMBOLS) if len(t) >= 3))
HITS = 8
_IN = lambda xs: ", ".join(f"'{x}'" for x in xs)


def store(t: Tables) -> Store:
    return Store(t.nodes, t.edges, t.files, t.file_content)


_NAMED = f"""f AS (SELECT *, lower(name) AS low FROM now WHERE lower(name) IN ({_IN(s.lower() for s in SYMBOLS)}) AND kind IN ({_IN(retrieve.ANSWERS)})),
special AS (SELECT DISTINCT file_path FROM f WHERE low IN (SELECT low FROM f GROUP BY low HAVING count(DISTINCT file_path) BETWEEN 1 AND 9)),
s AS (SELECT id, low, file_path, 1.0 + CASE WHEN file_path IN (SELECT file_path FROM special) THEN 20.0 ELSE 0 END AS score FROM f),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY low ORDER BY score DESC, id) AS k FROM s) WHERE k <= {max(8, -(-5 * HITS // max(1, len(SYMBOLS))))} ORDER BY score DESC, id LIMIT {5 * HITS})"""


@R.query(f"WITH {NOW}, {_NAMED}, n AS (SELECT file_path, count(DISTINCT low) AS n FROM top GROUP BY file_path) SELECT id, score + 20.0 * (n - 1) AS score FROM top JOIN n USING (file_path) ORDER BY score DESC, id LIMIT {2 * HITS}")
def context_exact_names(t: Tables) -> DataFrame:
    return retrieve.by_exact_name(store(t), SYMBOLS, HITS).select("id", "score")


def _inside_sql(within: bool) -> str:
    cond = lambda x: f"contains(lower(name), '{x.lower()}')" + (f" AND NOT starts_with(lower(name), '{x.lower()}')" if within else "")
    each = " UNION ALL ".join(f"SELECT '{x}' AS title, id, length(name) AS n FROM now WHERE kind IN ({_IN(retrieve.DEFINITIONS)}) AND {cond(x)}" for x in TITLES)
    return f"WITH {NOW}, e AS ({each}) SELECT title, id FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY n, id) AS k FROM e) WHERE k <= 200"


@R.query(_inside_sql(True))
def context_camel(t: Tables) -> DataFrame:
    return retrieve.inside_names(store(t).nodes, TITLES, within=True).select("title", "id")


@R.query(_inside_sql(False))
def context_compound(t: Tables) -> DataFrame:
    return retrieve.inside_names(store(t).nodes, TITLES, within=False).select("title", "id")


@R.query(
    f"""WITH {NOW}, inner_edges AS (SELECT a.file_path, count(*) AS edges FROM edges e JOIN now a ON a.id = e.source JOIN now b ON b.id = e.target WHERE a.file_path = b.file_path GROUP BY 1),
few AS (SELECT file_path AS path, edges FROM inner_edges ORDER BY edges DESC, path LIMIT 20),
kept AS (SELECT *, row_number() OVER (ORDER BY edges DESC, path) AS k FROM few WHERE edges >= 20 AND NOT (regexp_matches(path, '{names.LOW_VALUE}') OR regexp_matches(path, '{names.GENERATED}')))
SELECT regexp_extract(a.path, '^(.*/)[^/]*$', 1) AS folder FROM kept a LEFT JOIN kept b ON b.k = 2 WHERE a.k = 1 AND (b.edges IS NULL OR a.edges >= 3 * b.edges)"""
)
def context_core_folder(t: Tables) -> DataFrame:
    found = store(t).core_folder()
    return t.spark.createDataFrame([(found,)] if found else [], "folder string")


@R.query()
def context_text(t: Tables) -> DataFrame:
    return retrieve.by_text(store(t), retrieve.search_terms(QUESTION), HITS).select("id", "name", "kind", "score")


def _frame(t: Tables, rows: list[tuple], schema: str) -> DataFrame:
    return t.spark.createDataFrame(rows, schema)


@R.query()
def context_hits(t: Tables) -> DataFrame:
    hits, sure = retrieve.hits_of(store(t), QUESTION, retrieve.RETRIEVAL)
    return _frame(t, [(k, r["id"], r["name"], r["kind"], r["file_path"], round(float(r["score"]), 6), sure) for k, r in enumerate(hits, 1)], "rank int, id string, name string, kind string, file_path string, score double, sure boolean")


@R.query()
def context_nodes(t: Tables) -> DataFrame:
    sg = retrieve.relevant(store(t), QUESTION, retrieve.RETRIEVAL)
    return _frame(t, [(k, n["id"], n["kind"], n["name"], n["file_path"], n["id"] in sg.roots) for k, n in enumerate(sg.nodes.values(), 1)], "place int, id string, kind string, name string, file_path string, hit boolean")


@R.query()
def context_edges(t: Tables) -> DataFrame:
    return _frame(t, list(retrieve.relevant(store(t), QUESTION, retrieve.RETRIEVAL).edges), "source string, target string, kind string")


@R.query()
def context_markdown(t: Tables) -> DataFrame:
    return _frame(t, [(QUESTION, render.markdown(store(t), QUESTION, retrieve.RETRIEVAL))], "question string, markdown string")


@R.query()
def explore_files(t: Tables) -> DataFrame:
    _, files = explore.explore(store(t), QUESTION)
    return _frame(t, [(k, f["file_path"], f["named"], round(float(f["mass"]), 9), f["terms"], float(f["score"])) for k, f in enumerate(files, 1)], "rank int, file_path string, named boolean, mass double, terms int, score double")


@R.query()
def explore_markdown(t: Tables) -> DataFrame:
    return _frame(t, [(QUESTION, explore.explore(store(t), QUESTION)[0])], "question string, markdown string")


@R.query(
    """SELECT * FROM (VALUES (0, 13000, 4, 3800, 1), (149, 13000, 4, 3800, 1), (150, 18000, 5, 3800, 1), (499, 18000, 5, 3800, 1), (500, 24000, 8, 6500, 2), (4999, 24000, 8, 6500, 2),
(5000, 24000, 8, 7000, 3), (15000, 24000, 8, 7000, 4), (30000, 24000, 8, 7000, 5)) AS b(files, output, shown, per_file, calls)"""
)
def explore_budgets(t: Tables) -> DataFrame:
    rows = [(n, explore.budget(n).output, explore.budget(n).files, explore.budget(n).per_file, explore.calls_recommended(n)) for n in (0, 149, 150, 499, 500, 4999, 5000, 15000, 30000)]
    return _frame(t, rows, "files int, output int, shown int, per_file int, calls int")


_TRACE_SEED = "(SELECT source FROM edges WHERE kind = 'calls' AND source IN (SELECT id FROM nodes) GROUP BY source ORDER BY count(*) DESC, source LIMIT 1)"


@R.query(
    f"""WITH RECURSIVE known AS (SELECT DISTINCT id FROM nodes), e AS (SELECT DISTINCT source, target FROM edges WHERE target IN (SELECT id FROM known) AND source IS NOT NULL),
walk(id, depth) AS (SELECT {_TRACE_SEED}, 0 UNION SELECT e.target, w.depth + 1 FROM walk w JOIN e ON e.source = w.id WHERE w.depth < 3)
SELECT id, min(depth) AS depth FROM walk GROUP BY id"""
)
def traverse_bfs(t: Tables) -> DataFrame:
    """Ids within three steps out of the node with most calls, over all kinds of edges, with their least depth."""
    from graphloom.operators import graph

    calls = t.edges.where("kind = 'calls'").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n"))
    seed = calls.join(t.nodes.select("id").distinct(), "id", "left_semi").orderBy(F.desc("n"), "id").limit(1).select("id")
    return graph.reach(t.edges, t.nodes, seed, 3).select(F.col("node_id").alias("id"), "depth")
