"""Full-text search, ranking, vectors and changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import names
from graphloom.operators import fulltext, ranking, search
from graphloom.plans.base import NOW, Registry, Tables
from graphloom.streaming import incremental

R = Registry()
QUERY = "rank ledger cache"
_COLUMNS = {"id": 0.0, "name": 20.0, "qualified_name": 5.0, "docstring": 1.0, "signature": 2.0, "name_split": 8.0}


def _tokens(column: str) -> str:
    return f"list_filter(regexp_split_to_array(translate(regexp_replace(lower(coalesce({column}, '')), '\\p{{Mn}}+', '', 'g'), '{fulltext.accents()[0]}', '{fulltext.accents()[1]}'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def _bm25_sql(table: str, columns: dict[str, float], key: str, terms: list[str]) -> str:
    held = ", ".join(f"{_tokens(c)} AS t_{c}" for c in columns)
    count = lambda c, w: f"len(list_filter(t_{c}, lambda x: starts_with(x, '{w}')))"
    total = " + ".join(f"len(t_{c})" for c in columns)
    hits = {w: " + ".join(count(c, w) for c in columns) for w in terms}
    f = {w: " + ".join(f"{v} * {count(c, w)}" for c, v in columns.items() if v) for w in terms}
    figures = ", ".join(f"sum(CASE WHEN h{i} > 0 THEN 1 ELSE 0 END) AS df{i}" for i in range(len(terms)))
    idf = [f"CASE WHEN n - df{i} > df{i} THEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) ELSE 1e-6 END" for i in range(len(terms))]
    score = " + ".join(f"({idf[i]}) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * d / mean))" for i in range(len(terms)))
    return f"""t AS (SELECT *, {held} FROM {table}),
c AS (SELECT *, ({total}) AS d, {", ".join(f"({h}) AS h{i}" for i, h in enumerate(hits.values()))}, {", ".join(f"({x}) AS f{i}" for i, x in enumerate(f.values()))} FROM t),
g AS (SELECT count(*) AS n, avg(d) AS mean, {figures} FROM c),
scored AS (SELECT {key}, {score} AS score FROM c, g WHERE {" OR ".join(f"h{i} > 0" for i in range(len(terms)))})"""


@R.query(f"WITH {NOW}, {_bm25_sql('now', _COLUMNS, 'id', QUERY.split())} SELECT id, round(score, 6) AS score FROM scored")
def fts_bm25(t: Tables) -> DataFrame:
    return search.bm25(t.now, QUERY).select("id", F.round("score", 6).alias("score"))


@R.query(f"WITH {_bm25_sql('documents', {'text': 1.0}, 'doc_id', ['cursor', 'drain'])} SELECT doc_id, round(score, 6) AS score FROM scored")
def fts_documents(t: Tables) -> DataFrame:
    return search.bm25(t.documents.select("doc_id", "text"), "cursor drain", {"text": 1.0}, key="doc_id").select("doc_id", F.round("score", 6).alias("score"))


@R.query(f"WITH {NOW}, w AS (SELECT id, unnest({_tokens('name')}) AS term FROM now) SELECT term, count(*) AS tf, count(DISTINCT id) AS df FROM w GROUP BY term")
def term_frequencies(t: Tables) -> DataFrame:
    p = search.postings(t.now.select("id", "name"), weights={"name": 1.0})
    return p.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


_TEST_SQL = " OR ".join(f"regexp_matches(path, '{x}')" for x in (names.TEST_NAME, names.TEST_CAMEL, names.TEST_DIR, names.TEST_CAMEL_DIR, names.SIDE_DIR))


def _path_sql(word: str) -> str:
    return f"""CASE WHEN contains(lower(regexp_extract(path, '[^/]*$')), '{word}') THEN 10 ELSE 0 END
+ CASE WHEN contains(lower(regexp_extract(path, '^(.*)/[^/]*$', 1)), '{word}') THEN 5 WHEN contains(lower(path), '{word}') THEN 3 ELSE 0 END"""


@R.query(
    f"""WITH {NOW}, {_bm25_sql('now', _COLUMNS, 'id', QUERY.split())},
best AS (SELECT n.id, n.name, n.kind, n.file_path AS path, s.score FROM scored s JOIN now n ON n.id = s.id ORDER BY s.score DESC, n.id LIMIT 125),
named AS (SELECT id, name, kind, file_path AS path, row_number() OVER (PARTITION BY lower(name) ORDER BY file_path, start_line, id) AS k FROM now WHERE lower(name) IN ('rank', 'ledger', 'cache')),
every AS (SELECT * FROM best UNION ALL SELECT id, name, kind, path, (SELECT coalesce(max(score), 0) FROM best) FROM named WHERE k <= 20 AND id NOT IN (SELECT id FROM best)),
final AS (SELECT *, lower(name) AS low, {" + ".join(_path_sql(w) for w in QUERY.split())} - CASE WHEN {_TEST_SQL} THEN 15 ELSE 0 END AS points,
  CASE kind {" ".join(f"WHEN '{k}' THEN {v}" for k, v in names.KIND_BONUS.items())} ELSE 0 END AS kb FROM every)
SELECT id, name, kind, path AS file_path, round(score + kb + points + CASE WHEN low = 'rankledgercache' THEN 80 WHEN low IN ('rank', 'ledger', 'cache') THEN 60
  WHEN starts_with(low, 'rankledgercache') THEN CAST(round(10 + 30.0 * 15 / length(low)) AS INT) WHEN contains(low, 'rank') AND contains(low, 'ledger') AND contains(low, 'cache') THEN 15
  WHEN contains(low, 'rankledgercache') THEN 10 ELSE 0 END, 6) AS score FROM final ORDER BY score DESC, id LIMIT 25"""
)
def fts_multi_signal(t: Tables) -> DataFrame:
    return search.search(t.now, QUERY, 25).select("id", "name", "kind", "file_path", "score")


@R.query(f"WITH {NOW} SELECT id FROM now WHERE list_contains({_tokens('name')}, 'cache') OR (list_contains({_tokens('name_split')}, 'ledger') AND NOT list_contains({_tokens('name_split')}, 'rank'))")
def fts_match(t: Tables) -> DataFrame:
    return search.match(t.now, "name:cache OR (name_split:ledger NOT name_split:rank)").select("id")


@R.query(
    f"""WITH {NOW} SELECT id, CASE WHEN lower(name) = 'rankledger' THEN 80 WHEN lower(name) IN ('rank', 'ledger') THEN 60
WHEN starts_with(lower(name), 'rankledger') THEN CAST(round(10 + 30.0 * 10 / length(name)) AS INT) WHEN contains(lower(name), 'rank') AND contains(lower(name), 'ledger') THEN 15
WHEN contains(lower(name), 'rankledger') THEN 10 ELSE 0 END AS bonus,
CASE kind {" ".join(f"WHEN '{k}' THEN {v}" for k, v in names.KIND_BONUS.items())} ELSE 0 END AS kind_bonus FROM now WHERE name IS NOT NULL"""
)
def name_match_bonus(t: Tables) -> DataFrame:
    return t.now.where("name is not null").select("id", names.name_bonus(F.col("name"), "rank ledger").alias("bonus"), names.kind_bonus(F.col("kind")).alias("kind_bonus"))


@R.query(
    f"""SELECT DISTINCT path, {_path_sql("ledger")} + {_path_sql("cache")}
- CASE WHEN regexp_matches(path, '{names.TEST_NAME}') OR regexp_matches(path, '{names.TEST_CAMEL}') OR regexp_matches(path, '{names.TEST_DIR}') OR regexp_matches(path, '{names.TEST_CAMEL_DIR}') OR regexp_matches(path, '{names.SIDE_DIR}') THEN 15 ELSE 0 END AS points
FROM files WHERE path IS NOT NULL"""
)
def path_relevance(t: Tables) -> DataFrame:
    return t.files.where("path is not null").select("path").distinct().select("path", names.path_relevance(F.col("path"), "ledger cache").alias("points"))


@R.query(
    f"""WITH {NOW}, f AS (SELECT *, lower(name) AS low FROM now WHERE lower(name) IN ('ledger', 'chunk', 'cache')),
special AS (SELECT DISTINCT file_path FROM f WHERE low IN (SELECT low FROM f GROUP BY low HAVING count(DISTINCT file_path) BETWEEN 1 AND 9)),
s AS (SELECT id, low, 1.0 + CASE WHEN file_path IN (SELECT file_path FROM special) THEN 20.0 ELSE 0 END AS score FROM f)
SELECT id, score FROM (SELECT *, row_number() OVER (PARTITION BY low ORDER BY score DESC, id) AS k FROM s) WHERE k <= 10"""
)
def names_top_per_name(t: Tables) -> DataFrame:
    return search.per_name(t.now, ["ledger", "chunk", "cache"], 30).select("id", "score")


@R.query(
    """WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
c AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 5) AS cosine FROM embeddings, q)
SELECT vec_id, cosine FROM c ORDER BY cosine DESC, vec_id LIMIT 20"""
)
def cosine_topk(t: Tables) -> DataFrame:
    v = t.embeddings.select("vec_id", "embedding")
    first = v.orderBy("vec_id").first()
    if first is None:
        return v.select("vec_id", F.lit(None).cast("double").alias("cosine"))
    return ranking.cosine(v, first["embedding"]).select("vec_id", F.round("cosine", 5).alias("cosine")).orderBy(F.desc("cosine"), "vec_id").limit(20)


@R.query(
    f"""WITH {_bm25_sql('documents', {'text': 1.0}, 'doc_id', ['cursor'])},
a AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored ORDER BY rank LIMIT 50),
b AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents WHERE n_chars IS NOT NULL ORDER BY rank LIMIT 50)
SELECT doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id"""
)
def rrf_fusion(t: Tables) -> DataFrame:
    a = search.bm25(t.documents.select("doc_id", "text"), "cursor", {"text": 1.0}, key="doc_id").orderBy(F.desc(F.round("score", 9)), "doc_id").limit(50)
    a = a.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "doc_id")))
    b = t.documents.where("n_chars is not null").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(50)
    b = b.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")))
    return ranking.fuse([a, b], "doc_id")


@R.query(
    """SELECT DISTINCT coalesce(f.path, c.path) AS path, CASE WHEN f.path IS NULL THEN 'new' WHEN c.content IS NULL THEN 'removed' WHEN sha256(c.content) <> f.content_hash OR f.content_hash IS NULL THEN 'changed' ELSE 'same' END AS state
FROM files f FULL JOIN file_content c ON c.path = f.path WHERE f.path IS NOT NULL OR c.path IS NOT NULL AND c.content IS NOT NULL"""
)
def incremental_changed(t: Tables) -> DataFrame:
    return incremental.states(t.files, t.file_content)
