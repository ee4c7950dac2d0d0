"""Full-text and name search over nodes (or any table of text columns)."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import names
from graphloom.operators import fulltext
from graphloom.operators.fulltext import B, K1, WEIGHTS, Index, tokens
from graphloom.session import cut_lineage


def postings(rows: DataFrame, key: str = "id", weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """term, key, column, tf: the inverted index by column."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), tokens(F.col(c)).alias("terms")) for c in weights)))
    words = rows.select(F.col(key), each.alias("e")).select(key, "e.column", F.explode("e.terms").alias("term"))
    return words.groupBy("term", key, "column").agg(F.count("*").alias("tf"))


def bm25(rows: DataFrame, query: str, weights: Mapping[str, float] = WEIGHTS, k1: float = K1, b: float = B, key: str = "id", index: Index | None = None) -> DataFrame:
    """The rows that hold a word beginning with one of the query's words, with ``score``; over a stored index if one is given."""
    found = fulltext.rank(index or fulltext.build(rows, weights, key), [query], k1, b).select(F.col("id").alias("__id"), "score")
    return rows.join(found, F.col(key) == F.col("__id")).drop("__id")


def search_many(
    rows: DataFrame, queries: list[str], limit: int = 10, kinds: tuple[str, ...] = (), project_words: frozenset[str] = frozenset(), index: Index | None = None
) -> DataFrame:
    """query and the columns of rows with their final ``score``: the best nodes of every query.

    BM25 over max(5 limit, 100) candidates of the kinds and up to 20 exact names for each word (with the best score so
    far), re-ranked by kind, path and name.  A query of two letters or more without a hit is looked for inside names.
    The limit is the feature: a top-k search.
    """
    queries = list(dict.fromkeys(q for q in queries if q.strip()))
    chosen = rows.where(F.col("kind").isin(*kinds)) if kinds else rows
    if not queries:
        return chosen.limit(0).withColumn("query", F.lit("")).withColumn("score", F.lit(0.0))
    cap = max(5 * limit, 100)
    top = lambda df, *order: df.withColumn("__k", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("__k") <= cap).drop("__k")
    every = fulltext.rank(index or fulltext.build(rows), queries)
    best = cut_lineage(top(chosen.join(every, "id"), F.desc("score"), "id"))
    met = {r["query"] for r in best.select("query").distinct().collect()}  # some of the queries
    if missed := [q for q in queries if q not in met and len(q) >= 2]:
        low = {q: like(chosen, q).withColumn("query", F.lit(q)) for q in missed}
        best = best.unionByName(top(reduce(DataFrame.unionByName, low.values()), F.desc("score"), F.length("name"), "id"))
    words = [(q, w.lower()) for q in queries for w in q.split() if len(w) >= 2]
    of = F.broadcast(rows.sparkSession.createDataFrame(words, "query string, low string"))  # the words of the queries
    named = chosen.where(F.lower("name").isin(*{w for _, w in words})).withColumn("low", F.lower("name")).join(of, "low")
    order = Window.partitionBy("query", "low").orderBy("file_path", "start_line", "id")
    named = named.withColumn("__k", F.row_number().over(order)).where("__k <= 20").drop("__k", "low").dropDuplicates(["query", "id"])
    most = best.groupBy("query").agg(F.max("score").alias("score"))
    exact = named.join(best.select("query", "id"), ["query", "id"], "left_anti").join(most, "query", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    bonus = F.lit(0)
    for q in queries:
        bonus = F.when(F.col("query") == q, names.path_relevance(F.col("file_path"), q, project_words) + names.name_bonus(F.col("name"), q)).otherwise(bonus)
    ranked = best.unionByName(exact).withColumn("score", F.round(F.col("score") + names.kind_bonus(F.col("kind")) + bonus, 6))
    final = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return ranked.withColumn("__k", F.row_number().over(final)).where(F.col("__k") <= limit).drop("__k")


def search(rows: DataFrame, query: str, limit: int = 10, kinds: tuple[str, ...] = (), project_words: frozenset[str] = frozenset(), index: Index | None = None) -> DataFrame:
    """The best nodes of one query, as in ``search_many``."""
    return search_many(rows, [query], limit, kinds, project_words, index).drop("query").orderBy(F.desc("score"), "id")


def like(rows: DataFrame, query: str) -> DataFrame:
    """Rows with the query inside name or qualified name: 1 the name, .9 its beginning, .8 inside, .7 in the qualified name. % and _ are wildcards."""
    low, q = F.lower("name"), query.lower()
    score = F.when(low == q, 1.0).when(low.like(f"{q}%"), 0.9).when(low.like(f"%{q}%"), 0.8).when(F.lower("qualified_name").like(f"%{q}%"), 0.7)
    return rows.withColumn("score", score).where("score is not null")


def substring(rows: DataFrame, part: str, not_prefix: bool = False) -> DataFrame:
    """Rows whose name holds a part (and doesn't begin with it), score 1; % and _ are wildcards."""
    low = F.lower("name")
    found = rows.where(low.like(f"%{part.lower()}%"))
    return (found.where(~low.like(f"{part.lower()}%")) if not_prefix else found).withColumn("score", F.lit(1.0))


def per_name(rows: DataFrame, wanted: list[str], limit: int) -> DataFrame:
    """Nodes of exactly these names (in any case): files where a name of one to nine files stands count 20 more, and each name gets at most max(8, limit / names) rows."""
    low = [w.lower() for w in wanted]
    found = rows.where(F.lower("name").isin(*low)).withColumn("low", F.lower("name"))
    spread = found.groupBy("low").agg(F.countDistinct("file_path").alias("files")).where("files between 1 and 9").select("low")
    special = found.join(spread, "low", "left_semi").select("file_path").distinct().withColumn("special", F.lit(20.0))
    scored = found.join(special, "file_path", "left").withColumn("score", F.lit(1.0) + F.coalesce("special", F.lit(0.0)))
    order = Window.partitionBy("low").orderBy(F.desc("score"), "id")
    return scored.withColumn("k", F.row_number().over(order)).where(F.col("k") <= max(8, -(-limit // max(1, len(low))))).drop("k", "low", "special")


def match(rows: DataFrame, query: str, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """Rows that satisfy a boolean query: words (all wanted), OR, NOT, "phrases", prefix*, column:word and parentheses."""
    text = re.findall(r'\(|\)|[\w.]+:"[^"]*"|"[^"]*"\*?|[^\s()"]+', query)
    held = {c: tokens(F.col(c)) for c in weights}

    def leaf(word: str) -> Column:
        column, _, rest = word.partition(":")
        columns, body = ([column], rest) if rest and column in held else (list(held), word)
        prefix = body.endswith("*")
        phrase = [x for x in re.sub(r"[^\w]+", " ", body.lower()).split() if x]
        if not phrase:
            return F.lit(True)
        out = F.lit(False)
        for c in columns:
            line = F.concat(F.lit(" "), F.array_join(held[c], " "), F.lit(" "))
            out = out | line.contains(" " + " ".join(phrase) + ("" if prefix else " "))
        return out

    def either(at: int) -> tuple[Column, int]:
        left, at = every(at)
        while at < len(text) and text[at] == "OR":
            right, at = every(at + 1)
            left = left | right
        return left, at

    def every(at: int) -> tuple[Column, int]:
        left, at = one(at)
        while at < len(text) and text[at] not in ("OR", ")"):
            negate = text[at] == "NOT"
            right, at = one(at + (text[at] in ("NOT", "AND")))
            left = left & ~right if negate else left & right
        return left, at

    def one(at: int) -> tuple[Column, int]:
        if at >= len(text):
            return F.lit(True), at
        if text[at] == "(":
            inner, at = either(at + 1)
            return inner, at + 1
        return leaf(text[at]), at + 1

    return rows.where(either(0)[0]) if text else rows.limit(0)
