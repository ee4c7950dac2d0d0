"""An inverted index of text columns, and BM25 over it for many queries at once.

Postings (term, id, f) hold the weighted number of occurrences of a term in a row, lengths (id, total) the number of
its tokens.  Queries look for terms that begin with one of their words; they are few and short, and all of them are
answered in one pass over the postings that their prefixes select.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.query_text import match_terms

# Columns of a node's text and their weights; the id counts for hits, not for the score.
WEIGHTS = {"id": 0.0, "name": 20.0, "qualified_name": 5.0, "docstring": 1.0, "signature": 2.0, "name_split": 8.0}
# BM25's constants.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


@cache
def accents() -> tuple[str, str]:
    """Letters that carry marks and the letters without them, by Unicode's decompositions."""
    odd, plain = [], []
    for o in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)):
        first, *marks = unicodedata.normalize("NFD", chr(o).lower())
        if marks and all(unicodedata.combining(m) for m in marks) and chr(o).lower() == chr(o):
            odd.append(chr(o))
            plain.append(first)
    return "".join(odd), "".join(plain)


def tokens(text: Column) -> Column:
    """Runs of letters and digits, in lower case and without accents."""
    plain = F.translate(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\p{Mn}+", ""), *accents())
    return F.filter(F.split(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "), " "), lambda x: x != "")


@dataclass(frozen=True)
class Index:
    postings: DataFrame
    lengths: DataFrame


def build(rows: DataFrame, weights: Mapping[str, float] = WEIGHTS, key: str = "id") -> Index:
    """The index of a table. Null keys are left out; null texts have no tokens."""
    held = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), *(tokens(F.col(c)).alias(f"t_{i}") for i, c in enumerate(weights)))
    each = F.explode(F.array(*(F.struct(F.lit(float(w)).alias("w"), F.col(f"t_{i}").alias("terms")) for i, w in enumerate(weights.values()))))
    words = held.select("id", each.alias("e")).select("id", "e.w", F.explode("e.terms").alias("term"))
    total = sum((F.size(f"t_{i}") for i in range(len(weights))), F.lit(0))
    return Index(words.groupBy("term", "id").agg(F.sum("w").alias("f")), held.select("id", total.alias("total")))


def prefixes(query: str) -> list[str]:
    """The beginnings of terms that a query asks for, as the tokenizer would write them."""
    odd, plain = accents()
    low = (unicodedata.normalize("NFC", x.lower()).translate(str.maketrans(odd, plain)) for x in match_terms(query))
    return list(dict.fromkeys(t for t in (re.sub(r"[\W_]+", " ", x).strip() for x in low) if t))


def rank(index: Index, queries: Iterable[str], k1: float = K1, b: float = B) -> DataFrame:
    """query, id, score of the rows that hold a term beginning with a word of the query.

    A row that is hit in a column of weight 0 alone has score 0 and is there.  A word's rarity is that of all rows with
    a term it begins; figures of the whole table are two numbers.
    """
    spark = index.postings.sparkSession
    asked = [(q, p) for q in dict.fromkeys(queries) for p in prefixes(q)]
    if not asked:
        return index.postings.limit(0).select(F.lit("").alias("query"), "id", F.lit(0.0).alias("score"))
    words = sorted({p for _, p in asked})
    wanted = F.broadcast(spark.createDataFrame([(p,) for p in words], "prefix string"))  # the words of the queries
    any_of = F.lit(False)
    for p in words:
        any_of = any_of | F.col("term").startswith(p)
    hits = index.postings.where(any_of).join(wanted, F.expr("startswith(term, prefix)")).groupBy("prefix", "id").agg(F.sum("f").alias("f"))
    figures = index.lengths.agg(F.count("*").alias("n"), F.avg("total").alias("mean")).first()
    n, mean = figures["n"], figures["mean"] or 1.0
    df = hits.groupBy("prefix").agg(F.count("*").alias("df"))
    plain = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    scored = hits.join(F.broadcast(df), "prefix").join(index.lengths, "id").select(  # df: a row for each word
        "prefix", "id",
        (F.when(plain > 0, plain).otherwise(F.lit(LEAST_IDF)) * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("total") / F.lit(mean)))).alias("s"),
    )
    of = F.broadcast(spark.createDataFrame(asked, "query string, prefix string"))
    return scored.join(of, "prefix").groupBy("query", "id").agg(F.sum("s").alias("score"))
