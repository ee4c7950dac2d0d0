"""Windows, clusters and fusion of ranked rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: what an edge's kind adds to a file's score.
RRF_K = 60


def top_per(rows: DataFrame, group: list[str], order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of each group."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= limit)


def relationship_lists(edges: DataFrame, nodes: DataFrame, limit: int = 5) -> DataFrame:
    """Per file and kind of edge: the first pairs of names by name, and how many more there are."""
    n = nodes.select("id", "name", "file_path")
    pairs = edges.where("kind <> 'contains'").join(n.select(F.col("id").alias("source"), F.col("name").alias("a"), "file_path"), "source").join(n.select(F.col("id").alias("target"), F.col("name").alias("b")), "target")
    names = pairs.select("file_path", "kind", F.concat_ws(" -> ", "a", "b").alias("pair")).distinct()
    ranked = names.withColumn("k", F.row_number().over(Window.partitionBy("file_path", "kind").orderBy("pair")))
    counted = ranked.groupBy("file_path", "kind").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("k") <= limit, F.col("pair")))), "; ").alias("pairs"))
    return counted.select("file_path", "kind", "pairs", F.greatest(F.lit(0), F.col("n") - limit).cast("bigint").alias("more"))


def line_clusters(spans: DataFrame, group: list[str], gap: int) -> DataFrame:
    """Spans (first, last) joined while the next begins within ``gap`` of the end so far: group, first, last, spans."""
    order = Window.partitionBy(*group).orderBy("first", "last")
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("fresh", F.when(F.col("first") <= before + gap, 0).otherwise(1))
    numbered = marked.withColumn("cluster", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*group, "cluster").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count("*").alias("spans")).drop("cluster")


def fuse(channels: list[DataFrame], key: str, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked channels (key, rank): key, score."""
    every = channels[0].select(key, "rank")
    for c in channels[1:]:
        every = every.unionByName(c.select(key, "rank"))
    return every.groupBy(key).agg(F.round(F.sum(F.lit(1.0) / (k + F.col("rank"))), 9).alias("score"))


def cosine(vectors: DataFrame, query: list[float], column: str = "embedding") -> DataFrame:
    """The rows with their cosine to a query vector; null where a vector has no length."""
    q = F.array(*(F.lit(float(x)) for x in query))
    dot = F.aggregate(F.zip_with(column, q, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x)
    size = F.sqrt(F.aggregate(column, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    length = sum(float(x) ** 2 for x in query) ** 0.5
    return vectors.withColumn("cosine", F.when((size > 0) & F.lit(length > 0), dot / (size * length)))
