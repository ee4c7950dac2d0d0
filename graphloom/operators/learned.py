"""Around a learned layer: entries older than the files they speak of, episodes of a stream of events, communities of a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import cut_lineage


def stale(entries: DataFrame, refs: DataFrame, files: DataFrame) -> DataFrame:
    """id, files, changed: entries (id, written_at) that refer (id, path) to files (path, modified_at) changed later, or no longer there.

    files counts the files that make it stale, changed is the last change of those that are there.  Null times are no
    change; repeated rows count once.
    """
    now = files.where("path is not null").groupBy("path").agg(F.max("modified_at").alias("modified_at"), F.lit(True).alias("there"))
    asked = refs.where("id is not null and path is not null").select("id", "path").distinct().join(entries.groupBy("id").agg(F.max("written_at").alias("written_at")), "id")
    late = asked.join(now, "path", "left").where(F.col("there").isNull() | (F.col("modified_at") > F.col("written_at")))
    return late.groupBy("id").agg(F.count("*").alias("files"), F.max("modified_at").alias("changed"))


def episodes(events: DataFrame, who: str, order: list[str], begins: Column) -> DataFrame:
    """The events with the number of their episode: a new one begins where ``begins`` holds; what comes before the first is episode 0."""
    so_far = Window.partitionBy(who).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("episode", F.sum(F.when(begins, 1).otherwise(0)).over(so_far))


def communities(links: DataFrame, rounds: int = 5) -> DataFrame:
    """id, community by label propagation over undirected links (a, b): each round a node takes its neighbours' most frequent label, of equal ones the least.

    An approximation of modularity clustering in a fixed number of rounds; an id without links to others has none.
    """
    one = links.where("a is not null and b is not null and a <> b").select("a", "b")
    both = cut_lineage(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.select(F.col("a").alias("id"), F.col("a").alias("community")).distinct()
    for _ in range(rounds):
        votes = both.join(labels.select(F.col("id").alias("b"), "community"), "b").groupBy("a", "community").agg(F.count("*").alias("n"))
        labels = cut_lineage(votes.groupBy(F.col("a").alias("id")).agg(F.min_by("community", F.struct(-F.col("n"), "community")).alias("community")))
    return labels
