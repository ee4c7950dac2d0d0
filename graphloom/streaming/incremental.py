"""Incremental indexing: which files changed, and a stream that keeps an index of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.index import Index, reindex
from graphloom.session import cut_lineage


def states(files: DataFrame, contents: DataFrame) -> DataFrame:
    """path, state: 'new', 'changed', 'same' or 'removed', by comparing the index's hashes with the texts'. Null paths are left out."""
    old = files.where("path is not null").select("path", "content_hash").distinct()
    now = contents.where("path is not null and content is not null").select("path", F.sha2("content", 256).alias("hash"))
    state = (
        F.when(F.col("known").isNull(), "new").when(F.col("hash").isNull(), "removed").when(F.col("content_hash").isNull() | (F.col("content_hash") != F.col("hash")), "changed").otherwise("same")
    )
    return old.withColumn("known", F.lit(True)).join(now, "path", "full").select("path", state.alias("state")).distinct()


def follow(spark: SparkSession, folder: str, index: Index, checkpoint: str) -> StreamingQuery:
    """Follow Parquet files of (path, content) that arrive in a folder, and take new and changed texts into a stored index, each in the place of the old one.

    A null content removes its file.  A text whose hash the index has for its path is skipped, so replays after a
    failure change nothing; of several texts of one path in a batch, the one with the greatest hash is taken.
    """

    def step(batch: DataFrame, _: int) -> None:
        told = batch.where("path is not null").withColumn("content_hash", F.sha2("content", 256))
        last = cut_lineage(told.groupBy("path").agg(F.max_by("content", F.coalesce("content_hash", F.lit(""))).alias("content"), F.max("content_hash").alias("content_hash")))
        changed = cut_lineage(last.where("content is not null").join(index.table("files").select("path", "content_hash"), ["path", "content_hash"], "left_anti"))
        removed = last.where("content is null").select("path")
        if changed.limit(1).count() or removed.limit(1).count():
            reindex(index, changed.select("path", "content"), removed)

    return spark.readStream.schema("path string, content string").parquet(folder).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch(spark: SparkSession, folder: str, index: str, checkpoint: str, work: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Follow Parquet files of (path, content) that arrive in a folder, and append what ``work`` makes of new and changed texts.

    A text whose hash the index already has for its path is skipped, so replays after a failure add nothing.
    """
    schema = "path string, content string"

    def step(batch: DataFrame, _: int) -> None:
        fresh = batch.where("path is not null and content is not null").withColumn("content_hash", F.sha2("content", 256)).dropDuplicates(["path", "content_hash"])
        try:
            fresh = fresh.join(spark.read.parquet(index).select("path", "content_hash"), ["path", "content_hash"], "left_anti")
        except Exception as e:  # the index doesn't exist before the first batch
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        work(fresh).write.mode("append").parquet(index)

    return spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
