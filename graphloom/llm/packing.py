"""Problem 6: items packed into containers of fixed capacity.

Bulk-synchronous best fit.  Documents are counted in tokens and sorted into size
classes; within a class each has a rank, computed in bounded groups.  A
superstep takes one class, largest first: a sweep finds for its items the
successor gaps (the smallest that hold them), the k-th item takes the k-th place
there, and the gaps are updated for the next superstep.  Since gaps are whole
numbers up to the capacity, gaps of a class are intervals of container numbers,
and a sweep handles millions of equal items at once.  The result is that of
best-fit decreasing, item by item.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import cut_lineage, in_batches, spread

CAPACITY = 2048
MAX_CAPACITY = 1 << 17  # the plan is held by the driver and grows with the capacity, not with the data
GROUP = 100_000  # rows of a size class that are ranked in one group
TOKENIZERS = "/opt/tokenizers"
# Fixed value: how the byte-level vocabulary's tokenizer cuts text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def _encoder(folder: str):
    import tiktoken

    with Path(folder, "byte_bpe_50k.tiktoken").open("rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, tokens of each distinct row; null texts and ids are left out, an empty text has no tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(folder).encode_ordinary
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "tokens": np.array([len(encode(t)) for t in b["text"]], dtype=np.int64)})

    whole = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint"), "text")
    return in_batches(spread(whole), run, "doc_id bigint, tokens bigint")


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over size classes.

    counts: items by size, 1 to capacity.  Returns rows (size, first rank, end rank, first container, items per
    container) and the number of containers: the item of rank r goes to container first + (r - first rank) // items.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    gaps: list[int] = []  # sorted gap sizes that have containers
    held: dict[int, list[tuple[int, int]]] = {}
    opened = 0

    def free(gap: int, begin: int, end: int) -> None:
        if gap and begin < end:
            if gap not in held:
                insort(gaps, gap)
                held[gap] = []
            held[gap].append((begin, end))

    for size in sorted(counts, reverse=True):
        rank, total = 0, counts[size]
        while rank < total:
            i = bisect_left(gaps, size)
            if i < len(gaps):
                gap = gaps[i]
                begin, end = held[gap].pop()
                if not held[gap]:
                    del held[gap]
                    gaps.pop(i)
            else:
                gap = capacity
                begin = opened
                end = opened = opened + -(-(total - rank) // (capacity // size))
            each = gap // size
            full = min(end - begin, (total - rank) // each)
            if full:
                rows.append((size, rank, rank + full * each, begin, each))
                rank += full * each
                free(gap - each * size, begin, begin + full)
            at = begin + full
            if at < end and rank < total:  # the last items fill one container partly
                rows.append((size, rank, total, at, each))
                free(gap - (total - rank) * size, at, at + 1)
                rank = total
                at += 1
            free(gap, at, end)
    return rows, opened


def pack(sizes: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """doc_id, piece, tokens, container for sizes (doc_id, tokens).

    An item longer than the capacity is divided into full containers and a rest (pieces 0, 1, ...); all others stay
    whole.  Items without tokens take no room and get a null container; null sizes or ids are left out.  Repeated rows
    are items of their own.  Equal sizes are told apart by doc_id, so the result doesn't depend on the order of rows.
    """
    if not 0 < capacity <= MAX_CAPACITY:
        raise ValueError(f"capacity must be between 1 and {MAX_CAPACITY}")
    items = sizes.where(F.col("doc_id").isNotNull() & F.col("tokens").isNotNull()).select("doc_id", F.col("tokens").cast("bigint").alias("tokens"))
    pieces = F.when(F.col("tokens") > 0, F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("tokens") - 1) / capacity).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))
    cut = items.select("doc_id", "tokens", F.explode(pieces).alias("piece"))
    cut = cut.select("doc_id", "piece", F.least(F.col("tokens") - F.col("piece") * capacity, F.lit(capacity).cast("bigint")).alias("size"))
    cut = cut_lineage(cut)
    most = cut.groupBy("size").agg(F.count("*").alias("n"))
    counts = {int(s): int(n) for s, n in most.where("size > 0").collect()}  # at most ``capacity`` rows
    steps, _ = plan(counts, capacity)
    buckets = max(1, -(-sum(counts.values()) // group))
    salted = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    per = salted.groupBy("size", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("size", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("size", "bucket").orderBy("doc_id", "piece")
    ranked = salted.withColumn("k", F.row_number().over(inside)).join(offsets, ["size", "bucket"]).select("doc_id", "piece", "size", (F.col("k") - 1 + F.col("before")).alias("rank"))
    table: dict[int, np.ndarray] = {}
    for row in steps:
        table.setdefault(row[0], []).append(row[1:])  # type: ignore[arg-type]
    table = {s: np.array(sorted(x), dtype=np.int64) for s, x in table.items()}
    shared = sizes.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            container = np.full(len(b), -1, dtype=np.int64)
            size, rank = b["size"].to_numpy(), b["rank"].to_numpy()
            for s in np.unique(size):
                if s in shared.value:
                    where, step = np.flatnonzero(size == s), shared.value[s]
                    k = np.searchsorted(step[:, 0], rank[where], side="right") - 1
                    container[where] = step[k, 2] + (rank[where] - step[k, 0]) // step[k, 3]
            yield pd.DataFrame({"doc_id": b["doc_id"], "piece": b["piece"], "tokens": size, "container": pd.array(np.where(container < 0, 0, container), dtype="Int64").copy()}).assign(
                container=lambda x: x["container"].mask(pd.Series(container < 0, index=x.index))
            )

    return in_batches(ranked, run, "doc_id bigint, piece bigint, tokens bigint, container bigint")


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, items, tokens, and the share of the containers' room that is used."""
    held = packed.where("container is not null").groupBy("container").agg(F.sum("tokens").alias("used"), F.count("*").alias("n"))
    return held.agg(
        F.count("*").alias("containers"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("items"),
        F.coalesce(F.sum("used"), F.lit(0)).cast("bigint").alias("tokens"),
        F.coalesce(F.max("used"), F.lit(0)).cast("bigint").alias("fullest"),
        F.round(F.sum("used") / (F.count("*") * capacity), 6).alias("filled"),
    )
