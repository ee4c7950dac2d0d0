"""Problem 5: references to records that do not exist.

Keys are cut into ranges of their hash, which are equally full whatever the keys
look like.  Of each range the parents' lives (appearances and removals, sorted by
key and time) become arrays; references stream past them in Arrow batches and find
their key and moment by binary search.  A range with many references is dealt out
to several tasks, each of which gets the range's arrays, so one key may hold any
share of the references.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import cut_lineage, in_batches

EVENTS_PER_RANGE = 20_000
REFERENCES_PER_TASK = 100_000
TASKS = 20_000  # of larger tables, ranges and tasks grow so that there are about so many

_FIELDS = {"edge_id": pa.int64(), "endpoint": pa.string(), "kind": pa.string(), "indexed_at": pa.int64(), "reason": pa.string()}


def lives(nodes: DataFrame, removals: DataFrame) -> DataFrame:
    """id, at, gone: one row per distinct appearance and removal. A null id is no key; a null time is no event but shows that the id exists."""
    seen = nodes.where(F.col("id").isNotNull()).select("id", F.col("updated_at").alias("at"), F.lit(False).alias("gone"))
    removed = removals.where(F.col("id").isNotNull() & F.col("removed_at").isNotNull()).select("id", F.col("removed_at").alias("at"), F.lit(True).alias("gone"))
    return seen.unionByName(removed).distinct()


class _Lives:
    """The lives of one range of keys as arrays sorted by hash and time, of which only the changes between there and gone are kept."""

    def __init__(self) -> None:
        self.hash, self.at, self.gone = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        self.ids = pa.array([], pa.string())
        self.waiting: list[tuple] = []
        self.held = 0

    def add(self, hashes: np.ndarray, ids: pa.Array, at: np.ndarray, gone: np.ndarray) -> None:
        self.waiting.append((hashes, ids, at, gone))
        self.held += len(hashes)
        if self.held >= 4 * EVENTS_PER_RANGE:
            self._sort()

    def _sort(self) -> None:
        parts = [(self.hash, self.ids, self.at, self.gone), *self.waiting]
        self.waiting, self.held = [], 0
        hashes, at, gone = (np.concatenate([p[k] for p in parts]) for k in (0, 2, 3))
        ids = pa.concat_arrays([p[1] for p in parts])
        order = np.lexsort((gone, at, pc.rank(ids, tiebreaker="dense").to_numpy() if len(ids) else at, hashes))
        hashes, at, gone, ids = hashes[order], at[order], gone[order], ids.take(pa.array(order))
        if len(hashes):
            other = np.concatenate([[True], pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)])
            kept = np.flatnonzero(other | np.concatenate([[True], gone[1:] != gone[:-1]]))
            hashes, at, gone, ids = hashes[kept], at[kept], gone[kept], ids.take(pa.array(kept))
        self.hash, self.at, self.gone, self.ids = hashes, at, gone, ids

    def close(self) -> None:
        self._sort()
        n = len(self.hash)
        other = np.concatenate([[True], pc.not_equal(self.ids[1:], self.ids[:-1]).to_numpy(zero_copy_only=False)]) if n else np.empty(0, bool)
        self.begin = np.flatnonzero(other)
        self.end = np.append(self.begin[1:], n)
        self.keys, self.names = self.hash[self.begin], self.ids.take(pa.array(self.begin))
        self.known = np.logical_or.reduceat(~self.gone, self.begin) if n else np.empty(0, bool)

    def reasons(self, hashes: np.ndarray, ids: pa.Array, when: np.ndarray) -> np.ndarray:
        """0 exists, 1 missing, 2 late, 3 deleted."""
        out = np.ones(len(hashes), dtype=np.int64)
        if not len(self.keys):
            return out
        first = np.searchsorted(self.keys, hashes, "left")
        last = np.searchsorted(self.keys, hashes, "right")
        rows, group = np.flatnonzero(first < last), first[first < last]
        while len(rows):  # one step, but for keys of equal hash
            same = pc.equal(ids.take(pa.array(rows)), self.names.take(pa.array(group))).to_numpy(zero_copy_only=False)
            out[rows[same]] = self._at(group[same], when[rows[same]])
            more = ~same & (group + 1 < last[rows])
            rows, group = rows[more], group[more] + 1
        return out

    def _at(self, group: np.ndarray, when: np.ndarray) -> np.ndarray:
        begin = self.begin[group]
        low, high = begin.copy(), self.end[group].copy()
        while (low < high).any():  # the number of events up to the moment, by halving all intervals at once
            middle = (low + high) // 2
            up_to = (low < high) & (self.at[np.minimum(middle, len(self.at) - 1)] <= when)
            low = np.where(up_to, middle + 1, low)
            high = np.where((low <= high) & ~up_to, np.minimum(middle, high), high)
        return np.where(~self.known[group], 1, np.where(low == begin, 2, np.where(self.gone[np.maximum(low - 1, 0)], 3, 0)))


_REASON = np.array([None, "missing", "late", "deleted"], dtype=object)


def _probe(with_kind: bool):  # noqa: ANN202
    """A partition has the lives of one range and then references to it."""
    fields = {k: t for k, t in _FIELDS.items() if with_kind or k in ("edge_id", "endpoint", "reason")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, closed = _Lives(), False
        for batch in batches:
            refs = batch["is_reference"].to_numpy(zero_copy_only=False)
            n = int(np.searchsorted(refs, True))
            if n:
                b = batch.slice(0, n)
                at = b["at"].fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
                table.add(b["hash"].to_numpy(zero_copy_only=False), b["id"], at, b["gone"].to_numpy(zero_copy_only=False))
            if n == batch.num_rows:
                continue
            if not closed:
                table.close()
                closed = True
            b = batch.slice(n)
            when = b["at"].fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            code = table.reasons(b["hash"].to_numpy(zero_copy_only=False), b["id"], when)
            hit = np.flatnonzero(code)
            if len(hit):
                kept = b.take(pa.array(hit))
                source = kept["gone"].to_numpy(zero_copy_only=False)  # of a reference: whether it is the edge's source
                columns = {"edge_id": kept["edge_id"], "endpoint": pa.array(np.where(source, "source", "target").tolist(), pa.string()), "reason": pa.array(_REASON[code[hit]], pa.string())}
                if with_kind:
                    columns |= {"kind": kept["kind"], "indexed_at": kept["at"]}
                yield pa.RecordBatch.from_arrays([columns[k] for k in fields], schema=pa.schema(list(fields.items())))

    return run


def orphans(
    edges: DataFrame, nodes: DataFrame, removals: DataFrame, events_per_range: int = EVENTS_PER_RANGE, references_per_task: int = REFERENCES_PER_TASK,
    with_kind: bool = True, hashed: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """edge_id, endpoint, kind, indexed_at, reason of each end of an edge that didn't exist when the edge was written.

    'missing': the id has no row in ``nodes``; 'late': nothing of it up to indexed_at; 'deleted': the last thing up to
    then is a removal (at the same moment a removal counts as the later).  A null endpoint refers to nothing and is no
    case; a null indexed_at comes before everything.  An id that only has removals is missing.  Repeated edge rows are
    reported each.  with_kind=False leaves out kind and indexed_at.  Ids of equal hash are told apart by their text.
    """
    n_events, n_edges = nodes.count() + removals.count(), edges.count()
    events_per_range, references_per_task = max(events_per_range, n_events // TASKS), max(references_per_task, 2 * n_edges // TASKS)
    ranges = max(1, -(-n_events // events_per_range))
    placed = lambda df: df.withColumn("hash", hashed(F.col("id")).cast("bigint")).withColumn("range", F.least(F.floor((F.col("hash") / F.lit(2.0**64) + 0.5) * ranges), F.lit(ranges - 1)).cast("int"))
    ends = F.explode(F.array(F.struct(F.lit(True).alias("source"), F.col("source").alias("id")), F.struct(F.lit(False).alias("source"), F.col("target").alias("id"))))
    kinds = ["kind"] if with_kind else []
    references = edges.select("edge_id", *kinds, F.col("indexed_at").alias("at"), ends.alias("e")).where(F.col("e.id").isNotNull())
    references = placed(references.select("edge_id", *kinds, "at", F.col("e.source").alias("gone"), F.col("e.id").alias("id")))
    # Ranges with more references than a task takes get further parts; parts are numbered, and each is one partition.
    parts = references.groupBy("range").agg(F.ceil(F.count("*") / references_per_task).cast("int").alias("parts")).where("parts > 1")
    before = F.sum(F.col("parts") - 1).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    heavy = cut_lineage(parts.select("range", "parts", (F.lit(ranges) + F.coalesce(before, F.lit(0))).cast("int").alias("first")))
    slots = ranges + (heavy.agg(F.sum(F.col("parts") - 1)).first()[0] or 0)
    slot = F.when(F.col("part") > 0, F.col("first") + F.col("part") - 1).otherwise(F.col("range")).alias("slot")
    dealt = references.join(heavy, "range", "left").withColumn("part", F.pmod(F.xxhash64("edge_id", "gone"), F.coalesce("parts", F.lit(1))))
    held = placed(lives(nodes, removals)).join(heavy, "range", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    columns = lambda df, reference: df.select(
        slot.cast("int"), F.lit(reference).alias("is_reference"), "hash", "id", "at", "gone", *([] if reference else [F.lit(None).cast("bigint").alias("edge_id")]), *(["edge_id"] if reference else []),
        *(kinds if reference else [F.lit(None).cast("string").alias(k) for k in kinds]),
    )
    together = columns(dealt, True).unionByName(columns(held, False)).repartitionById(int(slots), "slot").sortWithinPartitions("is_reference").drop("slot")
    schema = "edge_id bigint, endpoint string, kind string, indexed_at bigint, reason string" if with_kind else "edge_id bigint, endpoint string, reason string"
    return in_batches(together, _probe(with_kind), schema, arrow=True)


def orphan_rates(found: DataFrame) -> DataFrame:
    """Orphans per edge kind and month of indexed_at (UTC), by endpoint and reason."""
    month = F.date_format(F.timestamp_millis("indexed_at"), "yyyy-MM")
    return found.groupBy("kind", month.alias("month"), "endpoint", "reason").agg(F.count("*").alias("orphans"))
