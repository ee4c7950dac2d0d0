"""The tables behind an answer. Whatever comes to the driver is bounded: rows of stated ids, or so many per id."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import names
from graphloom.operators import fulltext, graph, search
from graphloom.operators.fulltext import Index
from graphloom.session import cut_lineage
from graphloom.sources.repository import slice_lines

SHOWN = ("id", "kind", "name", "qualified_name", "file_path", "language", "start_line", "end_line", "signature", "docstring", "name_split")


class Store:
    """Nodes in force, edges, files and texts; with a stored index of the nodes if there is one."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, files: DataFrame, texts: DataFrame, index: Index | None = None, project_words: frozenset[str] = frozenset()) -> None:
        self.raw, self.edges, self.files, self.texts, self._index, self.project_words = nodes, edges, files, texts, index, project_words
        columns = [*SHOWN, *(c for c in ("updated_at",) if c in nodes.columns)]
        self.narrow = nodes.select(*columns)
        self.nodes = self.narrow if index else cut_lineage(self.in_force(self.narrow))

    @property
    def index(self) -> Index:
        """The inverted index of the nodes, written once if none was given."""
        if self._index is None:
            built = fulltext.build(self.nodes)
            self._index = Index(cut_lineage(built.postings.sortWithinPartitions("term")), cut_lineage(built.lengths))
        return self._index

    @staticmethod
    def in_force(nodes: DataFrame) -> DataFrame:
        return graph.in_force(nodes) if "updated_at" in nodes.columns else nodes

    def rows(self, df: DataFrame) -> list[dict]:
        """Node rows with what ranking asks about their paths."""
        told = df.withColumn("is_test", F.coalesce(names.is_test(F.col("file_path")), F.lit(False))).withColumn("is_generated", F.coalesce(names.is_generated(F.col("file_path")), F.lit(False)))
        return [r.asDict() | {"file_path": r["file_path"] or "", "name": r["name"] or ""} for r in told.collect()]

    def by_ids(self, ids: Iterable[str]) -> dict[str, dict]:
        wanted = list(dict.fromkeys(ids))
        return {r["id"]: r for r in self.rows(self.nodes.where(F.col("id").isin(*wanted)))} if wanted else {}

    def named(self, wanted: Sequence[str], kinds: Sequence[str], limit: int) -> DataFrame:
        """The best ``limit`` of the nodes of these names."""
        return search.per_name(self.nodes.where(F.col("kind").isin(*kinds)), list(wanted), limit).orderBy(F.desc("score"), "id").limit(limit)

    def adjacent(self, ids: Sequence[str], per: int, kinds: Sequence[str] = (), direction: str = "both", node_kinds: Sequence[str] = ()) -> dict[str, list[dict]]:
        """Per id its first ``per`` edges to nodes (of some kinds) that exist: contains before calls before others, then by edge id."""
        if not ids:
            return {}
        seeds = self.edges.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], "id string")
        found = graph.adjacent(self.edges, F.broadcast(seeds), direction, kinds).where("source is not null and target is not null")  # stated ids
        known = self.nodes.where(F.col("kind").isin(*node_kinds)) if node_kinds else self.nodes
        priority = F.when(F.col("kind") == "contains", 0).when(F.col("kind") == "calls", 1).otherwise(2)
        order = Window.partitionBy("at").orderBy(priority, "edge_id")
        columns = ["at", "other", "source", "target", "kind", "edge_id", *(c for c in ("metadata", "provenance") if c in found.columns)]
        near = found.select(*columns).join(known.select(F.col("id").alias("other")), "other", "left_semi")
        near = near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per)
        out: dict[str, list[dict]] = {}
        for r in near.orderBy("at", "k").collect():
            out.setdefault(r["at"], []).append(r.asDict(recursive=True))
        return out

    def between(self, ids: Sequence[str], kinds: Sequence[str]) -> list[dict]:
        """Edges of some kinds both ends of which are among stated ids, one for each source, target and kind."""
        if not ids:
            return []
        inner = graph.of_kinds(self.edges, kinds).where(F.col("source").isin(*ids) & F.col("target").isin(*ids))
        rest = [c for c in ("metadata", "provenance") if c in inner.columns]
        one = inner.groupBy("source", "target", "kind").agg(F.min_by(F.struct("edge_id", *rest), "edge_id").alias("e"))
        return [{**r["e"].asDict(recursive=True), "source": r["source"], "target": r["target"], "kind": r["kind"]} for r in one.orderBy("e.edge_id").collect()]

    def core_folder(self) -> str | None:
        """The folder of the file with most inner edges, if it has three times as many as the next."""
        best = graph.dominant_files(self.edges, self.nodes).orderBy("rank").limit(2).collect()
        if not best or len(best) > 1 and best[0]["edges"] < 3 * best[1]["edges"] or "/" not in best[0]["file_path"]:
            return None
        return best[0]["file_path"].rpartition("/")[0] + "/"

    def code(self, nodes: Sequence[dict]) -> dict[str, str]:
        """id -> source lines of stated nodes; constants of configuration languages are shown by their signature."""
        leaf = {n["id"]: n["signature"] or n["qualified_name"] or n["name"] for n in nodes if n["kind"] == "constant" and n["language"] in ("yaml", "properties", "xml")}
        wanted = [(n["id"], n["file_path"], n["start_line"], n["end_line"]) for n in nodes if n["id"] not in leaf and n["start_line"]]
        if not wanted:
            return leaf
        spans = F.broadcast(self.edges.sparkSession.createDataFrame(wanted, "id string, path string, first int, last int"))  # stated nodes
        text = self.texts.where(F.col("path").isin(*{w[1] for w in wanted})).select("path", "content")
        cut = text.join(spans, "path").select("id", slice_lines(F.col("content"), F.col("first"), F.greatest("first", "last")).alias("code"), F.size(F.split("content", "\n")).alias("n"), "first")
        return leaf | {r["id"]: r["code"] for r in cut.where("first <= n and code is not null").collect()}

    def file_texts(self, paths: Sequence[str]) -> dict[str, str]:
        return {r["path"]: r["content"] for r in self.texts.where(F.col("path").isin(*paths) & F.col("content").isNotNull()).select("path", "content").collect()} if paths else {}
