"""A stored index: nodes, edges, files, references, texts, and the postings that full-text search reads.

Every table is partitioned by a hash of the file that a row belongs to, so a changed file costs the rewriting of its
part only, postings included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.context.store import Store
from graphloom.functions import names
from graphloom.operators import fulltext, resolve, synth
from graphloom.session import cut_lineage
from graphloom.sources import extract
from graphloom.sources.repository import read_repository

PARTS = 64  # of each table; a larger collection takes more
TABLES = ("nodes", "edges", "files", "unresolved_refs", "file_content", "postings", "lengths")


def _keyed(df: DataFrame, path: str, parts: int) -> DataFrame:
    return df.withColumn("part", F.pmod(F.xxhash64(F.coalesce(path, F.lit(""))), F.lit(parts)).cast("int"))


def one_per_id(nodes: DataFrame) -> DataFrame:
    """The last row of each id, with its name split into words (null if there is only one)."""
    split = F.nullif(names.camel_split(F.col("name")), F.lit(""))
    rest = [c for c in nodes.columns if c not in ("id", "name_split")]
    order = F.struct(*([F.col("updated_at")] if "updated_at" in rest else []), F.coalesce("start_line", F.lit(-1)), F.coalesce("end_line", F.lit(-1)), F.coalesce("qualified_name", F.lit("")))
    last = nodes.where("id is not null").groupBy("id").agg(F.max_by(F.struct(*rest), order).alias("n"))
    return last.select("id", "n.*").withColumn("name_split", split)


class Index:
    """An index in a folder. Tables that were never written are absent; ``ready`` tells."""

    def __init__(self, spark: SparkSession, folder: str, parts: int = PARTS) -> None:
        self.spark, self.folder, self.parts = spark, folder.rstrip("/"), parts

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._path(name)).drop("part")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        if name == "now":
            return self.table("nodes")
        raise AttributeError(name)

    @property
    def ready(self) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self._path("nodes"))
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def _put(self, name: str, df: DataFrame, path: str, dynamic: bool = False) -> None:
        keyed = _keyed(df, path, self.parts).repartition("part")
        order = {"postings": ["part", "term"], "nodes": ["part", "file_path", "start_line"]}.get(name, ["part"])
        w = keyed.sortWithinPartitions(*order).write.mode("overwrite").partitionBy("part").option("compression", "zstd")
        (w.option("partitionOverwriteMode", "dynamic") if dynamic else w).parquet(self._path(name))

    def _postings(self, nodes: DataFrame) -> dict[str, DataFrame]:
        built, place = fulltext.build(nodes), nodes.select("id", "file_path")
        return {"postings": built.postings.join(place, "id"), "lengths": built.lengths.join(place, "id")}

    def write(self, nodes: DataFrame, edges: DataFrame, files: DataFrame, refs: DataFrame, texts: DataFrame | None = None) -> None:
        """The whole index anew (K1): one node per id, its split name, edges with the file of their source, postings."""
        n = cut_lineage(one_per_id(nodes))
        where = n.select(F.col("id").alias("source"), F.col("file_path").alias("__f"))
        self._put("nodes", n, "file_path")
        self._put("edges", edges.join(where, "source", "left").withColumnRenamed("__f", "from_file"), "from_file")
        self._put("files", files.where("path is not null"), "path")
        self._put("unresolved_refs", refs, "file_path")
        if texts is not None:
            self._put("file_content", texts.where("path is not null").select("path", "content"), "path")
        for name, df in self._postings(n).items():
            self._put(name, df, "file_path")

    def replace_files(self, nodes: DataFrame, edges: DataFrame, files: DataFrame, refs: DataFrame, texts: DataFrame | None = None, removed: DataFrame | None = None) -> None:
        """Put new rows of some files in the place of the old ones (K2, K3), and drop removed files (column path).

        Only the parts of those files are read and written; what else stands in them stays as it is.
        """
        gone = files.select("path") if removed is None else files.select("path").unionByName(removed.select("path"))
        gone = cut_lineage(gone.where("path is not null").distinct())
        parts = [r["part"] for r in _keyed(gone, "path", self.parts).select("part").distinct().collect()]  # at most self.parts
        n = cut_lineage(one_per_id(nodes))
        where = n.select(F.col("id").alias("source"), F.col("file_path").alias("__f"))
        fresh = {"nodes": (n, "file_path"), "edges": (edges.join(where, "source", "left").withColumnRenamed("__f", "from_file"), "from_file"), "files": (files, "path"), "unresolved_refs": (refs, "file_path")}
        if texts is not None:
            fresh["file_content"] = (texts.select("path", "content"), "path")
        fresh |= {k: (df, "file_path") for k, df in self._postings(n).items()}
        for name, (df, path) in fresh.items():
            old = self.spark.read.parquet(self._path(name)).where(F.col("part").isin(*parts)).drop("part")
            kept = old.join(gone.select(F.col("path").alias("__gone")), F.col(path) == F.col("__gone"), "left_anti")
            whole = cut_lineage(kept.unionByName(df, allowMissingColumns=True))
            emptied = [p for p in parts if p not in {r[0] for r in _keyed(whole, path, self.parts).select("part").distinct().collect()}]
            self._put(name, whole, path, dynamic=True)
            for p in emptied:  # a part without rows isn't overwritten, so it is deleted
                at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._path(name)}/part={p}")
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
            self.spark.catalog.refreshByPath(self._path(name))

    def append_edges(self, edges: DataFrame) -> None:
        """Further edges of files that are there (K4)."""
        where = self.table("nodes").select(F.col("id").alias("source"), F.col("file_path").alias("from_file"))
        _keyed(edges.join(where, "source", "left"), "from_file", self.parts).write.mode("append").partitionBy("part").option("compression", "zstd").parquet(self._path("edges"))

    def clear(self, *tables: str) -> None:
        """Empty some tables, or all (K5)."""
        for name in tables or TABLES:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name))
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def store(self, project_words: frozenset[str] = frozenset()) -> Store:
        """What answers questions, over the stored nodes and postings."""
        nodes = self.table("nodes")
        missing = [F.lit(None).cast("string").alias(c) for c in ("docstring", "signature", "name_split") if c not in nodes.columns]
        return Store(nodes.select("*", *missing).drop("updated_at"), self.table("edges"), self.table("files"), self.table("file_content"), fulltext.Index(self.table("postings"), self.table("lengths")), project_words)


def graph_of(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, references) of source texts (path, content): extracted, resolved and completed by synthesis."""
    rows = cut_lineage(extract.extract(texts))
    nodes, edges = cut_lineage(extract.nodes_of(rows)), extract.edges_of(rows)
    refs = cut_lineage(extract.references_of(rows))
    files = texts.select("path").where("path is not null").distinct()
    found = resolve.resolved_edges(refs, nodes, files, texts)
    none = lambda c, t="string": F.lit(None).cast(t).alias(c)
    every = cut_lineage(
        edges.select("source", "target", "kind", "line", none("confidence", "double"), none("resolved_by"), none("via"), none("provenance"))
        .unionByName(found.select("source", "target", "kind", "line", "confidence", "resolved_by", none("via"), "provenance"))
    )
    made = synth.synthesize(nodes, every).select("source", "target", "kind", none("line", "int"), none("confidence", "double"), F.col("synthesized_by").alias("resolved_by"), "via", F.when(F.col("synthesized_by").isNotNull(), F.lit("heuristic")).alias("provenance"))
    whole = every.unionByName(made)
    return nodes, whole.withColumn("edge_id", F.xxhash64("source", "target", "kind", "line", "resolved_by", "via")), refs


def index_repository(spark: SparkSession, root: str, folder: str, rules: list[str] | None = None) -> Index:
    """Read a repository and write its index."""
    texts = cut_lineage(read_repository(spark, root, rules))
    nodes, edges, refs = graph_of(texts)
    index = Index(spark, folder)
    per = nodes.groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("node_count"))
    index.write(nodes, edges, texts.drop("content").join(per, "path", "left"), refs, texts)
    return index


def reindex(index: Index, texts: DataFrame, removed: DataFrame | None = None) -> None:
    """Take changed files (path, content, ...) into an index. References of other files into them are resolved again only when those files change."""
    texts = cut_lineage(texts)
    nodes, edges, refs = graph_of(texts)
    files = texts.select("path", F.sha2("content", 256).alias("content_hash"), names.language(F.col("path")).alias("language"), F.octet_length("content").cast("bigint").alias("size"))
    index.replace_files(nodes, edges, files, refs, texts, removed)
