"""One object with the questions that people ask: search, callers, callees, a way between two symbols, a symbol's code, a file's symbols."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.context import explore, render, retrieve
from graphloom.context import questions as Q
from graphloom.context.store import Store
from graphloom.index import Index
from graphloom.operators import graph, search
from graphloom.plans.base import Tables
from graphloom.sources.repository import slice_lines

DEFINITIONS = 6  # definitions of a name that one answer covers: a feature of the answers


SHOWN_DEFINITIONS, TRAIL, LINES = 8, 8, 2000  # of one answer: definitions, names of callers or callees, lines of a file
# Kinds that a search can be narrowed to; any other word narrows nothing.
KINDS = frozenset("function method class interface struct enum trait type_alias variable constant module namespace import export property field file route component protocol enum_member parameter".split())


class Engine:
    """Answers over the tables of a folder, or over a stored index. Unknown names give empty answers or a word of guidance, never errors."""

    def __init__(self, spark: SparkSession, folder: str, project_words: frozenset[str] = frozenset()) -> None:
        index = Index(spark, folder)
        self.stored = index if index.ready and self._has(index, "postings") else None
        self.tables = self.stored or Tables(spark, folder)
        self.project_words = project_words
        self.ready = index.ready
        self.nodes = self.tables.now if self.ready else None

    @staticmethod
    def _has(index: Index, name: str) -> bool:
        where = index.spark._jvm.org.apache.hadoop.fs.Path(index._path(name))
        return where.getFileSystem(index.spark._jsc.hadoopConfiguration()).exists(where)

    @cached_property
    def store(self) -> Store:
        t = self.tables
        return self.stored.store(self.project_words) if self.stored else Store(t.nodes, t.edges, t.files, t.file_content, project_words=self.project_words)

    @cached_property
    def n_files(self) -> int:
        return self.tables.files.select("path").distinct().count()

    def context(self, question: str, o: retrieve.Options = retrieve.RETRIEVAL) -> str:
        """The context of a question as Markdown."""
        return render.markdown(self.store, question, o)

    def explore(self, question: str, max_files: int | None = None) -> str:
        """The files that answer a question, with their source, in the budget of the collection's size; 20 files at most."""
        return explore.explore(self.store, question, min(20, max_files) if max_files else None, self.n_files)[0]

    def node(self, symbol: str | None = None, file: str | None = None, code: bool = False, offset: int = 1, limit: int = LINES, symbols_only: bool = False) -> str:
        """A symbol's definitions with callers and callees, or a file's lines (or its symbols)."""
        if symbol:
            return self._definitions_text(symbol, file, code)
        if not file:
            return "Name a symbol to read its definitions, or a file to read its lines."
        paths = self.file(file)
        if len(paths) != 1:
            return f'"{file}" means {len(paths)} files; name one of them:\n' + "\n".join(f"  - {p}" for p in paths[:10]) if paths else f'No indexed file matches "{file}".'
        (path,) = paths
        if symbols_only:
            return "\n".join([f"// {path}", *(f"{r['start_line']}\t{r['kind']} {r['name']}{r['signature'] or ''}" for r in self.symbols(path).collect())])
        text = self.store.file_texts([path]).get(path)
        if text is None:
            return f"{path} has no text in the index."
        deps = [r["dependent"] for r in graph.dependents(self.tables.edges, self.nodes.select("id", "file_path")).where(F.col("file_path") == path).orderBy("dependent").limit(50).collect()]
        out = [f"// {len(deps)} file(s) depend on {path} (e.g. {', '.join(deps[:3])})"] if deps else []
        lines, first = text.split("\n"), max(1, offset)
        out.append(f"// {path}")
        out.append(Q.numbered("\n".join(lines[first - 1 : first - 1 + limit]), first) if first <= len(lines) else f"// (line {first} is past the end: {len(lines)} lines)")
        return "\n".join(out)

    def _definitions_text(self, symbol: str, file: str | None, code: bool) -> str:
        found = self.store.rows(self.definitions(symbol, file, SHOWN_DEFINITIONS))
        if not found:
            return f'No symbol named "{symbol}" is indexed. Search for the right name, or explore the area.'
        source = self.store.code(found) if code else {}
        trails = [(word, self.store.adjacent([n["id"] for n in found], TRAIL, graph.CALL_KINDS, way)) for word, way in (("callers", "in"), ("calls", "out"))]
        known = self.store.by_ids(e["other"] for _, near in trails for es in near.values() for e in es)
        out = [f'{len(found)} definitions of "{symbol}":\n'] if len(found) > 1 else []
        for n in found:
            out.append(f"### {n['kind']} — {n['qualified_name'] or n['name']} ({n['file_path']}:{n['start_line']}-{n['end_line']})")
            out += [f"`{n['signature']}`"] if n["signature"] else []
            out += [f"```{n['language'] or ''}", Q.numbered(source[n["id"]], n["start_line"] or 1), "```"] if n["id"] in source else []
            out += [f"{word}: {', '.join(known[e['other']]['name'] for e in near[n['id']])}" for word, near in trails if near.get(n["id"])] + [""]
        return "\n".join(out)

    def search(self, query: str, kind: str | None = None, limit: int = 10) -> DataFrame:
        return search.search(self.store.nodes, query, limit, (kind,) if kind in KINDS else (), self.project_words, self.store.index).select("id", "name", "kind", "file_path", "start_line", "score")

    def definitions(self, symbol: str, file: str | None = None, limit: int = DEFINITIONS) -> DataFrame:
        """Nodes of a name, functions and methods first, then types; of a file only, if one is given."""
        rank = F.when(F.col("kind").isin("function", "method"), 0).when(F.col("kind").isin("class", "struct", "interface", "trait"), 1).otherwise(2)
        found = self.nodes.where((F.col("name") == symbol) | (F.col("qualified_name") == symbol))
        if file:
            found = found.where(F.col("file_path").endswith(file))
        return found.orderBy(rank, "file_path", "start_line", "id").limit(limit)

    def _around(self, symbol: str, direction: str, depth: int, file: str | None, limit: int) -> DataFrame:
        seeds = self.definitions(symbol, file).select("id")
        reached = graph.reach(self.tables.edges, self.nodes, seeds, depth, direction, graph.CALL_KINDS).where("depth > 0")
        named = self.nodes.select(F.col("id").alias("node_id"), "name", "kind", "file_path", "start_line")
        return reached.join(named, "node_id").select("seed", "depth", "name", "kind", "file_path", "start_line").orderBy("seed", "depth", "file_path", "start_line", "name").limit(limit)

    def callers(self, symbol: str, depth: int = 2, file: str | None = None, limit: int = 20) -> DataFrame:
        return self._around(symbol, "in", depth, file, limit)

    def callees(self, symbol: str, depth: int = 2, file: str | None = None, limit: int = 20) -> DataFrame:
        return self._around(symbol, "out", depth, file, limit)

    def trace(self, start: str, end: str) -> list[str]:
        """Ids on a shortest way between the first definitions of two names; empty if there is none."""
        a, b = self.definitions(start, limit=1).first(), self.definitions(end, limit=1).first()
        return (graph.shortest_path(self.tables.edges, self.nodes, a["id"], b["id"]) or []) if a and b else []

    def code(self, symbol: str, file: str | None = None) -> DataFrame:
        """The definitions of a name with their source."""
        texts = self.tables.file_content.select(F.col("path").alias("file_path"), "content")
        found = self.definitions(symbol, file).join(texts, "file_path", "left")
        return found.select("id", "kind", "file_path", "start_line", "signature", "docstring", slice_lines(F.col("content"), F.col("start_line"), F.col("end_line")).alias("code"))

    def file(self, fragment: str) -> list[str]:
        """The path that a fragment means: itself, the only one that ends with it, or the only one that holds it; else all candidates (fifty at most)."""
        paths = self.tables.files.where("path is not null").select("path").distinct()
        for test in (F.col("path") == fragment, F.col("path").endswith(f"/{fragment}"), F.lower("path").contains(fragment.lower())):
            found = [r["path"] for r in paths.where(test).orderBy("path").limit(50).collect()]
            if found:
                return found
        return []

    def symbols(self, path: str) -> DataFrame:
        return self.nodes.where((F.col("file_path") == path) & (F.col("kind") != "file")).select("start_line", "kind", "name", "signature").orderBy("start_line", "name")
