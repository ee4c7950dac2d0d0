"""The part of a graph that answers a question: hits of several channels, their neighbourhood, and caps that keep it varied.

Names, full text and parts of names are looked for over whole tables; each channel brings at most a stated number of
rows to the driver (a top-k), and all that follows works on those.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.context import questions as Q
from graphloom.context.store import Store
from graphloom.functions import names
from graphloom.functions.query_text import search_terms, stems
from graphloom.operators import search
from graphloom.operators.graph import CALL_KINDS

# Kinds of nodes that answer questions, that define something, that text search looks at, that have a hierarchy.
ANSWERS = "function method class interface type_alias struct trait component route variable constant enum module namespace".split()
DEFINITIONS = "class interface struct trait protocol enum type_alias".split()
TEXT_KINDS = "file module class struct interface trait protocol function method property field variable constant enum enum_member type_alias namespace export route component".split()
HIERARCHIC = frozenset("class interface struct trait protocol".split())
RECOVERED = ("calls", "extends", "implements", "references", "overrides")


@dataclass(frozen=True)
class Options:
    nodes: int = 20
    blocks: int = 5
    block_size: int = 1500
    code: bool = True
    hits: int = 3
    depth: int = 1
    least: float = 0.3


DEFAULT = Options()
EXPLORE = Options(nodes=200, blocks=0, block_size=0, code=False, hits=8, depth=3, least=0.2)
RETRIEVAL = Options(blocks=8, block_size=2000, hits=8, depth=2)


@dataclass
class Subgraph:
    """nodes in the order in which they were met, edges, the hits they grew from, and whether those are to be trusted."""

    nodes: dict[str, dict] = field(default_factory=dict)
    edges: dict[tuple[str, str, str], dict] = field(default_factory=dict)
    roots: list[str] = field(default_factory=list)
    sure: bool = True

    def link(self, e: dict) -> None:
        self.edges.setdefault((e["source"], e["target"], e["kind"]), e)

    def prune(self) -> None:
        self.edges = {k: e for k, e in self.edges.items() if k[0] in self.nodes and k[1] in self.nodes}


def _ranked(rows: list[dict], most: int | None = None) -> list[dict]:
    return sorted(rows, key=lambda r: (-r["score"], r["id"]))[:most]


def colocated(found: DataFrame) -> DataFrame:
    """20 more for each further name that hits the same file."""
    per = found.groupBy("file_path").agg(F.countDistinct(F.lower("name")).alias("n"))
    return found.join(per, found["file_path"].eqNullSafe(per["file_path"])).drop(per["file_path"]).withColumn("score", F.col("score") + 20.0 * (F.col("n") - 1)).drop("n")


def by_exact_name(store: Store, symbols: list[str], hits: int) -> DataFrame:
    """The nodes that a question names, those first whose file it names most of."""
    return colocated(store.named(symbols, ANSWERS, 5 * hits)).orderBy(F.desc("score"), "id").limit(2 * hits)


def _definitions(store: Store, symbols: list[str], hits: int) -> list[dict]:
    """Definitions whose names begin with a symbol or a form of it, shorter ones first."""
    forms = list(dict.fromkeys([*symbols, *(v for s in symbols for v in stems(s))]))
    asked = list(dict.fromkeys(Q.title(s) for s in forms if Q.title(s) != s))
    found = search.search_many(store.nodes, asked, 30, tuple(DEFINITIONS), store.project_words, store.index)
    begins = found.where(F.expr("startswith(lower(name), lower(query))"))
    shortness = F.greatest(F.lit(0.0), F.lit(10.0) - (F.length("name") - F.length("query")) / 3.0)
    scored = begins.withColumn("score", F.col("score") + 15.0 + shortness)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    rows = store.rows(scored.withColumn("k", F.row_number().over(order)).where(F.col("k") <= hits).drop("k"))
    place = {q: i for i, q in enumerate(asked)}
    first: dict[str, dict] = {}
    for r in sorted(rows, key=lambda r: (place[r["query"]], -r["score"], r["id"])):
        first.setdefault(r["id"], r)
    return list(first.values())


def by_text(store: Store, terms: list[str], hits: int) -> DataFrame:
    """Full-text hits of each term; a node that several terms hit gains five for each further one."""
    found = search.search_many(store.nodes, terms, 2 * hits, tuple(TEXT_KINDS), store.project_words, store.index)
    rest = [c for c in found.columns if c not in ("id", "query", "score")]
    per = found.groupBy("id").agg(F.max("score").alias("best"), F.count("*").alias("n"), F.first(F.struct(*rest)).alias("r"))
    return per.select("id", "r.*", (F.col("best") + 5.0 * (F.col("n") - 1)).alias("score")).orderBy(F.desc("score"), "id").limit(2 * hits)


def inside_names(nodes: DataFrame, titles: list[str], within: bool, per: int = 200) -> DataFrame:
    """title and the node columns: definitions with a word in their names, the ``per`` shortest for each word.

    within: not at the beginning of the name.
    """
    chosen, low = nodes.where(F.col("kind").isin(*DEFINITIONS)), F.lower("name")
    hit = lambda t: low.contains(t.lower()) & (~low.startswith(t.lower()) if within else F.lit(True))
    each = chosen.withColumn("title", F.explode(F.array(*(F.when(hit(t), t) for t in titles)))).where("title is not null")
    return each.withColumn("k", F.row_number().over(Window.partitionBy("title").orderBy(F.length("name"), "id"))).where(F.col("k") <= per).drop("k")


def _path_points(store: Store, rows: DataFrame, question: str) -> list[dict]:
    return store.rows(rows.withColumn("points", names.path_relevance(F.col("file_path"), question, store.project_words)))


def camel_hits(store: Store, question: str, symbols: list[str], known: set[str], hits: int) -> list[dict]:
    """Definitions in whose camel-case name a word begins after another."""
    titles = list(dict.fromkeys(t for t in map(Q.title, symbols) if len(t) >= 3))
    if not titles:
        return []
    per_title: dict[str, list[dict]] = defaultdict(list)
    for r in _path_points(store, inside_names(store.nodes, titles, within=True), question):
        at = r["name"].find(r["title"])
        if at > 0 and r["name"][at - 1].isascii() and r["name"][at - 1].isalpha() and r["id"] not in known and (not r["is_test"] or Q.about_tests(question)):
            r["score"] = 8.0 + max(0.0, 6.0 - (len(r["name"]) - len(r["title"])) / 4.0) + r["points"]
            per_title[r["title"]].append(r)
    first: dict[str, dict] = {}
    n: Counter = Counter()
    for t in titles:
        for r in _ranked(per_title[t], 4 * math.ceil(hits / 2)):
            first.setdefault(r["id"], r)
            n[r["id"]] += 1
    return _ranked([r | {"score": r["score"] * (1.0 + n[i]) + 30.0 * (n[i] - 1)} for i, r in first.items()], hits)


def compound_hits(store: Store, question: str, symbols: list[str], known: set[str], hits: int) -> list[dict]:
    """Definitions with two or more of the words in their names."""
    titles = list(dict.fromkeys(t for t in map(Q.title, symbols) if len(t) >= 3))
    if len(symbols) < 2 or not titles:
        return []
    rows, words = {}, defaultdict(set)
    for r in _path_points(store, inside_names(store.nodes, titles, within=False), question):
        if r["id"] not in known and (not r["is_test"] or Q.about_tests(question)):
            rows[r["id"]] = r
            words[r["id"]].add(r["title"])
    scored = [r | {"score": 10.0 + 20.0 * (len(words[i]) - 1) + r["points"] + max(0.0, 6.0 - len(r["name"]) / 8.0)} for i, r in rows.items() if len(words[i]) >= 2]
    return _ranked(scored, math.ceil(hits / 2))


def concepts(terms: list[str]) -> list[list[str]]:
    """Terms that hold one another are one concept; the longest comes first."""
    left, out = sorted(terms, key=len, reverse=True), []
    while left:
        head = left[0]
        out.append([t for t in left if t in head or head in t])
        left = [t for t in left if t not in out[-1]]
    return out


def _touches(row: dict, terms: list[str]) -> bool:
    low, parts = row["name"].lower(), Q.folder(row["file_path"]).lower().split("/")
    return any(t in low or t in parts for t in terms)


def hits_of(store: Store, question: str, o: Options = DEFAULT) -> tuple[list[dict], bool]:
    """The nodes that answer a question best, and whether more than common words led to them."""
    if not question.strip():
        return [], True
    symbols, terms, tests = Q.symbols_of(question), search_terms(question), Q.about_tests(question)
    exact: list[dict] = []
    if symbols:
        exact = _ranked(store.rows(by_exact_name(store, symbols, o.hits)))
        known = {r["id"] for r in exact}
        exact = _ranked(exact + [r for r in _definitions(store, symbols, o.hits) if r["id"] not in known], 3 * o.hits)
    text = store.rows(by_text(store, terms, o.hits)) if terms else []
    merged: dict[str, dict] = {}
    for r in [*exact, *_ranked(text)]:
        merged[r["id"]] = merged.get(r["id"], r) | {"score": max(r["score"], merged.get(r["id"], r)["score"])}
    core = store.core_folder()
    distinctive = {s.lower() for s in symbols if Q.is_distinctive(s)}
    exact_ids, groups = {r["id"] for r in exact}, concepts(terms)
    for r in merged.values():
        r["score"] = r["score"] * (1.0 if tests or not r["is_test"] else 0.3) + (25.0 if core and r["file_path"].startswith(core) else 0.0)
        if len(terms) >= 2:
            met = sum(_touches(r, g) for g in groups)
            if met >= 2:
                r["score"] *= 1.0 + 0.5 * met
            elif not (r["id"] in exact_ids and r["name"].lower() in distinctive):
                r["score"] *= 0.3 if r["id"] in exact_ids else 0.6
    if symbols:
        for channel in (camel_hits, compound_hits):
            merged |= {r["id"]: r for r in channel(store, question, symbols, set(merged), o.hits)}
    best = [r for r in _ranked(list(merged.values()), 3 * o.hits) if r["score"] >= o.least]
    best = definitions_of_imports(store, best)[: o.hits]
    plain = [t for t in search_terms(question, stems=False) if len(t) >= 3]
    strong = len(plain) < 2 or not best or any(r["name"].lower() in distinctive or sum(_touches(r, [t]) for t in plain) >= 2 for r in best)
    return best, strong


def definitions_of_imports(store: Store, rows: list[dict]) -> list[dict]:
    """Imports and exports give way to what they lead to, with the same score; those that lead nowhere are dropped."""
    via = {"import": "imports", "export": "exports"}
    near = store.adjacent([r["id"] for r in rows if r["kind"] in via], 100, tuple(via.values()), "out")
    there = store.by_ids(e["target"] for es in near.values() for e in es)
    out: dict[str, dict] = {}
    for r in rows:
        if r["kind"] not in via:
            out.setdefault(r["id"], r)
        for e in near.get(r["id"], ()):
            if r["kind"] in via and e["kind"] == via[r["kind"]]:
                out.setdefault(e["target"], there[e["target"]] | {"score": r["score"]})
    return list(out.values())


def traverse(store: Store, start: str, depth: int = 1, limit: int = 1000, direction: str = "out", kinds: tuple[str, ...] = (), node_kinds: tuple[str, ...] = ()) -> tuple[list[str], list[dict]]:
    """Ids within ``depth`` steps in the order they are met, and the edges that first led to each.

    One query a level.  Contains edges come before calls and those before others; once ``limit`` ids are met no further
    one is expanded, and one id brings in at most ``limit``.  An unknown start gives nothing.
    """
    if start not in store.by_ids([start]):
        return [], []
    met, tree, level = {start: None}, [], [start]
    for _ in range(depth):
        if not level or len(met) >= limit:
            break
        near, fresh = store.adjacent(level, limit + len(met), kinds, direction, node_kinds), []
        for at in level:
            if len(met) >= limit:
                break
            for e in near.get(at, ()):
                if e["other"] not in met:
                    met[e["other"]] = None
                    tree.append(e)
                    fresh.append(e["other"])
        level = fresh
    return list(met), tree


def hops(store: Store, start: str, depth: int, direction: str = "in", limit: int = 1000) -> list[dict]:
    """Callers ('in') or callees ('out') depth first, as edges with ``other`` and ``depth``.

    A node is left once it was gone into; at the last level it comes once for each edge.  The edges of each level are
    read at once, at most ``limit`` for each node; that many rows are returned at most.
    """
    near: dict[str, list[dict]] = {}
    level = [start]
    for _ in range(depth):
        near |= store.adjacent(level, limit, CALL_KINDS, direction)
        level = list(dict.fromkeys(e["other"] for at in level for e in near.get(at, ()) if e["other"] not in near))
    out, gone = [], {start}
    ways = [iter(sorted(near.get(start, ()), key=lambda e: e["edge_id"]))]
    while ways and len(out) < limit:
        e = next(ways[-1], None)
        if e is None:
            ways.pop()
        elif e["other"] not in gone:
            out.append(e | {"depth": len(ways) - 1})
            if len(ways) < depth:
                gone.add(e["other"])
                ways.append(iter(sorted(near.get(e["other"], ()), key=lambda x: x["edge_id"])))
    return out


def type_family(store: Store, start: str, most: int) -> tuple[list[str], list[dict]]:
    """Types above a type and below it, and the edges that led to each; at most ``most`` in either direction."""
    met, tree = {start: None}, []
    for way in ("out", "in"):
        level, n = [start], 0
        while level and n < most:
            near, fresh = store.adjacent(level, most + 1, ("extends", "implements"), way), []
            for e in (e for at in level for e in near.get(at, ())):
                if e["other"] not in met and n < most:
                    met[e["other"]] = None
                    tree.append(e)
                    fresh.append(e["other"])
                    n += 1
            level = fresh
    return list(met), tree


def relevant(store: Store, question: str, o: Options = DEFAULT) -> Subgraph:
    """The subgraph of a question."""
    hits, sure = hits_of(store, question, o)
    sg = Subgraph({r["id"]: r for r in hits}, roots=[r["id"] for r in hits], sure=sure)
    if not hits:
        return sg
    room = math.ceil(o.nodes / 4)
    wanted: dict[str, None] = dict.fromkeys(sg.nodes)
    for seeds in (list(hits), None):  # the hits' own families, then those of the types found in them
        if seeds is None:
            seeds = [n for n in store.by_ids(i for i in wanted if i not in sg.nodes).values() if n["kind"] in HIERARCHIC]
        for r in seeds:
            added = len(wanted) - len(hits)
            if added >= room or r["kind"] not in HIERARCHIC:
                continue
            ids, tree = type_family(store, r["id"], room - added)
            wanted |= dict.fromkeys(ids)
            for e in tree:
                sg.link(e)
    for r in hits:
        ids, tree = traverse(store, r["id"], o.depth, math.ceil(o.nodes / len(hits)), "both", node_kinds=tuple(ANSWERS))
        wanted |= dict.fromkeys(ids)
        for e in tree:
            sg.link(e)
    known = store.by_ids(i for i in wanted if i not in sg.nodes)
    sg.nodes |= {i: known[i] for i in wanted if i in known}
    _trim(sg, o)
    if not Q.about_tests(question):
        outside = [i for i, n in sg.nodes.items() if n["is_test"]]
        for i in outside[max(3, math.ceil(0.15 * o.nodes)) :]:
            del sg.nodes[i]
        sg.roots = [i for i in sg.roots if i in sg.nodes or i not in outside]
    sg.prune()
    for e in store.between(list(sg.nodes), RECOVERED):
        sg.link(e)
    return sg


def _trim(sg: Subgraph, o: Options) -> None:
    """At most o.nodes, hits and their neighbours first; of one file a fifth of them, hits and types first."""
    if len(sg.nodes) > o.nodes:
        near = set(sg.roots)
        for a, b, _ in sg.edges:
            near |= {b} if a in near else set()
            near |= {a} if b in near else set()
        order = [i for i in sg.nodes if i in near] + [i for i in sg.nodes if i not in near]
        sg.nodes = {i: sg.nodes[i] for i in order[: o.nodes]}
        sg.prune()
    rank = lambda n: 10 * (n["id"] in sg.roots) + (3 if n["kind"] in HIERARCHIC or n["kind"] == "enum" else n["kind"] in ("method", "function"))
    per_file = defaultdict(list)
    for n in sg.nodes.values():
        per_file[n["file_path"]].append(n)
    for several in per_file.values():
        for n in sorted(several, key=rank, reverse=True)[max(5, math.ceil(0.2 * o.nodes)) :]:
            del sg.nodes[n["id"]]


