"""Exploring: the files that answer a question, ranked by how the graph connects them, with their source in a budget of characters."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.context import questions as Q
from graphloom.context.render import call_paths
from graphloom.context.retrieve import EXPLORE, Subgraph, relevant
from graphloom.context.store import Store
from graphloom.operators.graph import CALL_KINDS, WALK_KINDS

GLUE = 60  # neighbours of hits that are added from files already met
WHOLE_LINES = 220  # a file up to this is shown whole
CALLABLE = ("method", "function", "component")
WEIGHTS = {"named": 50.0, "hit": 10.0, "linked": 3.0, "met": 1.0}  # what a node adds to its file


@dataclass(frozen=True)
class Budget:
    output: int
    files: int
    per_file: int
    gap: int
    symbols: int
    edges: int
    told: bool  # relationships and a closing note are part of the answer


# From how many files on which budget holds.
BUDGETS = ((0, Budget(13000, 4, 3800, 7, 5, 4, False)), (150, Budget(18000, 5, 3800, 8, 6, 6, False)), (500, Budget(24000, 8, 6500, 12, 10, 10, True)), (5000, Budget(24000, 8, 7000, 15, 15, 15, True)))
CALLS = ((0, 1), (500, 2), (5000, 3), (15000, 4), (25000, 5))


def budget(files: int) -> Budget:
    return max((b for b in BUDGETS if b[0] <= files), key=lambda b: b[0])[1]


def calls_recommended(files: int) -> int:
    """How many explorations a project of that size deserves."""
    return max(n for least, n in CALLS if least <= files)


def add_glue(store: Store, sg: Subgraph) -> None:
    """Callers and callees of the hits that live in files already met."""
    files, added = {n["file_path"] for n in sg.nodes.values()}, 0
    near = [store.adjacent(sg.roots, 10 * GLUE, CALL_KINDS, way) for way in ("in", "out")]
    there = store.by_ids(e["other"] for es in near for x in es.values() for e in x)
    for root in sg.roots:
        for es in near:
            for e in es.get(root, ()):
                n = there.get(e["other"])
                if n and added < GLUE and n["id"] not in sg.nodes and n["file_path"] in files:
                    sg.nodes[n["id"]] = n
                    added += 1


def add_named(store: Store, sg: Subgraph, question: str) -> list[str]:
    """Ids of the definitions of identifiers that the question spells out; of many, those in a file or type it also names."""
    tokens = Q.identifiers_of(question)
    if not tokens:
        return []
    types = [t.lower() for t in tokens if Q.is_type_name(t)]
    found = store.nodes.where(F.col("name").isin(*tokens))
    per_name: dict[str, list[dict]] = defaultdict(list)
    order = F.row_number().over(Window.partitionBy("name").orderBy("file_path", "start_line", "id"))
    for n in store.rows(found.withColumn("k", order).where("k <= 60").drop("k")):
        if n["kind"] in CALLABLE and not n["is_test"]:
            per_name[n["name"]].append(n)
    seeds = []
    for t in tokens:
        several = sorted(per_name[t], key=lambda n: (-max(0, (n["end_line"] or 0) - (n["start_line"] or 0)), n["id"]))
        if len(several) > 3:
            told = [n for n in several if any(x in n["file_path"].lower() or x in (n["qualified_name"] or "").lower() for x in types)]
            several = told[:4] or several[:1]
        seeds += [n["id"] for n in several]
        for n in several:
            sg.nodes.setdefault(n["id"], n)
    return seeds


def walk(ids: list[str], edges: list[tuple[str, str, str]], seeds: set[str], alpha: float = 0.25, rounds: int = 25) -> dict[str, float]:
    """Random walk with restart on the undirected multigraph of one subgraph (E6); ``graph.random_walk`` does it on whole tables."""
    if not ids:
        return {}
    at = {x: i for i, x in enumerate(ids)}
    ends = np.array([(at[a], at[b]) for a, b, kind in edges if kind in WALK_KINDS and a != b and a in at and b in at], dtype=np.int64).reshape(-1, 2)
    source, target = np.concatenate([ends[:, 0], ends[:, 1]]), np.concatenate([ends[:, 1], ends[:, 0]])
    degree = np.bincount(source, minlength=len(ids))
    start = np.array([float(x in seeds) for x in ids])
    start = start / start.sum() if start.any() else np.full(len(ids), 1.0 / len(ids))
    mass = start
    for _ in range(rounds):
        moved = np.bincount(target, weights=mass[source] / degree[source], minlength=len(ids)) + np.where(degree == 0, mass, 0.0)
        mass = (1 - alpha) * moved + alpha * start
    return dict(zip(ids, mass.tolist()))


def ranked_files(sg: Subgraph, question: str, named: list[str]) -> list[dict]:
    """The files of a subgraph that are worth showing, best first, with what they are ranked by.

    Masses that differ by less than a hundredth of the greatest count as equal, in steps of that width.
    """
    hits = set(sg.roots) | set(named)
    linked = {b for a, b, _ in sg.edges if a in hits} | {a for a, b, _ in sg.edges if b in hits}
    mass = walk(list(sg.nodes), list(sg.edges), hits)
    files: dict[str, dict] = {}
    terms = {t for t in question.lower().split() if len(t) >= 3}
    for i, n in sg.nodes.items():
        f = files.setdefault(n["file_path"], {"file_path": n["file_path"], "score": 0.0, "mass": 0.0, "nodes": [], "named": False, "hit": False, "low": n["is_test"] or n["is_generated"], "generated": n["is_generated"]})
        f["mass"] += mass[i]
        f["named"] |= i in named
        f["hit"] |= i in hits
        if n["kind"] not in ("import", "export"):
            f["nodes"].append(n)
            f["score"] += WEIGHTS["named" if i in named else "hit" if i in hits else "linked" if i in linked else "met"]
    for f in files.values():
        text = " ".join([f["file_path"].lower(), *(n["name"].lower() for n in f["nodes"])])
        f["terms"] = sum(t in text for t in terms) if f["score"] >= 3.0 else 0
    worth = [f for f in files.values() if f["score"] >= 3.0 and f["nodes"]]
    if not any(w in question.lower() for w in ("test", "spec", "verify", "verifies")):
        plain = [f for f in worth if not f["low"]]
        worth = plain if len(plain) >= 2 else worth
    counted = {f["file_path"] for f in worth}
    for f in files.values():
        f["terms"] = f["terms"] if f["file_path"] in counted else 0
    most = max((f["mass"] for f in files.values()), default=0.0)
    central = {f["file_path"] for f in sorted((f for f in files.values() if f["mass"] > 0 and f["terms"]), key=lambda f: (-f["mass"], f["file_path"]))[:2]}
    if most > 0:
        gated = [f for f in worth if f["mass"] >= 0.06 * most or f["file_path"] in central or f["hit"] or f["terms"] >= 2]
        worth = gated if len(gated) >= 2 else worth
    step = 0.01 * most or 1.0
    return sorted(worth, key=lambda f: (not f["named"], -int(f["mass"] / step), -f["terms"], f["low"], f["generated"], -f["score"], f["file_path"]))


def windows(spans: list[tuple[int, int]], gap: int) -> list[tuple[int, int]]:
    """Spans of lines joined where the next begins within ``gap`` of the end so far."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + gap:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def _section(file: dict, text: str, b: Budget, room: int) -> str | None:
    lines = text.split("\n")
    if len(lines) <= WHOLE_LINES and len(text.encode()) <= b.per_file:
        return Q.numbered(text.rstrip("\n"), 1)
    spans = [(n["start_line"], max(n["start_line"], n["end_line"] or 0)) for n in file["nodes"] if n["start_line"]]
    shown, used = [], 0
    for first, last in windows(spans, b.gap):
        if used < min(b.per_file, room) and first <= len(lines):
            shown.append(Q.numbered("\n".join(lines[first - 1 : last]), first))
            used += len(shown[-1].encode())
    return "\n\n…\n\n".join(shown) or None


def explore(store: Store, question: str, max_files: int | None = None, n_files: int | None = None) -> tuple[str, list[dict]]:
    """The answer as Markdown, and the files it was made from."""
    sg = relevant(store, question, EXPLORE)
    if not sg.nodes:
        return f'No relevant code found for "{question}"', []
    add_glue(store, sg)
    named = add_named(store, sg, question)
    files = ranked_files(sg, question, named)
    b = budget(n_files if n_files is not None else store.files.select("path").distinct().count())
    out = [f"## Exploration: {question}", "", f"Found {len(sg.nodes)} symbols across {len(files)} files.", ""]
    if ways := call_paths(sg).rstrip():
        out += [ways, ""]
    if b.told:
        per_kind = defaultdict(list)
        for s, t, kind in sg.edges:
            if kind != "contains" and s in sg.nodes and t in sg.nodes:
                per_kind[kind].append(f"- {sg.nodes[s]['name']} → {sg.nodes[t]['name']}")
        out += ["### Relationships", ""] if per_kind else []
        for kind, pairs in per_kind.items():
            out += [f"**{kind}:**", *pairs[: b.edges], *([f"- ... and {len(pairs) - b.edges} more"] if len(pairs) > b.edges else []), ""]
    out += ["### Source Code", "", "> Source as it stands in the index, with line numbers.", ""]
    used, shown = sum(len(x.encode()) + 1 for x in out), 0
    texts = store.file_texts([f["file_path"] for f in files[: 4 * (max_files or b.files)]])
    for f in files:
        text = texts.get(f["file_path"])
        if shown >= (max_files or b.files) or used >= b.output:
            break
        if text is None or not (f["hit"] or used <= 0.9 * b.output):
            continue
        section = _section(f, text, b, b.output - used)
        if section is None or used + len(section.encode()) + 200 > b.output and (shown or len(text.split("\n")) <= WHOLE_LINES):
            continue
        heads = list(dict.fromkeys(f"{n['name']}({n['kind']})" for n in f["nodes"]))[: b.symbols]
        out += [f"#### {f['file_path']} — {', '.join(heads)}", "", f"```{f['nodes'][0]['language'] or ''}", section, "```", ""]
        used, shown = used + len(section.encode()) + 200, shown + 1
    if b.told:
        out.append("_The source of the relevant symbols is above; ask for any symbol to see all of it with its callers and callees._")
    return "\n".join(out), files
