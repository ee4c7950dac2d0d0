"""Answers as text: Markdown of a subgraph, the ways calls take through it, and a word of caution."""

from __future__ import annotations

from collections import defaultdict

from graphloom.context import questions as Q
from graphloom.context.retrieve import DEFAULT, Options, Subgraph, relevant
from graphloom.context.store import Store

LONGEST, SHORTEST, VISITS, STARTS, SHOWN = 6, 3, 2000, 5, 3  # of chains of calls: nodes, visits in all, hits they start at, chains shown


def call_chains(sg: Subgraph) -> list[list[str]]:
    """Simple ways along calls from the first hits that come by two hits or more: those with most hits and then the longest, none inside another."""
    after = defaultdict(list)
    for a, b, kind in sg.edges:
        if kind == "calls" and a in sg.nodes and b in sg.nodes:
            after[a].append(b)
    starts = [i for i in (sg.roots or list(after)) if i in after][:STARTS]
    found, visits = [], VISITS
    for start in starts:
        stack = [[start]]
        while stack and visits > 0:
            way, visits = stack.pop(), visits - 1
            further = [b for b in dict.fromkeys(after[way[-1]]) if b not in way] if len(way) < LONGEST else []
            stack += [[*way, b] for b in reversed(further)]
            if not further and len(way) >= SHORTEST:
                found.append(way)
    hits = lambda way: len(set(way) & set(sg.roots))
    kept: list[list[str]] = []
    for way in sorted((w for w in found if hits(w) >= 2), key=lambda w: (-hits(w), -len(w))):
        if len(kept) < SHOWN and not any(">".join(way) in ">".join(k) for k in kept):
            kept.append(way)
    return kept


def _hop(edge: dict) -> str | None:
    """What a synthesised call stands for; nothing for a direct one."""
    told = edge.get("metadata") or {}
    by, via, event = told.get("synthesizedBy"), told.get("via"), told.get("event")
    if edge.get("provenance") != "heuristic" or not by:
        return None
    at = f" @{told['registeredAt']}" if told.get("registeredAt") else ""
    fixed = {
        "callback": f"callback via {f'`{via}`' if via else 'registrar'}{at}",
        "react-render": f"React re-render via setState{at}",
        "jsx-render": f"renders <{via or 'child'}>",
        "vue-handler": f"Vue @{event or 'event'} handler",
    }
    return fixed.get(by, f"event{f' `{event}`' if event else ''}{at}")


def call_paths(sg: Subgraph) -> str:
    """The chains as a section; empty if there are none."""
    lines, marked = [], False
    for way in call_chains(sg):
        text = sg.nodes[way[0]]["name"]
        for a, b in zip(way, way[1:]):
            hop = _hop(sg.edges[a, b, "calls"])
            marked |= hop is not None
            text += f" →{f'[{hop}]' if hop else ''} {sg.nodes[b]['name']}"
        lines.append(f"- {text}")
    if not lines:
        return ""
    note = "_Hops in brackets are dynamic dispatch, with the place of registration; the others are direct calls._" if marked else "_Ask for any symbol above to see its source, callers and callees._"
    return "\n".join(["", "## Call paths", "", "How calls run among the key symbols:", "", *lines, "", note, ""])


def caution(sg: Subgraph) -> str:
    """Said where only common words led to the hits."""
    areas = list(dict.fromkeys(Q.folder(sg.nodes[i]["file_path"]) for i in sg.roots if i in sg.nodes))[:4]
    where = f"\n- look at a likely area: {', '.join(f'`{a}`' for a in areas)}" if areas else ""
    return (
        "\n\n### Low confidence\n\nThe question matched mostly on common words, so take the entry points as a place to start and not as a full answer. Better results come from:"
        f"\n- the exact names of symbols, or\n- a search for one symbol{where}\n"
    )


def code_blocks(store: Store, sg: Subgraph, o: Options) -> list[dict]:
    """The source of hits, then of functions and methods, then of classes; each cut at a number of bytes."""
    roots = [i for i in sg.roots if i in sg.nodes]
    rest = [n for n in sg.nodes.values() if n["id"] not in sg.roots]
    order = [*(sg.nodes[i] for i in roots), *(n for n in rest if n["kind"] in ("function", "method")), *(n for n in rest if n["kind"] == "class")]
    code = store.code(order) if o.blocks else {}
    return [n | {"code": Q.shortened(code[n["id"]], o.block_size)} for n in order if n["id"] in code][: o.blocks]


def markdown(store: Store, question: str, o: Options = DEFAULT, sg: Subgraph | None = None) -> str:
    """The context of a question (C14)."""
    sg = sg or relevant(store, question, o)
    out = ["## Code Context\n", f"**Query:** {question}\n"]
    hits = sorted((sg.nodes[i] for i in sg.roots if i in sg.nodes), key=lambda n: n["is_generated"])
    if hits:
        out.append("### Entry Points\n")
        for n in hits:
            out.append(f"- **{n['name']}** ({n['kind']}) - {n['file_path']}{':%d' % n['start_line'] if n['start_line'] else ''}")
            out += [f"  `{n['signature']}`"] if n["signature"] else []
        out.append("")
    others = [n for n in sg.nodes.values() if n["id"] not in sg.roots and not n["is_generated"]][:10]
    if others:
        per_file = defaultdict(list)
        for n in others:
            per_file[n["file_path"]].append(f"{n['name']}:{n['start_line']}")
        out += ["### Related Symbols\n", *(f"- {f}: {', '.join(x)}" for f, x in per_file.items()), ""]
    if blocks := sorted(code_blocks(store, sg, o), key=lambda n: n["is_generated"]) if o.code else []:
        out.append("### Code\n")
        for n in blocks:
            out += [f"#### {n['name']} ({n['file_path']}:{n['start_line']})\n", f"```{n['language']}", n["code"], "```\n"]
    return "\n".join(out) + call_paths(sg) + ("" if sg.sure else caution(sg))
