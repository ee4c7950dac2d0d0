"""Source files to nodes, edges and unresolved references.

One pass in Arrow batches: each file is lexed (or, for Python, parsed), declarations become nodes, nesting becomes
contains edges, and calls, imports, bases and new objects become references for the resolver.
"""

from __future__ import annotations

import ast
import hashlib
import re
import warnings
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import names
from graphloom.functions.lexing import line_of, line_starts, mask, pairs
from graphloom.session import in_batches, spread

ROW = (
    "tag string, id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, "
    "docstring string, signature string, is_exported boolean, is_async boolean, return_type string, source string, target string, line int, col int, module string"
)
MAX_BYTES = 1 << 20  # larger files are recorded and not parsed

# Words that look like calls or types and are none.
CONTROL = frozenset("if for while switch catch return with else do match loop".split())
NOT_CALLS = frozenset("if for while switch catch return with func function fn def class struct match loop new await typeof sizeof elif else defer go select print super self this const var type import".split())
_CALL = re.compile(r"(?<![\w.])((?:[A-Za-z_$][\w$]*(?:\.|::))*[A-Za-z_$][\w$]*)\s*\(")
_NEW = re.compile(r"\bnew\s+([A-Za-z_$][\w$.]*)")


@dataclass
class Found:
    path: str
    language: str
    rows: list[dict] = field(default_factory=list)

    def node(self, kind: str, name: str, scope: list[str], first: int, last: int, **more: object) -> str:
        key = hashlib.sha256(f"{self.path}:{kind}:{name}:{first}".encode()).hexdigest()[:32]
        self.rows.append(
            {"tag": "node", "id": f"{kind}:{key}", "kind": kind, "name": name, "qualified_name": "::".join([*scope, name]), "file_path": self.path, "language": self.language, "start_line": first, "end_line": last} | more
        )
        return f"{kind}:{key}"

    def edge(self, source: str, target: str, line: int) -> None:
        self.rows.append({"tag": "edge", "kind": "contains", "source": source, "target": target, "line": line})

    def ref(self, source: str, name: str, kind: str, line: int, col: int = 0, module: str | None = None) -> None:
        self.rows.append({"tag": "ref", "source": source, "name": name, "kind": kind, "line": line, "col": col, "file_path": self.path, "language": self.language, "module": module})


def _python(found: Found, text: str, root: str) -> None:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(text)

    def dotted(node: ast.AST) -> str | None:
        if isinstance(node, ast.Name):
            return node.id
        if isinstance(node, ast.Attribute) and (head := dotted(node.value)):
            return node.attr if head in ("self", "cls") else f"{head}.{node.attr}"
        return None

    def values(node: ast.AST) -> list[ast.expr]:
        """What stands where a function may be handed on: arguments, the right of an assignment, entries of lists and dictionaries."""
        if isinstance(node, ast.Call):
            return [*node.args, *(k.value for k in node.keywords)]
        if isinstance(node, ast.Assign):
            stored = [t.attr if isinstance(t, ast.Attribute) else getattr(t, "id", None) for t in node.targets]
            return [] if isinstance(node.value, ast.Name) and node.value.id in stored else [node.value]
        return node.elts if isinstance(node, ast.List) else node.values if isinstance(node, ast.Dict) else []

    def walk(body: list[ast.stmt] | ast.AST, owner: str, scope: list[str], inside: str) -> None:
        for node in body if isinstance(body, list) else ast.iter_child_nodes(body):
            if isinstance(node, ast.ClassDef):
                own = found.node("class", node.name, scope, node.lineno, node.end_lineno or node.lineno, docstring=ast.get_docstring(node), is_exported=not node.name.startswith("_"))
                found.edge(owner, own, node.lineno)
                for base in node.bases:
                    if name := dotted(base):
                        found.ref(own, name, "extends", base.lineno, base.col_offset)
                walk(node.body, own, [*scope, node.name], "class")
            elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                kind = "method" if inside == "class" else "function"
                own = found.node(
                    kind, node.name, scope, node.lineno, node.end_lineno or node.lineno, docstring=ast.get_docstring(node), is_exported=not node.name.startswith("_"), is_async=isinstance(node, ast.AsyncFunctionDef),
                    signature=f"({ast.unparse(node.args)})" + (f" -> {ast.unparse(node.returns)}" if node.returns else ""), return_type=ast.unparse(node.returns) if node.returns else None,
                )
                found.edge(owner, own, node.lineno)
                walk(node.body, own, [*scope, node.name], kind)
            elif isinstance(node, ast.Import | ast.ImportFrom):
                module = "." * getattr(node, "level", 0) + (getattr(node, "module", None) or "") if isinstance(node, ast.ImportFrom) else None
                for a in node.names:
                    own = found.node("import", module or a.name, scope, node.lineno, node.lineno)
                    found.edge(owner, own, node.lineno)
                    found.ref(owner, a.name, "imports", node.lineno, node.col_offset, module)
            else:
                if inside == "module" and isinstance(node, ast.Assign | ast.AnnAssign):
                    for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
                        if isinstance(t, ast.Name):
                            found.edge(owner, found.node("variable", t.id, scope, node.lineno, node.end_lineno or node.lineno, is_exported=not t.id.startswith("_")), node.lineno)
                if isinstance(node, ast.Call) and (name := dotted(node.func)):
                    found.ref(owner, name, "calls", node.lineno, node.col_offset)
                for value in values(node):
                    if isinstance(value, ast.Name):
                        found.ref(owner, value.id, "function_ref", value.lineno, value.col_offset)
                    elif isinstance(value, ast.Attribute) and isinstance(value.value, ast.Name) and value.value.id == "self":
                        found.ref(owner, value.attr, "function_ref", value.lineno, value.col_offset)
                walk(node, owner, scope, inside)

    walk(tree.body, root, [], "module")
    _keep_values(found)


def _keep_values(found: Found) -> None:
    """Of names used as values, only functions that the file defines or imports are references, one per user and name; generated files have none."""
    known = {r["name"] for r in found.rows if r["tag"] == "node" and r["kind"] in ("function", "method") or r["tag"] == "ref" and r["kind"] == "imports"}
    seen, kept, made = set(), [], bool(re.search(names.GENERATED, found.path))
    for r in found.rows:
        if r["kind"] == "function_ref":
            if made or r["name"] not in known or (r["source"], r["name"]) in seen:
                continue
            seen.add((r["source"], r["name"]))
        kept.append(r)
    found.rows[:] = kept


# Types that are built in and no references.
BUILT_IN = frozenset(
    "string number boolean void null undefined never any object symbol bigint true false str bool i8 i16 i32 i64 i128 isize u8 u16 u32 u64 u128 usize f32 f64 char int long short byte "
    "float double int8 int16 int32 int64 uint uint8 uint16 uint32 uint64 uintptr float32 float64 complex64 complex128 rune error".split()
)
_NO_TYPES = frozenset("mut const dyn impl ref self Self map chan func interface struct readonly keyof typeof infer extends in out is where for final unsafe async this unique asserts new".split())
_TYPE_NAME = re.compile(r"(?<![\w$.'])(?:[a-zA-Z_]\w*(?:\.|::))*([A-Za-z_$][\w$]*)")


def _types_in(text: str) -> list[str]:
    """Names of types in a piece of a signature, without qualifiers and built-in ones."""
    return [m[1] for m in _TYPE_NAME.finditer(re.sub(r"[\w$]+\s*\??:(?!:)", " ", text)) if m[1] not in BUILT_IN and m[1] not in _NO_TYPES]


def _pieces(text: str) -> list[str]:
    """A list cut at its outer commas."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([{<") - (c in ")]}") - (c == ">" and text[i - 1 : i] not in ("-", "="))
        if c == "," and depth <= 0:
            out.append(text[at:i])
            at = i + 1
    return [x for x in (*out, text[at:]) if x.strip()]


def _parameters(inside: str, kind: str) -> list[tuple[str | None, str]]:
    """(name, type) of each parameter of a signature."""
    pieces = [p.strip() for p in _pieces(inside)]
    if kind in ("script", "rust"):
        return [(re.sub(r"\W", "", a.split()[-1]) if a.split() else None, b.partition("=")[0]) for a, colon, b in (re.split(r"(:(?!:))", p, maxsplit=1) if re.search(r":(?!:)", p) else (p, "", "") for p in pieces) if colon]
    if kind == "go":
        if not any(re.match(r"\w+\s+\S", p) for p in pieces):
            return [(None, p) for p in pieces]
        out, last = [], ""
        for p in reversed(pieces):
            name, _, what = p.partition(" ")
            last = what.strip() or last
            out.append((name, last if what.strip() else ""))
        return out[::-1]
    return [(p.split()[-1].strip("*[]"), " ".join(p.split()[:-1])) for p in pieces if len(p.split()) > 1]


def _bare(kind: str) -> str | None:
    """The one named type of a Go type: pointers and packages are left off; slices, maps, functions and channels have none."""
    m = re.fullmatch(r"\s*\**\s*(?:\w+\.)?([A-Za-z_]\w*)(?:\[[^\]]*\])?\s*", kind)
    return m[1] if m and m[1] not in ("func", "map", "chan", "interface", "struct") else None


# What declares a type, and how functions and imports begin.
_TYPES = {
    "go": re.compile(r"^[ \t]*type[ \t]+(?P<name>\w+)[ \t]+(?P<kind>struct|interface)\b|^[ \t]*type[ \t]+(?P<alias>\w+)[ \t]+=?[ \t]*\w", re.M),
    "rust": re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?P<kind>struct|enum|trait|impl)\b[ \t]*(?:<[^>{]*>[ \t]*)?(?:\w+(?:<[^>{]*>)?[ \t]+for[ \t]+)?(?P<name>\w+)", re.M),
    "java": re.compile(r"\b(?P<kind>class|interface|enum)[ \t]+(?P<name>\w+)", re.M),
    "script": re.compile(r"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:abstract[ \t]+)?(?P<kind>class|interface|enum)[ \t]+(?P<name>[\w$]+)|^[ \t]*(?:export[ \t]+)?type[ \t]+(?P<alias>[\w$]+)[^=\n]*=", re.M),
    "c": re.compile(r"^[ \t]*(?:typedef[ \t]+)?(?P<kind>struct|enum)[ \t]+(?P<name>\w+)", re.M),
}
_FUNCTIONS = {
    "go": re.compile(r"^func[ \t]*(?:\([ \t]*\w*[ \t]*\*?(?P<owner>\w+)[^)]*\)[ \t]*)?(?P<name>\w+)[ \t]*(?:\[[^\]]*\])?(?=\()", re.M),
    "rust": re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?:(?P<async>async)[ \t]+|const[ \t]+|unsafe[ \t]+)*fn[ \t]+(?P<name>\w+)[ \t]*(?:<[^>]*>)?(?=\()", re.M),
    "java": re.compile(r"^[ \t]*(?:(?:public|private|protected|static|final|abstract|synchronized)[ \t]+)+(?:<[^>]*>[ \t]*)?[\w<>\[\], ?.]+?[ \t]+(?P<name>\w+)[ \t]*(?=\()", re.M),
    "script": re.compile(
        r"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?P<async>async[ \t]+)?function[ \t]*\*?[ \t]*(?P<name>[\w$]+)[ \t]*(?:<[^>]*>)?(?=\()"
        r"|^[ \t]*(?:export[ \t]+)?(?:const|let|var)[ \t]+(?P<arrow>[\w$]+)[^=\n]*=[ \t]*(?:async[ \t]*)?(?=\([^()]*\)[^=\n{;]*=>|[\w$]+[ \t]*=>|function\b)"
        r"|^[ \t]+(?:(?:public|private|protected|static|readonly|async|override|get|set)[ \t]+)*(?P<method>[\w$]+)[ \t]*(?:<[^>]*>)?(?=\([^()]*\)[^;{}=]*\{)"
        r"|^[ \t]+(?P<pair>[\w$]+)[ \t]*:[ \t]*(?:async[ \t]*)?(?=function\b|\([^()]*\)[ \t]*(?::[^=\n]+)?=>|[\w$]+[ \t]*=>)"
        r"|^[ \t]+(?P<property>[\w$]+)[ \t]*(?::[^=;\n]+)?=[ \t]*(?:async[ \t]*)?(?=\([^()]*\)[^=\n{;]*=>)",
        re.M,
    ),
    "c": re.compile(r"^(?:[A-Za-z_]\w*[ \t*]+)+(?P<name>[A-Za-z_]\w*)[ \t]*(?=\([^;{}]*\)[^;{}=()]*\{)", re.M),
}
_VARIABLES = {
    "go": re.compile(r"^(?P<kind>const|var)[ \t]+(?P<name>\w+)", re.M),
    "rust": re.compile(r"^(?:pub(?:\([^)]*\))?[ \t]+)?(?P<kind>const|static)[ \t]+(?:mut[ \t]+)?(?P<name>\w+)[ \t]*:", re.M),
    "script": re.compile(r"^(?:export[ \t]+)?(?P<kind>const|let|var)[ \t]+(?P<name>[\w$]+)[^=\n]*=(?![ \t]*(?:async[ \t]*)?(?:\([^()]*\)[^=\n{;]*=>|[\w$]+[ \t]*=>|function\b))", re.M),
}
_MEMBERS = re.compile(r"(?:^|[,{])\s*([A-Za-z_]\w*)(?=\s*(?:[,}(={]|$))")


def _braced(found: Found, text: str, root: str, kind: str) -> None:
    masked = mask(text, found.language)
    code, (match, _) = masked.code, pairs(masked.code)
    starts = line_starts(text)
    line = lambda at: line_of(starts, at)
    comment_end = {e: b for b, e in masked.comments}
    spans: list[tuple[int, int, str, str, str]] = []  # begin, end, id, name, kind

    def doc(at: int) -> str | None:
        out, n = [], line(at) - 1
        while n > 0:
            b, e = starts[n - 1], starts[n] - 1
            stop = b + len(text[b:e].rstrip())
            if stop not in comment_end or text[b : max(b, comment_end[stop])].strip():
                break
            out.append(re.sub(r"^(?:///?!?|/\*+|\*+/?)[ \t]?|[ \t]*\*+/$", "", text[comment_end[stop] : stop]))
            n = line(comment_end[stop]) - 1
        return "\n".join(re.sub(r"(?m)^[ \t]*\*[ \t]?", "", x).strip() for x in out[::-1]) or None

    def block(at: int) -> int:
        brace = code.find("{", at)
        stop = code.find(";", at)
        if brace < 0 or (0 <= stop < brace and kind != "go") or "\n\n" in code[at:brace]:
            return code.find("\n", at) if code.find("\n", at) >= 0 else len(code)
        return match.get(brace, len(code) - 1) + 1

    for m in _TYPES[kind].finditer(code):
        groups = m.groupdict()
        name, what = (groups.get("alias"), "type_alias") if groups.get("alias") else (m["name"], m["kind"])
        begin, end = m.start() + len(m[0]) - len(m[0].lstrip()), block(m.end())
        if what == "impl":
            spans.append((begin, end, "", name, "impl"))
            continue
        exported = name[:1].isupper() if kind == "go" else bool(re.match(r"(?:export|pub|public)\b", m[0].strip())) or kind in ("java", "c")
        own = found.node(what, name, [], line(begin), line(max(begin, end - 1)), docstring=doc(begin), is_exported=exported)
        spans.append((begin, end, own, name, what))
        head = code[m.end() : code.find("{", m.end())] if "{" in code[m.end() :] else ""
        if kind in ("script", "java"):
            for word, bases in re.findall(r"\b(extends|implements)\s+([\w$.,\s<>]+?)(?=\bextends\b|\bimplements\b|$)", head):
                for base in re.findall(r"[A-Za-z_$][\w$.]*(?=\s*(?:<|,|$))", bases.strip()):
                    found.ref(own, base, word, line(begin))
        body = code[code.find("{", m.end()) + 1 : end - 1] if what == "enum" else ""
        for x in _MEMBERS.finditer("{" + re.sub(r"\([^()]*\)|\{[^{}]*\}", "", body)):
            found.edge(own, found.node("enum_member", x[1], [name], line(begin), line(begin)), line(begin))
    functions: list[tuple[int, int, str, str, str]] = []
    heads: set[int] = set()
    typed: dict[str, dict[str, str]] = {}  # of Go's functions: variables and their types
    for begin, end, own, name, what in spans:
        if own:
            _members(found, code, match, own, name, what, begin, end, kind, line)
    for m in _FUNCTIONS[kind].finditer(code):
        groups = m.groupdict()
        name = next(groups[g] for g in ("name", "arrow", "method", "pair", "property") if groups.get(g))
        if name in CONTROL:
            continue
        begin = m.start() + len(m[0]) - len(m[0].lstrip())
        opener = code.find("(", m.end() - 1)
        shut = match.get(opener, opener)
        heads.add(opener)
        end = block(shut if kind != "script" or groups.get("name") or groups.get("method") else m.end())
        owner = next((s for s in reversed(spans) if s[0] < begin < s[1]), None)
        if groups.get("owner"):
            owner = next((s for s in spans if s[3] == groups["owner"]), (0, 0, "", groups["owner"], "struct"))
        what = "method" if owner else "function"
        rest = code[shut + 1 : code.find("{", shut) if code.find("{", shut) >= 0 else shut + 1]
        returned = re.search(r"(?:->|:)?\s*[*&]*([A-Za-z_][\w.]*)", rest)
        exported = name[:1].isupper() if kind == "go" else bool(re.match(r"(?:export|pub|public)\b", m[0].strip()))
        own = found.node(
            what, name, [owner[3]] if owner else [], line(begin), line(max(begin, end - 1)), docstring=doc(begin), is_exported=exported, is_async=bool(groups.get("async")),
            signature=re.sub(r"\s+", " ", text[opener : shut + 1] + rest.rstrip()).strip() or None, return_type=returned[1].split(".")[-1] if returned and kind != "c" else None,
        )
        given = _parameters(code[opener + 1 : shut], kind) if kind != "c" else []
        for x in [t for _, types in given for t in _types_in(types)] + (_types_in(rest) if kind != "java" else []):
            found.ref(own, x, "references", line(begin))
        if kind == "go":
            receiver = re.match(r"func\s*\(\s*(\w+)\s+", code[begin:opener])
            body = code[shut:end]
            typed[own] = {n: t for n, k in given if n and (t := _bare(k))} | {a: b for a, b in re.findall(r"\b(\w+)\s*:=\s*&?(?:\w+\.)?([A-Z]\w*)\{", body)} | {a: b for a, k in re.findall(r"\bvar\s+(\w+)\s+([*\w.]+)", body) if (b := _bare(k))}
            if receiver and groups.get("owner"):
                typed[own][receiver[1]] = groups["owner"]
        found.edge(root, own, line(begin))
        if owner:
            same = owner[2] or next((s[2] for s in spans if s[3] == owner[3] and s[2]), "")
            if same:
                found.edge(same, own, line(begin))
        functions.append((begin, end, own, name, owner[3] if owner else ""))
    for begin, _, own, _, _ in spans:
        if own:
            found.edge(root, own, line(begin))
    for m in _VARIABLES[kind].finditer(code) if kind in _VARIABLES else ():
        exported = m["name"][:1].isupper() if kind == "go" else bool(re.match(r"(?:export|pub)\b", m[0].strip()))
        found.edge(root, found.node("constant" if m["kind"] == "const" and kind != "rust" else "variable", m["name"], [], line(m.start()), line(m.start()), is_exported=exported), line(m.start()))
    for m in re.finditer(r"^(const|var)[ \t]*\(", code, re.M) if kind == "go" else ():
        at, last = m.end(), match.get(m.end() - 1, len(code))
        while at < last:  # one specification a line; what stands in brackets is passed over
            if x := _SPEC.match(code, at, last):
                for name in re.split(r"[ \t]*,[ \t]*", x[1]):
                    found.edge(root, found.node("constant" if m[1] == "const" else "variable", name, [], line(x.start(1)), line(x.start(1)), is_exported=name[:1].isupper()), line(x.start(1)))
            while (step := _SPEC_STEP.search(code, at, last)) and step[0] != "\n":
                at = match.get(step.start(), last) + 1
            at = step.end() if step else last
    _imports(found, text, code, root, kind, line)

    functions.sort()
    begins, parents, open_now = [f[0] for f in functions], [], []
    for k, f in enumerate(functions):
        while open_now and functions[open_now[-1]][1] <= f[0]:
            open_now.pop()
        parents.append(open_now[-1] if open_now else -1)
        open_now.append(k)

    def within(at: int) -> str:
        k = bisect_right(begins, at) - 1
        while k >= 0 and functions[k][1] <= at:
            k = parents[k]
        return functions[k][2] if k >= 0 else root

    contracts = [(b, e) for b, e, _, _, what in spans if what == "interface"]
    opened = {c: o for o, c in match.items()}
    for m in _CALL.finditer(code):
        at = m.end() - 1
        name = re.sub(r"^(?:self|this|cls|super|Self)(?:\.|::)", "", m[1])
        if at in heads or any(b < at < e for b, e in contracts) or name.split(".")[-1].split("::")[-1] in NOT_CALLS or re.search(r"(?:\bfunc|\bfn|\bfunction|\bnew)\s+$", code[max(0, m.start() - 12) : m.start()]):
            continue
        begin, user = starts[line(m.start()) - 1], within(m.start())
        head, dot, method = name.partition(".")
        if dot and "." not in method and head in typed.get(user, ()):
            name = f"{typed[user][head]}::{method}"
        found.ref(user, name, "calls", line(m.start()), len(text[begin : m.start()].encode()))
    if kind == "go":
        for m in re.finditer(r"\)\.([A-Za-z_]\w*)\(", code):
            made = re.search(r"([A-Za-z_][\w.]*)$", code[max(0, opened.get(m.start(), 0) - 200) : opened.get(m.start(), 0)])
            if made and made[1] not in NOT_CALLS:
                found.ref(within(m.start()), f"{made[1]}().{m[1]}", "calls", line(m.start()))
    for m in _NEW.finditer(code):
        found.ref(within(m.start()), m[1], "instantiates", line(m.start()))
    if kind in ("go", "rust"):
        for m in re.finditer(r"(?<![\w.\]])(?:\w+(?:\.|::))?([A-Z]\w*)\s*\{", code):
            user = within(m.start())
            if user != root and m.start() not in heads and not any(b <= m.start() < b + 200 and code.find("{", b) == m.end() - 1 for b, *_ in spans) and not re.search(r"(?:->|\bfor|\bimpl|\bin|\bmatch|\bif|\))\s*[*&]?$", code[max(0, m.start() - 12) : m.start()]):
                found.ref(user, m[1], "instantiates", line(m.start()))
    bodies = sorted((b, e) for b, e, own, _, what in spans if own and what not in ("class", "enum"))
    stack: list[int] = []
    for m in _VALUE.finditer(code):
        if m["open"]:
            stack.append(m.start())
        elif m["shut"]:
            if stack:
                stack.pop()
        else:
            before = code[: m.start()].rstrip(" \t\r\n")[-1:] if m.start() < 400 else code[m.start() - 400 : m.start()].rstrip()[-1:]
            after = re.match(r"[ \t\r]*(.?)", code[m.end() : m.end() + 40], re.S)[1]
            inside = code[stack[-1]] if stack else ""
            ended = after in ("", "\n", ";")
            fits = (before in "(,[{" and before and inside in "([{" and after in ",)]}\n" and after) or (before == "=" and (ended or after == ",")) or (before == ":" and inside == "{" and after in ",}\n" and after)
            if fits and not any(b < m.start() < e for b, e in bodies[: bisect_right(bodies, (m.start(), 0))][-1:]) and not re.search(rf"(?<![\w$]){re.escape(m['name'])}\s*:?=\s*$", code[max(0, m.start() - 120) : m.start()]):
                found.ref(within(m.start()), m["name"], "function_ref", line(m.start()))
    _keep_values(found)


_SPEC = re.compile(r"[ \t]*([A-Za-z_]\w*(?:[ \t]*,[ \t]*[A-Za-z_]\w*)*)(?=[ \t\n\r]|$)")
_SPEC_STEP = re.compile(r"[(\[{\n]")
_VALUE = re.compile(r"(?P<open>[(\[{])|(?P<shut>[)\]}])|(?<![\w$.])(?P<name>[A-Za-z_$][\w$]*)(?![\w$(.])")


def _members(found: Found, code: str, match: dict[int, int], own: str, name: str, what: str, begin: int, end: int, kind: str, line: Callable[[int], int]) -> None:
    """Methods of interfaces, properties of classes, embedded types, and the types that an alias is made of."""
    brace = code.find("{", begin, end)
    if what == "type_alias":
        for x in _types_in(code[code.find("=", begin, end) + 1 or begin : end] if kind == "script" else code[code.find(name, begin) + len(name) : end]):
            found.ref(own, x, "references", line(begin))
        return
    if brace < 0 or kind in ("c", "rust") or what == "enum":
        return
    at, stop = brace + 1, match.get(brace, end - 1)
    while at < stop:
        ahead = re.compile(r"[;\n{]").search(code, at, stop)
        cut = ahead.start() if ahead else stop
        text = code[at:cut]
        while ahead and (text.count("(") > text.count(")")):
            ahead = re.compile(r"[;\n{]").search(code, cut + 1, stop)
            cut = ahead.start() if ahead else stop
            text = code[at:cut]
        first, x = at + len(text) - len(text.lstrip()), text.strip()
        if what == "interface" and kind in ("go", "script", "java") and (m := re.match(r"(?:(?:public|abstract|readonly|static|default)\s+)*(?:[\w<>\[\],.?]+\s+)?([A-Za-z_$][\w$]*)\s*\??\(", x) if kind == "java" else re.match(r"([A-Za-z_$][\w$]*)\s*\??\(", x)):
            method = found.node("method", m[1], [name], line(first), line(first), signature=re.sub(r"\s+", " ", x[m.end(1) :]).strip() or None)
            found.edge(own, method, line(first))
        elif kind == "go" and re.fullmatch(r"\*?(?:\w+\.)?[A-Za-z_]\w*(?:\s*`.*)?", x):
            found.ref(own, _bare(x.split("`")[0]) or x, "extends", line(first))
        elif kind == "script" and what in ("class", "interface") and (m := re.match(r"(?:(?:public|private|protected|static|readonly|declare|override|abstract)\s+)*([A-Za-z_$][\w$]*)\s*[?!]?\s*:\s*([^=]+)", x)) and "=>" not in x:
            prop = found.node("property", m[1], [name], line(first), line(first))
            found.edge(own, prop, line(first))
            for t in _types_in(m[2]):
                found.ref(prop, t, "references", line(first))
        at = (match.get(cut, stop) + 1) if ahead and code[cut] == "{" else cut + 1


def _imports(found: Found, text: str, code: str, root: str, kind: str, line: Callable[[int], int]) -> None:
    def add(name: str, at: int, module: str | None = None, node: str | None = None) -> None:
        found.edge(root, found.node("import", node or name, [], line(at), line(at)), line(at))
        found.ref(root, name, "imports", line(at), 0, module)

    if kind == "go":
        for m in re.finditer(r"^import[ \t]*(?:\(|[\w.]*[ \t]*\")", code, re.M):
            end = code.find(")", m.start()) if "(" in m[0] else code.find("\n", m.start())
            for s in re.finditer(r'"([^"\n]+)"', text[m.start() : end if end >= 0 else len(text)]):
                add(s[1], m.start() + s.start())
    elif kind == "script":
        for m in re.finditer(r"^[ \t]*import\b([^;'\"]*?)(?:\bfrom\b)?[ \t]*[\"']", code, re.M):
            module = re.match(r"[^\"'\n]*", text[m.end() :])[0]
            for name in re.findall(r"[A-Za-z_$][\w$]*(?!\s+as\b)", re.sub(r"\b(?:type|from)\b|[\w$]+\s+as\s+", " ", m[1])) or [module]:
                add(name, m.start(), module, module)
    elif kind == "rust":
        for m in re.finditer(r"^[ \t]*(?:pub[ \t]+)?use[ \t]+([^;]+);", code, re.M):
            for leaf in _use_tree(re.sub(r"\s+", "", re.sub(r"\s+as\s+\w+", "", m[1]))):
                add(leaf, m.start())
    elif kind == "java":
        for m in re.finditer(r"^[ \t]*import[ \t]+(?:static[ \t]+)?([\w.*]+)[ \t]*;", code, re.M):
            add(m[1], m.start())
    else:
        for m in re.finditer(r"^[ \t]*#[ \t]*include[ \t]*[<\"]([^>\"\n]+)", text, re.M):
            add(m[1], m.start())


def _use_tree(tree: str) -> list[str]:
    """The full paths of a use tree: a::{b, c::d} gives a::b and a::c::d."""
    head, brace, rest = tree.partition("{")
    if not brace:
        return [tree] if tree else []
    parts, depth, word = [], 0, ""
    for c in rest.rpartition("}")[0] + ",":
        depth += (c == "{") - (c == "}")
        if c == "," and not depth:
            parts.append(word)
            word = ""
        else:
            word += c
    return [head.removesuffix("::") if leaf == "self" else head + leaf for p in parts for leaf in _use_tree(p)]


KINDS = {"go": "go", "rust": "rust", "java": "java", "c": "c", "cpp": "c", "typescript": "script", "tsx": "script", "javascript": "script", "jsx": "script"}


def extract_file(path: str, text: str | None, language: str) -> list[dict]:
    """Rows (tag node, edge or ref) of one file. Text that doesn't parse, of an unknown language or too long gives the file node alone or nothing."""
    if text is None or language not in KINDS and language != "python":
        return []
    found = Found(path, language)
    root = f"file:{path}"
    found.rows.append({"tag": "node", "id": root, "kind": "file", "name": path.rpartition("/")[2], "qualified_name": path, "file_path": path, "language": language, "start_line": 1, "end_line": text.count("\n") + 1})
    if len(text.encode()) > MAX_BYTES:
        return found.rows
    try:
        if language == "python":
            _python(found, text, root)
        else:
            _braced(found, text, root, KINDS[language])
    except (SyntaxError, ValueError, RecursionError):
        pass
    return found.rows


def extract(contents: DataFrame) -> DataFrame:
    """Tagged rows of all files (path, content); null paths and texts are left out, and the language is that of the extension."""
    columns = [c.split()[0] for c in ROW.split(", ")]
    text = contents.where("path is not null and content is not null").select("path", "content", names.language(F.col("path")).alias("language")).where("language <> 'unknown'")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for x in zip(b["path"], b["content"], b["language"]) for r in extract_file(*x)]
            out = pd.DataFrame(rows, columns=columns).astype(object)
            for c in ("start_line", "end_line", "line", "col"):
                out[c] = out[c].astype("Int32")
            for c in ("is_exported", "is_async"):
                out[c] = out[c].map(lambda v: None if v is None or v != v else bool(v)).astype("boolean")
            yield out.where(out.notna(), None)

    return in_batches(spread(text), run, ROW)


def nodes_of(rows: DataFrame) -> DataFrame:
    """Nodes with their split names, the last one of each id."""
    n = rows.where("tag = 'node'").withColumn("name_split", F.nullif(names.camel_split(F.col("name")), F.lit("")))
    keep = ["kind", "name", "qualified_name", "file_path", "language", "start_line", "end_line", "docstring", "signature", "is_exported", "is_async", "return_type", "name_split"]
    return n.groupBy("id").agg(F.max_by(F.struct(*keep), F.struct("start_line", "end_line", "qualified_name")).alias("n")).select("id", "n.*")


def edges_of(rows: DataFrame) -> DataFrame:
    return rows.where("tag = 'edge'").select("source", "target", "kind", "line").distinct()


def references_of(rows: DataFrame) -> DataFrame:
    """unresolved references, with a module in candidates where an import names one."""
    r = rows.where("tag = 'ref'").select(F.col("source").alias("from_node_id"), F.col("name").alias("reference_name"), F.col("kind").alias("reference_kind"), "line", "col", "file_path", "language", "module")
    key = F.xxhash64("from_node_id", "reference_name", "reference_kind", "line", "col", "module")
    return r.distinct().select(key.alias("ref_id"), "*", F.when(F.col("module").isNotNull(), F.array("module")).alias("candidates")).drop("module")
