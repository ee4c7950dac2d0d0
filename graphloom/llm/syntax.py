"""Problem 2: source files that do not parse.

Each file is lexed for its own language, delimiters go through a pushdown stack,
and what stands outside brackets must be able to begin a declaration of that
language.  Python's layout has a stack of its own: of indentations, with what
each line may open, and operands must have operators between them.
"""

from __future__ import annotations

import keyword
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.lexing import family, line_of, line_starts, mask, pairs
from graphloom.session import in_batches

VERDICT = "path string, language string, repo string, error string, error_line int"

_CONFLICT = re.compile(r"^(?:<{7}(?: |$)|={7}\r?$|>{7}(?: |$)|\|{7}(?: |$))", re.M)
_DIFF = re.compile(r"^(?:@@ -\d|diff --git |--- a/|\+\+\+ b/)", re.M)
_STRAY = {  # Fixed values: characters that no program of the family has outside comments and literals.
    "go": re.compile(r"[#$@?\\`\x00-\x08\x0e-\x1f�]"),
    "java": re.compile(r"[#\\`\x00-\x08\x0e-\x1f�]"),
    "c": re.compile(r"[@`\x00-\x08\x0e-\x1f�]"),
    "rust": re.compile(r"[`\\\x00-\x08\x0e-\x1f�]"),
    "javascript": re.compile(r"[`\\\x00-\x08\x0e-\x1f�]"),
    "python": re.compile(r"[$?!`\x00-\x08\x0e-\x1f�](?!=)"),
}
# Words that begin a declaration outside brackets.
_DECLARES = {
    "go": frozenset("package import const var type func".split()),
    "rust": frozenset("use pub fn const static struct enum impl mod trait type unsafe extern async union macro_rules".split()),
    "java": frozenset("package import public private protected class interface enum abstract final static record sealed strictfp non module open".split()),
}
_FOREIGN = {
    "c": frozenset("package import def class fn func function let pub use impl export public private from var const_cast elif async await defer interface type".split()),
    "javascript": frozenset("package def fn func pub use impl elif struct mod defer chan public private protected unsigned include".split()),
}
_DIRECTIVE = re.compile(r"#[ \t]*(?:include|include_next|import|define|undef|if|ifdef|ifndef|elif|elifdef|else|endif|line|error|warning|pragma|embed)\b|#[ \t]*$", re.M)
_OBJECT_FILE = re.compile(r'\s*\{\s*"[^"]*"\s*:')
_ADJACENT = re.compile(r"^[ \t]*([A-Za-z_$][\w$-]*):?[ \t]+([A-Za-z_$][\w$-]*)(?:[ \t]+[\w$:-]+)*[ \t]*\r?$", re.M)
# Words of JavaScript and TypeScript that may stand beside another word.
_JOINS = frozenset(
    "abstract accessor as asserts async await break case catch class const continue declare default delete do else enum export extends false finally for from function get global if implements import in infer instanceof interface is keyof let module namespace new null of out override private protected public readonly return satisfies set static switch this throw true try type typeof unique using var void while with yield".split()
)
_STATEMENT = re.compile(r"[^\s;{}()\[\]]+|[;{}()\[\]]|\n")
_WORD = re.compile(r"[A-Za-z_$][\w$]*")
_TYPED = re.compile(  # type annotations, which plain JavaScript doesn't have
    r"^[ \t]*(?:export[ \t]+)?(?:private|public|protected|readonly|interface|declare|namespace|abstract|enum)[ \t]+\w+"
    r"|^[ \t]*(?:export[ \t]+)?type[ \t]+\w+(?:<[^>\n]*>)?[ \t]*="
    r"|\b(?:const|let|var)[ \t]+\w+[ \t]*:[ \t]*\w"
    r"|\bfunction\b[ \t]*\w*(?:<[^>\n]*>)?\([^()\n]*\w[ \t]*\??:[ \t]*\w"
    r"|^[ \t]*(?:(?:export|default|async|static)[ \t]+)*(?:function[ \t]+)?\w+(?:<[^>\n]*>)?\([^()\n]*\)[ \t]*:[ \t]*[\w<>\[\], |]+\{[ \t]*$"
    r"|\bimport[ \t]+type\b",
    re.M,
)
_OPEN_END = re.compile(r"(?:[=+*/%&|^<,.:?!~-]|\b(?:const|let|var|function|class|import|export|return|from|package|func|type|pub|fn|use|struct|impl|new|if|else|for|while|switch|public|static|extends|implements))$")


def first_error(text: str | None, language: str | None) -> tuple[str, int] | None:
    """The first reason why a text isn't a program of its language, with its line; None if it's valid, empty or of no known language."""
    if not text or not text.strip("﻿ \t\r\n\f") or language is None:
        return None
    kind = family(language)
    text = text.removeprefix("﻿")
    masked = mask(text, language)
    code = masked.code
    found: list[tuple[str, int]] = list(masked.errors)
    if m := _CONFLICT.search(code):
        found.append(("merge conflict marker", m.start()))
    if m := _DIFF.search(code):
        found.append(("patch text", m.start()))
    stray = code
    if kind == "javascript" and code.startswith("#!"):
        stray = code[code.find("\n") :] if "\n" in code else ""
    if m := _STRAY[kind].search(stray):
        found.append(("stray character", m.start()))
    if not found:
        _, found = pairs(code)
    if not found:
        found = _outside(code, kind, language.lower(), {e - 1 for b, e in masked.strings if "\n" in text[b:e]})
    if not found and kind == "python":
        found = _layout(code)
    if not found:
        return None
    what, at = min(found, key=lambda x: x[1])
    return what, line_of(line_starts(text), at)


def _outside(code: str, kind: str, language: str, ends: set[int]) -> list[tuple[str, int]]:
    """What stands outside brackets and begins no declaration of the language. ends: where literals of several lines end."""
    if kind == "python" or not code.strip():
        return []
    if language == "javascript" and (m := _TYPED.search(code)):
        return [("other language", m.start())]
    declares, foreign = _DECLARES.get(kind), _FOREIGN.get(kind, frozenset())
    depth, fresh, first = 0, True, True
    for m in _STATEMENT.finditer(code):
        token = m[0]
        if token in ("(", "[", "{"):
            if fresh and not depth and kind != "javascript":
                return [("misplaced token", m.start())]
            depth += 1
            fresh = False
        elif token in (")", "]", "}"):
            depth -= 1
            fresh = token == "}" or fresh
        elif depth:
            continue
        elif token == ";":
            fresh = True
        elif token == "\n":
            fresh = fresh or kind == "go"
        elif fresh:
            if m.start() in ends:
                fresh = False
                continue
            word = _WORD.match(token)
            if kind == "c" and token.startswith("#") and _DIRECTIVE.match(code, m.start()):
                fresh = False
                continue
            if token.startswith("<!") or re.fullmatch(r"\d+:", token) or kind in ("c", "javascript") and token[0] == "#" or kind == "c" and not word and token[0] != "~":
                return [("misplaced token", m.start())]
            if declares is not None:
                macro = kind == "rust" and (token.startswith("#") or "!" in token)
                if not macro and not (kind == "java" and token.startswith("@")) and (not word or word[0] not in declares):
                    return [("other language" if word else "misplaced token", m.start())]
                if kind == "go" and first and word and word[0] != "package":
                    return [("other language", m.start())]
            elif word and word[0] in foreign and not code.startswith((":", "(", "."), m.start() + len(word[0])) and not re.match(r"\s*(?:[=,.;()]|\+\+)", code[m.start() + len(word[0]) : m.start() + len(word[0]) + 20]):
                return [("other language", m.start())]
            first = fresh = False
    if kind == "javascript":
        if m := _OBJECT_FILE.match(code):
            return [("other language", m.start())]
        if m := next((m for m in _ADJACENT.finditer(code) if not (m[1] in _JOINS or m[2] in _JOINS)), None):
            return [("words without an operator", m.start())]
    last = code.rstrip()
    if kind in ("c", "java", "rust"):
        tail = last.rpartition("\n")[2].lstrip()
        if not last.endswith((";", "}")) and not (kind == "c" and (tail.startswith("#") or last.endswith((")", "\\")) or "\n#" in last[-400:])):
            return [("premature end", max(0, len(last) - 1))]
    elif (m := _OPEN_END.search(last)) and not last.endswith(("++", "--", "*/")):
        return [("premature end", m.start())]
    return []


# Words that open a block in Python, and words that stand between operands or before them.
_BLOCKS = frozenset("def class if elif else for while try except finally with async".split())
_SOFT = frozenset("match case type".split())
_BETWEEN = frozenset(keyword.kwlist) - {"True", "False", "None"}
_PY_TOKEN = re.compile(r"(?P<join>\\\r?\n)|(?P<line>\n)|(?P<text>[A-Za-z]{0,2}\"[^\"]*\")|(?P<number>\.?\d(?:[eE][+-]|[\w.])*)|(?P<word>[^\W\d]\w*)|(?P<open>[(\[{])|(?P<shut>[)\]}])|(?P<op>:=|->|\*\*=?|//=?|<<=?|>>=?|[-+*/%@&|^<>=!]=|\.\.\.|[-+*/%@&|^<>=~.,:;\\])")
_NUMBER = re.compile(r"0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.(?:\d[\d_]*)?)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[jJ]?")


def _layout(code: str) -> list[tuple[str, int]]:
    """The first breach of Python's layout in masked code: indentation, blocks that are missing or not announced, operands without an operator."""
    indents, waits = [0], 0  # waits: where the line stands that needs a block below it, plus one
    depth, start, first, before, last, colon, operand = 0, 0, "", "", "", False, ""
    fresh, kind = True, ""
    for m in _PY_TOKEN.finditer(code + "\n"):
        at, token, kind = m.start(), m[0], m.lastgroup
        if kind == "join":
            continue
        if kind == "line":
            if depth or fresh:
                start = start if depth else m.end()
                continue
            if first in _BLOCKS and not colon:
                return [("missing colon", at)]
            if last == ":" and first not in _BLOCKS and first not in _SOFT:
                return [("misplaced token", at)]
            if last in _OPERATORS and not (last == "*" and before == "import") or last in ("not", "and", "or", "in", "is", "if", "import", "from", "as", "lambda"):
                return [("premature end", at)]
            waits = at + 1 if last == ":" else 0
            start, fresh, first, last, colon, operand = m.end(), True, "", "", False, ""
            continue
        if fresh:
            line = code[start:at].rpartition("\n")[2]
            width = len(line.rpartition("\f")[2].expandtabs(8))
            if waits and width <= indents[-1]:
                return [("missing block", at)]
            if waits:
                indents.append(width)
            elif width > indents[-1]:
                return [("indentation", at)]
            while width < indents[-1]:
                indents.pop()
            if width != indents[-1]:
                return [("indentation", at)]
            fresh, first, waits = False, token, 0
            if kind == "op" and token not in ("@", "-", "+", "~", "*", "...") or kind == "shut" or token in ("in", "is", "and", "or", "as"):
                return [("misplaced token", at)]
        if kind == "number" and not _NUMBER.fullmatch(token):
            return [("malformed number", at)]
        if kind == "open":
            depth += 1
        elif kind == "shut":
            depth = max(0, depth - 1)
        value = kind in ("number", "text", "shut", "word") and token not in _BETWEEN
        if value and kind != "shut" and operand and not (kind == "text" and operand == "text") and not (operand == "word" and last == first and last in _SOFT):
            return [("words without an operator", at)]
        colon |= token == ":" and not depth
        operand, before, last = (kind if value else ""), last, token
        if token == ";" and not depth:
            operand = ""
    return [("premature end", waits - 1)] if waits else []


# Operators that need something after them.
_OPERATORS = frozenset("= + - * / % @ & | ^ < > == != <= >= += -= *= /= //= %= @= &= |= ^= <<= >>= **= ** // << >> := -> ~ .".split())


def check_files(files: DataFrame, contents: DataFrame) -> DataFrame:
    """One row per distinct (path, language) of ``files`` that has text: path, language, repo, error, error_line.

    error is null for a valid file.  A null or empty text, a null language and a file without text are no errors; a
    null path is left out.  Repeated rows of either table count once (of unequal texts of one path, each is checked and
    an error of any counts).  Further columns are ignored.
    """
    named = files.where(F.col("path").isNotNull()).select("path", "language").distinct()
    text = contents.where(F.col("path").isNotNull()).select(F.col("path"), F.col("content"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [first_error(t, x) for t, x in zip(b["content"], b["language"])]
            yield pd.DataFrame(
                {
                    "path": b["path"],
                    "language": b["language"],
                    "repo": [p.partition("/")[0] for p in b["path"]],
                    "error": [g[0] if g else None for g in got],
                    "error_line": pd.array([g[1] if g else None for g in got], dtype="Int32"),
                }
            )

    return in_batches(named.join(text, "path"), run, VERDICT)


def broken_files(checked: DataFrame) -> DataFrame:
    """Distinct paths with an error."""
    return checked.where(F.col("error").isNotNull()).select("path").distinct()


def error_rates(checked: DataFrame) -> DataFrame:
    """Per repo and language: files checked, files broken, and their share."""
    one = checked.groupBy("path", "language", "repo").agg(F.max(F.col("error").isNotNull().cast("int")).alias("bad"))
    return one.groupBy("repo", "language").agg(
        F.count("*").alias("files"),
        F.sum("bad").cast("bigint").alias("broken"),
        F.round(F.sum("bad") / F.count("*"), 6).alias("rate"),
    )
