"""String- and comment-aware lexing of source text, one state machine for seven languages.

``mask`` walks a file once.  It keeps every character position: the inside of
comments and literals is blanked out (line breaks stay), so the remaining code
can be searched with plain patterns and positions still map to lines.  The walk
jumps from one literal or comment opener to the next, which keeps it close to
the speed of a regular-expression scan.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

# The languages that have a lexer, and how each one writes comments and literals.
C_LIKE = ("c", "cpp", "go", "java", "javascript", "typescript", "rust", "jsx", "tsx", "csharp", "kotlin", "swift", "scala", "php", "dart")
LANGUAGES = (*C_LIKE, "python")

_OPENERS = {
    "python": re.compile(r"""[#"']"""),
    "go": re.compile(r"""//|/\*|["'`]"""),
    "java": re.compile(r"""//|/\*|["']"""),
    "c": re.compile(r"""//|/\*|["']|^[ \t]*#[ \t]*(?:error|warning|pragma)\b""", re.M),
    "rust": re.compile(r"""//|/\*|\bb?r#*"|["']"""),
    "javascript": re.compile(r"""//|/\*|["'`/{}]"""),
}
_DQ = re.compile(r'"(?:[^"\\\n]|\\(?:\r\n|.|\n))*"')
_SQ = re.compile(r"'(?:[^'\\\n]|\\(?:\r\n|.|\n))*'")
_BACKTICK = re.compile(r"`[^`]*`")
_RUST_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_RUST_CHAR = re.compile(r"'(?:[^'\\\n]|\\(?:u\{[0-9a-fA-F_]+\}|x[0-9a-fA-F]{2}|.))'")
_RUST_LIFETIME = re.compile(r"'[A-Za-z_]\w*")
_RUNE = re.compile(r"'(?:[^'\\\n]|\\(?:[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|.))'")
_C_CHAR = re.compile(r"'(?:[^'\\\n]|\\.[0-9a-fA-F]*){1,4}'")
_TEXT_BLOCK = re.compile(r'"""(?:[^"\\]|\\.|"(?!""))*"""', re.S)
_PY_TRIPLE = {q: re.compile(q + r"(?:[^\\" + q[0] + r"]|\\.|" + q[0] + r"(?!" + q[0] * 2 + r"))*" + q, re.S) for q in ('"""', "'''")}
_LINE_END = re.compile(r"[^\n]*")
_C_LINE = re.compile(r"(?:[^\n\\]|\\\r?\n|\\.)*\\?")
_JS_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
_TEMPLATE_STEP = re.compile(r"`|\$\{|\\.", re.S)
_NEST = re.compile(r"/\*|\*/")
_NOT_BREAK = re.compile(r"[^\n]")
_VALUE_END = re.compile(r"[\w$)\]\"'`}]$")
_REGEX_WORD = re.compile(r"\b(?:return|typeof|case|in|of|delete|void|throw|new|else|do|await|yield|instanceof)$")


@dataclass
class Masked:
    """code: the text with comments and literals blanked; comments, strings: their (start, end); errors: what is unterminated."""

    code: str
    comments: list[tuple[int, int]] = field(default_factory=list)
    strings: list[tuple[int, int]] = field(default_factory=list)
    errors: list[tuple[str, int]] = field(default_factory=list)


def family(language: str | None) -> str:
    """The lexer that a language uses; an unknown language uses the C family's."""
    language = (language or "").lower()
    if language in ("python", "go", "java", "rust"):
        return language
    if language in ("javascript", "typescript", "jsx", "tsx"):
        return "javascript"
    return "c"


def _blank(text: str, start: int, end: int, quote: str = "") -> str:
    part = text[start:end]
    if "\n" not in part:
        return quote + " " * (end - start - 2 * len(quote)) + quote if len(part) >= 2 * len(quote) else " " * len(part)
    inner = _NOT_BREAK.sub(" ", part)
    return quote + inner[len(quote) : len(inner) - len(quote)] + quote if quote else inner


def mask(text: str, language: str | None) -> Masked:
    """Blank comments and literals. At an unterminated literal the rest of the line (or file) is blanked and an error noted."""
    kind = family(language)
    opener = _OPENERS[kind]
    out: list[str] = []
    found = Masked("")
    pos, size = 0, len(text)
    braces: list[int] = []  # of template literals: open braces inside each ${ }
    depth = 0

    def put(start: int, end: int, quote: str = "") -> None:
        nonlocal pos
        out.append(text[pos:start])
        out.append(_blank(text, start, end, quote))
        pos = end

    def template(start: int) -> None:
        """From a back-tick, or from the brace that closes a ${ }, to the next ${ or the end."""
        nonlocal depth
        at = start + 1
        while step := _TEMPLATE_STEP.search(text, at):
            at = step.end()
            if step[0] == "`":
                found.strings.append((start, at))
                put(start, at, '"')
                return
            if step[0] == "${":
                put(start, at)
                braces.append(depth)
                depth = 0
                return
        found.errors.append(("unterminated template literal", start))
        put(start, size)

    while pos < size and (m := opener.search(text, pos if pos == 0 or kind != "c" else pos)):
        start, what = m.start(), m[0]
        if what == "{":
            depth += 1
            out.append(text[pos : start + 1])
            pos = start + 1
        elif what == "}":
            if braces and depth == 0:
                depth = braces.pop()
                template(start)
                continue
            depth -= 1
            out.append(text[pos : start + 1])
            pos = start + 1
        elif what == "//" or what == "#" or what.lstrip().startswith("#"):
            end = (_C_LINE if kind == "c" else _LINE_END).match(text, start).end()
            found.comments.append((start, end))
            put(start, end)
        elif what == "/*":
            end = text.find("*/", start + 2) + 2
            if kind == "rust":
                level, end = 0, 1
                for step in _NEST.finditer(text, start):
                    level += 1 if step[0] == "/*" else -1
                    if not level:
                        end = step.end()
                        break
            if end <= 1:
                found.errors.append(("unterminated comment", start))
                end = size
            found.comments.append((start, end))
            put(start, end)
        elif what == "/":
            before = text[max(0, start - 200) : start].rstrip()
            line = "".join(out)[-200:].rstrip() if before.endswith("/") else before
            regex = None
            if not before or not _VALUE_END.search(line) or _REGEX_WORD.search(line):
                regex = _JS_REGEX.match(text, start)
            if regex:
                found.strings.append(regex.span())
                put(start, regex.end(), '"')
            else:
                out.append(text[pos : start + 1])
                pos = start + 1
        elif what == "`" and kind == "javascript":
            template(start)
        elif kind == "rust" and what.endswith('"') and len(what) > 1:
            close = '"' + "#" * what.count("#")
            end = text.find(close, m.end())
            if end < 0:
                found.errors.append(("unterminated string", start))
                put(start, size)
            else:
                found.strings.append((start, end + len(close)))
                put(start, end + len(close), '"')
        else:
            triple = text[start : start + 3]
            if kind == "python" and triple in _PY_TRIPLE:
                literal = _PY_TRIPLE[triple].match(text, start)
            elif kind == "java" and triple == '"""':
                literal = _TEXT_BLOCK.match(text, start)
            elif what == "`":
                literal = _BACKTICK.match(text, start)
            elif what == '"':
                literal = (_RUST_STRING if kind == "rust" else _DQ).match(text, start)
            elif kind == "rust":
                literal = _RUST_CHAR.match(text, start)
                if not literal and (life := _RUST_LIFETIME.match(text, start)):
                    out.append(text[pos : life.end()].replace("'", " "))
                    pos = life.end()
                    continue
            elif kind == "go":
                literal = _RUNE.match(text, start)
            elif kind in ("c", "java"):
                literal = _C_CHAR.match(text, start)
                digit = start > 0 and text[start - 1].isalnum() and text[start + 1 : start + 2].isalnum()
                if not literal and kind == "c" and digit:  # a digit separator
                    out.append(text[pos : start + 1].replace("'", " "))
                    pos = start + 1
                    continue
            else:
                literal = _SQ.match(text, start)
            if literal:
                found.strings.append(literal.span())
                put(start, literal.end(), '"')
            else:
                whole = triple in ('"""', "'''") and kind in ("python", "java") or what == "`" or kind == "rust"
                found.errors.append(("unterminated string", start))
                put(start, size if whole else _LINE_END.match(text, start).end())
    if braces:
        found.errors.append(("unterminated template literal", size))
    out.append(text[pos:])
    found.code = "".join(out)
    return found


def line_starts(text: str) -> list[int]:
    """Positions at which lines begin."""
    return [0, *(m.end() for m in re.finditer("\n", text))]


def line_of(starts: list[int], at: int) -> int:
    """The 1-based line of a position."""
    return bisect_right(starts, at)


_DELIMITER = re.compile(r"[()\[\]{}]")
_PAIR = {")": "(", "]": "[", "}": "{"}


def pairs(code: str) -> tuple[dict[int, int], list[tuple[str, int]]]:
    """Match delimiters of masked code with a stack: opener position -> closer position, and what doesn't match."""
    stack: list[tuple[str, int]] = []
    match: dict[int, int] = {}
    errors: list[tuple[str, int]] = []
    for m in _DELIMITER.finditer(code):
        c = m[0]
        if c in "([{":
            stack.append((c, m.start()))
        elif stack and stack[-1][0] == _PAIR[c]:
            match[stack.pop()[1]] = m.start()
        else:
            errors.append(("unbalanced delimiter", m.start()))
            if any(c0 == _PAIR[c] for c0, _ in stack):
                while stack[-1][0] != _PAIR[c]:
                    stack.pop()
                match[stack.pop()[1]] = m.start()
    if stack:
        errors.append(("premature end", stack[-1][1]))
    return match, errors
