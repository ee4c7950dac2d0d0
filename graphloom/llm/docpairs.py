"""Problem 1: functions and methods paired with their documentation.

Source files are lexed with the string- and comment-aware machine of
``lexing``; braces (or indentation) delimit the functions, and the comment that
ends right before a function, or the string inside it, is its documentation.
Only what the lexer delimits is a pair.  The row in force of ``nodes`` confirms
the comment, or, where the symbol was indexed again with other documentation
than the text at hand has, replaces it.  Comment markers, notices, tags and code
are set aside, and what is left must say something.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.lexing import family, line_of, line_starts, mask, pairs
from graphloom.session import in_batches, spread

FUNCTION = "path string, name string, start_line int, end_line int, source_doc string, code string"

# How a function begins, in code whose comments and literals are blanked.
_HEAD = {
    "go": re.compile(r"^[ \t]*func[ \t]*(?:\([^()\n]*\)[ \t]*)?(?P<name>\w+)[ \t]*(?:\[[^\]\n]*\])?\(", re.M),
    "rust": re.compile(r"^[ \t]*(?:pub(?:\([^)\n]*\))?[ \t]+)?(?:(?:const|async|unsafe|default)[ \t]+|extern[ \t]+\"[^\"]*\"[ \t]+)*fn[ \t]+(?P<name>\w+)", re.M),
    "python": re.compile(r"^(?P<in>[ \t]*)(?:async[ \t]+)?def[ \t]+(?P<name>\w+)[ \t]*(?:\[[^\]\n]*\])?\(", re.M),
    "javascript": re.compile(
        r"^[ \t]*(?:(?:export|default|async|public|private|protected|static|readonly|override|abstract|get|set|declare)[ \t]+)*"
        r"(?:function[ \t]*\*?[ \t]*)?(?P<name>[A-Za-z_$][\w$]*)[ \t]*(?:<[^>\n]*>)?\([^()]*(?:\([^()]*\)[^()]*)*\)[ \t]*(?::[^{};=\n]+)?\{"
        r"|(?<![\w$.])function[ \t]*\*?[ \t]*(?P<name3>[A-Za-z_$][\w$]*)[ \t]*\([^()]*\)[ \t]*\{"
        r"|^[ \t]*(?:export[ \t]+)?(?:const|let|var)[ \t]+(?P<name2>[A-Za-z_$][\w$]*)[^=\n]*=[ \t]*(?:async[ \t]+)?(?:function\b|\([^()]*\)[^=\n{]*=>|[\w$]+[ \t]*=>)",
        re.M,
    ),
    "java": re.compile(r"^[ \t]*(?:@\w+[ \t]+)*(?:[A-Za-z_][\w<>\[\],.?]*[ \t]+)+\**(?P<name>[A-Za-z_]\w*)[ \t]*\([^()]*\)[^;{}=]*\{", re.M),
}
_HEAD["c"] = re.compile(r"^(?:[A-Za-z_][\w]*[ \t*]+)+\**[ \t]*(?P<name>[A-Za-z_]\w*)[ \t]*\([^()]*(?:\([^()]*\)[^()]*)*\)[^;{}=()]*\{", re.M)
_NOT_NAMES = frozenset("if for while switch catch return with else do function match loop unsafe new typeof await synchronized".split())
_ABOVE = re.compile(r"[ \t]*(?:@[\w.]+(?:\([^\n]*\))?|#!?\[[^\n]*\]|template[ \t]*<[^\n]*>|)[ \t]*\r?")
_PY_DOC = re.compile(r'[ \t\r\n]*[rRuUbB]{0,2}("""|\'\'\'|"|\')')


def functions_of(text: str | None, language: str | None) -> list[tuple[str, int, int, str | None, str]]:
    """(name, first line, last line, documentation, code) of each function of a file; an empty or null text has none."""
    if not text:
        return []
    kind = family(language)
    masked = mask(text, language)
    code = masked.code
    match, _ = pairs(code)
    starts = line_starts(text)
    comment_at = {e: b for b, e in masked.comments}
    string_at = dict(masked.strings)
    out = []
    for m in _HEAD[kind].finditer(code):
        name = next(x for k, x in m.groupdict().items() if x and k.startswith("name"))
        if name in _NOT_NAMES:
            continue
        begin = m.start() + len(m[0]) - len(m[0].lstrip())
        doc: list[str] = []
        if kind == "python":
            end, body = _python_extent(code, m, match)
            if (d := _PY_DOC.match(text, body)) and (stop := string_at.get(d.start(1))):
                doc = [text[d.end(1) : stop - len(d[1])]]
        else:
            end = _extent(code, m, match, kind)
        if not doc:
            same_line = len(text[starts[line_of(starts, begin) - 1] : begin].rstrip()) + starts[line_of(starts, begin) - 1]
            if same_line in comment_at and comment_at[same_line] >= starts[line_of(starts, begin) - 1]:
                doc = [comment_text(text[comment_at[same_line] : same_line])]
            elif not code[starts[line_of(starts, begin) - 1] : begin].strip():
                doc = [comment_text(x) for x in _comment_above(text, starts, line_of(starts, begin) - 1, comment_at)]
        out.append((name, line_of(starts, begin), line_of(starts, max(begin, end - 1)), "\n".join(doc) or None, text[begin:end]))
    return out


def comment_text(comment: str) -> str:
    """The text of one comment without its markers."""
    if comment.startswith("/*"):
        inner = re.sub(r"^/\*+!?|\*+/$", "", comment)
        return re.sub(r"(?m)^[ \t]*\*(?!/)[ \t]?", "", inner.replace("\r", "")).strip()
    return re.sub(r"^(?://+!?|#+!?)[ \t]?", "", comment.rstrip("\r"))


_STOP = re.compile(r"[(\[{;]")
_STOP_LINE = re.compile(r"[(\[{;\n]")


def _extent(code: str, head: re.Match[str], match: dict[int, int], kind: str) -> int:
    """Where a function ends: after its braces, after the semicolon of a declaration, or after the expression of an arrow function."""
    at, stop = head.end() - 1, _STOP
    if kind == "javascript" and head[0].endswith("=>"):
        at = head.end()
        while at < len(code) and code[at] in " \t\r\n":
            at += 1
        stop = _STOP if code[at : at + 1] == "{" else _STOP_LINE
    while m := stop.search(code, at):
        at = m.start()
        if m[0] in ";\n":
            return at + (m[0] == ";")
        end = match.get(at, len(code) - 1) + 1
        if m[0] == "{" and not (kind == "go" and code[max(0, at - 12) : at].rstrip().endswith(("interface", "struct"))):
            return end
        at = end
    return len(code)


_COLON = re.compile(r"[(\[{:]")


def _python_extent(code: str, head: re.Match[str], match: dict[int, int]) -> tuple[int, int]:
    """Where a def ends, by indentation, and where its body begins."""
    colon = head.end() - 1
    while (m := _COLON.search(code, colon)) and m[0] != ":":
        colon = match.get(m.start(), len(code)) + 1
    if not m:
        return len(code), len(code)
    colon = m.start()
    indent = len(head["in"].expandtabs(8))
    end = at = code.find("\n", colon) + 1 or len(code)
    while at < len(code):
        stop = code.find("\n", at) + 1 or len(code)
        line = code[at:stop]
        if line.strip():
            if len(line.expandtabs(8)) - len(line.expandtabs(8).lstrip()) <= indent:
                break
            end = stop
        at = stop
    return end, colon + 1


def _comment_above(text: str, starts: list[int], line: int, comment_at: dict[int, int]) -> list[str]:
    """The block of comments, of any kind, that ends on the line before; decorators and attributes may stand between."""
    taken: list[str] = []
    while line > 0:
        begin, stop = starts[line - 1], starts[line] - 1
        at = len(text[begin:stop].rstrip()) + begin
        if at in comment_at and not text[max(begin, 0) : max(begin, comment_at[at])].strip():
            taken.append(text[comment_at[at] : at])
            line = line_of(starts, comment_at[at]) - 1
        elif text[begin:stop].strip() and _ABOVE.fullmatch(text, begin, stop) and not taken:
            line -= 1
        else:
            break
    return taken[::-1]


# Words and phrases that mark text as something other than a description.
_NOTICE = re.compile(r"copyright|\(c\)\s*\d{4}|©|spdx|licen[sc]|all rights reserved|redistribution|this file is part of|public domain", re.I)
_PLACEHOLDER = re.compile(r"^\W*(?:todo|fixme|xxx|hack|tbd|tba|wip|n/?a|ditto|none|null|undocumented|placeholder|lorem ipsum)\b", re.I)
_DIRECTIVE = re.compile(
    r"^\W*(?:nolint|nosec|noqa|pylint|flake8|mypy|isort|pyright|ruff|black|yapf|eslint|tslint|jshint|jslint|biome|prettier|istanbul|c8 ignore|v8 ignore|coverage|codecov|go:|\+build|fmt:|rustfmt|clippy|type:\s*ignore|ts-(?:ignore|expect|nocheck|check)|clang-format|noinspection|pragma|swiftlint|checkstyle|spotless|sonar|nosonar|formatter:|region\b|endregion|mark:|cspell|spell-checker|language=|vim:|-\*-|@generated)",
    re.I,
)
_BOOKKEEPING = re.compile(
    r"^\W*(?:[a-z]+(?:ed|er)?-(?:by|on|at):|cc:|owners?:|tickets?:|issue:|bug:|authors?\b[: ]|maintainers?:|created\b.*\d|modified\b.*\d|(?:last )?(?:changed|updated|modified)\b.*\d{4}|date:|status:|revision|changelog\b|history:|version:? [\d.]+$|since:? [\d.]+$|\$id)", re.I
)
_TAG = re.compile(r"^\W*(?:[@\\](?P<at>\w+)|:(?P<sphinx>\w+)\b[^:\n]*:)\s*(?P<rest>.*)$", re.S)
_FIELDS = re.compile(r"^(?:args|arguments|parameters|params|returns?|yields?|raises|throws|input|inputs|output|outputs|function|method|name|type|example|examples|notes?)\s*:\s*(?P<rest>.*)$", re.I)
_BARE_FIELD = re.compile(r"^[*-]?\s*\w+(?:\s*\([^)]*\))?\s*:\s*$")
_POINTER = re.compile(r"^\W*(?:please\s+)?(?:(?:see|refer|cf|compare|consult|check)\b(?!\s+(?:if|whether|that)\b)|same\s+(?:as|here)\b|as\s+(?:above|below|before)\b|\(?see\b|like\s+the\s+(?:base|above)|inherit|{@inherit|(?:for\s+)?(?:the\s+)?(?:details?|documentation|docs|more)\b.*\b(?:see|found|refer)\b|documented\s+(?:in|at|elsewhere)|overrides?\s+base)", re.I)
_ABOUT_DOCS = re.compile(r"\b(?:docs?|documentation|documented|description|docstring|comment|stub)\b", re.I)
_NO_DOCS = re.compile(r"\b(?:no|missing|pending|insert|add|goes|here|needs|write|provided|generated|soon|later|todo|coming|fill|real|of\s+the\s+(?:function|method)|placeholder|auto)\b", re.I)
_HEADING = re.compile(r"^(?:section\s+\w+|chapter\s+\w+|part\s+\w+|helpers?|internals?|utilit(?:y|ies)|constants|lifecycle|handlers?|constructors?|(?:private|public|protected|internal|static)\s+(?:methods?|functions?|api|members?)|getters?\s*(?:&|and|/)\s*setters?|accessors|overrides|imports|types|tests?|api)$", re.I)
_EMPTY_TAGS = re.compile(r"</?\w+[^<>]*>|\{@\w+\}")
_CODE_LINE = re.compile(
    r"^(?:[})\]]+[;,]?|.*[;{]|\w[\w.]*\([^()]*(?:\([^()]*\)[^()]*)*\)|[\w.\[\]\"'*, ]+\s(?:=|:=|\+=|-=)\s.*|.*(?:=>|->)\s*\S.*"
    r"|(?:try|finally|else|default|except\b[^.]*|elif\b[^.]*|case\b[^.]*|for\s+\w+\s+in\b.*|if\s+[\w.!()\s]+(?:==|is|>|<|!=)?.*|while\b.*|with\b.*\bas\s+\w+|def\s+\w+\(.*|class\s+\w+.*)\s*:|return(?:\s+[\w.()\[\]]+)?|raise\s+\w+\(.*\)|defer\s+\w[\w.]*\(.*\)|(?:func|fn|import|from|package|use)\s+[\w.]+(?:\s+import\s+[\w, ]+)?|break|continue|pass|[\w.]+\(.*\)\s+(?:#|//).*)$"
)
_MARKER = re.compile(r"^\s*(?:/\*+!?|\*+/|\*+(?=\s|$)|//[/!]*|#+(?=\s|$|!)|--+(?=\s|$)|;+(?=\s)|\"\"\"|''')\s?")
_TAIL = re.compile(r"\s*(?:\*+/|\"\"\"|''')\s*$")
_FILL = frozenset(
    "a an the this that these it its is are was be been being to of for and or in on at by with from as which what who then also just simply only does do did done make makes used use uses using call called calls named name names says given method methods function functions func procedure routine class helper member returns return see signature input output inputs outputs param params parameter parameters argument arguments value values object instance void none string number boolean int ctx self".split()
)
_SENTENCE = re.compile(r"(?<=[.!?;。！？])\s+|(?<=[。！？])")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_A-Za-z]+")
_TOKEN = re.compile(r"[^\W_]+(?:_[^\W_]+)*")


def words_of(name: str | None) -> list[str]:
    """Lower-cased parts of an identifier."""
    return [w.lower() for w in _CAMEL.findall(name or "")]


def _known(word: str, known: set[str]) -> bool:
    if word in known or word in _FILL:
        return True
    return any(len(k) > 1 and word.startswith(k[:-1] if len(k) > 3 else k) and len(word) - len(k) <= 4 for k in known)


def description(doc: str | None, name: str | None, signature: str | None = None) -> str | None:
    """The prose of a docstring that says more than the name and signature, or None.

    Null, blank or marker-only docstrings give None, as do notices, placeholders, headings, bookkeeping, instructions
    to tools, disabled code, bare parameter lists, pointers elsewhere and restatements of the name.  A missing name or
    signature only means that nothing is known from it.
    """
    if not doc or not doc.strip():
        return None
    lines = doc.splitlines()
    full = [x for x in lines if x.strip()]
    if full and all(x.lstrip().startswith("#") for x in full):
        lines = [re.sub(r"^\s*#+!? ?", "", x) for x in lines]
    inner = [x.strip() for x in lines]
    coded = [bool(x) and bool(_CODE_LINE.match(x)) and not _prose_like(x) for x in inner]
    some_code = any(coded)
    kept: list[str] = []
    for raw, is_code in zip(inner, coded):
        if is_code or not raw or (some_code and raw.startswith(("//", "#"))):
            continue
        line = raw
        for _ in range(3):
            line = _MARKER.sub("", line, count=1)
        line = _EMPTY_TAGS.sub(" ", _TAIL.sub("", line)).strip()
        if not line or not any(c.isalnum() for c in line):
            continue
        if _NOTICE.search(line) or _PLACEHOLDER.match(line) or _DIRECTIVE.match(line) or _BOOKKEEPING.match(line):
            continue
        if tag := _TAG.match(line):
            what = (tag["at"] or tag["sphinx"] or "").lower()
            if what in ("brief", "summary", "description", "remarks", "details", "note", "warning", "deprecated", "returns", "return", "throws") and len(tag["rest"].split()) >= 4:
                line = tag["rest"].rstrip(".") + "."
            else:
                continue
        if _BARE_FIELD.match(line):
            continue
        if fields := _FIELDS.match(line):
            line = fields["rest"]
        line = line.strip(" =-~*#+_|<>[]")
        if not line or _HEADING.match(line):
            continue
        kept.append(line)
    if not kept:
        return None
    known = set(words_of(name)) | {w for p in re.findall(r"[(,]\s*&?(?:mut\s+)?(\w+)", signature or "") for w in words_of(p)}
    if name:
        known.add(name.lower())
    good = [s for s in _SENTENCE.split(" ".join(kept)) if s and _says(s, name, known)]
    return " ".join(good) or None


def _prose_like(line: str) -> bool:
    """A line that only looks like code because of a bracket or a colon at its end."""
    plain = re.sub(r"\([^()]*\)|\"[^\"]*\"", " ", line)
    tokens = plain.split()
    return len(tokens) >= 5 and sum(t.strip(".,:;!?").isalpha() for t in tokens) >= 0.8 * len(tokens) and not line.endswith(("{", "}")) and not re.match(r"(?:for|if|while|with|except|elif|case|let|const|var)\b.*[:{;]$", line)


def _says(sentence: str, name: str | None, known: set[str]) -> bool:
    if _POINTER.match(sentence) or _PLACEHOLDER.match(sentence):
        return False
    tokens = _TOKEN.findall(sentence)
    if len(tokens) <= 14 and _ABOUT_DOCS.search(sentence) and (_NO_DOCS.search(sentence) or _POINTER.search(sentence)):
        return False
    new = [t for t in tokens if not (name and t.lower() == name.lower()) and not all(_known(w, known) for w in words_of(t))]
    if not new:
        return False
    ended = sentence.rstrip(" \"')")[-1:] in ".!?;:。！？"
    wide = any(len(t) >= 6 and ord(t[0]) > 0x2E80 for t in new)
    return ended or wide or len(tokens) >= 5


def in_force(nodes: DataFrame) -> DataFrame:
    """The row with the greatest updated_at of each id (of equal ones, the greatest by the other columns); null ids are left out."""
    row = F.struct(
        F.col("updated_at"), F.coalesce(F.col("docstring"), F.lit("")).alias("d"), "kind", "name", "signature", "file_path", "start_line", "end_line", "language", "docstring"
    )
    best = nodes.where(F.col("id").isNotNull()).groupBy("id").agg(F.max(row).alias("r"))
    return best.select(F.col("id").alias("node_id"), *(F.col(f"r.{c}").alias(c) for c in ("kind", "name", "signature", "file_path", "start_line", "end_line", "language", "docstring")))


def lexed_functions(contents: DataFrame, with_code: bool = True) -> DataFrame:
    """path, name, start_line, end_line, source_doc, code of the functions of each file; the language is that of the extension.

    Files of languages without a lexer, and null or empty texts, have no functions.
    """
    text = contents.where(F.col("path").isNotNull() & (F.length("content") > 0)).select("path", "content", language_of("path").alias("language"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *f[:4], f[4] if with_code else None) for p, t, x in zip(b["path"], b["content"], b["language"]) for f in functions_of(t, x)]
            frame = pd.DataFrame(rows, columns=["path", "name", "start_line", "end_line", "source_doc", "code"])
            yield frame.astype({"start_line": "int32", "end_line": "int32"})

    return in_batches(spread(text.where("language is not null")), run, FUNCTION)


# Extensions and their languages.
EXTENSIONS = {"go": "go", "rs": "rust", "py": "python", "pyi": "python", "java": "java", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp"}


def language_of(path: str) -> F.Column:
    """The language that a path's extension names, or null."""
    names = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    return F.element_at(names, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))


_SPACE = re.compile(r"[\W_]+")


def _same(doc: str, source: str | None) -> bool:
    """The comment in the source is the docstring, but for markers and white space."""
    return bool(source) and _SPACE.sub("", doc) == _SPACE.sub("", source)


def function_pairs(nodes: DataFrame, contents: DataFrame, with_code: bool = True) -> DataFrame:
    """Code-description pairs of functions and methods whose row in force has a docstring that says something.

    node_id, kind, name, signature, file_path, start_line, language, description, origin, code.  The source is lexed,
    functions are delimited and their documentation attached; node and function meet at path, name and first line, and
    a node without a function in its file (or whose file has no text) is no pair.  Where the row's docstring is the
    attached comment (but for markers and white space), the description comes from the comment and origin is 'source';
    where the symbol was indexed with other documentation than the text has, it comes from the row and origin is 'row'.
    Each id appears once; null ids, kinds, names and docstrings are no cases.
    """
    functions = in_force(nodes).where(F.col("kind").isin("function", "method") & (F.length(F.trim("docstring")) > 0)).drop("end_line")
    lexed = lexed_functions(contents, with_code).withColumnRenamed("path", "file_path")
    lexed = lexed.groupBy("file_path", "name", "start_line").agg(F.max(F.struct("end_line", "source_doc", "code")).alias("f"))
    joined = functions.join(lexed, ["file_path", "name", "start_line"]).select(
        "node_id", "kind", "name", "signature", "file_path", "start_line", "language", "docstring", "f.source_doc", "f.code"
    )
    columns = ["node_id", "kind", "name", "signature", "file_path", "start_line", "language", "description", "origin", "code"]
    schema = "node_id string, kind string, name string, signature string, file_path string, start_line int, language string, description string, origin string, code string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            origin = ["source" if _same(d, s) else "row" for d, s in zip(b["docstring"], b["source_doc"].fillna(""))]
            said = [
                description(s if o == "source" else d, n, g or None)
                for o, d, s, n, g in zip(origin, b["docstring"], b["source_doc"], b["name"], b["signature"].fillna(""))
            ]
            b = b.assign(description=said, origin=origin)[[x is not None for x in said]]
            yield b.astype({"start_line": "Int32"})[columns]

    return in_batches(joined, run, schema)


def documented(nodes: DataFrame, contents: DataFrame) -> DataFrame:
    """node_id of the pairs."""
    return function_pairs(nodes, contents, with_code=False).select("node_id").distinct()
