"""Columns on identifiers and paths: native expressions, no Python in the workers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bonus of a node's kind in ranked search.
KIND_BONUS = {
    "function": 10, "method": 10, "class": 8, "interface": 9, "type_alias": 6, "struct": 6, "trait": 9, "enum": 5,
    "component": 8, "route": 9, "module": 4, "property": 3, "field": 3, "variable": 2, "constant": 3, "import": 1,
    "export": 1, "parameter": 0, "namespace": 4, "file": 0, "protocol": 9, "enum_member": 3,
}
# Languages that share a type system.
FAMILIES = {"jvm": ("java", "kotlin", "scala"), "apple": ("swift", "objc"), "web": ("typescript", "tsx", "javascript", "jsx"), "c": ("c", "cpp")}
# Extensions and languages.
LANGUAGE_EXTENSIONS = {
    "go": "go", "typescript": "ts mts cts", "tsx": "tsx", "javascript": "js mjs cjs", "jsx": "jsx", "python": "py pyw", "rust": "rs", "java": "java",
    "c": "c h", "cpp": "cpp cc cxx hpp hxx", "csharp": "cs", "php": "php", "ruby": "rb rake", "swift": "swift", "kotlin": "kt kts", "dart": "dart",
    "scala": "scala sc", "lua": "lua", "r": "r", "objc": "m mm",
}
# Path patterns of tests, of generated files, and of files that don't count for the dominant file.
TEST_NAME = r"(?i)(?:^|/)(?:test[_.][^/]*|[^/]*[._-](?:test|tests|spec|specs)\.[a-z0-9]+)$"
TEST_CAMEL = r"(?:Test|Tests|TestCase|Tester|Spec|Specs)\.[A-Za-z0-9]+$"
TEST_DIR = r"(?i)(?:/(?:__tests__|testlib|testing)/|(?:^|/)(?:tests?|specs?)/)"
TEST_CAMEL_DIR = r"(?:^|/)[A-Za-z0-9]*(?:Test|Tests|Spec)/"
SIDE_DIR = r"(?i)(?:^|/)(?:integration|samples?|examples?|fixtures?|benchmarks?|demos?)/"
GENERATED = (
    r"\.pb\.go$|\.pulsar\.go$|_mocks?\.go$|(?:^|/)mock_[^/]+\.go$|\.(?:generated|gen)\.[jt]sx?$|\.pb\.[jt]s$|_pb\.[jt]s$|\.min\.m?js$|_pb2(?:_grpc)?\.py$|_pb2\.pyi$"
    r"|\.pb\.(?:cc|h)$|\.g\.cs$|Grpc\.cs$|OuterClass\.java$|Grpc\.java$|\.pb\.swift$|\.(?:g|freezed|pb|pbgrpc|chopper)\.dart$|\.generated\.rs$"
)
LOW_VALUE = (
    r"(?i)(?:^|/)(?:tests?|__tests?__|spec)/|_test\.(?:go|py|rb|dart)$|(?:^|/)test_[^/]+\.py$|_spec\.rb$|\.(?:test|spec)\.[jt]sx?$"
    r"|(?:test|spec|tests)\.(?:java|kt|scala)$|(?:tests?|spec)\.cs$|tests?\.swift$"
)


def node_id(path: Column, kind: Column, name: Column, line: Column) -> Column:
    """kind ':' and 32 digits of a hash of path, kind, name and line."""
    return F.concat(kind, F.lit(":"), F.substring(F.sha2(F.concat_ws(":", path, kind, name, line.cast("string")), 256), 1, 32))


def normalized(name: Column) -> Column:
    """ASCII letters and digits in lower case."""
    return F.lower(F.regexp_replace(name, "[^A-Za-z0-9]", ""))


def camel_space(name: Column) -> Column:
    """A blank at each boundary of camel case."""
    return F.regexp_replace(name, "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")


def camel_split(name: Column) -> Column:
    """Lower-case parts of two letters or more, joined by blanks; empty when there is only one."""
    parts = F.filter(F.split(F.regexp_replace(F.lower(camel_space(name)), "[^a-z0-9]", " "), " "), lambda x: F.length(x) >= 2)
    return F.when(F.size(parts) <= 1, "").otherwise(F.array_join(parts, " "))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def directory(path: Column) -> Column:
    """What stands before the last slash; empty if there is none."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    pairs = [x for lang, exts in LANGUAGE_EXTENSIONS.items() for e in exts.split() for x in (F.lit(e), F.lit(lang))]
    return F.coalesce(F.element_at(F.create_map(*pairs), ext), F.lit("unknown"))


def family(lang: Column) -> Column:
    """The family of a language; a language without one is its own."""
    out = lang
    for name, members in FAMILIES.items():
        out = F.when(lang.isin(*members), F.lit(f"family:{name}")).otherwise(out)
    return out


def is_test(path: Column) -> Column:
    """Tests by name or directory, and directories beside production code."""
    return path.rlike(TEST_NAME) | path.rlike(TEST_CAMEL) | path.rlike(TEST_DIR) | path.rlike(TEST_CAMEL_DIR) | path.rlike(SIDE_DIR)


def is_generated(path: Column) -> Column:
    return path.rlike(GENERATED)


def is_low_value(path: Column) -> Column:
    return path.rlike(LOW_VALUE) | is_generated(path)


def is_distinctive(token: Column) -> Column:
    """An underscore, a digit, or a capital after the first letter."""
    return token.rlike("[_0-9]|^.+[A-Z]")


def kind_bonus(kind: Column) -> Column:
    pairs = [F.lit(x) for p in KIND_BONUS.items() for x in p]
    return F.coalesce(F.element_at(F.create_map(*pairs), kind), F.lit(0))


def proximity(a: Column, b: Column) -> Column:
    """15 for each leading directory that two paths share, 80 at most."""
    dirs = lambda p: F.slice(F.split(p, "/"), F.lit(1), F.size(F.split(p, "/")) - 1)
    same = F.zip_with(dirs(a), dirs(b), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first_off = F.array_position(same, F.lit(False))
    return F.least(F.lit(80), F.lit(15) * F.when(first_off > 0, first_off - 1).otherwise(F.size(same))).cast("int")


def _any_in(text: Column, words: Iterable[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def name_bonus(name: Column, query: str) -> Column:
    """How well a name answers a query: 80 the whole, 60 one of its words, 10 to 40 a prefix, 15 all its parts, 10 a part."""
    import re

    words = [w.lower() for w in query.split() if len(w) >= 2]
    whole = "".join(query.split()).lower()
    parts = [p.lower() for p in re.split(r"[\s_.\-]+", re.sub(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", query)) if len(p) >= 2]
    low = F.lower(name)
    out = F.when(low == whole, 80)
    if len(words) > 1:
        out = out.when(low.isin(*words), 60)
    if whole:
        out = out.when(low.startswith(whole), F.round(10 + 30 * len(whole) / F.greatest(F.length(low), F.lit(1))).cast("int"))
    if len(parts) > 1:
        every = F.lit(True)
        for p in parts:
            every = every & low.contains(p)
        out = out.when(every, 15)
    if whole:
        out = out.when(low.contains(whole), 10)
    return out.otherwise(0)


def path_relevance(path: Column, query: str, project_words: frozenset[str] = frozenset()) -> Column:
    """Points for query words in file name (10), directory (5) or path (3); tests lose 15 unless the query is about them."""
    from graphloom.functions.query_text import search_terms

    words = query.split()
    if not words:
        return F.lit(0)
    kept = [w for w in words if "".join(c for c in w.lower() if c.isascii() and c.isalnum()) not in project_words] or words
    low, score = F.lower(path), F.lit(0)
    for w in kept:
        terms = search_terms(w, stems=False)
        if terms:
            score = score + F.when(_any_in(base_name(low), terms), 10).otherwise(0)
            score = score + F.when(_any_in(directory(low), terms), 5).when(_any_in(low, terms), 3).otherwise(0)
    if "test" in query.lower() or "spec" in query.lower():
        return score
    return score - F.when(is_test(path), 15).otherwise(0)
