"""Problem 4: generated, minified, vendored and data files among source code.

An inverted index of rare line hashes finds text that also stands in another
repository; the files that remain are judged by opening comment, path and the
composition of their tokens.  Every file is lexed once.  Files
with the same lines are one class.  A class of n lines that shall hold at least t
of them elsewhere can't do without all of any m - t + 1 of its m lines that stand
elsewhere at all, so the holders of its rarest m - t + 1 are all its candidates,
and the shared lines of each are counted exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.lexing import mask
from graphloom.session import cut_lineage, in_batches

MIN_LINE = 12  # characters of a line that is indexed
MIN_LINES = 5  # distinct indexed lines of a file that can be a copy
CONTAINED = 0.8  # share of a file's lines that stand in one file of another repository
JUDGED = "path string, rule string, marked boolean"

# What generators write at the top of a file, in some languages.
_GENERATED = re.compile(
    r"code generated (?:by|from)|do not edit\b|do not (?:modify|change)\b|don't edit|auto-?\s?generated (?:file|by|from|code|on|using|-)|autogenerated\b|automatically[- ](?:generated|created|produced|written)|@generated\b|<auto-?generated"
    r"|\b(?:generated|produced|created|written|built|emitted|output) (?:automatically |on [\d-]+ )?(?:by|with|from|using) (?:the |a )?[\w.\-]+ ?(?:compiler|generator|tool|script|v?\d|from|on)|regenerate instead|changes (?:will be|are) (?:lost|overwritten)|edits (?:get|are|will be) (?:overwritten|lost)|machine[- ](?:written|generated|made)"
    r"|generiert\b|nicht bearbeiten|nicht (?:ändern|editieren)|généré|ne pas (?:modifier|éditer)|generado (?:autom|por)|no (?:editar|modificar)|gerado (?:autom|por)|сгенерирован|не редактир|自動生成|自动生成|編集しない|请勿",
    re.I,
)
_MENTION = re.compile(r"method stub|generated by hand|not generated|hand[- ]?written|\bemits?\b|\bwe (?:emit|generate|write)\b|\bevery file we\b", re.I)
_UPSTREAM = re.compile(r"\b\w+ v?\d+(?:\.\d+)+\S* - upstream|upstream (?:release|version|source)|vendored from|copied from https?:|imported from upstream|origin: https?:", re.I)
_GENERATED_NAME = re.compile(
    r"(?:_pb2(?:_grpc)?\.pyi?|\.pb(?:\.\w+)?\.(?:go|h|cc|c|cpp|ts|js|rs|swift|dart)|\.pb\.\w+|_grpc\.pb\.go|_pb\.(?:js|ts|d\.ts|rb)|OuterClass\.java|Grpc\.java|\.generated\.\w+|_generated\.\w+|\.g\.(?:dart|cs|ts)|\.designer\.cs|\.gen\.\w+|/zz_generated[\w.]*|/mock_\w+\.go|/(?:__generated__|generated)/[^/]+|\.min\.m?js|\.bundle\.m?js)$"
)
_VENDOR_DIR = re.compile(r"(?:^|/)(?:vendor|_vendor|third[-_]?party|3rd[-_]?party|node_modules|bower_components|site-packages|dist-packages|external|extern|externals|Godeps|Carthage|Pods|jspm_packages|deps/[\w.]+-\d[\w.]*)/")
_TRANSPILED = re.compile(r'Object\.defineProperty\(exports, *["\']__esModule["\']|var __(?:extends|awaiter|generator|decorate|importDefault|createBinding|assign|rest|spreadArray) = \(this && this\.__|__webpack_require__|System\.register\(|^//# sourceMappingURL=|sourceMappingURL=data:', re.M)
_BANNER = re.compile(r"^\s*/\*!")
_DATA = re.compile(r'"[ ]*"|\b(?:0[xX][0-9a-fA-F]+|\d[\d_.]*(?:[eE][+-]?\d+)?[uUlLfF]*)\b')
_NAME = re.compile(r"[A-Za-z_$][\w$]*")


def judge(path: str | None, text: str | None, language: str | None) -> tuple[str | None, bool]:
    """(why a file isn't written by hand, or None; whether path or opening comment mark it as somebody else's).

    A null path, a null or blank text and a null language say nothing.
    """
    where = path or ""
    text = text or ""
    if not text.strip():
        return None, False
    outside = bool(_VENDOR_DIR.search("/".join(where.split("/")[1:])))
    masked = mask(text, language)
    code = masked.code
    stripped = code.lstrip("﻿ \t\r\n")
    first = len(code) - len(stripped)
    head = [text[b:e] for b, e in masked.comments if b <= first]
    if (language or "") == "python" and stripped.startswith('"') and masked.strings:
        b, e = masked.strings[0]
        head.append(text[b:e])
    for comment in head:
        for line in comment.splitlines():
            if _GENERATED.search(line) and not _MENTION.search(line):
                return "generated", outside
    if any(_UPSTREAM.search(c) for c in head):
        return "vendored", True
    if outside:
        return "vendored", True
    if _GENERATED_NAME.search(where):
        return "minified" if ".min." in where else "generated", False
    if _minified(text, code, language):
        return "minified", False
    if _TRANSPILED.search(text) and any(_TRANSPILED.search(code[max(0, m.start() - 1) : m.end() + 80]) or code[m.start()] != " " for m in [_TRANSPILED.search(text)]):
        return "generated", False
    if _data(code):
        return "data", False
    return None, False


def _minified(text: str, code: str, language: str | None) -> bool:
    """Long lines of short names with next to no white space; comments don't count."""
    if (language or "") not in ("javascript", "typescript") or len(code) < 200:
        return False
    lines = [x for x in code.splitlines() if x.strip()]
    dense = [x for x in lines if len(x) >= 200 and len(re.findall(r"[;{},]", x)) >= len(x) / 25]
    size = sum(len(x.strip()) for x in lines)
    if sum(map(len, dense)) < 0.6 * size:
        return False
    joined = re.sub(r'"[ ]*"', '""', "\n".join(dense))
    names = _NAME.findall(joined)
    spaces = sum(c == " " for c in joined)
    return spaces < 0.12 * len(joined) and sum(len(n) <= 2 for n in names) >= 0.25 * len(names)


def _data(code: str) -> bool:
    """Most tokens are literals."""
    literals = len(_DATA.findall(code))
    if literals < 60:
        return False
    names = len(_NAME.findall(re.sub(r"\b0[xX][0-9a-fA-F]+", "0", code)))
    return literals >= 4 * names


def rules(files: DataFrame, contents: DataFrame) -> DataFrame:
    """path, rule, marked of each file with text, by what stands in it alone."""
    named = files.where(F.col("path").isNotNull()).groupBy("path").agg(F.max("language").alias("language"))
    text = contents.where(F.col("path").isNotNull() & F.col("content").isNotNull()).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [judge(*x) for x in zip(b["path"], b["content"], b["language"])]
            yield pd.DataFrame({"path": b["path"], "rule": [g[0] for g in got], "marked": [g[1] for g in got]})

    return in_batches(text.join(named, "path"), run, JUDGED)


def line_classes(contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, repo, class of each file; class, lines, n, least and greatest (repo, path) of each class of files with the same lines)."""
    text = contents.where(F.col("path").isNotNull() & F.col("content").isNotNull()).select("path", "content").distinct()
    split = F.array_distinct(F.transform(F.split("content", "\r\n|\r|\n"), F.trim))
    hashed = F.array_sort(F.array_distinct(F.transform(F.filter(split, lambda x: F.length(x) >= MIN_LINE), lambda x: F.xxhash64(x))))
    held = cut_lineage(
        text.select("path", F.substring_index("path", "/", 1).alias("repo"), hashed.alias("lines")).where(F.size("lines") > 0).withColumn("class", F.xxhash64("lines"))
    )
    own = F.struct("repo", "path")
    classes = held.groupBy("class").agg(F.first("lines").alias("lines"), F.min(own).alias("a"), F.max(own).alias("b")).withColumn("n", F.size("lines"))
    return held.select("path", "repo", "class"), cut_lineage(classes)


def class_links(classes: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """class, other, share: all pairs of classes with files in two repositories, of which ``other`` has at least the share ``contained`` of the lines of ``class``."""
    lines = classes.select("class", F.col("a.repo").alias("lo"), F.col("b.repo").alias("hi"), "n", F.explode("lines").alias("line"))
    spread = lines.groupBy("line").agg(F.count("*").alias("holders"), F.min("lo").alias("first"), F.max("hi").alias("last")).where("holders > 1 and first <> last")
    needed = F.ceil(F.lit(contained) * F.col("n") - F.lit(1e-9))
    rare = (
        lines.where(F.col("n") >= MIN_LINES).join(spread, "line").groupBy("class", "lo", "hi", "n").agg(F.collect_list(F.struct("holders", "line")).alias("found"))
        .where(F.size("found") >= needed)
        .select("class", "lo", "hi", "n", F.explode(F.slice(F.array_sort("found"), F.lit(1), (F.size("found") - needed + 1).cast("int"))).alias("l"))
        .select("class", "lo", "hi", "n", F.col("l.line").alias("line"))
    )
    theirs = lines.select(F.col("class").alias("other"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("n").alias("n2"), "line")
    apart = (F.col("lo") != F.col("hi2")) | (F.col("lo2") != F.col("hi"))
    pairs = rare.join(theirs, "line").where((F.col("class") != F.col("other")) & apart & (F.col("n2") >= needed)).select("class", "other").distinct()
    mine = classes.select("class", "n", F.col("lines").alias("mine"))
    shared = pairs.join(mine, "class").join(classes.select(F.col("class").alias("other"), "lines"), "other").withColumn("shared", F.size(F.array_intersect("mine", "lines")))
    return shared.where(F.col("shared") >= contained * F.col("n")).select("class", "other", F.round(F.col("shared") / F.col("n"), 6).alias("share"))


def copied_lines(held: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """Files most of whose lines stand in one file of another repository: path, other, share.

    Lines are compared without their indentation; short ones (under MIN_LINE characters) and repeated ones of a file
    don't count, and files with fewer than MIN_LINES left are no cases.  The repository is the path up to its first
    slash.  Of several candidates the one with the greatest share and then the smallest path is named.
    """
    ends = classes.select("class", "a", "b", "n")
    away = lambda a, b: F.when(F.col(f"{a}.repo") != F.col("repo"), F.col(f"{a}.path")).when(F.col(f"{b}.repo") != F.col("repo"), F.col(f"{b}.path"))
    files = held.join(ends, "class").where(F.col("n") >= MIN_LINES).select("path", "repo", "class", away("a", "b").alias("mate"))
    equal = files.where("mate is not null").select("path", F.col("mate").alias("other"), F.lit(1.0).alias("share"))
    theirs = links.join(ends.select(F.col("class").alias("other"), F.col("a").alias("c"), F.col("b").alias("d")), "other")
    near = files.where("mate is null").join(theirs, "class").select("path", away("c", "d").alias("found"), "share").where("found is not null")
    best = near.groupBy("path").agg(F.min(F.struct((-F.col("share")).alias("k"), "found")).alias("v")).select("path", F.col("v.found").alias("other"), (-F.col("v.k")).alias("share"))
    return equal.unionByName(best)


def copy_groups(links: DataFrame) -> DataFrame:
    """class, group: the least class that links lead to, in either direction, for every class that has a link."""
    both = links.select(F.col("class").alias("x"), F.col("other").alias("y"))
    both = cut_lineage(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    groups = both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("class"), F.least("x", "y").alias("group"))
    while True:
        groups = cut_lineage(groups)
        near = both.join(groups.select(F.col("class").alias("y"), "group"), "y").groupBy("x").agg(F.min("group").alias("near")).withColumnRenamed("x", "class")
        least = groups.join(near, "class").select("class", F.least("group", "near").alias("least"), "group")
        above = groups.select(F.col("class").alias("least"), F.col("group").alias("further"))
        moved = cut_lineage(least.join(above, "least", "left").select("class", F.least("least", F.coalesce("further", "least")).alias("to"), "group"))
        if not moved.where("to <> group").limit(1).count():
            return groups
        groups = moved.select("class", F.col("to").alias("group"))


def originals(held: DataFrame, classes: DataFrame, links: DataFrame, copies: DataFrame, marked: DataFrame) -> DataFrame:
    """path: of each group of copies with a marked file, the one copy without a mark that counts as the original, if there is any.

    It is the one of which a marked file holds (or is) the greatest share of its own lines, and of equal ones that with the smallest path.
    """
    known = held.select("path", "class").join(marked.withColumn("marked", F.lit(True)), "path", "left").withColumn("marked", F.coalesce("marked", F.lit(False)))
    groups = classes.select("class").join(copy_groups(links), "class", "left").select("class", F.coalesce("group", "class").alias("group"))
    signed = known.where("marked").select("class").distinct()
    with_mark = signed.join(groups, "class").select("group").distinct()
    near = links.join(signed, "class").select(F.col("other").alias("class"), "share").unionByName(signed.withColumn("share", F.lit(1.0))).groupBy("class").agg(F.max("share").alias("near"))
    unmarked = known.where("not marked").join(copies.select("path"), "path", "left_semi").join(groups, "class").join(with_mark, "group", "left_semi")
    ranked = unmarked.join(near, "class", "left").select("group", F.struct((-F.coalesce("near", F.lit(0.0))).alias("far"), "path").alias("k"))
    return ranked.groupBy("group").agg(F.min("k").alias("k")).select("k.path")


def not_handwritten(files: DataFrame, contents: DataFrame) -> DataFrame:
    """Files that nobody wrote by hand in their repository: path, reason ('generated', 'minified', 'vendored', 'data'), other.

    A file held by one of another repository is 'vendored'; opening comment, path and token composition judge the others.
    Copies that hold each other's lines, directly or over others, are a group.  In a group with a file that path or
    opening comment mark as a copy, one file without such a mark is left as the original.
    Files without text, with null paths or missing from ``files`` are no cases; repeated rows count once.
    """
    ruled = cut_lineage(rules(files, contents).where("rule is not null or marked"))
    held, classes = line_classes(contents)
    links = cut_lineage(class_links(classes))
    copies = cut_lineage(copied_lines(held, classes, links).join(files.select("path").distinct(), "path", "left_semi"))
    marked = ruled.where("marked").select("path").distinct()
    joined = copies.select("path", "other").join(ruled, "path", "full")
    if copies.join(marked, "path", "left_anti").limit(1).count():
        joined = joined.join(originals(held, classes, links, copies, marked).withColumn("original", F.lit(True)), "path", "left")
    else:
        joined = joined.withColumn("original", F.lit(False))
    copied = F.col("other").isNotNull() & ~F.coalesce("original", F.lit(False))
    reason = F.when(copied, F.lit("vendored")).otherwise(F.col("rule"))  # composition and marks judge the files that are no copies
    return joined.select("path", reason.alias("reason"), "other").where("reason is not null").groupBy("path").agg(
        F.min("reason").alias("reason"), F.min("other").alias("other")
    )
