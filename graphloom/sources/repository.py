"""Repositories on disk or in an object store: walking, guards, module files and slices of lines."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import names
from graphloom.sources.extract import MAX_BYTES

# Directories that hold no sources of their own, at any depth.
SKIPPED = frozenset(
    "node_modules bower_components jspm_packages web_modules .yarn .pnpm-store .next .nuxt .svelte-kit .turbo .vite .parcel-cache .angular .docusaurus storybook-static .vinxi .nitro out-tsc "
    ".vercel .netlify .wrangler dist build out .output coverage .nyc_output __pycache__ __pypackages__ .venv venv .pixi .pdm-build .mypy_cache .pytest_cache .ruff_cache .tox .nox .hypothesis "
    ".ipynb_checkpoints .eggs target .gradle obj vendor .build Pods Carthage DerivedData .swiftpm .dart_tool .pub-cache .cxx .externalNativeBuild vcpkg_installed .bloop .metals lua_modules "
    ".luarocks __history __recovery .cache .git".split()
)


def ignore_pattern(rule: str, folder: str = "") -> tuple[bool, str] | None:
    """(whether the rule takes back, regular expression of the paths it covers) for a line of a .gitignore in a folder; None for blanks and comments.

    * and ? stay within a name, ** crosses folders; a rule with a slash inside counts from its folder, others at any depth.
    """
    text = re.sub(r"(?<!\\)\s+$", "", rule)
    if not text or text.startswith("#"):
        return None
    back = text.startswith("!")
    text = text.removeprefix("!").removeprefix("\\")
    only_folders, body = text.endswith("/"), text.strip("/")
    anchored = "/" in text.rstrip("/")
    out = ""
    for part in re.findall(r"/\*\*/|^\*\*/|/\*\*$|\*+|\?|\[!?\]?[^\]]*\]|\\.|.", body):
        if part in ("**/", "/**/"):
            out += "/(?:.*/)?" if part[0] == "/" else "(?:.*/)?"
        elif part == "/**":
            out += "/.+"
        elif part[0] == "*":
            out += "[^/]*"
        elif part == "?":
            out += "[^/]"
        elif part[0] == "[" and len(part) > 2:
            out += "[" + part[1:-1].replace("\\", "\\\\").replace("!", "^", 1 if part[1] == "!" else 0) + "]"
        else:
            out += re.escape(part[-1])
    base = re.escape(folder.strip("/")) + "/" if folder.strip("/") else ""
    return back, f"^{base}{'' if anchored else '(?:.*/)?'}{out}{'/.*' if only_folders else '(?:/.*)?'}$"


def ignored(path: str, rules: list[str]) -> bool:
    """Whether rules of a .gitignore at the root exclude a relative path; later rules win, ! takes back."""
    out = False
    for back, pattern in filter(None, map(ignore_pattern, rules)):
        if re.match(pattern, path):
            out = not back
    return out


def ignore_rules(root: str) -> list[tuple[bool, str]]:
    """The rules of .git/info/exclude and of every .gitignore below a local root, outer ones first."""
    found = []
    exclude = os.path.join(root, ".git", "info", "exclude")
    if os.path.isfile(exclude):
        found.append(("", exclude))
    for folder, inner, names_here in os.walk(root):
        inner[:] = sorted(d for d in inner if d not in SKIPPED)
        if ".gitignore" in names_here:
            found.append((os.path.relpath(folder, root).replace(os.sep, "/").removeprefix("."), os.path.join(folder, ".gitignore")))
    out = []
    for folder, file in found:
        with open(file, encoding="utf-8", errors="replace") as f:
            out += [p for p in (ignore_pattern(x.rstrip("\n\r"), folder) for x in f) if p]
    return out


def project_words(root: str) -> frozenset[str]:
    """What the project itself is called, by go.mod, package.json and its folder: normalised, five letters or more. Such words say nothing in a query."""
    told = [os.path.basename(os.path.realpath(root))]
    for file, read in (("go.mod", lambda t: (re.search(r"(?m)^\s*module\s+(\S+)", t) or ["", ""])[1]), ("package.json", lambda t: json.loads(t).get("name") or "")):
        try:
            with open(os.path.join(root, file), encoding="utf-8") as f:
                told.append(str(read(f.read())).rpartition("/")[2])
        except (OSError, ValueError, AttributeError):
            continue
    return frozenset(w for w in (re.sub(r"[^a-z0-9]", "", t.lower()) for t in told) if len(w) >= 5)


def inside(root: str, path: str) -> str | None:
    """The real path, if it lies within root."""
    base, real = os.path.realpath(root), os.path.realpath(os.path.join(root, path))
    return real if real == base or real.startswith(base + os.sep) else None


def read_repository(spark: SparkSession, root: str, rules: list[str] | None = None) -> DataFrame:
    """path, content, content_hash, size, modified_at, language of the source files below root.

    Skipped directories, files ignored by .gitignore files, .git/info/exclude (both of local roots) and ``rules``, unknown extensions, files over MAX_BYTES and bytes that aren't UTF-8 are left out.
    """
    base = f"file:{os.path.realpath(root)}" if "://" not in root else root
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    prefix = re.sub(r"^file:/*", "/", base).rstrip("/") + "/"
    path = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), "^" + re.escape(prefix).replace("\\-", "-"), "")
    parts = F.split("path", "/")
    rows = files.where(F.col("length") <= MAX_BYTES).select(path.alias("path"), "content", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified_at"))
    rows = rows.where(F.size(F.array_intersect(parts, F.array(*map(F.lit, sorted(SKIPPED))))) == 0).withColumn("language", names.language(F.col("path"))).where("language <> 'unknown'")
    told = ignore_rules(root) if "://" not in root else []
    skip = F.lit(False)
    for back, pattern in [*told, *filter(None, map(ignore_pattern, rules or []))]:  # the last rule that covers a path decides
        skip = F.when(F.col("path").rlike(pattern), F.lit(not back)).otherwise(skip)
    rows = rows.where(~skip)
    rows = rows.where(F.is_valid_utf8(F.col("content").cast("string")))
    return rows.select("path", F.col("content").cast("string").alias("content"), F.sha2("content", 256).alias("content_hash"), "size", "modified_at", "language")


def go_module(text: str) -> str | None:
    """The module that a go.mod names."""
    m = re.search(r"(?m)^\s*module\s+(\S+)\s*$", re.sub(r"//[^\n]*", "", text))
    return m[1].strip("\"'`") if m else None


def slice_lines(content: Column, first: Column, last: Column) -> Column:
    """Lines first to last of a text, both counted from 1; null where the text or a bound is."""
    lines = F.split(content, "\n")
    return F.array_join(F.slice(lines, F.greatest(first, F.lit(1)), F.greatest(last - F.greatest(first, F.lit(1)) + 1, F.lit(0))), "\n")
