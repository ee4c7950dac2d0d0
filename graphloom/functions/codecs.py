"""Words of the model read leniently: what is outside a domain becomes its default. Lists and metadata as JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The domains and what stands for any other word.
NODE_KINDS = "file module class struct interface trait protocol function method property field variable constant enum enum_member type_alias namespace parameter import export route component".split()
EDGE_KINDS = "contains calls imports exports extends implements references type_of returns instantiates overrides decorates".split()
PROVENANCES = ("tree-sitter", "scip", "heuristic")
VISIBILITIES = ("public", "private", "protected", "internal")
METADATA = "confidence double, resolvedBy string, synthesizedBy string, via string, registeredAt string, event string"


def decoded(word: Column, domain: Sequence[str], default: str | None) -> Column:
    """The word if its domain has it, else the default; null counts as outside."""
    return F.when(word.isin(*domain), word).otherwise(F.lit(default))


def node_kind(word: Column) -> Column:
    return decoded(word, NODE_KINDS, "file")


def edge_kind(word: Column) -> Column:
    return decoded(word, EDGE_KINDS, "contains")


def reference_kind(word: Column) -> Column:
    return decoded(word, [*EDGE_KINDS, "function_ref"], "references")


def provenance(word: Column) -> Column:
    return decoded(word, PROVENANCES, "tree-sitter")


def visibility(word: Column) -> Column:
    return decoded(word, VISIBILITIES, None)


def list_text(items: Column) -> Column:
    """A list as JSON; null and empty lists are null."""
    return F.when(F.size(items) > 0, F.to_json(items))


def list_of(text: Column) -> Column:
    """The list that a JSON text holds; null where it holds none."""
    return F.from_json(text, "array<string>")


def metadata_text(told: Column) -> Column:
    return F.to_json(told)


def metadata_of(text: Column) -> Column:
    return F.from_json(text, METADATA)
