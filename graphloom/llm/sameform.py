"""Problem 8: one form for texts that look the same.

Only what stands at a character outside ASCII can change.  Texts are cut there,
the distinct pieces are exploded to positioned code points and joined with a
mapping of code points (decompositions and look-alikes), their combining marks
are ordered by class, each starter is recomposed with its marks, and pieces and
texts are put together again.  A text of plain ASCII is already in the form.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from graphloom.session import cut_lineage, ship_package

# Letters that look like a Latin letter, and the letters they look like, in the same order.
LOOKALIKES = {
    "Cyrillic": ("АВЕЅІЈКМНОРСТХаеѕіјорсухԁԛԝһӏԌԜ", "ABESIJKMHOPCTXaesijopcyxdqwhlGW"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳ", "ABEZHIKMNOPTYXocj"),
    "Armenian": ("օսհցոՍՏՕ", "ouhgnUSO"),
    "Latin": ("ɑɡı", "agi"),
}
# Hyphens, and the kinds of compatibility that a reader sees.
HYPHENS = "‐‑﹣－"
SEEN_KINDS = ("<super>", "<sub>", "<circle>", "<fraction>", "<square>", "<font>")


def invisible(c: str) -> bool:
    """Characters that leave no mark: format characters, variation selectors, fillers."""
    o = ord(c)
    if 0x600 <= o <= 0x605:
        return False
    return unicodedata.category(c) == "Cf" or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or o in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0)


def _form_of(c: str, alike: dict[str, str]) -> str:
    if c in alike:
        return alike[c]
    if invisible(c):
        return ""
    if unicodedata.category(c) == "Zs":
        return " "
    if 0xAC00 <= ord(c) <= 0xD7A3:
        return unicodedata.normalize("NFD", c)
    parts = unicodedata.decomposition(c)
    if not parts:
        return c
    kind, *codes = parts.split() if parts[0] == "<" else ("", *parts.split())
    if kind in SEEN_KINDS or kind == "<compat>" and unicodedata.category(c)[0] != "L":
        return c
    return "".join(_form_of(chr(int(x, 16)), alike) for x in codes)


@cache
def mapping() -> dict[str, str]:
    """Code point -> decomposed form, for the code points that change; built from Unicode's data and the fixed values above."""
    alike = dict.fromkeys(HYPHENS, "-")
    for odd, plain in LOOKALIKES.values():
        alike |= dict(zip(odd, plain, strict=True))
    points = (chr(o) for o in (*range(0x80, 0xD800), *range(0xE000, 0x30000), *range(0xE0000, 0xE0200)))
    return {c: f for c in points if (f := _form_of(c, alike)) != c}


@cache
def _table() -> dict[int, str]:
    return {ord(k): v for k, v in mapping().items()}


def same_form(text: str | None) -> str | None:
    """The form of one text, for single strings; the DataFrame operator gives the same. Null stays null."""
    if text is None or text.isascii():
        return text
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text.translate(_table())))


def _point_table(spark: SparkSession) -> DataFrame:
    """One row per code point that changes or combines: some twenty thousand rows, whatever the data."""
    changed = mapping()
    rows = [(c, [(x, unicodedata.combining(x)) for x in unicodedata.normalize("NFD", f)]) for c, f in changed.items()]
    rows += [(chr(o), [(chr(o), k)]) for o in (*range(0x300, 0xD800), *range(0xE000, 0x1F000)) if chr(o) not in changed and (k := unicodedata.combining(chr(o)))]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["cp", "parts"]), "cp string, parts array<struct<c string, ccc int>>")


_CUT = r"(?=[\x00-\x7F][^\x00-\x7F])|(?<=[^\x00-\x7F])(?=[\x00-\x7F])"
_WIDE = r"[^\x00-\x7F]"
_JAMO = r"^[ᅡ-ᆧᆨ-ᇿ]$"


@F.pandas_udf(StringType())
def _composed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x))


def piece_forms(pieces: DataFrame) -> DataFrame:
    """piece, form of the distinct non-null strings in column ``piece``."""
    ship_package(pieces.sparkSession)
    points = pieces.select("piece", F.posexplode(F.split("piece", "")).alias("i", "cp")).where("cp <> ''")
    parts = points.join(F.broadcast(_point_table(pieces.sparkSession)), "cp", "left").select(
        "piece", "i", F.posexplode(F.coalesce("parts", F.array(F.struct(F.col("cp").alias("c"), F.lit(0).alias("ccc"))))).alias("j", "part")
    )
    points = parts.select("piece", "i", "j", F.col("part.c").alias("c"), F.col("part.ccc").alias("ccc"))
    order = Window.partitionBy("piece").orderBy("i", "j").rowsBetween(Window.unboundedPreceding, 0)
    starter = F.when(F.col("ccc") == 0, 1).otherwise(0)
    starts = F.when(F.col("c").rlike(_JAMO), 0).otherwise(starter)  # vowels and finals of Hangul join the syllable before them
    numbered = points.withColumn("run", F.sum(starts).over(order)).withColumn("base", F.sum(starter).over(order))
    runs = numbered.groupBy("piece", "run").agg(F.sort_array(F.collect_list(F.struct("base", "ccc", "i", "j", "c"))).alias("ordered"))
    runs = runs.select("piece", "run", F.array_join(F.transform("ordered", lambda x: x["c"]), "").alias("cluster"))
    compound = runs.where(F.length("cluster") > 1).select("cluster").distinct().select("cluster", _composed("cluster").alias("whole"))
    whole = runs.join(compound, "cluster", "left").select("piece", "run", F.coalesce("whole", "cluster").alias("whole"))
    some = whole.groupBy("piece").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run", "whole"))), lambda x: x["whole"]), "").alias("form"))
    return pieces.join(some, "piece", "left").select("piece", F.coalesce("form", F.lit("")).alias("form"))


def distinct_forms(texts: DataFrame, text: str = "text") -> DataFrame:
    """key, form of the distinct texts that aren't plain ASCII; key is the SHA-256 of the text."""
    wide = texts.where(F.col(text).rlike(_WIDE)).select(F.sha2(text, 256).alias("key"), F.col(text).alias("text"))
    cut = wide.groupBy("key").agg(F.min("text").alias("text")).select("key", F.split("text", _CUT).alias("cut"))
    units = cut.select("key", F.posexplode("cut").alias("at", "piece")).where(F.col("piece").rlike(_WIDE))
    forms = piece_forms(units.select("piece").distinct())
    changed = units.join(forms, "piece").where("form <> piece").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("at", "form"))).alias("new"))
    return cut.join(changed, "key", "left").select(
        "key", F.array_join(F.transform("cut", lambda p, i: F.coalesce(F.element_at("new", i), p)), "").alias("form")
    )


def canonical_texts(documents: DataFrame, text: str = "text", out: str = "form") -> DataFrame:
    """The input with one further column: the text in its one form.

    Null texts get a null form, empty texts an empty one; a text of invisible characters only becomes empty.  Repeated
    rows stay repeated, other columns are untouched (a column already called like ``out`` is replaced).
    """
    kept = documents.drop(out) if out in documents.columns else documents
    forms = distinct_forms(kept.select(text), text).select(F.col("key").alias("__key"), F.col("form").alias("__form"))
    key = F.when(F.col(text).rlike(_WIDE), F.sha2(text, 256))
    return kept.withColumn("__k", key).join(forms, F.col("__k") == F.col("__key"), "left").select(
        *(kept[c] for c in kept.columns), F.coalesce("__form", text).alias(out)
    )


def _looks(documents: DataFrame) -> DataFrame:
    """doc_id, raw (hash of the text), look (hash of its form) of distinct rows; every text is read and hashed once, and the hashes are kept."""
    docs = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.sha2("text", 256).alias("raw"), F.col("text").rlike(_WIDE).alias("wide"))
    raw = cut_lineage(docs)
    forms = distinct_forms(documents.where(F.col("doc_id").isNotNull())).select(F.col("key").alias("raw"), F.sha2("form", 256).alias("look"))
    narrow = raw.where("not wide").select("doc_id", "raw", F.col("raw").alias("look"))
    return narrow.unionByName(raw.where("wide").join(forms, "raw").select("doc_id", "raw", "look")).distinct()


def look_classes(documents: DataFrame) -> DataFrame:
    """doc_id, raw (hash of the text), look (hash of its form), representative (least doc_id of equal-looking texts)."""
    seen = _looks(documents)
    least = seen.groupBy("look").agg(F.min("doc_id").alias("representative"))
    return seen.join(least, "look").select("doc_id", "raw", "look", "representative")


def equal_looking_pairs(documents: DataFrame) -> DataFrame:
    """doc_id_a < doc_id_b of documents whose texts look the same and are different strings.

    Null texts and null ids are in no pair.  The result grows with the product of the spellings of a text and their
    copies; only texts with two spellings take part.
    """
    seen = cut_lineage(_looks(documents))
    several = seen.groupBy("look").agg(F.min("raw").alias("a"), F.max("raw").alias("b")).where("a <> b").select("look")
    members = cut_lineage(seen.join(several, "look", "left_semi"))
    a = members.select(F.col("doc_id").alias("doc_id_a"), "look", F.col("raw").alias("raw_a"))
    b = members.select(F.col("doc_id").alias("doc_id_b"), "look", F.col("raw").alias("raw_b"))
    return a.join(b, "look").where("doc_id_a < doc_id_b and raw_a <> raw_b").select("doc_id_a", "doc_id_b").distinct()
