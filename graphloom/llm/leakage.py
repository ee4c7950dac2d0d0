"""Problem 7: evaluation texts that leaked into training text.

Texts become word sequences as a reader sees them.  Fixed masks over SPAN words
ignore some positions; the words at the others are hashed, and seeds of corpus
and test items are joined.  Wherever up to TOLERATED words of a window are
replaced, one mask ignores them all.  Around each hit the two windows are compared
word by word, so that copies with a few replaced words are seen too, and a window
without any replaced word proves SPAN consecutive words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.sameform import same_form
from graphloom.session import cut_lineage, in_batches, spread

SPAN = 12
TOLERATED = 3  # replaced words of a window that still counts as an overlap
#: Which of SPAN words a seed looks at: any TOLERATED positions are zeros of some mask (a covering design of 12 points, blocks of 6 and all triples).
MASKS = (
    "000011111001", "001001011110", "001100100111", "010100111100", "010111000101", "011000011011", "011011100010", "100001110110",
    "100010001111", "101101010001", "101110101000", "110101001010", "110110000011", "111000101001", "111010010100",
)
FILTER_BITS = 26  # log2 of the bits of a filter of the test seeds (8 MB), whatever their number; what passes by chance is dropped by the join

# A tag on one line, or of attributes on any number of lines; a comment (if any ends); the target of a link.
_ATTRIBUTE = r"""\s++[\w:@.-]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'=<>`]++))?+"""
_TAG = re.compile(rf"</?[A-Za-z](?:[^<>\n]*+>|[\w:.-]*+(?:{_ATTRIBUTE})*+\s*+/?>)|\]\([^()\s]*+\)")
_COMMENT = re.compile(r"<!--.*?-->", re.S)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]{2,8});")
_WORD = re.compile(r"[^\W_]+")
WINDOWS = "id bigint, at int, words string, seeds array<bigint>"


def words_of(text: str | None) -> list[str]:
    """The words of a text as a reader sees them; null and wordless texts have none."""
    if not text:
        return []
    if (end := text.rfind("-->") + 3) > 3:
        text = _COMMENT.sub(" ", text[:end]) + text[end:]
    if "<" in text or "](" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = _ENTITY.sub(lambda m: unescape(m[0]), text)
    return _WORD.findall((same_form(text) or "").casefold())


def _numbers(words: list[str], known: dict[str, int]) -> list[int]:
    out = []
    for w in words:
        n = known.get(w)
        if n is None:
            if len(known) > 400_000:
                known.clear()
            n = known[w] = xxhash.xxh64_intdigest(w)
        out.append(n)
    return out


def _seeds_of(numbers: np.ndarray) -> list[np.ndarray]:
    """Per mask the seed at each window; numbers has one value per word."""
    n = len(numbers) - SPAN + 1
    factors = np.random.default_rng(12).integers(1, 2**63, SPAN, dtype=np.uint64) | np.uint64(1)
    parts = [numbers[i : i + n] * factors[i] for i in range(SPAN)]
    out = []
    for k, mask in enumerate(MASKS):
        total = np.full(n, np.uint64(0x9E3779B97F4A7C15 + k), dtype=np.uint64)
        for i in range(SPAN):
            if mask[i] == "1":
                total += parts[i]
        out.append((total ^ (total >> np.uint64(29))).view(np.int64))
    return out


def _bits(seed: Column) -> Column:
    """The two bits of a seed in the filter."""
    low = F.lit((1 << FILTER_BITS) - 1)
    return F.array(seed.bitwiseAND(low), F.shiftrightunsigned(seed, 32).bitwiseAND(low))


def seed_filter(tests: DataFrame) -> np.ndarray:
    """Bits of the seeds of a table (column seed): at most 2^FILTER_BITS / 64 numbers come to the driver, whatever the seeds."""
    bits = tests.select(F.explode(_bits(F.col("seed"))).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("word")).toPandas()
    out = np.zeros(1 << FILTER_BITS - 6, dtype=np.int64)
    out[words["at"].to_numpy(dtype=np.int64)] = words["word"].to_numpy(dtype=np.int64)
    return out


def _among(bits: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The positions of the seeds that may be in the filter."""
    low = np.uint64(64 * len(bits) - 1)
    at = np.arange(len(s))
    for shift in (np.uint64(0), np.uint64(32)):
        bit = (s.view(np.uint64)[at] >> shift) & low
        at = at[(bits.view(np.uint64)[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1]
    return at


def windows(texts: DataFrame, key: str, only: np.ndarray | None = None) -> DataFrame:
    """id, at, words, seeds (of all masks) for every window; with ``only`` (a filter), just the seeds that pass it and the windows that have any."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(only) if only is not None else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        bits = shared.value if shared is not None else None
        for b in batches:
            for lo in range(0, len(b), 256):
                ids, all_words, numbers, starts = b["id"].iloc[lo : lo + 256].to_numpy(), [], [], [0]
                for t in b["text"].iloc[lo : lo + 256]:
                    w = words_of(t)
                    all_words += w
                    numbers += _numbers(w, known)
                    starts.append(len(all_words))
                if len(numbers) < SPAN:
                    continue
                ends = np.repeat(starts[1:], np.diff(starts))[: len(numbers) - SPAN + 1]
                whole = np.arange(len(ends)) + SPAN <= ends
                where, found = [], []
                for s in _seeds_of(np.array(numbers, dtype=np.uint64)):
                    at = _among(bits, s) if bits is not None else np.arange(len(s))
                    at = at[whole[at]]
                    where.append(at)
                    found.append(s[at])
                at = np.concatenate(where)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, first = np.unique(at[order], return_index=True)
                doc = np.searchsorted(starts, at, side="right") - 1
                yield pd.DataFrame(
                    {
                        "id": ids[doc],
                        "at": (at - np.array(starts)[doc]).astype("int32"),
                        "words": [" ".join(all_words[i : i + SPAN]) for i in at],
                        "seeds": np.split(np.concatenate(found)[order], first[1:]),
                    }
                )

    whole = texts.where(F.col(key).isNotNull() & F.col("text").isNotNull()).select(F.col(key).cast("bigint").alias("id"), "text")
    return in_batches(spread(whole), run, WINDOWS)


def hits(documents: DataFrame, benchmark: DataFrame, tolerated: int = TOLERATED) -> DataFrame:
    """doc_id, item_id, doc_at, item_at, equal: all windows of documents and items that differ in ``tolerated`` words (TOLERATED at most) or fewer, and how many agree.

    Null texts and ids are no cases; repeated rows count once.  Texts of fewer than SPAN words have no window.
    Seeds of distinct windows are joined, so a passage costs the same however many texts hold it.
    """
    if not 0 <= tolerated <= TOLERATED:
        raise ValueError(f"tolerated must be from 0 to {TOLERATED}")
    tests = cut_lineage(windows(benchmark, "item_id"))
    corpus = cut_lineage(windows(documents, "doc_id", seed_filter(tests.select(F.explode("seeds").alias("seed")))))
    seen, sought = (w.groupBy("words").agg(F.first("seeds").alias("seeds")).select(F.col("words").alias(name), F.explode("seeds").alias("seed")) for w, name in ((corpus, "doc_words"), (tests, "item_words")))
    agree = F.size(F.filter(F.zip_with(F.split("doc_words", " "), F.split("item_words", " "), lambda x, y: x == y), lambda e: e))
    pairs = seen.join(sought, "seed").select("doc_words", "item_words").distinct().withColumn("equal", agree).where(F.col("equal") >= SPAN - tolerated)
    ours = corpus.select(F.col("id").alias("doc_id"), F.col("at").alias("doc_at"), F.col("words").alias("doc_words"))
    theirs = tests.select(F.col("id").alias("item_id"), F.col("at").alias("item_at"), F.col("words").alias("item_words"))
    return pairs.join(theirs, "item_words").join(ours, "doc_words").select("doc_id", "item_id", "doc_at", "item_at", "equal").distinct()


def leaked(found: DataFrame) -> DataFrame:
    """doc_id, item_id where SPAN consecutive words agree."""
    return found.where(F.col("equal") == SPAN).select("doc_id", "item_id").distinct()


def overlaps(found: DataFrame) -> DataFrame:
    """Per document and item: windows met, the best agreement, and the stretch of the document they cover (in words)."""
    return found.groupBy("doc_id", "item_id").agg(
        F.countDistinct("doc_at").alias("windows"),
        F.max("equal").alias("best_equal"),
        F.min("doc_at").alias("from_word"),
        (F.max("doc_at") + SPAN).cast("int").alias("to_word"),
    )
