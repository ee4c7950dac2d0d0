"""Queries of the subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import docpairs, handwritten, leakage, packing, sameform, syntax
from graphloom.session import checkpoint_folder
from graphloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _tables(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    checkpoint_folder(spark)
    return [table(spark, folder, n) for n in names]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return docpairs.documented(*_tables(spark, folder, "nodes", "file_content"))


def p1_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return docpairs.function_pairs(*_tables(spark, folder, "nodes", "file_content"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return syntax.broken_files(syntax.check_files(*_tables(spark, folder, "files", "file_content")))


def p2_rates(spark: SparkSession, folder: str) -> DataFrame:
    return syntax.error_rates(syntax.check_files(*_tables(spark, folder, "files", "file_content")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_reasons(spark, folder).select("path")


def p4_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return handwritten.not_handwritten(*_tables(spark, folder, "files", "file_content"))


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    (documents,) = _tables(spark, folder, "documents")
    return packing.pack(packing.token_counts(documents))


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill(p6_containers(spark, folder))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked(leakage.hits(*_tables(spark, folder, "documents", "benchmark")))


def p7_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.overlaps(leakage.hits(*_tables(spark, folder, "documents", "benchmark")))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return sameform.equal_looking_pairs(*_tables(spark, folder, "documents"))


def p8_classes(spark: SparkSession, folder: str) -> DataFrame:
    return sameform.look_classes(*_tables(spark, folder, "documents"))


def p8_forms(spark: SparkSession, folder: str) -> DataFrame:
    (documents,) = _tables(spark, folder, "documents")
    return sameform.canonical_texts(documents.select("doc_id", "text")).select("doc_id", "form")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_pairs, p2_found, p2_rates, p4_found, p4_reasons, p6_containers, p6_fill, p7_found, p7_overlaps, p8_found, p8_classes, p8_forms)}


def oracle_sql() -> dict[str, str]:
    return {}
