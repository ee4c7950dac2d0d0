"""Extraction from source text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.base import NOW, Registry, Tables
from graphloom.sources import extract
from graphloom.sources.repository import slice_lines

R = Registry()


@R.query()
def extracted_nodes(t: Tables) -> DataFrame:
    return extract.nodes_of(extract.extract(t.file_content))


@R.query()
def extracted_edges(t: Tables) -> DataFrame:
    return extract.edges_of(extract.extract(t.file_content))


@R.query()
def extracted_references(t: Tables) -> DataFrame:
    return extract.references_of(extract.extract(t.file_content)).select("ref_id", "from_node_id", "reference_name", "reference_kind", "line", "col", "file_path", "language")


@R.query(
    f"""WITH {NOW}, s AS (SELECT n.id, greatest(start_line, 1) AS a, end_line AS b, c.content FROM now n JOIN file_content c ON c.path = n.file_path WHERE n.kind IN ('function', 'method') AND start_line IS NOT NULL AND end_line IS NOT NULL AND c.content IS NOT NULL)
SELECT id, array_to_string(list_slice(string_split(content, chr(10)), a, b), chr(10)) AS code FROM s"""
)
def node_code(t: Tables) -> DataFrame:
    n = t.now.where("kind in ('function', 'method') and start_line is not null and end_line is not null").select("id", "start_line", "end_line", "file_path")
    joined = n.join(t.file_content.where("content is not null").withColumnRenamed("path", "file_path"), "file_path")
    return joined.select("id", slice_lines(F.col("content"), F.col("start_line"), F.col("end_line")).alias("code"))
