"""Queries of the training-text problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section contents and table markdowns that hold markup."""
    from .markup import marked_parts

    return marked_parts(_read(spark, sf_dir, "pipeline_output", "output_id", "sections", "tables"))


def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts as clean text with the number of marks taken out."""
    from .markup import cleaned_parts

    return cleaned_parts(_read(spark, sf_dir, "pipeline_output", "output_id", "sections", "tables"))


def _oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import oversized

    return oversized(_read(spark, sf_dir, "chunk_data", "chunk_id", "content", "start_line", "end_line"), _read(spark, sf_dir, "pipeline_output", "output_id", "sections"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and sections over their limit: those that come out in more than one piece."""
    from .pieces import pieces

    cut = pieces(_oversized(spark, sf_dir), texts=False).where("piece_no = 1")
    return cut.select("item_kind", "item_id", "item_pos").distinct()


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces with their byte and line ranges."""
    from .pieces import pieces

    return pieces(_oversized(spark, sf_dir)).distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and sections with faults of scanning."""
    from .scans import faulty_parts

    return faulty_parts(_read(spark, sf_dir, "pipeline_output", "output_id", "title", "sections"))


def p4_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All titles and sections as continuous paragraphs."""
    from .scans import repaired_parts

    return repaired_parts(_read(spark, sf_dir, "pipeline_output", "output_id", "title", "sections"))


def _not_handwritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .provenance import not_handwritten

    files = _read(spark, sf_dir, "file_metadata", "source_id", "filename", "file_type", "size_bytes", "line_count", "processed_at")
    return not_handwritten(files, _read(spark, sf_dir, "chunk_data", "source_id", "filename", "content", "start_line", "metadata"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and configuration files nobody wrote by hand."""
    return _not_handwritten(spark, sf_dir).select("source_id", "filename")


def p6_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files with what they are."""
    return _not_handwritten(spark, sf_dir)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on which a literal credential begins."""
    from .credentials import credential_lines

    return credential_lines(_read(spark, sf_dir, "chunk_data", "chunk_id", "content"))


def p7_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks with their secret values blanked, offsets unchanged."""
    from .credentials import redact_chunks

    return redact_chunks(_read(spark, sf_dir, "chunk_data", "chunk_id", "source_id", "filename", "content"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    from .encode import token_ids

    return token_ids(_read(spark, sf_dir, "documents", "doc_id", "text"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the test items that leaked into them."""
    from .leaks import leaks

    return leaks(_read(spark, sf_dir, "documents", "doc_id", "text"), _read(spark, sf_dir, "eval_items", "item_id", "text"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents that look the same and differ as strings."""
    from .lookalikes import same_looks

    return same_looks(_read(spark, sf_dir, "documents", "doc_id", "text"))


def p10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents, one row each, with the class of their look."""
    from .lookalikes import look_classes

    return look_classes(_read(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p1_clean": p1_clean, "p2_found": p2_found, "p2_pieces": p2_pieces, "p4_found": p4_found, "p4_repaired": p4_repaired, "p6_found": p6_found, "p6_kinds": p6_kinds, "p7_found": p7_found, "p7_redacted": p7_redacted, "p8_ids": p8_ids, "p9_found": p9_found, "p10_found": p10_found, "p10_classes": p10_classes}
SQL: dict[str, str] = {
    "p2_found": """
SELECT DISTINCT 'chunk' AS item_kind, chunk_id AS item_id, CAST(0 AS INTEGER) AS item_pos FROM chunk_data WHERE strlen(content) > 1500
UNION SELECT DISTINCT 'section', CAST(output_id AS VARCHAR), CAST(pos - 1 AS INTEGER)
FROM (SELECT output_id, sections, unnest(range(1, len(sections) + 1)) AS pos FROM pipeline_output) WHERE strlen(sections[pos].content) > 3000""",
    "p9_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 11], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 10)) AS i FROM d WHERE len(w) >= 12)),
es AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 11], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 10)) AS i FROM e WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM ds JOIN es USING (g)""",
}
