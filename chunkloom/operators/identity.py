"""Deterministic identity of chunks and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import composite_id
from ..functions.text import NAMESPACE_OID, NAMESPACE_URL, uuid5

#: Name of the edge name space. Ids of edges are those of another service if its name is given instead.
EDGE_SPACE = "chunk_relationship"


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def file_space(source: Column, path: Column) -> Column:
    return uuid5(NAMESPACE_URL, composite_id(source, path))


def span_id(source: Column, path: Column, start: Column, end: Column) -> Column:
    """Id of the chunk that covers ``start`` to ``end`` of a file."""
    return uuid5(file_space(source, path), F.concat_ws("-", start.cast("string"), end.cast("string")))


def signature_id(source: Column, path: Column, signature: Column, content: Column) -> Column:
    """Id that follows a signature and its content wherever they stand in a file."""
    return uuid5(file_space(source, path), F.concat_ws("|", signature, content_hash(content)))


def edge_id(src: Column, dst: Column, kind: Column, space: str = EDGE_SPACE) -> Column:
    """Id of an edge by its ends and type, in the name space called ``space``."""
    return uuid5(uuid5(NAMESPACE_OID, F.lit(space)), F.concat_ws("_", src, dst, kind))


def identified(chunks: DataFrame, source: str = "source_id", path: str = "filename") -> DataFrame:
    """Chunks (…, ordinal, content, start, end) with hash, key, span id and an id of their own.

    Chunks that occur nowhere verbatim share the span 0; ``id`` is made of ordinal
    and hash instead, so it is unique in a file.
    """
    s, p = F.col(source), F.col(path)
    hashed = chunks.withColumn("chunk_hash", content_hash(F.col("content")))
    return hashed.select(
        "*",
        composite_id(s, p, F.col("start").cast("string"), F.col("end").cast("string")).alias("chunk_key"),
        span_id(s, p, F.col("start"), F.col("end")).alias("span_id"),
        uuid5(file_space(s, p), F.concat_ws("-", F.col("ordinal").cast("string"), F.col("chunk_hash"))).alias("id"),
    )
