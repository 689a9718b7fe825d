"""Event contracts: validation, building and reading of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of content in a chunk event, of an event that is small, and of a message that can be sent at all.
MAX_CONTENT, MAX_EVENT, MAX_MESSAGE = 50 * 1024, 10 * 1024, 10 * 1024 * 1024


def _empty(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def _commit(c: str) -> list[tuple[Column, str]]:
    value = F.coalesce(F.col(c), F.lit(""))
    return [(F.octet_length(value) != 40, f"{c} must be 40 characters (SHA-1)"), (~value.rlike("^[0-9A-Fa-f]*$"), f"{c} must be hexadecimal")]


def _rules(kind: str) -> list[tuple[Column, str]]:
    """(is broken, message) of an event type, in the order in which they are tried. The texts of the messages."""
    none = lambda c: (_empty(c), f"{c} cannot be empty")
    provider = (~F.coalesce(F.col("provider"), F.lit("")).isin("github", "gitlab", "bitbucket"), "unknown provider")
    line = lambda c: (F.coalesce(F.col(c), F.lit(0)) == 0, f"{c} must be positive (1-based)")
    return {
        "REPO_INGEST_REQUESTED": lambda: [none("url"), none("branch"), *_commit("commit_id"), none("credential_ref"), provider],
        "REPO_UPDATED": lambda: [none("url"), none("branch"), *_commit("old_commit"), *_commit("new_commit"), (F.col("old_commit") == F.col("new_commit"), "old_commit and new_commit must be distinct"), none("credential_ref"), provider],
        "CODE_CHUNK_CREATED": lambda: [
            none("file_path"), none("language"), none("content"), (F.octet_length("content") > MAX_CONTENT, "content exceeds 50KB limit"), line("start_line"), line("end_line"),
            (F.col("start_line") > F.col("end_line"), "start_line cannot be greater than end_line"), *_commit("commit_id"), (F.col("chunk_index") >= F.col("total_chunks"), "chunk_index must be less than total_chunks"),
        ],
        "EMBEDDING_CREATED": lambda: [
            (F.coalesce(F.size("embedding"), F.lit(0)) <= 0, "embedding cannot be empty"),
            (F.size("embedding") != F.col("dimension"), F.concat(F.lit("embedding length ("), F.size("embedding").cast("string"), F.lit(") does not match dimension ("), F.col("dimension").cast("string"), F.lit(")"))),
            none("model"), none("model_version"), (F.col("dimension") == 0, "dimension must be positive"),
        ],
        "INGEST_FAILED": lambda: [none("error_message")],
        "INGEST_COMPLETED": lambda: _commit("commit_id"),
    }[kind]()


def violation(kind: str) -> Column:
    """Message of the first broken rule of an event of that type; null for a valid one. Null fields read as empty or 0."""
    return F.coalesce(*[F.when(bad, F.lit(m) if isinstance(m, str) else m) for bad, m in _rules(kind)])


def too_large(event: Column, limit: int = MAX_EVENT) -> Column:
    """Whether an event has ``limit`` bytes or more."""
    return F.octet_length(event) >= limit


def chunk_events(chunks: DataFrame, service: str = "chunkloom") -> DataFrame:
    """(key, value): one JSON message for each dirty chunk (id, source_id, file_id, chunk_type, content, language, start_line, end_line, user_id)."""
    one = F.struct("id", "file_id", "chunk_type", "content", "language", "start_line", "end_line")
    headers = F.struct(F.col("id").alias("event_id"), F.lit("CHUNK_RAW").alias("event_type"), F.lit(service).alias("source_service"), F.col("source_id").alias("correlation_id"))
    body = F.struct(headers.alias("headers"), F.struct(F.lit(0).alias("retry_count"), "user_id").alias("metadata"), "source_id", F.array(one).alias("chunks"))
    return chunks.where(F.coalesce("is_dirty", F.lit(True))).select(F.col("id").alias("key"), F.to_json(body).alias("value"))


#: Schema of an embedding message.
EMBEDDING_EVENT = (
    "headers struct<event_id:string,correlation_id:string>, metadata struct<retry_count:int,user_id:string>, source_id string, repo_name string, "
    "chunks array<struct<id:string,file_id:string,embedding:array<float>,model:string,dimension:int>>, model string"
)


def embedding_rows(messages: DataFrame, value: str = "value") -> DataFrame:
    """(event_id, correlation_id, user_id, source_id, pos, id, embedding, model) of the readable messages without a repo_name.

    A message that can't be read is left out, as is one that names a repository; a
    user that isn't named is 'system'; the correlation is the event where it is missing.
    """
    read = messages.select(F.from_json(value, EMBEDDING_EVENT).alias("e")).where("e IS NOT NULL AND e.chunks IS NOT NULL AND e.repo_name IS NULL")
    rows = read.select("e", F.posexplode("e.chunks").alias("pos", "c"))
    return rows.select(
        F.col("e.headers.event_id").alias("event_id"), F.coalesce("e.headers.correlation_id", "e.headers.event_id").alias("correlation_id"), F.coalesce("e.metadata.user_id", F.lit("system")).alias("user_id"),
        F.col("e.source_id").alias("source_id"), "pos", F.col("c.id").alias("id"), F.col("c.embedding").alias("embedding"), F.coalesce("c.model", "e.model").alias("model"),
    )


def with_embeddings(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Nodes with the embeddings of ``rows`` set on those that exist; unknown ids are skipped, of several the last (event_id, pos) holds, an empty one changes nothing."""
    last = rows.where(F.size("embedding") > 0).groupBy("id").agg(F.max(F.struct("event_id", "pos", "embedding", "model")).alias("r")).select("id", F.col("r.embedding").alias("_e"), F.col("r.model").alias("_m"))
    joined = nodes.join(last, "id", "left")
    return joined.withColumn("embedding", F.coalesce("_e", "embedding")).withColumn("model", F.coalesce("_m", "model")).select(*nodes.columns)
