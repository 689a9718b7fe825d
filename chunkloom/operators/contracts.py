"""Settings, extension points and record schemas of the engine."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ChunkingStrategy(Protocol):
    """A chunker: which kinds of content it takes, and files to chunks."""

    name: str

    def supports(self, kind: str) -> bool: ...

    def process(self, files: DataFrame) -> DataFrame: ...


class RelationExtractor(Protocol):
    """An extractor of relations between chunks of one kind of source."""

    source_type: str

    def extract(self, chunks: DataFrame) -> DataFrame: ...


class TextReader(Protocol):
    """A reader of documents that need software of their own (PDF, scanned pages): files to (title, sections, tables)."""

    def read(self, files: DataFrame) -> DataFrame: ...


def extract_all(chunks: DataFrame, extractors: list[RelationExtractor]) -> DataFrame:
    """The relations of every extractor, one after the other, repeats included."""
    first, *rest = [e.extract(chunks) for e in extractors]
    for edges in rest:
        first = first.unionByName(edges)
    return first


@dataclass(frozen=True)
class ChunkerConfig:
    """Sizes in bytes and thresholds of a chunker."""

    min_size: int = 100
    max_size: int = 1500
    overlap: int = 200
    confidence_threshold: float = 0.7
    workers: int = 4

    def problem(self) -> str | None:
        """The first rule that the settings break."""
        if self.max_size < self.min_size:
            return "max chunk size must be at least the min chunk size"
        if not 0.0 <= self.confidence_threshold <= 1.0:
            return "confidence threshold must lie between 0 and 1"
        if self.workers <= 0:
            return "number of workers must be positive"
        return None


def checked_user(user: str | None) -> str:
    """A user id for a store; raises ValueError for a missing or empty one."""
    if not user or not user.strip():
        raise ValueError("user_id must not be empty")
    return user


def of_user(rows: DataFrame, user: str, column: str = "user_id") -> DataFrame:
    """The rows of one tenant."""
    return rows.where(F.col(column) == checked_user(user))


def needs_enhancement(tier: Column, confidence: Column, complexity: Column) -> Column:
    """Structural chunks of low confidence or high complexity; null measures don't ask for it."""
    return (tier == "structural") & (F.coalesce(confidence < 0.7, F.lit(False)) | F.coalesce(complexity > 7, F.lit(False)))


def advanced(chunks: DataFrame, now: Column) -> DataFrame:
    """Chunks (tier, quality, enhanced_at) one tier on: structural with a quality to enhanced, enhanced to relationship."""
    tier = F.col("tier")
    up = F.when((tier == "structural") & F.col("quality").isNotNull(), "enhanced").when(tier == "enhanced", "relationship").otherwise(tier)
    return chunks.withColumns({"enhanced_at": F.when((tier == "structural") & F.col("quality").isNotNull(), now).otherwise(F.col("enhanced_at")), "tier": up})


def is_stale(sent: Column, now: Column, seconds: int = 300) -> Column:
    """Whether a request's time lies over ``seconds`` from now, before or after."""
    return F.abs(F.unix_seconds(now) - F.unix_seconds(sent)) > seconds


#: Schema of an episode.
EPISODE = (
    "id string, source_type string, source_id string, chunk_text string, chunk_type string, embedding array<float>, embedding_model string, embedding_dimension int, language string, content_path string, group_id string, "
    "start_timestamp string, end_timestamp string, metadata map<string,string>, provenance map<string,string>, pii_detected boolean, acl_tags array<string>"
)


def episode_json(episodes: DataFrame) -> DataFrame:
    """(id, value): episodes as JSON; missing fields are left out, the dimension is that of the embedding."""
    rows = episodes.withColumn("embedding_dimension", F.when(F.col("embedding").isNotNull(), F.size("embedding")))
    return rows.select("id", F.to_json(F.struct(*rows.columns)).alias("value"))


def episodes_of(messages: DataFrame, value: str = "value") -> DataFrame:
    """Episodes read back; kind 'raw', no personal data and no tags where a message doesn't say."""
    rows = messages.select(F.from_json(value, EPISODE).alias("e")).where("e.id IS NOT NULL").select("e.*")
    return rows.withColumns({"chunk_type": F.coalesce("chunk_type", F.lit("raw")), "pii_detected": F.coalesce("pii_detected", F.lit(False)), "acl_tags": F.coalesce("acl_tags", F.array().cast("array<string>"))})


# Payload fields of the extension events.
EXTENSION_EVENTS = {
    "SLACK_MESSAGE_RECEIVED": "workspace_id string, channel_id string, channel_name string, message_ts string, thread_ts string, user_id string, text_preview string, is_dm boolean, reaction_count int, source_id string, org_id string",
    "MEETING_TRANSCRIPT_RECEIVED": "meeting_id string, platform string, title string, started_at string, duration_secs bigint, participants array<string>, content_ref string, source_id string, org_id string",
    "API_SCHEMA_UPDATED": "api_id string, api_name string, schema_format string, schema_version string, content_ref string, base_url string, org_id string",
    "CHUNK_DEPRECATED": "chunk_ids array<string>, source_id string, file_path string, reason string, new_file_path string, replacement_chunk_ids array<string>, deprecated_at string",
    "ENTITY_MERGED": "source_entity_id string, target_entity_id string, merge_reason string, confidence float, detected_by string",
    "RELATIONSHIP_INFERRED": "from_entity_id string, to_entity_id string, relationship_type string, evidence_chunk_ids array<string>, confidence float, inference_method string",
    "DOCUMENT_UPDATED": "document_id string, title string, source_id string, content_ref string, updated_by string, source_updated_at string, content_hash string, org_id string",
}
# Fields of them that may be missing, and reasons of a deprecation.
OPTIONAL = ("thread_ts", "org_id", "duration_secs", "schema_version", "base_url", "new_file_path", "updated_by")
REASONS = ("file_deleted", "file_renamed", "content_replaced", "manual_deprecation", "source_removed")


def extension_rows(messages: DataFrame, kind: str, value: str = "value") -> DataFrame:
    """(event_id, correlation_id, payload fields...) of the messages of an extension event.

    A message is an event's base fields with a payload. Messages of another type,
    unreadable ones, such without an id or without a field that must be there, and
    deprecations for an unknown reason are left out.
    """
    fields = EXTENSION_EVENTS[kind]
    base = f"event_id string, event_type string, correlation_id string, payload struct<{', '.join(f.replace(' ', ': ', 1) for f in fields.split(', '))}>"
    rows = messages.select(F.from_json(value, base).alias("e")).where((F.col("e.event_type") == kind) & F.col("e.event_id").isNotNull())
    rows = rows.select("e.event_id", "e.correlation_id", "e.payload.*")
    for name in [f.split(" ", 1)[0] for f in fields.split(", ")]:
        if name not in OPTIONAL:
            rows = rows.where(F.col(name).isNotNull())
    return rows.where(F.col("reason").isin(*REASONS)) if kind == "CHUNK_DEPRECATED" else rows


def client_id(user: Column, forwarded_for: Column, real_ip: Column) -> Column:
    """Who a request counts for: its user, else the first address it was forwarded for, else its real address, else unknown."""
    first = F.trim(F.split_part(forwarded_for, F.lit(","), F.lit(1)))
    return F.coalesce(F.concat(F.lit("user:"), user), first, real_ip, F.lit("unknown"))


def requests_a_minute(path: Column) -> Column:
    """The limit of a path: searches, chunks and syncs have their own."""
    return F.when(path.contains("search"), 50).when(path.contains("chunks"), 100).when(path.contains("sync"), 20).otherwise(100)
