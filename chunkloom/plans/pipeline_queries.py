"""Queries of the two general training-data problems: repeated messages and incremental runs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import IntervalLog, pending_changes
from ..operators.once import exactly_once, repeated_deliveries
from ..session import shared_folder
from ..sources.tables import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every delivery except the one kept of its message."""
    events = table(spark, sf_dir, "chunk_events", ["delivery_id", "received_at", "event_id", "metadata"])
    return repeated_deliveries(events).select("delivery_id")


def p3_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept deliveries by topic."""
    kept = exactly_once(table(spark, sf_dir, "chunk_events", ["delivery_id", "received_at", "event_id", "metadata", "topic"]))
    return kept.groupBy("topic").agg(F.count("*").alias("messages"))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshot = table(spark, sf_dir, "chunk_snapshot", ["chunk_key", "chunk_hash", "tombstone", "last_indexed_at"])
    ledger = table(spark, sf_dir, "run_ledger", ["run_id", "chunk_key", "chunk_hash", "tombstone", "recorded_at"])
    return pending_changes(snapshot, table(spark, sf_dir, "index_runs", ["run_id", "status"]), ledger)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys added, changed or removed since their last recorded success."""
    return _changes(spark, sf_dir).select("chunk_key")


def p5_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of keys by kind of change."""
    return _changes(spark, sf_dir).groupBy("change").agg(F.count("*").alias("keys"))


def p5_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals of each source as two runs of an interval log commit them: first what arrived in even hours, then everything.

    A version's number is its time of arrival in microseconds, so the first run leaves
    gaps between the intervals of a source and the second one processes those alone.
    """
    rows = table(spark, sf_dir, "chunk_snapshot", ["id", "source_id", "created_at"]).where("source_id IS NOT NULL AND created_at IS NOT NULL").distinct()
    feed = rows.select("id", "source_id", "created_at", F.unix_micros(F.col("created_at").cast("timestamp")).alias("arrived"))
    log = IntervalLog(spark, f"{shared_folder(spark)}/commits-{uuid.uuid4().hex}")
    log.run(feed.where(F.hour("created_at") % 2 == 0), ["source_id"], "arrived", lambda new: new.select("id", "source_id"))
    log.run(feed, ["source_id"], "arrived", lambda new: new.select("id", "source_id"))
    return log.output().groupBy("source_id", "run").agg(F.count("*").alias("versions"))


P3_SQL = """
WITH RECURSIVE d AS (
  SELECT delivery_id, received_at,
    replace(replace(replace(replace(lower(trim(event_id)), 'urn:uuid:', ''), '{', ''), '}', ''), '-', '') AS own,
    CASE WHEN coalesce(metadata.retry_count, 0) > 0 THEN
      replace(replace(replace(replace(lower(trim(metadata.original_event_id)), 'urn:uuid:', ''), '{', ''), '}', ''), '-', '') END AS named
  FROM chunk_events),
e AS (SELECT DISTINCT own AS a, named AS b FROM d WHERE own <> named UNION SELECT DISTINCT named, own FROM d WHERE own <> named),
r(node, root) AS (SELECT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node),
m AS (SELECT d.*, coalesce(c.root, d.own, d.named) AS message FROM d LEFT JOIN c ON c.node = coalesce(d.own, d.named)),
k AS (SELECT *, row_number() OVER (PARTITION BY message ORDER BY received_at, delivery_id) AS rn FROM m WHERE message IS NOT NULL)
"""

P5_SQL = """
WITH v AS (
  SELECT chunk_key, lower(chunk_hash) AS hash, tombstone,
    row_number() OVER (PARTITION BY chunk_key ORDER BY last_indexed_at DESC) AS rn FROM chunk_snapshot),
l AS (
  SELECT chunk_key, lower(chunk_hash) AS hash, tombstone,
    row_number() OVER (PARTITION BY chunk_key ORDER BY run_id DESC) AS rn
  FROM run_ledger WHERE run_id IN (SELECT run_id FROM index_runs WHERE status = 'succeeded')),
j AS (
  SELECT v.chunk_key, v.hash, v.tombstone, l.hash AS lhash, l.tombstone AS ltomb, l.chunk_key IS NULL AS fresh
  FROM v LEFT JOIN l ON l.chunk_key = v.chunk_key AND l.rn = 1 WHERE v.rn = 1),
f AS (
  SELECT chunk_key, CASE WHEN tombstone THEN 'removed' WHEN fresh OR ltomb THEN 'added' ELSE 'changed' END AS change FROM j
  WHERE ((fresh OR ltomb) AND NOT tombstone) OR (NOT fresh AND NOT ltomb AND (tombstone OR hash <> lhash)))
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p3_found": p3_found, "p3_kept": p3_kept, "p5_found": p5_found, "p5_changes": p5_changes, "p5_commits": p5_commits,
}

SQL: dict[str, str] = {
    "p3_found": P3_SQL + "SELECT delivery_id FROM k WHERE rn > 1",
    "p3_kept": P3_SQL + ", x AS (SELECT delivery_id FROM k WHERE rn > 1) SELECT topic, count(*) AS messages FROM chunk_events WHERE delivery_id NOT IN (SELECT delivery_id FROM x) GROUP BY topic",
    "p5_found": P5_SQL + "SELECT chunk_key FROM f",
    "p5_commits": """
WITH s AS (SELECT DISTINCT id, source_id, created_at FROM chunk_snapshot WHERE source_id IS NOT NULL AND created_at IS NOT NULL),
e AS (SELECT DISTINCT source_id, created_at FROM s WHERE hour(created_at) % 2 = 0)
SELECT s.source_id, CAST(CASE WHEN e.source_id IS NULL THEN 1 ELSE 0 END AS INTEGER) AS run, count(*) AS versions FROM s LEFT JOIN e ON e.source_id = s.source_id AND e.created_at = s.created_at GROUP BY ALL""",
    "p5_changes": P5_SQL + "SELECT change, count(*) AS keys FROM f GROUP BY change",
}
