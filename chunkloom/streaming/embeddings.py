"""Embedding messages as a stream: applied to a node table, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.events import embedding_rows, with_embeddings
from ..sources.store import BucketedTable, VersionedTable


def message_stream(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """Lines of text files in ``folder`` as a stream of messages in the column ``value``."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", per_trigger).load(folder)


def apply_embeddings(messages: DataFrame, nodes: VersionedTable | BucketedTable, checkpoint: str, dead_letters: str | None = None) -> StreamingQuery:
    """Merge every micro-batch into ``nodes``; a batch that is repeated after a failure gives the same version again.

    Of a table in buckets only those are rewritten that hold a node of the batch.
    Messages whose node isn't there yet are skipped. Unreadable ones go to a folder per
    batch in ``dead_letters`` if it is named, where a repeated batch replaces itself.
    """

    def merge(batch: DataFrame, number: int) -> None:
        batch.persist()
        rows = embedding_rows(batch)
        if isinstance(nodes, BucketedTable):
            nodes.update(rows, with_embeddings, tag=f"batch-{number}")
        else:
            nodes.write(with_embeddings(nodes.read(), rows), tag=f"batch-{number}")
        if dead_letters:
            read = "from_json(value, 'chunks array<struct<id:string>>')"
            batch.where(f"{read} IS NULL OR {read}.chunks IS NULL").write.mode("overwrite").text(f"{dead_letters}/batch={number}")
        batch.unpersist()

    return messages.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
