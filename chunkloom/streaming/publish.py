"""Chunk messages out: one JSON line each, with a place for what can't be sent."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.events import MAX_MESSAGE, chunk_events, too_large

#: Topic of the messages, attempts to send a batch, and seconds before the second one, doubled before each further one.
TOPIC, ATTEMPTS, BACK_OFF = "chunks.raw", 3, 0.5


def dead_letters_of(messages: DataFrame, error: str, topic: str = TOPIC) -> DataFrame:
    """(value): an envelope for each message that couldn't be sent, with topic, time in milliseconds, error and event."""
    now = F.unix_millis(F.current_timestamp())
    return messages.select(F.to_json(F.struct(F.lit(topic).alias("failedTopic"), now.alias("failedAt"), F.lit(error).alias("error"), F.col("value").alias("event"))).alias("value"))


def sent(messages: DataFrame, send: Callable[[DataFrame], None], attempts: int = ATTEMPTS, back_off: float = BACK_OFF) -> Exception | None:
    """Send messages, again after a growing wait if that fails; the last error, or none."""
    problem = None
    for attempt in range(attempts):
        try:
            send(messages)
            return None
        except Exception as error:  # noqa: BLE001  any failure of a transport is tried again
            problem = error
            if attempt < attempts - 1:
                time.sleep(back_off * 2**attempt)
    return problem


def publish_chunks(chunks: DataFrame, folder: str, checkpoint: str, dead_letters: str, max_bytes: int = MAX_MESSAGE, send: Callable[[DataFrame, int], None] | None = None, back_off: float = BACK_OFF) -> StreamingQuery:
    """Write the messages of the dirty chunks of a stream below ``folder``, a folder per batch, so that a repeated batch replaces itself.

    ``send`` stands for another transport. A batch that fails is tried ``ATTEMPTS``
    times; then its messages go to ``dead_letters`` in an envelope with the error, and the
    stream fails, so that the batch is sent again at its restart. Messages of
    ``max_bytes`` or more can't be sent by any transport and only go there.
    """

    def to_folder(messages: DataFrame, number: int) -> None:
        messages.select("value").write.mode("overwrite").text(f"{folder}/batch={number}")

    def one(batch: DataFrame, number: int) -> None:
        messages = chunk_events(batch).persist()
        over = too_large(F.col("value"), max_bytes)
        dead_letters_of(messages.where(over), "message too large").write.mode("overwrite").text(f"{dead_letters}/batch={number}")
        problem = sent(messages.where(~over), lambda m: (send or to_folder)(m, number), back_off=back_off)
        if problem is not None:
            dead_letters_of(messages.where(~over), str(problem)[:1000]).write.mode("overwrite").text(f"{dead_letters}/failed={number}")
        messages.unpersist()
        if problem is not None:
            raise problem

    return chunks.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
