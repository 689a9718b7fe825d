"""Windowed counts over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_requests(requests: DataFrame, time: str, client: str, path: str, window: str = "1 minute", slide: str = "10 seconds", late: str = "2 minutes") -> DataFrame:
    """(client, path, start, requests): requests per sliding window, for streams and tables alike; later than ``late`` is dropped by a stream's watermark."""
    rows = requests.withWatermark(time, late) if requests.isStreaming else requests
    return rows.groupBy(F.window(time, window, slide).alias("w"), F.col(client).alias("client"), F.col(path).alias("path")).agg(F.count("*").alias("requests")).select("client", "path", F.col("w.start").alias("start"), "requests")


def first_deliveries(deliveries: DataFrame, event_id: str, time: str, late: str = "1 hour") -> DataFrame:
    """A stream's deliveries with each identifier once within the watermark; the state of an identifier goes after ``late``."""
    return deliveries.withWatermark(time, late).dropDuplicatesWithinWatermark([event_id])
