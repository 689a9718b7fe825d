"""Sliding-window rate limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rate_limited(requests: DataFrame, limit: int, window: int = 60, bucket: int = 3600) -> DataFrame:
    """Requests (client, path, epoch_s, seq) with count, allowed, remaining and reset.

    A request counts those of its client and path in the last ``window`` seconds,
    rejected ones and itself included; within a second ``seq`` is the order of
    arrival. Windows are partitioned by time bucket too, the last window of a bucket
    being repeated at the head of the next one, so that a client with a third of all
    requests is spread over its buckets. Null clients and paths are clients of their
    own; null times are left out.
    """
    rows = requests.where("epoch_s IS NOT NULL").select("client", "path", "epoch_s", "seq")
    home = F.floor(F.col("epoch_s") / bucket)
    buckets = F.when((F.col("epoch_s") + window - 1) >= (home + 1) * bucket, F.array(home, home + 1)).otherwise(F.array(home))
    rows = rows.withColumn("home", home).withColumn("bucket", F.explode(buckets))
    own = Window.partitionBy("client", "path", "bucket")
    reach = own.orderBy("epoch_s").rangeBetween(-(window - 1), 0)
    later = F.count("*").over(own.orderBy("epoch_s").rangeBetween(0, 0)) - F.row_number().over(Window.partitionBy("client", "path", "bucket", "epoch_s").orderBy("seq"))
    counted = rows.withColumn("count", F.count("*").over(reach) - later).where("bucket = home")
    return counted.select(
        "client", "path", "epoch_s", "seq", "count", (F.col("count") <= limit).alias("allowed"), F.greatest(F.lit(0), F.lit(limit) - F.col("count")).alias("remaining"), (F.col("epoch_s") + window).alias("reset")
    )
