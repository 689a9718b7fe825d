"""Incremental processing over disjoint intervals of processed sequence numbers.

An interval is a row (keys..., lo, hi), both ends included. Sets of intervals are
merged and subtracted by one sweep over their boundaries, a window per key, so the
cost is a sort of the boundaries and no pair of intervals is ever joined.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import small
from ..sources.shared import SharedFolder


def islands(rows: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """The runs of consecutive sequence numbers that ``rows`` holds; null numbers are left out, repeats count once."""
    rows = rows.where(F.col(seq).isNotNull()).select(*keys, F.col(seq).cast("bigint").alias("lo")).distinct()
    return merged(rows.withColumn("hi", F.col("lo")), keys)


#: Sequence numbers of a block, within which intervals are merged before whole keys are.
BLOCK = 1 << 16


def merged(intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same numbers as disjoint intervals that don't touch. Empty intervals (hi < lo) vanish.

    Intervals are merged twice, first within blocks of their first number, then by
    key. A key with a third of all numbers is so spread over its blocks, and what is
    left for one task is no more than an interval a block and the true gaps.
    """
    blocked = _merged(intervals.withColumn("_block", F.floor(F.col("lo") / BLOCK)), [*keys, "_block"])
    return _merged(blocked.drop("_block"), keys)


def _merged(intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    own = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = own.orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    marked = intervals.where("lo <= hi").select(*keys, "lo", "hi").withColumn("reach", F.max("hi").over(before))
    starts = (F.col("reach").isNull() | (F.col("lo") > F.col("reach") + 1)).cast("int")
    grouped = marked.withColumn("n", F.sum(starts).over(own.orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "n").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("n")


def subtract(available: DataFrame, processed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The numbers in ``available`` that aren't in ``processed``, as disjoint intervals per key.

    Every boundary becomes a row: +1 at lo, -1 after hi. Summed in order they tell
    on which stretches something is available and nothing processed.
    """

    def ends(df: DataFrame, a: int, p: int) -> DataFrame:
        two = F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("d")), F.struct((F.col("hi") + 1).alias("at"), F.lit(-1).alias("d")))
        return df.where("lo <= hi").select(*keys, F.explode(two).alias("e")).select(*keys, F.col("e.at").alias("at"), (F.col("e.d") * a).alias("a"), (F.col("e.d") * p).alias("p"))

    own = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("at")
    points = ends(available, 1, 0).unionByName(ends(processed, 0, 1)).groupBy(*keys, "at").agg(F.sum("a").alias("a"), F.sum("p").alias("p"))
    swept = points.select(*keys, F.col("at").alias("lo"), (F.lead("at").over(own) - 1).alias("hi"), F.sum("a").over(own).alias("a"), F.sum("p").over(own).alias("p"))
    return _merged(swept.where("a > 0 AND p = 0").select(*keys, "lo", "hi"), keys)


def pending_changes(snapshot: DataFrame, runs: DataFrame, ledger: DataFrame) -> DataFrame:
    """(chunk_key, change, lo, hi): the keys added, changed or removed since the last recorded success.

    The sequence number of a version is its last_indexed_at in microseconds. What
    a key has available reaches from its oldest to its newest version; what is
    processed are the numbers over which it had the state (hash in lower case,
    tombstone) of its record, the row of the greatest succeeded run. That leaves up to
    two gaps: one below, history that the record is newer than, and one above, which is
    the work. A late version below the processed end opens no work, a run that failed
    closes none. A gap that ends in a tombstone nobody recorded alive is no change.

    Null keys are left out; a version without a time counts as the oldest; a null
    tombstone reads as false; of two versions of one time the greatest state holds.
    Repeated rows count once by nature of the maxima. Of records of one run the latest
    recorded_at holds, then the greatest state. Versions and records are reduced by
    aggregates before they are shuffled, so a hot key is a row per task and state.
    """
    state = F.when(F.coalesce("tombstone", F.lit(False)), F.lit("-")).otherwise(F.coalesce(F.lower("chunk_hash"), F.lit("")))
    done = small(runs.where("status = 'succeeded'").select("run_id").distinct())
    record = (
        ledger.where("chunk_key IS NOT NULL").join(done, "run_id")
        .select("chunk_key", F.struct("run_id", "recorded_at", state.alias("state")).alias("record"))
        .groupBy("chunk_key").agg(F.max("record").alias("record")).select("chunk_key", F.col("record.state").alias("recorded"))
    )
    seq = F.coalesce(F.unix_micros(F.col("last_indexed_at").cast("timestamp")), F.lit(0))
    versions = snapshot.where("chunk_key IS NOT NULL").select("chunk_key", seq.alias("seq"), state.alias("state"))
    own = F.col("state") == F.col("recorded")
    ranges = (
        versions.groupBy("chunk_key", "state").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
        .join(record, "chunk_key", "left").groupBy("chunk_key")
        .agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max(F.struct("hi", "state")).alias("newest"), F.max("recorded").alias("recorded"),
            F.min(F.when(own, F.col("lo"))).alias("from"), F.max(F.when(own, F.col("hi"))).alias("to"),
        )
        # Of two versions of one time the newest's number is open where the other one is recorded.
        .withColumn("to", F.when((F.col("to") == F.col("hi")) & (F.col("newest.state") != F.col("recorded")), F.col("to") - 1).otherwise(F.col("to")))
    )
    processed = ranges.where("from <= to").select("chunk_key", F.col("from").alias("lo"), F.col("to").alias("hi"))
    gaps = subtract(ranges.select("chunk_key", "lo", "hi"), processed, ["chunk_key"]).withColumnRenamed("lo", "gap_lo").withColumnRenamed("hi", "gap_hi")
    alive = F.coalesce(F.col("recorded") != "-", F.lit(False))
    change = F.when(F.col("newest.state") == "-", "removed").when(alive, "changed").otherwise("added")
    work = gaps.join(ranges.select("chunk_key", "hi", "newest", "recorded"), "chunk_key").where(F.col("gap_hi") == F.col("hi")).where(alive | (F.col("newest.state") != "-"))
    return work.select("chunk_key", change.alias("change"), F.col("gap_lo").alias("lo"), F.col("gap_hi").alias("hi"))


#: Sequence numbers of a block, by which rows are matched to gaps.
GAP_BLOCK = 1 << 20


def within(rows: DataFrame, intervals: DataFrame, keys: Sequence[str], seq: str, block: int = GAP_BLOCK) -> DataFrame:
    """The rows whose number lies in one of the disjoint ``intervals`` of their key.

    Intervals become one row per block of numbers that they touch and rows are joined
    by key and block, so that neither side grows with the length of a gap.
    """
    touched = F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor(F.col("hi") / block)))
    gaps = intervals.where("lo <= hi").select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), touched.alias("_block"))
    on = (F.floor(F.col(seq) / block) == F.col("_block")) & F.col(seq).between(F.col("_lo"), F.col("_hi"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return rows.join(gaps, on, "left_semi")


class IntervalLog:
    """Output and processed intervals of a feed, committed together.

    A run writes its output into a folder of its own name, then one small manifest
    with the merged intervals, put into place by a rename that doesn't overwrite.
    Readers follow manifests only: a run that dies before the rename leaves nothing
    visible and its numbers stay gaps; one that dies after it is complete. ``root`` is
    a folder on a file system that driver and executors share.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        self.log = SharedFolder(spark, f"{root}/log")

    def _committed(self) -> list[str]:
        return [n for n in self.log.names() if n.endswith(".json")]

    def manifests(self) -> list[dict]:
        """What every run committed, in order."""
        return [json.loads(self.log.read(n)) for n in self._committed()]

    def processed(self, keys: Sequence[str], schema: str) -> DataFrame:
        """The intervals that the last manifest names; each holds those of all before."""
        last = self._committed()[-1:]
        return self.spark.read.schema(schema).parquet(json.loads(self.log.read(last[0]))["intervals"]) if last else self.spark.createDataFrame([], schema)

    def output(self) -> DataFrame | None:
        """The output of all runs, with the number of the run in the column ``run``."""
        frames = [self.spark.read.parquet(m["output"]).withColumn("run", F.lit(k)) for k, m in enumerate(self.manifests())]
        for more in frames[1:]:
            frames[0] = frames[0].unionByName(more, allowMissingColumns=True)
        return frames[0] if frames else None

    def run(self, feed: DataFrame, keys: Sequence[str], seq: str, work: Callable[[DataFrame], DataFrame]) -> int:
        """Process the rows of ``feed`` whose numbers lie in no processed interval; the number of those numbers.

        Rows without a number or key can't be recorded as processed and are left out.
        The gaps are found by a sweep, and rows are matched to them by key and block.
        """
        schema = ", ".join([f"`{k}` {dict(feed.dtypes)[k]}" for k in keys] + ["lo bigint", "hi bigint"])
        before = self.processed(keys, schema)
        name = f"{len(self._committed()):08d}"
        place = f"{name}-{uuid.uuid4().hex}"
        out, own, new = (f"{self.root}/{kind}/{place}" for kind in ("output", "intervals", "fresh"))
        subtract(islands(feed, keys, seq), before, keys).write.parquet(new)
        fresh = self.spark.read.schema(schema).parquet(new)
        work(within(feed.withColumn(seq, F.col(seq).cast("bigint")), fresh, keys, seq)).write.parquet(out)
        merged(before.unionByName(fresh), keys).write.parquet(own)
        count = fresh.agg(F.coalesce(F.sum(F.col("hi") - F.col("lo") + 1), F.lit(0))).first()[0]
        self.log.create(f"{name}.json", json.dumps({"output": out, "intervals": own, "new": count}))  # fails if another run committed first
        return count
