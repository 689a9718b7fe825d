"""Differences between a stored snapshot and a new one, and the tables after them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def diff_by_key(old: DataFrame, new: DataFrame, key: str = "chunk_key", digest: str = "chunk_hash") -> DataFrame:
    """(key, state): clean, dirty, added or removed, by key and content hash.

    ``old`` has no tombstones taken out: a key that was removed and is back is dirty
    or clean by its hash. Keys are unique on both sides. One shuffle for each side.
    """
    a = old.select(F.col(key).alias("k"), F.lower(digest).alias("before"), F.lit(True).alias("was"))
    b = new.select(F.col(key).alias("k"), F.lower(digest).alias("after"), F.lit(True).alias("is"))
    state = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("before").eqNullSafe(F.col("after")), "clean").otherwise("dirty")
    return a.join(b, "k", "full_outer").select(F.col("k").alias(key), state.alias("state"))


def diff_by_hash(old: DataFrame, new: DataFrame, within: Sequence[str] = ("source_id", "filename"), digest: str = "chunk_hash", order: str = "chunk_key") -> DataFrame:
    """(within..., hash, old_key, new_key, state) by content alone; moved chunks stay unchanged.

    Equal hashes of a file are numbered on both sides and matched by number, so two
    copies against one leave exactly one over. Tombstones in ``old`` don't count.
    """

    def numbered(df: DataFrame, name: str) -> DataFrame:
        h = F.lower(digest)
        own = Window.partitionBy(*within, "hash").orderBy(order)
        return df.select(*within, h.alias("hash"), order).withColumn("n", F.row_number().over(own)).withColumnRenamed(order, name)

    living = old.where(~F.coalesce("tombstone", F.lit(False))) if "tombstone" in old.columns else old
    both = numbered(living, "old_key").join(numbered(new, "new_key"), [*within, "hash", "n"], "full_outer")
    state = F.when(F.col("old_key").isNull(), "new").when(F.col("new_key").isNull(), "deleted").otherwise("unchanged")
    return both.select(*within, "hash", "old_key", "new_key", state.alias("state"))


def upsert(stored: DataFrame, incoming: DataFrame, key: Sequence[str], kept: Sequence[str] = (), fill: Sequence[str] = ()) -> DataFrame:
    """``stored`` after merging ``incoming`` by ``key``: incoming values win.

    Columns in ``kept`` keep the stored value of a row that exists; columns in
    ``fill`` take the incoming value only where it isn't null. Keys are compared
    null-safely; each side has one row per key.
    """
    columns = stored.columns
    a = stored.select(*[F.col(c).alias(f"a_{c}") for c in columns], F.lit(True).alias("a_is"))
    b = incoming.select(*[F.col(c).alias(f"b_{c}") for c in columns], F.lit(True).alias("b_is"))
    on = F.lit(True)
    for k in key:
        on = on & F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}"))

    def value(c: str):  # noqa: ANN202
        old, new = F.col(f"a_{c}"), F.col(f"b_{c}")
        chosen = F.coalesce(new, old) if c in fill else new
        return F.when(F.col("b_is").isNull(), old).when(F.col("a_is").isNull(), new).otherwise(old if c in kept or c in key else chosen).alias(c)

    return a.join(b, on, "full_outer").select(*[value(c) for c in columns])


def newest(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One whole row per key, the greatest by ``order``, then by all its columns; an aggregate, not a window."""
    rest = [c for c in rows.columns if c not in order and dict(rows.dtypes)[c].split("<")[0] != "map"]
    maps = [c for c in rows.columns if dict(rows.dtypes)[c].split("<")[0] == "map"]
    top = F.max_by(F.struct(*[F.col(c) for c in rows.columns]), F.struct(*[F.col(c) for c in [*order, *rest]])) if maps else F.max(F.struct(*[F.col(c) for c in [*order, *rest]]))
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(top.alias("r")).select(*[F.col(f"r.{c}").alias(c) for c in rows.columns])


def tombstoned(stored: DataFrame, keys: DataFrame, key: str = "chunk_key") -> DataFrame:
    """``stored`` with tombstone set on the rows whose key is in ``keys``."""
    gone = keys.select(F.col(key)).distinct().withColumn("_gone", F.lit(True))
    joined = stored.join(gone, key, "left")
    return joined.withColumn("tombstone", F.coalesce("_gone", "tombstone", F.lit(False))).select(*stored.columns)


def replaced(stored: DataFrame, new: DataFrame, removed: DataFrame, id_column: str = "id", key: str = "chunk_key") -> DataFrame:
    """The table after tombstoning ``removed`` keys and upserting ``new`` rows by id, as one plan to be written as one version."""
    return upsert(tombstoned(stored, removed, key), new, [id_column])
