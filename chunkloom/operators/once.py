"""Exactly one copy of every message that was delivered at least once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .components import components

#: Bits of the permuted identifier that name its shard; the other 112 are its remainder.
QUOTIENT_BITS = 16


def spelling(identifier: Column) -> Column:
    """One spelling of an identifier: no blanks, case, braces, urn prefix or dashes of a UUID; blank gives null."""
    bare = F.regexp_replace(F.lower(F.trim(identifier)), r"^urn:uuid:|[{}]", "")
    tight = F.regexp_replace(bare, "-", "")
    return F.when(tight.rlike("^[0-9a-f]{32}$"), tight).otherwise(F.nullif(F.trim(identifier), F.lit("")))


def with_quotient_keys(df: DataFrame, identifiers: dict[str, Column]) -> DataFrame:
    """``df`` with a struct<q, r_high, r_low, r_text> per identifier, null for a null or blank one.

    128-bit identifiers run through a Feistel permutation of their two halves. A
    Feistel round is one to one whatever its round function is, so quotient plus
    remainder are the whole identifier and equal keys mean equal identifiers. The
    permutation spreads time-ordered or clustered identifiers evenly over the
    shards. Identifiers of any other form keep their text in the remainder. Each
    step is a projection of its own, so that no expression is evaluated twice.
    """
    kept = df.columns
    word = lambda n, at: F.conv(F.substring(f"_{n}", at, 8), 16, 10).cast("bigint")
    names = list(identifiers)
    df = df.select(*kept, *[spelling(c).alias(f"_{n}") for n, c in identifiers.items()])
    df = df.select("*", *[F.col(f"_{n}").rlike("^[0-9a-f]{32}$").alias(f"_{n}_fixed") for n in names])
    df = df.select(
        *kept, *[c for n in names for c in (
            F.col(f"_{n}").isNotNull().alias(f"_{n}_known"),
            F.when(~F.col(f"_{n}_fixed"), F.col(f"_{n}")).alias(f"_{n}_text"),
            F.when(F.col(f"_{n}_fixed"), F.shiftleft(word(n, 1), 32).bitwiseOR(word(n, 9))).otherwise(F.xxhash64(f"_{n}")).alias(f"_{n}_high"),
            F.when(F.col(f"_{n}_fixed"), F.shiftleft(word(n, 17), 32).bitwiseOR(word(n, 25))).otherwise(F.lit(0)).alias(f"_{n}_low"),
        )]
    )
    for to, of, seed in (("low", "high", 1), ("high", "low", 2)):
        df = df.withColumns({f"_{n}_{to}": F.col(f"_{n}_{to}").bitwiseXOR(F.xxhash64(f"_{n}_{of}", F.lit(seed))) for n in names})
    rest = 64 - QUOTIENT_BITS
    key = lambda n: F.struct(
        F.shiftrightunsigned(f"_{n}_high", rest).cast("int").alias("q"), F.col(f"_{n}_high").bitwiseAND(F.lit((1 << rest) - 1)).alias("r_high"),
        F.col(f"_{n}_low").alias("r_low"), F.col(f"_{n}_text").alias("r_text"),
    )
    return df.select(*kept, *[F.when(F.col(f"_{n}_known"), key(n)).alias(n) for n in names])


#: Time of a delivery without one, and of an identifier that is only named; both sort last.
_LATE, _NEVER = (1 << 63) - 2, (1 << 63) - 1
_KEY = ("q", "r_high", "r_low", "r_text")
_VALUES = ("at", "kept", "least", "most", "linked")
_SCHEMA = "q int, r_high bigint, r_low bigint, r_text string, at bigint, kept bigint, least bigint, most bigint, linked boolean"
_TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())


class QuotientTable:
    """An exact hash table of permuted identifiers: a slot holds the quotient and the complete remainder.

    Slots are probed in line from the place the permuted bits name. An identifier is
    inserted once, whatever the number of its rows, and is never taken for another
    one. Whole batches are inserted at a time: rows that want a free slot write their
    number into it, the one found there has won it, the others compare or move on.
    """

    def __init__(self, bits: int = 10) -> None:
        self.texts: dict[str, int] = {}
        self._clear(bits)

    def _clear(self, bits: int) -> None:
        self.bits, n = bits, 1 << bits
        self.count = 0
        self.used = np.zeros(n, bool)
        self.winner = np.zeros(n, np.int64)
        self.keys = np.zeros((4, n), np.int64)
        self.at, self.kept, self.least = (np.full(n, _NEVER, np.int64) for _ in range(3))
        self.most, self.linked = np.full(n, -_NEVER, np.int64), np.zeros(n, bool)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, free ones claimed for new keys."""
        mixed = (keys[1] ^ keys[2]).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ keys[0].astype(np.uint64) << np.uint64(40)
        place = (mixed >> np.uint64(64 - self.bits)).astype(np.int64)
        slots = np.empty(keys.shape[1], np.int64)
        left = np.arange(keys.shape[1])
        while len(left):
            here = place[left]
            free = ~self.used[here]
            self.winner[here[free]] = left[free]
            won = left[free][self.winner[here[free]] == left[free]]
            self.used[place[won]] = True
            self.keys[:, place[won]] = keys[:, won]
            self.count += len(won)
            same = (self.keys[:, here] == keys[:, left]).all(0)
            slots[left[same]] = here[same]
            left = left[~same]
            place[left] = (place[left] + 1) & ((1 << self.bits) - 1)
        return slots

    def insert(self, keys: np.ndarray, at: np.ndarray, kept: np.ndarray, least: np.ndarray, most: np.ndarray, linked: np.ndarray) -> None:
        """Insert identifiers with their first delivery (time, number), least and greatest delivery, and whether a link names them."""
        if 2 * (self.count + keys.shape[1]) > 1 << self.bits:
            held = self._held()
            self._clear((2 * (self.count + keys.shape[1])).bit_length() + 1)
            self._fill(*held)
        self._fill(keys, at, kept, least, most, linked)

    def _fill(self, keys, at, kept, least, most, linked) -> None:  # noqa: ANN001
        slots = self._slots(keys)
        before = self.at[slots]
        np.minimum.at(self.at, slots, at)
        self.kept[slots[self.at[slots] < before]] = _NEVER
        first = at == self.at[slots]
        np.minimum.at(self.kept, slots[first], kept[first])
        np.minimum.at(self.least, slots, least)
        np.maximum.at(self.most, slots, most)
        self.linked[slots[linked]] = True

    def _held(self) -> tuple[np.ndarray, ...]:
        own = np.flatnonzero(self.used)
        return self.keys[:, own], self.at[own], self.kept[own], self.least[own], self.most[own], self.linked[own]

    def insert_batch(self, batch: pa.RecordBatch) -> None:
        """Insert rows of the columns of ``_SCHEMA``. Identifiers that aren't of fixed width go by the number of their text."""
        numbers = [batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 4, 5, 6, 7, 8)]
        texts = batch.column(3)
        codes = np.zeros(batch.num_rows, np.int64)
        if texts.null_count < batch.num_rows:
            codes[:] = [0 if t is None else self.texts.setdefault(t, len(self.texts) + 1) for t in texts.to_pylist()]
        self.insert(np.stack([numbers[0].astype(np.int64), numbers[1], numbers[2], codes]), *numbers[3:7], numbers[7].astype(bool))

    def rows(self) -> list[pa.Array]:
        """What the table holds, as columns of ``_SCHEMA``; it is empty afterwards."""
        keys, *values = self._held()
        names = [None, *self.texts]
        text = pa.array([names[c] for c in keys[3]] if self.texts else [None] * keys.shape[1], pa.string())
        self.texts = {}
        self._clear(10)
        return [pa.array(keys[0].astype(np.int32)), pa.array(keys[1]), pa.array(keys[2]), text, *map(pa.array, values)]


#: Identifiers that a partial table holds before it is handed on.
PARTIAL = 1 << 20


def _partial_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map side: the rows of a task as tables of bounded size, so that a hot identifier leaves the task once a table."""
    table = QuotientTable()
    for batch in batches:
        table.insert_batch(batch)
        if table.count >= PARTIAL:
            yield pa.RecordBatch.from_arrays(table.rows(), names=[*_KEY, *_VALUES])
    if table.count:
        yield pa.RecordBatch.from_arrays(table.rows(), names=[*_KEY, *_VALUES])


def _shard_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shard side: rows sorted by quotient give the final table of one quotient after the other, each identifier with a name of its own.

    The name is the quotient and the identifier's number in the table of that
    quotient, so it is as exact as the identifier and fits 64 bits.
    """
    table, last = QuotientTable(), None

    def done() -> Iterator[pa.RecordBatch]:
        if table.count:
            columns = table.rows()
            q = columns[0].to_numpy().astype(np.int64)
            order = np.argsort(q, kind="stable")
            first = np.searchsorted(q[order], q[order])
            names = np.empty(len(q), np.int64)
            names[order] = (q[order] << (62 - QUOTIENT_BITS)) + np.arange(len(q)) - first
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names)], names=[*_KEY, *_VALUES, "name"])

    for batch in batches:
        if not batch.num_rows:
            continue
        q = batch.column(0).to_numpy()
        whole = int(np.searchsorted(q, q[-1]))  # the last quotient may go on in the next batch
        if whole:
            table.insert_batch(batch.slice(0, whole))
            yield from done()
        elif table.count and last != int(q[-1]):
            yield from done()
        table.insert_batch(batch.slice(whole))
        last = int(q[-1])
    yield from done()


def identifier_table(entries: DataFrame) -> DataFrame:
    """(q, r_high, r_low, r_text, at, kept, least, most, linked, name): one row per identifier of ``entries``, which have all these columns but the name.

    Entries are put into partial tables map side, shuffled by quotient, and every
    quotient's table is filled in one task, which holds one quotient at a time.
    """
    partial = entries.select(*_KEY, *_VALUES).mapInArrow(_partial_tables, _SCHEMA)
    return partial.repartition("q").sortWithinPartitions("q").mapInArrow(_shard_tables, _SCHEMA + ", name bigint")


def _by_key(left: DataFrame, right: DataFrame) -> Column:
    same = (left.q == right.q) & (left.r_high == right.r_high) & (left.r_low == right.r_low)
    return same & left.r_text.eqNullSafe(right.r_text)


def repeated_deliveries(
    deliveries: DataFrame,
    delivery_id: str = "delivery_id",
    event_id: str = "event_id",
    received_at: str = "received_at",
    retry_count: str = "metadata.retry_count",
    original: str = "metadata.original_event_id",
) -> DataFrame:
    """(delivery_id, kept) of every delivery but the one kept of its message.

    Identifiers, own ones and those that a retry names, are inserted into the exact
    tables of ``identifier_table``; each holds its first delivery. Most are no part of
    a link, their table row is their message. Links become pairs of names; components
    are found on those alone, and only the identifiers of links are grouped by them.
    The narrow table of keys is written once to the shared folder, as three steps read it.

    Null identifiers match nothing, but a retry without an identifier belongs to
    the original it names. Null retry counts read as 0. Equal arrival times fall
    to the smaller delivery_id; rows repeated with the same delivery_id are one
    delivery; null arrival times sort last; rows without a delivery_id, a whole
    number, are left out. No rows give no rows, and other columns of the input are
    not looked at.
    """
    retried = F.coalesce(F.col(retry_count), F.lit(0)) > 0
    rows = deliveries.select(
        F.col(delivery_id).cast("bigint").alias("delivery"),
        F.coalesce(F.unix_micros(F.col(received_at).cast("timestamp")), F.lit(_LATE)).alias("at"),
        F.col(event_id).alias("id"),
        F.when(retried, F.col(original)).alias("named"),
    ).where("delivery IS NOT NULL")
    rows = with_quotient_keys(rows, {"own": F.col("id"), "first": F.col("named")})
    rows = cut(rows.select("delivery", "at", "own", "first").where("own IS NOT NULL OR first IS NOT NULL"))
    links = rows.where("own IS NOT NULL AND first IS NOT NULL AND own <> first").select("own", "first").distinct()

    owned = rows.select(F.coalesce("own", "first").alias("key"), "at", F.col("delivery").alias("kept"), F.col("delivery").alias("least"), F.col("delivery").alias("most"), F.lit(False).alias("linked"))
    mentioned = links.select(F.explode(F.array("own", "first")).alias("key"), F.lit(_NEVER).alias("at"), F.lit(_NEVER).alias("kept"), F.lit(_NEVER).alias("least"), F.lit(-_NEVER).alias("most"), F.lit(True).alias("linked"))
    table = cut(identifier_table(owned.unionByName(mentioned).select("key.*", *_VALUES)))

    named = table.where("linked").select(*_KEY, "name")
    ends = links.select("own", F.col("first").alias("other")).select("own.*", "other")
    ends = ends.join(named, _by_key(ends, named)).select(F.col("name").alias("a"), "other").select("a", "other.*")
    named = named.select(*_KEY, "name")
    ends = ends.join(named, _by_key(ends, named)).select("a", F.col("name").alias("b"))
    roots = components(ends, "a", "b").withColumnRenamed("node", "name")

    linked = table.where("linked").join(roots, "name")
    message = linked.groupBy("root").agg(F.min(F.struct("at", "kept")).alias("top"), F.min("least").alias("low"), F.max("most").alias("high"))
    message = message.select("root", F.col("top.kept").alias("first_of"), "low", "high").where("low < high")
    of_links = linked.join(message, "root").select(*_KEY, F.col("first_of").alias("kept"))
    repeated = table.where("NOT linked AND least < most").select(*_KEY, "kept").unionByName(of_links)
    keyed = rows.select("delivery", F.coalesce("own", "first").alias("key")).select("delivery", "key.*")
    found = keyed.join(repeated, _by_key(keyed, repeated)).where(F.col("delivery") != F.col("kept"))
    return found.select(F.col("delivery").alias("delivery_id"), "kept").distinct()


def exactly_once(deliveries: DataFrame, delivery_id: str = "delivery_id", **names: str) -> DataFrame:
    """The deliveries without the repeated ones, all columns kept; a repeated row of one delivery_id is given once."""
    gone = repeated_deliveries(deliveries, delivery_id=delivery_id, **names).select(F.col("delivery_id").alias(delivery_id))
    return deliveries.join(gone, delivery_id, "left_anti").dropDuplicates([delivery_id])
