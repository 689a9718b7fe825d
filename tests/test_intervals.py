import random

import pytest
from pyspark.sql import functions as F

from chunkloom.operators.components import components
from chunkloom.operators.intervals import IntervalLog, islands, merged, pending_changes, subtract


def numbers(rows, keyed=True):
    return {(r.k, n) for r in rows for n in range(r.lo, r.hi + 1)} if keyed else {n for r in rows for n in range(r.lo, r.hi + 1)}


def test_merge_and_subtract_against_sets(spark):
    r = random.Random(3)
    make = lambda: [(r.choice("ab"), a, a + r.randrange(-1, 12)) for a in (r.randrange(100) for _ in range(40))]
    for _ in range(3):
        a, p = make(), make()
        A, P = spark.createDataFrame(a, "k string, lo bigint, hi bigint"), spark.createDataFrame(p, "k string, lo bigint, hi bigint")
        plain = lambda x: {(k, n) for k, lo, hi in x for n in range(lo, hi + 1)}
        whole = merged(A, ["k"]).collect()
        assert numbers(whole) == plain(a)
        for k in "ab":
            own = sorted((x.lo, x.hi) for x in whole if x.k == k)
            assert all(b[0] > a_[1] + 1 for a_, b in zip(own, own[1:]))
        assert numbers(subtract(A, P, ["k"]).collect()) == plain(a) - plain(p)


def test_islands_and_no_keys(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (5,), (None,)], "n bigint")
    assert sorted((r.lo, r.hi) for r in islands(df, [], "n").collect()) == [(1, 2), (5, 5)]
    empty = spark.createDataFrame([], "lo bigint, hi bigint")
    assert subtract(empty, empty, []).count() == 0


def test_log_survives_failures_and_late_rows(spark, tmp_path):
    log = IntervalLog(spark, str(tmp_path / "log"))
    feed = lambda ns: spark.createDataFrame([("s", n, f"v{n}") for n in ns], "k string, n bigint, v string")
    assert log.run(feed([1, 2, 5]), ["k"], "n", lambda df: df) == 3

    def die(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        log.run(feed([1, 2, 5, 6]), ["k"], "n", die)
    assert log.run(feed([1, 2, 3, 5, 6]), ["k"], "n", lambda df: df) == 2  # 3 came late
    assert log.run(feed([1, 2, 3, 5, 6]), ["k"], "n", lambda df: df) == 0
    assert sorted(r.n for r in log.output().collect()) == [1, 2, 3, 5, 6]
    assert sorted((r.lo, r.hi) for r in log.processed(["k"], "k string, lo bigint, hi bigint").collect()) == [(1, 3), (5, 6)]


def test_pending_changes_cases(spark):
    v = "chunk_key string, chunk_hash string, tombstone boolean, last_indexed_at timestamp, extra int"
    t = lambda d: f"2025-01-{d:02d} 00:00:00"
    rows = [
        ("new", "A", False, t(1)), ("same", "AB", False, t(1)), ("same", "CD", False, t(3)), ("late", "AA", False, t(1)), ("late", "BB", False, t(2)), ("gone", "A", True, t(4)), ("gone", "A", False, t(1)),
        ("back", "A", False, t(5)), ("dead", "A", True, t(2)), ("never", "A", True, t(2)), ("failed", "A", False, t(2)), ("again", "A", False, t(1)), ("again", "B", False, t(2)), ("again", "A", False, t(3)), (None, "A", False, t(1)),
    ]
    snapshot = spark.createDataFrame([(*r[:3], r[3], 1) for r in rows * 2], v.replace("timestamp", "string")).withColumn("last_indexed_at", F.to_timestamp("last_indexed_at"))
    runs = spark.createDataFrame([(1, "succeeded"), (2, "failed"), (3, "succeeded"), (4, "running")], "run_id int, status string")
    ledger = spark.createDataFrame(
        [(1, "same", "ab", False), (3, "same", "cd", False), (3, "late", "BB", False), (1, "gone", "A", False), (3, "back", "A", True), (1, "dead", "A", True), (2, "failed", "A", False), (3, "again", "a", False), (1, None, "A", False)],
        "run_id int, chunk_key string, chunk_hash string, tombstone boolean",
    ).withColumn("recorded_at", F.lit("2025-01-01").cast("timestamp"))
    got = {(r.chunk_key, r.change) for r in pending_changes(snapshot, runs, ledger).collect()}
    assert got == {("new", "added"), ("gone", "removed"), ("back", "added"), ("failed", "added")}
    assert pending_changes(snapshot.limit(0), runs, ledger).count() == 0
    assert pending_changes(snapshot, runs, ledger.limit(0)).count() == 6  # all but the three newest tombstones


def test_components_against_union_find(spark):
    r = random.Random(1)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(1, 1), (None, 2)]
    group: dict = {}
    for a, b in edges:
        if a is not None and a != b:
            x, y = group.get(a, {a}), group.get(b, {b})
            x |= y
            for n in x:
                group[n] = x
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    assert got == {n: min(g) for n, g in group.items()}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0
