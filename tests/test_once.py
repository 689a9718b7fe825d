import random
import uuid
from datetime import datetime, timedelta

from chunkloom.operators.once import exactly_once, repeated_deliveries

SCHEMA = "delivery_id bigint, received_at timestamp_ntz, event_id string, metadata struct<retry_count:int,original_event_id:string>, own string"
T0 = datetime(2025, 1, 1)


def brute(rows):
    clean = lambda x: None if x is None or not x.strip() else x.strip().lower().replace("urn:uuid:", "").replace("{", "").replace("}", "").replace("-", "")
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    node = {}
    for d, _, e, (n, o), *_ in rows:
        own, named = clean(e), clean(o) if (n or 0) > 0 else None
        if own and named:
            a, b = find(own), find(named)
            parent[a] = b
        if own or named:
            node[d] = own or named
    groups: dict = {}
    for d, at, *_ in rows:
        if d in node:
            groups.setdefault(find(node[d]), []).append((at is None, at or T0, d))
    return {d for g in groups.values() for _, _, d in sorted(g)[1:]}


def spell(r, u):
    return r.choice([u, u.upper(), "{" + u + "}", "urn:uuid:" + u, u.replace("-", ""), f" {u} "])


def test_against_union_find(spark):
    r = random.Random(7)
    ids = [str(uuid.UUID(int=r.getrandbits(128))) for _ in range(60)] + [f"evt-{k}" for k in range(5)]
    rows = []
    for d in range(600):
        own = None if r.random() < 0.1 else r.choice(ids)
        named = r.choice(ids) if r.random() < 0.3 else None
        wrote = own and (spell(r, own) if len(own) > 30 else own)
        rows.append((d, T0 + timedelta(seconds=r.randrange(40)) if r.random() > 0.02 else None, wrote, (r.choice([None, 0, 1, 3]), named and (spell(r, named) if len(named) > 30 else named)), "x"))
    got = {x.delivery_id for x in repeated_deliveries(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_long_chain_hot_id_and_ties(spark):
    rows = [(k, T0, f"id{k}", (1, f"id{k - 1}"), "") for k in range(1, 40)] + [(1000 + k, T0, "hot", (0, None), "") for k in range(500)]
    found = repeated_deliveries(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {x.delivery_id for x in found} == set(range(2, 40)) | set(range(1001, 1500))
    assert {x.kept for x in found} == {1, 1000}


def test_empty_null_and_repeated_rows(spark):
    assert repeated_deliveries(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, T0, None, (0, None), ""), (2, T0, "", (0, None), ""), (3, None, "a", None, ""), (3, None, "a", None, ""), (4, T0, None, (1, "a"), "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [x.delivery_id for x in repeated_deliveries(df).collect()] == [3]
    kept = exactly_once(df)
    assert sorted(x.delivery_id for x in kept.collect()) == [1, 2, 4] and kept.columns == df.columns


def test_quotient_table_holds_each_identifier_once():
    import numpy as np

    from chunkloom.operators.once import QuotientTable

    r = np.random.default_rng(3)
    few = r.integers(-(1 << 62), 1 << 62, (2, 700))
    keys = np.stack([r.integers(0, 4, 700), few[0] & 0xFF, few[1] & 3, np.zeros(700, np.int64)])  # crowded: many share their place
    pick = r.integers(0, 700, 9000)
    at, delivery = r.integers(0, 50, 9000), r.permutation(9000)
    table = QuotientTable(3)
    for part in np.array_split(np.arange(9000), 17):
        table.insert(keys[:, pick[part]], at[part], delivery[part], delivery[part], delivery[part], delivery[part] % 7 == 0)
    want: dict = {}
    for k, t, d in zip(pick, at, delivery):
        want.setdefault(tuple(keys[:, k]), []).append((t, d))
    held = table._held()
    got = {tuple(k): v for *v, k in zip(*held[1:], held[0].T)}
    assert table.count == len(want) == len(got)
    for k, deliveries in want.items():
        t, d, least, most, linked = got[k]
        assert (t, d) == min(deliveries) and least == min(x for _, x in deliveries) and most == max(x for _, x in deliveries) and linked == any(x % 7 == 0 for _, x in deliveries)


def test_the_tables_decide(spark, monkeypatch):
    from chunkloom.operators import once

    rows = spark.createDataFrame([(1, T0, "a", None, ""), (2, T0, "a", None, ""), (3, T0, "b", None, "")], SCHEMA)
    whole = once.identifier_table
    assert [x.delivery_id for x in once.repeated_deliveries(rows).collect()] == [2]
    monkeypatch.setattr(once, "identifier_table", lambda entries: whole(entries).where("false"))
    assert once.repeated_deliveries(rows).count() == 0  # no other path finds a repeat
