import os
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@needs_data
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    result = duck.execute(entry.oracle_sql()[name])
    order = [[d[0] for d in result.description].index(c) for c in columns]
    want = Counter(repr(tuple(plain(r[i]) for i in order)) for r in result.fetchall())
    assert Counter(repr(tuple(plain(v) for v in r)) for r in df.select(*columns).collect()) == want


@needs_data
@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_runs(spark, name):
    assert entry.queries()[name](spark, FOLDER).count() >= 0


def test_nothing_outside_imports_llm():
    root = Path(entry.__file__).parent
    for p in (root / "chunkloom").rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "llm" not in p.read_text(), p


def test_registry_names_are_unique():
    assert set(entry.oracle_sql()) <= set(entry.queries())
