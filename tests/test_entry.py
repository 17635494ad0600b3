import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
CORE = sorted(n for n in entry.queries() if not n.startswith(("p2", "p3", "p5", "p6", "p7", "p8")))


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for f in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    yield con
    con.close()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(names, found):
    return sorted((tuple(plain(r[n]) for n in sorted(names)) for r in found), key=repr)


@pytest.mark.parametrize("name", CORE)
def test_core_query_equals_its_sql(spark, views, name):
    df = entry.queries()[name](spark, SMALL)
    assert len(set(df.columns)) == len(df.columns)
    got = [r.asDict() for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql:
        want = views.execute(sql)
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(df.columns)
        assert rows(names, got) == rows(names, [dict(zip(names, r)) for r in want.fetchall()])


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_a_failing_optional_package_leaves_the_core(monkeypatch):
    real = entry.importlib.import_module

    def broken(name, *more):
        if name.startswith(entry.OPTIONAL):
            raise ImportError(name)
        return real(name, *more)

    monkeypatch.setattr(entry.importlib, "import_module", broken)
    assert set(entry.queries()) == set(CORE)
