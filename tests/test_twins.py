"""Every query with a SQL twin against DuckDB, on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from seriesmill.plans import registry  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Slow twins, which the driver's own comparison covers.
SLOW = {"d12_score_candidates", "l2_stream_error_counts", "l3_stream_idle_sessions"}


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: round(v, 5) + 0.0 if isinstance(v, float) else v
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(set(registry.oracle_sql()) - SLOW))
def test_twin(spark, con, small, name):
    df = registry.queries()[name](spark, small)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    c = con.execute(registry.oracle_sql()[name])
    want = rows([x[0] for x in c.description], c.fetchall())
    assert got[0] == want[0]
    assert [str(r) for r in got[1]] == [str(r) for r in want[1]]


def test_flagship_is_registered():
    assert registry.FLAGSHIP in registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_without_twin(spark, small, name):
    assert registry.queries()[name](spark, small).count() > 0
