"""Every query with SQL gives the rows that DuckDB gives; the others keep their promises."""

import math
import os

import duckdb
import pytest

from leafmark.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ALL = catalog.all_queries()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, int | float):
            return f"{float(v):.9g}"
        return str(list(v)) if isinstance(v, list | tuple) else str(v)

    return sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", [n for n, (_, sql) in ALL.items() if sql])
def test_matches_sql(spark, duck, name):
    f, sql = ALL[name]
    got = f(spark, SF)
    want = duck.execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), columns)
