"""Every registered query with an SQL twin gives its rows; the others run."""

import math
import os

import duckdb
import pytest

from lessonlake import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(x) for x in r) for r in df.select(*cols).collect()), key=str)
    assert rows
    if (sql := registry.oracle_sql().get(name)) is None:
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    other = con.sql(sql)
    assert sorted(other.columns) == cols
    assert sorted((tuple(plain(x) for x in r) for r in other.select(*[f'"{c}"' for c in cols]).fetchall()), key=str) == rows
