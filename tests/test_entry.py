import os

import duckdb
import pytest

import __spark_entry__ as entry
from quercus import plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def rounded(v):
    return round(v, 9) + 0.0 if isinstance(v, float) else tuple(map(rounded, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = con.execute(plans.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert columns == sorted(names)
    want = sorted((tuple(rounded(dict(zip(names, r, strict=True))[c]) for c in columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(rounded(r[c]) for c in columns) for r in df.collect()), key=repr) == want


def test_others_run(spark):
    for name in set(plans.QUERIES) - set(plans.ORACLE_SQL):
        assert plans.QUERIES[name](spark, SF).count() > 0
