import os

import duckdb
import pytest

from veinwork.plans import catalog, resolution  # noqa: F401  (registers its queries)
from veinwork.sources import bridge

DATA = "/root/testdata/sf0.001"


def normal(df):
    df = df[sorted(df.columns)]
    df = df.astype(object).where(df.notna(), None)
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", catalog.ORACLE_SQL)
def test_query_equals_its_sql(spark, tables, name):
    got, expected = catalog.QUERIES[name](spark, DATA).toPandas(), tables.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert normal(got) == normal(expected)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_gates_derive_edges_once(spark):
    plan = catalog.scan_gates(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert " AS o#" not in plan  # the join of lineitem with itself
    assert not bridge._shared
