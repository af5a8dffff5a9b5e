"""Queries against their SQL on the smallest tables, and the registry's shape. Factors of each panel stand for the rest."""

import duckdb
import numpy as np
import pytest

import __spark_entry__
from marlstone import queries
from marlstone.factors import all_factors

SF = "/root/testdata/sf0.001"
FIRST = {s.panel: n for n, s in reversed(all_factors().items())}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "supplier", "part", "nation", "region", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted({*FIRST.values(), *queries.operator_queries()}))
def test_query_equals_sql(spark, con, name):
    got = __spark_entry__.queries()[name](spark, SF).toPandas()
    want = con.execute(__spark_entry__.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    columns = sorted(got.columns, key=lambda c: (got[c].dtype.kind == "f", c))
    order = lambda df: df[columns].sort_values(columns).reset_index(drop=True)
    got, want = order(got), order(want)
    for c in columns:
        if got[c].dtype.kind == "f" or want[c].dtype.kind == "f":
            np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), atol=1e-9)
        else:
            assert got[c].astype(str).tolist() == want[c].astype(str).tolist()


def test_registry_is_whole(spark):
    names = set(__spark_entry__.queries())
    assert set(all_factors()) <= names
    assert set(all_factors()) | set(queries.operator_queries()) <= set(__spark_entry__.oracle_sql()) <= names
    out = __spark_entry__.entry(spark)
    assert out.columns == ["date", "code", "value"] and out.count() > 0
