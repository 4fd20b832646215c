"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from gridwright.jobs import catalog, catalog_atlas, catalog_compare, catalog_labels, catalog_methods, catalog_modes, catalog_more, catalog_presets, catalog_results, catalog_rules  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in sorted(os.listdir(SF)):
        table = name.split(".")[0]
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{name}'")
    return con


#: Sums run in another order on the two sides, so doubles are rounded values of nearly equal numbers: one unit at the last place that queries keep.
TOLERANCE = 1.5e-6


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    """Equal rows in any order; doubles within the tolerance, all else exactly."""
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    exact = [c for c in cols if a[c].dtype.kind != "f"]
    assert [a[c].dtype for c in cols] == [b[c].dtype for c in cols] and len(a) == len(b)
    a, b = (x[cols].assign(**{f"~{c}": x[c].round(3) for c in cols if c not in exact}).sort_values([*exact, *[f"~{c}" for c in cols if c not in exact], *cols]).reset_index(drop=True) for x in (a, b))
    for c in cols:
        equal = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if c not in exact:
            equal |= (a[c] - b[c]).abs() <= TOLERANCE + 1e-9 * b[c].abs()
        assert equal.all(), c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    same(catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.SQL[name]).df())
