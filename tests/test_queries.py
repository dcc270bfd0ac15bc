"""Every registered query of the engine against its SQL form on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pytest

from smoothspan.plans import catalog


def plain(pdf):
    columns = sorted(pdf.columns)
    out = pdf[columns].copy()
    for c in columns:
        out[c] = out[c].map(lambda v: "" if v is None or v != v else f"{float(v):.7g}" if isinstance(v, float | np.floating) else str(v))
    return out.sort_values(columns).reset_index(drop=True)


@pytest.fixture(scope="module")
def database(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, sf_dir, database, name):
    found = catalog.queries()[name](spark, sf_dir).toPandas()
    assert plain(found).equals(plain(database.sql(catalog.oracle_sql()[name]).df()))


def test_fitted_queries(spark, sf_dir):
    found = catalog.flagship(spark, sf_dir).toPandas()
    assert len(found) == 9 and found["support"].sum() == 1500
