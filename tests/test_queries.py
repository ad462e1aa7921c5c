"""Every query against the same rows in SQL on another engine."""

import duckdb
import pandas as pd
import pytest

from trialgrid.plans import joins, labels, models, statistics, tables  # noqa: F401  register their queries
from trialgrid.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def engine():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, engine, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got) > 0
    if name not in ORACLES:  # tests/test_models.py
        return
    tidy = lambda df: df[sorted(df.columns)].sort_values(sorted(df.columns), ignore_index=True)
    pd.testing.assert_frame_equal(tidy(got), tidy(engine.sql(ORACLES[name]).df()), check_dtype=False, rtol=1e-9, atol=0)
