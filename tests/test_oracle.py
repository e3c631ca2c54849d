"""Every registered query with an oracle matches DuckDB on sf0.001."""
import math

import pandas as pd
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

ORACLES = E.oracle_sql()
QUERIES = E.queries()


def _norm(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    return v.item() if hasattr(v, "item") else v


def _rows(df):
    cols = sorted(df.columns)
    rows = [tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False)]
    return cols, sorted(rows, key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    sp = QUERIES[name](spark, SF_SMALL).toPandas()
    du = duck.execute(ORACLES[name]).fetchdf()
    c1, r1 = _rows(sp)
    c2, r2 = _rows(du)
    assert c1 == c2
    assert len(r1) == len(r2)
    for a, b in zip(r1, r2):
        for x, y in zip(a, b):
            if isinstance(x, float) and isinstance(y, float):
                assert x == pytest.approx(y, rel=1e-9, abs=1e-6)
            else:
                assert x == y


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 7
