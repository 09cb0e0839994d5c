"""Every registered query of the library itself against its SQL, on the smallest tables."""

import math
import os

import pytest

from quaymark.plans import file_queries  # noqa: F401 - registers its queries
from quaymark.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in ("lineitem", "part", "events", "region", "nation", "customer"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def _norm(v):
    if v is None or isinstance(v, float) and math.isnan(v) or type(v).__name__ == "NAType":
        return ""
    return v if isinstance(v, (str, bool)) else repr(float(v))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).fetchdf()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a, b = (sorted(tuple(map(_norm, r)) for r in x[cols].astype(object).itertuples(index=False)) for x in (got, want))
    assert [tuple(map(str, r)) for r in a] == [tuple(map(str, r)) for r in b]
