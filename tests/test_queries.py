"""Every registered analytics query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from tesserae import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    v = v.item() if hasattr(v, "item") else v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return [norm(x) for x in v] if isinstance(v, (list, tuple)) else repr(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, con, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(str(norm([r[c] for c in columns])) for r in df.collect())
    if name not in plans.SQL:
        assert columns
        return
    result = con.execute(plans.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert sorted(str(norm([r[i] for i in at])) for r in result.fetchall()) == rows
