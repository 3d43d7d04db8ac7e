"""The corpus queries that SQL can express, against it: on the smallest tables, and on rows with edge cases."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tesserae import llm

SF = "/root/testdata/sf0.001"
TABLES = {"op7_url_filter": "pages", "op8_embeddings": "embeddings", "op9_quality": "documents", "op10_chat_format": "conversations"}


def compared(spark, name, path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {TABLES[name]} AS SELECT * FROM '{path}/{TABLES[name]}.parquet'")
    result = con.execute(llm.SQL[name])
    names = [d[0] for d in result.description]
    df = llm.QUERIES[name](spark, str(path))
    assert sorted(df.columns) == sorted(names)
    key = lambda rows: sorted(str([r[c] for c in sorted(names)]) for r in rows)
    want = key([dict(zip(names, r, strict=True)) for r in result.fetchall()])
    assert key([r.asDict() for r in df.collect()]) == want
    return want


@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_query_equals_sql(spark, name):
    assert compared(spark, name, SF)


def test_vectors_with_links_and_edge_cases(spark, tmp_path):
    import pyarrow.parquet as pq

    rng = np.random.default_rng(1)
    vs = [(c + rng.normal(size=8) * s).astype(np.float32).tolist() for c in rng.normal(size=(6, 8)) for s in (0.1, 0.3, 0.5, 0.6) for _ in range(3)]
    vs += [None, [], [0.0] * 8, [float("nan")] * 8, [1.0, None] * 4, [1.0, 0.0], [2.0, 0.0], vs[0], vs[0]]
    pq.write_table(pa.table({"vec_id": pa.array([*range(len(vs) - 2), None, 3], pa.int64()), "embedding": pa.array(vs, pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    assert len(compared(spark, "op8_embeddings", tmp_path)) == len(vs)
