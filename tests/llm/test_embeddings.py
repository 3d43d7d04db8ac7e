import math

import numpy as np
import pytest

from tesserae.llm import embeddings


def brute(rows):
    """[(vec_id, n_links, component_id, kept)] by all pairs."""

    def fine(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    link = [[] for _ in rows]
    top = list(range(n))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(n):
        for j in range(i):
            a, b = rows[i][1], rows[j][1]
            if fine(a) and fine(b) and len(a) == len(b):
                p, q = np.array(a, float), np.array(b, float)
                if (p @ q) / (np.sqrt(p @ p) * np.sqrt(q @ q)) >= 0.9:
                    link[i].append(j)
                    link[j].append(i)
                    top[max(find(i), find(j))] = min(find(i), find(j))
    out = []
    for i, (vid, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(n) if find(j) == find(i) and rows[j][0] is not None]
        comp = min(ids, default=None)
        out.append((vid, len(link[i]), comp, vid == comp))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=str)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_equals_all_pairs(spark, kind, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 40)
    monkeypatch.setattr(embeddings, "ROWS", 16)
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(12, 24))
    vs = [(c + rng.normal(size=24) * s).astype(np.float32) for c in centers for s in (0.05, 0.2, 0.3, 0.35, 0.4, 0.5) for _ in range(3)]
    vs += [vs[0]] * 20 + [vs[1] * np.float32(3)] + list(rng.normal(size=(40, 24)).astype(np.float32))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vs)]
    df = spark.createDataFrame([(*r, 1) for r in rows[::-1]], f"vec_id long, embedding array<{kind}>, c int")
    want = brute(rows)
    assert got(embeddings.near_vectors(df)) == want
    assert max(w[1] for w in want) > 20


def test_edge_rows(spark):
    rows = [(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, []), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, [1.0, 0.1]), (None, [0.0, 1.0]), (None, [1.0, 0.05]), (10, [1e-30, 0.0]), (11, [2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert got(embeddings.near_vectors(df)) == brute(rows)
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_huge_tiny_and_repeated_vectors_at_the_threshold(spark):
    """cos of (1, 0) and (9, x) is 0.9 where x = sqrt(19); both sides of it, at scales whose squares leave the range."""
    x = math.sqrt(19)
    flat = [[1.0, 0.0], [9.0, x], [9.0, math.nextafter(x, 0)], [9.0, math.nextafter(x, 9) + 1e-12], [9.0, x + 1e-3]]
    plain = [(i, v) for i, v in enumerate(flat)]
    df = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(plain)
    assert got(embeddings.near_vectors(df(plain))) == want
    for scale in (2.0**600, 2.0**-600):
        assert got(embeddings.near_vectors(df([(i, [c * scale for c in v]) for i, v in plain]))) == want
    twice = [(i, [c * s for c in v]) for s in (2.0**600, 2.0**-600) for i, v in plain]
    assert all(r[1] >= 1 for r in got(embeddings.near_vectors(df(twice))))
