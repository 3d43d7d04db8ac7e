"""Queries of the vector operators on `embeddings`, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vectors as v
from .tables import read

QUERIES, SQL = {}, {}
K = 10


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _vectors(spark, sf):
    return read(spark, sf, "embeddings").select("vec_id", "embedding", F.col("label").cast("string").alias("label"))


def _edges(spark, sf):
    return v.knn(_vectors(spark, sf), "vec_id", "embedding", K)


def _labels(spark, sf):
    return _vectors(spark, sf).select(F.col("vec_id").alias("cell"), F.col("label").alias("grp"))


_E = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, CAST(label AS VARCHAR) AS label FROM embeddings)"
_KNN = f"""{_E}, d AS (SELECT a.vec_id AS i, b.vec_id AS j, sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS distance FROM e a JOIN e b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY distance, j) AS rank FROM d), k AS (SELECT * FROM r WHERE rank <= {K})"""


@query(f"""WITH {_E} SELECT a.vec_id AS i, b.vec_id AS j, round(sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 6) AS euclidean,
round(list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS sqeuclidean, round(list_sum(list_transform(list_zip(a.x, b.x), lambda p: abs(p[1] - p[2]))), 6) AS cityblock,
round(list_max(list_transform(list_zip(a.x, b.x), lambda p: abs(p[1] - p[2]))), 6) AS chebyshev, round(1 - list_cosine_similarity(a.x, b.x), 6) AS cosine FROM e a JOIN e b ON a.vec_id < b.vec_id""")
def pairwise_distances(spark, sf):
    out = v.pairwise_distances(_vectors(spark, sf), "vec_id", "embedding")
    return out.select("i", "j", *[F.round(m, 6).alias(m) for m in v.METRICS])


@query(f"WITH {_E}, p AS (SELECT label, unnest(x) AS v, unnest(range(0, len(x))) AS pos FROM e), m AS (SELECT label, pos, avg(v) AS v FROM p GROUP BY 1, 2) SELECT label, list(round(v, 6) ORDER BY pos) AS barycenter FROM m GROUP BY 1")
def barycenters(spark, sf):
    return v.barycenters(_vectors(spark, sf), "label", "embedding").select("label", F.transform("barycenter", lambda x: F.round(x, 6)).alias("barycenter"))


@query(f"WITH {_KNN} SELECT i, j, round(distance, 6) AS distance, rank FROM k")
def knn_exact(spark, sf):
    return _edges(spark, sf).withColumn("distance", F.round("distance", 6))


@query(f"WITH {_KNN}, b AS (SELECT i, j FROM k UNION ALL SELECT j, i FROM k) SELECT i, j, CAST(count(*) * 0.5 AS DOUBLE) AS weight FROM b GROUP BY 1, 2 UNION ALL SELECT vec_id, vec_id, CAST(1 AS DOUBLE) FROM e")
def knn_binary_connectivity(spark, sf):
    return v.binary_connectivity(_edges(spark, sf))


@query()
def knn_fuzzy(spark, sf):
    return v.fuzzy_connectivity(_edges(spark, sf), K + 1)


_SHARED = f"WITH {_KNN}, s AS (SELECT a.i AS i, b.i AS j, count(*) AS shared, sum(1.0 / (a.rank + b.rank)) AS r FROM k a JOIN k b ON a.j = b.j AND a.i < b.i GROUP BY 1, 2 HAVING count(*) > 1)"


def _shared(spark, sf, score, weights=None):
    return v.shared_neighbors(_edges(spark, sf), K, score, weights=weights).withColumn("weight", F.round("weight", 6))


@query(f"{_SHARED} SELECT i, j, shared, round(shared / ({2 * K} - shared), 6) AS weight FROM s")
def snn_jaccard(spark, sf):
    return _shared(spark, sf, "jaccard")


@query(f"{_SHARED} SELECT i, j, shared, round(shared / {K}, 6) AS weight FROM s")
def snn_overlap(spark, sf):
    return _shared(spark, sf, "overlap")


@query(f"{_SHARED} SELECT i, j, shared, round(shared / sqrt({K * K}), 6) AS weight FROM s")
def snn_cosine(spark, sf):
    return _shared(spark, sf, "cosine")


@query(f"{_SHARED} SELECT i, j, shared, round(least(r / {sum(1 / (2 * m) for m in range(1, K + 1))!r}, 1), 6) AS weight FROM s")
def snn_ranked(spark, sf):
    return _shared(spark, sf, "ranked")


@query(f"""WITH {_KNN}, w AS (SELECT a.i, a.j, a.rank, CASE WHEN b.i IS NULL THEN 0.5 ELSE 1.0 END AS w FROM k a LEFT JOIN k b ON a.i = b.j AND a.j = b.i), t AS (SELECT i, sum(w) AS t FROM w GROUP BY 1),
s AS (SELECT a.i AS i, b.i AS j, count(*) AS shared, sum(least(a.w, b.w)) AS m FROM w a JOIN w b ON a.j = b.j AND a.i < b.i GROUP BY 1, 2 HAVING count(*) > 1)
SELECT s.i, s.j, shared, round(m / (a.t + b.t - m), 6) AS weight FROM s JOIN t a ON a.i = s.i JOIN t b ON b.i = s.j""")
def snn_weighted(spark, sf):
    edges = _edges(spark, sf)
    return v.shared_neighbors(edges, K, "weighted", weights=v.binary_connectivity(edges).filter("i <> j")).withColumn("weight", F.round("weight", 6))


_PAGA = f"""WITH {_KNN}, c AS (SELECT a.label AS a, b.label AS b, count(*) AS e FROM k JOIN e a ON a.vec_id = k.i JOIN e b ON b.vec_id = k.j GROUP BY 1, 2), n AS (SELECT label, count(*) AS n FROM e GROUP BY 1),
t AS (SELECT a AS label, sum(e) AS t FROM c GROUP BY 1), g AS (SELECT n.label, n.n, coalesce(t.t, 0) AS t FROM n LEFT JOIN t USING (label)), o AS (SELECT least(a, b) AS a, greatest(a, b) AS b, sum(e) AS observed FROM c WHERE a <> b GROUP BY 1, 2),
p AS (SELECT o.a, o.b, CAST(o.observed AS BIGINT) AS observed, (x.t * y.n + y.t * x.n) / ((SELECT count(*) FROM e) - 1) AS expected FROM o JOIN g x ON x.label = o.a JOIN g y ON y.label = o.b)"""


@query(_PAGA + " SELECT a, b, observed, round(expected, 6) AS expected, round(CASE WHEN expected = 0 THEN 1 ELSE least(observed / expected, 1) END, 6) AS weight FROM p")
def paga(spark, sf):
    return v.paga(_edges(spark, sf), _labels(spark, sf)).select("a", "b", "observed", F.round("expected", 6).alias("expected"), F.round("weight", 6).alias("weight"))


#: An edge is in the tree if edges that come before it (heavier, or equal and of smaller names) do not join its ends.
_TREE = _PAGA.replace("WITH ", "WITH RECURSIVE ", 1) + """, w AS (SELECT a, b, round(CASE WHEN expected = 0 THEN 1 ELSE least(observed / expected, 1) END, 9) AS weight FROM p), en AS (SELECT *, row_number() OVER (ORDER BY weight DESC, a, b) AS m FROM w),
ed AS (SELECT m, a AS x, b AS y FROM en UNION ALL SELECT m, b, a FROM en), rt(m, x) AS (SELECT en.m, ed.y FROM en JOIN ed ON ed.x = en.a AND ed.m < en.m UNION SELECT rt.m, ed.y FROM rt JOIN ed ON ed.x = rt.x AND ed.m < rt.m) SELECT a, b, weight FROM en WHERE NOT EXISTS (SELECT 1 FROM rt WHERE rt.m = en.m AND rt.x = en.b)"""


@query(_TREE)
def paga_tree(spark, sf):
    weights = v.paga(_edges(spark, sf), _labels(spark, sf))
    return v.paga_tree(weights.withColumn("weight", F.round("weight", 9)))


def _lengths(spark, sf):
    return v.knnsc_distances(_vectors(spark, sf), "vec_id", "embedding", "label", K)


def _grp(spark, sf):
    return _vectors(spark, sf).select(F.col("vec_id").alias("node"), F.col("label").alias("grp"))


@query()
def knnsc_peripheral(spark, sf):
    return v.peripheral_cells(_lengths(spark, sf), _grp(spark, sf), 30)


@query()
def knnsc_central(spark, sf):
    return v.central_cells(_lengths(spark, sf), _grp(spark, sf), 30)


@query()
def kmeans(spark, sf):
    return v.kmeans(_vectors(spark, sf), "vec_id", "embedding", 10)


@query()
def pca(spark, sf):
    return v.pca(_vectors(spark, sf), "vec_id", "embedding", 10)


def _fuzzy(spark, sf):
    return v.fuzzy_connectivity(_edges(spark, sf), K + 1)


@query()
def spectral(spark, sf):
    return v.spectral(_fuzzy(spark, sf))


@query()
def louvain(spark, sf):
    return v.communities(_fuzzy(spark, sf))


@query()
def leiden(spark, sf):
    return v.communities(_fuzzy(spark, sf), refine=True)


@query()
def umap(spark, sf):
    return v.umap(_fuzzy(spark, sf))


@query()
def tsne(spark, sf):
    return v.tsne(_vectors(spark, sf), "vec_id", "embedding")


@query("""WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), m AS (SELECT pos, avg(v) AS m, stddev_samp(v) AS s FROM x GROUP BY 1)
SELECT vec_id, pos, round(greatest(least((v - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 2), -2), 6) AS value FROM x JOIN m USING (pos)""")
def scale_representation(spark, sf):
    out = v.scaled_representation(read(spark, sf, "embeddings"), "vec_id", "embedding", max_value=2.0)
    return out.select("vec_id", F.posexplode("components").alias("p", "value")).select("vec_id", (F.col("p") + 1).alias("pos"), F.round("value", 6).alias("value"))
