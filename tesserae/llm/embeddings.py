"""Near-duplicate embeddings by a PCA-ordered tiled comparison.

Vectors are scaled to length 1 and turned so that the leading dimensions hold the most energy. Vectors within the
threshold differ by at most sqrt(2 - 2t) in every turned dimension, so a grid of that width over the two leading ones
leaves each cell only its neighbours; cells are cut along the third into tiles of about TILE vectors, and tiles of
neighbouring cells are compared in pairs unless their boxes in the leading dimensions lie too far apart. A tile pair adds up inner products a few dimensions at a time; the rest is bounded by the
product of the suffix norms, and rows, columns or pairs that cannot reach the threshold any more are dropped.

Equal vectors are one class with a count. A tile pair reports link counts and a spanning forest, never pairs. All
pairs of near tiles are exact work: where the leading dimensions part nothing, it grows with the square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored
from .components import components
from .simhash import Forest

THRESHOLD, TILE, ROWS = 0.9, 4096, 512
#: Dimensions added before each look at the bound, dimensions of a tile's box, steps in which a cell is cut.
STAGES, BOX, CUTS = (8, 16, 32), 8, 64
#: Below this share of pairs still alive they are followed one by one.
SPARSE = 0.02
#: Products this near the threshold are taken again from the vectors as given.
NEAR = 1e-9


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled by their largest component first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows by a power of two that brings their largest component near 1: squares stay in range and no bit is lost."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector can link: not null, not zero, no null or non-finite component."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False)))


def rotation(classes: DataFrame, dim: int) -> np.ndarray:
    """Orthonormal basis (columns) by falling energy, from the second moments of all unit vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            if b.num_rows:
                u = _unit(_matrix(b["embedding"], dim))
                total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim, dtype=np.int32)), pa.array(total.ravel())], ["at", "value"])

    rows = classes.select("embedding").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("v")).collect()
    moments = np.zeros(dim * dim)
    for r in rows:  # dim x dim numbers, whatever the data's size
        moments[r["at"]] = r["v"]
    return np.linalg.eigh(moments.reshape(dim, dim))[1][:, ::-1].copy()


def compare(a: np.ndarray, b: np.ndarray, turned_a: np.ndarray, turned_b: np.ndarray, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs (row of a, row of b) of two tiles, in pieces; for one tile with itself, each pair once.

    a, b: vectors as given; turned: unit vectors in the rotated basis."""
    dim = a.shape[1]
    steps = [*(s for s in STAGES if s < dim), dim]
    rest = lambda x: [np.sqrt((x[:, s:] ** 2).sum(axis=1)) for s in steps]
    rest_a, rest_b = rest(turned_a), rest(turned_b)
    least = threshold - NEAR
    for top in range(0, len(a), ROWS):
        rows, cols = np.arange(top, min(top + ROWS, len(a))), np.arange(top if same else 0, len(b))
        got, pairs, at = np.zeros((len(rows), len(cols))), None, 0
        for k, s in enumerate(steps):
            if pairs is None:
                got += turned_a[rows, at:s] @ turned_b[cols, at:s].T
                alive = got + np.outer(rest_a[k][rows], rest_b[k][cols]) >= least
                n = np.count_nonzero(alive)
                if n <= SPARSE * alive.size or s == dim:
                    i, j = np.nonzero(alive)
                    pairs, got = (rows[i], cols[j]), got[i, j]
                else:
                    r, c = alive.any(axis=1), alive.any(axis=0)
                    if not (r.all() and c.all()):
                        rows, cols, got = rows[r], cols[c], got[np.ix_(r, c)]
            else:
                x, y = pairs
                got = got + np.einsum("ij,ij->i", turned_a[x, at:s], turned_b[y, at:s])
                alive = got + rest_a[k][x] * rest_b[k][y] >= least
                pairs, got = (x[alive], y[alive]), got[alive]
            if pairs is not None and not len(got):
                break
            at = s
        x, y = pairs
        if same:
            once = x < y
            x, y, got = x[once], y[once], got[once]
        close = np.flatnonzero(np.abs(got - threshold) <= NEAR)
        if close.size:
            p, q = _scaled(a[x[close]]), _scaled(b[y[close]])
            got[close] = (p * q).sum(axis=1) / (np.sqrt((p * p).sum(axis=1)) * np.sqrt((q * q).sum(axis=1)))
        hit = got >= threshold
        if hit.any():
            yield x[hit], y[hit]


def class_links(classes: DataFrame, dim: int, threshold: float = THRESHOLD) -> DataFrame:
    """(c, links, root) for classes (c, n, embedding of `dim` components) with links: the number of vectors linked to
    class c in one tile pair, and the class that stands for c's component there. Classes without links are absent."""
    basis = rotation(classes, dim)
    width = float(np.sqrt(2 - 2 * threshold)) + 1e-6

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lead = np.zeros((b.num_rows, 3))
            lead[:, : min(dim, 3)] = _unit(_matrix(b["embedding"], dim)) @ basis[:, :3]
            x, y = np.floor(lead[:, :2] / width).astype(np.int32).T
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(x.copy()), pa.array(y.copy()), pa.array(lead[:, 2].copy())], [*b.schema.names, "x", "y", "z"])

    celled = stored(classes.select("c", "n", "embedding").mapInArrow(cells, f"c long, n long, embedding {dict(classes.dtypes)['embedding']}, x int, y int, z double"))
    edges = F.percentile_approx("z", F.array(*[F.lit(k / CUTS) for k in range(1, CUTS)]), F.lit(1000)).alias("edges")
    counts = celled.groupBy("x", "y").agg(F.ceil(F.count("*") / TILE).alias("parts"), edges)  # at most a few hundred cells
    step = F.size(F.filter("edges", lambda e: e < F.col("z")))
    wide = F.ceil(F.col("parts") / CUTS)  # tiles of one step, beyond CUTS tiles a cell
    part = F.when(F.col("parts") <= CUTS, F.floor(step * F.col("parts") / CUTS)).otherwise(step * wide + F.pmod(F.xxhash64("c"), wide))
    tiled = celled.join(F.broadcast(counts), ["x", "y"]).withColumn("part", part.cast("int"))

    def pack(key, t):
        v = t["embedding"].combine_chunks().flatten()
        kind = np.float32 if v.type == pa.float32() else np.float64
        raw = v.to_numpy(zero_copy_only=False).astype(kind)
        lead = _unit(raw.astype(np.float64).reshape(-1, dim)) @ basis[:, :BOX]
        own = [pa.array([k.as_py()], pa.int32()) for k in key]
        box = [pa.array([x.tolist()], pa.list_(pa.float64())) for x in (lead.min(axis=0), lead.max(axis=0))]
        return pa.Table.from_arrays([*own, *(pa.array([x], pa.binary()) for x in (t["c"].to_numpy().tobytes(), t["n"].to_numpy().tobytes(), raw.tobytes())), *box], ["x", "y", "part", "ids", "counts", "raw", "lo", "hi"])

    tiles = stored(tiled.select("x", "y", "part", "c", "n", "embedding").groupBy("x", "y", "part").applyInArrow(pack, "x int, y int, part int, ids binary, counts binary, raw binary, lo array<double>, hi array<double>"))
    names = tiles.select("x", "y", "part", "lo", "hi")
    ahead = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    first = names.select("x", "y", "part", "lo", "hi", F.explode(ahead).alias("to"))
    first = first.select("x", "y", "part", "lo", "hi", (F.col("x") + F.col("to.i")).alias("x2"), (F.col("y") + F.col("to.j")).alias("y2"))
    second = names.select(F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("part").alias("part2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    pairs = first.join(second, ["x2", "y2"]).filter((F.col("x") != F.col("x2")) | (F.col("y") != F.col("y2")) | (F.col("part") <= F.col("part2")))
    # vectors of two boxes differ by the boxes' gaps at least
    gap = lambda a, b: F.zip_with(a, b, lambda p, q: F.pow(F.greatest(p - q, F.lit(0.0)), F.lit(2.0)))
    apart = F.aggregate(F.concat(gap("lo", "hi2"), gap("lo2", "hi")), F.lit(0.0), lambda a, x: a + x)
    pairs = pairs.filter(apart <= 2 - 2 * threshold + 1e-6).select("x", "y", "part", "x2", "y2", "part2")
    left = tiles.select("x", "y", "part", *[F.col(c).alias(f"{c}1") for c in ("ids", "counts", "raw")])
    right = tiles.select(F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("part").alias("part2"), *[F.col(c).alias(f"{c}2") for c in ("ids", "counts", "raw")])
    work = pairs.join(left, ["x", "y", "part"]).join(right, ["x2", "y2", "part2"])
    double = "double" in dict(classes.dtypes)["embedding"]
    same = (F.col("x") == F.col("x2")) & (F.col("y") == F.col("y2")) & (F.col("part") == F.col("part2"))
    work = work.select("ids1", "counts1", "raw1", "ids2", "counts2", "raw2", same.alias("same")).repartition(F.xxhash64("ids1", "ids2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                one = b.slice(k, 1)
                get = lambda c, kind: np.frombuffer(one[c][0].as_py(), kind)  # noqa: B023, E731
                kind = np.float64 if double else np.float32
                ids, n = [get(f"ids{i}", np.int64) for i in (1, 2)], [get(f"counts{i}", np.int64) for i in (1, 2)]
                raw = [get(f"raw{i}", kind).astype(np.float64).reshape(-1, dim) for i in (1, 2)]
                turned = [_unit(x) @ basis for x in raw]
                alone = one["same"][0].as_py()
                shift = 0 if alone else len(ids[0])
                total = np.zeros(shift + len(ids[1]), np.int64)
                forest = Forest(len(total))
                for x, y in compare(*raw, *turned, alone, threshold):
                    total += np.bincount(x, n[1][y], len(total)).astype(np.int64) + np.bincount(y + shift, n[0][x], len(total)).astype(np.int64)
                    forest.link(x, y + shift)
                own = ids[0] if alone else np.concatenate(ids)
                hit = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(own[hit]), pa.array(total[hit]), pa.array(own[forest.label[hit]])], ["c", "links", "root"])

    return work.mapInArrow(run, "c long, links long, root long")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of `vectors` (vec_id, embedding; other columns ignored).

    Null, zero and empty vectors and those with null or non-finite components link with nothing; vectors of different
    lengths do not link. Rows with equal vectors (repeated rows too) link with each other. Null vec_ids count as
    vectors but name a component only if all its ids are null. Empty table: no rows."""
    rows = stored(vectors.select("vec_id", "embedding").withColumn("_row", F.monotonically_increasing_id()))
    able = usable(rows)
    classes = stored(able.groupBy("embedding").agg(F.min("_row").alias("c"), F.count("*").alias("n"), F.min("vec_id").alias("first")))
    dims = [r[0] for r in classes.select(F.size("embedding")).distinct().collect()]
    found = None
    for dim in sorted(dims):
        own = class_links(classes.filter(F.size("embedding") == dim), dim, threshold)
        found = own if found is None else found.union(own)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "c long, links long, root long")
    found = stored(found)
    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    label = components(found.select("c", "root").filter("c <> root")).select(F.col("node").alias("c"), "component")
    known = classes.select("c", "n", "first").join(links, "c", "left").join(label, "c", "left").withColumn("component", F.coalesce("component", "c"))
    known = stored(known)
    least = known.groupBy("component").agg(F.min("first").alias("component_id"))
    # stored, so that the joins below read straight from shuffles and can split a vector of many copies
    of = stored(known.join(least, "component").select("c", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"))
    member = able.select("_row", "embedding").join(classes.select("embedding", "c"), "embedding").select("_row", "c").join(of, "c")
    out = rows.select("vec_id", "_row").join(member, "_row", "left")
    component = F.when(F.col("c").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: links and component of every vector; edge cases as in `near_vectors`."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP8_SQL = f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS u, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS MATERIALIZED (SELECT u, list_transform(e, lambda x: coalesce(x, 0)) AS e FROM v WHERE len(e) > 0 AND list_bool_and(list_transform(e, lambda x: coalesce(isfinite(x), false))) AND list_bool_or(list_transform(e, lambda x: coalesce(x <> 0, false)))),
l AS (SELECT a.u AS a, b.u AS b FROM ok a JOIN ok b ON a.u < b.u AND CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= {THRESHOLD} ELSE false END),
d AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), n AS (SELECT a AS u, count(*) AS n FROM d GROUP BY 1),
r(u, w) AS (SELECT u, u FROM ok UNION SELECT r.u, d.b FROM r JOIN d ON d.a = r.w),
c AS (SELECT r.u, min(v.vec_id) AS component_id FROM r JOIN v ON v.u = r.w GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0) AS n_links, CASE WHEN c.u IS NULL THEN vec_id ELSE component_id END AS component_id,
       vec_id IS NOT DISTINCT FROM CASE WHEN c.u IS NULL THEN vec_id ELSE component_id END AS kept
FROM v LEFT JOIN n USING (u) LEFT JOIN c USING (u)
"""
