"""Operators against brute force: distribution tests, communities, layouts, bridges, cubes and graph edits."""

import collections
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import boolean as b
from tesserae.operators import compare, graphs, matrix, vectors


def brute_tail(n1, n2, gap, two):
    hit = total = 0
    for own in itertools.combinations(range(n1 + n2), n1):
        x = y = most = 0
        for i in range(n1 + n2):
            x, y = (x + 1, y) if i in own else (x, y + 1)
            g = x / n1 - y / n2
            most = max(most, abs(g) if two else g)
        total += 1
        hit += most >= gap - 1e-12
    return hit / total


def test_smirnov_tails_equal_all_orders():
    for n1, n2 in ((3, 4), (5, 5), (6, 3)):
        for d in (1 / 3, 0.5, 0.8, 1.0):
            gap = round(d * n1 * n2) / (n1 * n2)
            for alternative in ("two-sided", "greater"):
                assert compare.smirnov_p(n1, n2, gap, alternative) == pytest.approx(brute_tail(n1, n2, gap, alternative == "two-sided"))
    exact = compare.smirnov_p(10_000, 6_000, 0.03)
    assert compare.smirnov_p(10_001, 6_000, 0.03) == pytest.approx(exact, rel=0.03)
    assert 0 < compare.smirnov_p(400, 300, 0.9) < 1e-100


def test_smirnov_tests_by_hand(spark):
    rng = random.Random(1)
    cells = [(i, "abc"[i % 3]) for i in range(30)]
    values = [(i, g, float(rng.randint(1, 4))) for i, _ in cells for g in ("x", "y") if rng.random() < 0.6]
    x = spark.createDataFrame(values, "cell int, gene string, value double")
    obs = spark.createDataFrame(cells, "cell int, kind string")
    var = spark.createDataFrame([("x",), ("y",), ("z",)], "gene string")
    full = {(i, g): 0.0 for i, _ in cells for g in "xyz"} | {(i, g): v for i, g, v in values}
    for reference, alternative in (("rest", "two-sided"), ("b", "greater"), ("b", "less")):
        got = {(r.gene, r.grp): r for r in compare.smirnov_tests(x, obs, "kind", var, reference, alternative, correction="bonferroni").collect()}
        assert len(got) == (9 if reference == "rest" else 6)
        for (gene, grp), r in got.items():
            a = [full[i, gene] for i, k in cells if k == grp]
            o = [full[i, gene] for i, k in cells if (k != grp if reference == "rest" else k == reference)]
            gaps = [(sum(v <= t for v in a) / len(a) - sum(v <= t for v in o) / len(o), t) for t in sorted(set(a + o))]
            up, down = max(g for g, _ in gaps), min(g for g, _ in gaps)
            want = {"two-sided": max(up, -down), "greater": max(up, 0), "less": max(-down, 0)}[alternative]
            assert r.statistic == pytest.approx(want) and r.adjusted == pytest.approx(min(1, 3 * r.p))
            assert r.p == pytest.approx(compare.smirnov_p(len(a), len(o), want, alternative))


def planted(seed=0, groups=6, size=40):
    rng = np.random.default_rng(seed)
    n = groups * size
    label = np.repeat(np.arange(groups), size)
    i, j = np.triu_indices(n, 1)
    keep = rng.random(len(i)) < np.where(label[i] == label[j], 0.3, 0.01)
    return label, [(int(a), int(c), 1.0) for a, c in zip(i[keep], j[keep])]


@pytest.mark.parametrize("refine", [False, True])
def test_communities_find_planted_groups(spark, refine):
    label, edges = planted()
    got = {r.node: r.community for r in vectors.communities(spark.createDataFrame(edges, "i long, j long, weight double"), refine=refine).collect()}
    assert len(got) == len(label) and len(set(got.values())) == 6
    for c in set(got.values()):
        own = collections.Counter(label[n] for n, x in got.items() if x == c)
        assert own.most_common(1)[0][1] >= 0.95 * sum(own.values())


def test_refined_communities_are_connected():
    """Local moves alone may leave a community whose parts meet only outside it; refined parts never do."""
    rng = np.random.default_rng(3)
    n = 80
    i, j = np.triu_indices(n, 1)
    keep = rng.random(len(i)) < 0.05
    g = vectors.Sparse(n, i[keep], j[keep], np.ones(keep.sum()))
    for seed in range(5):
        own = np.arange(n) % 4
        part = vectors._refined(g, own, 1.0, np.random.default_rng(seed))
        for p in np.unique(part):
            inside = set(np.flatnonzero(part == p).tolist())
            assert len({own[v] for v in inside}) == 1
            seen, stack = set(), [min(inside)]
            while stack:
                v = stack.pop()
                if v not in seen:
                    seen.add(v)
                    stack += [u for u in g.to[g.starts[v] : g.starts[v + 1]].tolist() if u in inside]
            assert seen == inside


def test_sparse_eigenvectors_equal_dense_ones(monkeypatch):
    label, edges = planted(1)
    i, j, w = (np.array(x) for x in zip(*edges))
    g = vectors.Sparse(len(label), i, j, w)
    dense, _ = vectors.eigenvectors(g, 3)
    monkeypatch.setattr(vectors, "DENSE", 10)
    power, _ = vectors.eigenvectors(g, 3)
    assert np.abs(np.abs((dense * power).sum(axis=0)) - 1).max() < 1e-3


def test_layout_curve_and_separation(spark):
    assert vectors.curve(0.1, 1.0) == pytest.approx((1.5769, 0.8951), abs=1e-3)
    label, edges = planted(2, 3, 40)
    rows = vectors.umap(spark.createDataFrame(edges, "i long, j long, weight double"), min_dist=0.1).collect()
    at = {r.node: np.array([r.x, r.y]) for r in rows}
    center = [np.mean([at[n] for n in range(len(label)) if label[n] == c], axis=0) for c in range(3)]
    near = sum(np.argmin([np.linalg.norm(at[n] - c) for c in center]) == label[n] for n in range(len(label)))
    assert near > 0.9 * len(label)


def test_closest_between_parts(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 10)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(45, 3)) + np.repeat([[0, 0, 0], [9, 0, 0], [0, 9, 0]], 15, axis=0)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    parts = spark.createDataFrame([(k, 15 * (k // 15)) for k in range(45)], "node long, part long")
    for metric in ("euclidean", "cityblock"):
        got = sorted((r.i // 15, r.j // 15, r.distance) for r in vectors.closest_between(df, "id", "v", parts, metric).collect())
        d = vectors.distances(x, x, metric)
        want = sorted((*sorted((p, q)), d[15 * p : 15 * p + 15, 15 * q : 15 * q + 15].min()) for p, q in itertools.combinations(range(3), 2))
        assert [(min(a, c), max(a, c)) for a, c, _ in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want])


def test_small_clusters_have_no_barycenter(spark):
    rng = np.random.default_rng(6)
    rows = [(k, rng.normal(size=2).tolist(), "a" if k < 20 else "b" if k < 39 else "lone") for k in range(40)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label string")
    labels = df.selectExpr("id as node", "label as grp")
    assert {r.grp: r.n for r in vectors.cluster_counts(labels).collect()} == {"a": 20, "b": 19, "lone": 1}
    assert vectors.large_clusters(labels, 2).filter("grp is null").count() == 1
    got = vectors.knnsc_distances(df, "id", "v", "label", 4, "cityblock", min_cluster_size=2)
    assert {r.source for r in got.select("source").distinct().collect()} == {"a", "b"}
    assert got.filter("d < 0").count() == 0 and got.count() == 80


def test_empty_tables_of_vectors(spark):
    none = spark.createDataFrame([], "id long, v array<double>")
    assert vectors.pca(none, "id", "v", 2).count() == 0 and vectors.kmeans(none, "id", "v", 3).count() == 0


def masks(spark, rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "cube int, fixed_mask long, value_mask long")


def random_masks(seed, n=6, count=40):
    rng = random.Random(seed)
    return [(f, rng.getrandbits(n) & f) for f in (rng.getrandbits(n) for _ in range(count))]


def test_extreme_cubes_equal_all_pairs(spark):
    rows = random_masks(1)
    inside = lambda a, c: a != c and a[0] & c[0] == c[0] and a[1] & c[0] == c[1]  # noqa: E731  a inside c
    df = masks(spark, rows)
    assert {r.cube for r in b.maximal(df).collect()} == {k for k, a in enumerate(rows) if not any(inside(a, c) for c in rows)}
    assert {r.cube for r in b.minimal(df).collect()} == {k for k, a in enumerate(rows) if not any(inside(c, a) for c in rows)}


def test_compressed_cubes_hold_the_same_states_in_fewer_pieces(spark):
    rng = random.Random(2)
    states = sorted({rng.getrandbits(5) for _ in range(22)})
    got = [(r.fixed_mask, r.value_mask) for r in b.compress(masks(spark, [(31, s) for s in states]), 5).collect()]
    spelled = [s for f, v in got for s in range(32) if s & f == v]
    assert sorted(spelled) == states and len(got) < len(states)


def test_draws_are_uniform_over_cubes_of_all_sizes(spark):
    df = masks(spark, [(0b111000, 0b001000), (0b111111, 0b111111), (0b110000, 0b010000)])
    got = collections.Counter(r.state for r in b.sample(df, 6, 5000).collect())
    assert sum(got.values()) == 5000 and len(got) == 8 + 1 + 16
    assert all(120 < k < 300 for k in got.values())


def test_collections_of_cubes(spark):
    rows = random_masks(3, count=20)
    df, new = masks(spark, rows), masks(spark, [(63, 1), rows[0]])
    assert b.with_cubes(df, new).count() == len({*rows, (63, 1)}) and b.without_cubes(df, new).count() == len({*rows} - {(63, 1), rows[0]})
    assert b.has_cube(df, *rows[0]).first()[0] and not b.has_cube(df.limit(0), 0, 0).first()[0]
    assert b.same_collections(df, df).first()["equal"] and not b.same_collections(df, new).first()["equal"]
    assert {r.cube for r in b.around(df, 7, 5).collect()} == {k for k, (f, v) in enumerate(rows) if f & 7 == f and 5 & f == v}


def test_weighted_medians_and_equal_batches(spark):
    rows = [("b1", "g1", 10, 1.0, 3.0), ("b1", "g2", 10, 1.0, 2.0), ("b1", "g3", 10, 1.0, 1.0), ("b2", "g1", 90, 1.0, 1.0), ("b2", "g2", 90, 1.0, 2.0), ("b2", "g3", 90, 1.0, 3.0), ("b3", "g4", 5, 1.0, None)]
    df = spark.createDataFrame(rows, "batch string, gene string, n_obs long, mean double, score double")
    equal = {r.gene: r for r in matrix.hvg_batches(df, 3).collect()}
    cells = {r.gene: r for r in matrix.hvg_batches(df, 3, "rank", "cell_count").collect()}
    assert equal["g1"].rank == 2.0 and equal["g1"].score == 2.0 and cells["g1"].rank == 3.0 and cells["g1"].score == pytest.approx(1.2)
    assert cells["g3"].rank == 1.0 and equal["g4"].score is None and [r.gene for r in matrix.hvg_batches(df, 3, "rank", "cell_count").collect()][0] == "g3"
    with pytest.raises(ValueError):
        matrix.hvg_batches(df, 3, weighting="other")


def test_medians_of_sparse_genes(spark):
    rng = random.Random(8)
    x = [(c, g, float(rng.randint(-3, 5) or 1)) for g, k in (("a", 3), ("b", 8), ("c", 11)) for c in rng.sample(range(11), k)]
    df = spark.createDataFrame(x, "cell int, gene string, value double")
    obs = spark.createDataFrame([(c,) for c in range(11)], "cell int")
    for r in matrix.sparse_median_mad(df, obs).collect():
        full = np.zeros(11)
        for c, g, v in x:
            if g == r.gene:
                full[c] = v
        assert r.median == np.median(full) and r.mad == np.median(np.abs(full - np.median(full)))


def test_graph_edits(spark):
    e = spark.createDataFrame([("a", "b", 1), ("b", "a", 1), ("b", "c", -1)], "source string, target string, sign int")
    assert graphs.to_undirected(e).count() == 2 and graphs.to_directed(e.union(e)).count() == 3
    assert graphs.update_edges(e, spark.createDataFrame([("a", "b", 1), ("c", "a", -1)], e.schema)).count() == 4
    w = spark.createDataFrame([("a", "b", 0.5), ("a", "c", -2.0), ("a", "d", 0.0)], "source string, target string, weight double")
    assert {(r.target, r.sign) for r in graphs.weighted_edges(w).collect()} == {("b", 1), ("c", -1)}
    agg = graphs.aggregate_graphs(e.crossJoin(spark.createDataFrame([(1,), (2,)], "g int")), "g")
    more = graphs.update_aggregated(agg, graphs.aggregate_graphs(e.limit(1).selectExpr("*", "7 as g"), "g"))
    assert {r["count"] for r in more.collect()} == {2, 3} and {r.total for r in more.collect()} == {3}


def test_loess_of_batches_equals_each_batch_apart(spark):
    rng = np.random.default_rng(4)
    obs = spark.createDataFrame([(c, "ab"[c % 2]) for c in range(40)], "cell long, kind string")
    rows = [(c, f"g{g}", float(v)) for g in range(25) for c, v in enumerate(rng.poisson(0.5 + g / 3, 40)) if v]
    x = spark.createDataFrame(rows, "cell long, gene string, value double")
    both = {(r.batch, r.gene): (r.n_obs, r.score) for r in matrix.hvg_loess(x, obs, 0.5, batch="kind").collect()}
    for kind in "ab":
        own = obs.filter(f"kind = '{kind}'")
        alone = {r.gene: r.score for r in matrix.hvg_loess(x.join(own.select("cell"), "cell"), own, 0.5).collect()}
        assert alone and {g: s for (k, g), (_, s) in both.items() if k == kind} == pytest.approx(alone)
    assert {n for n, _ in both.values()} == {20}


def test_scaled_representations(spark):
    x = np.random.default_rng(7).normal(size=(30, 4)) * [1, 5, 0, 2]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    sd = np.where(x.std(axis=0, ddof=1) > 0, x.std(axis=0, ddof=1), 1)
    got = {r.id: r.components for r in vectors.scaled_representation(df, "id", "v").collect()}
    assert np.allclose([got[k] for k in range(30)], (x - x.mean(axis=0)) / sd)
    plain = {r.id: r.components for r in vectors.scaled_representation(df, "id", "v", False, 1.0).collect()}
    assert np.allclose([plain[k] for k in range(30)], np.clip(x / sd, -1, 1))


def test_a_mean_at_the_bound_is_not_above_it(spark, tmp_path):
    """Decimal values of mean 50 whose doubles, added one by one, end above their sum."""
    from tesserae.functions.columns import mean_above
    from tesserae.plans.boolean_queries import _cubes

    rng, near = random.Random(3), []
    while len(near) < 5:  # groups of mean 50 whose doubles, in this order, add up to more
        v = [rng.randrange(2100, 9000) / 100 for _ in range(11)]
        v.append(round(600 - sum(v), 2))
        if 20 < v[-1] < 500 and list(itertools.accumulate(v))[-1] > 600:
            near.append(v)
    rows = [(u, "view", x) for u, v in enumerate(near) for x in v] + [(9, "view", x) for x in [50.0] * 11 + [50.01]]
    spark.createDataFrame(rows, "user_id long, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = {q.cell: q.value for q in _cubes(spark, str(tmp_path)).collect()}
    assert got == {0: False, 1: False, 2: False, 3: False, 4: False, 9: True}
    odd = [("inf", float("inf")), ("inf", 1.0), ("nan", float("nan")), ("fine", 1e-30), ("fine", 60.0), ("large", 1e300), ("large", -1e299), ("none", None), ("less", 49.99), ("less", None)]
    over = spark.createDataFrame(odd, "k string, v double").groupBy("k").agg(mean_above(F.col("v"), 50).alias("m"))
    assert {q.k: q.m for q in over.collect()} == {"inf": True, "nan": True, "fine": False, "large": True, "none": None, "less": False}


def test_nearest_neighbours_by_products_equal_brute_force(spark, monkeypatch):
    """Far from the origin, with equal vectors, in more tiles than one; squares that overflow count as no neighbours."""
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(300, 5)), 1) * 1e-3 + 1e4
    x[40:60] = x[0]
    monkeypatch.setattr(vectors, "TILE", 7)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    assert vectors._tiles(frame, "id", "v").count() <= vectors.SIDE  # not one a seven vectors
    for metric in ("euclidean", "sqeuclidean", "cityblock"):
        d = vectors.distances(x, x, metric)
        np.fill_diagonal(d, np.inf)
        got = {(q.i, q.rank): (q.j, q.distance) for q in vectors.knn(frame, "id", "v", 6, metric).collect()}
        for i in range(len(x)):
            best = np.argsort(d[i], kind="stable")[:6]
            assert [got[i, r + 1] for r in range(6)] == [(j, d[i, j]) for j in best]
    huge = spark.createDataFrame([(0, [1e200, 0.0]), (1, [1e200, 1e150]), (2, [0.0, 1.0]), (3, [0.0, 3.0])], "id long, v array<double>")
    assert {(q.i, q.j) for q in vectors.knn(huge, "id", "v", 2).collect()} == {(0, 1), (1, 0), (2, 3), (3, 2)}


def test_candidates_hold_the_nearest_of_wide_blocks():
    rng = np.random.default_rng(6)
    y, x = rng.normal(size=(3000, 4)), rng.normal(size=(50, 4))
    y[100:200] = y[0]
    x[0] = y[0]
    ids = rng.permutation(3000).astype(np.int64)
    got = {}
    for i, j, d in vectors._nearest(np.arange(50), x, ids, y, 5, "euclidean", False):
        for q in zip(i, j, d):
            got.setdefault(int(q[0]), []).append((q[2], int(q[1])))
    d = vectors.distances(x, y, "euclidean")
    assert all(got[i] == sorted((d[i, c], int(ids[c])) for c in range(3000))[:5] for i in range(50))


def test_loess_fits_a_mean_once(spark):
    """Genes of equal means share a fit, which is that of all genes fitted one by one. Where one mean
    holds more genes than the span, all of them count, not whichever come first."""
    rng = np.random.default_rng(2)
    cells, genes = 40, 300
    x = rng.poisson(np.repeat([1.0, 2.0, 3.0], 100), size=(cells, genes)).astype(float)
    frame = spark.createDataFrame([(f"c{i}", f"g{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x))], "cell string, gene string, value double")
    obs = spark.createDataFrame([(f"c{i}",) for i in range(cells)], "cell string")
    got = {r.gene: r.expected for r in matrix.hvg_loess(frame, obs, 0.5).collect()}
    a, b = np.log10(x.mean(axis=0)), np.log10(x.var(axis=0, ddof=1))
    assert len(set(a)) < genes / 2
    for i in range(genes):
        d = np.abs(a - a[i])
        k = int(np.ceil(0.5 * genes))
        h = np.sort(d)[k - 1]
        w = np.clip(1 - (d / h) ** 3, 0, None) ** 3
        basis = np.stack([np.ones(genes), a - a[i], (a - a[i]) ** 2])
        assert got[f"g{i}"] == pytest.approx(10 ** np.linalg.lstsq(basis * w @ basis.T, basis @ (w * b), rcond=1e-12)[0][0], rel=1e-6)
    spread = [(f"c{c}", f"g{g}", float(v)) for g in range(20) for c, v in enumerate((10 + g, 40 - g))]
    two = obs.filter("cell in ('c0', 'c1')")
    level = np.mean([np.log10((30 - 2 * g) ** 2 / 2) for g in range(20) if g != 15])
    same = matrix.hvg_loess(spark.createDataFrame(spread, "cell string, gene string, value double"), two, 0.3).collect()
    assert len(same) == 19 and all(r.expected == pytest.approx(10**level) for r in same)


def test_trade_carries_numbers_and_is_joined_once(spark, monkeypatch):
    """What the joins of order lines shuffle has no names; a query that needs the yearly graphs twice computes them once."""
    from tesserae.plans import graph_queries as q

    plan = q._trade(spark, "/root/testdata/sf0.001", True)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(k for k, at in enumerate(plan) if "Join Inner" in at and "orderkey" in at)
    depth = lambda at: len(at) - len(at.lstrip(" :+-"))
    under = [at for k, at in enumerate(plan) if k > join and all(depth(x) > depth(plan[join]) for x in plan[join + 1 : k + 1])]
    assert under and not any("n_name" in at for at in under)
    calls, yearly = [], q._yearly
    monkeypatch.setattr(q, "_yearly", lambda *a: calls.append(a) or yearly(*a))
    assert q.graph_distance_given(spark, "/root/testdata/sf0.001").count() == 1 and len(calls) == 1


def test_paths_and_parts_in_one_task_equal_rounds(spark, monkeypatch):
    rng = np.random.default_rng(9)
    ties = {(int(a), int(b)) for a, b in rng.integers(0, 90, (110, 2)) if a != b}
    edges = spark.createDataFrame([(a, b, float(rng.random())) for a, b in sorted(ties)], "i long, j long, distance double")
    starts = spark.createDataFrame([("x", 3, 0.25), ("x", 4, 0.5), ("x", 3, 0.125), ("y", 50, 0.0), ("z", 700, 1.0)], "source string, node long, d double")
    nodes = spark.range(95).select(F.col("id").alias("node"))
    none = starts.filter("node < 0")

    def run():
        pairs = edges.select("i", "j")
        return [sorted(map(tuple, f.collect())) for f in (vectors.shortest_paths(edges, starts), vectors.shortest_paths(edges, none), vectors.graph_parts(pairs, nodes), vectors.graph_parts(pairs.limit(0), nodes.limit(0)))]

    one = run()
    monkeypatch.setattr(vectors, "TASK_EDGES", -1)
    assert one == run() and len({p for _, p in one[2]}) > 5 and ("x", 3, 0.125) in one[0]


def test_neighbour_search_is_done_once(spark):
    """Whatever reads the edges, several times or to count nodes, reads a finished table."""
    frame = spark.createDataFrame([(i, [float(i * i % 17), float(i)]) for i in range(40)], "id long, v array<double>")
    assert "MapInArrow" not in vectors.knn(frame, "id", "v", 3)._jdf.queryExecution().optimizedPlan().toString()
    plan = vectors.fuzzy_connectivity(vectors.knn(frame, "id", "v", 3), 4)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_tsne_by_blocks_equals_all_pairs_in_one_task(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 6)) + 4 * np.arange(150)[:, None] // 50
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").coalesce(1)
    one = np.array(sorted(map(tuple, vectors.tsne(frame, "id", "v", n_iter=10).collect())))
    monkeypatch.setattr(vectors, "DENSE_TSNE", 10)
    blocks = np.array(sorted(map(tuple, vectors.tsne(frame, "id", "v", n_iter=10).collect())))
    assert np.abs(one - blocks).max() < 1e-8  # later rounds carry rounding on
    monkeypatch.undo()
    many = spark.range(3100).select("id", F.array(F.sin("id"), F.cos("id"), F.col("id") / 1000).alias("v"))
    assert vectors.tsne(many, "id", "v", n_iter=2).count() == 3100
