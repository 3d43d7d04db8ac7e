"""Operators on small fixtures with values known by hand or by plain Python."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import rules as r
from tesserae.operators import boolean, compare, dynamics, genes, graphs, matrix, vectors


def long(spark, rows, cells, genes_):
    data = [(c, g, float(v)) for c, row in zip(cells, rows) for g, v in zip(genes_, row) if v]
    x = spark.createDataFrame(data, "cell string, gene string, value double")
    return x, spark.createDataFrame([(c,) for c in cells], "cell string"), spark.createDataFrame([(g,) for g in genes_], "gene string")


def test_qc_of_a_small_matrix(spark):
    m = np.array([[1, 0, 2, 3], [0, 4, 2, 0], [2, 3, 1, 2]], float)
    x, obs, var = long(spark, m, ["a", "b", "c"], ["g1", "g2", "g3", "g4"])
    flag = spark.createDataFrame([("g1",), ("g3",)], "gene string")
    got = {q.cell: q for q in matrix.qc_obs(x, obs, (1, 2), {"mito": flag}).collect()}
    assert [got[c].n_features for c in "abc"] == [3, 2, 4] and [got[c].total for c in "abc"] == [6, 6, 8]
    assert [got[c].pct_top1 for c in "abc"] == pytest.approx([50, 100 * 4 / 6, 37.5])
    assert [got[c].pct_mito for c in "abc"] == pytest.approx([50, 100 * 2 / 6, 37.5])
    per = {q.gene: q for q in matrix.qc_var(x, obs, var).collect()}
    for k, g in enumerate(["g1", "g2", "g3", "g4"]):
        col = m[:, k]
        assert per[g].median == np.median(col) and per[g].mad == np.median(abs(col - np.median(col)))
        assert per[g].variance == pytest.approx(col.var(ddof=1)) and per[g].pct_dropout == pytest.approx(100 * (col == 0).mean())


def test_median_counts_implicit_zeros_and_negatives(spark):
    rng = np.random.default_rng(0)
    m = rng.integers(-3, 4, (9, 12)) * (rng.random((9, 12)) < 0.6)
    x, obs, _ = long(spark, m, [f"c{i}" for i in range(9)], [f"g{i}" for i in range(12)])
    got = {q.gene: (q.median, q.mad) for q in matrix.sparse_median_mad(x, obs).collect()}
    for k in range(12):
        if m[:, k].any():
            med = np.median(m[:, k])
            assert got[f"g{k}"] == (med, np.median(abs(m[:, k] - med)))


def test_normalize_and_scale(spark):
    m = np.array([[1, 0, 3], [2, 2, 0], [0, 3, 1], [4, 0, 2]], float)
    x, obs, var = long(spark, m, list("abcd"), ["g1", "g2", "g3"])
    got = {(q.cell, q.gene): q.value for q in matrix.normalize(x, 10).collect()}
    assert got["a", "g3"] == pytest.approx(7.5)
    z = {(q.cell, q.gene): q.value for q in matrix.scale(x, obs, var).collect()}
    want = (m - m.mean(0)) / m.std(0, ddof=1)
    assert all(z[c, g] == pytest.approx(want[i, j]) for i, c in enumerate("abcd") for j, g in enumerate(["g1", "g2", "g3"]))
    with pytest.raises(ValueError):
        matrix.log1p(x, 1)


def ranks(v):
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def test_rank_and_moment_tests_equal_dense_formulas(spark):
    rng = np.random.default_rng(3)
    m = rng.integers(0, 4, (14, 5)).astype(float)
    groups = ["A"] * 5 + ["B"] * 6 + ["C"] * 2 + [None]
    cells = [f"c{i}" for i in range(14)]
    x, _, var = long(spark, m, cells, [f"g{k}" for k in range(5)])
    obs = spark.createDataFrame(list(zip(cells, groups)), "cell string, grp string")
    w = {(q.gene, q.grp): q for q in compare.wilcoxon(x, obs, "grp", var).collect()}
    t = {(q.gene, q.grp): q for q in compare.student_two_sided(compare.welch(x, obs, "grp", var)).collect()}
    for k, g in itertools.product(range(5), "ABC"):
        mine = np.array([h == g for h in groups])
        rk, n1, n = ranks(m[:, k]), mine.sum(), 14
        n2 = n - n1
        ties = sum(c**3 - c for c in np.unique(m[:, k], return_counts=True)[1])
        sd = math.sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1))))
        u = rk[mine].sum() - n1 * (n1 + 1) / 2
        q = w[f"g{k}", g]
        assert (q.u, q.z) == pytest.approx((u, (u - n1 * n2 / 2) / sd)) and q.p == pytest.approx(math.erfc(abs(q.z) / math.sqrt(2)), abs=1e-12)
        a, b = m[mine, k], m[~mine, k]
        se = a.var(ddof=1) / n1 + b.var(ddof=1) / n2
        assert t[f"g{k}", g].t == pytest.approx((a.mean() - b.mean()) / math.sqrt(se) if se else 0)


def test_student_p_values(spark):
    # known values: t(1) is Cauchy, t(2) has a closed form
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (-2.0, 2.0), (0.0, 7.0), (50.0, 30.0)], "t double, df double")
    got = [q.p for q in compare.student_two_sided(df).collect()]
    assert got[:4] == pytest.approx([0.5, 1 - 2 / math.sqrt(6), 1 - 2 / math.sqrt(6), 1.0]) and got[4] < 1e-25


def test_adjustments(spark):
    ps = [0.01, 0.04, 0.03, None, 0.2]
    df = spark.createDataFrame([("a", p, i) for i, p in enumerate(ps)], "grp string, p double, i int")
    got = [q.adjusted for q in compare.bh_adjust(df, "p", ["grp"]).orderBy("i").collect()]
    assert got == [pytest.approx(v) if v is not None else None for v in (0.04, 0.16 / 3, 0.16 / 3, None, 0.2)]
    got = [q.adjusted for q in compare.bonferroni_adjust(df, "p", ["grp"]).orderBy("i").collect()]
    assert got == [pytest.approx(v) if v is not None else None for v in (0.04, 0.16, 0.12, None, 0.8)]


def edges(spark, text):
    rows = [(a, b, 1 if s == "+" else -1) for a, s, b in (e.split() for e in text.split(","))]
    return spark.createDataFrame(rows, "source string, target string, sign int")


def test_walk_scores_of_a_small_graph(spark):
    g = edges(spark, "A + D,A + B,B + D,A + C,C - D")
    q = graphs.walk_scores(g, 2).filter("source = 'A' and target = 'D'").first()
    assert (q.paths, q.score, q.total) == (3, 1.0, 1.5) and q.normalized == pytest.approx(2 / 3)
    assert {(e.source, e.target) for e in graphs.infer_interactions(graphs.walk_scores(g, 2)).collect()} == {("A", "B"), ("A", "C"), ("B", "D"), ("C", "D")}


def test_distances_of_two_graphs(spark):
    a, b = edges(spark, "A + B,B - C"), edges(spark, "A + B,C + D")
    q = graphs.graph_distance(a, b).first()
    assert q.distance == pytest.approx(2 / 3) and q.similarity == pytest.approx(1 / 3)
    assert graphs.graph_distance(a, b, "complete").first().size == 32
    assert graphs.graph_distance(a.limit(0), b.limit(0)).first().similarity == 1
    with pytest.raises(Exception, match="loops"):
        graphs.graph_distance(edges(spark, "A + A"), b, "loopless").collect()


def test_families_feedback_and_paths(spark):
    g = edges(spark, "TF + g1,TF + g2,g1 - out,g2 - out")
    fam = graphs.structural_families(g)
    assert [f.family for f in fam.collect()] == ["g1|g2"]
    assert {(e.source, e.target, e.sign) for e in graphs.family_collapsed(g, fam).collect()} == {("TF", "g1|g2", 1), ("g1|g2", "out", -1)}
    f = edges(spark, "A + B,B + A,B + C,C + C")
    assert {(q.node, q.scc) for q in graphs.feedback_components(f).collect()} == {("A", "A"), ("B", "A"), ("C", "C")}
    assert {q.node for q in graphs.feedback_components(f, False).collect()} == {"A", "B"}
    p = edges(spark, "A + B,B - C,C + D")
    path = spark.createDataFrame([(["A", "B", "C", "D"],)], "path array<string>")
    assert graphs.path_sign(p, path).first().text == "A -> B -| C -> D"
    m = edges(spark, "marker1 + A,A + B,B + C,C + A,C + D,D + E,E + D,E + marker2,D + marker2")
    got = {(q.scc, tuple(q.path)) for q in graphs.marker_paths(m, ["marker2"]).collect()}
    assert got == {("A", ("C", "D", "marker2")), ("D", ("E", "marker2")), ("D", ("D", "marker2"))}


def test_strong_components_alike_on_driver_and_cluster(spark, monkeypatch):
    rng = random.Random(8)
    rows = {(f"n{rng.randint(0, 25)}", f"n{rng.randint(0, 25)}") for _ in range(40)}
    g = spark.createDataFrame([(a, b, 1) for a, b in rows], "source string, target string, sign int")
    here = {(q.node, q.scc) for q in graphs.strong_components(g).collect()}
    monkeypatch.setattr(graphs, "DRIVER_EDGES", 1)
    assert {(q.node, q.scc) for q in graphs.strong_components(g).collect()} == here


def test_edge_tables_are_checked(spark):
    t = spark.createDataFrame([("A", "B", "1", "high"), ("B", "C", "-1", "low"), ("C", "A", None, "unknown")], "source string, target string, sign string, confidence string")
    assert {(q.source, q.sign, q.confidence) for q in graphs.from_table(t).collect()} == {("A", 1, "high"), ("B", -1, "low")}
    with pytest.raises(ValueError):
        graphs.from_table(t.union(t))


def test_rules():
    tree = r.parse("A & ~B | !(C ^ D) & (A | B)")
    order = r.symbols(tree)
    env = lambda s: {n: bool(s >> i & 1) for i, n in enumerate(order)}
    want = [eval("(A and not B) or (not (C ^ D) and (A or B))", {}, env(s)) for s in range(16)]  # noqa: S307
    assert r.table(tree, order).tolist() == want
    assert r.equivalent(tree, r.parse(r.to_text(tree))) and r.Diagram(tree).count() == sum(want)
    assert r.equivalent(r.simplify(r.parse("(A | 0) & ~~B | A & ~A")), r.parse("A & B"))
    primes = r.prime_implicants(r.parse("A & B | ~A & C"))
    assert {tuple(sorted(p.items())) for p in primes} == {(("A", True), ("B", True)), (("A", False), ("C", True)), (("B", True), ("C", True))}
    assert len(r.dnf_implicants(r.parse("A & B | ~A & C"))) == 2
    assert r.prime_implicants(r.parse("A | ~A")) == [{}] and r.prime_implicants(r.parse("A & ~A")) == []
    assert r.signs(r.parse("A & ~B | A & C")) == {"A": {1}, "B": {-1}, "C": {1}}
    for bad in ("A &", "A B", "(A", "A $ B"):
        with pytest.raises(ValueError):
            r.parse(bad)


def test_dynamics_of_a_small_network(spark):
    net = dynamics.Network({"A": "B", "B": "A", "C": "~C", "D": "(A & ~C) | D"})
    f = net.images().tolist()
    start = spark.createDataFrame([(0,), (2,), (4,), (6,)], "state long")
    for update in dynamics.UPDATES:
        after = {s: set() for s in range(16)}
        for s in range(16):
            u = s ^ f[s]
            after[s] = {f[s]} if update == "synchronous" else {s ^ m for m in range(1, 16) if m & u == m and (update == "general" or bin(m).count("1") == 1)}
        seen, todo = set(), [0, 2, 4, 6]
        while todo:
            s = todo.pop()
            if s not in seen:
                seen.add(s)
                todo += after[s]
        assert {q.state for q in dynamics.reachable(start, net, update).collect()} == seen
    with pytest.raises(ValueError):
        dynamics.Network({"A": "B"})


def test_kleene_and_votes(spark):
    values = [True, None, False]
    df = spark.createDataFrame(list(itertools.product(values, values)), "a boolean, b boolean")
    order = {False: 0, None: 1, True: 2}
    for q in df.select("a", "b", boolean.kleene_diff(F.col("a"), F.col("b")).alias("d"), boolean.includes(F.col("a"), F.col("b")).alias("i")).collect():
        assert q.d == (order[q.b] > order[q.a]) - (order[q.b] < order[q.a])
        assert q.i == ({q.a} <= {q.b} if q.a is not None and q.b is not None else q.b is None)


def test_sampling_is_inside_the_set(spark):
    masks = spark.createDataFrame([("x", 0b011, 0b001), ("y", 0b111, 0b110)], "cube string, fixed_mask long, value_mask long")
    got = {q.state for q in boolean.sample(masks, 3, 200).collect()}
    assert got == {0b001, 0b101, 0b110}
    assert boolean.configuration_count(masks, 3).first().n_configurations == 3
    assert {q.state for q in boolean.subtract(masks, masks.filter("cube = 'y'"), 3).collect()} == {1, 5}


def test_alias_priorities(spark):
    rows = [(1, "1", "-", "Off1", ["Alias1"], "protein-coding"), (2, "2", "Ref1", "Ref1", ["Alias2", "Off1"], "pseudo"), (3, "3", "Ref3", "x3", ["Alias2"], "ncRNA"), (4, "4", "Alias2", "Alias2", [], "pseudo"), (5, "5", "Z", "Z", ["Alias2"], "other")]
    info = spark.createDataFrame(rows, "row_no int, gene_id string, symbol string, ncbi_symbol string, synonyms array<string>, gene_type string")
    got = {q.key: q.gene_id for q in genes.alias_table(info).collect()}
    assert got == {"OFF1": "1", "ALIAS1": "1", "REF1": "2", "REF3": "3", "X3": "3", "ALIAS2": "5", "Z": "5"}


def test_orthologs(spark):
    t = spark.createDataFrame([("A", "a", "1,2,3"), ("B", "b1", "1,2,3,4"), ("B", "b2", "1,2,3"), ("B", "b2", "4,5,6"), ("T", "t", "1,2,3"), ("X", "x", "1")], "source string, target string, support string")
    ranked = genes.ranked_orthologs(genes.supported(t))
    assert [q.target for q in ranked.filter("source = 'B'").orderBy("rank").collect()] == ["b1", "b2"]
    names = spark.createDataFrame([("A_B",), ("A_X",), ("A",)], "name string")
    assert {q.name: q.translated for q in genes.translate_complexes(names, "name", ranked).collect()} == {"A_B": "a_b1", "A": "a"}
    assert genes.translate(names, "name", ranked, "nan").filter("translated is null").count() == 2
    with pytest.raises(Exception, match="no ortholog"):
        genes.translate(names, "name", ranked, "raise").collect()


def test_neighbour_graph_kernels(spark):
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(3, 6)) * 8
    rows = [(i, [float(v) for v in centers[i % 3] + rng.normal(size=6)], "abc"[i % 3]) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label string")
    k = vectors.knn(df, "id", "v", 8)
    fuzzy = vectors.fuzzy_connectivity(k, 9)
    for refine in (False, True):
        labels = {q.node: q.community for q in vectors.communities(fuzzy, refine=refine).collect()}
        groups = {}
        for n, c in labels.items():
            groups.setdefault(c, set()).add(n % 3)
        assert all(len(g) == 1 for g in groups.values())
    clusters = {q.id: q.cluster for q in vectors.kmeans(df, "id", "v", 3).collect()}
    assert len({(i % 3, c) for i, c in clusters.items()}) == 3
    pcs = vectors.pca(df, "id", "v", 2).collect()
    x = np.array([row[1] for row in rows])
    want = np.linalg.svd(x - x.mean(0), full_matrices=False)[1][:2] ** 2 / len(x)
    assert np.array([q.components for q in pcs]).var(axis=0) == pytest.approx(want)
    lengths = vectors.knnsc_distances(df, "id", "v", "label", 5)
    assert lengths.count() == 3 * 90
    marks = df.select(F.col("id").alias("node"), F.col("label").alias("grp"))
    assert vectors.central_cells(lengths, marks, 4).count() == 12 and vectors.peripheral_cells(lengths, marks, 4).count() == 12
    for out in (vectors.umap(fuzzy, 20), vectors.spectral(fuzzy)):
        assert out.count() == 90
    with pytest.raises(ValueError):
        vectors.in_one_task(fuzzy, lambda t: t, "i long", 5)


def test_ensembles(spark):
    nets = [dynamics.Network(x) for x in ({"A": "B", "B": "A & B"}, {"A": "B", "B": "B & A"}, {"A": "~B", "B": "0"})]
    got = {q.component: (q.function_count, q.stability) for q in dynamics.ensemble_nodes(spark, nets).collect()}
    assert got == {"A": (2, pytest.approx(2 / 3)), "B": (2, pytest.approx(2 / 3))}
    d = {(q.a, q.b): q.distance for q in dynamics.ensemble_distances(spark, nets).collect()}
    assert d == {(0, 1): 0, (0, 2): (1 + 0.25) / 2, (1, 2): (1 + 0.25) / 2}
    with pytest.raises(ValueError):
        dynamics.ensemble_frame(spark, [nets[0], dynamics.Network({"A": "A"})])


def test_aggregated_graphs_are_checked(spark):
    g = edges(spark, "A + B,B - C")
    assert graphs.add_edges(g, edges(spark, "A - B")).count() == 3
    with pytest.raises(ValueError):
        graphs.add_edges(g, edges(spark, "A + B"))
    bad = spark.createDataFrame([("A", "B", 1, 5, 4, 1.25)], "source string, target string, sign int, count long, total long, frequency double")
    with pytest.raises(Exception, match="outside"):
        graphs.validated_counts(bad).collect()


def test_running_sums_and_ecdf_of_a_hot_group(spark):
    rng = random.Random(0)
    rows = [("hot" if i % 3 else f"g{i % 5}", float(rng.randint(0, 400))) for i in range(3000)] + [("one", 1.0), ("one", None)]
    got = {(q.g, q.v): q.cdf for q in matrix.ecdf(spark.createDataFrame(rows, "g string, v double"), "v", "g").collect()}
    by = {}
    for g, v in rows:
        if v is not None:
            by.setdefault(g, []).append(v)
    assert got == {(g, v): pytest.approx(sum(x <= v for x in vs) / len(vs)) for g, vs in by.items() for v in set(vs)}
