"""Further queries: set algebra of cubes and states, ensembles, relabelling, gene flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as r
from ..operators import boolean as b
from ..operators import dynamics as d
from ..operators import genes, graphs, matrix, vectors
from .boolean_queries import _CUBES, _MASKS, _NEXT, _RULE, _RULE_SQL, _TERMINAL, _VARS, OTHER, RULES, THIRD, _bit, _cubes, _image, _masks, _restrict_sql, net
from .gene_queries import _HCOP, _hcop
from .graph_queries import _AGG, _yearly
from .matrix_queries import _part_matrix
from .tables import customers, read
from .vector_queries import _grp, _lengths, _vectors

QUERIES, SQL = {}, {}
_SECOND = "(B | ~D) & (A ^ C)"
_SECOND_SQL = r.to_sql(r.parse(_SECOND), lambda v: _bit(v, "s", _VARS))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _cube_rows(spark, sf):
    return _cubes(spark, sf).withColumnRenamed("cell", "cube")


@query(f"WITH {_CUBES} SELECT cell AS cube, component, value FROM c WHERE component NOT IN ('click', 'view')")
def hypercube_drop(spark, sf):
    return b.drop_components(_cube_rows(spark, sf), ["click", "view"])


@query(f"WITH {_CUBES} SELECT cell AS cube, CASE component WHEN 'click' THEN 'tap' ELSE component END AS component, value FROM c")
def hypercube_relabel(spark, sf):
    mapping = spark.createDataFrame([("click", "tap")], "old string, new string")
    return b.relabel_components(_cube_rows(spark, sf), mapping).select("cube", "component", "value")


@query(f"WITH {_CUBES}, u AS (SELECT cell, 'click' AS component, true AS value FROM c WHERE component = 'view' AND value UNION ALL SELECT DISTINCT cell, 'new', false FROM c) SELECT cell AS cube, component, coalesce(u.value, CASE WHEN u.cell IS NULL THEN c.value END) AS value FROM c FULL JOIN u USING (cell, component)")
def hypercube_update(spark, sf):
    cubes = _cube_rows(spark, sf)
    set_ = cubes.filter("component = 'view' and value").select("cube", F.lit("click").alias("component"), F.lit(True).alias("value"))
    return b.update_cubes(cubes, set_.union(cubes.select("cube", F.lit("new"), F.lit(False)).distinct()))


@query(f"""WITH {_CUBES}, j AS (SELECT coalesce(a.cell, b.cell - 1) AS cube, a.value AS x, b.value AS y FROM c a FULL JOIN c b ON b.cell = a.cell + 1 AND b.component = a.component)
SELECT cube, bool_and(x IS NOT DISTINCT FROM y) AS same, bool_and(y IS NULL OR (x IS NOT NULL AND x = y)) AS below, bool_and(x IS NULL OR (y IS NOT NULL AND x = y)) AS above FROM j GROUP BY 1""")
def hypercube_compare(spark, sf):
    a = _cube_rows(spark, sf)
    return b.compare_cubes(a, a.withColumn("cube", F.col("cube") - 1))


_A, _B = "(s & 7) = 5", "(s & 9) = 9"
_SET_SQL = {"union": f"{_A} OR {_B}", "intersection": f"{_A} AND {_B}", "difference": f"{_A} AND NOT {_B}", "symmetric": f"({_A}) <> ({_B})", "complement": f"NOT {_A}"}


def _algebra(operation):
    def f(spark, sf):
        states = d.all_states(spark, net())
        return b.state_algebra(states.filter("(state & 7) = 5"), states.filter("(state & 9) = 9"), operation, len(RULES))

    return f


for _op, _where in _SET_SQL.items():
    QUERIES[f"states_{_op}"] = _algebra(_op)
    SQL[f"states_{_op}"] = f"SELECT s AS state FROM (SELECT range AS s FROM range(0, {1 << len(RULES)})) WHERE {_where}"


@query(f"WITH s AS (SELECT {_A} AS a, {_B} AS b FROM (SELECT range AS s FROM range(0, {1 << len(RULES)}))) SELECT bool_and(a = b) AS equal, bool_and(NOT a OR b) AS subset, bool_and(NOT b OR a) AS superset, bool_or(a AND b) AS meets, count(*) FILTER (WHERE a) AS n_a, count(*) FILTER (WHERE b) AS n_b FROM s")
def states_relations(spark, sf):
    states = d.all_states(spark, net())
    return b.state_relations(states.filter("(state & 7) = 5"), states.filter("(state & 9) = 9"))


_ALL = (RULES, OTHER, THIRD)


def _ensemble_sql() -> str:
    pairs = [(i, j) for i in range(3) for j in range(i + 1, 3)]
    return " UNION ALL ".join(f"SELECT {i} AS a, {j} AS b, round(avg(x), 9) AS distance FROM ({' UNION ALL '.join(_restrict_sql(_ALL[i], _ALL[j], c) for c in RULES)})" for i, j in pairs)


@query(_ensemble_sql())
def ensemble_distance(spark, sf):
    return d.ensemble_distances(spark, [net(x) for x in _ALL]).withColumn("distance", F.round("distance", 9))


@query("SELECT * FROM (VALUES " + ", ".join(f"({k}, '{c}', '{r.to_text(r.parse(t))}')" for k, x in enumerate(_ALL) for c, t in x.items()) + ") t(network_id, component, rule)")
def ensemble_rules(spark, sf):
    return d.ensemble_frame(spark, [net(x) for x in _ALL])


def _named(implicant):
    """The implicant as JSON in order of names."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(implicant))))


def _prime_sql(k: int, component: str, rule: str) -> str:
    """Cubes of the rule's variables on which it always holds, that no greater such cube holds."""
    tree = r.parse(rule)
    order = r.symbols(tree)
    size = 1 << len(order)
    holds = r.to_sql(tree, lambda v: _bit(v, "s", tuple(order)))
    pairs = ", ".join(f"CASE WHEN fm & {1 << i} <> 0 THEN '\"{v}\":' || CASE WHEN vm & {1 << i} <> 0 THEN 'true' ELSE 'false' END END" for i, v in sorted(enumerate(order), key=lambda x: x[1]))
    return f"""SELECT {k} AS network_id, '{component}' AS component, '{{' || array_to_string(list_filter([{pairs}], lambda x: x IS NOT NULL), ',') || '}}' AS implicant
 FROM (WITH st AS (SELECT s, {holds} AS v FROM (SELECT range AS s FROM range(0, {size}))), im AS (SELECT fm, vm FROM range(0, {size}) a(fm), range(0, {size}) b(vm) WHERE vm & fm = vm AND NOT EXISTS (SELECT 1 FROM st WHERE s & fm = vm AND NOT v))
 SELECT fm, vm FROM im a WHERE NOT EXISTS (SELECT 1 FROM im b WHERE b.fm <> a.fm AND a.fm & b.fm = b.fm AND a.vm & b.fm = b.vm))"""


@query(" UNION ALL ".join(_prime_sql(k, c, t) for k, rules in enumerate(_ALL) for c, t in (rules or RULES).items()))
def ensemble_prime_implicants(spark, sf):
    out = d.ensemble_implicants(spark, [net(x) for x in _ALL], prime=True)
    return out.select("network_id", "component", _named(F.col("implicant")).alias("implicant"))


@query()
def ensemble_dnf_implicants(spark, sf):
    out = d.ensemble_implicants(spark, [net(x) for x in _ALL])
    return out.select("network_id", "component", _named(F.col("implicant")).alias("implicant"))


_STOPPED = f"st AS (SELECT s, CAST({_image(RULES | {'H': '0'})} AS BIGINT) AS f FROM (SELECT range AS s FROM range(0, {1 << len(RULES)}))), mv AS (SELECT s, f, xor(s, f) AS u FROM st)"


@query(f"WITH RECURSIVE {_STOPPED}, {_NEXT['asynchronous']}, rc(s) AS (SELECT s FROM st WHERE (s & 15) = 5 UNION SELECT nx.t FROM rc JOIN nx ON nx.s = rc.s), {_TERMINAL} SELECT min(bk.t) AS attractor, at0.s AS state FROM at0 JOIN bk ON bk.s = at0.s GROUP BY at0.s")
def executable_model_attractors(spark, sf):
    model = d.ExecutableModel(net(), {"start": {"A": True, "B": False, "C": True, "D": False}}, {"H": False})
    return model.attractors(spark, "start", "asynchronous")


@query("SELECT p_partkey, p_size % 11 = 0 AS mt, regexp_matches(lower(p_name), '^(rps|rpl|mrps|mrpl)') OR p_brand = 'Brand#7' AS rps FROM part")
def gene_flags(spark, sf):
    part = read(spark, sf, "part")
    symbol = F.when(F.col("p_brand") == "Brand#7", F.concat(F.lit("Rpl"), F.col("p_size").cast("string"))).otherwise(F.col("p_name"))
    ids = part.select(F.col("p_partkey").cast("string").alias("alias"), F.when(F.col("p_size") % 11 == 0, "MT").otherwise("7").alias("chromosome"), symbol.alias("symbol"))
    var = part.select("p_partkey", F.col("p_partkey").cast("string").alias("gene"))
    return matrix.ribosomal_genes(matrix.mitochondrial_genes(var, ids), ids).select("p_partkey", "mt", "rps")


@query()
def hvg_loess(spark, sf):
    return matrix.hvg_loess(_part_matrix(spark, sf), customers(spark, sf))


@query()
def knnsc_predict(spark, sf):
    return vectors.knnsc_predict(_lengths(spark, sf), _grp(spark, sf), 30, central=["1", "2"])


@query("SELECT vec_id, list_transform(embedding[1:3], lambda x: round(CAST(x AS DOUBLE), 6)) AS components FROM embeddings")
def representation_slice(spark, sf):
    out = vectors.representation(_vectors(spark, sf), "vec_id", "embedding", 3)
    return out.withColumn("components", F.transform("components", lambda x: F.round(x.cast("double"), 6)))


@query(f"""WITH {_HCOP}, k AS (SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY max(evidence) DESC, count(*) DESC, target) AS r FROM h GROUP BY 1, 2), m AS (SELECT source AS old, target AS new FROM k WHERE r = 1),
e AS (SELECT DISTINCT p_brand AS source, 'Brand#' || (1 + p_size % 30) AS target, CASE WHEN p_size > 25 THEN 1 ELSE -1 END AS sign FROM part) SELECT DISTINCT a.new AS source, b.new AS target, sign FROM e JOIN m a ON a.old = e.source JOIN m b ON b.old = e.target""")
def translate_graph(spark, sf):
    part = read(spark, sf, "part")
    edges = part.select(F.col("p_brand").alias("source"), F.concat(F.lit("Brand#"), (1 + F.col("p_size") % 30).cast("string")).alias("target"), F.when(F.col("p_size") > 25, 1).otherwise(-1).alias("sign")).distinct()
    return genes.translate_edges(edges, genes.ranked_orthologs(_hcop(spark, sf)))


@query("SELECT DATE '2024-03-01' AS start, 2 AS version")
def version_lookup(spark, sf):
    v = spark.sql("SELECT * FROM VALUES (1, DATE '2023-01-01', DATE '2024-02-29'), (2, DATE '2024-03-01', DATE '2024-12-31'), (3, DATE '2025-01-01', NULL) AS v(version, start, end)")
    return genes.version_at(v, "2024-06-30").select("start", "version")


@query("""SELECT date_trunc('hour', ts) AS start, user_id AS cell, event_type AS gene, round(sum(value), 4) AS value, count(*) AS n FROM events GROUP BY 1, 2, 3""")
def windowed_totals(spark, sf):
    from ..streaming.counters import windowed_totals as totals

    return totals(read(spark, sf, "events")).withColumn("value", F.round("value", 4)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query()
def ensemble_stability(spark, sf):
    return d.ensemble_nodes(spark, [net(x) for x in _ALL])


@query(f"{_AGG} SELECT source, target, sign, CASE WHEN count / total < 0.25 THEN 'dotted' WHEN count / total < 0.5 THEN 'dashed' WHEN count / total < 0.75 THEN 'solid' ELSE 'bold' END AS style FROM a")
def edge_styles(spark, sf):
    aggregated = graphs.validated_counts(graphs.aggregate_graphs(_yearly(spark, sf), "year"))
    return aggregated.select("source", "target", "sign", graphs.frequency_style(F.col("frequency")).alias("style"))


_PARTIAL = f"WITH {_CUBES} SELECT cell, component, CASE WHEN value THEN '1' WHEN NOT value THEN '0' ELSE '*' END AS symbol, value IS NOT NULL AS fixed, value IS NULL AS free, CASE WHEN value THEN '1' WHEN NOT value THEN '0' ELSE '0,1' END AS allowed FROM c"


@query(_PARTIAL)
def partial_values(spark, sf):
    v = F.col("value")
    allowed = F.array_join(F.transform(b.possibilities(v), lambda x: x.cast("string")), ",")
    return _cubes(spark, sf).select("cell", "component", b.symbol(b.to_kleene(v)).alias("symbol"), b.is_fixed(v).alias("fixed"), b.is_free(v).alias("free"), allowed.alias("allowed"))


@query(f"WITH {_CUBES}, {_MASKS} SELECT cube FROM m WHERE (fm & 7) = fm AND (5 & fm) = vm")
def hypercube_larger_than(spark, sf):
    return b.around(_masks(spark, sf), 7, 5).select("cube")


@query(f"WITH {_CUBES}, {_MASKS}, k AS (SELECT DISTINCT fm, vm FROM m), w AS (SELECT * FROM k UNION SELECT 7, 5), o AS (SELECT * FROM w WHERE NOT (fm = 7 AND vm = 5)) SELECT (SELECT count(*) FROM k) AS size, (SELECT count(*) FROM w) AS size_with, (SELECT count(*) FROM o) AS size_without, EXISTS (SELECT 1 FROM k WHERE fm = 7 AND vm = 5) AS contained, EXISTS (SELECT 1 FROM w WHERE fm = 7 AND vm = 5) AS then_contained, NOT EXISTS (SELECT 1 FROM k WHERE fm = 7 AND vm = 5) AS same_after")
def hypercube_collection(spark, sf):
    masks = b.collected(_masks(spark, sf))
    one = spark.range(1).select(F.lit(7).cast("long").alias("fixed_mask"), F.lit(5).cast("long").alias("value_mask"))
    more = b.with_cubes(masks, one)
    less = b.without_cubes(more, one)
    count = lambda d, name: d.agg(F.count("*").alias(name))
    row = count(masks, "size").crossJoin(count(more, "size_with")).crossJoin(count(less, "size_without"))
    row = row.crossJoin(b.has_cube(masks, 7, 5)).crossJoin(b.has_cube(more, 7, 5).withColumnRenamed("contained", "then_contained"))
    return row.crossJoin(b.same_collections(masks, less).select(F.col("equal").alias("same_after")))


@query(f"WITH {_CUBES} SELECT DISTINCT component FROM c WHERE value IS NOT NULL")
def hypercube_components(spark, sf):
    return b.fixed_components(_cube_rows(spark, sf))


@query(f"WITH {_CUBES}, {_MASKS} SELECT DISTINCT s AS state FROM m, range(0, 32) g(s) WHERE (s & fm) = vm")
def configuration_compress(spark, sf):
    """States of all cubes, made disjoint as single states and compressed to fewer cubes, then spelled out again."""
    states = b.enumerate_configurations(_masks(spark, sf), 5).select(F.lit(31).cast("long").alias("fixed_mask"), F.col("state").alias("value_mask"))
    return b.enumerate_configurations(b.compress(states, 5).withColumn("cube", F.lit(0)), 5).select("state")


_ROBDD = f"FROM (SELECT s, {_RULE_SQL} AS x, {_SECOND_SQL} AS y FROM (SELECT range AS s FROM range(0, 16)))"


@query(f"SELECT count(*) FILTER (WHERE x AND y) AS n_and, count(*) FILTER (WHERE x OR y) AS n_or, count(*) FILTER (WHERE x <> y) AS n_xor, count(*) FILTER (WHERE NOT x) AS n_not {_ROBDD}")
def robdd_algebra(spark, sf):
    x, y = (r.Diagram(r.parse(t), list(_VARS)) for t in (_RULE, _SECOND))
    return spark.createDataFrame([tuple(z.count() for z in (x & y, x | y, x ^ y, ~x))], "n_and long, n_or long, n_xor long, n_not long")


@query(" UNION ALL ".join(f"SELECT {fm} AS fixed_mask, {vm} AS value_mask, coalesce(bool_or(x), false) AS can_be_1, coalesce(bool_or(NOT x), false) AS can_be_0 {_ROBDD} WHERE (s & {fm}) = {vm}" for fm in range(16) for vm in range(16) if vm & fm == vm))
def robdd_can_take(spark, sf):
    x = r.Diagram(r.parse(_RULE), list(_VARS))
    cube = lambda fm, vm: {v: bool(vm >> i & 1) for i, v in enumerate(_VARS) if fm >> i & 1}
    rows = [(fm, vm, x.can_take_value(cube(fm, vm), True), x.can_take_value(cube(fm, vm), False)) for fm in range(16) for vm in range(16) if vm & fm == vm]
    return spark.createDataFrame(rows, "fixed_mask int, value_mask int, can_be_1 boolean, can_be_0 boolean")
