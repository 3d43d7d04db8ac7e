"""Queries of Boolean algebra and network dynamics, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as r
from ..functions.columns import mean_above
from ..operators import boolean as b
from ..operators import dynamics as d
from .tables import read

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: A network with a switch, a cycle, an oscillator and constants-free rules.
RULES = {"A": "B", "B": "(A & ~H) | C", "C": "~D", "D": "(A & ~C) | D", "E": "(C & ~F) | (~C & F)", "F": "E | G", "G": "~B & F", "H": "A | G"}
OTHER = RULES | {"B": "A | C", "G": "~B", "H": "G | A"}
THIRD = RULES | {"D": "A | D", "F": "E & G"}
N = len(RULES)
START = 0b00010101


def net(rules=None) -> d.Network:
    return d.Network(rules or RULES)


def _bit(name: str, state: str = "s", order=tuple(RULES)) -> str:
    return f"((({state} >> {order.index(name)}) & 1) = 1)"


def _image(rules=None, state: str = "s") -> str:
    return " + ".join(f"CASE WHEN {r.to_sql(r.parse(t), lambda v: _bit(v, state))} THEN {1 << i} ELSE 0 END" for i, t in enumerate((rules or RULES).values()))


_STATES = f"st AS (SELECT s, CAST({_image()} AS BIGINT) AS f FROM (SELECT range AS s FROM range(0, {1 << N}))), mv AS (SELECT s, f, xor(s, f) AS u FROM st)"
_NEXT = {
    "synchronous": "nx AS (SELECT s, f AS t FROM mv)",
    "asynchronous": f"nx AS (SELECT s, xor(s, 1 << i) AS t FROM mv, range(0, {N}) g(i) WHERE ((u >> i) & 1) = 1)",
    "general": f"nx AS (SELECT s, xor(s, m) AS t FROM mv, range(1, {1 << N}) g(m) WHERE (m & u) = m)",
}
_REACH = "rc(s) AS (SELECT CAST({start} AS BIGINT) UNION SELECT nx.t FROM rc JOIN nx ON nx.s = rc.s)"


def _dyn(update: str, tail: str, reach: bool = False) -> str:
    parts = [_STATES, _NEXT[update]] + ([_REACH.format(start=START)] if reach else [])
    return f"WITH RECURSIVE {', '.join(parts)} {tail}"


def _start(spark):
    return spark.range(1).select(F.lit(START).cast("long").alias("state"))


_CUBES = "c AS (SELECT user_id AS cell, event_type AS component, CASE WHEN count(*) FILTER (WHERE value > 20) < 5 THEN NULL ELSE avg(value) > 50 END AS value FROM events GROUP BY 1, 2)"


def _cubes(spark, sf):
    value = F.when(F.count_if(F.col("value") > 20) >= 5, mean_above(F.col("value"), 50))
    return read(spark, sf, "events").groupBy(F.col("user_id").alias("cell"), F.col("event_type").alias("component")).agg(value.alias("value"))


def _pairs(spark, sf):
    cells = read(spark, sf, "events").select(F.col("user_id").alias("cell1")).distinct()
    return cells.join(cells.withColumnRenamed("cell1", "cell2"), F.col("cell1") + 1 == F.col("cell2"))


_TYPES = ("click", "error", "purchase", "signup", "view")
_INTER = (("click", "view", 1), ("view", "purchase", 1), ("error", "purchase", -1), ("signup", "click", 1), ("purchase", "error", -1))


def _interactions(spark):
    return spark.createDataFrame(_INTER, "source string, target string, sign int")


def _masks(spark, sf):
    return b.cube_masks(_cubes(spark, sf).withColumnRenamed("cell", "cube"), list(_TYPES))


_MASKS = "m AS (SELECT cell AS cube, CAST(sum(CASE WHEN value IS NOT NULL THEN b ELSE 0 END) AS BIGINT) AS fm, CAST(sum(CASE WHEN value THEN b ELSE 0 END) AS BIGINT) AS vm FROM c JOIN (VALUES ('click', 1), ('error', 2), ('purchase', 4), ('signup', 8), ('view', 16)) t(component, b) USING (component) GROUP BY 1)"
_RANK = "CASE WHEN {0} THEN 2 WHEN NOT {0} THEN 0 ELSE 1 END"


@query(f"WITH {_CUBES} SELECT a.cell, a.component, a.value AND b.value AS meet, a.value OR b.value AS joined, NOT a.value AS negated FROM c a JOIN c b ON b.cell = a.cell + 1 AND b.component = a.component")
def kleene_and_or_not(spark, sf):
    a = _cubes(spark, sf)
    o = a.select((F.col("cell") - 1).alias("cell"), "component", F.col("value").alias("o"))
    return a.join(o, ["cell", "component"]).select("cell", "component", (F.col("value") & F.col("o")).alias("meet"), (F.col("value") | F.col("o")).alias("joined"), (~F.col("value")).alias("negated"))


@query(f"WITH {_CUBES} SELECT a.cell, a.component, CAST(sign({_RANK.format('b.value')} - {_RANK.format('a.value')}) AS INTEGER) AS diff FROM c a JOIN c b ON b.cell = a.cell + 1 AND b.component = a.component")
def kleene_diff(spark, sf):
    a = _cubes(spark, sf)
    o = a.select((F.col("cell") - 1).alias("cell"), "component", F.col("value").alias("o"))
    return a.join(o, ["cell", "component"]).select("cell", "component", b.kleene_diff(F.col("value"), F.col("o")).alias("diff"))


@query(f"WITH {_CUBES} SELECT a.cell, a.component, (b.value IS NULL OR (a.value IS NOT NULL AND a.value = b.value)) AS included FROM c a JOIN c b ON b.cell = a.cell + 1 AND b.component = a.component")
def partial_inclusion(spark, sf):
    a = _cubes(spark, sf)
    o = a.select((F.col("cell") - 1).alias("cell"), "component", F.col("value").alias("o"))
    return a.join(o, ["cell", "component"]).select("cell", "component", b.includes(F.col("value"), F.col("o")).alias("included"))


@query(f"""WITH {_CUBES}, j AS (SELECT coalesce(a.cell, b.cell - 1) AS cell, coalesce(a.component, b.component) AS component, a.value AS before, b.value AS after FROM c a FULL JOIN c b ON b.cell = a.cell + 1 AND b.component = a.component)
SELECT cell, component, before, after, CASE WHEN before IS NULL THEN 'stabilization' WHEN after IS NULL THEN 'destabilization' ELSE 'flip' END AS change FROM j WHERE before IS DISTINCT FROM after""")
def hypercube_changes(spark, sf):
    a = _cubes(spark, sf)
    return b.changes(a, a.withColumn("cell", F.col("cell") - 1), ["cell", "component"])


@query(f"WITH {_CUBES}, {_MASKS} SELECT cube FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.fm <> a.fm AND (a.fm & b.fm) = b.fm AND (a.vm & b.fm) = b.vm)")
def hypercube_maximal(spark, sf):
    return b.maximal(_masks(spark, sf))


@query(f"WITH {_CUBES}, {_MASKS} SELECT cube FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.fm <> a.fm AND (b.fm & a.fm) = a.fm AND (b.vm & a.fm) = a.vm)")
def hypercube_minimal(spark, sf):
    return b.minimal(_masks(spark, sf))


@query(f"WITH {_CUBES}, {_MASKS} SELECT cube FROM m WHERE (fm & 5) = 5 AND (vm & 5) = 4")
def hypercube_smaller_than(spark, sf):
    return b.inside(_masks(spark, sf), 5, 4).select("cube")


@query(f"WITH {_CUBES}, {_MASKS} SELECT cube FROM m WHERE fm = 31")
def hypercube_fully_specified(spark, sf):
    return b.fully_specified(_masks(spark, sf), 5).select("cube")


@query(f"WITH {_CUBES}, {_MASKS}, k AS (SELECT DISTINCT fm, vm FROM m) SELECT fm AS fixed_mask, vm AS value_mask, CAST(1 << (5 - bit_count(fm)) AS BIGINT) AS n_configurations FROM k")
def configuration_count(spark, sf):
    masks = _masks(spark, sf).select("fixed_mask", "value_mask").distinct()
    return masks.withColumn("n_configurations", F.expr("shiftleft(1L, 5 - bit_count(fixed_mask))"))


@query(f"WITH {_CUBES}, {_MASKS} SELECT cube, s AS state FROM m, range(0, 32) g(s) WHERE (s & fm) = vm")
def configuration_enumerate(spark, sf):
    return b.enumerate_configurations(_masks(spark, sf), 5)


@query(f"WITH {_CUBES}, {_MASKS} SELECT CAST(sum(1 << (5 - bit_count(fm))) AS BIGINT) AS n_configurations FROM m")
def configuration_total(spark, sf):
    return b.configuration_count(_masks(spark, sf), 5)


@query()
def configuration_sample(spark, sf):
    return b.sample(_masks(spark, sf), 5, 1000)


_VOTES = f"""WITH {_CUBES}, pr AS (SELECT a.cell AS cell1, b.cell AS cell2 FROM (SELECT DISTINCT cell FROM c) a JOIN (SELECT DISTINCT cell FROM c) b ON a.cell + 1 = b.cell), i(source, target, sign) AS (VALUES {', '.join(str(x) for x in _INTER)}),
e AS (SELECT cell1, cell2, sign, s1.value AS s1, s2.value AS s2, t1.value AS t1, t2.value AS t2, s1.cell IS NOT NULL AND s2.cell IS NOT NULL AND t1.cell IS NOT NULL AND t2.cell IS NOT NULL AS known FROM pr CROSS JOIN i
 LEFT JOIN c s1 ON s1.cell = cell1 AND s1.component = source LEFT JOIN c s2 ON s2.cell = cell2 AND s2.component = source LEFT JOIN c t1 ON t1.cell = cell1 AND t1.component = target LEFT JOIN c t2 ON t2.cell = cell2 AND t2.component = target),
v AS (SELECT cell1, cell2, CASE WHEN NOT known OR s1 IS NULL OR s1 IS DISTINCT FROM s2 OR t1 IS NOT DISTINCT FROM t2 THEN 'i' WHEN s1 = (sign = sign({_RANK.format('t2')} - {_RANK.format('t1')})) THEN 'f' ELSE 'b' END AS k FROM e),
w AS (SELECT cell1, cell2, count(*) FILTER (WHERE k = 'f') AS forward, count(*) FILTER (WHERE k = 'b') AS backward, count(*) FILTER (WHERE k = 'i') AS inconclusive FROM v GROUP BY 1, 2)"""


@query(_VOTES + " SELECT * FROM w")
def predecessor_votes(spark, sf):
    return b.predecessor_votes(_pairs(spark, sf), _cubes(spark, sf), _interactions(spark))


@query(_VOTES + " SELECT cell1, cell2, round(coalesce((forward - backward) / nullif(forward + backward, 0), 0), 9) AS score, CASE WHEN forward > backward THEN cell1 WHEN backward > forward THEN cell2 END AS predecessor FROM w")
def predecessor_score(spark, sf):
    out = b.predecessor_score(b.predecessor_votes(_pairs(spark, sf), _cubes(spark, sf), _interactions(spark)))
    return out.select("cell1", "cell2", F.round("score", 9).alias("score"), "predecessor")


@query(_dyn("synchronous", "SELECT s AS state FROM st WHERE s = f"))
def fixed_points(spark, sf):
    return d.fixed_points(spark, net())


def _successors(update):
    def f(spark, sf):
        return d.successors(d.all_states(spark, net()), net(), update)

    return f


def _reachable(update):
    def f(spark, sf):
        return d.reachable(_start(spark), net(), update)

    return f


def _attractors(update):
    def f(spark, sf):
        return d.attractors(_start(spark), net(), update)

    return f


_TERMINAL = "ed AS (SELECT DISTINCT nx.s, nx.t FROM nx JOIN rc ON rc.s = nx.s), cl(s, t) AS (SELECT s, s FROM rc UNION SELECT cl.s, ed.t FROM cl JOIN ed ON ed.s = cl.t), bk AS (SELECT a.s, a.t FROM cl a JOIN cl b ON a.s = b.t AND a.t = b.s), at0 AS (SELECT s FROM rc WHERE NOT EXISTS (SELECT 1 FROM cl WHERE cl.s = rc.s AND NOT EXISTS (SELECT 1 FROM bk WHERE bk.s = cl.s AND bk.t = cl.t)))"
for _u, _short in (("synchronous", "sync"), ("asynchronous", "async"), ("general", "general")):
    for _name, _make, _sql in (
        ("successors", _successors, _dyn(_u, "SELECT s AS state, t AS next FROM nx")),
        ("reachable", _reachable, _dyn(_u, "SELECT s AS state FROM rc", True)),
        ("attractors", _attractors, _dyn(_u, f", {_TERMINAL} SELECT min(bk.t) AS attractor, at0.s AS state FROM at0 JOIN bk ON bk.s = at0.s GROUP BY at0.s", True).replace(" , ed AS", ", ed AS")),
    ):
        QUERIES[f"{_name}_{_short}"], SQL[f"{_name}_{_short}"] = _make(_u), _sql

_SETS = "so AS (SELECT s FROM st WHERE (s & 7) = 5 AND s < 64), ta AS (SELECT s FROM st WHERE (s & 9) = 9)"


def _sets(spark):
    states = d.all_states(spark, net())
    return states.filter("(state & 7) = 5 AND state < 64"), states.filter("(state & 9) = 9")


_QUANT = "p AS (SELECT so.s, count(DISTINCT h.t) AS hits FROM so LEFT JOIN h ON h.s = so.s AND h.t IN (SELECT s FROM ta) GROUP BY 1) SELECT bool_or(hits > 0) AS exists_, bool_and(hits > 0) AS robust, bool_and(hits = (SELECT count(*) FROM ta)) AS universal FROM p"


@query(f"WITH {_STATES}, {_NEXT['general']}, {_SETS}, h AS (SELECT s, t FROM nx), {_QUANT}")
def transition_quantifiers(spark, sf):
    return d.transition(*_sets(spark), net(), "general")


@query(f"WITH RECURSIVE {_STATES}, {_NEXT['asynchronous']}, {_SETS}, h(s, t) AS (SELECT s, s FROM so UNION SELECT h.s, nx.t FROM h JOIN nx ON nx.s = h.t), {_QUANT}")
def reachability_quantifiers(spark, sf):
    return d.reachability(*_sets(spark), net(), "asynchronous")


@query(f"WITH {_STATES}, {_NEXT['asynchronous']}, {_SETS} SELECT DISTINCT nx.s AS state FROM nx WHERE t IN (SELECT s FROM ta)")
def predecessor_states(spark, sf):
    return d.pre(_sets(spark)[1], net())


@query(f"WITH RECURSIVE {_STATES}, {_NEXT['asynchronous']}, {_SETS}, bk(s) AS (SELECT s FROM ta UNION SELECT nx.s FROM bk JOIN nx ON nx.t = bk.s) SELECT s AS state FROM bk")
def coreachable(spark, sf):
    return d.coreachable(_sets(spark)[1], net(), "asynchronous")


_TRAPS = f"cb AS (SELECT fm, vm FROM range(0, {1 << N}) a(fm), range(0, {1 << N}) b(vm) WHERE (vm & fm) = vm), cs AS (SELECT fm, vm FROM cb WHERE NOT EXISTS (SELECT 1 FROM st WHERE (s & fm) = vm AND (f & fm) <> vm))"


@query(f"WITH {_STATES}, {_TRAPS}, r AS (SELECT s, fm, vm, row_number() OVER (PARTITION BY s ORDER BY bit_count(fm) DESC) AS k FROM st JOIN cs ON (s & fm) = vm) SELECT s AS state, fm AS closed_fixed, vm AS closed_value FROM r WHERE k = 1")
def trap_space_closure(spark, sf):
    points = d.all_states(spark, net()).select(F.lit((1 << N) - 1).cast("long").alias("fixed_mask"), F.col("state").alias("value_mask"))
    return d.trap_closure(points, net()).select(F.col("value_mask").alias("state"), "closed_fixed", "closed_value")


@query(f"WITH {_STATES}, {_TRAPS} SELECT fm AS fixed_mask, vm AS value_mask FROM cs a WHERE NOT EXISTS (SELECT 1 FROM cs b WHERE b.fm <> a.fm AND (b.fm & a.fm) = a.fm AND (b.vm & a.fm) = a.vm)")
def minimal_trap_spaces(spark, sf):
    return d.minimal_trap_spaces(spark, net())


@query()
def most_permissive_reachable(spark, sf):
    return d.most_permissive_reachable(spark, net(), START)


def _disagree(a, b_, name):
    order = sorted(set(r.essential(r.parse(a[name]))) | set(r.essential(r.parse(b_[name]))))
    sql = lambda t: r.to_sql(r.parse(t), lambda v: _bit(v, "s", tuple(order)) if v in order else "FALSE")
    return f"SELECT '{name}' AS component, count(*) FILTER (WHERE {sql(a[name])} <> {sql(b_[name])}) AS disagree, count(*) AS size FROM (SELECT range AS s FROM range(0, {1 << len(order)}))"


def _restrict_sql(a, b_, name):
    return f"SELECT disagree / size AS x FROM ({_disagree(a, b_, name)})"


_HAMMING = "h AS (" + " UNION ALL ".join(_disagree(RULES, OTHER, c) for c in RULES) + ")"


@query(f"WITH {_HAMMING} SELECT round(avg(disagree / size), 9) AS distance, round(1 - avg(disagree / size), 9) AS similarity FROM h")
def bn_hamming(spark, sf):
    return d.distance(spark, net(), net(OTHER)).select(F.round("distance", 9).alias("distance"), F.round("similarity", 9).alias("similarity"))


@query(f"WITH {_HAMMING} SELECT round(avg(CASE WHEN disagree > 0 THEN 1.0 ELSE 0 END), 9) AS distance, round(1 - avg(CASE WHEN disagree > 0 THEN 1.0 ELSE 0 END), 9) AS similarity FROM h")
def bn_equivalence(spark, sf):
    return d.distance(spark, net(), net(OTHER), "equivalence").select(F.round("distance", 9).alias("distance"), F.round("similarity", 9).alias("similarity"))


def _influence_sql() -> str:
    parts = []
    for k, rules in enumerate((RULES, OTHER, THIRD)):
        for c, t in rules.items():
            for v in r.symbols(r.parse(t)):
                up, down = (r.to_sql(r.parse(t), lambda x, v=v, c=c: c if x == v else _bit(x)) for c in ("TRUE", "FALSE"))
                parts.append(f"SELECT DISTINCT {k} AS k, '{v}' AS source, '{c}' AS target, CASE WHEN {up} THEN 1 ELSE -1 END AS sign FROM (SELECT range AS s FROM range(0, {1 << N})) WHERE ({up}) <> ({down})")
    return f"WITH i AS ({' UNION ALL '.join(parts)}) SELECT source, target, sign, count(DISTINCT k) AS count, 3 AS total FROM i GROUP BY 1, 2, 3"


@query(_influence_sql())
def bn_influence_counts(spark, sf):
    return d.ensemble_influences(spark, [net(), net(OTHER), net(THIRD)])


_RULE, _VARS = "(A & ~B) | (C ^ D) & (A | B)", ("A", "B", "C", "D")
_RULE_SQL = r.to_sql(r.parse(_RULE), lambda v: _bit(v, "s", _VARS))


@query(f"SELECT range AS state, {_RULE_SQL.replace('s >>', 'range >>')} AS value FROM range(0, 16)")
def rule_truth_table(spark, sf):
    return d.truth_table(spark, _RULE, list(_VARS))


@query(f"""WITH t AS (SELECT s, {_RULE_SQL} AS v FROM (SELECT range AS s FROM range(0, 16))), cb AS (SELECT fm, vm FROM range(0, 16) a(fm), range(0, 16) b(vm) WHERE (vm & fm) = vm),
im AS (SELECT fm, vm FROM cb WHERE NOT EXISTS (SELECT 1 FROM t WHERE (s & fm) = vm AND NOT v)) SELECT fm AS fixed_mask, vm AS value_mask FROM im a WHERE NOT EXISTS (SELECT 1 FROM im b WHERE b.fm <> a.fm AND (a.fm & b.fm) = b.fm AND (a.vm & b.fm) = b.vm)""")
def prime_implicants(spark, sf):
    found = r.prime_implicants(r.parse(_RULE))
    rows = [(sum(1 << _VARS.index(n) for n in c), sum(1 << _VARS.index(n) for n, v in c.items() if v)) for c in found]
    return spark.createDataFrame(rows, "fixed_mask long, value_mask long")


@query(f"SELECT count(*) FILTER (WHERE {_RULE_SQL}) AS ones, count(*) FILTER (WHERE NOT ({_RULE_SQL})) AS zeros FROM (SELECT range AS s FROM range(0, 16))")
def robdd_count(spark, sf):
    diagram = r.Diagram(r.parse(_RULE), list(_VARS))
    return spark.createDataFrame([(diagram.count(True), diagram.count(False))], "ones long, zeros long")


@query()
def robdd_nodes(spark, sf):
    return spark.createDataFrame(r.Diagram(r.parse(_RULE), list(_VARS)).rows(), "node int, variable string, low int, high int")
