"""Queries of state sets held as decision diagrams, against the SQL of the state tables."""

from __future__ import annotations

from ..operators import symbolic as s
from .boolean_queries import _NEXT, _SETS, _STATES, SQL as _SQL
from .boolean_queries import START, net

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _start(update: str) -> s.StateSet:
    return s.TransitionSystem(net(), update).states([START])


def _goal(update: str) -> s.StateSet:
    return s.TransitionSystem(net(), update).rule_set("A & D")


def _attractor_rows(spark, update: str):
    rows = [(min(states), x) for part in _start(update).attractors() for states in [sorted(part)] for x in states]
    return spark.createDataFrame(rows, "attractor long, state long")


for _u, _short in (("synchronous", "sync"), ("asynchronous", "async"), ("general", "general")):
    QUERIES[f"symbolic_reachable_{_short}"] = lambda spark, sf, u=_u: _start(u).reachable().states(spark)
    SQL[f"symbolic_reachable_{_short}"] = _SQL[f"reachable_{_short}"]
    QUERIES[f"symbolic_attractors_{_short}"] = lambda spark, sf, u=_u: _attractor_rows(spark, u)
    SQL[f"symbolic_attractors_{_short}"] = _SQL[f"attractors_{_short}"]
    QUERIES[f"symbolic_post_{_short}"] = lambda spark, sf, u=_u: _goal(u).post().states(spark)
    SQL[f"symbolic_post_{_short}"] = f"WITH {_STATES}, {_NEXT[_u]}, {_SETS} SELECT DISTINCT t AS state FROM nx WHERE s IN (SELECT s FROM ta)"
    QUERIES[f"symbolic_pre_{_short}"] = lambda spark, sf, u=_u: _goal(u).pre().states(spark)
    SQL[f"symbolic_pre_{_short}"] = f"WITH {_STATES}, {_NEXT[_u]}, {_SETS} SELECT DISTINCT s AS state FROM nx WHERE t IN (SELECT s FROM ta)"
    QUERIES[f"symbolic_coreachable_{_short}"] = lambda spark, sf, u=_u: _goal(u).coreachable().states(spark)
    SQL[f"symbolic_coreachable_{_short}"] = f"WITH RECURSIVE {_STATES}, {_NEXT[_u]}, {_SETS}, bk(s) AS (SELECT s FROM ta UNION SELECT nx.s FROM bk JOIN nx ON nx.t = bk.s) SELECT s AS state FROM bk"


@query(f"WITH {_STATES}, {_SETS} SELECT count(*) FILTER (WHERE a OR b) AS n_union, count(*) FILTER (WHERE a AND b) AS n_both, count(*) FILTER (WHERE a AND NOT b) AS n_less, count(*) FILTER (WHERE a <> b) AS n_differ, count(*) FILTER (WHERE NOT a) AS n_not FROM (SELECT s IN (SELECT s FROM so) AS a, s IN (SELECT s FROM ta) AS b FROM st)")
def symbolic_algebra(spark, sf):
    t = s.TransitionSystem(net())
    a, b = t.rule_set("A & ~B & C & ~G & ~H"), t.rule_set("A & D")
    counts = [x.count() for x in (a | b, a & b, a - b, a ^ b, ~a)]
    return spark.createDataFrame([tuple(counts)], "n_union long, n_both long, n_less long, n_differ long, n_not long")
