"""Queries of the signed graphs: trade between nations, and nations within regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import settled
from ..operators import graphs as g
from .tables import read

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _trade(spark, sf, year: bool = False):
    """Supplier nation -> customer nation, negative for returned goods: quantity, by ship year if asked."""
    line, orders = read(spark, sf, "lineitem"), read(spark, sf, "orders")
    nation = read(spark, sf, "nation").select("n_nationkey", "n_name")
    sign = F.when(F.col("l_returnflag") == "R", -1).otherwise(1).cast("byte").alias("sign")
    when = [F.year("l_shipdate").cast("short").alias("year")] if year else []
    # nations travel as numbers, and only the sums get their names
    s = read(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("_s"))
    c = read(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("_c"))
    sold = line.select("l_orderkey", "l_suppkey", sign, *when, "l_quantity").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    bought = orders.select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "_c")
    keys = ["_s", "_c", "sign", *(["year"] if year else [])]
    sums = sold.join(bought, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(*keys).agg(F.sum("l_quantity").alias("quantity"))
    names = lambda key, out: F.broadcast(nation.select(F.col("n_nationkey").alias(key), F.col("n_name").alias(out)))
    named = sums.join(names("_s", "source"), "_s").join(names("_c", "target"), "_c")
    years = [F.col("year").cast("int").alias("year")] if year else []
    return named.groupBy("source", "target", F.col("sign").cast("int").alias("sign"), *years).agg(F.sum("quantity").alias("quantity"))


def _net(trade, *keys):
    """One signed edge of each pair (and year): negative where more than a third of the quantity came back."""
    returned, whole = F.sum(F.when(F.col("sign") < 0, F.col("quantity")).otherwise(0.0)), F.sum("quantity")
    return trade.groupBy("source", "target", *keys).agg(F.when(3 * returned > whole, -1).otherwise(1).alias("sign")).select("source", "target", "sign", *keys)


def _edges(spark, sf):
    """Used several times by the operators, so the joins behind the edges are done once."""
    return settled(_net(_trade(spark, sf)))


def _yearly(spark, sf):
    return settled(_net(_trade(spark, sf, True), "year"))


def _regions(spark, sf):
    n, r = read(spark, sf, "nation"), read(spark, sf, "region")
    sign = F.when(F.col("n_nationkey") % 2 == 0, 1).otherwise(-1)
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("source"), F.col("r_name").alias("target"), sign.alias("sign"))


_T = "SELECT a.n_name AS source, b.n_name AS target, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS sign{y}, sum(l_quantity) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey GROUP BY ALL"
_N = "CASE WHEN 3 * sum(CASE WHEN sign < 0 THEN quantity ELSE 0 END) > sum(quantity) THEN -1 ELSE 1 END AS sign"
_E = f"e AS (SELECT source, target, {_N} FROM ({_T.format(y='')}) GROUP BY 1, 2)"
_Y = f"y AS (SELECT source, target, {_N}, year FROM ({_T.format(y=', year(l_shipdate) AS year')}) GROUP BY source, target, year)"
_R = "e AS (SELECT n_name AS source, r_name AS target, CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE -1 END AS sign FROM nation JOIN region ON n_regionkey = r_regionkey)"
_SCC = "re(s, t) AS (SELECT DISTINCT source, target FROM e UNION SELECT re.s, e.target FROM re JOIN e ON e.source = re.t), nd AS (SELECT source AS node FROM e UNION SELECT target FROM e), mu AS (SELECT a.s AS node, a.t AS other FROM re a JOIN re b ON a.s = b.t AND a.t = b.s), sc AS (SELECT node, least(node, coalesce(min(other), node)) AS scc FROM nd LEFT JOIN mu USING (node) GROUP BY node), fb AS (SELECT DISTINCT node FROM mu)"


@query("WITH f AS (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem) SELECT l_returnflag AS source, l_linestatus AS target, CASE l_returnflag WHEN 'R' THEN -1 ELSE 1 END AS sign FROM f WHERE l_returnflag <> 'N'")
def signed_edges_from_table(spark, sf):
    line = read(spark, sf, "lineitem").select("l_returnflag", "l_linestatus").distinct()
    sign = F.when(F.col("l_returnflag") == "R", "-").when(F.col("l_returnflag") == "A", "positive").otherwise("unknown")
    return g.from_table(line.withColumn("s", sign), "l_returnflag", "l_linestatus", "s")


@query(f"WITH {_Y} SELECT source, target, CASE WHEN min(sign) = max(sign) THEN min(sign) ELSE 0 END AS sign FROM y GROUP BY 1, 2")
def edge_sign(spark, sf):
    return g.edge_sign(_yearly(spark, sf))


@query(f"WITH t AS ({_T.format(y='')}) SELECT source, target, sign FROM t WHERE source = target")
def autoregulations(spark, sf):
    return g.autoregulations(_trade(spark, sf)).select("source", "target", "sign")


@query(f"WITH {_R} SELECT DISTINCT source AS node FROM e WHERE source NOT IN (SELECT target FROM e)")
def regulators(spark, sf):
    return g.regulators(_regions(spark, sf))


@query(f"WITH {_R} SELECT DISTINCT target AS node FROM e WHERE target NOT IN (SELECT source FROM e)")
def targets(spark, sf):
    return g.targets(_regions(spark, sf))


@query(f"WITH RECURSIVE {_E}, {_SCC} SELECT node, scc FROM sc")
def scc(spark, sf):
    return g.strong_components(_edges(spark, sf))


@query(f"WITH RECURSIVE {_E}, {_SCC} SELECT node FROM fb")
def feedback_nodes(spark, sf):
    return g.feedback_components(_edges(spark, sf)).select("node")


@query(f"WITH RECURSIVE {_E}, {_SCC} SELECT source, target, sign FROM e WHERE source IN (SELECT node FROM fb) AND target IN (SELECT node FROM fb)")
def feedback_induced(spark, sf):
    return g.feedback_induced(_edges(spark, sf))


_FAM = "f AS (SELECT target, sign, string_agg(source, '|' ORDER BY source) AS family, list(source) AS members FROM e GROUP BY 1, 2 HAVING count(*) >= 2)"


@query(f"WITH {_R}, {_FAM} SELECT family, len(members) AS size FROM f")
def structural_families(spark, sf):
    return g.structural_families(_regions(spark, sf)).select("family", F.size("members").cast("long").alias("size"))


@query(f"WITH {_R}, {_FAM}, m AS (SELECT unnest(members) AS node, family FROM f) SELECT DISTINCT coalesce(family, source) AS source, target, sign FROM e LEFT JOIN m ON node = source")
def family_collapsed(spark, sf):
    edges = _regions(spark, sf)
    return g.family_collapsed(edges, g.structural_families(edges))


@query(f"""WITH RECURSIVE {_E}, w(path, cur, sign, d) AS (SELECT [source, target], target, sign, 1 FROM e WHERE source = 'NATION_3' UNION ALL SELECT list_append(path, e.target), e.target, w.sign * e.sign, d + 1 FROM w JOIN e ON e.source = cur WHERE d < 3)
SELECT array_to_string(path, '>') AS path, sign FROM w""")
def walks_from(spark, sf):
    return g.walks_from(_edges(spark, sf), "NATION_3").select(F.array_join("path", ">").alias("path"), "sign")


_W = f"""WITH RECURSIVE {_E}, w(s, cur, sign, d) AS (SELECT source, target, sign, 1 FROM e UNION ALL SELECT w.s, e.target, w.sign * e.sign, d + 1 FROM w JOIN e ON e.source = cur WHERE d < 3),
sc AS (SELECT s AS source, cur AS target, sum(w.sign / (d * d)) AS score, sum(1.0 / (d * d)) AS total, count(*) AS paths, sum(w.sign / (d * d)) / sum(1.0 / (d * d)) AS normalized FROM w WHERE s <> cur GROUP BY 1, 2)"""


@query(_W + " SELECT source, target, round(score, 6) AS score, round(total, 6) AS total, paths, round(normalized, 6) AS normalized FROM sc")
def walk_scores(spark, sf):
    out = g.walk_scores(_edges(spark, sf))
    return out.select("source", "target", F.round("score", 6).alias("score"), F.round("total", 6).alias("total"), "paths", F.round("normalized", 6).alias("normalized"))


@query(_W + " SELECT a.source, a.target, CAST(sign(a.normalized) AS INTEGER) AS sign FROM sc a LEFT JOIN sc b ON b.source = a.target AND b.target = a.source WHERE a.normalized <> 0 AND abs(a.normalized) >= 0.05 AND round(abs(a.normalized), 12) > round(coalesce(abs(b.normalized), 0), 12)")
def infer_interactions(spark, sf):
    scores = g.walk_scores(_edges(spark, sf))
    return g.infer_interactions(scores.withColumn("normalized", F.round("normalized", 12)), 0.05)


@query(f"""WITH RECURSIVE {_E}, w(path, cur, sign) AS (SELECT [source], target, sign FROM e WHERE source <= target
UNION ALL SELECT list_append(path, cur), e.target, w.sign * e.sign FROM w JOIN e ON e.source = cur WHERE cur > path[1] AND NOT list_contains(path, cur) AND e.target >= path[1] AND len(path) < 4)
SELECT array_to_string(path, '>') AS path, sign FROM w WHERE cur = path[1]""")
def circuits(spark, sf):
    return g.circuits(_edges(spark, sf), 4).select(F.array_join("path", ">").alias("path"), "sign")


@query(f"""WITH {_E}, s AS (SELECT source, target, CASE WHEN min(sign) = max(sign) THEN min(sign) ELSE 0 END AS sign FROM e GROUP BY 1, 2)
SELECT a.source || CASE a.sign WHEN 1 THEN ' -> ' WHEN -1 THEN ' -| ' ELSE ' -- ' END || a.target || CASE b.sign WHEN 1 THEN ' -> ' WHEN -1 THEN ' -| ' ELSE ' -- ' END || b.target AS text, a.sign * b.sign AS sign FROM s a JOIN s b ON a.target = b.source""")
def path_sign(spark, sf):
    edges = _edges(spark, sf)
    signs = g.edge_sign(edges)
    two = signs.select("source", F.col("target").alias("via")).join(signs.select(F.col("source").alias("via"), "target"), "via").select(F.array("source", "via", "target").alias("path"))
    return g.path_sign(edges, two).select("text", "sign")


@query(f"""WITH RECURSIVE {_E}, {_SCC}, mb AS (SELECT node, scc FROM sc WHERE node IN (SELECT node FROM fb)), p(scc, cur, path) AS (SELECT scc, node, [node] FROM mb UNION ALL SELECT p.scc, e.target, list_append(path, e.target) FROM p JOIN (SELECT DISTINCT source, target FROM e) e ON e.source = cur WHERE len(path) < 4 AND NOT list_contains(path, e.target)),
d AS (SELECT scc, cur, min(len(path)) AS l FROM p GROUP BY 1, 2) SELECT cur AS marker, scc, array_to_string(path, '>') AS path FROM p JOIN d USING (scc, cur) WHERE len(path) = l AND cur IN ('NATION_1', 'NATION_7', 'NATION_13')""")
def marker_paths(spark, sf):
    return g.marker_paths(_edges(spark, sf), ["NATION_1", "NATION_7", "NATION_13"], 3).select("marker", "scc", F.array_join("path", ">").alias("path"))


def _two_years(spark, sf, yearly=None):
    y = _yearly(spark, sf) if yearly is None else yearly
    return y.filter("year = 1994").drop("year"), y.filter("year = 1995").drop("year")


_DIST = f"""WITH {_Y}, a AS (SELECT source, target, sign FROM y WHERE year = 1994), b AS (SELECT source, target, sign FROM y WHERE year = 1995), u AS (SELECT * FROM a UNION SELECT * FROM b), i AS (SELECT * FROM a INTERSECT SELECT * FROM b),
n AS (SELECT count(*) AS n FROM (SELECT source FROM u UNION SELECT target FROM u)), c AS (SELECT (SELECT count(*) FROM u) - (SELECT count(*) FROM i) AS differing, {{size}} AS size FROM n)
SELECT differing, size, round(differing / size, 9) AS distance, round(1 - differing / size, 9) AS similarity FROM c"""


def _distance(spark, sf, universe, given=None):
    out = g.graph_distance(*_two_years(spark, sf, given), universe, given)
    return out.withColumns({c: F.round(c, 9) for c in ("distance", "similarity")})


@query(_DIST.format(size="(SELECT count(*) FROM u)"))
def graph_distance_union(spark, sf):
    return _distance(spark, sf, "union")


@query(_DIST.format(size="2 * n * n"))
def graph_distance_complete(spark, sf):
    return _distance(spark, sf, "complete")


@query(_DIST.replace("year = 1994", "year = 1994 AND source <> target").replace("year = 1995", "year = 1995 AND source <> target").format(size="2 * n * (n - 1)"))
def graph_distance_loopless(spark, sf):
    a, b = (x.filter("source <> target") for x in _two_years(spark, sf))
    return g.graph_distance(a, b, "loopless").withColumns({c: F.round(c, 9) for c in ("distance", "similarity")})


@query(_DIST.format(size="(SELECT count(*) FROM (SELECT DISTINCT source, target, sign FROM y))"))
def graph_distance_given(spark, sf):
    return _distance(spark, sf, "given", _yearly(spark, sf))


_AGG = f"WITH {_Y}, a AS (SELECT source, target, sign, count(*) AS count, (SELECT count(DISTINCT year) FROM y) AS total FROM y GROUP BY 1, 2, 3)"


@query(_AGG + " SELECT source, target, sign, count, total, round(count / total, 9) AS frequency FROM a")
def aggregate_graphs(spark, sf):
    return g.aggregate_graphs(_yearly(spark, sf), "year").withColumn("frequency", F.round("frequency", 9))


@query(_AGG + ", f AS (SELECT *, count / total AS q FROM a) SELECT source, target, sign, CASE WHEN q <= 0.25 THEN 0 WHEN q <= 0.5 THEN 1 WHEN q <= 0.75 THEN 2 ELSE 3 END AS bin FROM f")
def frequency_bins(spark, sf):
    return g.aggregate_graphs(_yearly(spark, sf), "year").select("source", "target", "sign", g.frequency_bin(F.col("frequency")).alias("bin"))


@query(f"WITH {_Y}, {_R.replace('e AS (', 'r AS (', 1)}, f AS (SELECT target, sign, string_agg(source, '|' ORDER BY source) AS family, list(source) AS members FROM r GROUP BY 1, 2 HAVING count(*) >= 2), m AS (SELECT unnest(members) AS node, family FROM f), a AS (SELECT source, target, sign, count(*) / (SELECT count(DISTINCT year) FROM y) AS q FROM y GROUP BY 1, 2, 3), c AS (SELECT coalesce(x.family, source) AS source, coalesce(z.family, target) AS target, sign, q FROM a LEFT JOIN m x ON x.node = source LEFT JOIN m z ON z.node = target) SELECT source, target, sign, round(avg(q), 9) AS mean, round(min(q), 9) AS low, round(max(q), 9) AS high FROM c WHERE source <> target GROUP BY 1, 2, 3")
def aggregated_families(spark, sf):
    families = g.structural_families(_regions(spark, sf))
    out = g.aggregated_collapse(g.aggregate_graphs(_yearly(spark, sf), "year"), families)
    return out.withColumns({c: F.round(c, 9) for c in ("mean", "low", "high")})


@query(f"""WITH {_E} SELECT '"' || source || '" -> "' || target || '" [arrowhead=' || CASE sign WHEN -1 THEN 'tee' ELSE 'normal' END || '];' AS line FROM e""")
def dot_export(spark, sf):
    return g.dot_rows(_edges(spark, sf))
