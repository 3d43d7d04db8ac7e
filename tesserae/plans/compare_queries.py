"""Queries of the group comparisons, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import normal_two_sided
from ..operators import compare as c
from .tables import BRAND_X, BRANDS, CUSTOMERS, brand_matrix, brands, customers, read

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _three(spark, sf):
    return brand_matrix(spark, sf), customers(spark, sf), brands(spark, sf)


_DENSE = f"""WITH {BRAND_X}, {CUSTOMERS}, {BRANDS}, d AS (SELECT gene, cell, segment, coalesce(value, 0) AS v FROM var CROSS JOIN obs LEFT JOIN x USING (cell, gene)),
g AS (SELECT DISTINCT segment AS grp FROM obs),
mo AS (SELECT gene, grp, count(*) FILTER (WHERE segment = grp) AS n1, count(*) FILTER (WHERE segment IS DISTINCT FROM grp) AS n2, avg(v) FILTER (WHERE segment = grp) AS m1, avg(v) FILTER (WHERE segment IS DISTINCT FROM grp) AS m2,
 var_samp(v) FILTER (WHERE segment = grp) AS v1, var_samp(v) FILTER (WHERE segment IS DISTINCT FROM grp) AS v2 FROM d, g GROUP BY 1, 2)"""


def _welch_sql(n2: str) -> str:
    return f"{_DENSE} SELECT gene, grp, round((m1 - m2) / sqrt(v1 / n1 + v2 / {n2}), 5) AS t, round(pow(v1 / n1 + v2 / {n2}, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / {n2}, 2) / ({n2} - 1)), 2) AS df, round(m1, 5) AS mean_group, round(m2, 5) AS mean_rest, round(v1, 3) AS variance_group, round(v2, 3) AS variance_rest FROM mo"


def _rounded_welch(df):
    return df.select("gene", "grp", F.round("t", 5).alias("t"), F.round("df", 2).alias("df"), F.round("mean_group", 5).alias("mean_group"), F.round("mean_rest", 5).alias("mean_rest"), F.round("variance_group", 3).alias("variance_group"), F.round("variance_rest", 3).alias("variance_rest"))


@query(_welch_sql("n2"))
def welch_stats(spark, sf):
    x, obs, var = _three(spark, sf)
    return _rounded_welch(c.welch(x, obs, "segment", var))


@query(_welch_sql("n1"))
def welch_overestimate(spark, sf):
    x, obs, var = _three(spark, sf)
    return _rounded_welch(c.welch(x, obs, "segment", var, True))


@query()
def welch_pvalues(spark, sf):
    x, obs, var = _three(spark, sf)
    return c.bh_adjust(c.student_two_sided(c.welch(x, obs, "segment", var)), "p", ["grp"])


_RANKS = _DENSE + """, rk AS (SELECT gene, segment, v, rank() OVER (PARTITION BY gene ORDER BY v) + (count(*) OVER (PARTITION BY gene, v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY gene, v) AS t FROM d),
ti AS (SELECT gene, count(*) AS n, sum(t * t - 1.0) AS tie FROM rk GROUP BY 1),
rs AS (SELECT gene, grp, n, tie, count(*) FILTER (WHERE segment = grp) AS n1, coalesce(sum(r) FILTER (WHERE segment = grp), 0) AS sr FROM rk JOIN ti USING (gene), g GROUP BY 1, 2, 3, 4),
w AS (SELECT gene, grp, sr AS sum_ranks, sr - n1 * (n1 + 1) / 2.0 AS u, (sr - n1 * (n1 + 1) / 2.0 - n1 * (n - n1) / 2.0) / sqrt(n1 * (n - n1) / 12.0 * ((n + 1) - {tie} / (n * (n - 1.0)))) AS z FROM rs)"""
_WILCOXON = _RANKS.format(tie="tie")


@query(_WILCOXON + f" SELECT gene, grp, sum_ranks, u, round(z, 6) AS z, round({normal_two_sided('z')}, 8) AS p FROM w")
def wilcoxon_stats(spark, sf):
    x, obs, var = _three(spark, sf)
    return c.wilcoxon(x, obs, "segment", var).select("gene", "grp", "sum_ranks", "u", F.round("z", 6).alias("z"), F.round("p", 8).alias("p"))


@query(_RANKS.format(tie="0") + " SELECT gene, grp, u, round(z, 6) AS z FROM w")
def wilcoxon_no_tie_correction(spark, sf):
    x, obs, var = _three(spark, sf)
    return c.wilcoxon(x, obs, "segment", var, False).select("gene", "grp", "u", F.round("z", 6).alias("z"))


@query(f"""WITH {BRAND_X}, obs AS (SELECT c_custkey AS cell, c_mktsegment AS segment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')), {BRANDS},
d AS (SELECT gene, cell, segment, coalesce(value, 0) AS v FROM var CROSS JOIN obs LEFT JOIN x USING (cell, gene)),
r AS (SELECT gene, segment, rank() OVER (PARTITION BY gene ORDER BY v) + (count(*) OVER (PARTITION BY gene, v) - 1) / 2.0 AS r FROM d)
SELECT gene, sum(r) - count(*) * (count(*) + 1) / 2.0 AS u FROM r WHERE segment = 'BUILDING' GROUP BY 1""")
def wilcoxon_fixed_background(spark, sf):
    x, obs, var = _three(spark, sf)
    two = obs.filter(F.col("segment").isin("BUILDING", "MACHINERY"))
    return c.wilcoxon(x.join(two.select("cell"), "cell", "left_semi"), two, "segment", var).filter("grp = 'BUILDING'").select("gene", "u")


_P = f"p AS (SELECT gene, grp, round({normal_two_sided('z')}, 12) AS p FROM w)"


@query(_WILCOXON + f", {_P}, o AS (SELECT *, count(p) OVER (PARTITION BY grp) AS m, row_number() OVER (PARTITION BY grp ORDER BY p) AS k FROM p) SELECT gene, grp, round(least(min(p * m / k) OVER (PARTITION BY grp ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1), 8) AS adjusted FROM o")
def bh_adjust(spark, sf):
    x, obs, var = _three(spark, sf)
    return c.bh_adjust(c.wilcoxon(x, obs, "segment", var).withColumn("p", F.round("p", 12)), "p", ["grp"]).select("gene", "grp", F.round("adjusted", 8).alias("adjusted"))


@query(_WILCOXON + f", {_P} SELECT gene, grp, round(least(p * count(p) OVER (PARTITION BY grp), 1), 8) AS adjusted FROM p")
def bonferroni_adjust(spark, sf):
    x, obs, var = _three(spark, sf)
    return c.bonferroni_adjust(c.wilcoxon(x, obs, "segment", var).withColumn("p", F.round("p", 12)), "p", ["grp"]).select("gene", "grp", F.round("adjusted", 8).alias("adjusted"))


_LFC = "CASE WHEN m1 = 0 THEN -CAST('inf' AS DOUBLE) ELSE log2(m1) END - CASE WHEN m2 = 0 THEN -CAST('inf' AS DOUBLE) ELSE log2(m2) END"


@query(_DENSE + f" SELECT gene, grp, round({_LFC}, 6) AS lfc FROM mo")
def logfoldchanges(spark, sf):
    x, obs, var = _three(spark, sf)
    return c.logfoldchanges(x, obs, "segment", var).select("gene", "grp", F.round("lfc", 6).alias("lfc"))


@query(_DENSE + " SELECT gene, grp, round(log2(m1) - log2((sum(m1) OVER (PARTITION BY gene) - m1) / (count(*) OVER (PARTITION BY gene) - 1)), 6) AS lfc FROM mo")
def logfoldchanges_rebalanced(spark, sf):
    x, obs, var = _three(spark, sf)
    return c.logfoldchanges(x, obs, "segment", var, True).select("gene", "grp", F.round("lfc", 6).alias("lfc"))


_TESTS = _WILCOXON + f", {_P}, b AS (SELECT gene, grp, least(p * count(p) OVER (PARTITION BY grp), 1) AS adjusted FROM p), f AS (SELECT gene, grp, {_LFC} AS lfc FROM mo)"


def _tests(spark, sf):
    x, obs, var = _three(spark, sf)
    tests = c.bonferroni_adjust(c.wilcoxon(x, obs, "segment", var).withColumn("p", F.round("p", 12)), "p", ["grp"]).select("gene", "grp", "adjusted")
    return tests, c.logfoldchanges(x, obs, "segment", var)


@query(_TESTS + " SELECT gene, grp, round(adjusted, 8) AS adjusted, round(lfc, 6) AS lfc FROM b JOIN f USING (gene, grp) WHERE adjusted <= 0.8")
def dea(spark, sf):
    return c.dea(*_tests(spark, sf), alpha=0.8).select("gene", "grp", F.round("adjusted", 8).alias("adjusted"), F.round("lfc", 6).alias("lfc"))


@query(_TESTS + " SELECT grp, gene, CASE WHEN adjusted <= 0.8 AND lfc > 0 THEN 1 WHEN adjusted <= 0.8 THEN 0 END AS value FROM b JOIN f USING (gene, grp)")
def dea_binarize(spark, sf):
    return c.dea_binarize(*_tests(spark, sf), alpha=0.8)


_SIGS = """w AS (SELECT source AS signature, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\x0B\f\r]+')) AS item FROM documents WHERE source IS NOT NULL),
s AS (SELECT DISTINCT signature, item FROM w WHERE item <> ''), b AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\x0B\f\r]+')) AS item FROM benchmark),
q AS (SELECT item FROM b WHERE item <> ''), bg AS (SELECT item FROM s UNION SELECT item FROM q)"""


@query(f"""WITH {_SIGS}, c AS (SELECT signature, count(*) AS size, count(q.item) AS overlap FROM s LEFT JOIN q USING (item) GROUP BY 1), t AS (SELECT (SELECT count(*) FROM q) AS n, (SELECT count(*) FROM bg) AS m),
tail AS (SELECT signature, sum(exp(lgamma(size + 1) - lgamma(i + 1) - lgamma(size - i + 1) + lgamma(m - size + 1) - lgamma(n - i + 1) - lgamma(m - size - n + i + 1) - lgamma(m + 1) + lgamma(n + 1) + lgamma(m - n + 1))) AS p
 FROM (SELECT *, unnest(range(overlap, least(size, n) + 1)) AS i FROM c, t) WHERE m - size - n + i >= 0 GROUP BY 1)
SELECT signature, overlap, size, round(n * size / m, 6) AS expected, round(overlap / (n * size / m), 6) AS fold, round(CASE WHEN overlap = 0 THEN 1 ELSE p END, 6) AS p FROM c JOIN tail USING (signature), t""")
def ora(spark, sf):
    """Words of the benchmark among the words of each source of documents."""
    words = lambda df, *keys: df.select(*keys, F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), "[ \\t\\n\\x0B\\f\\r]+")).alias("item")).filter("item <> ''").distinct()
    own = words(read(spark, sf, "documents").filter("source is not null"), F.col("source").alias("signature"))
    asked = words(read(spark, sf, "benchmark"))
    out = c.ora(asked, own, own.select("item").union(asked))
    return out.select("signature", "overlap", "size", F.round("expected", 6).alias("expected"), F.round("fold", 6).alias("fold"), F.round("p", 6).alias("p"))


@query("""WITH e AS (SELECT event_type, value, user_id % 2 = 0 AS side FROM events WHERE value IS NOT NULL), v AS (SELECT event_type, value, count(*) FILTER (WHERE side) AS a, count(*) FILTER (WHERE NOT side) AS b FROM e GROUP BY 1, 2),
g AS (SELECT event_type, value, round(sum(a) OVER w / sum(a) OVER t - sum(b) OVER w / sum(b) OVER t, 12) AS gap FROM v WINDOW w AS (PARTITION BY event_type ORDER BY value), t AS (PARTITION BY event_type)),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY abs(gap) DESC, value) AS k FROM g)
SELECT event_type, round(abs(gap), 9) AS statistic, value AS location, CAST(sign(gap) AS INTEGER) AS sign FROM r WHERE k = 1""")
def smirnov_statistic(spark, sf):
    events = read(spark, sf, "events").filter("value is not null").select("event_type", "value", (F.col("user_id") % 2 == 0).alias("side"))
    return c.smirnov(events, "event_type", "value", "side").withColumn("statistic", F.round("statistic", 9))


@query("""WITH f AS (SELECT event_type, regr_slope(value, user_id) AS b, regr_intercept(value, user_id) AS a FROM events GROUP BY 1)
SELECT event_id, round(value - b * user_id - a, 6) AS residual FROM events JOIN f USING (event_type)""")
def regress_out_one_key(spark, sf):
    events = read(spark, sf, "events").select("event_id", "event_type", "value", "user_id")
    return c.regress_out(events, "event_type", "value", "user_id").select("event_id", F.round("residual", 6).alias("residual"))


@query("""WITH e AS (SELECT event_id, event_type, value, user_id AS u, event_id % 7 AS k FROM events),
m AS (SELECT event_type, avg(value) AS my, avg(u) AS mu, avg(k) AS mk, covar_pop(u, u) AS uu, covar_pop(k, k) AS kk, covar_pop(u, k) AS uk, covar_pop(value, u) AS yu, covar_pop(value, k) AS yk FROM e GROUP BY 1),
b AS (SELECT *, (yu * kk - yk * uk) / (uu * kk - uk * uk) AS bu, (yk * uu - yu * uk) / (uu * kk - uk * uk) AS bk FROM m)
SELECT event_id, round(value - my - bu * (u - mu) - bk * (k - mk), 5) AS residual FROM e JOIN b USING (event_type)""")
def regress_out_two_keys(spark, sf):
    events = read(spark, sf, "events").select("event_id", "event_type", "value", "user_id", (F.col("event_id") % 7).alias("k"))
    return c.regress_out_keys(events, "event_type", "value", ["user_id", "k"]).select("event_id", F.round("residual", 5).alias("residual"))


def _smirnov_sql(rest: str, groups: str, pick: str) -> str:
    return f"""{_DENSE}, va AS (SELECT gene, v, segment AS grp, count(*) AS c FROM d GROUP BY 1, 2, 3), sz AS (SELECT segment AS grp, count(*) AS n FROM obs GROUP BY 1), {groups},
vg AS (SELECT gene, v, sum(c) AS total, {rest} AS other FROM va GROUP BY 1, 2), gr AS (SELECT vg.gene, vg.v, ts.grp, n1, n2, coalesce(va.c, 0) AS a, other - {{less}} AS b FROM vg CROSS JOIN ts LEFT JOIN va ON va.gene = vg.gene AND va.v = vg.v AND va.grp = ts.grp),
gp AS (SELECT gene, grp, v, n1, n2, sum(a) OVER w * n2 - sum(b) OVER w * n1 AS g FROM gr WINDOW w AS (PARTITION BY gene, grp ORDER BY v)),
tp AS (SELECT gene, grp, n1, n2, max(g) AS up, min(g) AS down, arg_min(v, {{{{'a': -g, 'b': v}}}}) AS at_up, arg_min(v, {{{{'a': g, 'b': v}}}}) AS at_down FROM gp GROUP BY 1, 2, 3, 4)
{pick}"""


_REST = _smirnov_sql("sum(c)", "ts AS (SELECT grp, n AS n1, (SELECT sum(n) FROM sz) - n AS n2 FROM sz)", "SELECT gene, grp, round(greatest(up, -down) / (n1 * n2), 9) AS statistic, CASE WHEN up >= -down THEN at_up ELSE at_down END AS location, CASE WHEN up >= -down THEN 1 ELSE -1 END AS sign FROM tp").format(less="coalesce(va.c, 0)")
_AGAINST = _smirnov_sql("coalesce(sum(c) FILTER (WHERE grp = 'BUILDING'), 0)", "ts AS (SELECT grp, n AS n1, (SELECT n FROM sz WHERE grp = 'BUILDING') AS n2 FROM sz WHERE grp <> 'BUILDING')", "SELECT gene, grp, round(greatest(up, 0) / (n1 * n2), 9) AS statistic, at_up AS location, 1 AS sign FROM tp").format(less="0")


@query(_REST)
def smirnov_rest(spark, sf):
    x, obs, var = _three(spark, sf)
    return c.smirnov_tests(x, obs, "segment", var).select("gene", "grp", F.round("statistic", 9).alias("statistic"), "location", "sign")


@query(_AGAINST)
def smirnov_reference_greater(spark, sf):
    x, obs, var = _three(spark, sf)
    return c.smirnov_tests(x, obs, "segment", var, "BUILDING", "greater").select("gene", "grp", F.round("statistic", 9).alias("statistic"), "location", "sign")


@query()
def smirnov_pvalues(spark, sf):
    x, obs, var = _three(spark, sf)
    return c.smirnov_tests(x, obs, "segment", var).select("gene", "grp", "p", "adjusted")
