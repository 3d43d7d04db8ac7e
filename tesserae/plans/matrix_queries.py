"""Queries of the annotated-matrix operators on the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import settled
from ..operators import matrix as m
from .tables import BRAND_X, BRANDS, CUSTOMERS, EVENT_X, USERS, brand_matrix, brands, customers, event_matrix, read, users

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query(f"""WITH {EVENT_X}, {USERS}, r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY value DESC, gene) AS k FROM x),
a AS (SELECT cell, count(*) FILTER (WHERE value > 0) AS n, sum(value) AS t, sum(value) FILTER (WHERE k <= 1) AS t1, sum(value) FILTER (WHERE k <= 3) AS t3,
 coalesce(sum(value) FILTER (WHERE gene = 'purchase'), 0) AS f FROM r GROUP BY 1)
SELECT cell, coalesce(n, 0) AS n_features, round(coalesce(t, 0), 4) AS total, round(coalesce(f, 0), 4) AS total_flag, round(100 * t1 / t, 4) AS pct_top1, round(100 * t3 / t, 4) AS pct_top3,
 round(100 * f / t, 4) AS pct_flag, round(ln(1 + coalesce(n, 0)), 6) AS log1p_n_features, round(ln(1 + coalesce(t, 0)), 6) AS log1p_total, round(ln(1 + coalesce(f, 0)), 6) AS log1p_total_flag
FROM obs LEFT JOIN a USING (cell)""")
def qc_obs(spark, sf):
    flag = read(spark, sf, "events").select(F.col("event_type").alias("gene")).distinct().filter("gene = 'purchase'")
    out = m.qc_obs(event_matrix(spark, sf), users(spark, sf), (1, 3), {"flag": flag})
    return rounded(rounded(out, "log1p_n_features", "log1p_total", "log1p_total_flag"), "total", "total_flag", "pct_top1", "pct_top3", "pct_flag", digits=4)


@query(f"""WITH {BRAND_X}, {CUSTOMERS}, {BRANDS}, n AS (SELECT count(*) AS n FROM obs),
d AS (SELECT gene, cell, coalesce(value, 0) AS v FROM var CROSS JOIN obs LEFT JOIN x USING (cell, gene)),
a AS (SELECT gene, median(v) AS med FROM d GROUP BY 1), b AS (SELECT gene, median(abs(v - med)) AS mad FROM d JOIN a USING (gene) GROUP BY 1)
SELECT gene, count(*) FILTER (WHERE v > 0) AS n_barcodes, sum(v) AS total, round(avg(v), 6) AS mean, round(var_samp(v), 4) AS variance, round(100.0 * (1 - count(*) FILTER (WHERE v > 0) / count(*)), 6) AS pct_dropout,
 any_value(med) AS median, any_value(mad) AS mad FROM d JOIN a USING (gene) JOIN b USING (gene) GROUP BY gene""")
def qc_var(spark, sf):
    # the matrix is read four times: computed once
    out = m.qc_var(settled(brand_matrix(spark, sf)), customers(spark, sf), brands(spark, sf))
    return rounded(rounded(out, "mean", "pct_dropout"), "variance", digits=4)


@query(f"WITH {EVENT_X} SELECT cell, gene, round(value / (sum(value) OVER (PARTITION BY cell) / 10000), 4) AS value FROM x")
def normalize(spark, sf):
    return rounded(m.normalize(event_matrix(spark, sf)), "value", digits=4)


@query(f"WITH {EVENT_X} SELECT cell, gene, round(ln(1 + value), 6) AS value FROM x")
def log1p(spark, sf):
    return rounded(m.log1p(event_matrix(spark, sf)), "value")


@query(f"WITH {EVENT_X} SELECT cell, gene, round(ln(1 + value) / ln(2), 6) AS value FROM x")
def log1p_base2(spark, sf):
    return rounded(m.log1p(event_matrix(spark, sf), 2), "value")


_MOMENTS = f"""WITH {BRAND_X}, {CUSTOMERS}, {BRANDS}, d AS (SELECT gene, cell, coalesce(value, 0) AS v FROM var CROSS JOIN obs LEFT JOIN x USING (cell, gene)),
mom AS (SELECT gene, count(*) AS n_obs, sum(v) AS total, avg(v) AS mean, var_samp(v) AS variance FROM d GROUP BY 1)"""


@query(_MOMENTS + " SELECT gene, n_obs, total, round(mean, 6) AS mean, round(variance, 4) AS variance FROM mom")
def column_mean_variance(spark, sf):
    return rounded(rounded(m.column_moments(brand_matrix(spark, sf), customers(spark, sf)), "mean"), "variance", digits=4)


@query(_MOMENTS + " SELECT cell, gene, round((v - mean) / CASE WHEN variance > 0 THEN sqrt(variance) ELSE 1 END, 5) AS value FROM d JOIN mom USING (gene)")
def scale_centered(spark, sf):
    return rounded(m.scale(brand_matrix(spark, sf), customers(spark, sf), brands(spark, sf)), "value", digits=5)


@query(_MOMENTS + " SELECT x.cell, gene, round(greatest(least(value / CASE WHEN variance > 0 THEN sqrt(variance) ELSE 1 END, 3), -3), 5) AS value FROM x JOIN mom USING (gene)")
def scale_uncentered_clip(spark, sf):
    return rounded(m.scale(brand_matrix(spark, sf), customers(spark, sf), brands(spark, sf), False, 3.0), "value", digits=5)


_PARTS = "x AS (SELECT o_custkey AS cell, 'p' || l_partkey AS gene, sum(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"


def _part_matrix(spark, sf):
    """Customers by parts."""
    line, orders = read(spark, sf, "lineitem"), read(spark, sf, "orders")
    gene = F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("gene")
    return line.join(orders, line.l_orderkey == orders.o_orderkey).groupBy(F.col("o_custkey").alias("cell"), gene).agg(F.sum("l_quantity").alias("value"))


_STEPS = ", ".join(f"{k / 100}" for k in range(10, 101, 5))
_BINNED = f"""WITH {_PARTS}, {CUSTOMERS}, n AS (SELECT count(*) AS n FROM obs),
mom AS (SELECT gene, sum(value) / n AS mean, greatest(sum(value * value) / n - (sum(value) / n) * (sum(value) / n), 0) * n / (n - 1) AS variance FROM x, n GROUP BY gene, n),
dis AS (SELECT gene, mean, variance / mean AS dispersion FROM mom),
e AS (SELECT list_distinct(quantile_cont(mean, [{_STEPS}])) AS edges FROM dis WHERE mean > 0),
bn AS (SELECT gene, mean, dispersion, len(list_filter(edges, lambda v: v < mean)) - 1 AS bin FROM dis, e),
c AS (SELECT bin, median(dispersion) AS centre FROM bn GROUP BY 1), s AS (SELECT bin, median(abs(dispersion - centre)) AS spread FROM bn JOIN c USING (bin) GROUP BY 1),
scored AS (SELECT gene, mean, dispersion, bin, (dispersion - centre) / nullif(spread / 0.67449, 0) AS score FROM bn JOIN c USING (bin) JOIN s USING (bin))"""


@query(_BINNED + " SELECT gene, round(mean, 6) AS mean, round(dispersion, 5) AS dispersion, bin, round(score, 4) AS score FROM scored")
def hvg_binning(spark, sf):
    out = m.hvg_binning(_part_matrix(spark, sf), customers(spark, sf))
    return out.select("gene", F.round("mean", 6).alias("mean"), F.round("dispersion", 5).alias("dispersion"), "bin", F.round("score", 4).alias("score"))


@query(_BINNED + " SELECT gene, round(score, 4) AS score FROM scored WHERE score IS NOT NULL ORDER BY scored.score DESC, gene LIMIT 50")
def hvg_top(spark, sf):
    return m.hvg_top(m.hvg_binning(_part_matrix(spark, sf), customers(spark, sf)), 50).select("gene", F.round("score", 4).alias("score"))


@query(_BINNED + " SELECT gene FROM scored WHERE mean > 0.0125 AND mean < 3 AND score > 0.5")
def hvg_cutoff(spark, sf):
    return m.hvg_cutoff(m.hvg_binning(_part_matrix(spark, sf), customers(spark, sf))).select("gene")


_BATCHED = f"""WITH {_PARTS}, obs AS (SELECT c_custkey AS cell, c_mktsegment AS batch FROM customer), n AS (SELECT batch, count(*) AS n FROM obs GROUP BY 1 HAVING count(*) >= 2),
mom AS (SELECT batch, gene, n, sum(value) / n AS mean, greatest(sum(value * value) / n - (sum(value) / n) * (sum(value) / n), 0) * n / (n - 1) AS variance FROM x JOIN obs USING (cell) JOIN n USING (batch) GROUP BY batch, gene, n),
dis AS (SELECT *, variance / mean AS dispersion FROM mom), e AS (SELECT batch, list_distinct(quantile_cont(mean, [{_STEPS}])) AS edges FROM dis WHERE mean > 0 GROUP BY 1),
bn AS (SELECT batch, gene, n, dispersion, len(list_filter(edges, lambda v: v < mean)) - 1 AS bin FROM dis JOIN e USING (batch)),
c AS (SELECT batch, bin, median(dispersion) AS centre FROM bn GROUP BY 1, 2), s AS (SELECT batch, bin, median(abs(dispersion - centre)) AS spread FROM bn JOIN c USING (batch, bin) GROUP BY 1, 2),
sc AS (SELECT batch, gene, n, {{weight}} AS w, round((dispersion - centre) / nullif(spread / 0.67449, 0), 9) AS score FROM bn JOIN c USING (batch, bin) JOIN s USING (batch, bin)),
rk AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY score DESC NULLS LAST, gene) AS r FROM sc), rr AS (SELECT *, r <= 50 AND score IS NOT NULL AS ok FROM rk),
cw AS (SELECT gene, r, sum(w) OVER (PARTITION BY gene ORDER BY r, w) AS up, sum(w) OVER (PARTITION BY gene) AS whole FROM rr WHERE ok), md AS (SELECT gene, CAST({{median}} AS DOUBLE) AS rank FROM cw GROUP BY 1)
SELECT gene, count(r) FILTER (WHERE ok) AS n_batches, rank, round(sum(score * w) / sum(w) FILTER (WHERE score IS NOT NULL), 4) AS score FROM rr LEFT JOIN md USING (gene) GROUP BY gene, rank"""


def _by_segment(spark, sf):
    return customers(spark, sf).drop("batch").withColumnRenamed("segment", "batch")


@query(_BATCHED.format(weight="n", median="min(r) FILTER (WHERE up >= whole / 2)"))
def hvg_rank_batch(spark, sf):
    out = m.hvg_batches(m.batch_binning(_part_matrix(spark, sf), _by_segment(spark, sf), "batch"), 50, "rank", "cell_count")
    return out.select("gene", "n_batches", "rank", F.round("score", 4).alias("score"))


@query(_BATCHED.format(weight="1", median="median(r)"))
def hvg_equal_batch(spark, sf):
    out = m.hvg_batches(m.batch_binning(_part_matrix(spark, sf), _by_segment(spark, sf), "batch"), 50)
    return out.select("gene", "n_batches", "rank", F.round("score", 4).alias("score"))


@query()
def hvg_loess_batch(spark, sf):
    return m.hvg_batches(m.hvg_loess(_part_matrix(spark, sf), _by_segment(spark, sf), batch="batch"), 50, method="loess")


@query(f"""WITH {BRAND_X}, v AS (SELECT p_brand AS gene, any_value(left(p_brand, 7)) AS name, min(p_size) AS size FROM part GROUP BY 1)
SELECT cell, name, sum(value) AS value FROM x JOIN v USING (gene) GROUP BY 1, 2""")
def merge_duplicate_vars_sum(spark, sf):
    return m.merge_duplicate_vars(brand_matrix(spark, sf), _named_brands(spark, sf), ["size"])[0]


def _named_brands(spark, sf):
    part = read(spark, sf, "part").groupBy(F.col("p_brand").alias("gene")).agg(F.min("p_size").alias("size"), F.min("p_type").alias("kind"), F.min("p_partkey").alias("pos"))
    return part.withColumn("name", F.substring("gene", 1, 7))


_NAMED = "v AS (SELECT p_brand AS gene, left(p_brand, 7) AS name, min(p_size) AS size, min(p_type) AS kind, min(p_partkey) AS pos FROM part GROUP BY 1, 2)"


@query(f"WITH {_NAMED} SELECT name, min(pos) AS pos, arg_min(size, pos) AS size, arg_min(kind, pos) AS kind FROM v GROUP BY 1")
def merge_duplicate_vars_first(spark, sf):
    return m.merge_duplicate_vars(brand_matrix(spark, sf), _named_brands(spark, sf), ["size", "kind"])[1]


@query(f"WITH {_NAMED} SELECT name, min(pos) AS pos, CASE WHEN count(DISTINCT size) = 1 AND count(size) = count(*) THEN min(size) END AS size, CASE WHEN count(DISTINCT kind) = 1 AND count(kind) = count(*) THEN min(kind) END AS kind FROM v GROUP BY 1")
def merge_duplicate_vars_consensus(spark, sf):
    return m.merge_duplicate_vars(brand_matrix(spark, sf), _named_brands(spark, sf), ["size", "kind"], "consensus")[1]


@query(f"WITH {BRAND_X}, {CUSTOMERS} SELECT x.* FROM x JOIN obs USING (cell) WHERE balance > 5000")
def filter_obs(spark, sf):
    return m.filter_axis(brand_matrix(spark, sf), customers(spark, sf), "cell", F.col("balance") > 5000)[0]


@query(f"WITH {BRAND_X} SELECT * FROM x WHERE gene LIKE 'Brand#1%'")
def filter_var(spark, sf):
    return m.filter_axis(brand_matrix(spark, sf), brands(spark, sf), "gene", F.col("gene").startswith("Brand#1"))[0]


@query("SELECT c_custkey AS cell, c_name AS name FROM customer")
def sort_axes(spark, sf):
    return m.sort_axis(read(spark, sf, "customer").select(F.col("c_custkey").alias("cell"), F.col("c_name").alias("name")), "name")


@query("""SELECT c_custkey AS cell, c_acctbal AS balance_x, c_mktsegment AS segment, b.balance AS balance_y
FROM customer LEFT JOIN (SELECT o_custkey AS cell, round(sum(o_totalprice), 2) AS balance FROM orders GROUP BY 1) b ON b.cell = c_custkey""")
def annotation_merge(spark, sf):
    left = customers(spark, sf).select("cell", "balance", "segment")
    right = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("cell")).agg(F.round(F.sum("o_totalprice"), 2).alias("balance"))
    return m.merge_annotations(left, right, "cell")


@query(f"WITH {BRAND_X}, y AS (SELECT cell, gene, value * 2 AS value FROM x WHERE cell % 3 <> 0) SELECT x.cell, x.gene, y.value FROM x LEFT JOIN y USING (cell, gene)")
def transfer_layer(spark, sf):
    x = brand_matrix(spark, sf)
    return m.transfer_layer(x, x.filter("cell % 3 <> 0").withColumn("value", F.col("value") * 2))


_YEARLY = "SELECT o_custkey AS cell, CAST(year(o_orderdate) AS VARCHAR) AS condition, count(*) AS n_orders FROM orders GROUP BY 1, 2"


def _yearly(spark, sf):
    return read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("cell"), F.year("o_orderdate").cast("string").alias("condition")).agg(F.count("*").alias("n_orders"))


_YEARS = ("1993", "1994", "1995")


@query(f"WITH y AS ({_YEARLY}) SELECT c.c_custkey AS cell, v.condition, n_orders FROM customer c CROSS JOIN (VALUES ('1993'), ('1994'), ('1996')) v(condition) LEFT JOIN y ON y.cell = c.c_custkey AND y.condition = v.condition AND y.condition IN ('1993', '1994', '1995')")
def transfer_to_integrated(spark, sf):
    y = _yearly(spark, sf)
    whole = customers(spark, sf).select("cell", F.explode(F.array(*map(F.lit, ("1993", "1994", "1996")))).alias("condition"))
    samples = {c: y.filter(F.col("condition") == c).drop("condition") for c in _YEARS}
    return m.transfer_to_integrated(whole, samples, ["n_orders"])


@query(f"WITH y AS ({_YEARLY}) SELECT c_custkey AS cell, c_acctbal AS balance, n_orders FROM customer LEFT JOIN y ON y.cell = c_custkey AND y.condition = '1994'")
def transfer_to_specific(spark, sf):
    return m.transfer_to_specific(_yearly(spark, sf), customers(spark, sf).select("cell", "balance"), "1994", ["n_orders"])


@query(f"WITH {EVENT_X} SELECT cell, round(coalesce(sum(value) FILTER (WHERE gene = 'click'), 0), 4) AS click, round(coalesce(sum(value) FILTER (WHERE gene = 'view'), 0), 4) AS view FROM x GROUP BY 1")
def to_dataframe_pivot(spark, sf):
    return rounded(m.to_wide(event_matrix(spark, sf), ["click", "view"]), "click", "view", digits=4)


@query("WITH o AS (SELECT c_mktsegment AS segment, c_nationkey AS nation FROM customer) SELECT s.segment, t.nation, (SELECT count(*) FROM o WHERE o.segment = s.segment AND o.nation = t.nation) AS n FROM (SELECT DISTINCT segment FROM o) s CROSS JOIN (SELECT DISTINCT nation FROM o) t")
def composition(spark, sf):
    return m.composition(customers(spark, sf).withColumnRenamed("batch", "nation"), "nation", "segment", False).select("segment", "nation", "n")


@query("WITH o AS (SELECT c_mktsegment AS segment, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1, 2), g AS (SELECT s.segment, t.nation, coalesce(o.n, 0) AS n FROM (SELECT DISTINCT segment FROM o) s CROSS JOIN (SELECT DISTINCT nation FROM o) t LEFT JOIN o ON o.segment = s.segment AND o.nation = t.nation) SELECT nation, segment, n, round(n / sum(n) OVER (PARTITION BY nation), 6) AS share FROM g")
def composition_normalized(spark, sf):
    return rounded(m.composition(customers(spark, sf).withColumnRenamed("batch", "nation"), "nation", "segment"), "share")


@query("SELECT DISTINCT event_type, value, round(cume_dist() OVER (PARTITION BY event_type ORDER BY value), 8) AS cdf FROM events WHERE value IS NOT NULL")
def ecdf(spark, sf):
    return rounded(m.ecdf(read(spark, sf, "events"), "value", "event_type"), "cdf", digits=8)


@query("""WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
SELECT event_type, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, min(value) FILTER (WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS low,
max(value) FILTER (WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS high, count(*) FILTER (WHERE NOT value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_out
FROM events JOIN q USING (event_type) GROUP BY event_type, q1, median, q3""")
def boxplot_stats(spark, sf):
    return rounded(m.box_stats(read(spark, sf, "events"), "value", "event_type"), "q1", "median", "q3")


@query("""WITH t AS (SELECT quantile_cont(value, 0.99) AS t FROM events), v AS (SELECT least(value, t) AS v FROM events, t WHERE value IS NOT NULL),
s AS (SELECT count(*) AS n, stddev_samp(v) * pow(count(*), -0.2) AS h, min(v) AS lo, max(v) AS hi FROM v)
SELECT round(lo + (hi - lo) * k / 49, 6) AS at, round(sum(exp(-((lo + (hi - lo) * k / 49 - v) / h) * ((lo + (hi - lo) * k / 49 - v) / h) / 2)) / (n * h * sqrt(2 * pi())), 8) AS density
FROM v, s, unnest(range(0, 50)) AS g(k) GROUP BY k, lo, hi, n, h""")
def density(spark, sf):
    return rounded(rounded(m.density(read(spark, sf, "events"), "value"), "at"), "density", digits=8)
