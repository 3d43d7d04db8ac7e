"""Comparisons of groups of cells: moment and rank tests, fold changes, enrichment, distribution gaps, regression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import log2_or_inf, log_factorial, normal_two_sided, ratio

#: Terms of a hypergeometric tail in one range.
TAIL = 10_000


def bh_adjust(df: DataFrame, p: str, by: list[str], out: str = "adjusted") -> DataFrame:
    """Benjamini-Hochberg within `by`: the running minimum, from the largest p down, of p x tests / rank, 1 at most.
    Null p stay null and are no tests."""
    m = F.count(p).over(Window.partitionBy(*by))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.asc_nulls_last(p)))
    raw = df.withColumn("_q", F.col(p) * m / rank)
    down = Window.partitionBy(*by).orderBy(F.desc_nulls_last(p)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return raw.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.min("_q").over(down), F.lit(1.0)))).drop("_q")


def bonferroni_adjust(df: DataFrame, p: str, by: list[str], out: str = "adjusted") -> DataFrame:
    return df.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.col(p) * F.count(p).over(Window.partitionBy(*by)), F.lit(1.0))))


def group_moments(x: DataFrame, obs: DataFrame, group: str, var: DataFrame) -> DataFrame:
    """(gene, grp, n, total, squares) of every gene and non-null group, and of all cells under `all_*`.

    One aggregate by gene and group; the totals are windows over its few rows a gene."""
    labels = obs.select("cell", F.col(group).alias("grp"))
    sizes = labels.groupBy("grp").agg(F.count("*").alias("n"))
    grid = var.select("gene").crossJoin(F.broadcast(sizes))
    sums = x.join(labels, "cell").groupBy("gene", "grp").agg(F.sum("value").alias("total"), F.sum(F.col("value") * F.col("value")).alias("squares"))
    full = grid.join(sums, (grid.gene == sums.gene) & grid.grp.eqNullSafe(sums.grp), "left").select(grid.gene, grid.grp, "n", F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("squares", F.lit(0.0)).alias("squares"))
    whole = Window.partitionBy("gene")
    out = full.withColumns({f"all_{c}": F.sum(c).over(whole) for c in ("n", "total", "squares")})
    return out.filter(F.col("grp").isNotNull())


def _variance(n: Column, total: Column, squares: Column) -> Column:
    mean = total / n
    return F.greatest(squares / n - mean * mean, F.lit(0.0)) * F.when(n > 1, n / (n - 1)).otherwise(1.0)


def welch(x: DataFrame, obs: DataFrame, group: str, var: DataFrame, overestimate_variance: bool = False) -> DataFrame:
    """(gene, grp, t, df, mean_group, mean_rest, variance_group, variance_rest): each group against all other cells
    (those without a group too). t is 0 where both variances are. overestimate_variance: the group's size on both sides.
    Groups of two cells at least."""
    m = group_moments(x, obs, group, var).filter("n >= 2 and all_n > n")
    n1, n2 = F.col("n"), F.col("all_n") - F.col("n")
    t2, q2 = F.col("all_total") - F.col("total"), F.col("all_squares") - F.col("squares")
    v1, v2 = _variance(n1, F.col("total"), F.col("squares")), _variance(n2, t2, q2)
    used = n1 if overestimate_variance else n2
    m = m.withColumns({"mean_group": F.col("total") / n1, "mean_rest": t2 / n2, "variance_group": v1, "variance_rest": v2, "_a": v1 / n1, "_b": v2 / used})
    se = F.sqrt(F.col("_a") + F.col("_b"))
    t = F.coalesce(ratio(F.col("mean_group") - F.col("mean_rest"), se), F.lit(0.0))
    df = ratio((F.col("_a") + F.col("_b")) * (F.col("_a") + F.col("_b")), F.col("_a") * F.col("_a") / (n1 - 1) + F.col("_b") * F.col("_b") / (used - 1))
    return m.select("gene", "grp", t.alias("t"), df.alias("df"), "mean_group", "mean_rest", "variance_group", "variance_rest")


def student_two_sided(df: DataFrame, t: str = "t", freedom: str = "df", out: str = "p") -> DataFrame:
    """Adds the two-sided p of Student's t: the regularised incomplete beta function by its continued fraction."""

    def p_values(t: np.ndarray, v: np.ndarray) -> np.ndarray:
        from math import lgamma

        x = v / (v + t * t)
        a, b = v / 2, np.full_like(v, 0.5)
        swap = x > (a + 1) / (a + b + 2)
        p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
        tiny = 1e-300
        c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for k in range(1, 300):
            for step in (k * (q - k) * z / ((p + 2 * k - 1) * (p + 2 * k)), -(p + k) * (p + q + k) * z / ((p + 2 * k) * (p + 2 * k + 1))):
                d = 1 + step * d
                c = 1 + step / c
                d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
                h *= d * c
            if np.all(np.abs(d * c - 1) < 1e-15):
                break
        gamma = np.array([lgamma(i + j) - lgamma(i) - lgamma(j) for i, j in zip(p, q, strict=True)])
        with np.errstate(divide="ignore"):
            part = np.exp(gamma + p * np.log(z) + q * np.log1p(-z)) * h / p
        return np.clip(np.where(swap, 1 - part, part), 0, 1)

    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tv, v = (b[c].to_numpy(zero_copy_only=False).astype(float) for c in (t, freedom))
            good = np.isfinite(v) & (v > 0)
            got = np.ones(len(tv))
            got[good] = p_values(tv[good], v[good])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got)], [*b.schema.names, out])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return df.mapInArrow(run, StructType([*schema.fields, StructField(out, DoubleType())]))


def wilcoxon(x: DataFrame, obs: DataFrame, group: str, var: DataFrame, tie_correction: bool = True) -> DataFrame:
    """(gene, grp, sum_ranks, u, z, p): rank sums of each group among all cells, average ranks for ties.

    Cells without a stored value are one block of zeros: only stored values are ranked, and the block shifts the
    ranks above it, so no dense matrix arises. u, z and p are null where all values tie."""
    labels = obs.select("cell", F.col(group).alias("grp"))
    sizes = labels.groupBy("grp").agg(F.count("*").alias("n1")).filter(F.col("grp").isNotNull())
    counts = x.filter("value <> 0").join(labels, "cell").groupBy("gene", "value", "grp").agg(F.count("*").alias("k"))
    gene = Window.partitionBy("gene")
    # ranks by distinct value: how many lie below, and how many share it
    per_value = counts.groupBy("gene", "value").agg(F.sum("k").alias("same"))
    per_value = per_value.withColumn("below", F.coalesce(F.sum("same").over(gene.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    per_value = per_value.withColumn("nnz", F.sum("same").over(gene))
    per_value = per_value.crossJoin(F.broadcast(labels.agg(F.count("*").alias("n"))))
    zeros = F.col("n") - F.col("nnz")
    per_value = per_value.withColumn("rank", F.col("below") + F.when(F.col("value") > 0, zeros).otherwise(0) + (F.col("same") + 1) / 2)
    ties = per_value.groupBy("gene", "n", "nnz").agg(F.sum(F.pow("same", F.lit(3)) - F.col("same")).alias("tie"), F.sum(F.when(F.col("value") < 0, F.col("same")).otherwise(0)).alias("negative"))
    sums = counts.filter(F.col("grp").isNotNull()).join(per_value.select("gene", "value", "rank"), ["gene", "value"]).groupBy("gene", "grp").agg(F.sum(F.col("rank") * F.col("k")).alias("stored"), F.sum("k").alias("k1"))
    everything = labels.agg(F.count("*").alias("_n"))
    full = var.select("gene").crossJoin(F.broadcast(sizes)).join(ties, "gene", "left").join(sums, ["gene", "grp"], "left").crossJoin(F.broadcast(everything))
    full = full.withColumn("n", F.col("_n")).fillna(0, ["nnz", "tie", "negative", "stored", "k1"])
    block = F.col("n") - F.col("nnz")
    ranks = F.col("stored") + (F.col("n1") - F.col("k1")) * (F.col("negative") + (block + 1) / 2)
    n, n1, n2 = F.col("n").cast("double"), F.col("n1").cast("double"), (F.col("n") - F.col("n1")).cast("double")
    tie = (F.col("tie") + F.pow(block.cast("double"), F.lit(3)) - block) if tie_correction else F.lit(0.0)
    sigma = F.sqrt(F.greatest(n1 * n2 / 12 * ((n + 1) - tie / (n * (n - 1))), F.lit(0.0)))
    full = full.filter("n1 < n").withColumn("sum_ranks", ranks).withColumn("_s", sigma)
    good = F.col("_s") > 1e-9
    full = full.withColumn("u", F.when(good, F.col("sum_ranks") - n1 * (n1 + 1) / 2))
    full = full.withColumn("z", F.when(good, (F.col("u") - n1 * n2 / 2) / F.col("_s")))
    return full.select("gene", "grp", "sum_ranks", "u", "z", F.expr(normal_two_sided("z")).alias("p"))


def logfoldchanges(x: DataFrame, obs: DataFrame, group: str, var: DataFrame, rebalanced: bool = False) -> DataFrame:
    """(gene, grp, lfc): log2 of the group's mean less log2 of the other cells' mean, or, rebalanced, of the plain mean
    of the other groups' means. Infinite and undefined values stay as they are."""
    m = group_moments(x, obs, group, var)
    inside = F.col("total") / F.col("n")
    if rebalanced:
        gene = Window.partitionBy("gene")
        outside = ratio(F.sum(inside).over(gene) - inside, F.count("*").over(gene) - 1)
    else:
        outside = ratio(F.col("all_total") - F.col("total"), F.col("all_n") - F.col("n"))
    # sums that cancel leave a residue of rounding: count it as none
    outside = F.when(F.abs(outside) < 1e-12, 0.0).otherwise(outside)
    return m.select("gene", "grp", (log2_or_inf(inside) - log2_or_inf(outside)).alias("lfc"))


def dea(tests: DataFrame, changes: DataFrame, p: str = "adjusted", alpha: float = 0.05) -> DataFrame:
    """Tests with their fold changes, those with adjusted p of alpha or less."""
    return tests.join(changes, ["gene", "grp"], "left").filter(F.col(p) <= alpha)


def dea_binarize(tests: DataFrame, changes: DataFrame, p: str = "adjusted", alpha: float = 0.05, min_abs_lfc: float = 0.0) -> DataFrame:
    """(grp, gene, value): 1 where significant and raised, 0 where significant and not, else null."""
    hit = (F.col(p) <= alpha) & (F.abs("lfc") >= min_abs_lfc)
    return tests.join(changes, ["gene", "grp"], "left").select("grp", "gene", F.when(hit & (F.col("lfc") > 0), 1).when(hit, 0).alias("value"))


def ora(query: DataFrame, signatures: DataFrame, background: DataFrame) -> DataFrame:
    """(signature, overlap, size, expected, fold, p): over-representation of `query` (item) in `signatures`
    (signature, item) within `background` (item), by the upper tail of the hypergeometric law.

    Logarithms of factorials are a series in the expression. A signature's tail is summed by ranges of TAIL terms in
    tasks of their own, so nothing grows with the background but the sets themselves."""
    bg = background.select("item").distinct()
    q = query.select("item").distinct().join(bg, "item", "left_semi")
    s = signatures.select("signature", "item").distinct().join(bg, "item", "left_semi")
    counts = s.join(q.withColumn("_hit", F.lit(1)), "item", "left").groupBy("signature").agg(F.count("*").alias("size"), F.count("_hit").alias("overlap"))
    n, big = q.agg(F.count("*").alias("n")), bg.agg(F.count("*").alias("m"))
    sized = counts.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(big))  # one row each
    m, k1, nn = F.col("m"), F.col("size"), F.col("n")
    low, high = F.greatest(F.col("overlap"), nn + k1 - m, F.lit(0).cast("long")), F.least(k1, nn)
    ranges = sized.withColumn("_low", low).filter(F.col("_low") <= high).withColumn("_from", F.explode(F.sequence(F.col("_low"), high, F.lit(TAIL).cast("long"))))
    f = lambda i: log_factorial(i.cast("double"))
    choose = lambda a, b: f(a) - f(b) - f(a - b)
    term = lambda i: F.exp(choose(k1, i) + choose(m - k1, nn - i) - F.col("_all"))
    each = ranges.withColumn("_all", choose(m, nn)).withColumn("_i", F.explode(F.sequence(F.col("_from"), F.least(high, F.col("_from") + TAIL - 1))))
    tails = each.groupBy("signature").agg(F.sum(term(F.col("_i"))).alias("_tail"))
    p = F.when(F.col("overlap") <= F.greatest(nn + k1 - m, F.lit(0).cast("long")), 1.0).otherwise(F.least(F.coalesce("_tail", F.lit(0.0)), F.lit(1.0)))
    expected = nn * k1 / m
    out = sized.join(tails, "signature", "left")
    return out.select("signature", "overlap", "size", expected.alias("expected"), ratio(F.col("overlap"), expected).alias("fold"), p.alias("p"))


def smirnov(values: DataFrame, gene: str, value: str, side: str) -> DataFrame:
    """(gene, statistic, location, sign): largest gap of the distributions of rows with `side` true and false, the
    smallest value where it occurs and the side that leads there (1: true)."""
    counts = values.groupBy(gene, value).agg(F.count_if(F.col(side)).alias("a"), F.count_if(~F.col(side)).alias("b"))
    run, whole = Window.partitionBy(gene).orderBy(value).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(gene)
    gap = ratio(F.sum("a").over(run), F.sum("a").over(whole)) - ratio(F.sum("b").over(run), F.sum("b").over(whole))
    # exact fractions of small counts: rounding keeps equal gaps equal
    gaps = counts.withColumn("gap", F.round(gap, 12)).filter(F.col("gap").isNotNull())
    best = gaps.groupBy(gene).agg(F.min_by(F.struct("gap", value), F.struct(-F.abs("gap"), F.col(value))).alias("at"))
    return best.select(gene, F.abs("at.gap").alias("statistic"), F.col(f"at.{value}").alias("location"), F.sign("at.gap").cast("int").alias("sign"))


def _path_tail(n1: int, n2: int, gap: int, two_sided: bool) -> float:
    """Chance that a random order of n1 and n2 cells, as a path from (0, 0) to (n1, n2), somewhere has n2 x - n1 y (in
    absolute value, if two-sided) of `gap` or more. The chances of all points x + y = t are carried along; what comes to
    a point beyond adds up and goes no further, so small tails keep their digits."""
    if gap <= 0:
        return 1.0
    out, at = 0.0, np.zeros(n1 + 2)
    at[0] = 1.0
    x = np.arange(n1 + 1)
    for t in range(n1 + n2):
        y = t - x
        right = at[:-1] * np.clip(n1 - x, 0, None) / (n1 + n2 - t)
        up = at[:-1] * np.clip(n2 - y, 0, None) / (n1 + n2 - t)
        at[:-1] = up
        at[1:] += right
        at[-1] = 0.0
        here = n2 * x - n1 * (y + 1)
        beyond = (here >= gap) | (here <= -gap) if two_sided else here >= gap
        out += float(at[:-1][beyond].sum())
        at[:-1][beyond] = 0.0
    return min(out, 1.0)


#: Groups of up to so many cells get exact tails, larger ones the limit law (as common statistics packages do).
EXACT_CELLS = 10_000


def smirnov_p(n1: int, n2: int, statistic: float, alternative: str = "two-sided") -> float:
    """Tail of the two-sample Kolmogorov-Smirnov statistic."""
    two = alternative == "two-sided"
    if max(n1, n2) <= EXACT_CELLS:
        return _path_tail(n1, n2, round(statistic * n1 * n2), two)
    mean = n1 * n2 / (n1 + n2)
    z = np.sqrt(mean) * statistic
    if not two:
        big, small = max(n1, n2), min(n1, n2)
        return float(np.exp(-2 * z * z - 2 * z * (big + 2 * small) / np.sqrt(big * small * (big + small)) / 3))
    z += 1 / (6 * np.sqrt(mean))  # the limit law's first correction
    if z < 0.3:
        return 1.0
    k = np.arange(1, 101)
    return float(np.clip(2 * ((-1.0) ** (k - 1) * np.exp(-2 * k * k * z * z)).sum(), 0, 1))


def smirnov_tests(x: DataFrame, obs: DataFrame, group: str, var: DataFrame, reference: str = "rest", alternative: str = "two-sided", groups: list[str] | None = None, correction: str = "benjamini-hochberg") -> DataFrame:
    """(gene, grp, statistic, location, sign, p, adjusted): each group's distribution against the rest's, or against that
    of the `reference` group, implicit zeros included. sign 1: the group's distribution function is ahead (its values
    are smaller); `greater` and `less` look at one sign alone. Adjusted within a group.

    What is shuffled are counts of distinct values; a gene's grid is its distinct values by the groups."""
    if alternative not in ("two-sided", "greater", "less"):
        raise ValueError("alternative: two-sided, greater or less")
    labels = obs.select("cell", F.col(group).alias("grp"))
    sizes = labels.groupBy("grp").agg(F.count("*").alias("n"))  # one row a group
    counts = x.join(labels, "cell").filter("value <> 0").groupBy("gene", "grp", "value").agg(F.count("*").alias("c"))
    found = counts.groupBy("gene", "grp").agg(F.sum("c").alias("_c"))
    zeros = var.select("gene").crossJoin(F.broadcast(sizes)).join(found, ["gene", "grp"], "left").select("gene", "grp", F.lit(0.0).alias("value"), (F.col("n") - F.coalesce("_c", F.lit(0))).alias("c"))
    counts = counts.unionByName(zeros)
    tested = sizes.filter("grp is not null")
    if groups is not None:
        tested = tested.filter(F.col("grp").isin(*groups))
    tested = tested.select("grp", F.col("n").alias("n1"))
    if reference == "rest":
        other = counts.groupBy("gene", "value").agg(F.sum("c").alias("all"))
        n2 = F.col("_n") - F.col("n1")
        tested = tested.crossJoin(F.broadcast(sizes.agg(F.sum("n").alias("_n")))).select("grp", "n1", n2.alias("n2"))
    else:
        other = counts.filter(F.col("grp") == reference).groupBy("gene", "value").agg(F.sum("c").alias("all"))
        own = sizes.filter(F.col("grp") == reference).select(F.col("n").alias("n2"))
        tested = tested.filter(F.col("grp") != reference).crossJoin(F.broadcast(own))
    grid = counts.select("gene", "value").distinct().crossJoin(F.broadcast(tested))
    grid = grid.join(counts, ["gene", "grp", "value"], "left").join(other, ["gene", "value"], "left").fillna(0, ["c", "all"])
    before = Window.partitionBy("gene", "grp").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    inside, outside = F.sum("c").over(before), F.sum(F.col("all") - F.col("c") if reference == "rest" else F.col("all")).over(before)
    # whole numbers over n1 x n2, so that equal gaps are equal
    gaps = grid.withColumn("_g", inside * F.col("n2") - outside * F.col("n1"))
    top = gaps.groupBy("gene", "grp", "n1", "n2").agg(F.max("_g").alias("up"), F.min_by("value", F.struct(-F.col("_g"), F.col("value"))).alias("at_up"), F.min("_g").alias("down"), F.min_by("value", F.struct(F.col("_g"), F.col("value"))).alias("at_down"))
    ahead = {"two-sided": F.col("up") >= -F.col("down"), "greater": F.lit(True), "less": F.lit(False)}[alternative]
    best = top.filter("n1 > 0 and n2 > 0").select(
        "gene", "grp", "n1", "n2", (F.greatest(F.when(ahead, F.col("up")).otherwise(-F.col("down")), F.lit(0)) / (F.col("n1") * F.col("n2"))).alias("statistic"),
        F.when(ahead, F.col("at_up")).otherwise(F.col("at_down")).alias("location"), F.when(ahead, 1).otherwise(-1).alias("sign"),
    )

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = [smirnov_p(n1, n2, d, alternative) for n1, n2, d in zip(b["n1"].to_pylist(), b["n2"].to_pylist(), b["statistic"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], [*b.schema.names, "p"])

    out = best.mapInArrow(tails, ", ".join(f"{c} {t}" for c, t in best.dtypes) + ", p double").drop("n1", "n2")
    if correction == "benjamini-hochberg":
        return bh_adjust(out, "p", ["grp"])
    if correction == "bonferroni":
        return bonferroni_adjust(out, "p", ["grp"])
    raise ValueError("correction: benjamini-hochberg or bonferroni")


def regress_out(values: DataFrame, gene: str, value: str, key: str, intercept: bool = False) -> DataFrame:
    """Residuals of `value` on one key (with an intercept) per gene; intercept: its coefficient is added back."""
    fit = values.groupBy(gene).agg(F.regr_slope(value, key).alias("_b"), F.regr_intercept(value, key).alias("_a"), F.avg(value).alias("_m"))
    joined = values.join(fit, gene)
    slope = F.coalesce("_b", F.lit(0.0))
    base = F.coalesce("_a", "_m")
    residual = F.col(value) - slope * F.col(key) - (F.lit(0.0) if intercept else base)
    return joined.withColumn("residual", residual).drop("_a", "_b", "_m")


def regress_out_keys(values: DataFrame, gene: str, value: str, keys: list[str]) -> DataFrame:
    """Residuals on several keys: one pass of sums of products per gene, the normal equations solved per gene, and the
    coefficients joined back."""
    terms = [F.lit(1.0), *[F.col(k).cast("double") for k in keys]]
    n = len(terms)
    sums = [F.sum(terms[i] * terms[j]).alias(f"x{i}_{j}") for i in range(n) for j in range(i, n)] + [F.sum(t * F.col(value)).alias(f"y{i}") for i, t in enumerate(terms)]
    moments = values.groupBy(gene).agg(*sums)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a = np.zeros((b.num_rows, n, n))
            for i in range(n):
                for j in range(i, n):
                    a[:, i, j] = a[:, j, i] = b[f"x{i}_{j}"].to_numpy(zero_copy_only=False)
            y = np.stack([b[f"y{i}"].to_numpy(zero_copy_only=False) for i in range(n)], axis=1)
            beta = [np.linalg.lstsq(p, q, rcond=None)[0] for p, q in zip(a, y, strict=True)]
            yield pa.RecordBatch.from_arrays([b[gene], pa.array([x.tolist() for x in beta], pa.list_(pa.float64()))], [gene, "_beta"])

    kind = dict(values.dtypes)[gene]
    fit = moments.mapInArrow(solve, f"{gene} {kind}, _beta array<double>")
    fitted = sum((F.col("_beta")[i] * t for i, t in enumerate(terms)), F.lit(0.0))
    return values.join(fit, gene).withColumn("residual", F.col(value) - fitted).drop("_beta")
