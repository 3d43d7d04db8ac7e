"""Annotated matrices as long tables: x(cell, gene, value) without zeros, obs(cell, ...), var(gene, ...).

Counts of cells come from `obs` and never from the stored values, so implicit zeros take part in every moment,
median and rank. All operators return new frames.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import clip, ratio
from ..functions.lineage import settled


def with_size(df: DataFrame, axis: DataFrame, name: str = "n_obs") -> DataFrame:
    """`df` with the number of rows of `axis` (one value, so a broadcast of one row)."""
    return df.crossJoin(F.broadcast(axis.agg(F.count("*").alias(name))))


def normalize(x: DataFrame, target_sum: float = 1e4) -> DataFrame:
    """Values scaled so that each cell's sum to `target_sum`; cells whose sum is 0 stay as they are."""
    scale = F.sum("value").over(Window.partitionBy("cell")) / F.lit(float(target_sum))
    return x.withColumn("_s", scale).withColumn("value", F.col("value") / F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s"))).drop("_s")


def log1p(x: DataFrame, base: float = math.e) -> DataFrame:
    if base <= 0 or base == 1:
        raise ValueError("base: positive and not 1")
    return x.withColumn("value", F.log1p("value") / F.lit(math.log(base)))


def column_moments(x: DataFrame, obs: DataFrame, var: DataFrame | None = None) -> DataFrame:
    """(gene, n_obs, total, mean, variance): implicit zeros count; variance is never below 0. Genes of `var` without
    values have mean and variance 0."""
    sums = x.groupBy("gene").agg(F.sum("value").alias("total"), F.sum(F.col("value") * F.col("value")).alias("squares"))
    if var is not None:
        sums = var.select("gene").join(sums, "gene", "left").fillna(0.0, ["total", "squares"])
    n = F.col("n_obs")
    mean = F.col("total") / n
    spread = F.greatest(F.col("squares") / n - mean * mean, F.lit(0.0)) * F.when(n > 1, n / (n - 1)).otherwise(1.0)
    return with_size(sums, obs).select("gene", "n_obs", "total", mean.alias("mean"), spread.alias("variance"))


def scale(x: DataFrame, obs: DataFrame, var: DataFrame, zero_center: bool = True, max_value: float | None = None) -> DataFrame:
    """Values in units of their gene's standard deviation. Centred, every (cell, gene) gets a value, as implicit zeros
    become -mean / sd; else only stored values are divided. A deviation of 0 counts as 1."""
    m = column_moments(x, obs, var)
    sd = F.when(F.col("variance") > 0, F.sqrt("variance")).otherwise(1.0)
    m = m.select("gene", "mean", sd.alias("sd"))
    if zero_center:
        grid = obs.select("cell").crossJoin(m)  # the result itself is dense
        full = grid.join(x, ["cell", "gene"], "left").fillna(0.0, ["value"])
        value = (F.col("value") - F.col("mean")) / F.col("sd")
    else:
        full = x.join(m, "gene")
        value = F.col("value") / F.col("sd")
    return full.select("cell", "gene", (value if max_value is None else clip(value, max_value)).alias("value"))


def qc_obs(x: DataFrame, obs: DataFrame, top: tuple[int, ...] = (), flags: dict[str, DataFrame] | None = None) -> DataFrame:
    """Per cell: n_features, total, pct_top{k}, and total_{f}, pct_{f} for each flag's genes; log1p_* beside counts.

    Cells without values have counts of 0 and null percentages."""
    rank = F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("value"), "gene"))
    each = x.withColumn("_rank", rank) if top else x
    for name, genes in (flags or {}).items():
        each = each.join(genes.select("gene").withColumn(f"_{name}", F.lit(True)), "gene", "left")
    aggs = [F.count_if(F.col("value") > 0).alias("n_features"), F.sum("value").alias("total")]
    aggs += [F.sum(F.when(F.col("_rank") <= k, F.col("value"))).alias(f"_top{k}") for k in top]
    aggs += [F.sum(F.when(F.col(f"_{f}"), F.col("value")).otherwise(0.0)).alias(f"total_{f}") for f in flags or {}]
    counts = ["n_features", "total", *[f"total_{f}" for f in flags or {}]]
    out = obs.select("cell").join(each.groupBy("cell").agg(*aggs), "cell", "left").fillna(0, counts)
    for k in top:
        out = out.withColumn(f"pct_top{k}", 100 * ratio(F.col(f"_top{k}"), F.col("total"))).drop(f"_top{k}")
    for f in flags or {}:
        out = out.withColumn(f"pct_{f}", 100 * ratio(F.col(f"total_{f}"), F.col("total")))
    return out.withColumns({f"log1p_{c}": F.log1p(c) for c in counts})


def _order_statistic(values: DataFrame, value: str, zero: Column) -> DataFrame:
    """(gene, median) of `value` and of the `n_obs` - stored copies of `zero` per gene (n_obs and what `zero` reads are
    the same for all rows of a gene). Distinct values are counted and their counts summed up by cuts of the gene's
    range, so a gene may hold any share of the rows."""
    counts = values.withColumn("_zero", zero).groupBy("gene", value).agg(F.count("*").alias("_c"), F.first("n_obs").alias("n_obs"), F.first("_zero").alias("_zero"))
    run = running_sum(counts, "gene", value, "_c", "_run")
    top = F.col("_run") + F.when(F.col(value) > F.col("_zero"), F.col("n_obs") - F.col("_run_all")).otherwise(0)
    at = run.withColumn("_hi", top).withColumn("_lo", F.col("_hi") - F.col("_c"))
    pick = lambda p: F.coalesce(F.max(F.when((F.col("_lo") < p) & (p <= F.col("_hi")), F.col(value))), F.max("_zero"))
    return at.groupBy("gene").agg(((pick(F.floor((F.col("n_obs") + 1) / 2)) + pick(F.floor(F.col("n_obs") / 2) + 1)) / 2).alias("median"))


def sparse_median_mad(x: DataFrame, obs: DataFrame) -> DataFrame:
    """(gene, median, mad) over all cells, implicit zeros included; mad is the raw median absolute deviation."""
    stored = with_size(x, obs)
    median = _order_statistic(stored, "value", F.lit(0.0))
    away = stored.join(median, "gene").withColumn("away", F.abs(F.col("value") - F.col("median")))
    mad = _order_statistic(away, "away", F.abs("median")).withColumnRenamed("median", "mad")
    return median.join(mad, "gene")


def qc_var(x: DataFrame, obs: DataFrame, var: DataFrame) -> DataFrame:
    """Per gene: n_barcodes, total, mean, variance (not clipped; null for one cell), median, mad, pct_dropout."""
    sums = x.groupBy("gene").agg(F.count_if(F.col("value") > 0).alias("n_barcodes"), F.sum("value").alias("total"), F.sum(F.col("value") * F.col("value")).alias("_sq"))
    full = with_size(var.select("gene").join(sums, "gene", "left").fillna(0, ["n_barcodes", "total", "_sq"]), obs)
    n = F.col("n_obs")
    out = full.select(
        "gene", "n_barcodes", "total", (F.col("total") / n).alias("mean"),
        ratio(F.col("_sq") - F.col("total") * F.col("total") / n, F.when(n > 1, n - 1)).alias("variance"),
        (100 * (1 - F.col("n_barcodes") / n)).alias("pct_dropout"),
    )
    return out.join(sparse_median_mad(x, obs), "gene", "left").fillna(0.0, ["median", "mad"])


def hvg_binning(x: DataFrame, obs: DataFrame, n_bins: int = 20) -> DataFrame:
    """(gene, mean, dispersion, bin, score): dispersion against the median and spread of genes of like mean.

    Bins are cut at percentiles of the positive means (10, 15, ..., 100 for 20 bins, else n even steps). A score is
    null where its bin has no spread."""
    steps = [k / 100 for k in range(10, 101, 5)] if n_bins == 20 else [(k + 1) / n_bins for k in range(n_bins)]
    m = column_moments(x, obs).withColumn("dispersion", ratio(F.col("variance"), F.col("mean")))
    edges = m.filter("mean > 0").agg(F.sort_array(F.array_distinct(F.percentile("mean", F.array(*map(F.lit, steps))))).alias("edges"))
    binned = m.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("mean"))) - 1)
    centre = binned.groupBy("bin").agg(F.median("dispersion").alias("centre"))  # a bin is a row of a few
    binned = binned.join(F.broadcast(centre), "bin")
    spread = binned.groupBy("bin").agg(F.median(F.abs(F.col("dispersion") - F.col("centre"))).alias("spread"))
    score = ratio(F.col("dispersion") - F.col("centre"), F.col("spread") / 0.67449)
    return binned.join(F.broadcast(spread), "bin").select("gene", "mean", "dispersion", "bin", score.alias("score"))


def hvg_top(scored: DataFrame, n: int) -> DataFrame:
    """The n genes of highest score (ties: gene order); a top-k, not a sort of all."""
    return scored.filter(F.col("score").isNotNull()).orderBy(F.desc("score"), "gene").limit(n)


def hvg_cutoff(scored: DataFrame, mean: tuple[float, float] = (0.0125, 3.0), score: tuple[float, float] = (0.5, math.inf)) -> DataFrame:
    """Genes strictly inside both intervals."""
    return scored.filter((F.col("mean") > mean[0]) & (F.col("mean") < mean[1]) & (F.col("score") > score[0]) & (F.col("score") < score[1]))


def batch_moments(x: DataFrame, obs: DataFrame, batch: str) -> DataFrame:
    """(batch, gene, n_obs, mean, variance) of batches of two cells at least; cells without a batch are left out."""
    cells = obs.filter(F.col(batch).isNotNull()).select("cell", F.col(batch).alias("batch"))
    sizes = cells.groupBy("batch").agg(F.count("*").alias("n_obs")).filter("n_obs >= 2")
    sums = x.join(cells, "cell").groupBy("batch", "gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")).join(sizes, "batch")
    size = F.col("n_obs")
    mean = F.col("s") / size
    return sums.select("batch", "gene", "n_obs", mean.alias("mean"), (F.greatest(F.col("q") / size - mean * mean, F.lit(0.0)) * size / (size - 1)).alias("variance"))


def batch_binning(x: DataFrame, obs: DataFrame, batch: str) -> DataFrame:
    """(batch, gene, n_obs, mean, score): binning scores inside each batch."""
    m = batch_moments(x, obs, batch).withColumn("dispersion", ratio(F.col("variance"), F.col("mean")))
    steps = F.array(*[F.lit(k / 100) for k in range(10, 101, 5)])
    edges = m.filter("mean > 0").groupBy("batch").agg(F.sort_array(F.array_distinct(F.percentile("mean", steps))).alias("edges"))
    binned = m.join(edges, "batch").withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("mean"))) - 1)
    centre = binned.groupBy("batch", "bin").agg(F.median("dispersion").alias("centre"))
    binned = binned.join(centre, ["batch", "bin"])
    spread = binned.groupBy("batch", "bin").agg(F.median(F.abs(F.col("dispersion") - F.col("centre"))).alias("spread"))
    score = ratio(F.col("dispersion") - F.col("centre"), F.col("spread") / 0.67449)
    return binned.join(spread, ["batch", "bin"]).select("batch", "gene", "n_obs", "mean", score.alias("score"))


def _weighted_median(pairs: Column) -> Column:
    """The first value, of a sorted array of (value, weight), up to which half of the weight lies."""
    half = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["w"]) / 2
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("at"))
    step = lambda a, p: F.struct((a["sum"] + p["w"]).alias("sum"), F.when(a["at"].isNull() & (a["sum"] + p["w"] >= half), p["r"]).otherwise(a["at"]).alias("at"))
    return F.aggregate(pairs, start, step, lambda a: a["at"])


def hvg_batches(scored: DataFrame, n: int, by: str = "consensus", weighting: str = "equal", method: str = "binning") -> DataFrame:
    """Scores of batches (batch, gene, n_obs, mean, score) merged: (gene, n_batches, rank, score), best first.

    n_batches: batches whose top n hold the gene; rank: median of its ranks there; score: mean. `equal`: batches count
    alike; `cell_count`: by cells, also in the median, which is then the first rank that reaches half of the weight. By
    `rank`: (rank, -n_batches, -score); by `consensus`: (-n_batches, -score), for `loess` (-n_batches, rank, -score)."""
    if weighting not in ("equal", "cell_count"):
        raise ValueError("weighting: equal or cell_count")
    weight = F.lit(1.0) if weighting == "equal" else F.col("n_obs").cast("double")
    # sums in another order differ in the last digits: equal scores stay equal
    scored = scored.withColumn("score", F.round("score", 9)).withColumn("_w", weight)
    place = F.row_number().over(Window.partitionBy("batch").orderBy(F.desc_nulls_last("score"), "gene"))
    ranked = scored.withColumn("r", place).withColumn("r", F.when((F.col("r") <= n) & F.col("score").isNotNull(), F.col("r")))
    mean = ratio(F.sum(F.col("score") * F.col("_w")), F.sum(F.when(F.col("score").isNotNull(), F.col("_w"))))
    pairs = F.sort_array(F.collect_list(F.when(F.col("r").isNotNull(), F.struct(F.col("r").cast("double").alias("r"), F.col("_w").alias("w")))))  # one a batch
    rank = F.median("r") if weighting == "equal" else _weighted_median(pairs)
    out = ranked.groupBy("gene").agg(F.count("r").alias("n_batches"), rank.alias("rank"), mean.alias("score"))
    keys = {"rank": ["rank", "n_batches", "score"], "consensus": ["n_batches", "rank", "score"] if method == "loess" else ["n_batches", "score"]}[by]
    order = {"rank": F.asc_nulls_last("rank"), "n_batches": F.desc("n_batches"), "score": F.desc_nulls_last("score")}
    return out.orderBy(*[order[k] for k in keys], "gene")


def merge_duplicate_vars(x: DataFrame, var: DataFrame, columns: list[str], keep: str = "first") -> tuple[DataFrame, DataFrame]:
    """Values of genes of one `name` summed; annotations of the first row (by pos) or, with `consensus`, where all agree."""
    merged = x.join(var.select("gene", "name"), "gene").groupBy("cell", "name").agg(F.sum("value").alias("value"))
    if keep == "first":
        picks = [F.min_by(c, "pos").alias(c) for c in columns]
    elif keep == "consensus":
        agree = lambda c: (F.count_distinct(c) == 1) & (F.count(c) == F.count("*"))
        picks = [F.when(agree(c), F.min(c)).alias(c) for c in columns]
    else:
        raise ValueError("keep: first or consensus")
    return merged, var.groupBy("name").agg(F.min("pos").alias("pos"), *picks)


def filter_axis(x: DataFrame, axis: DataFrame, key: str, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Rows of `axis` that meet the condition, and the values on them."""
    kept = axis.filter(condition)
    return x.join(kept.select(key), key, "left_semi"), kept


def sort_axis(axis: DataFrame, key: str) -> DataFrame:
    """`axis` in the order of `key`: a range sort, as order is only how rows are shown."""
    return axis.orderBy(key)


def merge_annotations(left: DataFrame, right: DataFrame, key: str, suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Left join on the index; columns of both get the suffixes."""
    both = [c for c in left.columns if c in right.columns and c != key]
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in both})
    return left.join(right.withColumnsRenamed({c: c + suffixes[1] for c in both}), key, "left")


def transfer_layer(left: DataFrame, right: DataFrame) -> DataFrame:
    """(cell, gene, value of the right layer) on the left's entries; what the right lacks is null, what it adds is dropped."""
    return left.select("cell", "gene").join(right.select("cell", "gene", "value"), ["cell", "gene"], "left")


def transfer_to_integrated(integrated: DataFrame, samples: dict[str, DataFrame], columns: list[str], condition: str = "condition") -> DataFrame:
    """Each sample's columns on the integrated rows of its condition; keys of two samples may be alike."""
    parts = [df.select("cell", *columns).withColumn(condition, F.lit(name)) for name, df in samples.items()]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return integrated.join(whole, ["cell", condition], "left")


def transfer_to_specific(integrated: DataFrame, sample: DataFrame, name: str, columns: list[str], condition: str = "condition") -> DataFrame:
    """The integrated rows' columns on one sample."""
    return sample.join(integrated.filter(F.col(condition) == name).select("cell", *columns), "cell", "left")


def flag_genes(var: DataFrame, identifiers: DataFrame, pattern: str, column: str, name: str) -> DataFrame:
    """`var` with boolean `name`: whether the identifier table's `column` for the gene matches `pattern`."""
    known = identifiers.select(F.upper("alias").alias("_key"), F.col(column).alias("_found")).dropDuplicates(["_key"])
    joined = var.join(known, F.upper("gene") == F.col("_key"), "left")
    return joined.withColumn(name, F.coalesce(F.col("_found").rlike(pattern), F.lit(False))).drop("_key", "_found")


def to_wide(x: DataFrame, genes: list[str], is_log: float | None = None) -> DataFrame:
    """A row for each cell, a column for each listed gene; absent values 0; is_log: the base to undo log1p with."""
    value = F.col("value") if is_log is None else F.expm1(F.col("value") * F.lit(math.log(is_log)))
    return x.withColumn("value", value).groupBy("cell").pivot("gene", genes).agg(F.sum("value")).fillna(0.0)


def composition(obs: DataFrame, by: str, of: str, normalize: bool = True) -> DataFrame:
    """(by, of, n, share): cells of each pair of labels, all pairs present."""
    pairs = obs.select(by).distinct().crossJoin(obs.select(of).distinct())  # label dimensions
    counts = pairs.join(obs.groupBy(by, of).agg(F.count("*").alias("n")), [by, of], "left").fillna(0, ["n"])
    if not normalize:
        return counts
    return counts.withColumn("share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy(by))))


def running_sum(counts: DataFrame, by: str, order: str, amount: str, out: str, buckets: int = 200) -> DataFrame:
    """`counts` with `out`, the sum of `amount` up to and with each row in its group, and `{out}_all`, the group's sum.

    Groups may hold any share of the rows: each is cut at approximate quantiles of `order`, running sums are taken
    inside the cuts and the cuts' own totals (a few hundred rows a group) are added."""
    steps = F.array(*[F.lit(k / buckets) for k in range(1, buckets)])
    edges = counts.groupBy(by).agg(F.percentile_approx(order, steps, F.lit(1000)).alias("_edges"))
    cut = counts.join(edges, by).withColumn("_cut", F.size(F.filter("_edges", lambda e: e < F.col(order)))).drop("_edges")
    totals = cut.groupBy(by, "_cut").agg(F.sum(amount).alias("_t"))
    group = Window.partitionBy(by)
    before = F.coalesce(F.sum("_t").over(group.orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(by, "_cut", before.alias("_before"), F.sum("_t").over(group).alias(f"{out}_all"))
    own = F.sum(amount).over(Window.partitionBy(by, "_cut").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("_own", own).join(totals, [by, "_cut"]).withColumn(out, F.col("_before") + F.col("_own")).drop("_own", "_before", "_cut")


def ecdf(values: DataFrame, value: str, group: str) -> DataFrame:
    """(group, value, cdf): empirical distribution at each distinct value, from partial counts and their running sums."""
    counts = values.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_n"))
    return running_sum(counts, group, value, "_n", "_run").select(group, value, ratio(F.col("_run"), F.col("_run_all")).alias("cdf"))


def box_stats(values: DataFrame, value: str, group: str) -> DataFrame:
    """Quartiles, whiskers (last values within 1.5 IQR) and number of outliers per group."""
    q = values.groupBy(group).agg(F.percentile(value, F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("q"))
    q = q.select(group, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    v, reach = F.col(value), 1.5 * (F.col("q3") - F.col("q1"))
    inside = (v >= F.col("q1") - reach) & (v <= F.col("q3") + reach)
    out = values.join(F.broadcast(q), group).groupBy(group, "q1", "median", "q3")
    return out.agg(F.min(F.when(inside, v)).alias("low"), F.max(F.when(inside, v)).alias("high"), F.count_if(~inside).alias("n_out"))


def density(values: DataFrame, value: str, points: int = 50, clip_at: float = 0.99) -> DataFrame:
    """(at, density): Gaussian kernel estimate on an even grid, values clipped at a quantile, Scott's bandwidth."""
    top = values.agg(F.percentile(value, F.lit(clip_at)).alias("_top"))
    v = values.crossJoin(F.broadcast(top)).filter(F.col(value).isNotNull()).select(F.least(F.col(value), F.col("_top")).alias("v"))
    counts = v.groupBy("v").agg(F.count("*").alias("n"))
    s = counts.agg(F.sum("n").alias("_n"), F.sum(F.col("v") * F.col("n")).alias("_s"), F.sum(F.col("v") * F.col("v") * F.col("n")).alias("_q"), F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    width = F.sqrt((F.col("_q") - F.col("_s") * F.col("_s") / F.col("_n")) / (F.col("_n") - 1)) * F.pow(F.col("_n"), F.lit(-0.2))
    grid = s.withColumn("_h", width).withColumn("at", F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.col("_lo") + (F.col("_hi") - F.col("_lo")) * k / (points - 1))))
    z = (F.col("at") - F.col("v")) / F.col("_h")
    kernel = F.exp(-z * z / 2) * F.col("n") / (F.col("_n") * F.col("_h") * math.sqrt(2 * math.pi))
    return counts.crossJoin(F.broadcast(grid)).groupBy("at").agg(F.sum(kernel).alias("density"))


def mitochondrial_genes(var: DataFrame, identifiers: DataFrame, name: str = "mt") -> DataFrame:
    """`var` with a flag for genes on the mitochondrial chromosome (identifiers: alias, chromosome)."""
    return flag_genes(var, identifiers, "^MT$", "chromosome", name)


def ribosomal_genes(var: DataFrame, identifiers: DataFrame, name: str = "rps") -> DataFrame:
    """`var` with a flag for genes of ribosomal proteins by their symbols (identifiers: alias, symbol)."""
    return flag_genes(var, identifiers, "(?i)^(rps|rpl|mrps|mrpl)", "symbol", name)


def hvg_loess(x: DataFrame, obs: DataFrame, span: float = 0.3, floor: float = 1e-12, batch: str | None = None) -> DataFrame:
    """(gene, mean, variance, expected, score): variance of counts clipped at mean + sqrt(expected * cells), in units of
    the variance that a local quadratic fit of log10 variance on log10 mean expects. With `batch`, a column of `obs`:
    (batch, n_obs) too, each batch on its own.

    A fit sees, in one task a batch, one row a distinct mean of genes with positive mean and variance: genes of one mean
    have one fit, in which they weigh by their number and the sum of their log10 variances. Counts are clipped and summed
    where they lie."""
    import numpy as np
    import pyarrow as pa

    if batch is None:
        m, keys = column_moments(x, obs).withColumn("batch", F.lit(0)), ["gene"]
    else:
        m, keys = batch_moments(x, obs, batch), ["batch", "gene"]
        x = x.join(obs.select("cell", F.col(batch).alias("batch")), "cell")
    m = settled(m.filter("mean > 0 and variance > 0").select("batch", "gene", "n_obs", "mean", "variance"))  # means are joined by
    kinds = dict(m.dtypes)

    def fit(t):
        mean = t["mean"].to_numpy()
        order = np.argsort(mean, kind="stable")
        xs, count, ys = np.log10(mean[order]), t["genes"].to_numpy()[order].astype(np.float64), t["height"].to_numpy()[order]
        ends = np.cumsum(count)
        n = int(ends[-1])
        k = min(n, max(int(np.ceil(span * n)), 4))
        out = np.empty(len(xs))
        at = lambda p: int(np.searchsorted(ends, p, side="right"))  # noqa: E731  the mean of the p-th gene by mean
        lo = 0
        for i in range(len(xs)):  # the k nearest of a sorted row are a window that only moves on
            while lo + k < n:
                near, far = at(lo), at(lo + k)
                if not xs[far] - xs[i] < xs[i] - xs[near]:
                    break
                lo = int(min(ends[near], ends[far] - k))  # as far as both ends keep their means
            # a mean cut by an end of the window is the farthest, of weight 0, or the point's own
            part = slice(at(lo), at(lo + k - 1) + 1)
            d = xs[part] - xs[i]
            w = np.clip(1 - (np.abs(d) / max(np.abs(d).max(), 1e-12)) ** 3, 0, None) ** 3
            # the three normal equations of the local parabola, whose value at the point is its first coefficient
            basis = np.stack([np.ones(len(d)), d, d * d])
            out[i] = np.linalg.lstsq(basis * (w * count[part]) @ basis.T, basis @ (w * ys[part]), rcond=1e-12)[0][0]
        return pa.table({"batch": t["batch"].take(pa.array(order)), "mean": mean[order], "expected": np.maximum(10**out, floor)})

    means = m.groupBy("batch", "mean").agg(F.count("*").alias("genes"), F.sum(F.log10("variance")).alias("height"))
    trend = m.join(means.groupBy("batch").applyInArrow(fit, f"batch {kinds['batch']}, mean double, expected double"), ["batch", "mean"])
    top = F.col("mean") + F.sqrt(F.col("expected") * F.col("n_obs"))
    clipped = x.join(trend, keys).withColumn("_v", F.least(F.col("value"), top))
    sums = clipped.groupBy("batch", "gene", "n_obs", "mean", "variance", "expected").agg(F.sum("_v").alias("_s"), F.sum(F.col("_v") * F.col("_v")).alias("_q"))
    n, mean = F.col("n_obs"), F.col("mean")
    score = (n * mean * mean + F.col("_q") - 2 * mean * F.col("_s")) / ((n - 1) * F.col("expected"))
    return sums.select(*(["batch", "n_obs"] if batch else []), "gene", "mean", "variance", "expected", score.alias("score"))
