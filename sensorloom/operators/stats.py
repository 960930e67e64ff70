"""Correlations, rolling-window sweeps, adjusted p-values and groups of related predictors."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import stars
from .numerics import f_pvalue, t_pvalue
from .quantiles import LARGE, join_groups, value_ranks
from .reshape import metrics_long
from .shared import use_checkpoints
from .windows import rank_avg, top1, topn


def anomaly(long: DataFrame, ts: str = "datetime", series: Sequence[str] = ("variable",), value: str = "value") -> DataFrame:
    """x - (mean by day of year + mean by hour - mean), by series: three small aggregates joined to the readings."""
    d = long.withColumn("_doy", F.dayofyear(ts)).withColumn("_hour", F.hour(ts))
    s = list(series)
    by_day = d.groupBy(*s, "_doy").agg(F.avg(value).alias("_md"))
    by_hour = d.groupBy(*s, "_hour").agg(F.avg(value).alias("_mh"))
    whole = d.groupBy(*s).agg(F.avg(value).alias("_m"))
    d = d.join(by_day, [*s, "_doy"]).join(by_hour, [*s, "_hour"]).join(whole, s)
    return d.withColumn("anomaly", F.col(value) - (F.col("_md") + F.col("_mh") - F.col("_m"))).drop("_doy", "_hour", "_md", "_mh", "_m")


def _clean_r(r: Column) -> Column:
    return F.when(~F.isnan(r), r)


def corr_columns(x: str, y: str, min_n: int) -> list[Column]:
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    n = F.count_if(both)
    return [F.when(n >= min_n, _clean_r(F.corr(F.when(both, F.col(x)), F.when(both, F.col(y))))).alias("r"), n.alias("n")]


def with_p(df: DataFrame, r: str = "r", n: str = "n") -> DataFrame:
    """Two-sided p of a correlation, on result rows."""
    freedom = F.col(n) - 2
    t = F.col(r) * F.sqrt(freedom / F.nullif(1 - F.col(r) * F.col(r), F.lit(0.0)))
    return df.withColumn("p", F.when(F.abs(r) < 1, t_pvalue(t, freedom)).when(F.col(r).isNotNull(), 0.0))


def pearson(df: DataFrame, by: Sequence[str], x: str, y: str, min_n: int = 5, p: bool = True) -> DataFrame:
    out = df.groupBy(*by).agg(*corr_columns(x, y, min_n))
    return with_p(out) if p else out


def corr_by_levels(df: DataFrame, x: str, y: str, levels: Sequence[Sequence[str]], min_n: int = 4, p: bool = False) -> DataFrame:
    """Correlations by several groupings in one pass; columns outside a grouping read 'all'."""
    cols = list(dict.fromkeys(c for level in levels for c in level))
    out = df.groupingSets([[F.col(c) for c in level] for level in levels], *cols).agg(*corr_columns(x, y, min_n), *[F.grouping(c).alias(f"_g_{c}") for c in cols])
    out = out.select(*[F.when(F.col(f"_g_{c}") == 1, "all").otherwise(F.col(c).cast("string")).alias(c) for c in cols], "r", "n")
    return with_p(out) if p else out


def prefix_sums(long: DataFrame, series: Sequence[str], ts: str, value: str, chunk: str = "month") -> DataFrame:
    """Row number and running sums of values, counts and squares of each series.

    Sums run inside chunks of time and are carried over by the chunks' totals, so a long series
    is spread over tasks. Values are taken off their series' mean first, against cancellation; ``centre`` is that mean.
    """
    s = list(series)
    centre = long.groupBy(*s).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("centre"))
    d = long.join(F.broadcast(centre) if not s else centre, s).withColumn("_x", F.col(value) - F.col("centre")).withColumn("_chunk", F.date_trunc(chunk, ts))
    total = d.groupBy(*s, "_chunk").agg(F.count("*").alias("_tn"), F.coalesce(F.sum("_x"), F.lit(0.0)).alias("_ts"), F.count("_x").alias("_tc"), F.coalesce(F.sum(F.col("_x") * F.col("_x")), F.lit(0.0)).alias("_tq"))
    earlier = Window.partitionBy(*s).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = total.select(*s, "_chunk", *[F.coalesce(F.sum(f"_t{k}").over(earlier), F.lit(0)).alias(f"_p{k}") for k in "nscq"])
    w = Window.partitionBy(*s, "_chunk").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    x = F.coalesce(F.col("_x"), F.lit(0.0))
    d = d.select(*s, ts, "centre", "_chunk", F.count("*").over(w).alias("_n"), F.sum(x).over(w).alias("_s"), F.count("_x").over(w).alias("_c"), F.sum(x * x).over(w).alias("_q"))
    out = d.join(carried, [*s, "_chunk"])
    return out.select(*s, ts, "centre", (F.col("_n") + F.col("_pn")).alias("rn"), (F.col("_s") + F.col("_ps")).alias("S"), (F.col("_c") + F.col("_pc")).alias("C"), (F.col("_q") + F.col("_pq")).alias("Q"))


def window_features(points: DataFrame, long: DataFrame, windows: Sequence[int], series: Sequence[str] = ("variable",), ts: str = "datetime", value: str = "value") -> DataFrame:
    """Trailing mean, sum and sd over the last n rows at each point's time, for each n: two lookups in running sums instead of a frame for each n.

    ``points`` has ``ts``; a window that begins before the series does is left out. A mean of no value is NULL, a sum 0.
    """
    s = list(series)
    sums = prefix_sums(long, s, ts, value)
    hi = points.join(sums, ts).withColumn("window", F.explode(F.array(*[F.lit(int(n)) for n in windows]))).where(F.col("rn") >= F.col("window")).withColumn("_lo", F.col("rn") - F.col("window"))
    low = sums.select(*s, F.col("rn").alias("_lo"), *[F.col(k).alias(f"_{k}0") for k in "SCQ"])
    d = hi.join(low, [*s, "_lo"], "left")
    delta = {k: F.col(k) - F.coalesce(F.col(f"_{k}0"), F.lit(0)) for k in "SCQ"}
    d = d.select(*points.columns, *s, "window", "centre", *[c.alias(f"_{k}") for k, c in delta.items()])
    mean = F.try_divide("_S", "_C")
    var = F.when(F.col("_C") >= 2, F.greatest((F.col("_Q") - F.col("_S") * mean) / (F.col("_C") - 1), F.lit(0.0)))
    return d.withColumn("mean", mean + F.col("centre")).withColumn("sum", F.col("_S") + F.col("_C") * F.col("centre")).withColumn("sd", F.sqrt(var)).drop("centre", "_S", "_C", "_Q")


def window_sweep(flux: DataFrame, long: DataFrame, windows: Sequence[int], y: str = "flux", by: Sequence[str] = ("site",), series: Sequence[str] = ("variable",), ts: str = "datetime", stats: Sequence[str] = ("mean",), min_n: int = 5, p: bool = False) -> DataFrame:
    """Correlation of y with trailing statistics of every variable over every window, by group.

    The features of a time are the same for all measurements at it, so these are summed up by time and group first (number, mean and
    squares of y): the windows multiply times, however many measurements they have.
    """
    g, yc = list(by), F.col(y).cast("double")
    centre = flux.groupBy(*g).agg(F.avg(yc).alias("_centre"))
    at = flux.where(yc.isNotNull()).groupBy(ts, *g).agg(F.count("*").alias("_n"), F.avg(yc).alias("_m"), (F.var_pop(yc) * F.count("*")).alias("_v"))
    at = (at.join(centre, g) if g else at.crossJoin(F.broadcast(centre))).withColumn("_m", F.col("_m") - F.col("_centre")).drop("_centre")
    f = window_features(at, long, windows, series, ts)
    f = f.unpivot(["_n", "_m", "_v", *g, *series, "window"], list(stats), "stat", "feature")
    n, m, x = F.when(F.col("feature").isNotNull(), F.col("_n")), F.col("_m"), F.col("feature")
    out = f.groupBy(*g, *series, "window", "stat").agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("n"), F.sum(n * x).alias("_x"), F.sum(n * m).alias("_y"), F.sum(n * x * x).alias("_xx"), F.sum(n * x * m).alias("_xy"), F.sum(F.when(x.isNotNull(), F.col("_v")) + n * m * m).alias("_yy")
    )
    cov = lambda c, a, b: F.col(c) - F.col(a) * F.col(b) / F.col("n")
    xx, yy = cov("_xx", "_x", "_x"), cov("_yy", "_y", "_y")
    r = F.try_divide(cov("_xy", "_x", "_y"), F.sqrt(F.when((xx > 1e-12 * F.col("_xx")) & (yy > 1e-12 * F.col("_yy")), xx * yy)))
    out = out.select(*g, *series, "window", "stat", F.when(F.col("n") >= min_n, F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0))).alias("r"), "n")
    return with_p(out) if p else out


def flag_significant(sweep: DataFrame, alpha: float = 0.05, p: str = "p") -> DataFrame:
    """``significant``: p below alpha; NULL without p."""
    return sweep.withColumn("significant", F.col(p) < alpha)


def category_summary(flagged: DataFrame, category: Column, by: Sequence[str] = ("site",), variable: str = "variable") -> DataFrame:
    """Variables, mean and largest |r|, and percentage significant by category and group, the strongest first. Rows without r count for no mean."""
    out = flagged.withColumn("category", category).groupBy("category", *by).agg(
        F.countDistinct(variable).alias("n_variables"), F.avg(F.abs("r")).alias("mean_abs_r"), F.max(F.abs("r")).alias("max_abs_r"), (100 * F.avg(F.col("significant").cast("int"))).alias("pct_significant")
    )
    return out.orderBy(F.desc("max_abs_r"), "category", *by)


def both_modes(long: DataFrame, ts: str = "datetime", series: str = "variable", value: str = "value") -> DataFrame:
    """The readings as ``raw`` and as ``anomaly``, in a column ``mode``."""
    a = anomaly(long, ts, [series], value)
    return a.select(series, ts, F.explode(F.array(F.struct(F.lit("raw").alias("mode"), F.col(value).alias("value")), F.struct(F.lit("anomaly").alias("mode"), F.col("anomaly").alias("value")))).alias("_m")).select(series, ts, "_m.mode", "_m.value")


def bh_adjust(df: DataFrame, by: Sequence[str], p: str, out: str = "p_adj", large: int = LARGE) -> DataFrame:
    """Benjamini-Hochberg: p n / rank, made monotone from the largest p; NULL keeps NULL and does not count.

    Works on distinct p, as equal ones share the adjusted value. A large group is cut into bins of p: the smallest value from a
    p upwards is that in its bin or that of all later bins, so no window is over a whole large group.
    """
    names = [f"_k{i}" for i in range(len(by))]
    r = value_ranks(df.select(*[F.col(b).alias(k) for b, k in zip(by, names, strict=True)], F.col(p).alias("_p")), names, "_p", large)
    r = r.withColumn("_q", F.col("x") * F.col("n") / (F.col("before") + F.col("c")))
    here = Window.partitionBy(*names, "bin").orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy(*(names or [F.lit(0)])).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    least = r.groupBy(*names, "bin").agg(F.min("_q").alias("_m")).withColumn("_later", F.min("_m").over(later)).drop("_m")
    r = join_groups(r.withColumn("_here", F.min("_q").over(here)), least, [*names, "bin"])
    r = r.select(*[F.col(k).alias(b) for b, k in zip(by, names, strict=True)], F.col("x").alias("_x"), F.least(F.lit(1.0), F.col("_here"), F.col("_later")).alias(out))
    return join_groups(df.withColumn("_x", F.col(p).cast("double")), r, [*by, "_x"]).drop("_x")


def best_windows(sweep: DataFrame, by: Sequence[str], variable: str = "variable", alpha: float = 0.05, p: bool = True) -> DataFrame:
    """Each variable's window of largest |r|, ties to the smaller; p adjusted over the variables of a group."""
    best = top1(sweep.where(F.col("r").isNotNull()), [*by, variable], [F.abs("r").desc(), F.asc("window")])
    if not p:
        return best
    return bh_adjust(best, by, "p").withColumn("significant", F.col("p_adj") < alpha)


def compare_raw_anomaly(best: DataFrame, by: Sequence[str], variable: str = "variable") -> DataFrame:
    """r of both modes, their difference and whether the signs agree."""
    r = lambda m: F.max(F.when(F.col("mode") == m, F.col("r")))
    out = best.groupBy(*by, variable).agg(r("raw").alias("r_raw"), r("anomaly").alias("r_anomaly"))
    return out.withColumn("delta_r", F.col("r_anomaly") - F.col("r_raw")).withColumn("same_sign", F.signum("r_raw") == F.signum("r_anomaly"))


def largest_changes(compared: DataFrame, by: Sequence[str], k: int = 5, variable: str = "variable") -> DataFrame:
    """The k variables of each group whose r changes most between the modes, ties by name."""
    return topn(compared, by, [F.abs("delta_r").desc_nulls_last(), F.asc(variable)], k, ties=False)


def shared_variables(best: DataFrame, by: Sequence[str], group: str, groups: int, variable: str = "variable") -> DataFrame:
    """Variables that are significant in all ``groups`` groups, with their smallest |r|."""
    out = best.where("significant").groupBy(*by, variable).agg(F.countDistinct(group).alias(f"{group}s"), F.min(F.abs("r")).alias("weakest"))
    return out.where(F.col(f"{group}s") == groups)


def metric_correlations(df: DataFrame, metrics: Sequence[str], y: str, levels: Sequence[Sequence[str]], min_n: int = 4) -> DataFrame:
    """r, n, r2, p and stars of every metric with y, by several groupings in one pass; columns outside a grouping read 'all'."""
    cols = list(dict.fromkeys(c for level in levels for c in level))
    long = metrics_long(df, [*cols, y], metrics)
    out = corr_by_levels(long, "value", y, [["metric", *level] for level in levels], min_n, p=True)
    return out.select("metric", *cols, "r", "n", (F.col("r") * F.col("r")).alias("r2"), "p", stars("p").alias("stars"))


def forced_features(points: DataFrame, long: DataFrame, windows: Mapping[str, int], key: str, ts: str = "datetime", variable: str = "variable") -> DataFrame:
    """One given window for each variable, wide: ``<variable>_raw_<n>h``; a window of one hour is the value itself."""
    some = long.where(F.col(variable).isin(list(windows)))
    f = window_features(points.select(key, ts), some, sorted(set(windows.values())), [variable], ts)
    return f.groupBy(key).agg(*[F.max(F.when((F.col(variable) == v) & (F.col("window") == n), F.col("mean"))).alias(f"{v}_raw_{n}h") for v, n in windows.items()])


def significance_report(best: DataFrame, by: Sequence[str], variable: str = "variable", k: int = 5) -> DataFrame:
    """Significant variables of a group: number, signs, names, the strongest k, and the range of windows."""
    sig = best.where("significant").withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(F.abs("r").desc(), variable)))
    names = lambda c: F.array_join(F.sort_array(F.collect_list(c)), ",")
    return sig.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("r") > 0).alias("n_pos"), F.count_if(F.col("r") < 0).alias("n_neg"), names(variable).alias("names"), names(F.when(F.col("_k") <= k, F.col(variable))).alias("top"), F.min("window").alias("min_window"), F.percentile("window", F.lit(0.5)).alias("median_window"), F.max("window").alias("max_window"))


def corr_matrix(df: DataFrame, cols: Sequence[str], min_n: int = 2) -> DataFrame:
    """``a, b, r, n`` of every pair over rows where both have values: one aggregate of all pairs (for up to about 60 columns)."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(F.when(both(a, b), F.col(a)), F.when(both(a, b), F.col(b))).alias("r"), F.count_if(both(a, b)).alias("n")) for a, b in pairs]
    upper = df.agg(F.array(*cells).alias("_c")).select(F.inline("_c"))
    upper = upper.withColumn("r", F.when(F.col("n") >= min_n, _clean_r(F.col("r"))))
    lower = upper.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "r", "n")
    return upper.unionByName(lower)


def redundant_pairs(cm: DataFrame, threshold: float = 0.7) -> DataFrame:
    return cm.where((F.col("a") < F.col("b")) & (F.abs("r") >= threshold)).withColumn("abs_r", F.abs("r")).orderBy(F.desc("abs_r"), "a", "b")


def corr_clusters(cm: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``variable, cluster`` (its smallest name): components of |r| >= threshold, by spreading the smallest label along edges until nothing changes.

    The table has a row for each variable, so its few rounds are cheap; labels are cut off from their lineage in each.
    """
    spark = cm.sparkSession
    use_checkpoints(spark)
    edges = cm.where((F.col("a") != F.col("b")) & (F.abs("r") >= threshold)).select("a", "b").distinct().checkpoint()
    labels = cm.select(F.col("a").alias("variable")).distinct().withColumn("cluster", F.col("variable")).checkpoint()
    while True:
        near = edges.join(labels, edges["b"] == labels["variable"]).groupBy("a").agg(F.min("cluster").alias("_n"))
        new = labels.join(near, labels["variable"] == near["a"], "left").select("variable", F.least("cluster", F.coalesce("_n", "cluster")).alias("_new"), "cluster").checkpoint()
        done = not new.where("_new <> cluster").limit(1).count()
        labels = new.select("variable", F.col("_new").alias("cluster"))
        if done:
            return labels


def select_representatives(features: DataFrame, clusters: DataFrame, variable: str = "variable", r: str = "r", missing: str = "missing") -> DataFrame:
    """One variable a cluster: the largest |r|, then the least missing, then by name; with those that it stands for."""
    d = features.join(clusters, variable).withColumn("_k", F.row_number().over(Window.partitionBy("cluster").orderBy(F.abs(r).desc(), F.asc(missing), variable)))
    dropped = F.array_join(F.sort_array(F.collect_list(F.when(F.col("_k") > 1, F.col(variable)))), ",")
    return d.groupBy("cluster").agg(F.max(F.when(F.col("_k") == 1, F.col(variable))).alias("representative"), dropped.alias("dropped"), F.count("*").alias("size"))


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str, min_n: int = 5, p: bool = True) -> DataFrame:
    """Correlation of average ranks; p by the t approximation."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = rank_avg(rank_avg(both, by, x, "_rx"), by, y, "_ry")
    return pearson(ranked, by, "_rx", "_ry", min_n, p)


def two_level_corr(df: DataFrame, by: Sequence[str], entity: str, x: str, y: str, min_n: int = 4) -> DataFrame:
    """Correlations of single rows and of entities' means side by side."""
    rows = pearson(df, by, x, y, min_n, p=False).select(*by, F.col("r").alias("r_rows"), F.col("n").alias("n_rows"))
    means = df.groupBy(*by, entity).agg(F.avg(x).alias(x), F.avg(y).alias(y))
    ents = pearson(means, by, x, y, min_n, p=False).select(*by, F.col("r").alias("r_entities"), F.col("n").alias("n_entities"))
    return rows.join(ents, list(by), "full") if by else rows.crossJoin(ents)


def anova_oneway(df: DataFrame, factor: str, y: str, p: bool = True) -> DataFrame:
    """Sums of squares between and within groups, share between, F and p, from one grouping."""
    g = df.where(F.col(y).isNotNull() & F.col(factor).isNotNull()).groupBy(factor).agg(F.count(y).alias("n"), F.avg(y).alias("m"), F.coalesce(F.var_samp(y) * (F.count(y) - 1), F.lit(0.0)).alias("w"))
    one = g.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("w").alias("ss_within"), F.sum(F.col("n") * F.col("m")).alias("_t"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("_q"))
    one = one.withColumn("ss_between", F.col("_q") - F.col("_t") * F.col("_t") / F.col("n")).withColumn("df1", F.col("k") - 1).withColumn("df2", F.col("n") - F.col("k"))
    one = one.withColumn("share", F.try_divide(F.col("ss_between"), F.col("ss_between") + F.col("ss_within"))).withColumn("f", F.try_divide(F.try_divide(F.col("ss_between"), F.col("df1")), F.try_divide(F.col("ss_within"), F.col("df2"))))
    out = one.select("df1", "df2", "ss_between", "ss_within", "share", "f")
    return out.withColumn("p", f_pvalue(F.col("f"), F.col("df1"), F.col("df2"))) if p else out


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))
