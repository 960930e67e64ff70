"""Grouped summaries, coverage tables and the tables behind distribution figures."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import join_groups, quantiles, summarise, with_quantiles
from .reshape import metrics_long
from .windows import sampling_rounds


QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def hourly_mean(df: DataFrame, ts: str, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    hour = F.date_trunc("hour", F.col(ts)).cast("timestamp_ntz").alias("datetime")
    return df.groupBy(*by, hour).agg(*[F.avg(c).alias(c) for c in values])


def hourly_agg(df: DataFrame, ts: str, functions: Mapping[str, str], by: Sequence[str] = ()) -> DataFrame:
    """``mean`` or ``sum`` by column; the sum of no value is 0."""
    hour = F.date_trunc("hour", F.col(ts)).cast("timestamp_ntz").alias("datetime")
    how = {"mean": F.avg, "sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0))}
    return df.groupBy(*by, hour).agg(*[how[f](c).alias(c) for c, f in functions.items()])


def resample(df: DataFrame, ts: str, unit: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean and number of values by period."""
    return df.groupBy(*by, F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz").alias("period")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def describe_by(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Number, mean, spread and exact quantiles. ``se`` divides by all rows, ``se_valid`` by those with a value."""
    v = F.col(value)
    out = summarise(df, by, value, QUARTILES, {"n": F.count("*"), "n_valid": F.count(v), "mean": F.avg(v), "sd": F.stddev_samp(v), "min": F.min(v), "max": F.max(v)})
    return out.withColumn("iqr", F.col("q75") - F.col("q25")).withColumn("se", F.col("sd") / F.sqrt("n")).withColumn("se_valid", F.col("sd") / F.sqrt(F.nullif("n_valid", F.lit(0))))


def count_by(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def count_distinct_by(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    return df.groupBy(*by).agg(F.countDistinct(col).alias("n_distinct"))


def rates_by(df: DataFrame, by: Sequence[str], tests: Mapping[str, Column]) -> DataFrame:
    """Rows, and for each test the number and percentage of rows that pass."""
    aggs = [a for name, t in tests.items() for a in (F.count_if(t).alias(f"n_{name}"), (100 * F.avg(F.coalesce(t, F.lit(False)).cast("int"))).alias(f"pct_{name}"))]
    return df.groupBy(*by).agg(F.count("*").alias("n"), *aggs)


def coverage(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Values and percentage by column, in one pass."""
    cols = list(cols or df.columns)
    one = df.agg(F.count("*").alias("_n"), *[F.count(F.col(c)).alias(c) for c in cols])
    return one.unpivot(["_n"], cols, "variable", "n").select("variable", "n", (100 * F.try_divide(F.col("n").cast("double"), F.col("_n"))).alias("pct"))


def missing_frac(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in cols]).unpivot([], list(cols), "variable", "missing")


def coverage_in_span(df: DataFrame, ts: str, cols: Sequence[str], span: DataFrame, span_ts: str) -> DataFrame:
    """Coverage of columns between the first and last time of another table."""
    ends = span.agg(F.min(span_ts).alias("_a"), F.max(span_ts).alias("_b"))
    return coverage(df.crossJoin(F.broadcast(ends)).where(F.col(ts).between(F.col("_a"), F.col("_b"))), cols)


def peak_low(df: DataFrame, by: Sequence[str], key: str, value: str) -> DataFrame:
    """Keys of the largest and smallest value, ties to the smallest key."""
    some = df.where(F.col(value).isNotNull())
    out = some.groupBy(*by).agg(F.max(F.struct(F.col(value).alias("v"), (-F.col(key)).alias("k"))).alias("_p"), F.min(F.struct(F.col(value).alias("v"), F.col(key).alias("k"))).alias("_l"))
    return out.select(*by, (-F.col("_p.k")).alias("peak_key"), F.col("_p.v").alias("peak_value"), F.col("_l.k").alias("low_key"), F.col("_l.v").alias("low_value"))


def concat_values(df: DataFrame, by: Sequence[str], col: str, sep: str = ", ") -> DataFrame:
    """Distinct values as one text; they are made distinct before they are collected."""
    return df.select(*by, col).where(F.col(col).isNotNull()).distinct().groupBy(*by).agg(F.array_join(F.sort_array(F.collect_list(F.col(col).cast("string"))), sep).alias("values_text"))


def crosstab(df: DataFrame, a: str, b: str, names: Sequence[str]) -> DataFrame:
    return df.groupBy(a).agg(*[F.count_if(F.col(b) == n).alias(f"{b}_{n}") for n in names])


def mean_date(df: DataFrame, by: Sequence[str], date: str) -> DataFrame:
    return df.groupBy(*by).agg(F.date_from_unix_date(F.floor(F.avg(F.unix_date(F.col(date).cast("date")))).cast("int")).alias("mean_date"))


def variance_decomp(df: DataFrame, by: Sequence[str], entity: str, value: str) -> DataFrame:
    """Variance between entities' means, mean variance within entities, and their ratio."""
    each = df.groupBy(*by, entity).agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    out = each.groupBy(*by).agg(F.var_samp("m").alias("between"), F.avg("v").alias("within"))
    return out.withColumn("ratio", F.try_divide("between", "within"))


def cv_by(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")).withColumn("cv", F.try_divide("sd", "mean"))


def channel_coverage(sources: Mapping[str, DataFrame], channels: Sequence[str]) -> DataFrame:
    """Values by channel of each source, most first."""
    parts = [coverage(df, [c for c in channels if c in df.columns]).withColumn("source", F.lit(name)) for name, df in sources.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("source", "variable", "n", "pct").orderBy("source", F.desc("n"), "variable")


def range_by(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """Smallest, median and largest value, and the range as text."""
    out = summarise(df, by, col, {"median": 0.5}, {"lo": F.min(col), "hi": F.max(col)}).select(*by, "lo", "median", "hi")
    return out.withColumn("range_text", F.concat_ws("-", F.col("lo").cast("string"), F.col("hi").cast("string")))


def pct_significant(df: DataFrame, by: Sequence[str], p: str, alpha: float = 0.05) -> DataFrame:
    return df.groupBy(*by).agg(F.count(p).alias("n"), (100 * F.avg((F.col(p) < alpha).cast("int"))).alias("pct_significant"))


def effect_range(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    return df.groupBy(*by).agg(F.min(col).alias("min_effect"), F.max(col).alias("max_effect"), (F.max(col) - F.min(col)).alias("effect_range"))


def kv_summary(df: DataFrame, exprs: Mapping[str, Column]) -> DataFrame:
    """A row for each named aggregate of the whole table."""
    return df.agg(*[e.cast("double").alias(n) for n, e in exprs.items()]).unpivot([], list(exprs), "metric", "value")


def average_predictions(df: DataFrame, by: Sequence[str], value: str, attributes: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias(value), *[F.min(a).alias(a) for a in attributes])


class Parsed(NamedTuple):
    """Rows, and what failed with its error. Both are read from ``both``, which may be written once where either is costly."""

    rows: DataFrame
    failures: DataFrame
    both: DataFrame


def split_failures(both: DataFrame, names: Sequence[str], keys: Mapping[str, str]) -> Parsed:
    """``both``: columns of rows, then those of failures, of which ``failed_error`` is NULL in rows. ``keys``: failure columns and their names."""
    failed = F.col("failed_error").isNotNull()
    return Parsed(both.where(~failed).select(*[f"`{n}`" for n in names]), both.where(failed).select(*[F.col(c).alias(n) for c, n in keys.items()], F.col("failed_error").alias("error")), both)


def apply_by(df: DataFrame, by: Sequence[str], fn: Callable, schema: str, safe: bool = False) -> DataFrame:
    """A pandas function by group; a failure ends the job, with ``safe`` its group has no rows: ``apply_by_checked`` tells which. For groups of bounded size, as of one entity or model."""
    return apply_by_checked(df, by, fn, schema, safe).rows


def apply_by_checked(df: DataFrame, by: Sequence[str], fn: Callable, schema: str, safe: bool = True) -> Parsed:
    """The function's rows, and key and error of each group on which it failed."""
    names, kinds = [f.split()[0] for f in schema.split(",")], dict(df.select(*by).dtypes)
    keys = {f"failed_{i}": b for i, b in enumerate(by)}

    def run(key, pdf):
        import pandas as pd

        try:
            return fn(pdf)[names].assign(**dict.fromkeys(keys), failed_error=None)
        except Exception as e:
            if not safe:
                raise
            return pd.DataFrame([[None] * len(names) + [*key, f"{type(e).__name__}: {e}"]], columns=[*names, *keys, "failed_error"])

    both = df.groupBy(*by).applyInPandas(run, ", ".join([schema, *(f"{k} {kinds[b]}" for k, b in keys.items()), "failed_error string"]))
    return split_failures(both, names, keys)


# --- tables behind figures ------------------------------------------------------------------


def histogram(df: DataFrame, col: str, lo: float, hi: float, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts of equal bins; the upper end is in the last bin, values outside are left out."""
    width = (hi - lo) / bins
    k = F.least(F.floor((F.col(col) - lo) / width), F.lit(bins - 1)).cast("int")
    return df.where(F.col(col).between(lo, hi)).groupBy(*by, k.alias("bin")).agg(F.count("*").alias("n")).withColumn("left", lo + F.col("bin") * width)


def box_stats(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """Quartiles, whiskers at the last values within 1.5 IQR, and outliers."""
    q = quantiles(df, by, col, QUARTILES)
    lo, hi = F.col("q25") - 1.5 * (F.col("q75") - F.col("q25")), F.col("q75") + 1.5 * (F.col("q75") - F.col("q25"))
    joined = join_groups(df, q, by, "inner")
    inside = F.col(col).between(lo, hi)
    out = joined.groupBy(*by).agg(F.first("q25").alias("q25"), F.first("median").alias("median"), F.first("q75").alias("q75"), F.min(F.when(inside, F.col(col))).alias("whisker_low"), F.max(F.when(inside, F.col(col))).alias("whisker_high"), F.count_if(~inside).alias("n_outliers"))
    return out


def trend(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def bin2d(df: DataFrame, x: str, y: str, x_range: tuple[float, float], y_range: tuple[float, float], nx: int, ny: int) -> DataFrame:
    bin_ = lambda c, r, n: F.least(F.floor((F.col(c) - r[0]) / ((r[1] - r[0]) / n)), F.lit(n - 1)).cast("int")
    inside = df.where(F.col(x).between(*x_range) & F.col(y).between(*y_range))
    return inside.groupBy(bin_(x, x_range, nx).alias("x_bin"), bin_(y, y_range, ny).alias("y_bin")).agg(F.count("*").alias("n"))


def median_band(df: DataFrame, by: Sequence[str], value: str, noise: str | None = None) -> DataFrame:
    """Median and quartiles by group; with a column of noise floors, also the envelope of plus and minus their median."""
    out = summarise(df, by, value, QUARTILES, {"n": F.count(value)})
    if noise is None:
        return out.select(*by, *QUARTILES, "n")
    out = with_quantiles(out, df, by, noise, {"noise_high": 0.5})
    return out.select(*by, *QUARTILES, "n", (-F.col("noise_high")).alias("noise_low"), "noise_high")


def round_means(df: DataFrame, date: str, value: str, by: Sequence[str], gap_days: int = 7) -> DataFrame:
    """Mean, standard error and mean date by sampling round and group."""
    rounds = sampling_rounds(df, date, gap_days)
    return rounds.groupBy("round", *by).agg(F.date_from_unix_date(F.floor(F.avg(F.unix_date(F.col(date)))).cast("int")).alias("mean_date"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count("*"))).alias("se"), F.count("*").alias("n"))


def metric_summary(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return metrics_long(df, ids, metrics).groupBy(*ids, "metric").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))
