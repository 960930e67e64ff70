"""Sensor networks: long tables, baseline-adjusted means, the aligned hourly dataset."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import add_calendar, match_cols, null_sentinels, parse_ts12
from .joins import union_all
from .quantiles import quantiles, summarise
from .reshape import replicate_mean, to_long


def median(col: str) -> Column:
    return F.percentile(col, F.lit(0.5))


def sensor_long(df: DataFrame, prefix: str, ts12: str = "TIMESTAMP_START", years: tuple[int, int] | None = None, codes: Sequence[float] = (-9999,), include_pi: bool = False) -> DataFrame:
    """``datetime, sensor, value`` of a wide instrument table: one narrow stage."""
    cols = match_cols(df, prefix, include_pi)
    rows = df.select(parse_ts12(ts12).alias("datetime"), *[F.col(c).cast("double").alias(c) for c in cols])
    if years:
        rows = rows.where(F.year("datetime").between(*years))
    return to_long(null_sentinels(rows, cols, codes), ["datetime"], cols)


def baseline_adjusted_mean(long: DataFrame, start: str, end: str, agg: Callable[[str], Column] = median, min_sensors: int = 4, by: Sequence[str] = (), ts: str = "datetime", sensor: str = "sensor", value: str = "value") -> DataFrame:
    """Mean of the sensors' differences from their own baselines, plus the mean baseline.

    A sensor's baseline is ``agg`` of its values in [start, end); sensors without one are left
    out. ``n_sensors`` counts distinct sensors; times with fewer than ``min_sensors`` go.
    """
    inside = long.where((F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) < F.lit(end).cast("timestamp_ntz")))
    base = inside.groupBy(*by, sensor).agg(agg(value).alias("_b")).where("_b is not null")
    grand = base.groupBy(*by).agg(F.avg("_b").alias("_g"))
    joined = long.join(base, [*by, sensor])
    mean = joined.groupBy(*by, ts).agg(F.avg(F.col(value) - F.col("_b")).alias("_d"), F.countDistinct(sensor).alias("n_sensors")).where(F.col("n_sensors") >= min_sensors)
    out = mean.join(grand, list(by)) if by else mean.crossJoin(F.broadcast(grand))
    return out.select(*by, ts, (F.col("_d") + F.col("_g")).alias("adjusted"), "n_sensors")


def baseline_sensitivity(long: DataFrame, windows: Mapping[str, tuple[str, str]], min_sensors: int = 4, ts: str = "datetime", sensor: str = "sensor", value: str = "value") -> DataFrame:
    """The adjusted mean for several baseline windows in one plan: readings meet the few baselines of their sensor."""
    names = F.array(*[F.struct(F.lit(n).alias("window"), F.lit(a).cast("timestamp_ntz").alias("a"), F.lit(b).cast("timestamp_ntz").alias("b")) for n, (a, b) in windows.items()])
    inside = long.withColumn("_w", F.explode(names)).where((F.col(ts) >= F.col("_w.a")) & (F.col(ts) < F.col("_w.b")))
    base = inside.groupBy(F.col("_w.window").alias("window"), sensor).agg(median(value).alias("_b")).where("_b is not null")
    grand = base.groupBy("window").agg(F.avg("_b").alias("_g"))
    mean = long.join(base, sensor).groupBy("window", ts).agg(F.avg(F.col(value) - F.col("_b")).alias("_d"), F.countDistinct(sensor).alias("n_sensors")).where(F.col("n_sensors") >= min_sensors)
    return mean.join(F.broadcast(grand), "window").select("window", ts, (F.col("_d") + F.col("_g")).alias("adjusted"), "n_sensors")


def five_numbers(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """Minimum, 5 %, median, 95 % and maximum by group."""
    probs = {"min": 0.0, "p05": 0.05, "med": 0.5, "p95": 0.95, "max": 1.0}
    return summarise(df, by, col, probs, {"n": F.count(col)}).select(*by, "n", *probs)


def coverage_summary(df: DataFrame, by: Sequence[str] = (), n: str = "n_sensors") -> DataFrame:
    return five_numbers(df, by, n)


def baseline_summary(base: DataFrame, by: Sequence[str] = (), value: str = "baseline") -> DataFrame:
    return five_numbers(base, by, value)


def coverage_strata(df: DataFrame, probs: Sequence[float], n: str = "n_sensors", value: str = "adjusted") -> DataFrame:
    """Box statistics by stratum of the number of sensors: bins between its distinct quantiles, right-closed, the lowest included.

    Where fewer than two quantiles differ, bins of equal width between the ends; a constant number has no strata.
    """
    names = [f"q{i}" for i in range(len(probs))]
    breaks = quantiles(df, [], n, dict(zip(names, probs, strict=True))).select(F.array_distinct(F.array(*names)).alias("_b"))
    ends = df.agg(F.min(n).cast("double").alias("_lo"), F.max(n).cast("double").alias("_hi"))
    even = F.array(*[F.col("_lo") + (F.col("_hi") - F.col("_lo")) * i / (len(probs) - 1) for i in range(len(probs))])
    breaks = breaks.crossJoin(F.broadcast(ends)).where("_lo < _hi").select(F.when(F.size("_b") > 2, F.col("_b")).otherwise(even).alias("_b"))
    d = df.crossJoin(F.broadcast(breaks)).withColumn("stratum", F.greatest(F.size(F.filter("_b", lambda b: b < F.col(n))), F.lit(1)))
    return summarise(d, ["stratum"], value, {"q25": 0.25, "median": 0.5, "q75": 0.75}, {"n_lo": F.min(n), "n_hi": F.max(n), "rows": F.count("*")})


def replicate_pairs(df: DataFrame, ts: str, a: str, b: str) -> DataFrame:
    """Monthly means of two channels where both have values, with their agreement."""
    both = df.dropna(subset=[a, b]).groupBy(F.date_trunc("month", ts).cast("timestamp_ntz").alias("month"))
    return both.agg(F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.corr(a, b).alias("r"), F.regr_slope(b, a).alias("slope"), F.count("*").alias("n"))


def monthly_channels(df: DataFrame, ts: str, channels: Sequence[str], name: str) -> DataFrame:
    """Monthly mean and number of values of each channel of a tower."""
    long = to_long(df, [ts], channels, "channel")
    return long.groupBy("channel", F.date_trunc("month", ts).cast("timestamp_ntz").alias("month")).agg(F.avg("value").alias("mean"), F.count("value").alias("n")).withColumn("tower", F.lit(name))


def build_aligned(sources: Sequence[DataFrame | None], years: tuple[int, int] | None = None, ts: str = "datetime", *, replicates: Mapping[str, str] | None = None, daily: Sequence[DataFrame | None] = (), date: str = "date") -> DataFrame:
    """One row an hour with the hourly mean of every column of all sources that are there, and calendar columns.

    Sources go to long form and meet in one grouping by hour, so any number of them costs
    one shuffle, and the hours are the union of all their hours. ``replicates`` (name: pattern of whole column names) are means of an hour's
    replicate columns. ``daily`` sources have a date: their values stand at every hour of the backbone on that day and add no hours, as one join for all of them.
    """
    there = [s for s in sources if s is not None]
    names = [c for s in there for c in s.columns if c != ts]
    every = union_all([s.select(F.date_trunc("hour", ts).cast("timestamp_ntz").alias(ts), *[F.col(c).cast("double").alias(c) for c in s.columns if c != ts]) for s in there])
    wide = every.where(F.col(ts).isNotNull()).groupBy(ts).agg(*[F.avg(c).alias(c) for c in dict.fromkeys(names)])
    for out, pattern in (replicates or {}).items():
        wide = replicate_mean(wide, out, pattern)
    days = [s for s in daily if s is not None]
    if days:
        values = list(dict.fromkeys(c for s in days for c in s.columns if c != date))
        per_day = union_all([s.select(F.col(date).cast("date").alias("_day"), *[F.col(c).cast("double").alias(c) for c in s.columns if c != date]) for s in days])
        per_day = per_day.where(F.col("_day").isNotNull()).groupBy("_day").agg(*[F.avg(c).alias(c) for c in values])
        wide = wide.withColumn("_day", F.to_date(ts)).join(per_day, "_day", "left").drop("_day")
    out = add_calendar(wide, ts)
    return out if years is None else out.where(F.col("year").between(*years))


def towers_hourly(towers: Mapping[str, DataFrame], prefixes: Mapping[str, str], start: str, end: str, min_sensors: int = 4) -> DataFrame:
    """Adjusted hourly means of several towers and variables, wide: one keyed plan for all of them."""
    long = union_all([sensor_long(df, p).withColumn("series", F.lit(f"{v}_{t}")) for t, df in towers.items() for v, p in prefixes.items()])
    mean = baseline_adjusted_mean(long, start, end, min_sensors=min_sensors, by=["series"])
    names = [f"{v}_{t}" for t in towers for v in prefixes]
    hourly = mean.groupBy(F.date_trunc("hour", "datetime").cast("timestamp_ntz").alias("datetime"))
    return hourly.agg(*[F.avg(F.when(F.col("series") == n, F.col("adjusted"))).alias(n) for n in names])


def hydromet_hourly(hydro: DataFrame, met: DataFrame, levels: Sequence[str], means: Sequence[str], rain: str, ts: str = "datetime") -> DataFrame:
    """Hourly water levels with hourly weather beside them; rain is summed, no rain reading is 0."""
    hour = F.date_trunc("hour", ts).cast("timestamp_ntz").alias(ts)
    h = hydro.groupBy(hour).agg(*[F.avg(c).alias(c) for c in levels])
    m = met.groupBy(hour).agg(*[F.avg(c).alias(c) for c in means], F.coalesce(F.sum(rain), F.lit(0.0)).alias(rain))
    return h.join(m, ts, "left")


def attach_depth(readings: DataFrame, depths: DataFrame, keys: Sequence[str]) -> DataFrame:
    return readings.join(depths, list(keys), "left")


def depth_diagnostics(readings: DataFrame, depths: DataFrame, key: str, depth: str) -> DataFrame:
    """Positions without a depth, depths without a reading, NULL depths, and readings by position."""
    seen = readings.groupBy(key).agg(F.count("*").alias("n"))
    d = depths.select(key, depth, F.lit(True).alias("_d"))
    status = F.when(F.col("_d").isNull(), "no depth").when(F.col("n").isNull(), "no reading").when(F.col(depth).isNull(), "null depth").otherwise("ok")
    return seen.join(d, key, "full").select(key, F.coalesce("n", F.lit(0)).alias("n"), depth, status.alias("status"))


def product_series(df: DataFrame, prefer: Sequence[str], times: Sequence[str] = ("startDateTime", "endDateTime", "datetime")) -> DataFrame:
    """Mean by time of the first column that a pattern finds, in order of preference."""
    ts = next(c for c in times if c in df.columns)
    value = next(c for p in prefer for c in df.columns if re.search(p, c))
    return df.groupBy(F.col(ts).alias("datetime")).agg(F.avg(F.col(value).cast("double")).alias("value"))


def yearly_anomaly(df: DataFrame, source: str, ts: str, value: str, months: Sequence[int]) -> DataFrame:
    """Yearly mean of values standardised within their source, for some months of the year."""
    season = df.where(F.month(ts).isin(list(months)))
    stats = season.groupBy(source).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    z = season.join(stats, source).withColumn("_z", F.try_divide(F.col(value) - F.col("_m"), F.col("_s")))
    return z.groupBy(source, F.year(ts).alias("year")).agg(F.avg("_z").alias("anomaly"), F.count("_z").alias("n"))
