"""Quality of single measurements: Allan deviations, detection limits, flags, filters and treatments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import allan_of_intervals, once_and_again
from .joins import assign_intervals, assign_with_fallback, join_nearest
from .lookups import lookup
from .numerics import Z90, Z95, Z99, t_quantile
from .quantiles import quantiles, summarise, summarise_where, with_quantiles
from .reshape import to_wide_multi
from .series import chunks, last_before
from .windows import first_per

LEVELS = {"90": Z90, "95": Z95, "99": Z99}
# manufacturers' precision (one sigma, one second) by instrument: methane (ppb), carbon dioxide (ppm).
PRECISION = {"LGR/UGGA": (0.9, 0.35), "LI-7810": (0.6, 3.5)}
FLAGS = ("manuf", "wass90", "wass95", "wass99", "chr90", "chr95", "chr99")


def allan_sd(df: DataFrame, by: Sequence[str], order: Sequence[str], cols: Sequence[str], min_rows: int = 0) -> DataFrame:
    """sd of first differences / sqrt(2) of each column by series; rows without a value are left out first; NULL for fewer than two differences.

    ``n`` counts all rows; series of fewer than ``min_rows`` rows go.
    """
    c = last_before(chunks(df, by, order), by, cols, here=False)
    d = c.withColumns({f"_d_{x}": F.when(F.col(x).isNotNull(), F.col(x) - F.col(f"_last_{x}")) for x in cols})
    sd = lambda c: F.when(F.count(f"_d_{c}") >= 2, F.stddev_samp(f"_d_{c}") / F.sqrt(F.lit(2.0)))
    out = d.groupBy(*by).agg(F.count("*").alias("n"), *[sd(c).alias(f"allan_sd_{c}") for c in cols])
    return out.where(F.col("n") >= min_rows)


def allan_by_file(traces: DataFrame, cols: Sequence[str] = ("CO2", "CH4"), file: str = "file", order: Sequence[str] = ("ts", "line")) -> DataFrame:
    """Allan table of files with their first remark and date, and the key of both."""
    head = first_per(traces, [file], [F.col(c) for c in order]).select(file, F.col("REMARK").alias("remark"), F.col("DATE").alias("date"))
    out = allan_sd(traces, [file], list(order), cols, min_rows=5).join(head, file)
    return out.withColumn("key", F.concat_ws("_", "remark", "date"))


def interval_allan(samples: DataFrame, intervals: DataFrame, by: Sequence[str], key: str, order: Sequence[str], cols: Sequence[str], min_rows: int = 0) -> DataFrame:
    """Allan table of intervals by their key, over the samples inside (both ends included). Only keys that several intervals share are worked out from pairs of sample and interval."""
    once, again = once_and_again(intervals, key)
    out = allan_of_intervals(samples, once, by, key, order, cols)
    if again is not None:
        out = out.unionByName(allan_sd(assign_intervals(samples, again, by, order[0]), [key], order, cols))
    return out.where(F.col("n") >= min_rows)


def allan_by_interval(traces: DataFrame, logs: DataFrame, machine: str = "machine", date: str = "date", ts: str = "ts", key: str = "UniqueID", cols: Sequence[str] = ("CO2", "CH4"), ppb: Sequence[str] = ("CH4",), order: Sequence[str] = ()) -> DataFrame:
    """Allan table of logged intervals; days of fewer than 10 rows and intervals of fewer than 5 go; ppm to ppb. ``order``: of rows with one time."""
    days, rows = traces.groupBy(machine, date).agg(F.count("*").alias("_n")), traces.dropna(subset=[machine, date])
    few = days.where("_n < 10").drop("_n")
    if not few.isEmpty():
        rows = rows.join(few, [machine, date], "left_anti")
    rows = rows.withColumns({c: F.col(c) * 1000 for c in ppb})
    once, again = once_and_again(logs, key)
    # intervals of a machine without samples on its date take those of all machines
    once = once.join(days.where("_n >= 10"), [machine, date], "left").withColumn("_machine", F.when(F.col("_n").isNotNull(), F.col(machine)))
    out = allan_of_intervals(rows, once, [date], key, [ts, *order], cols, part=(machine, "_machine"))
    if again is not None:
        out = out.unionByName(allan_sd(assign_with_fallback(rows, again, machine, date, ts=ts), [key], [ts, *order], cols))
    return out.where("n >= 5")


def attach_allan(flux: DataFrame, by_file: DataFrame, by_interval: DataFrame, cols: Sequence[str], key: str, file_key: str, ts: str, interval_ts: str, date: str, tolerance_s: int = 120) -> DataFrame:
    """Allan values by file key, else by measurement key, else from the nearest interval of the day; ``allan_from`` says which."""
    f = by_file.groupBy(file_key).agg(*[F.min(c).alias(f"_f_{c}") for c in cols])
    i = by_interval.groupBy(key).agg(*[F.min(c).alias(f"_i_{c}") for c in cols])
    near = by_interval.select(date, F.col(interval_ts).alias("_its"), F.col(key).alias("_tie"), *[F.col(c).alias(f"_n_{c}") for c in cols])
    out = join_nearest(flux.join(f, file_key, "left").join(i, key, "left"), near, key, [date], ts, "_its", tolerance_s, "_tie")
    first = cols[0]
    source = F.when(F.col(f"_f_{first}").isNotNull(), "file").when(F.col(f"_i_{first}").isNotNull(), "interval").when(F.col(f"_n_{first}").isNotNull(), "nearest")
    out = out.withColumn("allan_from", source)
    for c in cols:
        out = out.withColumn(c, F.coalesce(f"_f_{c}", f"_i_{c}", f"_n_{c}"))
    return out.drop(*[x for x in out.columns if x.startswith(("_f_", "_i_", "_n_", "_its", "_tie"))], "gap_s")


def noise_metrics(df: DataFrame, flux: str = "flux", se: str | None = None, allan: str = "allan_sd", nmol: str = "nmol", area: str = "surfarea", t: str = "t_sec", default_t: float = 300) -> DataFrame:
    """``flux_term`` (nmol / area), duration, noise floor (Allan / duration x term) and signal-to-noise ratios."""
    d = df.withColumn("flux_term", F.try_divide(nmol, area)).withColumn("t_sec_est", F.coalesce(F.col(t), F.lit(default_t)).cast("double"))
    d = d.withColumn("noise_floor", F.try_divide(F.col(allan), F.col("t_sec_est")) * F.col("flux_term"))
    d = d.withColumn("snr_allan", F.when(F.col("noise_floor") > 0, F.abs(flux) / F.col("noise_floor")))
    return d if se is None else d.withColumn("snr_se", F.when(F.col(se) > 0, F.abs(flux) / F.col(se)))


def mdf_manufacturer(df: DataFrame, precision: Column, out: str = "MDF_manuf") -> DataFrame:
    return df.withColumn(out, F.try_divide(precision.cast("double"), F.col("t_sec_est")) * F.col("flux_term"))


def precision_of(instrument: Column, gas: int = 0) -> Column:
    pairs = F.create_map(*[x for name, p in PRECISION.items() for x in (F.lit(name), F.lit(p[gas]))])
    return F.try_element_at(pairs, instrument)


def mdf_wassmann(df: DataFrame, allan_all: DataFrame, instrument: str, allan: str = "allan_sd") -> DataFrame:
    """z x the instrument's median Allan deviation over all its rows / duration x term, at 90, 95 and 99 %."""
    mid = quantiles(allan_all, [instrument], allan, {"_mid": 0.5})
    d = df.join(mid, instrument, "left")
    base = F.try_divide(F.col("_mid"), F.col("t_sec_est")) * F.col("flux_term")
    return d.withColumns({f"MDF_wass{k}": z * base for k, z in LEVELS.items()}).drop("_mid")


def mdf_christiansen(df: DataFrame, allan: str = "allan_sd", t: str = "t_sec_est") -> DataFrame:
    """3 x t quantile (duration - 2 degrees of freedom, 1 at least) x Allan deviation / duration x term. Quantiles are worked out for the distinct durations."""
    freedom = F.greatest(F.floor(F.col(t)) - 2, F.lit(1)).cast("int")
    d = df.withColumn("_df", freedom)
    schema = "_df int, " + ", ".join(f"_t{k} double" for k in LEVELS)

    def table(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"_df": pdf["_df"], **{f"_t{k}": [t_quantile(1 - (100 - int(k)) / 200, x) for x in pdf["_df"]] for k in LEVELS}})

    quantiles = d.select("_df").where("_df is not null").distinct().mapInPandas(table, schema)
    d = d.join(quantiles, "_df", "left")
    base = F.try_divide(F.col(allan), F.col(t)) * F.col("flux_term")
    return d.withColumns({f"MDF_chr{k}": 3 * F.col(f"_t{k}") * base for k in LEVELS}).drop("_df", *[f"_t{k}" for k in LEVELS])


def mdf_flags(df: DataFrame, flux: str = "flux", names: Sequence[str] = FLAGS, canonical: str = "wass95") -> DataFrame:
    """``below_MDF_<name>``: |flux| under the limit, NULL without one; ``below_MDF`` is the canonical one."""
    there = [n for n in names if f"MDF_{n}" in df.columns]
    out = df.withColumns({f"below_MDF_{n}": F.abs(flux) < F.col(f"MDF_{n}") for n in there})
    return out.withColumn("below_MDF", F.col(f"below_MDF_{canonical}")) if canonical in there else out


def mdf_report(df: DataFrame, flags: Sequence[str], by: str) -> DataFrame:
    """Evaluated, below and percentage, by group and overall (``group`` 'all'), for all thresholds in one pass."""
    long = df.select(F.coalesce(F.col(by).cast("string"), F.lit("none")).alias("group"), *[F.col(f).cast("int").alias(f) for f in flags]).unpivot(["group"], list(flags), "threshold", "below")
    group, threshold = F.col("group"), F.col("threshold")
    out = long.groupingSets([[threshold], [group, threshold]], group, threshold)
    out = out.agg(F.grouping("group").alias("_g"), F.count("below").alias("evaluated"), F.coalesce(F.sum("below"), F.lit(0)).alias("_b"))
    out = out.withColumn("group", F.when(F.col("_g") == 1, "all").otherwise(F.col("group")))
    return out.select("group", "threshold", "evaluated", F.col("_b").alias("below"), F.try_divide(100.0 * F.col("_b"), F.col("evaluated")).alias("pct"))


def passes(flag: str) -> Column:
    """Not below a limit; without a limit it passes."""
    return F.coalesce(~F.col(flag), F.lit(True))


def filter_registry(flux: str = "co2_flux", co2_r2: str = "co2_r2", co2_snr: str = "co2_snr_se", r2: str = "r2", snr_se: str = "snr_se", snr_allan: str = "snr_allan") -> dict[str, Column]:
    """The named filters, as what passes. A missing Allan value or limit passes; a missing fit or error does not."""
    over = lambda c, k: F.coalesce(F.col(c) > k, F.lit(False))
    allan = lambda k: F.coalesce(F.col(snr_allan) > k, F.lit(True))
    # The filters' names and thresholds.
    return {
        "No filter": F.lit(True),
        "Manufacturer MDF": passes("below_MDF_manuf"),
        "CO2 flux > 0": over(flux, 0),
        "CO2 SNR (SE) > 2": over(co2_snr, 2),
        "CO2 R2 > 0.7": over(co2_r2, 0.7),
        "CO2 R2 > 0.8": over(co2_r2, 0.8),
        "CH4 SNR (SE) > 2": over(snr_se, 2),
        "CH4 SNR (SE) > 3": over(snr_se, 3),
        "CH4 SNR (Allan) > 2": allan(2),
        "CH4 SNR (Allan) > 3": allan(3),
        "Wassmann 90%": passes("below_MDF_wass90"),
        "Wassmann 95%": passes("below_MDF_wass95"),
        "Wassmann 99%": passes("below_MDF_wass99"),
        "Christiansen 90%": passes("below_MDF_chr90"),
        "Christiansen 95%": passes("below_MDF_chr95"),
        "Christiansen 99%": passes("below_MDF_chr99"),
        "CH4 R2 > 0.5": over(r2, 0.5),
        "CH4 R2 > 0.7": over(r2, 0.7),
        "CH4 R2 > 0.9": over(r2, 0.9),
    }


def filter_sensitivity(df: DataFrame, registry: Mapping[str, Column], flux: str = "flux", by: Sequence[str] = ()) -> DataFrame:
    """What each filter keeps: rows, percentage, negatives, mean and median, the most lenient first. Filters are aggregates side by side, so rows are not multiplied."""
    names, x = list(registry), F.col("_x")
    aggs = {"n": F.count("*")}
    for i in range(len(names)):
        kept = F.col(f"_t{i}") | (x.isNull() & F.coalesce(registry[names[i]], F.lit(False)))
        aggs |= {f"pass{i}": F.count_if(kept), f"neg{i}": F.count_if(F.col(f"_t{i}") & (x < 0)), f"mean{i}": F.avg(F.when(F.col(f"_t{i}"), x))}
    wide = summarise_where(df, by, F.col(flux), list(registry.values()), [0.5], aggs)
    each = F.array(*[F.struct(F.lit(n).alias("filter"), F.col("n"), F.col(f"pass{i}").alias("n_pass"), F.col(f"neg{i}").alias("n_neg"), F.col(f"mean{i}").alias("mean"), F.col(f"q{i}_0").alias("median")) for i, n in enumerate(names)])
    out = wide.select(*by, F.inline(each))
    out = out.withColumn("pct_pass", 100 * F.try_divide(F.col("n_pass").cast("double"), F.col("n"))).withColumn("pct_neg", 100 * F.try_divide(F.col("n_neg").cast("double"), F.col("n_pass")))
    return out.select(*by, "filter", "n", "n_pass", "pct_pass", "n_neg", "pct_neg", "mean", "median").orderBy(*by, F.desc("n_pass"), "filter")


def filter_sensitivity_wide(df: DataFrame, registry: Mapping[str, Column], by: str, groups: Sequence[str], flux: str = "flux") -> DataFrame:
    """Rows kept, their percentage and mean of each filter, with columns for each group side by side."""
    long = filter_sensitivity(df, registry, flux, [by])
    return to_wide_multi(long, ["filter"], by, groups, {m: F.first(m) for m in ("n_pass", "pct_pass", "mean")})


def treatment_effects(df: DataFrame, flags: Mapping[str, str], flux: str = "flux", by: Sequence[str] = ()) -> DataFrame:
    """Mean, median and sd of flux by threshold and treatment of values below it: removed, set to zero, kept. A value without a limit is kept."""
    names, x = list(flags), F.col("_v.x")
    low = [F.coalesce(F.col(f), F.lit(False)) for f in flags.values()]
    # a value below some limit stands a second time, as the zero that it may be set to
    value = F.struct(F.col(flux).cast("double").alias("x"), F.lit(False).alias("zeroed"))
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(True).alias("zeroed"))
    set_ = reduce(or_, low, F.lit(False)) & F.col(flux).isNotNull()
    d = df.select(*by, *[c.alias(f"_b{i}") for i, c in enumerate(low)], F.explode(F.when(set_, F.array(value, zero)).otherwise(F.array(value))).alias("_v"))
    own = ~F.col("_v.zeroed")
    tests = [own]
    for i in range(len(names)):
        tests += [own & ~F.col(f"_b{i}"), own != F.col(f"_b{i}")]
    aggs = {f"{m}{i}": f(F.when(F.col(f"_t{i}"), F.col("_x"))) for i in range(len(tests)) for m, f in (("n", F.count), ("mean", F.avg), ("sd", F.stddev_samp))}
    wide = summarise_where(d, by, x, tests, [0.5], aggs)
    row = lambda name, treatment, i: F.struct(F.lit(name).alias("threshold"), F.lit(treatment).alias("treatment"), *[F.col(f"{m}{i}").alias(m) for m in ("n", "mean")], F.col(f"q{i}_0").alias("median"), F.col(f"sd{i}").alias("sd"))
    each = F.array(*[row(n, how, i) for k, n in enumerate(names) for how, i in (("remove", 2 * k + 1), ("zero", 2 * k + 2), ("keep", 0))])
    return wide.select(*by, F.inline(each)).select(*by, "threshold", "treatment", "n", "mean", "median", "sd")


def pct_change_vs(df: DataFrame, keys: Sequence[str], name: str, baseline: str, values: Sequence[str]) -> DataFrame:
    """Change of each value in percent of the baseline row's, by the other keys."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    base = lambda v: F.max(F.when(F.col(name) == baseline, F.col(v))).over(w)
    return df.withColumns({f"pct_change_{v}": 100 * F.try_divide(F.col(v) - base(v), F.abs(base(v))) for v in values})


def noise_check(df: DataFrame, by: Sequence[str], flux: str = "flux", noise: str = "noise_floor") -> DataFrame:
    """Negative values, and how many lie within one, two and three noise floors."""
    neg = F.col(flux) < 0
    within = {f"n_within_{k}": F.count_if(neg & (F.abs(flux) < k * F.col(noise))) for k in (1, 2, 3)}
    out = summarise_where(df, by, F.abs(flux), [neg], [0.5], {"n_neg": F.count_if(neg), **within}).withColumnRenamed("q0_0", "median_abs_neg")
    return with_quantiles(out, df, by, noise, {"median_noise": 0.5})


# Names of seasons and of the two halves of the year.
def season(month: Column) -> Column:
    return F.when(month.isin(12, 1, 2), "Winter (Dec-Feb)").when(month.isin(3, 4, 5), "Spring (Mar-May)").when(month.isin(6, 7, 8), "Summer (Jun-Aug)").when(month.isNotNull(), "Fall (Sep-Nov)")


def dormancy(month: Column) -> Column:
    return F.when(month.isin(11, 12, 1, 2, 3, 4), "Dormant (Nov-Apr)").when(month.isNotNull(), "Growing (May-Oct)")


def period_breakdown(df: DataFrame, period: Column, by: Sequence[str], flux: str = "flux", flag: str = "below_MDF") -> DataFrame:
    d, keys = df.withColumn("period", period), ["period", *by]
    out = summarise(d, keys, flux, {"median": 0.5}, {"n": F.count("*"), "mean": F.avg(flux), "n_neg": F.count_if(F.col(flux) < 0), "n_below": F.count_if(F.col(flag))})
    return out.select(*keys, "n", "mean", "median", "n_neg", "n_below")


def overlap_breakdown(df: DataFrame, period: Column, by: str, groups: int, flux: str = "flux", flag: str = "below_MDF") -> DataFrame:
    """The breakdown of those periods in which all ``groups`` groups have rows."""
    out = period_breakdown(df, period, [by], flux, flag)
    whole = out.groupBy("period").agg(F.count("*").alias("_g")).where(F.col("_g") == groups).select("period")
    return out.join(whole, "period", "left_semi")


def qc_classify(df: DataFrame, flux: str, snr: str, r2: str, own_snr: str, min_snr: float, min_r2: float, min_own_snr: float) -> DataFrame:
    """Flags of both gases, their numbers, and a class of each: several flags, else the first in precedence.

    ``flux, snr, r2`` are those of carbon dioxide, ``own_snr`` is methane's.
    """
    d = df.withColumns({"flag_snr": F.col(snr) < min_snr, "flag_r2": F.col(r2) < min_r2, "flag_neg": F.col(flux) < 0, "flag_own_snr": F.col(own_snr) < min_own_snr})
    n = F.col("flag_snr").cast("int") + F.col("flag_r2").cast("int") + F.col("flag_neg").cast("int")
    d = d.withColumn("nflags_co2", n).withColumn("nflags_ch4", F.col("nflags_co2") + F.col("flag_own_snr").cast("int"))

    def tail(first: Column) -> Column:
        return first.when(F.col("flag_snr"), "CO2 low SNR").when(F.col("flag_r2"), "CO2 low R2").when(F.col("flag_neg"), "CO2 < 0").otherwise("Neither")

    return d.withColumn("co2_class", tail(F.when(F.col("nflags_co2") >= 2, "Multiple flags"))).withColumn("ch4_class", tail(F.when(F.col("nflags_ch4") >= 2, "Multiple flags").when(F.col("flag_own_snr"), "CH4 low SNR")))


def sign_analysis(df: DataFrame, by: Sequence[str], flux: str = "flux", flag: str = "below_MDF") -> DataFrame:
    """Among values not below their limit: positive, negative and their percentages."""
    d = df.where(passes(flag) & F.col(flux).isNotNull())
    return d.groupBy(*by).agg(F.count("*").alias("n_detected"), F.count_if(F.col(flux) > 0).alias("n_pos"), F.count_if(F.col(flux) < 0).alias("n_neg"), (100 * F.avg((F.col(flux) < 0).cast("int"))).alias("pct_neg"))


def qc_by_group(df: DataFrame, by: Sequence[str], flux: str = "flux", flag: str = "below_MDF") -> DataFrame:
    share = lambda test: 100 * F.avg(test.cast("int"))
    out = summarise(df, by, flux, {"median": 0.5}, {"n": F.count("*"), "mean": F.avg(flux), "sd": F.stddev_samp(flux), "pct_neg": share(F.col(flux) < 0), "pct_below": share(F.coalesce(F.col(flag), F.lit(False)))})
    return out.select(*by, "n", "mean", "median", "sd", "pct_neg", "pct_below")


def quality_flags(flux: DataFrame, volumes: DataFrame, by_file: DataFrame, by_interval: DataFrame, *, key: str = "UniqueID", instrument: str = "instrument", default_bar: float = 1013.25, default_airt: float = 15.0) -> DataFrame:
    """Geometry, Allan values, noise and all detection limits of a flux table.

    ``flux``: key, ``file_key``, date, ts, Tag, ``flux, bar, airt, vol_system, surfarea, t_sec``; volumes: Tag, Volume.
    """
    from ..functions.scalars import fill_from, ideal_gas_nmol

    d = flux.join(volumes, "Tag", "left").withColumn("vol_system", F.coalesce("vol_system", "Volume")).drop("Volume")
    d = fill_from(fill_from(d, "bar", [default_bar]), "airt", [default_airt])
    d = d.withColumn("nmol", ideal_gas_nmol("bar", "vol_system", "airt"))
    d = attach_allan(d, by_file, by_interval, ["allan_sd"], key, "file_key", "ts", "start_ts", "date")
    d = noise_metrics(d)
    d = mdf_manufacturer(d, precision_of(F.col(instrument)))
    every = by_file.select(instrument, "allan_sd").unionByName(by_interval.select(instrument, "allan_sd"))
    return mdf_flags(mdf_christiansen(mdf_wassmann(d, every, instrument)))


def instruments(spark, rows: Sequence[tuple[str, float, float]]) -> DataFrame:
    return lookup(spark, rows, "instrument string, ch4 double, co2 double")
