"""Column functions: parsing, cleaning, unit conversion, recoding. All stay inside Spark's expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lookups import lookup


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- missing values -------------------------------------------------------------------------


def null_sentinels(df: DataFrame, cols: Sequence[str], codes: Sequence[float] = (-9999,)) -> DataFrame:
    """Sentinel codes and NaN become NULL."""
    return df.withColumns({c: F.when(~(F.isnan(F.col(c).cast("double")) | F.col(c).isin(list(codes))), F.col(c)) for c in cols})


def require(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def fill_from(df: DataFrame, col: str, exprs: Sequence[Column | float]) -> DataFrame:
    """NULLs filled from the first expression that has a value."""
    return df.withColumn(col, F.coalesce(F.col(col), *[e if isinstance(e, Column) else F.lit(e) for e in exprs]))


def first_existing(df: DataFrame, names: Sequence[str], kind: str = "double") -> Column:
    """The first of the named columns that the table has; else NULL."""
    return next((F.col(n).cast(kind) for n in names if n in df.columns), F.lit(None).cast(kind))


def drop_sparse(df: DataFrame, min_n: int = 50, keep: Sequence[str] = ()) -> DataFrame:
    """Without the columns that have ``min_n`` values or fewer; one pass counts them all."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if c in keep or counts[c] > min_n])


# --- time -----------------------------------------------------------------------------------


def parse_ts12(col: Column | str) -> Column:
    """``YYYYMMDDHHMM`` as number or text, left-padded with zeros."""
    return F.try_to_timestamp(F.lpad(_c(col).cast("string"), 12, "0"), F.lit("yyyyMMddHHmm")).cast("timestamp_ntz")


#: Tried in this order; a year before 1900 counts as not parsed.
DATE_PATTERNS = ("M/d/yyyy", "M/d/yy", "M-d-yyyy", "yy-M-d", "yyyy-M-d")


def parse_date_multi(col: Column | str, patterns: Sequence[str] = DATE_PATTERNS) -> Column:
    tried = [F.try_to_timestamp(_c(col), F.lit(p)).cast("date") for p in patterns]
    return F.coalesce(*[F.when(F.year(d) >= 1900, d) for d in tried])


def parse_iso(col: Column | str) -> Column:
    """ISO text, with fraction and ``Z`` or without, as clock time."""
    clean = F.regexp_replace(F.regexp_replace(_c(col), "Z$", ""), "T", " ")
    return F.coalesce(*[F.try_to_timestamp(clean, F.lit(p)) for p in ("yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")]).cast("timestamp_ntz")


def build_intervals(df: DataFrame, date: str, start: str, end: str, min_s: int = 30, max_s: int = 1800) -> DataFrame:
    """``start_ts, end_ts, seconds`` from a date and two times of day; only durations strictly between the bounds."""
    ts = lambda c: F.try_to_timestamp(F.concat_ws(" ", F.date_format(F.col(date), "yyyy-MM-dd"), F.trim(F.col(c))), F.lit("yyyy-MM-dd H:m[:s]")).cast("timestamp_ntz")
    out = df.withColumn("start_ts", ts(start)).withColumn("end_ts", ts(end))
    return out.withColumn("seconds", F.timestamp_diff("SECOND", F.col("start_ts"), F.col("end_ts"))).where(f"seconds > {min_s} and seconds < {max_s}")


def floor_time(col: Column | str, unit: str, week_start: str = "monday") -> Column:
    if unit == "week" and week_start == "sunday":
        return (F.date_trunc("week", _c(col) + F.expr("interval 1 day")) - F.expr("interval 1 day")).cast("timestamp_ntz")
    return F.date_trunc(unit, _c(col)).cast("timestamp_ntz")


def round_time(col: Column | str, unit: str = "hour") -> Column:
    """Nearest hour, minute or day; half rounds up."""
    half = {"hour": "30 minutes", "minute": "30 seconds", "day": "12 hours"}[unit]
    return F.date_trunc(unit, _c(col) + F.expr(f"interval {half}")).cast("timestamp_ntz")


def shift_clock(col: Column | str, hours: float = 0, seconds: int = 0) -> Column:
    return (_c(col) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(hours * 3600 + seconds)).cast("decimal(18,6)"))).cast("timestamp_ntz")


def water_year(col: Column | str, first_month: int = 10) -> Column:
    return F.year(_c(col)) + (F.month(_c(col)) >= first_month).cast("int")


def add_calendar(df: DataFrame, ts: str, first_month: int = 10) -> DataFrame:
    t = F.col(ts)
    return df.withColumns({"date": t.cast("date"), "year": F.year(t), "month": F.month(t), "doy": F.dayofyear(t), "hour": F.hour(t), "wyear": water_year(t, first_month)})


def signed_doy(col: Column | str, first_month: int = 11) -> Column:
    """Day of the year, negative for the last months, which belong to the next winter."""
    c = _c(col)
    return F.when(F.month(c) >= first_month, -(365 - F.dayofyear(c))).otherwise(F.dayofyear(c))


# --- columns of a table ---------------------------------------------------------------------


def match_cols(df: DataFrame, pattern: str, include_pi: bool = False) -> list[str]:
    """Columns that the pattern matches from their start; ``_PI`` ones only if asked for."""
    found = re.compile(pattern)
    return [c for c in df.columns if found.match(c) and (include_pi or "_PI" not in c)]


def extract_vars(df: DataFrame, var_map: Mapping[str, str], suffix: str = "", years: tuple[int, int] | None = None, ts: str = "datetime") -> DataFrame:
    """Columns by map (new name: old name) as far as they exist, renamed with a suffix, within closed years."""
    rows = df if years is None else df.where(F.year(ts).between(*years))
    return rows.select(ts, *[F.col(old).cast("double").alias(new + suffix) for new, old in var_map.items() if old in df.columns])


def map_columns(df: DataFrame, cols: Sequence[str], fn: Callable[[Column], Column]) -> DataFrame:
    return df.withColumns({c: fn(F.col(c)) for c in cols})


# --- text -----------------------------------------------------------------------------------


def normalize_machine(col: Column | str, default: str = "LGR") -> Column:
    """Upper case without blanks, ``LGR #2`` and ``LGR2`` as ``LGR``; blank or NULL as the default."""
    clean = F.regexp_replace(F.regexp_replace(F.upper(F.trim(_c(col))), r"\s+", ""), r"^LGR#?\d*$", "LGR")
    return F.coalesce(F.when(clean != "", clean), F.lit(default))


def strip_date(col: Column | str) -> Column:
    return F.regexp_replace(_c(col), r"^.*\s+", "")


def prefer(col: Column | str, override: Column | str) -> Column:
    """The override where it is not blank."""
    return F.when(F.length(F.trim(_c(override))) > 0, _c(override)).otherwise(_c(col))


def position_key(h: Column | str, v: Column | str) -> Column:
    pad = lambda c: F.lpad(F.regexp_replace(_c(c).cast("string"), "^0+", ""), 3, "0")
    return F.concat_ws(".", pad(h), pad(v))


def parse_feature_name(col: Column | str) -> Column:
    """``base, mode, hours`` of a name such as ``ts_raw_24h``."""
    part = lambda i: F.regexp_extract(_c(col), r"^(.*)_(raw|anomaly)_(\d+)h$", i)
    return F.struct(part(1).alias("base"), part(2).alias("mode"), F.nullif(part(3), F.lit("")).cast("int").alias("hours"))


def feature_attributes(col: Column | str) -> Column:
    """``depth, site, hours`` of a name such as ``vwc_15cm_a`` or ``wtd_b_24h``: the depth in centimetres (``15 cm``), the site by the last letter, before the window if there is one (``Site A``), and the window's hours. NULL for what a name does not have."""
    part = lambda pattern: F.nullif(F.regexp_extract(_c(col), pattern, 1), F.lit(""))
    return F.struct(F.concat(part(r"(\d+)cm"), F.lit(" cm")).alias("depth"), F.concat(F.lit("Site "), F.upper(part(r"_([ab])(?:_\d+h)?$"))).alias("site"), part(r"(\d+)h$").cast("int").alias("hours"))


def recode(col: Column | str, mapping: Mapping[str, str], default: Column | str | None = None) -> Column:
    """Value by map; others the default, or themselves without one."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    other = _c(col) if default is None else default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.try_element_at(pairs, _c(col)), other)


def merge_codes(df: DataFrame, col: str, codes: Mapping[str, str], drop: Sequence[str] = ()) -> DataFrame:
    kept = df.where(~F.col(col).isin(list(drop)) | F.col(col).isNull()) if drop else df
    return kept.withColumn(col, recode(col, codes))


def override(df: DataFrame, key: str, col: str, values: Mapping) -> DataFrame:
    """Given keys take the given value of ``col``."""
    dim = lookup(df.sparkSession, list(values.items()), [key, "_new"])
    return df.join(dim, key, "left").withColumn(col, F.coalesce("_new", col)).drop("_new")


def stars(p: Column | str) -> Column:
    return F.when(_c(p) < 0.001, "***").when(_c(p) < 0.01, "**").when(_c(p) < 0.05, "*").when(_c(p).isNotNull(), "")


# --- numbers --------------------------------------------------------------------------------


def correct_units(df: DataFrame, col: str, cond: Column, factor: float) -> DataFrame:
    return df.withColumn(col, F.when(cond, F.col(col) * factor).otherwise(F.col(col)))


def ideal_gas_nmol(bar: Column | str, vol: Column | str, airt: Column | str) -> Column:
    """Moles from pressure (hPa), volume (cm3 in the same units as the gas constant 83.14472) and temperature (C)."""
    return _c(bar) * _c(vol) / (F.lit(83.14472) * (_c(airt) + 273.15))


def vpd_tetens(rh: Column | str, t: Column | str) -> Column:
    """Vapour pressure deficit in kPa, 0 at least."""
    es = 0.6108 * F.exp(17.27 * _c(t) / (_c(t) + 237.3))
    deficit = es * (1 - _c(rh) / 100)
    return F.when(deficit.isNotNull(), F.greatest(deficit, F.lit(0.0)))


def vpd_buck(rh: Column | str, t: Column | str, p_kpa: Column | str) -> Column:
    """Vapour pressure deficit in kPa with the Buck (1981) saturation pressure over water and its enhancement factor."""
    enhance = 1.0007 + 3.46e-5 * _c(p_kpa)
    es = 0.61121 * enhance * F.exp(17.502 * _c(t) / (240.97 + _c(t)))
    return es * (1 - _c(rh) / 100)


def et_mm(latent_heat: Column | str, seconds: float) -> Column:
    """Evapotranspiration in mm of an interval from latent heat flux (W/m2)."""
    return _c(latent_heat) * seconds / 2.45e6


#: Factor from the first unit to the second.
UNITS = {("umol", "nmol"): 1000.0, ("nmol", "umol"): 0.001, ("umol_s", "mg_h"): 43.236, ("ppm", "ppb"): 1000.0}


def convert_units(col: Column | str, source: str, target: str) -> Column:
    return _c(col) * (1.0 if source == target else UNITS[source, target])


def clamp(col: Column | str, lo: float, hi: float) -> Column:
    """NULL stays NULL."""
    return F.when(_c(col).isNotNull(), F.least(F.greatest(_c(col), F.lit(lo)), F.lit(hi)))


def plausible(df: DataFrame, col: str, lo: float | None = None, hi: float | None = None) -> DataFrame:
    tests = [F.col(col) >= lo] * (lo is not None) + [F.col(col) <= hi] * (hi is not None)
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def cut(col: Column | str, breaks: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins with the lowest break in the first; NULL outside."""
    c = _c(col)
    out = F.when((c >= breaks[0]) & (c <= breaks[1]), labels[0])
    for lo, hi, label in zip(breaks[1:], breaks[2:], labels[1:], strict=False):
        out = out.when((c > lo) & (c <= hi), label)
    return out


def qc_pass(df: DataFrame, col: str, lenient: bool = False) -> DataFrame:
    return df.where((F.col(col) == 0) | F.col(col).isNull()) if lenient else df.where(F.col(col) == 0)


def signed_sqrt(col: Column | str) -> Column:
    return F.signum(_c(col)) * F.sqrt(F.abs(_c(col)))


def signed_square(col: Column | str) -> Column:
    return F.signum(_c(col)) * _c(col) * _c(col)


def pseudo_log(col: Column | str, sigma: float = 1.0, base: float = 10.0) -> Column:
    return F.asinh(_c(col) / (2 * sigma)) / F.log(F.lit(base))


def log_offset(col: Column | str, offset: float) -> Column:
    return F.when(_c(col) + offset > 0, F.log(_c(col) + offset))


def exp_offset(col: Column | str, offset: float) -> Column:
    return F.exp(_c(col)) - offset
