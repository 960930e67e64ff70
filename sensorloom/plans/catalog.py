"""Queries over the driver tables, and the SQL that they must equal (DuckDB); models have none and are tested otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import models as M
from ..operators import quality as Q
from ..operators import reshape as R
from ..operators import sensors as N
from ..operators import stats as K
from ..operators import windows as W
from ..streaming.rollup import hourly_rollup
from .views import CHANNELS, FLUX, LONG, SPECIES, channels, driver_long, flux, rounded, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, digits: int = 6):
    def register(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: rounded(fn(spark, sf_dir), digits)
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


# --- sensors --------------------------------------------------------------------------------


def _sensor_long(spark, d):
    return flux(spark, d).where("reading is not null").select(F.col("ts").alias("datetime"), F.col("tree").alias("sensor"), F.col("reading").alias("value"), "site", "hour")


_BASE = "with " + FLUX + """, r as (select hour, tree, site, reading from flux where reading is not null),
b as (select {k} tree, median(reading) as b from r where hour >= timestamp '2024-01-01' and hour < timestamp '2024-01-16' group by {k} tree),
g as (select {k} avg(b) as g from b {gk})
"""


@query(_BASE.format(k="", gk="") + "select hour as datetime, round(avg(reading - b) + any_value(g), 9) as adjusted, count(distinct r.tree) as n_sensors from r join b on r.tree = b.tree cross join g group by hour having count(distinct r.tree) >= 2", 9)
def baseline_adjusted_hourly(spark, d):
    long = _sensor_long(spark, d).withColumn("datetime", F.col("hour"))
    return N.baseline_adjusted_mean(long, "2024-01-01", "2024-01-16", min_sensors=2)


@query(_BASE.format(k="site,", gk="group by site") + "select r.site, hour as datetime, round(avg(reading - b) + any_value(g), 9) as adjusted, count(distinct r.tree) as n_sensors from r join b on r.tree = b.tree and r.site = b.site join g on r.site = g.site group by r.site, hour having count(distinct r.tree) >= 2", 9)
def baseline_by_group(spark, d):
    long = _sensor_long(spark, d).withColumn("datetime", F.col("hour"))
    return N.baseline_adjusted_mean(long, "2024-01-01", "2024-01-16", min_sensors=2, by=["site"])


@query(
    "with " + FLUX + """, w as (select * from (values ('a', timestamp '2024-01-01', timestamp '2024-01-11'), ('b', timestamp '2024-01-11', timestamp '2024-01-21'), ('c', timestamp '2024-01-01', timestamp '2024-01-31')) as t("window", a, z)),
r as (select hour, tree, reading from flux where reading is not null),
b as (select "window", tree, median(reading) as b from r join w on hour >= a and hour < z group by 1, 2), g as (select "window", avg(b) as g from b group by 1)
select b."window", hour as datetime, round(avg(reading - b) + any_value(g), 9) as adjusted, count(distinct r.tree) as n_sensors from r join b on r.tree = b.tree join g on g."window" = b."window" group by 1, 2 having count(distinct r.tree) >= 2""",
    9,
)
def baseline_sensitivity(spark, d):
    long = _sensor_long(spark, d).withColumn("datetime", F.col("hour"))
    return N.baseline_sensitivity(long, {"a": ("2024-01-01", "2024-01-11"), "b": ("2024-01-11", "2024-01-21"), "c": ("2024-01-01", "2024-01-31")}, min_sensors=2)


_N = "with " + FLUX + ", n as (select hour, count(distinct tree) as n_sensors, avg(reading) as adjusted from flux where reading is not null group by hour) "


def _hourly_n(spark, d):
    return flux(spark, d).where("reading is not null").groupBy("hour").agg(F.countDistinct("tree").alias("n_sensors"), F.avg("reading").alias("adjusted"))


@query(_N + "select count(*) as n, min(n_sensors)::double as min, round(quantile_cont(n_sensors, 0.05), 6) as p05, round(quantile_cont(n_sensors, 0.5), 6) as med, round(quantile_cont(n_sensors, 0.95), 6) as p95, max(n_sensors)::double as max from n")
def coverage_summary(spark, d):
    return N.coverage_summary(_hourly_n(spark, d))


@query(_N + """, q as (select list_distinct([quantile_cont(n_sensors, 0.0), quantile_cont(n_sensors, 0.25), quantile_cont(n_sensors, 0.5), quantile_cont(n_sensors, 0.75), quantile_cont(n_sensors, 1.0)]) as b from n),
s as (select n.*, greatest(len(list_filter(b, lambda x: x < n_sensors)), 1)::int as stratum from n cross join q)
select stratum, min(n_sensors) as n_lo, max(n_sensors) as n_hi, count(*) as rows, round(quantile_cont(adjusted, 0.25), 6) as q25, round(quantile_cont(adjusted, 0.5), 6) as median, round(quantile_cont(adjusted, 0.75), 6) as q75 from s group by stratum""")
def coverage_strata(spark, d):
    return N.coverage_strata(_hourly_n(spark, d), (0.0, 0.25, 0.5, 0.75, 1.0))


@query("with " + CHANNELS + " select date_trunc('month', ts)::timestamp as month, round(avg(quantity), 6) as mean_a, round(avg(price), 6) as mean_b, round(corr(quantity, price), 6) as r, round(regr_slope(price, quantity), 6) as slope, count(*) as n from channels where quantity is not null and price is not null group by 1")
def replicate_pairs(spark, d):
    return N.replicate_pairs(channels(spark, d), "ts", "quantity", "price")


@query("with " + CHANNELS + ", l as (unpivot channels on quantity, price, discount, tax into name channel value value) select channel, date_trunc('month', ts)::timestamp as month, round(avg(value), 6) as mean, count(value) as n, 'tower' as tower from l group by 1, 2")
def monthly_channels(spark, d):
    return N.monthly_channels(channels(spark, d), "ts", ["quantity", "price", "discount", "tax"], "tower")


@query("select case when o_orderpriority is null then 'none' else o_orderpriority end as source, year(o_orderdate)::int as year, round(avg((o_totalprice - m) / s), 6) as anomaly, count((o_totalprice - m) / s) as n from (select *, avg(o_totalprice) over (partition by o_orderpriority) as m, stddev_samp(o_totalprice) over (partition by o_orderpriority) as s from orders where month(o_orderdate) in (6, 7, 8)) group by 1, 2")
def yearly_anomaly(spark, d):
    o = table(spark, d, "orders").withColumn("source", F.coalesce("o_orderpriority", F.lit("none")))
    return N.yearly_anomaly(o, "source", "o_orderdate", "o_totalprice", [6, 7, 8])


_WIDE = ", ".join(f"avg(case when species = '{s}' then reading end) as {s}" for s in SPECIES)


@query("with " + FLUX + f""", w as (select hour, {_WIDE} from flux group by hour), l as (select date_trunc('hour', l_shipdate)::timestamp as hour, avg(l_quantity) as quantity from lineitem group by 1),
j as (select coalesce(w.hour, l.hour) as datetime, {", ".join(SPECIES)}, quantity from w full join l on w.hour = l.hour)
select datetime, {", ".join(f"round({s}, 6) as {s}" for s in SPECIES)}, round(quantity, 6) as quantity, datetime::date as date, year(datetime)::int as year, month(datetime)::int as month, dayofyear(datetime)::int as doy, hour(datetime)::int as hour, (year(datetime) + case when month(datetime) >= 10 then 1 else 0 end)::int as wyear from j""")
def aligned_hourly(spark, d):
    f = flux(spark, d).groupBy(F.col("hour").alias("datetime")).agg(*[F.avg(F.when(F.col("species") == s, F.col("reading"))).alias(s) for s in SPECIES])
    li = table(spark, d, "lineitem").select(F.col("l_shipdate").alias("datetime"), F.col("l_quantity").alias("quantity"))
    return N.build_aligned([f, None, li])


@query("with " + FLUX + ", h as (select hour, avg(value) as level from flux where site = 'Wetland' group by 1), m as (select hour, avg(value) as temp, coalesce(sum(case when species = 'click' then value end), 0) as rain from flux where site = 'Upland' group by 1) select h.hour as datetime, round(level, 6) as level, round(temp, 6) as temp, round(rain, 6) as rain from h left join m on h.hour = m.hour")
def hydromet_hourly(spark, d):
    f = flux(spark, d).withColumn("datetime", F.col("ts"))
    hydro = f.where("site = 'Wetland'").select("datetime", F.col("value").alias("level"))
    met = f.where("site = 'Upland'").select("datetime", F.col("value").alias("temp"), F.when(F.col("species") == "click", F.col("value")).alias("rain"))
    return N.hydromet_hourly(hydro, met, ["level"], ["temp"], "rain")


# --- reshaping and aggregates ---------------------------------------------------------------


@query("with " + CHANNELS + ", h as (select date_trunc('hour', ts)::timestamp as datetime, avg(quantity) as quantity, avg(price) as price, avg(discount) as discount, avg(tax) as tax from channels group by 1) select datetime, round(quantity, 6) as quantity, round(price, 6) as price, round(discount, 6) as discount, round(tax, 6) as tax from h")
def hourly_mean(spark, d):
    return A.hourly_mean(channels(spark, d), "ts", ["quantity", "price", "discount", "tax"])


@query("with " + FLUX + " select hour as datetime, round(avg(value), 6) as value, round(coalesce(sum(reading), 0), 6) as reading from flux group by 1")
def hourly_mixed_agg(spark, d):
    return A.hourly_agg(flux(spark, d), "ts", {"value": "mean", "reading": "sum"})


@query("with " + FLUX + " select hour as datetime, site, round(avg(reading), 6) as mean, round(coalesce(sum(reading), 0), 6) as sum, count(reading) as n from flux group by 1, 2")
def hourly_rollup_batch(spark, d):
    return hourly_rollup(flux(spark, d), "ts", "reading", ["site"])


@query("select o_orderpriority, date_trunc('week', o_orderdate)::timestamp as period, round(avg(o_totalprice), 6) as mean, count(o_totalprice) as n from orders group by 1, 2")
def resample_week(spark, d):
    return A.resample(table(spark, d, "orders"), "o_orderdate", "week", "o_totalprice", ["o_orderpriority"])


@query("select o_orderpriority, date_trunc('month', o_orderdate)::timestamp as period, round(avg(o_totalprice), 7) as mean, count(o_totalprice) as n from orders group by 1, 2", 7)
def resample_month(spark, d):
    return A.resample(table(spark, d, "orders"), "o_orderdate", "month", "o_totalprice", ["o_orderpriority"])


@query("with " + CHANNELS + ", l as (unpivot channels on quantity, price, discount, tax into name sensor value value) select ts, sensor, round(value, 6) as value from l")
def sensor_long(spark, d):
    return R.to_long(channels(spark, d), ["ts"], ["quantity", "price", "discount", "tax"])


@query("with " + FLUX + " select tree, " + ", ".join(f"round(avg(case when species = '{s}' then reading end), 6) as mean_{s}, count(case when species = '{s}' then reading end) as n_{s}" for s in SPECIES) + " from flux group by tree")
def pivot_multi(spark, d):
    out = R.to_wide_multi(flux(spark, d), ["tree"], "species", SPECIES, {"mean": F.avg("reading"), "n": F.count("reading")})
    return out.na.fill(0, [f"n_{s}" for s in SPECIES])


@query("with days as (select distinct o_orderdate::date as d, o_orderdate::date::timestamp as t from orders), h as (select unnest(range(0, 24)) as h) select d as day, t + to_hours(h) as datetime from days cross join h")
def expand_hours(spark, d):
    days = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return R.expand_to_hours(days, "day")


@query("with " + FLUX + ", k as (select distinct site from flux), v as (select unnest(['click', 'error', 'purchase', 'signup', 'view', 'none']) as species), m as (select site, species, avg(reading) as mean from flux group by 1, 2) select k.site, v.species, round(m.mean, 6) as mean from k cross join v left join m on k.site = m.site and v.species = m.species")
def complete_grid(spark, d):
    m = flux(spark, d).groupBy("site", "species").agg(F.avg("reading").alias("mean"))
    return R.complete(m, ["site"], {"species": [*SPECIES, "none"]})


@query("with o as (select o_orderstatus, o_orderdate::date as day, sum(o_totalprice) as total from orders group by 1, 2), s as (select o_orderstatus, min(day) as a, max(day) as b from o group by 1), g as (select o_orderstatus, unnest(generate_series(a::timestamp, b::timestamp, interval 1 day))::date as day from s) select g.o_orderstatus, g.day, round(o.total, 6) as total from g left join o on g.o_orderstatus = o.o_orderstatus and g.day = o.day")
def complete_days(spark, d):
    o = table(spark, d, "orders").groupBy("o_orderstatus", F.col("o_orderdate").cast("date").alias("day")).agg(F.sum("o_totalprice").alias("total"))
    return R.complete_days(o, ["o_orderstatus"], "day")


@query("with " + FLUX + f", w as (select hour, {_WIDE} from flux group by hour) select hour, round(list_avg(list_filter([click, error, view], lambda x: x is not null)), 6) as replicate from w")
def replicate_mean(spark, d):
    w = flux(spark, d).groupBy("hour").agg(*[F.avg(F.when(F.col("species") == s, F.col("reading"))).alias(s) for s in SPECIES])
    return R.replicate_mean(w, "replicate", "click|error|view").select("hour", "replicate")


@query("with " + FLUX + """ select site, species, count(*) as n, count(reading) as n_valid, round(avg(reading), 6) as mean, round(stddev_samp(reading), 6) as sd, min(reading) as min, max(reading) as max, round(quantile_cont(reading, 0.25), 6) as q25, round(quantile_cont(reading, 0.5), 6) as median, round(quantile_cont(reading, 0.75), 6) as q75,
 round(quantile_cont(reading, 0.75) - quantile_cont(reading, 0.25), 6) as iqr, round(stddev_samp(reading) / sqrt(count(*)), 6) as se, round(stddev_samp(reading) / sqrt(count(reading)), 6) as se_valid from flux group by 1, 2""")
def describe_by(spark, d):
    return A.describe_by(flux(spark, d), ["site", "species"], "reading")


@query("with " + FLUX + " select species, count(*) as n, count(*) filter (where flux < 0) as n_negative, round(100.0 * avg(case when flux < 0 then 1 else 0 end), 6) as pct_negative, count(*) filter (where reading > 50) as n_high, round(100.0 * avg(case when reading > 50 then 1 else 0 end), 6) as pct_high from flux group by 1")
def rates_by(spark, d):
    return A.rates_by(flux(spark, d), ["species"], {"negative": F.col("flux") < 0, "high": F.col("reading") > 50})


_DL = "dl as (select d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic from documents d left join labels l on d.doc_id = l.doc_id)"


def _doc_labels(spark, d):
    return J.left_lookup(table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), table(spark, d, "labels"), "doc_id", "doc_id")


@query("with " + _DL + ", c as (" + " union all ".join(f"select '{c}' as variable, count({c}) as n, round(100.0 * count({c}) / count(*), 6) as pct from dl" for c in ("lang", "source", "n_chars", "quality", "toxic")) + ") select * from c")
def coverage_table(spark, d):
    return A.coverage(_doc_labels(spark, d), ["lang", "source", "n_chars", "quality", "toxic"])


@query("with " + _DL + ", c as (" + " union all ".join(f"select '{c}' as variable, round(avg(case when {c} is null then 1 else 0 end), 6) as missing from dl" for c in ("n_chars", "quality", "toxic")) + ") select * from c")
def missing_frac(spark, d):
    return A.missing_frac(_doc_labels(spark, d), ["n_chars", "quality", "toxic"])


@query("with " + FLUX + ", s as (select min(ts) as a, max(ts) as b from events where event_type = 'signup' ), r as (select flux.* from flux, s where ts between a and b) select 'reading' as variable, count(reading) as n, round(100.0 * count(reading) / count(*), 6) as pct from r union all select 'value', count(value), round(100.0 * count(value) / count(*), 6) from r")
def coverage_in_span(spark, d):
    f = flux(spark, d)
    return A.coverage_in_span(f, "ts", ["reading", "value"], f.where("species = 'signup'"), "ts")


@query("with m as (select o_orderpriority, month(o_orderdate)::int as month, avg(o_totalprice) as v from orders group by 1, 2) select o_orderpriority, first(month order by v desc, month) as peak_key, round(max(v), 6) as peak_value, first(month order by v, month) as low_key, round(min(v), 6) as low_value from m group by 1")
def peak_low(spark, d):
    m = table(spark, d, "orders").groupBy("o_orderpriority", F.month("o_orderdate").alias("month")).agg(F.avg("o_totalprice").alias("v"))
    return A.peak_low(m, ["o_orderpriority"], "month", "v")


@query("with " + FLUX + " select site, " + ", ".join(f"count(*) filter (where species = '{s}') as species_{s}" for s in SPECIES) + " from flux group by 1")
def crosstab(spark, d):
    return A.crosstab(flux(spark, d), "site", "species", SPECIES)


@query("with " + FLUX + ", e as (select site, tree, avg(reading) as m, var_samp(reading) as v from flux group by 1, 2) select site, round(var_samp(m), 6) as \"between\", round(avg(v), 6) as within, round(var_samp(m) / avg(v), 6) as ratio from e group by 1")
def variance_decomp(spark, d):
    return A.variance_decomp(flux(spark, d), ["site"], "tree", "reading")


@query("with " + FLUX + " select tree, round(avg(reading), 6) as mean, round(stddev_samp(reading), 6) as sd, round(stddev_samp(reading) / avg(reading), 6) as cv from flux group by 1")
def cv_by(spark, d):
    return A.cv_by(flux(spark, d), ["tree"], "reading")


@query("select o_orderpriority, (date '1970-01-01' + floor(avg(date_diff('day', date '1970-01-01', o_orderdate::date)))::int)::date as mean_date from orders group by 1")
def mean_date(spark, d):
    return A.mean_date(table(spark, d, "orders"), ["o_orderpriority"], "o_orderdate")


@query("with " + FLUX + " select tree, string_agg(s, ', ' order by s) as values_text from (select distinct tree, species as s from flux) group by 1")
def concat_values(spark, d):
    return A.concat_values(flux(spark, d), ["tree"], "species")


@query("with " + FLUX + " select site, count(distinct tree) as n_distinct from flux group by 1")
def count_distinct_by(spark, d):
    return A.count_distinct_by(flux(spark, d), ["site"], "tree")


@query("with " + CHANNELS + ", c as (" + " union all ".join(f"select '{s}' as source, '{c}' as variable, count({c}) as n, round(100.0 * count({c}) / count(*), 6) as pct from channels {w}" for s, w in (("all", ""), ("small", "where quantity < 10")) for c in ("quantity", "price")) + ") select * from c")
def channel_coverage(spark, d):
    c = channels(spark, d)
    return A.channel_coverage({"all": c, "small": c.where("quantity < 10")}, ["quantity", "price"])


@query("with " + FLUX + ", s as (select count(*)::double as n, count(reading)::double as n_valid, avg(reading) as mean, count(distinct tree)::double as trees from flux) select metric, round(value, 6) as value from (unpivot s on n, n_valid, mean, trees into name metric value value)")
def kv_summary(spark, d):
    return A.kv_summary(flux(spark, d), {"n": F.count("*"), "n_valid": F.count("reading"), "mean": F.avg("reading"), "trees": F.countDistinct("tree")})


@query("with " + FLUX + " select species, min(tree) as lo, round(quantile_cont(tree, 0.5), 6) as median, max(tree) as hi, min(tree)::varchar || '-' || max(tree)::varchar as range_text from flux group by 1")
def range_by(spark, d):
    return A.range_by(flux(spark, d), ["species"], "tree")


@query("with " + FLUX + " select species, round(min(flux), 6) as min_effect, round(max(flux), 6) as max_effect, round(max(flux) - min(flux), 6) as effect_range from flux group by 1")
def effect_range(spark, d):
    return A.effect_range(flux(spark, d), ["species"], "flux")


# --- distributions --------------------------------------------------------------------------


@query("with " + FLUX + ", b as (select species, least(floor((value - 0) / 10.0), 9)::int as bin from flux where value between 0 and 100) select species, bin, count(*) as n, round(bin * 10.0, 6)::double as \"left\" from b group by 1, 2")
def histogram(spark, d):
    return A.histogram(flux(spark, d), "value", 0.0, 100.0, 10, ["species"])


@query("with " + FLUX + ", q as (select species, quantile_cont(reading, 0.25) as q25, quantile_cont(reading, 0.5) as median, quantile_cont(reading, 0.75) as q75 from flux group by 1), j as (select f.reading, q.*, f.reading between q25 - 1.5 * (q75 - q25) and q75 + 1.5 * (q75 - q25) as inside from flux f join q on f.species = q.species) select species, round(any_value(q25), 6) as q25, round(any_value(median), 6) as median, round(any_value(q75), 6) as q75, min(reading) filter (where inside) as whisker_low, max(reading) filter (where inside) as whisker_high, count(*) filter (where not inside) as n_outliers from j group by 1")
def box_stats(spark, d):
    return A.box_stats(flux(spark, d), ["species"], "reading")


@query("select l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) as slope, round(regr_intercept(l_extendedprice, l_quantity), 6) as intercept, round(regr_r2(l_extendedprice, l_quantity), 6) as r2, regr_count(l_extendedprice, l_quantity)::bigint as n from lineitem group by 1")
def trend(spark, d):
    return A.trend(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")


@query("with b as (select least(floor((l_quantity - 0.0) / 10.0), 4)::int as x_bin, least(floor((l_extendedprice - 0.0) / 20000.0), 4)::int as y_bin from lineitem where l_quantity between 0 and 50 and l_extendedprice between 0 and 100000) select x_bin, y_bin, count(*) as n from b group by 1, 2")
def bin2d(spark, d):
    return A.bin2d(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", (0.0, 50.0), (0.0, 100000.0), 5, 5)


@query("select o_orderpriority, month(o_orderdate)::int as month, round(quantile_cont(o_totalprice, 0.25), 6) as q25, round(quantile_cont(o_totalprice, 0.5), 6) as median, round(quantile_cont(o_totalprice, 0.75), 6) as q75, count(o_totalprice) as n from orders group by 1, 2")
def median_band(spark, d):
    return A.median_band(table(spark, d, "orders").withColumn("month", F.month("o_orderdate")), ["o_orderpriority", "month"], "o_totalprice")


_ROUNDS = "with d as (select distinct o_orderdate::date as day from orders), g as (select day, case when date_diff('day', lag(day) over (order by day), day) > 1 then 1 else 0 end as f from d), r as (select day, (1 + sum(f) over (order by day))::bigint as round from g), o as (select *, o_orderdate::date as day from orders) "


def _order_days(spark, d):
    return table(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date"))


@query(_ROUNDS + "select o.o_orderkey, o.day, r.round from o join r on o.day = r.day")
def sampling_rounds(spark, d):
    return W.sampling_rounds(_order_days(spark, d), "day", 1).select("o_orderkey", "day", "round")


@query(_ROUNDS + "select r.round, o.o_orderstatus, (date '1970-01-01' + floor(avg(date_diff('day', date '1970-01-01', o.day)))::int)::date as mean_date, round(avg(o_totalprice), 6) as mean, round(stddev_samp(o_totalprice) / sqrt(count(*)), 6) as se, count(*) as n from o join r on o.day = r.day group by 1, 2")
def round_means(spark, d):
    return A.round_means(_order_days(spark, d), "day", "o_totalprice", ["o_orderstatus"], 1)


# --- joins ----------------------------------------------------------------------------------


@query("with " + FLUX + ", a as (select hour, avg(reading) as wet from flux where site = 'Wetland' group by 1), b as (select hour, avg(reading) as up from flux where site = 'Upland' and species = 'error' group by 1) select coalesce(a.hour, b.hour) as hour, round(wet, 6) as wet, round(up, 6) as up from a full join b on a.hour = b.hour")
def align_outer(spark, d):
    f = flux(spark, d)
    a = f.where("site = 'Wetland'").groupBy("hour").agg(F.avg("reading").alias("wet"))
    b = f.where("site = 'Upland' and species = 'error'").groupBy("hour").agg(F.avg("reading").alias("up"))
    return J.merge_outer(a, b, ["hour"])


@query("with " + FLUX + ", s as (select hour, species, avg(reading) as v from flux group by 1, 2), h as (select distinct hour from s) select h.hour as datetime, round(a.v, 6) as click, round(b.v, 6) as view from h left join s a on a.hour = h.hour and a.species = 'click' left join s b on b.hour = h.hour and b.species = 'view'")
def backbone_align(spark, d):
    s = flux(spark, d).groupBy(F.col("hour").alias("datetime"), "species").agg(F.avg("reading").alias("v"))
    one = lambda n: s.where(F.col("species") == n).select("datetime", F.col("v").alias(n))
    return J.align(J.backbone([s.where(F.col("species") == n) for n in SPECIES]), [one("click"), one("view")])


@query("with " + FLUX + ", s as (select hour, species, avg(reading) as v from flux group by 1, 2) select hour, " + ", ".join(f"round(max(case when species = '{s}' then v end), 6) as {s}" for s in SPECIES) + " from s group by hour")
def merge_all(spark, d):
    s = flux(spark, d).groupBy("hour", "species").agg(F.avg("reading").alias("v"))
    return J.merge_all([s.where(F.col("species") == n).select("hour", F.col("v").alias(n)) for n in SPECIES], ["hour"])


_IV = "iv as (select event_id as iv, user_id as tree, ts as start_ts, ts + interval 10 minute as end_ts from events where event_type = 'signup')"


def _intervals(spark, d):
    f = flux(spark, d).where("species = 'signup'")
    return f.select(F.col("event_id").alias("iv"), "tree", F.col("ts").alias("start_ts"), (F.col("ts") + F.expr("interval 10 minutes")).alias("end_ts"))


@query("with " + FLUX + ", " + _IV + " select f.event_id, iv.iv, f.tree from flux f join iv on f.tree = iv.tree and f.ts between iv.start_ts and iv.end_ts")
def interval_assign(spark, d):
    return J.assign_intervals(flux(spark, d), _intervals(spark, d), ["tree"]).select("event_id", "iv", "tree")


@query("with " + FLUX + ", iv as (select event_id as iv, ts::date as day, ts as start_ts, ts + interval 60 minute as end_ts from events where event_type = 'signup'), a as (select iv.iv, f.ts, f.event_id, f.reading from flux f join iv on f.ts::date = iv.day and f.ts between iv.start_ts and iv.end_ts), x as (select iv, reading - lag(reading) over (partition by iv order by ts, event_id) as diff from a where reading is not null), c as (select iv, count(*) as n from a group by 1) select c.iv, c.n, round(case when count(diff) >= 2 then stddev_samp(diff) / sqrt(2) end, 6) as allan_sd_reading from c left join x on c.iv = x.iv group by 1, 2 having c.n >= 5")
def interval_allan(spark, d):
    f = flux(spark, d).withColumn("day", F.col("ts").cast("date"))
    iv = f.where("species = 'signup'").select(F.col("event_id").alias("iv"), "day", F.col("ts").alias("start_ts"), (F.col("ts") + F.expr("interval 60 minutes")).alias("end_ts"))
    return Q.interval_allan(f, iv, ["day"], "iv", ["ts", "event_id"], ["reading"], min_rows=5)


@query("with " + FLUX + ", l as (select event_id, ts, ts::date as day from flux where species = 'purchase'), r as (select event_id as log, ts as log_ts, ts::date as day from flux where species = 'signup'), p as (select l.event_id, r.log, abs(date_diff('microsecond', l.ts, r.log_ts)) as g, row_number() over (partition by l.event_id order by abs(date_diff('microsecond', l.ts, r.log_ts)), r.log) as k from l join r on l.day = r.day and abs(date_diff('microsecond', l.ts, r.log_ts)) <= 120000000) select l.event_id, p.log, round(p.g / 1000000.0, 6) as gap_s from l left join p on l.event_id = p.event_id and p.k = 1")
def nearest_join(spark, d):
    f = flux(spark, d).withColumn("day", F.col("ts").cast("date"))
    left = f.where("species = 'purchase'").select("event_id", "ts", "day")
    right = f.where("species = 'signup'").select(F.col("event_id").alias("log"), F.col("ts").alias("log_ts"), "day")
    return J.join_nearest(left, right, "event_id", ["day"], "ts", "log_ts", 120, "log").select("event_id", "log", "gap_s")


@query("with " + FLUX + ", r as (select tree, ts, max(value) as level from flux where species = 'view' group by 1, 2) select f.event_id, round(r.level, 6) as level from (select * from flux where species = 'click') f asof left join r on f.tree = r.tree and f.ts >= r.ts")
def asof_locf(spark, d):
    f = flux(spark, d)
    right = f.where("species = 'view'").groupBy("tree", "ts").agg(F.max("value").alias("level"))
    return J.join_asof(f.where("species = 'click'").select("event_id", "tree", "ts"), right, "ts", ["tree"], ["level"]).select("event_id", "level")


@query("select d.doc_id from documents d where exists (select 1 from labels l where l.doc_id = d.doc_id)")
def semi_keep(spark, d):
    return J.keep_in(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"])


@query("select d.doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def anti_missing(spark, d):
    return J.not_in(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"])


@query("with e as (select event_type, cast(user_id as varchar) || ' ' || strftime(ts, '%Y-%m-%d') as k from events), a as (select k, count(*) as expected from e where event_type = 'click' group by 1), b as (select k, count(*) as actual from e where event_type = 'view' group by 1) select coalesce(a.k, b.k) as k, expected, actual, case when b.k is null then 'missing' when a.k is null then 'extra' when expected is not distinct from actual then 'match' else 'differs' end as status from a full join b on a.k = b.k")
def reconcile(spark, d):
    e = table(spark, d, "events").withColumn("k", F.concat_ws(" ", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")))
    a = e.where("event_type = 'click'").groupBy("k").agg(F.count("*").alias("v"))
    b = e.where("event_type = 'view'").groupBy("k").agg(F.count("*").alias("v"))
    return J.reconcile(a, b, "k", "v")


@query("select c_custkey as key, 'customer' as source from customer union all select o_custkey, 'orders' from orders")
def union_tagged(spark, d):
    return J.union_tagged({"customer": table(spark, d, "customer").select(F.col("c_custkey").alias("key")), "orders": table(spark, d, "orders").select(F.col("o_custkey").alias("key"))})


@query("select distinct o_custkey as key from orders where o_custkey in (select c_custkey from customer)")
def common_keys(spark, d):
    return J.common_keys(table(spark, d, "customer").select(F.col("c_custkey").alias("key")), table(spark, d, "orders").select(F.col("o_custkey").alias("key")), ["key"])


@query("select key, 'left_only' as side from (select distinct c_custkey as key from customer) where key not in (select o_custkey from orders) union all select key, 'right_only' from (select distinct o_custkey as key from orders) where key not in (select c_custkey from customer)")
def only_in(spark, d):
    return J.both_differences(table(spark, d, "customer").select(F.col("c_custkey").alias("key")), table(spark, d, "orders").select(F.col("o_custkey").alias("key")), ["key"])


@query("select n_name, count(*) as n, round(avg(c_acctbal), 6) as mean from customer join nation on c_nationkey = n_nationkey group by 1")
def attach_labels(spark, d):
    c = J.left_lookup(table(spark, d, "customer"), table(spark, d, "nation").select("n_nationkey", "n_name"), "c_nationkey", "n_nationkey")
    return c.groupBy("n_name").agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("mean"))


# --- windows --------------------------------------------------------------------------------


def _roll(sql: str, digits: int = 6) -> str:
    return "with " + LONG + f" select variable, datetime, round(case when row_number() over (partition by variable order by datetime) >= 24 then {sql} end, {digits}) as roll from long window w as (partition by variable order by datetime rows between 23 preceding and current row)"


@query(_roll("avg(value) over w", 8), 8)
def roll_mean_n(spark, d):
    return W.roll_mean(driver_long(spark, d), ["variable"], "datetime", "value", 24).select("variable", "datetime", "roll")


@query(_roll("coalesce(sum(value) over w, 0)"))
def roll_sum_n(spark, d):
    return W.roll_sum(driver_long(spark, d), ["variable"], "datetime", "value", 24).select("variable", "datetime", "roll")


@query(_roll("stddev_samp(value) over w"))
def roll_sd_n(spark, d):
    return W.roll_sd(driver_long(spark, d), ["variable"], "datetime", "value", 24).select("variable", "datetime", "roll")


@query("with " + LONG + " select variable, datetime, round(case when count(value) over w = 7 then avg(value) over w end, 6) as roll from long window w as (partition by variable order by datetime rows between 6 preceding and current row)")
def roll_strict(spark, d):
    return W.roll_mean(driver_long(spark, d), ["variable"], "datetime", "value", 7, strict=True).select("variable", "datetime", "roll")


_EP = LONG + ", s as (select variable, datetime, case when value > 60 then 'high' when value < 40 then 'low' else 'mid' end as state from long where value is not null), c as (select *, case when state is distinct from lag(state) over (partition by variable order by datetime) then 1 else 0 end as c from s), r as (select *, sum(c) over (partition by variable order by datetime) as run from c), e as (select variable, state, min(datetime) as \"start\", max(datetime) as \"end\", count(*) as n from r group by variable, run, state)"


def _episodes(spark, d):
    s = driver_long(spark, d).where("value is not null").withColumn("state", F.when(F.col("value") > 60, "high").when(F.col("value") < 40, "low").otherwise("mid"))
    return W.episodes(s, ["variable"], "datetime", "state", ["high", "low"])


@query("with " + _EP + " select variable, state, \"start\", \"end\", n from e where state in ('high', 'low')")
def episodes(spark, d):
    return _episodes(spark, d)


@query("with " + _EP + " select variable, state, greatest(\"start\", timestamp '2024-01-10') as \"start\", least(\"end\", timestamp '2024-01-12') as \"end\", n from e where state in ('high', 'low') and \"end\" >= timestamp '2024-01-10' and \"start\" <= timestamp '2024-01-12'")
def clip_episodes(spark, d):
    return W.clip_intervals(_episodes(spark, d), F.lit("2024-01-10").cast("timestamp_ntz"), F.lit("2024-01-12").cast("timestamp_ntz"))


@query("with " + FLUX + " select event_id, round(coalesce((reading - avg(reading) over w) / nullif(stddev_samp(reading) over w, 0), 0), 6) as z from flux window w as (partition by site, species)")
def zscore_group(spark, d):
    return W.zscore(flux(spark, d), ["site", "species"], "reading", zero=True).select("event_id", "z")


@query("with " + FLUX + " select event_id, round((reading - (select avg(reading) from flux)) / (select stddev_samp(reading) from flux), 6) as z from flux")
def zscore_global(spark, d):
    return W.zscore(flux(spark, d), [], "reading").select("event_id", "z")


@query("with " + FLUX + " select event_id, round((reading - min(reading) over w) / nullif(max(reading) over w - min(reading) over w, 0), 6) as scaled from flux window w as (partition by tree)")
def minmax_group(spark, d):
    return W.minmax(flux(spark, d), ["tree"], "reading").select("event_id", "scaled")


@query("with " + FLUX + " select event_id, round(case when reading is not null then rank() over (partition by site order by floor(reading) desc nulls last) + (count(*) over (partition by site, floor(reading)) - 1) / 2.0 end, 6) as rank from flux")
def rank_avg(spark, d):
    f = flux(spark, d).withColumn("v", F.floor("reading"))
    return W.rank_avg(f, ["site"], "v").select("event_id", "rank")


@query("select o_orderkey, o_custkey, o_totalprice from (select *, rank() over (partition by o_orderpriority order by floor(o_totalprice / 1000) desc) as k from orders) where k <= 3")
def topn_ties(spark, d):
    return W.topn(table(spark, d, "orders"), ["o_orderpriority"], [F.floor(F.col("o_totalprice") / 1000).desc()], 3).select("o_orderkey", "o_custkey", "o_totalprice")


@query("with " + FLUX + " select tree, event_id, species from (select *, row_number() over (partition by tree order by case species when 'signup' then 3 when 'purchase' then 2 when 'click' then 1 end desc nulls last, event_id) as k from flux) where k = 1")
def dedupe_priority(spark, d):
    rank = F.when(F.col("species") == "signup", 3).when(F.col("species") == "purchase", 2).when(F.col("species") == "click", 1)
    return W.dedupe(flux(spark, d), ["tree"], rank, [F.col("event_id")]).select("tree", "event_id", "species")


@query("with " + FLUX + ", g as (select tree, first(reading order by event_id) as r from flux where reading is not null group by 1) select f.event_id, round(coalesce(f.reading, g.r), 6) as reading from flux f left join g on f.tree = g.tree")
def fill_first(spark, d):
    return W.fill_first(flux(spark, d), ["tree"], "reading", "event_id").select("event_id", "reading")


@query("with d as (select o_orderkey, o_orderdate::date as day from orders) select o_orderkey, day, dense_rank() over (order by day)::int as date_index from d")
def date_index(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return W.date_index(o, "day").select("o_orderkey", "day", "date_index")


@query("with " + FLUX + ", q as (select unnest([0, 1, 2]) as band, unnest([quantile_cont(reading, 0.1), quantile_cont(reading, 0.5), quantile_cont(reading, 0.9)]) as centre from flux) select band::int as band, round(centre, 6) as centre, round((lag(centre) over (order by band) + centre) / 2, 6) as lower, round((lead(centre) over (order by band) + centre) / 2, 6) as upper from q")
def quantile_bands(spark, d):
    return W.quantile_bands(flux(spark, d), "reading", (0.1, 0.5, 0.9))


@query("with " + FLUX + ", n as (select event_id, row_number() over (partition by tree order by event_id) as i, count(*) over (partition by tree) as n from flux) select event_id from n where (i - 1) % ceil(n / 6.0)::bigint = 0 or i = n")
def thin_rows(spark, d):
    return W.thin_rows(flux(spark, d), ["tree"], [F.col("event_id")], 6).select("event_id")


@query("with " + FLUX + ", e as (select site, species, avg(abs(reading)) as strength from flux group by 1, 2), g as (select site, row_number() over (order by avg(strength) desc, site) as group_rank from e group by 1) select e.site, species, round(strength, 6) as strength, row_number() over (partition by e.site order by strength desc, species)::int as rank_in_group, g.group_rank::int as group_rank from e join g on e.site = g.site")
def rank_variables(spark, d):
    return W.rank_variables(flux(spark, d), "site", "species", "reading")


@query("with " + FLUX + " select event_id, round(100.0 * avg(case when reading > 40 then 1 else 0 end) over (partition by species), 6) as pct_retained from flux")
def pct_retained(spark, d):
    return W.pct_retained(flux(spark, d), ["species"], F.col("reading") > 40).select("event_id", "pct_retained")


@query("with " + FLUX + " select event_id, round(reading - lag(reading) over (partition by tree order by ts, event_id), 6) as diff from flux where reading is not null")
def first_difference(spark, d):
    return W.first_difference(flux(spark, d), ["tree"], ["ts", "event_id"], "reading").select("event_id", "diff")


@query("with " + FLUX + " select event_id, round(flux, 6) as flux from flux order by abs(flux) desc, event_id limit 25")
def top_abs(spark, d):
    return W.top_abs(flux(spark, d), "flux", 25, [F.col("event_id")]).select("event_id", "flux")


# --- scalars --------------------------------------------------------------------------------


@query("select o_orderkey, o_orderdate::date as parsed, strftime(o_orderdate, '%Y-%m-%d %H:%M:00')::timestamp as ts12 from orders")
def parse_dates(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format("o_orderdate", "M/d/yyyy")).when(k == 1, F.date_format("o_orderdate", "M-d-yyyy")).when(k == 2, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "MM/dd/yyyy"))
    return o.select("o_orderkey", S.parse_date_multi(text).alias("parsed"), S.parse_ts12(F.date_format("o_orderdate", "yyyyMMddHHmm")).alias("ts12"))


@query("select p_partkey, case when p_size between 0 and 15 then 'shallow' when p_size > 15 and p_size <= 35 then 'mid' when p_size > 35 and p_size <= 45 then 'deep' end as depth from part")
def cut_depth(spark, d):
    return table(spark, d, "part").select("p_partkey", S.cut("p_size", (0, 15, 35, 45), ("shallow", "mid", "deep")).alias("depth"))


@query("select p_partkey, lpad(ltrim((p_partkey % 100)::varchar, '0'), 3, '0') || '.' || lpad(ltrim(p_size::varchar, '0'), 3, '0') as position from part")
def position_key(spark, d):
    return table(spark, d, "part").select("p_partkey", S.position_key(F.col("p_partkey") % 100, "p_size").alias("position"))


@query("with " + FLUX + " select event_id, case species when 'click' then 'Quercus' when 'view' then 'Acer' else 'other' end as name, case when species in ('error', 'purchase') then 'merged' else species end as merged from flux where species <> 'signup'")
def recode(spark, d):
    f = S.merge_codes(flux(spark, d).withColumn("merged", F.col("species")), "merged", {"error": "merged", "purchase": "merged"}, drop=["signup"])
    return f.select("event_id", S.recode("species", {"click": "Quercus", "view": "Acer"}, "other").alias("name"), "merged")


@query("with " + FLUX + " select event_id, round(asinh(flux), 6) as asinh, round(sign(flux) * sqrt(abs(flux)), 6) as signed_sqrt, round(asinh(flux / 2) / ln(10), 6) as pseudo_log, round(case when flux + 10 > 0 then ln(flux + 10) end, 6) as log_offset, round(least(greatest(flux, -20.0), 20.0), 6) as clamped from flux")
def transforms(spark, d):
    f = flux(spark, d)
    return f.select("event_id", F.asinh("flux").alias("asinh"), S.signed_sqrt("flux").alias("signed_sqrt"), S.pseudo_log("flux").alias("pseudo_log"), S.log_offset("flux", 10).alias("log_offset"), S.clamp("flux", -20.0, 20.0).alias("clamped"))


@query("select l_orderkey, l_linenumber, round(greatest(0.6108 * exp(17.27 * t / (t + 237.3)) * (1 - rh / 100), 0), 6) as vpd, round(0.61121 * (1.0007 + 3.46e-5 * 101.3) * exp(17.502 * t / (240.97 + t)) * (1 - rh / 100), 6) as vpd_buck, round(1013.25 * l_quantity / (83.14472 * (t + 273.15)), 6) as nmol, round(l_extendedprice * 1800 / 2.45e6, 6) as et from (select *, l_tax * 400 as t, l_discount * 1000 as rh from lineitem)")
def vpd_and_gas(spark, d):
    li = table(spark, d, "lineitem").withColumn("t", F.col("l_tax") * 400).withColumn("rh", F.col("l_discount") * 1000).withColumn("p", F.lit(101.3))
    return li.select("l_orderkey", "l_linenumber", S.vpd_tetens("rh", "t").alias("vpd"), S.vpd_buck("rh", "t", "p").alias("vpd_buck"), S.ideal_gas_nmol(F.lit(1013.25), "l_quantity", "t").alias("nmol"), S.et_mm("l_extendedprice", 1800).alias("et"))


@query("select o_orderkey, (case when month(o_orderdate) >= 11 then -(365 - dayofyear(o_orderdate)) else dayofyear(o_orderdate) end)::int as signed_doy, (year(o_orderdate) + case when month(o_orderdate) >= 10 then 1 else 0 end)::int as wyear, date_trunc('hour', o_orderdate + interval 30 minute)::timestamp as nearest_hour, (o_orderdate - interval 5 hour)::timestamp as shifted from orders")
def calendar(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.signed_doy("o_orderdate").alias("signed_doy"), S.water_year("o_orderdate").alias("wyear"), S.round_time("o_orderdate").alias("nearest_hour"), S.shift_clock("o_orderdate", -5).alias("shifted"))


@query("with " + FLUX + " select event_id, round(case when tree % 3 = 0 then value * 1000 else value end, 6) as corrected, round(coalesce(reading, value / 2, -1), 6) as filled from flux where value between 1 and 90")
def corrections(spark, d):
    f = S.plausible(flux(spark, d), "value", 1, 90).withColumn("corrected", F.col("value")).withColumn("filled", F.col("reading"))
    f = S.fill_from(S.correct_units(f, "corrected", F.col("tree") % 3 == 0, 1000), "filled", [F.col("value") / 2, -1.0])
    return f.select("event_id", "corrected", "filled")


# --- quality --------------------------------------------------------------------------------

_ALLAN = FLUX + ", x as (select tree, reading - lag(reading) over (partition by tree order by ts, event_id) as diff from flux where reading is not null), al as (select tree, case when count(diff) >= 2 then stddev_samp(diff) / sqrt(2) end as allan_sd from x group by 1)"
_MDF = _ALLAN + """, mid as (select case when tree % 3 = 0 then 'LI-7810' else 'LGR/UGGA' end as instrument, quantile_cont(allan_sd, 0.5) as mid from al where allan_sd is not null group by 1),
m as (select f.event_id, f.ts, f.tree, f.site, f.species, f.flux, f.reading, case when f.tree % 3 = 0 then 'LI-7810' else 'LGR/UGGA' end as instrument, al.allan_sd, (100 + f.tree) / 0.5 as flux_term, coalesce(case when f.event_id % 5 <> 0 then 60.0 + f.event_id % 240 end, 300.0) as t_sec_est from flux f left join al on f.tree = al.tree),
q as (select m.*, case m.instrument when 'LI-7810' then 0.6 else 0.9 end / t_sec_est * flux_term as MDF_manuf, 1.6448536269514722 * mid / t_sec_est * flux_term as MDF_wass90, 1.959963984540054 * mid / t_sec_est * flux_term as MDF_wass95, 2.5758293035489004 * mid / t_sec_est * flux_term as MDF_wass99, allan_sd / t_sec_est * flux_term as noise_floor from m left join mid on m.instrument = mid.instrument),
z as (select q.*, abs(flux) < MDF_manuf as below_MDF_manuf, abs(flux) < MDF_wass90 as below_MDF_wass90, abs(flux) < MDF_wass95 as below_MDF_wass95, abs(flux) < MDF_wass99 as below_MDF_wass99, abs(flux) < MDF_wass95 as below_MDF, case when noise_floor > 0 then abs(flux) / noise_floor end as snr_allan,
 event_id % 100 / 100.0 as r2, event_id % 90 / 90.0 as co2_r2, reading / 20 as snr_se, reading / 15 as co2_snr_se, flux as co2_flux from q)"""


def _allan(spark, d):
    return Q.allan_sd(flux(spark, d), ["tree"], ["ts", "event_id"], ["reading"]).withColumnRenamed("allan_sd_reading", "allan_sd")


def _mdf(spark, d, chr_: bool = False):
    inst = F.when(F.col("tree") % 3 == 0, "LI-7810").otherwise("LGR/UGGA")
    al = _allan(spark, d).select("tree", "allan_sd")
    f = flux(spark, d).join(al, "tree", "left").withColumn("instrument", inst).withColumn("nmol", F.lit(100.0) + F.col("tree")).withColumn("surfarea", F.lit(0.5))
    f = f.withColumn("t_sec", F.when(F.col("event_id") % 5 != 0, 60.0 + F.col("event_id") % 240))
    f = Q.mdf_wassmann(Q.mdf_manufacturer(Q.noise_metrics(f), Q.precision_of(F.col("instrument"))), al.withColumn("instrument", inst), "instrument")
    f = Q.mdf_flags(Q.mdf_christiansen(f) if chr_ else f)
    e = F.col("event_id")
    return f.withColumns({"r2": e % 100 / 100.0, "co2_r2": e % 90 / 90.0, "snr_se": F.col("reading") / 20, "co2_snr_se": F.col("reading") / 15, "co2_flux": F.col("flux")})


@query("with " + _ALLAN + ", c as (select tree, count(*) as n from flux group by 1) select c.tree, c.n, round(al.allan_sd, 6) as allan_sd from c left join al on c.tree = al.tree")
def allan_by_group(spark, d):
    return _allan(spark, d)


@query("with " + _MDF + " select event_id, round(MDF_manuf, 6) as mdf_manuf, round(MDF_wass90, 6) as mdf_wass90, round(MDF_wass95, 6) as mdf_wass95, round(MDF_wass99, 6) as mdf_wass99, round(noise_floor, 6) as noise_floor, round(snr_allan, 6) as snr_allan from z")
def mdf_wassmann(spark, d):
    return _mdf(spark, d).select("event_id", *[F.col(f"MDF_{x}").alias(f"mdf_{x}") for x in ("manuf", "wass90", "wass95", "wass99")], "noise_floor", "snr_allan")


@query()
def mdf_christiansen(spark, d):
    return _mdf(spark, d, True).select("event_id", *[F.col(f"MDF_chr{x}").alias(f"mdf_chr{x}") for x in ("90", "95", "99")], "below_MDF_chr95")


@query("with " + _MDF + " select event_id, below_MDF_manuf as b_manuf, below_MDF_wass90 as b90, below_MDF_wass95 as b95, below_MDF_wass99 as b99, below_MDF as b from z")
def mdf_flags(spark, d):
    return _mdf(spark, d).select("event_id", F.col("below_MDF_manuf").alias("b_manuf"), F.col("below_MDF_wass90").alias("b90"), F.col("below_MDF_wass95").alias("b95"), F.col("below_MDF_wass99").alias("b99"), F.col("below_MDF").alias("b"))


_FLAG_SQL = {f"below_MDF_{x}": f"below_MDF_{x}" for x in ("manuf", "wass90", "wass95", "wass99")}


@query("with " + _MDF + ", l as (" + " union all ".join(f"select instrument, '{k}' as threshold, {v}::int as below from z" for k, v in _FLAG_SQL.items()) + ") select 'all' as \"group\", threshold, count(below) as evaluated, coalesce(sum(below), 0)::bigint as below, round(100.0 * sum(below) / count(below), 6) as pct from l group by threshold union all select instrument, threshold, count(below), coalesce(sum(below), 0)::bigint, round(100.0 * sum(below) / count(below), 6) from l group by instrument, threshold")
def mdf_report(spark, d):
    return Q.mdf_report(_mdf(spark, d), list(_FLAG_SQL), "instrument")


_PASS = {
    "No filter": "true", "Manufacturer MDF": "coalesce(not below_MDF_manuf, true)", "CO2 flux > 0": "coalesce(co2_flux > 0, false)", "CO2 SNR (SE) > 2": "coalesce(co2_snr_se > 2, false)",
    "CO2 R2 > 0.7": "coalesce(co2_r2 > 0.7, false)", "CO2 R2 > 0.8": "coalesce(co2_r2 > 0.8, false)", "CH4 SNR (SE) > 2": "coalesce(snr_se > 2, false)", "CH4 SNR (SE) > 3": "coalesce(snr_se > 3, false)",
    "CH4 SNR (Allan) > 2": "coalesce(snr_allan > 2, true)", "CH4 SNR (Allan) > 3": "coalesce(snr_allan > 3, true)", "Wassmann 90%": "coalesce(not below_MDF_wass90, true)", "Wassmann 95%": "coalesce(not below_MDF_wass95, true)",
    "Wassmann 99%": "coalesce(not below_MDF_wass99, true)", "CH4 R2 > 0.5": "coalesce(r2 > 0.5, false)", "CH4 R2 > 0.7": "coalesce(r2 > 0.7, false)", "CH4 R2 > 0.9": "coalesce(r2 > 0.9, false)",
}


@query("with " + _MDF + ", l as (" + " union all ".join(f"select instrument, '{k}' as filter, {v} as ok, flux as x from z" for k, v in _PASS.items()) + ") select instrument, filter, count(*) as n, count(*) filter (where ok) as n_pass, round(100.0 * count(*) filter (where ok) / count(*), 6) as pct_pass, count(*) filter (where ok and x < 0) as n_neg, round(100.0 * count(*) filter (where ok and x < 0) / nullif(count(*) filter (where ok), 0), 6) as pct_neg, round(avg(x) filter (where ok), 6) as mean, round(quantile_cont(x, 0.5) filter (where ok), 6) as median from l group by 1, 2")
def filter_sensitivity(spark, d):
    registry = {k: v for k, v in Q.filter_registry().items() if "Christiansen" not in k}
    return Q.filter_sensitivity(_mdf(spark, d), registry, by=["instrument"])


_TREAT = _MDF + ", l as (" + " union all ".join(f"select '{k[10:]}' as threshold, coalesce({v}, false) as b, flux as x from z" for k, v in _FLAG_SQL.items()) + "), t as (select threshold, treatment, case when not b or treatment = 'keep' then x when treatment = 'zero' then 0 end as v from l cross join (select unnest(['remove', 'zero', 'keep']) as treatment)), s as (select threshold, treatment, count(v) as n, avg(v) as mean, quantile_cont(v, 0.5) as median, stddev_samp(v) as sd from t group by 1, 2)"


def _treat(spark, d):
    return Q.treatment_effects(_mdf(spark, d), {k[10:]: v for k, v in _FLAG_SQL.items()})


@query("with " + _TREAT + " select threshold, treatment, n, round(mean, 6) as mean, round(median, 6) as median, round(sd, 6) as sd from s")
def treatment_effects(spark, d):
    return _treat(spark, d)


@query("with " + _TREAT + " select threshold, treatment, round(100.0 * (mean - max(case when treatment = 'keep' then mean end) over w) / abs(max(case when treatment = 'keep' then mean end) over w), 6) as pct_change_mean from s window w as (partition by threshold)")
def pct_change(spark, d):
    return Q.pct_change_vs(_treat(spark, d), ["threshold"], "treatment", "keep", ["mean"]).select("threshold", "treatment", "pct_change_mean")


@query("with " + _MDF + " select instrument, count(*) filter (where flux < 0) as n_neg, " + ", ".join(f"count(*) filter (where flux < 0 and abs(flux) < {k} * noise_floor) as n_within_{k}" for k in (1, 2, 3)) + ", round(quantile_cont(abs(flux), 0.5) filter (where flux < 0), 6) as median_abs_neg, round(quantile_cont(noise_floor, 0.5), 6) as median_noise from z group by 1")
def noise_check(spark, d):
    return Q.noise_check(_mdf(spark, d), ["instrument"])


@query("with " + _MDF + " select case when month(ts) in (12, 1, 2) then 'Winter (Dec-Feb)' when month(ts) in (3, 4, 5) then 'Spring (Mar-May)' when month(ts) in (6, 7, 8) then 'Summer (Jun-Aug)' else 'Fall (Sep-Nov)' end as period, instrument, count(*) as n, round(avg(flux), 6) as mean, round(quantile_cont(flux, 0.5), 6) as median, count(*) filter (where flux < 0) as n_neg, count(*) filter (where below_MDF) as n_below from z group by 1, 2")
def period_breakdown(spark, d):
    return Q.period_breakdown(_mdf(spark, d), Q.season(F.month("ts")), ["instrument"])


_CLS = "case when n2 >= 2 then 'Multiple flags' {own} when flag_snr then 'CO2 low SNR' when flag_r2 then 'CO2 low R2' when flag_neg then 'CO2 < 0' else 'Neither' end"


@query("with " + _MDF + ", g as (select *, co2_snr_se < 2 as flag_snr, co2_r2 < 0.8 as flag_r2, co2_flux < 0 as flag_neg, snr_se < 2 as flag_own from z where reading is not null), h as (select *, flag_snr::int + flag_r2::int + flag_neg::int as na, flag_snr::int + flag_r2::int + flag_neg::int + flag_own::int as nb from g), c as (select " + _CLS.format(own="").replace("n2", "na") + " as co2_class, " + _CLS.format(own="when flag_own then 'CH4 low SNR'").replace("n2", "nb") + " as ch4_class from h) select co2_class, ch4_class, count(*) as n from c group by 1, 2")
def qc_classify(spark, d):
    f = S.require(_mdf(spark, d), ["reading"])
    return A.count_by(Q.qc_classify(f, "co2_flux", "co2_snr_se", "co2_r2", "snr_se", 2, 0.8, 2), ["co2_class", "ch4_class"])


@query("with " + _MDF + " select species, count(*) as n_detected, count(*) filter (where flux > 0) as n_pos, count(*) filter (where flux < 0) as n_neg, round(100.0 * avg(case when flux < 0 then 1 else 0 end), 6) as pct_neg from z where coalesce(not below_MDF, true) and flux is not null group by 1")
def sign_analysis(spark, d):
    return Q.sign_analysis(_mdf(spark, d), ["species"])


@query("with " + _MDF + " select species, site, count(*) as n, round(avg(flux), 6) as mean, round(quantile_cont(flux, 0.5), 6) as median, round(stddev_samp(flux), 6) as sd, round(100.0 * avg(case when flux < 0 then 1 else 0 end), 6) as pct_neg, round(100.0 * avg(case when below_MDF then 1 else 0 end), 6) as pct_below from z group by 1, 2")
def qc_by_group(spark, d):
    return Q.qc_by_group(_mdf(spark, d), ["species", "site"])


# --- correlations ---------------------------------------------------------------------------


@query("with " + LONG + " select variable, datetime, round(value - (avg(value) over (partition by variable, dayofyear(datetime)) + avg(value) over (partition by variable, hour(datetime)) - avg(value) over (partition by variable)), 6) as anomaly from long")
def anomaly(spark, d):
    return K.anomaly(driver_long(spark, d)).select("variable", "datetime", "anomaly")


@query("with " + FLUX + " select site, species, round(case when count(reading) >= 5 then corr(reading, tree) end, 6) as r, count(reading) as n from flux group by 1, 2")
def pearson_by(spark, d):
    return K.pearson(flux(spark, d).withColumn("tree", F.col("tree").cast("double")), ["site", "species"], "reading", "tree", p=False)




@query("with o as (select o_totalprice, c_acctbal, c_mktsegment, o_orderpriority from orders join customer on o_custkey = c_custkey), g as (select c_mktsegment, o_orderpriority, grouping(c_mktsegment) as a, grouping(o_orderpriority) as b, corr(o_totalprice, c_acctbal) as r, count(*) as n from o group by grouping sets ((), (c_mktsegment), (o_orderpriority), (c_mktsegment, o_orderpriority))) select case when a = 1 then 'all' else c_mktsegment end as c_mktsegment, case when b = 1 then 'all' else o_orderpriority end as o_orderpriority, round(case when n >= 4 then r end, 6) as r, n from g")
def grouping_sets_corr(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return K.corr_by_levels(o, "o_totalprice", "c_acctbal", [[], ["c_mktsegment"], ["o_orderpriority"], ["c_mktsegment", "o_orderpriority"]])


WINDOWS = tuple(range(3, 337, 3))
SOME_WINDOWS = (3, 6, 12, 24, 72)
_MODES = LONG + """, modes as (select variable, 'raw' as mode, datetime, value from long union all
 select variable, 'anomaly', datetime, value - (avg(value) over (partition by variable, dayofyear(datetime)) + avg(value) over (partition by variable, hour(datetime)) - avg(value) over (partition by variable)) from long)"""
_ROLLED = "select variable, mode, datetime, {n} as win, case when row_number() over (partition by variable, mode order by datetime) >= {n} then avg(value) over (partition by variable, mode order by datetime rows between {m} preceding and current row) end as feature from modes"
_SWEEP = (
    _MODES
    + ", wl as ("
    + " union all ".join(_ROLLED.format(n=n, m=n - 1) for n in WINDOWS)
    + '), sweep as (select site, variable, mode, win as "window", count(*) filter (where flux is not null and feature is not null) as n, corr(flux, feature) as r0 from flux join wl on flux.hour = wl.datetime where feature is not null group by 1, 2, 3, 4), sw as (select site, variable, mode, "window", n, case when n >= 5 then r0 end as r from sweep)'
)


def _sweep(spark, d, p: bool = False):
    f = flux(spark, d).select(F.col("hour").alias("datetime"), "site", "flux")
    return K.window_sweep(f, K.both_modes(driver_long(spark, d)), WINDOWS, series=["variable", "mode"], p=p).where("n > 0")


@query("with " + _SWEEP + ' select site, variable, mode, "window"::int as "window", \'mean\' as stat, round(r, 6) as r, n from sw')
def window_sweep(spark, d):
    return _sweep(spark, d)


_BEST = ', best as (select site, variable, mode, "window"::int as "window", r, n from (select *, row_number() over (partition by site, variable, mode order by round(abs(r), 9) desc, "window") as k from sw where r is not null) where k = 1)'


def _best(spark, d, p: bool = False, alpha: float = 0.05):
    return K.best_windows(_sweep(spark, d, p).withColumn("r", F.round("r", 9)), ["mode", "site"], p=p, alpha=alpha)


@query("with " + _SWEEP + _BEST + ' select site, variable, mode, "window", round(r, 6) as r, n from best')
def best_windows(spark, d):
    return _best(spark, d).select("site", "variable", "mode", "window", "r", "n")


@query()
def best_windows_adjusted(spark, d):
    return _best(spark, d, p=True)


@query()
def significance_report(spark, d):
    return K.significance_report(_best(spark, d, p=True, alpha=0.5), ["mode", "site"])


@query("with p as (select event_type as k, event_id, case when value <= 60 then (event_id * 37 % 1000 + 1) / 1000.0 end as p from events), m as (select *, row_number() over (partition by k order by p, event_id) as m, count(p) over (partition by k) as n from p where p is not null), q as (select k, event_id, p, least(1.0, min(p * n / m) over (partition by k order by m desc rows between unbounded preceding and current row)) as p_adj from m) select k, event_id, round(p, 6)::double as p, round(p_adj, 6)::double as p_adj from q union all select k, event_id, null, null from p where p is null")
def bh_adjust(spark, d):
    e, i = table(spark, d, "events"), F.col("event_id")
    rows = e.select(F.col("event_type").alias("k"), "event_id", F.when(F.col("value") <= 60, (i * 37 % 1000 + 1) / 1000.0).alias("p"))
    return K.bh_adjust(rows, ["k"], "p")


_MET = "m as (select vec_id, label, " + ", ".join(f"embedding[{i + 1}]::double as d{i}" for i in range(8)) + " from embeddings)"


def _metrics(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"d{i}") for i in range(8)])


_CELLS = " union all ".join(f"select 'd{a}' as a, 'd{b}' as b, corr(d{a}, d{b}) as r, count(*) as n from m" for a in range(8) for b in range(8))


@query("with " + _MET + ", c as (" + _CELLS + ") select a, b, round(r, 6) as r, n from c")
def corr_matrix(spark, d):
    return K.corr_matrix(_metrics(spark, d), [f"d{i}" for i in range(8)])


@query("with " + _MET + ", c as (" + _CELLS + ") select a, b, round(r, 6) as r, n, round(abs(r), 6) as abs_r from c where a < b and abs(r) >= 0.02")
def redundant_pairs(spark, d):
    return K.redundant_pairs(K.corr_matrix(_metrics(spark, d), [f"d{i}" for i in range(8)]), 0.02)


@query("with recursive " + _MET + ", c as (" + _CELLS + "), e as (select a, b from c where a <> b and abs(r) >= 0.05), v as (select distinct a from c), reach as (select a, a as b from v union select reach.a, e.b from reach join e on reach.b = e.a) select a as variable, min(b) as cluster from reach group by 1")
def corr_clusters(spark, d):
    return K.corr_clusters(K.corr_matrix(_metrics(spark, d), [f"d{i}" for i in range(8)]), 0.05)


def _halves(spark, d):
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    e = W.means_in_order(flux(spark, d), ["tree"], ["event_id"], a=F.when(early, F.col("value")), b=F.when(~early, F.col("value")))
    return e.withColumn("g", F.col("tree") % 2)


@query("with e as (select user_id, avg(value) filter (where ts < timestamp '2024-01-16') as a, avg(value) filter (where ts >= timestamp '2024-01-16') as b, user_id % 2 as g from events group by user_id), r as (select g, rank() over (partition by g order by a desc) + (count(*) over (partition by g, a) - 1) / 2.0 as ra, rank() over (partition by g order by b desc) + (count(*) over (partition by g, b) - 1) / 2.0 as rb from e where a is not null and b is not null) select g, round(corr(ra, rb), 6) as r, count(*) as n from r group by g")
def spearman_rho(spark, d):
    return K.spearman(_halves(spark, d), ["g"], "a", "b", p=False)


@query("with " + LONG + ", a as (select variable, datetime, value, value - (avg(value) over (partition by variable, dayofyear(datetime)) + avg(value) over (partition by variable, hour(datetime)) - avg(value) over (partition by variable)) as anomaly from long), j as (select site, variable, flux, a.value, anomaly from flux join a on flux.hour = a.datetime) select site, variable, round(corr(flux, value), 6) as r_raw, round(corr(flux, anomaly), 6) as r_anomaly, round(corr(flux, anomaly) - corr(flux, value), 6) as delta_r, sign(corr(flux, value)) = sign(corr(flux, anomaly)) as same_sign from j group by 1, 2")
def compare_modes(spark, d):
    f = flux(spark, d).select(F.col("hour").alias("datetime"), "site", "flux")
    both = f.join(K.both_modes(driver_long(spark, d)), "datetime")
    return K.compare_raw_anomaly(K.pearson(both, ["site", "variable", "mode"], "flux", "value", p=False), ["site"])


@query("with " + FLUX + ", e as (select site, tree, avg(reading) as reading, avg(flux) as flux from flux group by 1, 2), a as (select site, corr(reading, flux) as r_rows, count(reading) as n_rows from flux group by 1), b as (select site, corr(reading, flux) as r_entities, count(reading) as n_entities from e group by 1) select a.site, round(r_rows, 6) as r_rows, n_rows, round(r_entities, 6) as r_entities, n_entities from a join b on a.site = b.site")
def two_level_corr(spark, d):
    return K.two_level_corr(flux(spark, d), ["site"], "tree", "reading", "flux")


@query("with " + FLUX + ", g as (select species, count(reading) as n, avg(reading) as m, coalesce(var_samp(reading) * (count(reading) - 1), 0) as w from flux where reading is not null group by 1), o as (select count(*) as k, sum(n) as n, sum(w) as ss_within, sum(n * m * m) - sum(n * m) ** 2 / sum(n) as ss_between from g) select (k - 1)::bigint as df1, (n - k)::bigint as df2, round(ss_between, 3) as ss_between, round(ss_within, 3) as ss_within, round(ss_between / (ss_between + ss_within), 6) as share, round((ss_between / (k - 1)) / (ss_within / (n - k)), 6) as f from o")
def anova_ss(spark, d):
    out = K.anova_oneway(flux(spark, d), "species", "reading", p=False)
    return out.withColumn("ss_between", F.round("ss_between", 3)).withColumn("ss_within", F.round("ss_within", 3))


# --- models ---------------------------------------------------------------------------------


@query("with s as (select l_returnflag, regr_slope(l_extendedprice, l_quantity) as b, regr_intercept(l_extendedprice, l_quantity) as a, regr_r2(l_extendedprice, l_quantity) as r2, count(*) as n from lineitem group by 1) select l_returnflag, '(Intercept)' as term, round(a, 4) as estimate, n, round(r2, 6) as r2 from s union all select l_returnflag, 'l_quantity', round(b, 4), n, round(r2, 6) from s")
def ols_coef(spark, d):
    li = table(spark, d, "lineitem")
    out = M.ols_by(li, "l_extendedprice", M.design(li, ["l_quantity"]), ["l_returnflag"])
    return out.select("l_returnflag", "term", F.round("estimate", 4).alias("estimate"), "n", "r2")


def _model_rows(spark, d):
    return flux(spark, d).withColumn("hour_of_day", F.hour("ts").cast("double")).withColumn("lagged", F.col("tree").cast("double") / 10)


@query()
def lmm_fit(spark, d):
    f = _model_rows(spark, d)
    return M.lmm(f, "value", M.design(f, ["hour_of_day*site"], ["site"]), "tree").coefficients(spark)


@query()
def lmm_summary(spark, d):
    f = _model_rows(spark, d)
    des = M.design(f, ["hour_of_day", "species"], ["species"])
    a, b = M.lmm(f, "value", des, "tree", reml=False), M.ols(f, "value", des)
    return M.compare_models(spark, {"fixed": (b, M.r_squared(b)), "mixed": (a, M.marginal_r2(f, "value", des, a))})


@query()
def icc(spark, d):
    return M.icc(flux(spark, d), ["site"], "tree", "reading")


@query()
def lrt_random(spark, d):
    out = M.lrt_random(flux(spark, d), "tree", "value")
    return spark.createDataFrame([tuple(out.values())], ", ".join(f"{k} double" for k in out))


@query()
def blups(spark, d):
    f = _model_rows(spark, d)
    des = M.design(f, ["hour_of_day"])
    return M.blups(f, "value", des, M.lmm(f, "value", des, "tree"))


@query()
def emmeans(spark, d):
    f = _model_rows(spark, d)
    des = M.design(f, ["species*site"], ["species", "site"])
    return M.emmeans(spark, M.lmm(f, "value", des, "tree"), des, "species", "site")[0]


@query()
def gvif(spark, d):
    f = _model_rows(spark, d)
    return M.gvif(spark, M.ols(f, "value", M.design(f, ["hour_of_day", "lagged", "species"], ["species"])))


@query()
def forward_select(spark, d):
    return M.forward_select(_metrics(spark, d), "d0", ["d1"], [f"d{i}" for i in range(2, 8)])


@query()
def selection_frequency(spark, d):
    return M.selection_frequency(_metrics(spark, d), "vec_id", "d0", [], [f"d{i}" for i in range(1, 8)])


@query()
def addition_tests(spark, d):
    f = _model_rows(spark, d)
    return M.addition_tests(f, "value", ["site"], ["hour_of_day", "lagged"], "tree", "site", ["site"])


@query()
def interaction_screen(spark, d):
    f = _model_rows(spark, d)
    return M.interaction_screen(f, "value", ["hour_of_day", "site", "species"], [("hour_of_day", "site"), ("hour_of_day", "species")], "tree", ["site", "species"])


@query()
def slopes_by_level(spark, d):
    f = _model_rows(spark, d)
    des = M.design(f, ["hour_of_day*species"], ["species"])
    return M.slopes_by_level(spark, M.ols(f, "value", des), des, ["hour_of_day"], "species")


def _features(spark, d):
    f = flux(spark, d).select("event_id", F.col("hour").alias("datetime"), "flux")
    return K.window_features(f, driver_long(spark, d), SOME_WINDOWS)


@query()
def window_grid(spark, d):
    return M.window_grid(_features(spark, d), "flux", "click", "view", "event_id")


@query()
def feature_matrix(spark, d):
    f = _features(spark, d).where("variable in ('click', 'view') and window in (6, 24)")
    name = F.concat_ws("_", "variable", F.lit("raw"), F.concat(F.col("window").cast("string"), F.lit("h")))
    return R.to_wide(f.withColumn("name", name), ["event_id"], "name", "mean", ["click_raw_6h", "click_raw_24h", "view_raw_6h", "view_raw_24h"])


@query()
def residual_screen(spark, d):
    f = _model_rows(spark, d)
    des = M.design(f, ["hour_of_day"])
    m = M.ols(f, "flux", des)
    resid = f.select(F.col("hour").alias("datetime"), "site", (F.col("flux") - M.predict_column(m, des)).alias("resid"))
    return K.best_windows(K.window_sweep(resid, driver_long(spark, d), WINDOWS, y="resid", p=True), ["site"])


@query()
def sweep_statistics(spark, d):
    f = flux(spark, d).select(F.col("hour").alias("datetime"), "site", "flux")
    return K.window_sweep(f, driver_long(spark, d), WINDOWS, stats=("mean", "sum", "sd"), p=True)


@query()
def prediction_grid(spark, d):
    li = table(spark, d, "lineitem")
    des = M.design(li, ["l_quantity*l_discount*l_returnflag"], ["l_returnflag"])
    return M.prediction_grid(li, M.ols(li, "l_extendedprice", des), des, "l_quantity", "l_discount", "l_returnflag")


@query()
def pca_scores(spark, d):
    return M.pca_by_group_norm(_metrics(spark, d), "vec_id", ["label"], [f"d{i}" for i in range(8)], "d0")[0]


@query("with m as (select vec_id, label, embedding[1]::double as a, embedding[2]::double as b from embeddings), z as (select *, (b - avg(b) over w) / nullif(stddev_samp(b) over w, 0) as z from m window w as (partition by label)) select vec_id, round(z, 6) as cv_z, case when a <= 0 and z <= 0 then 'I: Sound' when a <= 0 and z > 0 then 'II: Incipient' when a > 0 and z > 0 then 'III: Active' when a > 0 and z <= 0 then 'IV: Cavity' end as decay_phase from z")
def decay_phase(spark, d):
    return M.decay_phase(_metrics(spark, d), ["label"], "d0", "d1", 0.0).select("vec_id", "cv_z", "decay_phase")


_WIDE_H = "w as (select hour, avg(case when species = 'click' then reading end) as click, avg(case when species = 'view' then reading end) as view from flux group by hour)"


def _frame(spark, d):
    f = flux(spark, d)
    w = f.groupBy("hour").agg(*[F.avg(F.when(F.col("species") == s, F.col("reading"))).alias(s) for s in ("click", "view")])
    return M.model_frame(f.select("event_id", "hour", "flux"), w, "hour", "flux", ["click", "view"])


@query("with " + FLUX + ", " + _WIDE_H + ", j as (select event_id, flux, click, view from flux join w on flux.hour = w.hour where click is not null and view is not null) select event_id, round(flux, 6) as flux, round((click - avg(click) over ()) / stddev_samp(click) over (), 6) as click, round((view - avg(view) over ()) / stddev_samp(view) over (), 6) as view from j")
def model_frame(spark, d):
    return _frame(spark, d)[0].select("event_id", "flux", "click", "view")


@query("with " + FLUX + ", " + _WIDE_H + ", j as (select click, view from flux join w on flux.hour = w.hour where click is not null and view is not null) select 'click' as variable, round(avg(click), 6) as mean, round(stddev_samp(click), 6) as sd from j union all select 'view', round(avg(view), 6), round(stddev_samp(view), 6) from j")
def model_scales(spark, d):
    return _frame(spark, d)[1]


@query("with " + FLUX + ", s as (select tree, count(*) as n from flux where species = 'signup' group by 1), p as (select c_custkey as tree, case when c_custkey % 4 = 0 then null else c_acctbal end as depth from customer) select coalesce(s.tree, p.tree) as tree, coalesce(n, 0) as n, round(depth, 6) as depth, case when p.tree is null then 'no depth' when n is null then 'no reading' when depth is null then 'null depth' else 'ok' end as status from s full join p on s.tree = p.tree")
def depth_diagnostics(spark, d):
    c = table(spark, d, "customer")
    depths = c.select(F.col("c_custkey").alias("tree"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("depth"))
    return N.depth_diagnostics(flux(spark, d).where("species = 'signup'"), depths, "tree", "depth")


@query("with e as (select user_id as tree, user_id % 2 as g, avg(value) filter (where day(ts) <= 15) as a, avg(value) filter (where day(ts) > 15) as b from events group by 1) select g, round(case when count(*) filter (where a is not null and b is not null) >= 5 then corr(a, b) end, 6) as r, count(*) filter (where a is not null and b is not null) as n from e group by 1")
def period_consistency(spark, d):
    f = flux(spark, d).withColumn("half", F.when(F.dayofmonth("ts") <= 15, "a").otherwise("b"))
    wide = R.to_wide(f, ["tree"], "half", "value", ["a", "b"], agg=F.avg).withColumn("g", F.col("tree") % 2)
    return K.pearson(wide, ["g"], "a", "b", p=False)


@query()
def prediction_extremes(spark, d):
    return M.extremes(prediction_grid(spark, d), ["percentile", "l_returnflag"])


_FOREST = [f"d{i}" for i in range(1, 6)]


@query()
def forest_importance(spark, d):
    m, _, rows = M.forest(_metrics(spark, d), "d0", _FOREST, key="vec_id")
    return M.permutation_importance(m, rows, _FOREST, "vec_id")


@query()
def shapley(spark, d):
    m, _, rows = M.forest(_metrics(spark, d), "d0", _FOREST, key="vec_id")
    return M.shapley(m, rows, _FOREST, "vec_id")


@query()
def gamma_glm(spark, d):
    return M.gamma_glm(flux(spark, d), "value", ["site", "species"])


@query()
def repeatability(spark, d):
    return M.repeatability(flux(spark, d), "event_id", "tree", "reading")


from . import more  # noqa: E402, F401  registers its queries
from . import modelling, sweeps  # noqa: E402, F401  they register their queries
