"""Queries of sweep statistics with p, their summaries, feature names and the aligned table with replicates and daily sources; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import sensors as N
from ..operators import stats as K
from ..operators.numerics import t_pvalue
from .catalog import _SWEEP, ORACLE_SQL, WINDOWS, _mdf, _sweep, query
from .more import p_sql
from .views import FLUX, LONG, SPECIES, driver_long, flux, rounded_scaled, table

_STAT_WINDOWS = (3, 24, 72, 168)
_STATS = {"mean": "avg(value) over w", "sum": "coalesce(sum(value) over w, 0)", "sd": "stddev_samp(value) over w"}
_FEATURES = "f as (" + " union all ".join(
    f"select variable, datetime, {n} as win, '{s}' as stat, case when row_number() over (partition by variable order by datetime) >= {n} then {e} end as feature from long window w as (partition by variable order by datetime rows between {n - 1} preceding and current row)" for n in _STAT_WINDOWS for s, e in _STATS.items()
) + ")"
_STAT_SWEEP = "with " + LONG + ", " + _FEATURES + ', c as (select site, variable, win, stat, count(*) filter (where flux is not null and feature is not null) as n, corr(flux, feature) as r0 from flux join f on flux.hour = f.datetime where f.feature is not null group by 1, 2, 3, 4), r as (select site, variable, win as "window", stat, n, case when n >= 5 then r0 end as r from c), p as (select *, ' + p_sql("r", "n") + " as p from r)"


def _stat_sweep(spark, d):
    f = flux(spark, d).select(F.col("hour").alias("datetime"), "site", "flux")
    return K.flag_significant(K.window_sweep(f, driver_long(spark, d), _STAT_WINDOWS, stats=tuple(_STATS), p=True).where("n > 0"))


@query(_STAT_SWEEP + ' select site, variable, "window"::int as "window", stat, round(r, 5) as r, n, round(p, 5) as p, p < 0.05 as significant from p', 5)
def sweep_significance(spark, d):
    """Correlations with mean, sum and sd features, their p and whether it is under 0.05."""
    return _stat_sweep(spark, d)


@query(_STAT_SWEEP + " select case when variable in ('click', 'view') then 'use' else 'other' end as category, site, count(distinct variable) as n_variables, round(avg(abs(r)), 5) as mean_abs_r, round(max(abs(r)), 5) as max_abs_r, round(100 * avg((p < 0.05)::int), 5) as pct_significant from p group by 1, 2", 5)
def sweep_categories(spark, d):
    return K.category_summary(_stat_sweep(spark, d), F.when(F.col("variable").isin("click", "view"), "use").otherwise("other"))


@query("with " + _SWEEP + ', p as (select *, ' + p_sql("r", "n") + ' as p from sw) select site, mode, variable, "window"::int as "window", round(r, 5) as r, n, round(p, 5) as p, p < 0.05 as significant from p', 5)
def sweep_p(spark, d):
    """The whole sweep with p: 112 windows, both modes."""
    return K.flag_significant(_sweep(spark, d, p=True)).select("site", "mode", "variable", "window", "r", "n", "p", "significant")


@query("select event_id, case event_id % 4 when 0 then '15 cm' when 1 then '35 cm' when 2 then '50 cm' end as depth, case event_id % 3 when 0 then 'Site A' when 1 then 'Site B' end as site, case when event_id % 2 = 0 then (event_id % 336)::int end as hours from events")
def feature_attributes(spark, d):
    i = F.col("event_id")
    depth = F.when(i % 4 == 0, "_15cm").when(i % 4 == 1, "_35cm").when(i % 4 == 2, "_50cm").otherwise("")
    site = F.when(i % 3 == 0, "_a").when(i % 3 == 1, "_b").otherwise("")
    window = F.when(i % 2 == 0, F.concat(F.lit("_"), i % 336, F.lit("h"))).otherwise("")
    name = F.concat(F.lit("vwc"), depth, site, window)
    return table(spark, d, "events").select("event_id", S.feature_attributes(name).alias("f")).select("event_id", "f.*")


@query(
    "with " + FLUX + ", w as (select hour as datetime, " + ", ".join(f"avg(reading) filter (where species = '{s}') as {s}" for s in SPECIES) + """ from flux group by 1),
l as (select date_trunc('hour', l_shipdate)::timestamp as datetime, avg(l_quantity) as level_1, avg(l_extendedprice) / 1000 as level_2 from lineitem group by 1),
o as (select o_orderdate::date as day, avg(o_totalprice) as price from orders group by 1), s as (select l_shipdate::date as day, avg(l_discount) as discount from lineitem group by 1),
h as (select coalesce(w.datetime, l.datetime) as datetime, w.* exclude (datetime), l.level_1, l.level_2 from w full join l on w.datetime = l.datetime)
select h.datetime, """ + ", ".join(f"round({s}, 5) as {s}" for s in SPECIES) + """, round(level_1, 5) as level_1, round(level_2, 5) as level_2, round((coalesce(level_1, 0) + coalesce(level_2, 0)) / nullif((level_1 is not null)::int + (level_2 is not null)::int, 0), 5) as level, round(price, 5) as price, round(discount, 5) as discount,
 h.datetime::date as date, year(h.datetime)::int as year, month(h.datetime)::int as month, dayofyear(h.datetime)::int as doy, hour(h.datetime)::int as hour, CALENDAR
from h left join o on o.day = h.datetime::date left join s on s.day = h.datetime::date where year(h.datetime) between 1995 and 2024""".replace(
        "CALENDAR", ORACLE_SQL["aligned_hourly"].split("::int as hour, ", 1)[1].split(" from ", 1)[0].replace("datetime", "h.datetime")
    ),
    5,
)
def aligned_replicates(spark, d):
    """Replicate means over two level channels, and two daily sources spread over the hours of their days."""
    f = flux(spark, d).groupBy(F.col("hour").alias("datetime")).agg(*[F.avg(F.when(F.col("species") == s, F.col("reading"))).alias(s) for s in SPECIES])
    li = table(spark, d, "lineitem")
    # means are scaled, not readings: at a tie of the last digit the other order of the two rounds elsewhere
    level = li.groupBy(F.date_trunc("hour", "l_shipdate").cast("timestamp_ntz").alias("datetime")).agg(F.avg("l_quantity").alias("level_1"), (F.avg("l_extendedprice") / 1000).alias("level_2"))
    price = table(spark, d, "orders").select(F.col("o_orderdate").alias("date"), F.col("o_totalprice").alias("price"))
    discount = li.select(F.col("l_shipdate").alias("date"), F.col("l_discount").alias("discount"))
    return rounded_scaled(N.build_aligned([f, None, level], (1995, 2024), replicates={"level": r"level_\d"}, daily=[price, None, discount]), 5)


@query("select tree, 'ValueError: too few rows' as error from (select user_id as tree, count(*) as n from events group by 1) where n <= (select avg(n) from (select count(*) as n from events group by user_id))")
def failed_groups(spark, d):
    """Groups on which a function fails are rows with their error."""
    f = flux(spark, d).select("tree", "value")
    sizes = f.groupBy("tree").count()
    f = f.join(sizes, "tree").crossJoin(F.broadcast(sizes.agg(F.avg("count").alias("mean"))))

    def fit(pdf):
        if pdf["count"].iloc[0] <= pdf["mean"].iloc[0]:
            raise ValueError("too few rows")
        return pdf[["tree"]].head(1).assign(slope=float(pdf["value"].mean()))

    return A.apply_by_checked(f, ["tree"], fit, "tree bigint, slope double").failures


ORACLE_SQL["residual_screen"] = (
    "with " + LONG + ", m as (select regr_slope(flux, hour(ts)) as b, regr_intercept(flux, hour(ts)) as a from flux), res as (select site, hour, flux - a - b * hour(ts) as y from flux, m), wl as ("
    + " union all ".join(f"select variable, datetime, {n} as win, case when row_number() over (partition by variable order by datetime) >= {n} then avg(value) over (partition by variable order by datetime rows between {n - 1} preceding and current row) end as feature from long" for n in WINDOWS)
    + '), c as (select site, variable, win, count(y) as n, corr(y, feature) as r0 from res join wl on res.hour = wl.datetime where feature is not null group by 1, 2, 3), r as (select site, variable, win as "window", n, r0 as r from c where n >= 5 and r0 is not null), best as (select * from r qualify row_number() over (partition by site, variable order by round(abs(r), 9) desc, "window") = 1), p as (select *, ' + p_sql("r", "n")
    + ' as p from best), k as (select *, row_number() over (partition by site order by p, variable) as k, count(*) over (partition by site) as t from p), q as (select *, least(1.0, min(p * t / k) over (partition by site order by k desc rows between unbounded preceding and current row)) as p_adj from k)'
    + " select site, variable, \"window\"::int as \"window\", 'mean' as stat, round(r, 6) as r, n, round(p, 6) as p, round(p_adj, 6) as p_adj, p_adj < 0.05 as significant from q"
)


@query("with t as (select distinct greatest(60 + event_id % 240 - 2, 1)::int as df from events where event_id % 5 <> 0 union select 298) select df, level, p from t, (values ('90', 0.1::double), ('95', 0.05::double), ('99', 0.01::double)) as v(level, p)")
def christiansen_quantiles(spark, d):
    """Each limit over three noise floors is the t quantile of its duration: its two-sided p must be the level's."""
    z = _mdf(spark, d, chr_=True).where("noise_floor > 0")
    df = F.greatest(F.floor("t_sec_est") - 2, F.lit(1)).cast("int")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), (F.col(f"MDF_chr{k}") / (3 * F.col("noise_floor"))).alias("t")) for k in ("90", "95", "99")]))
    own = z.select(df.alias("df"), each.alias("v")).groupBy("df", "v.level").agg(F.avg("v.t").alias("t"))
    return own.select("df", "level", t_pvalue(F.col("t"), F.col("df")).alias("p"))
