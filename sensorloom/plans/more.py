"""Further queries over the driver tables: scalar functions, operators on traces and logs, p-values; with their SQL."""

from __future__ import annotations

import pandas as pd
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
from .catalog import _BEST, _MDF, _PASS, _SWEEP, ORACLE_SQL, SOME_WINDOWS, WINDOWS, _best, _halves, _mdf, query
from .views import FLUX, LONG, SPECIES, driver_long, flux, table


def p_sql(r: str, n: str) -> str:
    """Two-sided p of a correlation by the finite series of Student's t with whole degrees of freedom."""
    even = f"abs({r}) * list_sum(list_transform(range(0, ({n} - 2) // 2), lambda k: exp(lgamma(k + 0.5::double) - lgamma(k + 1.0::double) - 0.5 * ln(pi()) + k * ln(1 - {r} * {r}))))"
    odd = f"2 / pi() * (asin(abs({r})) + abs({r}) * sqrt(1 - {r} * {r}) * coalesce(list_sum(list_transform(range(0, ({n} - 3) // 2), lambda k: exp(0.5 * ln(pi()) + lgamma(k + 1.0::double) - ln(2) - lgamma(k + 1.5::double) + k * ln(1 - {r} * {r})))), 0))"
    return f"case when {r} is null or {n} < 3 then null when abs({r}) >= 1 then 0.0 when {n} % 2 = 0 then greatest(1 - {even}, 0) else greatest(1 - {odd}, 0) end"


# --- columns --------------------------------------------------------------------------------


@query("select l_orderkey, l_linenumber, case when l_discount not in (0.05, 0.0) then round(l_discount, 6) end as l_discount, case when l_tax not in (0.05, 0.0) then round(l_tax, 6) end as l_tax from lineitem")
def null_sentinels(spark, d):
    return S.null_sentinels(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax"), ["l_discount", "l_tax"], (0.05, 0.0))


@query("with e as (select event_id, date_trunc('second', ts) as a, date_trunc('second', ts)::time as t, (date_trunc('second', ts) + to_seconds(event_id * 37 % 2400))::time as u from events) select event_id, (a::date + t)::timestamp as start_ts, (a::date + u)::timestamp as end_ts, date_diff('second', a::date + t, a::date + u) as seconds from e where date_diff('second', a::date + t, a::date + u) > 30 and date_diff('second', a::date + t, a::date + u) < 1800")
def build_intervals(spark, d):
    e = table(spark, d, "events")
    later = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("event_id") * 37 % 2400)
    e = e.select("event_id", F.col("ts").cast("date").alias("date"), F.date_format("ts", "HH:mm:ss").alias("a"), F.date_format(later, "HH:mm:ss").alias("b"))
    return S.build_intervals(e, "date", "a", "b").select("event_id", "start_ts", "end_ts", "seconds")


@query("select event_id, date_trunc('second', ts)::timestamp as with_zone, date_trunc('millisecond', ts)::timestamp as fraction, ts::date::timestamp as day from events")
def parse_iso(spark, d):
    e, text = table(spark, d, "events"), lambda p: F.date_format("ts", p)
    return e.select("event_id", S.parse_iso(F.concat(text("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).alias("with_zone"), S.parse_iso(text("yyyy-MM-dd HH:mm:ss.SSS")).alias("fraction"), S.parse_iso(text("yyyy-MM-dd")).alias("day"))


@query("select event_id, (date_trunc('week', ts + interval 1 day) - interval 1 day)::timestamp as sunday, date_trunc('hour', ts + interval 30 minute)::timestamp as nearest_hour, (ts - interval 5 hour - interval 90 second)::timestamp as shifted from events")
def clock_times(spark, d):
    return table(spark, d, "events").select("event_id", S.floor_time("ts", "week", "sunday").alias("sunday"), S.round_time("ts").alias("nearest_hour"), S.shift_clock("ts", -5, -90).alias("shifted"))


@query("select l_shipdate as datetime, round(l_quantity, 6) as quantity_li, round(l_extendedprice, 6) as price_li from lineitem where year(l_shipdate) between 1996 and 1997")
def extract_vars(spark, d):
    li = table(spark, d, "lineitem").withColumnRenamed("l_shipdate", "datetime")
    return S.extract_vars(li, {"quantity": "l_quantity", "lost": "no_such_column", "price": "l_extendedprice"}, "_li", (1996, 1997))


@query("select l_orderkey, l_linenumber, round(l_discount, 6) as l_discount from lineitem")
def match_cols(spark, d):
    li = table(spark, d, "lineitem").withColumn("l_disc_PI", F.lit(1))
    return li.select("l_orderkey", "l_linenumber", *S.match_cols(li, "l_disc"))


@query("select p_partkey, case p_size % 4 when 0 then 'LGR' when 1 then 'LGR' when 2 then upper(replace(p_brand, ' ', '')) else 'LGR' end as machine, strftime(timestamp '2024-01-01' + to_seconds(p_size * 61), '%H:%M:%S') as time_of_day, case when p_size % 2 = 0 then p_type else p_name end as preferred from part")
def text_scalars(spark, d):
    p, k = table(spark, d, "part"), F.col("p_size") % 4
    raw = F.when(k == 0, F.concat(F.lit(" lgr #"), F.col("p_size"))).when(k == 1, F.concat(F.lit("LGR"), F.col("p_size"))).when(k == 2, F.col("p_brand")).otherwise("  ")
    clock = F.concat(F.lit("1899-12-31 "), F.date_format(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("p_size") * 61), "HH:mm:ss"))
    over = F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.lit("  "))
    return p.select("p_partkey", S.normalize_machine(raw).alias("machine"), S.strip_date(clock).alias("time_of_day"), S.prefer("p_name", over).alias("preferred"))


@query("select event_id, event_type || '_ha' as base, case when value > 40 then 'raw' else 'anomaly' end as mode, (event_id % 336)::int as hours from events")
def parse_feature_name(spark, d):
    e = table(spark, d, "events")
    name = F.concat(F.col("event_type"), F.lit("_ha_"), F.when(F.col("value") > 40, "raw").otherwise("anomaly"), F.lit("_"), F.col("event_id") % 336, F.lit("h"))
    return e.select("event_id", S.parse_feature_name(name).alias("f")).select("event_id", "f.*")


@query("select c_custkey, case c_nationkey when 2 then 'north' when 19 then 'south' else c_mktsegment end as c_mktsegment from customer")
def override(spark, d):
    return S.override(table(spark, d, "customer"), "c_nationkey", "c_mktsegment", {2: "north", 19: "south"}).select("c_custkey", "c_mktsegment")


@query("select c_custkey, round(c_acctbal, 6) as there, null::double as nowhere from customer")
def first_existing(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", S.first_existing(c, ["gcc_mean", "c_acctbal"]).alias("there"), S.first_existing(c, ["gcc_mean", "gcc_90"]).alias("nowhere"))


@query("with p as (select event_id, (event_id * 37 % 1000 + 1) / 10000.0 as p from events) select event_id, case when p < 0.001 then '***' when p < 0.01 then '**' when p < 0.05 then '*' else '' end as stars from p")
def stars(spark, d):
    return table(spark, d, "events").select("event_id", S.stars((F.col("event_id") * 37 % 1000 + 1) / 10000.0).alias("stars"))


_DL = "dl as (select d.doc_id, d.lang, l.quality, l.toxic, null::int as nothing from documents d left join labels l on d.doc_id = l.doc_id)"


def _doc_labels(spark, d):
    return J.left_lookup(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), "doc_id", "doc_id").withColumn("nothing", F.lit(None).cast("int"))


@query("with " + _DL + " select doc_id, 'strict' as form from dl where toxic = 0 union all select doc_id, 'lenient' from dl where toxic = 0 or toxic is null")
def qc_pass(spark, d):
    dl = _doc_labels(spark, d)
    return S.qc_pass(dl, "toxic").select("doc_id", F.lit("strict").alias("form")).unionByName(S.qc_pass(dl, "toxic", lenient=True).select("doc_id", F.lit("lenient").alias("form")))


@query("with " + _DL + " select doc_id, lang, quality, toxic from dl")
def drop_sparse(spark, d):
    return S.drop_sparse(_doc_labels(spark, d), min_n=10)


@query("select l_orderkey, l_linenumber, round(l_quantity * 2, 6) as l_quantity, round(l_tax * 2, 6) as l_tax from lineitem")
def map_columns(spark, d):
    return S.map_columns(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"), ["l_quantity", "l_tax"], lambda c: c * 2)


# --- reshaping, aggregates and windows ------------------------------------------------------


@query("with " + FLUX + " select hour, " + ", ".join(f"round(avg(reading) filter (where species = '{s}'), 6) as vwc_{s}" for s in SPECIES) + " from flux group by 1")
def wide_mean(spark, d):
    return R.wide_mean(flux(spark, d), ["hour"], "species", "reading", SPECIES, "vwc_")


@query("select vec_id, label, 'd' || i as metric, round(embedding[i + 1]::double, 6) as value from embeddings, range(0, 4) t(i)")
def metrics_long(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"d{i}") for i in range(4)])
    return R.metrics_long(e, ["vec_id", "label"], [f"d{i}" for i in range(4)])


@query("select label, 'd' || i as metric, round(avg(embedding[i + 1]::double), 6) as mean, count(*) as n from embeddings, range(0, 4) t(i) group by 1, 2")
def metric_summary(spark, d):
    e = table(spark, d, "embeddings").select("label", *[F.col("embedding")[i].cast("double").alias(f"d{i}") for i in range(4)])
    return A.metric_summary(e, ["label"], [f"d{i}" for i in range(4)])


@query("with p as (select event_type, case when value <= 60 then (event_id * 37 % 1000 + 1) / 1000.0 end as p from events) select event_type, count(p) as n, round(100.0 * avg(case when p < 0.05 then 1 when p is not null then 0 end), 6) as pct_significant from p group by 1")
def pct_significant(spark, d):
    e = table(spark, d, "events")
    return A.pct_significant(e.select("event_type", F.when(F.col("value") <= 60, (F.col("event_id") * 37 % 1000 + 1) / 1000.0).alias("p")), ["event_type"], "p")


@query("select c_nationkey, c_mktsegment, round(avg(c_acctbal), 6) as c_acctbal, min(c_name) as c_name from customer group by 1, 2")
def average_predictions(spark, d):
    return A.average_predictions(table(spark, d, "customer"), ["c_nationkey", "c_mktsegment"], "c_acctbal", ["c_name"])


@query("with " + FLUX + " select tree, event_id, round(value, 6) as value from (select *, row_number() over (partition by tree order by value desc, event_id) as k from flux) where k <= 3")
def head_by(spark, d):
    return W.head_by(flux(spark, d), ["tree"], [F.desc("value"), F.asc("event_id")], 3).select("tree", "event_id", "value")


@query("with " + FLUX + " select tree, species, event_id from (select *, row_number() over (partition by tree, species order by ts, event_id) as k from flux) where k = 1")
def first_per(spark, d):
    return W.first_per(flux(spark, d), ["tree", "species"], [F.asc("ts"), F.asc("event_id")]).select("tree", "species", "event_id")


@query("select o_orderkey, o_orderpriority, round(o_totalprice, 6) as o_totalprice from orders order by o_orderpriority, o_totalprice desc, o_orderkey")
def ordered_rows(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey")


@query("with " + FLUX + ", g as (select tree, count(*) as n, avg(value) as m from flux group by 1) select tree, n, round(m, 4) as mean from g", 4)
def apply_by(spark, d):
    return A.apply_by(flux(spark, d).select("tree", "value"), ["tree"], lambda p: pd.DataFrame({"tree": [p["tree"].iloc[0]], "n": [len(p)], "mean": [p["value"].mean()]}), "tree bigint, n bigint, mean double")


# --- sensors and traces ---------------------------------------------------------------------

_WIDE_TS = "wide as (select strftime(hour, '%Y%m%d%H%M')::bigint as ts12, hour as datetime, " + ", ".join(f"coalesce(avg(reading) filter (where species = '{s}'), -9999) as TS_{i}" for i, s in enumerate(SPECIES)) + " from flux group by hour)"


def _wide_ts(spark, d):
    f = flux(spark, d).groupBy("hour").agg(*[F.coalesce(F.avg(F.when(F.col("species") == s, F.col("reading"))), F.lit(-9999.0)).alias(f"TS_{i}") for i, s in enumerate(SPECIES)])
    return f.select(F.date_format("hour", "yyyyMMddHHmm").cast("bigint").alias("TIMESTAMP_START"), "TS_0", "TS_1", "TS_2", "TS_3", "TS_4", F.lit(1.0).alias("TS_PI_9"), F.lit(2.0).alias("WS_1"))


_TS_LONG = _WIDE_TS + ", lg as (" + " union all ".join(f"select datetime, 'TS_{i}' as sensor, TS_{i} as value from wide where TS_{i} <> -9999" for i in range(len(SPECIES))) + ")"


@query("with " + FLUX + ", " + _TS_LONG + " select datetime, sensor, round(value, 6) as value from lg where year(datetime) between 2024 and 2024")
def sensor_long_wide(spark, d):
    return N.sensor_long(_wide_ts(spark, d), r"TS($|_)", years=(2024, 2024))


@query("with " + FLUX + ", " + _TS_LONG + """, tw as (select 'TS_A' as series, * from lg union all select 'TS_B', datetime, sensor, value * 2 from lg),
b as (select series, sensor, median(value) as b from tw where datetime < timestamp '2024-01-16' group by 1, 2), g as (select series, avg(b) as g from b group by 1),
m as (select tw.series, datetime, avg(value - b) + any_value(g) as v from tw join b on tw.series = b.series and tw.sensor = b.sensor join g on g.series = tw.series group by 1, 2 having count(distinct tw.sensor) >= 2)
select datetime, round(max(v) filter (where series = 'TS_A'), 6) as TS_A, round(max(v) filter (where series = 'TS_B'), 6) as TS_B from m group by 1""")
def towers_hourly(spark, d):
    a = _wide_ts(spark, d)
    b = a.withColumns({f"TS_{i}": F.when(F.col(f"TS_{i}") == -9999, F.col(f"TS_{i}")).otherwise(F.col(f"TS_{i}") * 2) for i in range(5)})
    return N.towers_hourly({"A": a, "B": b}, {"TS": r"TS($|_)"}, "2024-01-01", "2024-01-16", min_sensors=2)


@query("with " + FLUX + " select ts as datetime, round(avg(value), 6) as value from flux group by 1")
def product_series(spark, d):
    f = flux(spark, d).select(F.col("ts").alias("endDateTime"), F.col("value").alias("VSWCMean"), F.lit(0).alias("VSWCFinalQF"))
    return N.product_series(f, ["soilMean", "VSWC.*Mean"])


@query("with " + FLUX + " select f.event_id, f.tree, f.species, round(c.c_acctbal, 6) as depth from flux f left join customer c on f.tree = c.c_custkey and f.species = case c.c_mktsegment when 'BUILDING' then 'click' when 'MACHINERY' then 'view' else 'error' end")
def attach_depth(spark, d):
    c = table(spark, d, "customer")
    species = F.when(F.col("c_mktsegment") == "BUILDING", "click").when(F.col("c_mktsegment") == "MACHINERY", "view").otherwise("error")
    return N.attach_depth(flux(spark, d), c.select(F.col("c_custkey").alias("tree"), species.alias("species"), F.col("c_acctbal").alias("depth")), ["tree", "species"]).select("event_id", "tree", "species", "depth")


_TRACES = "tr as (select event_id, case when user_id % 2 = 0 then 'LGR' else 'LI-7810' end as machine, ts::date as day, 'f' || user_id || '-' || strftime(ts, '%Y%m%d') as file, ts, event_id as line, event_type as REMARK, strftime(ts, '%Y-%m-%d') as DATE, value as CO2, case when event_id % 7 <> 0 then value / 1000 end as CH4 from events)"
_LOGS = "lo as (select event_id as UniqueID, case when user_id % 3 = 0 then 'LGR' when user_id % 3 = 1 then 'LI-7810' else 'NONE' end as machine, ts::date as day, ts as start_ts, ts + interval 90 minute as end_ts from events where event_type = 'signup')"
_ASSIGNED = _TRACES + ", " + _LOGS + """, seen as (select distinct machine, day from tr), asg as (
select tr.*, lo.UniqueID from tr join lo on tr.machine = lo.machine and tr.day = lo.day and tr.ts between lo.start_ts and lo.end_ts
union all select tr.*, lo.UniqueID from tr join lo on tr.day = lo.day and tr.ts between lo.start_ts and lo.end_ts where not exists (select 1 from seen where seen.machine = lo.machine and seen.day = lo.day))"""


def _traces(spark, d):
    e = table(spark, d, "events")
    return e.select(
        "event_id",
        F.when(F.col("user_id") % 2 == 0, "LGR").otherwise("LI-7810").alias("machine"),
        F.col("ts").cast("date").alias("day"),
        F.concat(F.lit("f"), F.col("user_id"), F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("file"),
        "ts",
        F.col("event_id").alias("line"),
        F.col("event_type").alias("REMARK"),
        F.date_format("ts", "yyyy-MM-dd").alias("DATE"),
        F.col("value").alias("CO2"),
        F.when(F.col("event_id") % 7 != 0, F.col("value") / 1000).alias("CH4"),
    )


def _logs(spark, d):
    e, k = table(spark, d, "events").where("event_type = 'signup'"), F.col("user_id") % 3
    return e.select(F.col("event_id").alias("UniqueID"), F.when(k == 0, "LGR").when(k == 1, "LI-7810").otherwise("NONE").alias("machine"), F.col("ts").cast("date").alias("day"), F.col("ts").alias("start_ts"), (F.col("ts") + F.expr("interval 90 minutes")).alias("end_ts"))


@query("with " + _ASSIGNED + " select event_id, UniqueID from asg")
def assign_with_fallback(spark, d):
    return J.assign_with_fallback(_traces(spark, d), _logs(spark, d), "machine", "day").select("event_id", "UniqueID")


def _allan_sql(table_: str, by: str, col: str) -> str:
    return f"select {by}, case when count(d) >= 2 then stddev_samp(d) / sqrt(2) end as s from (select {by}, {col} - lag({col}) over (partition by {by} order by ts, line) as d from {table_} where {col} is not null) group by {by}"


@query("with " + _TRACES + f", n as (select file, count(*) as n, first(REMARK order by ts, line) as remark, first(DATE order by ts, line) as date from tr group by 1 having count(*) >= 5), a as ({_allan_sql('tr', 'file', 'CO2')}), b as ({_allan_sql('tr', 'file', 'CH4')}) select n.file, n.n, round(a.s, 6) as allan_sd_CO2, round(b.s, 6) as allan_sd_CH4, remark, date, remark || '_' || date as key from n left join a on n.file = a.file left join b on n.file = b.file")
def allan_by_file(spark, d):
    return Q.allan_by_file(_traces(spark, d).withColumn("file", F.regexp_replace("file", "-.*", "")).withColumn("file", F.concat_ws("-", "file", F.date_format("ts", "yyyyMMdd"))))


_BY_INTERVAL = _ASSIGNED.replace("from tr join", "from trs tr join").replace(", seen as (select distinct machine, day from tr)", ", trs as (select * replace (CH4 * 1000 as CH4) from tr where (machine, day) in (select (machine, day) from tr group by machine, day having count(*) >= 10)), seen as (select distinct machine, day from trs)")


@query("with " + _BY_INTERVAL + f", n as (select UniqueID, count(*) as n from asg group by 1 having count(*) >= 5), a as ({_allan_sql('asg', 'UniqueID', 'CO2')}), b as ({_allan_sql('asg', 'UniqueID', 'CH4')}) select n.UniqueID, n.n, round(a.s, 6) as allan_sd_CO2, round(b.s, 6) as allan_sd_CH4 from n left join a on n.UniqueID = a.UniqueID left join b on n.UniqueID = b.UniqueID")
def allan_by_interval(spark, d):
    return Q.allan_by_interval(_traces(spark, d), _logs(spark, d), date="day", order=["line"])


_ATTACH = """fx as (select event_id, 'k' || user_id as file_key, ts::date as day, ts from events where event_type = 'purchase'),
bf as (select 'k' || c_custkey as file_key, c_acctbal as allan from customer where c_mktsegment = 'BUILDING'),
bi as (select event_id + 1 as event_id, ts::date as day, ts as start_ts, value as allan from events where event_type = 'signup'),
nr as (select fx.event_id, bi.allan, row_number() over (partition by fx.event_id order by abs(date_diff('microsecond', fx.ts, bi.start_ts)), bi.event_id) as k from fx join bi on fx.day = bi.day and abs(date_diff('microsecond', fx.ts, bi.start_ts)) <= 600000000)"""


@query("with " + _ATTACH + " select fx.event_id, round(coalesce(bf.allan, i.allan, nr.allan), 6) as allan, case when bf.allan is not null then 'file' when i.allan is not null then 'interval' when nr.allan is not null then 'nearest' end as allan_from from fx left join bf on fx.file_key = bf.file_key left join bi i on fx.event_id = i.event_id left join nr on fx.event_id = nr.event_id and nr.k = 1")
def attach_allan(spark, d):
    e = table(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    fx = e.where("event_type = 'purchase'").select("event_id", F.concat(F.lit("k"), F.col("user_id")).alias("file_key"), "day", "ts")
    bf = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("k"), F.col("c_custkey")).alias("file_key"), F.col("c_acctbal").alias("allan"))
    bi = e.where("event_type = 'signup'").select((F.col("event_id") + 1).alias("event_id"), "day", F.col("ts").alias("start_ts"), F.col("value").alias("allan"))
    return Q.attach_allan(fx, bf, bi, ["allan"], "event_id", "file_key", "ts", "start_ts", "day", tolerance_s=600).select("event_id", "allan", "allan_from")


# --- p-values -------------------------------------------------------------------------------


@query("with " + FLUX + ", c as (select site, species, case when count(reading) >= 5 then corr(reading, tree) end as r, count(reading) as n from flux group by 1, 2) select site, species, round(r, 6) as r, n, round(" + p_sql("r", "n") + ", 6) as p from c")
def pearson_p(spark, d):
    return K.pearson(flux(spark, d).withColumn("tree", F.col("tree").cast("double")), ["site", "species"], "reading", "tree")


@query("with e as (select user_id, avg(value) filter (where ts < timestamp '2024-01-16') as a, avg(value) filter (where ts >= timestamp '2024-01-16') as b, user_id % 2 as g from events group by user_id), r as (select g, rank() over (partition by g order by a desc) + (count(*) over (partition by g, a) - 1) / 2.0 as ra, rank() over (partition by g order by b desc) + (count(*) over (partition by g, b) - 1) / 2.0 as rb from e where a is not null and b is not null), c as (select g, corr(ra, rb) as r, count(*) as n from r group by g) select g, round(r, 6) as r, n, round(" + p_sql("r", "n") + ", 6) as p from c")
def spearman_p(spark, d):
    return K.spearman(_halves(spark, d), ["g"], "a", "b")


@query("with " + FLUX + ", g as (select species, count(reading) as n, avg(reading) as m, coalesce(var_samp(reading) * (count(reading) - 1), 0) as w from flux where reading is not null group by 1), o as (select count(*) as k, sum(n) as n, sum(w) as w, sum(n * m * m) - sum(n * m) ** 2 / sum(n) as b from g), s as (select k - 1 as d1, (n - k)::double as d2, (b / (k - 1)) / (w / (n - k)) as f from o) select round(f, 6) as f, round(power(d2 / (d2 + d1 * f), d2 / 2) * (1 + d2 / 2 * d1 * f / (d2 + d1 * f)), 6) as p from s")
def anova_p(spark, d):
    """Five species have four degrees of freedom, whose tail is two terms."""
    return K.anova_oneway(flux(spark, d), "species", "reading").select("f", "p")


_ADJUSTED = _BEST + ", pv as (select *, " + p_sql("r", "n") + " as p from best), rk as (select *, row_number() over (partition by mode, site order by p, variable) as m, count(*) over (partition by mode, site) as k from pv), adj as (select *, least(1.0, min(p * k / m) over (partition by mode, site order by m desc rows between unbounded preceding and current row)) as p_adj from rk)"


ORACLE_SQL["best_windows_adjusted"] = "with " + _SWEEP + _ADJUSTED + ' select site, variable, mode, "window", \'mean\' as stat, round(r, 6) as r, n, round(p, 6) as p, round(p_adj, 6) as p_adj, p_adj < 0.05 as significant from adj'
ORACLE_SQL["significance_report"] = (
    "with " + _SWEEP + _ADJUSTED + """, sg as (select *, row_number() over (partition by mode, site order by abs(r) desc, variable) as k5 from adj where p_adj < 0.5)
select mode, site, count(*) as n, count(*) filter (where r > 0) as n_pos, count(*) filter (where r < 0) as n_neg, string_agg(variable, ',' order by variable) as names, string_agg(variable, ',' order by variable) filter (where k5 <= 5) as top, min("window") as min_window, quantile_cont("window"::double, 0.5) as median_window, max("window") as max_window from sg group by 1, 2"""
)


@query("with " + _SWEEP + _ADJUSTED + ", v as (select mode, variable, count(*) as sites, min(abs(r)) as weakest from adj where p_adj < 0.5 group by 1, 2 having count(*) = 2) select mode, variable, sites, round(weakest, 6) as weakest from v")
def shared_variables(spark, d):
    return K.shared_variables(_best(spark, d, p=True, alpha=0.5), ["mode"], "site", 2)


@query("with " + _SWEEP + _BEST + """, w as (select site, variable, max(r) filter (where mode = 'raw') as r_raw, max(r) filter (where mode = 'anomaly') as r_anomaly from best group by 1, 2), k as (select *, r_anomaly - r_raw as delta_r, sign(r_raw) = sign(r_anomaly) as same_sign, row_number() over (partition by site order by abs(r_anomaly - r_raw) desc, variable) as place from w)
select site, variable, round(r_raw, 6) as r_raw, round(r_anomaly, 6) as r_anomaly, round(delta_r, 6) as delta_r, same_sign from k where place <= 3""")
def largest_changes(spark, d):
    return K.largest_changes(K.compare_raw_anomaly(_best(spark, d), ["site"]), ["site"], 3)


_STAT = "select variable, datetime, {n} as win, avg(value) over w as mean, coalesce(sum(value) over w, 0) as sum, stddev_samp(value) over w as sd, row_number() over (partition by variable order by datetime) as k from long window w as (partition by variable order by datetime rows between {m} preceding and current row)"
_STATS = LONG + ", f3 as (" + " union all ".join(_STAT.format(n=n, m=n - 1) for n in WINDOWS) + "), u as (unpivot (select * from f3 where k >= win) on mean, sum, sd into name stat value feature)"
ORACLE_SQL["sweep_statistics"] = "with " + _STATS + ', c as (select site, variable, win as "window", stat, case when count(*) >= 5 then corr(flux, feature) end as r, count(*) as n from flux join u on flux.hour = u.datetime where feature is not null group by 1, 2, 3, 4), e as (select site, variable, win as "window", stat from (select distinct site from flux) cross join (select distinct variable, win, stat from u)) select e.site, e.variable, e."window"::int as "window", e.stat, round(r, 6) as r, coalesce(n, 0) as n, round(' + p_sql("r", "n") + ", 6) as p from e left join c on c.site = e.site and c.variable = e.variable and c.\"window\" = e.\"window\" and c.stat = e.stat"


# --- models ---------------------------------------------------------------------------------

_ROLL5 = LONG + ", rl as (" + " union all ".join(f"select variable, datetime, {n} as win, avg(value) over w as mean, row_number() over (partition by variable order by datetime) as k from long window w as (partition by variable order by datetime rows between {n - 1} preceding and current row)" for n in SOME_WINDOWS) + "), ft as (select event_id, flux.flux, variable, win, mean from flux join rl on flux.hour = rl.datetime where k >= win)"
ORACLE_SQL["feature_matrix"] = "with " + _ROLL5 + " select event_id, " + ", ".join(f"round(max(mean) filter (where variable = '{v}' and win = {n}), 6) as {v}_raw_{n}h" for v in ("click", "view") for n in (6, 24)) + " from ft where variable in ('click', 'view') and win in (6, 24) group by 1"
ORACLE_SQL["window_grid"] = (
    "with " + _ROLL5 + """, j as (select a.win as w1, b.win as w2, a.mean as x1, b.mean as x2, a.flux as y from ft a join ft b on a.event_id = b.event_id where a.variable = 'click' and b.variable = 'view' and a.mean is not null and b.mean is not null),
g as (select w1, w2, count(*) as n, var_pop(x1) as aa, var_pop(x2) as bb, covar_pop(x1, x2) as ab, covar_pop(x1, y) as ay, covar_pop(x2, y) as yb, var_pop(y) as yy from j group by 1, 2),
e as (select *, (bb * ay * ay + aa * yb * yb - 2 * ab * ay * yb) / (aa * bb - ab * ab) as ex from g)
select w1::int as w1, w2::int as w2, n, round(ex / yy, 6) as r2, round(n * (ln(2 * pi() * (yy - ex)) + 1) + 8, 6) as aic from e"""
)
_ROWS = FLUX + ", mr as (select *, hour(ts)::double as x, tree / 10.0 as z from flux)"
ORACLE_SQL["slopes_by_level"] = (
    "with " + _ROWS + """, g as (select species, count(*) as n, regr_slope(value, x) as b, regr_sxx(value, x) as sxx, regr_syy(value, x) - regr_sxy(value, x) ** 2 / regr_sxx(value, x) as sse from mr group by 1), s as (select sum(sse) / (sum(n) - 2 * count(*)) as s2 from g)
select 'hour_of_day' as variable, species as level, round(b, 6) as slope, round(sqrt(s2 / sxx), 6) as se from g cross join s"""
)
ORACLE_SQL["gvif"] = (
    "with " + _ROWS + """, m as (select species, avg(x) as mx, avg(z) as mz from mr group by 1), t as (select var_pop(x) as xx, var_pop(z) as zz, covar_pop(x, z) as xz from mr), w as (select avg((x - mx) ** 2) as xx, avg((z - mz) ** 2) as zz, avg((x - mx) * (z - mz)) as xz from mr join m on mr.species = m.species),
r as (select 'hour_of_day' as term, 1 as df, t.xx / (w.xx - w.xz ** 2 / w.zz) as g from t cross join w union all select 'lagged', 1, t.zz / (w.zz - w.xz ** 2 / w.xx) from t cross join w union all select 'species', 4, (t.xx * t.zz - t.xz ** 2) / (w.xx * w.zz - w.xz ** 2) from t cross join w)
select term, df::int as df, round(g, 6) as gvif, round(power(g, 1.0 / (2 * df)), 6) as scaled, power(g, 1.0 / df) > 5 as high from r"""
)


@query("with " + FLUX + ", h as (select tree, site, avg(reading) filter (where day(ts) <= 15) as a, avg(reading) filter (where day(ts) > 15) as b from flux group by 1, 2), e as (select site, (a + b) / 2 as m, (a - b) ** 2 / 2 as w from h where a is not null and b is not null), s as (select site, count(*) as k, 2 * var_samp(m) as msb, avg(w) as msw from e group by 1) select site, round(greatest((msb - msw) / 2, 0) / (greatest((msb - msw) / 2, 0) + case when msb > msw then msw else (msb * (k - 1) + msw * k) / (2 * k - 1) end), 4) as icc, (2 * k)::bigint as n, k::bigint as n_entities from s", 4)
def icc_balanced(spark, d):
    """Two half-month means of each tree: with equal numbers REML has a closed form."""
    f = flux(spark, d).withColumn("half", F.dayofmonth("ts") <= 15).groupBy("site", "tree", "half").agg(F.avg("reading").alias("v")).where("v is not null")
    both = f.groupBy("site", "tree").count().where("count = 2").drop("count")
    out = M.icc(f.join(both, ["site", "tree"]), ["site"], "tree", "v")
    return out.select("site", "icc", F.col("n").cast("bigint").alias("n"), F.col("n_entities").cast("bigint").alias("n_entities"))


_GAMMA = FLUX + ", gm as (select site, species, ln(avg(value)) as l from flux where value > 0 group by 1, 2), a as (select l as l0 from gm where site = 'Upland' and species = 'click'), s as (select l as ls from gm where site = 'Wetland' and species = 'click'), t as (select '(Intercept)' as term, l0 as e from a union all select 'siteWetland', ls - l0 from a, s union all select 'species' || species, l - l0 from gm, a where site = 'Upland' and species <> 'click' union all select 'siteWetland:species' || g.species, g.l - u.l - ls + l0 from gm g join gm u on g.species = u.species and u.site = 'Upland', a, s where g.site = 'Wetland' and g.species <> 'click')"


@query("with " + _GAMMA + " select term, round(e, 4) as estimate, round(exp(e), 4) as fold from t", 4)
def gamma_means(spark, d):
    """Crossed factors leave a group for each mean, so the fit is the logarithms of group means."""
    return M.gamma_glm(flux(spark, d), "value", ["site", "species"])


@query("with " + FLUX + " select site, '(Intercept)' as term, round(regr_intercept(asinh(flux), hour(ts)), 6) as estimate, count(*) as n, round(regr_r2(asinh(flux), hour(ts)), 6) as r2 from flux group by 1 union all select site, 'hour_of_day', round(regr_slope(asinh(flux), hour(ts)), 6), count(*), round(regr_r2(asinh(flux), hour(ts)), 6) from flux group by 1")
def asinh_refit(spark, d):
    f = flux(spark, d).withColumn("hour_of_day", F.hour("ts").cast("double")).withColumn("response", F.asinh("flux"))
    return M.ols_by(f, "response", M.design(f, ["hour_of_day"]), ["site"]).select("site", "term", "estimate", "n", "r2")


@query("with " + LONG + ", rl as (select variable, datetime, value, avg(value) over (partition by variable order by datetime rows between 281 preceding and current row) as m, row_number() over (partition by variable order by datetime) as k from long) select event_id, round(max(rl.value) filter (where variable = 'click'), 6) as click_raw_1h, round(max(m) filter (where variable = 'view' and k >= 282), 6) as view_raw_282h from flux join rl on flux.hour = rl.datetime group by 1")
def forced_windows(spark, d):
    f = flux(spark, d).select("event_id", F.col("hour").alias("datetime"))
    return K.forced_features(f, driver_long(spark, d), {"click": 1, "view": 282}, "event_id")


_MET8 = "m as (select label, " + ", ".join(f"embedding[{i + 1}]::double as d{i}" for i in range(5)) + " from embeddings)"


@query(
    "with " + _MET8 + ", l as (" + " union all ".join(f"select 'd{i}' as metric, label, d{i} as v, d0 as y from m" for i in range(1, 5)) + "), c as (select metric, 'all' as label, case when count(*) >= 4 then corr(v, y) end as r, count(*) as n from l group by 1 union all select metric, label::varchar, case when count(*) >= 4 then corr(v, y) end, count(*) from l group by 1, 2), p as (select *, " + p_sql("r", "n") + " as p from c) select metric, label, round(r, 6) as r, n, round(r * r, 6) as r2, round(p, 6) as p, case when p < 0.001 then '***' when p < 0.01 then '**' when p < 0.05 then '*' when p is not null then '' end as stars from p"
)
def metric_correlations(spark, d):
    e = table(spark, d, "embeddings").select("label", *[F.col("embedding")[i].cast("double").alias(f"d{i}") for i in range(5)])
    return K.metric_correlations(e, [f"d{i}" for i in range(1, 5)], "d0", [[], ["label"]])


@query("with " + _MET8 + ", l as (" + " union all ".join(f"select 'd{i}' as metric, label, d{i} as v, d0 as y from m" for i in range(1, 5)) + ") select metric, " + ", ".join(f"round(corr(v, y) filter (where label = {k}), 6) as r_{k}, round(corr(v, y) filter (where label = {k}) ** 2, 6) as r2_{k}" for k in range(3)) + " from l group by 1")
def metric_correlations_wide(spark, d):
    return R.to_wide_multi(metric_correlations(spark, d).where("label in ('0', '1', '2')"), ["metric"], "label", ["0", "1", "2"], {"r": F.first("r"), "r2": F.first("r2")})


# --- quality tables -------------------------------------------------------------------------


@query("with " + _MDF + ", l as (" + " union all ".join(f"select instrument, '{k}' as filter, {v} as ok, flux as x from z" for k, v in _PASS.items()) + "), s as (select instrument, filter, count(*) filter (where ok) as n, 100.0 * count(*) filter (where ok) / count(*) as pct, avg(x) filter (where ok) as m from l group by 1, 2) select filter, " + ", ".join(f"max(n) filter (where instrument = '{i}') as \"n_pass_{i}\", round(max(pct) filter (where instrument = '{i}'), 6) as \"pct_pass_{i}\", round(max(m) filter (where instrument = '{i}'), 6) as \"mean_{i}\"" for i in ("LGR/UGGA", "LI-7810")) + " from s group by 1")
def filter_sensitivity_wide(spark, d):
    registry = {k: v for k, v in Q.filter_registry().items() if "Christiansen" not in k}
    return Q.filter_sensitivity_wide(_mdf(spark, d), registry, "instrument", list(Q.PRECISION))


@query("with " + _MDF + ", o as (select date_trunc('week', ts)::date as w from z group by 1 having count(distinct instrument) = 2) select date_trunc('week', ts)::date as period, instrument, count(*) as n, round(avg(flux), 6) as mean, round(quantile_cont(flux, 0.5), 6) as median, count(*) filter (where flux < 0) as n_neg, count(*) filter (where below_MDF) as n_below from z where date_trunc('week', ts)::date in (select w from o) group by 1, 2")
def overlap_periods(spark, d):
    return Q.overlap_breakdown(_mdf(spark, d), F.date_trunc("week", "ts").cast("date"), "instrument", 2)


@query("with " + _MDF + " select case when month(ts) in (11, 12, 1, 2, 3, 4) then 'Dormant (Nov-Apr)' else 'Growing (May-Oct)' end as period, instrument, count(*) as n, round(avg(flux), 6) as mean, round(quantile_cont(flux, 0.5), 6) as median, count(*) filter (where flux < 0) as n_neg, count(*) filter (where below_MDF) as n_below from z group by 1, 2")
def dormancy_breakdown(spark, d):
    return Q.period_breakdown(_mdf(spark, d), Q.dormancy(F.month("ts")), ["instrument"])


@query("with " + _MDF + " select instrument, date_trunc('week', ts)::date as week, round(quantile_cont(flux, 0.25), 6) as q25, round(quantile_cont(flux, 0.5), 6) as median, round(quantile_cont(flux, 0.75), 6) as q75, count(flux) as n, round(-quantile_cont(noise_floor, 0.5), 6) as noise_low, round(quantile_cont(noise_floor, 0.5), 6) as noise_high from z group by 1, 2")
def noise_envelope(spark, d):
    f = _mdf(spark, d).withColumn("week", F.date_trunc("week", "ts").cast("date"))
    return A.median_band(f, ["instrument", "week"], "flux", noise="noise_floor")
