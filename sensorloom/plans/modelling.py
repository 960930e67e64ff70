"""Queries of model selection, predictions by group and mixed Gamma models over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models as M
from .catalog import _metrics, _model_rows, query
from .views import FLUX, flux, table

# --- predictions by group: z has two values, so x * z is a line at either, with one residual variance
_PROBS = [k / 10 for k in range(1, 10)]
_BY_GROUP = (
    "with " + FLUX + """, d as (select site, ln(value + 0.01) as y, hour(ts)::double as x, (event_id % 3 = 0)::int::double as z from flux where value + 0.01 > 0),
l as (select site, z, count(*) as n, regr_slope(y, x) as b, regr_intercept(y, x) as a, avg(x) as mx, regr_sxx(y, x) as sxx, regr_syy(y, x) * (1 - coalesce(regr_r2(y, x), 1)) as rss from d group by 1, 2),
s as (select site, sum(n) as n, sum(rss) / (sum(n) - 4) as s2 from l group by 1 having sum(n) >= 30),
q as (select site, """ + ", ".join(f"quantile_cont(z, {p}) as z{i}" for i, p in enumerate(_PROBS)) + """ from d group by 1),
bands as (""" + " union all ".join(f"select site, {p}::double as p, z{i} as z, {f'(z{i - 1} + z{i}) / 2' if i else '-1e9'} as lo, {f'(z{i} + z{i + 1}) / 2' if i < 8 else '1e9'} as hi from q" for i, p in enumerate(_PROBS)) + """),
r as (select b.site, b.p, b.z, count(*) filter (where d.z between lo and hi) as k, quantile_cont(x, 0.05) filter (where d.z between lo and hi) as a1, quantile_cont(x, 0.95) filter (where d.z between lo and hi) as b1, quantile_cont(x, 0.05) as a0, quantile_cont(x, 0.95) as b0 from bands b join d using (site) group by 1, 2, 3),
g as (select site, p, z, step, case when k < 10 then a0 else a1 end + (case when k < 10 then b0 - a0 else b1 - a1 end) * step / 99 as x from r cross join (select unnest(range(100)) as step)),
f as (select g.site, g.p, g.step, g.x, g.z, s.n, (1 - g.z) * (l0.a + l0.b * g.x) + g.z * (l1.a + l1.b * g.x) as fit,
 sqrt(s.s2 * ((1 - g.z) ** 2 * (1.0 / l0.n + (g.x - l0.mx) ** 2 / l0.sxx) + g.z ** 2 * (1.0 / l1.n + (g.x - l1.mx) ** 2 / l1.sxx))) as se
 from g join s using (site) join l l0 on l0.site = g.site and l0.z = 0 join l l1 on l1.site = g.site and l1.z = 1)
select site, p as percentile, step::int as step, round(x, 5) as hour_of_day, round(z, 5) as third, n::bigint as n, round(fit, 5) as log_fit, round(se, 5) as log_se, round(exp(fit) - 0.01, 5) as fit, round(exp(fit - 1.96 * se) - 0.01, 5) as lower, round(exp(fit + 1.96 * se) - 0.01, 5) as upper from f"""
)


@query(_BY_GROUP, 5)
def fit_by_group(spark, d):
    f = flux(spark, d).withColumn("hour_of_day", F.hour("ts").cast("double")).withColumn("third", (F.col("event_id") % 3 == 0).cast("double"))
    return M.fit_by_group(f, ["site"], "value", "hour_of_day", "third")


@query()
def fit_by_group_covariates(spark, d):
    """Both covariates with many values."""
    li = table(spark, d, "lineitem")
    return M.fit_by_group(li, ["l_returnflag", "l_linestatus"], "l_extendedprice", "l_quantity", "l_discount")


@query()
def predictions_back(spark, d):
    """Predictions of a mixed model of asinh(flux), put back by sinh."""
    f = _model_rows(spark, d).withColumn("response", F.asinh("flux"))
    des = M.design(f, ["hour_of_day*lagged*site"], ["site"])
    m = M.lmm(f, "response", des, "tree", reml=False)
    return M.back_transform(M.prediction_grid(f, m, des, "hour_of_day", "lagged", "site"), F.sinh)


# --- selection from one aggregate


@query()
def forward_select_mixed(spark, d):
    """By the marginal R2 of the model with a random intercept; species stays in."""
    return M.forward_select(_wide(spark, d), "value", ["species"], _CANDIDATES, group="tree", factors=["species"])


@query()
def selection_frequency_mixed(spark, d):
    return M.selection_frequency(_wide(spark, d), "event_id", "value", ["species"], _CANDIDATES, steps=3, runs=20, group="tree", factors=["species"])


@query()
def bic_step(spark, d):
    return M.bic_step(_wide(spark, d), "value", ["hour_of_day*site"], ["minute", "weekday", "lagged"], "tree", "site", ["site"])[0]


@query()
def drop_collinear(spark, d):
    f = _wide(spark, d).withColumn("twice", 2 * F.col("hour_of_day") + F.col("minute") / 60)
    return M.drop_collinear(f, "value", ["hour_of_day", "minute", "twice", "weekday", "species"], "tree", ["species"], keep=["hour_of_day", "species"])[0]


@query()
def asinh_mixed(spark, d):
    """The refit of the mixed model on asinh of the response."""
    f = _model_rows(spark, d).withColumn("response", F.asinh(F.col("flux") * 1000))
    return M.lmm(f, "response", M.design(f, ["hour_of_day*site"], ["site"]), "tree", reml=False).coefficients(spark)


@query()
def gamma_mixed(spark, d):
    return _gamma(spark, d)[0]


@query()
def gamma_mixed_summary(spark, d):
    return _gamma(spark, d)[1]


@query()
def marginal_contrasts(spark, d):
    f = flux(spark, d)
    des = M.design(f, ["species*site"], ["species", "site"])
    return M.emmeans(spark, M.lmm(f, "value", des, "tree"), des, "species", "site")[1]


@query()
def pca_loadings(spark, d):
    return M.pca_by_group_norm(_metrics(spark, d), "vec_id", ["label"], [f"d{i}" for i in range(8)], "d0")[1]


_CANDIDATES = ["hour_of_day", "minute", "weekday", "lagged"]


def _wide(spark, d):
    return _model_rows(spark, d).withColumns({"minute": F.minute("ts").cast("double"), "weekday": F.weekday("ts").cast("double")})


def _gamma(spark, d):
    f = flux(spark, d).withColumn("day", F.to_date("ts"))
    return M.gamma_mixed(f, "value", ["site", "species"], "day")
