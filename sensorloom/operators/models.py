"""Linear, mixed, generalised and forest models fitted on Spark aggregates.

The only passes over the data are aggregations of cross-products, by entity where a random
intercept is fitted; what reaches the driver is as large as the number of terms (or a grid of
variance ratios), never as the data.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from itertools import combinations
from operator import add, and_

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .fits import CrossProducts, Design, Model, cross_products, design, entity_products, gram, lmm, ols, ols_by, ols_from_gram, products_of_sizes, r_squared, sized_products, solve, square, values  # noqa: F401
from .lookups import lookup
from .numerics import Z95, chi2_p, t_p
from .quantiles import join_groups, summarise, summarise_where, with_group
from .shared import stored

#: Fixed value: half width of the limits of back-transformed predictions, in standard errors.
LIMIT = 1.96


def model_frame(measured: DataFrame, features: DataFrame, on: str, y: str, xs: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``(frame, scales)``: measurements with their features by hour, complete cases only, predictors standardised; and their means and sds."""
    d = measured.join(features, on).dropna(subset=[y, *xs])
    one = d.agg(*[F.avg(x).alias(f"_m_{x}") for x in xs], *[F.stddev_samp(x).alias(f"_s_{x}") for x in xs])
    frame = d.crossJoin(F.broadcast(one)).withColumns({x: F.try_divide(F.col(x) - F.col(f"_m_{x}"), F.col(f"_s_{x}")) for x in xs}).drop(*one.columns)
    cells = F.array(*[F.struct(F.lit(x).alias("variable"), F.col(f"_m_{x}").alias("mean"), F.col(f"_s_{x}").alias("sd")) for x in xs])
    return frame, one.select(F.inline(cells))


def save_model(m: Model, spark: SparkSession, path: str) -> None:
    place = lookup(spark, [(i, x, m.term.get(x, x)) for i, x in enumerate(m.names)], "place int, term string, codes string")
    whole = m.summary(spark).withColumns({"n_params": F.lit(m.n_params), "tss": F.lit(m.tss), "entity": F.lit(m.group).cast("string")})
    for part, df in (("coefficients", m.coefficients(spark).join(place, "term")), ("covariances", m.covariances(spark)), ("summary", whole)):
        df.write.mode("overwrite").parquet(f"{path}/{part}")


def load_model(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {p: spark.read.parquet(f"{path}/{p}") for p in ("coefficients", "covariances", "summary")}


def restore_model(spark: SparkSession, path: str) -> Model:
    """A saved model that predicts (``predict_column`` with its design): terms, coefficients, covariance and variances."""
    parts = load_model(spark, path)
    found, one = parts["coefficients"].orderBy("place").collect(), parts["summary"].first()
    names = [r["term"] for r in found]
    cells = {(r["a"], r["b"]): r["value"] for r in parts["covariances"].collect()}
    vcov = np.array([[cells[a, b] for b in names] for a in names])
    return Model(names, np.array([r["estimate"] for r in found]), vcov, one["n"], one["sigma2"], one["loglik"], one["n_params"], one["tss"], one["entity"], one["sigma2_u"], one["n_groups"], {r["term"]: r["codes"] for r in found})


# --- random intercepts ----------------------------------------------------------------------


def icc(df: DataFrame, by: Sequence[str], entity: str, y: str) -> DataFrame:
    """Repeatability by group: variance of entities' intercepts / all variance, by REML on each entity's number, sum and squares."""
    return _icc_of_entities(_entities(df, by, entity, y), by)


def _entities(df: DataFrame, by: Sequence[str], entity: str, y: str) -> DataFrame:
    """Number, mean and squares within of each entity."""
    each = df.where(F.col(y).isNotNull()).groupBy(*by, entity).agg(F.count("*").alias("_m"), F.avg(y).alias("_mean"), F.var_pop(y).alias("_v"))
    return each.withColumn("_within", F.col("_v") * F.col("_m")).drop("_v")


def _icc_of_entities(each: DataFrame, by: Sequence[str], weight: Column | None = None) -> DataFrame:
    """``weight``: how often an entity counts."""
    k, mean = F.lit(1) if weight is None else weight, F.col("_mean")
    # the likelihood needs, for each size of entity: how many, sum of means and of squared means
    size = each.groupBy(*by, "_m").agg(F.sum(k).alias("_k"), F.sum(k * mean).alias("_a"), F.sum(k * mean * mean).alias("_b"), F.sum(k * F.col("_within")).alias("_w")).where("_k > 0")
    kinds = dict(each.select(*by).dtypes)
    names = [f"_by{i}" for i in range(len(by))]
    size = size.select(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], "_m", "_k", "_a", "_b", "_w")
    out = size.groupBy(*names).applyInPandas(_icc_of_sizes(names), ", ".join([*(f"{n} {kinds[c]}" for n, c in zip(names, by, strict=True)), "icc double, sigma2_u double, sigma2_e double, n bigint, n_entities bigint"]))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, by, strict=True)], "icc", "sigma2_u", "sigma2_e", "n", "n_entities")


def _icc_of_sizes(names: Sequence[str]):
    """REML of one group from its sums by size of entity: a row for each distinct size, so the group is small however many entities it has."""

    def fit(pdf):
        import pandas as pd

        m, k, a, b, w = (pdf[c].to_numpy(float) for c in ("_m", "_k", "_a", "_b", "_w"))
        n, e, within = float((k * m).sum()), float(k.sum()), float(w.sum())

        def profile(theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            u = m / (1 + np.outer(theta, m))
            sums = (u * k).sum(1)
            s2 = (within + (u * b).sum(1) - (u * a).sum(1) ** 2 / sums) / max(n - 1, 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                ll = -0.5 * ((n - 1) * np.log(s2) + (k * np.log1p(np.outer(theta, m))).sum(1) + np.log(sums))
            return np.where(s2 > 0, ll, -np.inf), s2

        grid = np.concatenate([[0.0], np.logspace(-6, 6, 121)])
        for _ in range(12):
            ll, _ = profile(grid)
            best = int(np.argmax(ll))
            grid = np.linspace(grid[max(best - 1, 0)], grid[min(best + 1, len(grid) - 1)], 21)
        ll, s2 = profile(grid)
        best = int(np.argmax(ll))
        if not np.isfinite(ll[best]):
            return pd.DataFrame(columns=[*names, "icc", "sigma2_u", "sigma2_e", "n", "n_entities"])
        t, v = float(grid[best]), float(s2[best])
        return pd.DataFrame([[*(pdf[c].iloc[0] for c in names), t / (1 + t), t * v, v, int(n), int(e)]], columns=[*names, "icc", "sigma2_u", "sigma2_e", "n", "n_entities"])

    return fit


def lrt_random(df: DataFrame, entity: str, y: str) -> dict[str, float]:
    """Likelihood-ratio test of a random intercept (ML against least squares)."""
    d = design(df, [])
    a, b = lmm(df, y, d, entity, reml=False), ols(df, y, d)
    x = max(2 * (a.loglik - b.loglik), 0.0)
    return {"loglik_mixed": a.loglik, "loglik_fixed": b.loglik, "chi2": x, "p": chi2_p(x, 1) if x > 0 else 1.0}


def lrt_nested(small: Model, large: Model) -> tuple[float, int, float]:
    x, k = max(2 * (large.loglik - small.loglik), 0.0), large.n_params - small.n_params
    return x, k, chi2_p(x, k) if k > 0 and x > 0 else 1.0


def predict_column(m: Model, d: Design) -> Column:
    out = F.lit(0.0)
    for name, b in zip(m.names, m.beta, strict=True):
        out = out + float(b) * d.columns[name]
    return out


def blups(df: DataFrame, y: str, d: Design, m: Model) -> DataFrame:
    """Each entity's intercept: theta n (mean residual) / (1 + theta n), with its 95 % interval and whether that leaves out 0."""
    theta = m.sigma2_u / m.sigma2 if m.sigma2 > 0 else 0.0
    each = df.withColumn("_r", F.col(y) - predict_column(m, d)).where(F.col("_r").isNotNull()).groupBy(m.group).agg(F.count("*").alias("n"), F.avg("_r").alias("_m"))
    shrink = theta * F.col("n") / (1 + theta * F.col("n"))
    out = each.withColumn("blup", shrink * F.col("_m")).withColumn("se", F.sqrt(F.lit(m.sigma2_u) * (1 - shrink))).drop("_m")
    out = out.withColumn("lower", F.col("blup") - Z95 * F.col("se")).withColumn("upper", F.col("blup") + Z95 * F.col("se"))
    return out.withColumn("excludes_0", (F.col("lower") > 0) | (F.col("upper") < 0))


def marginal_r2(df: DataFrame, y: str, d: Design, m: Model) -> float:
    """Variance of the fixed part / variance of y."""
    r = df.withColumn("_f", predict_column(m, d)).where(F.col("_f").isNotNull() & F.col(y).isNotNull()).agg(F.var_samp("_f").alias("f"), F.var_samp(y).alias("y")).first()
    return r["f"] / r["y"] if r["y"] else math.nan


def compare_models(spark: SparkSession, models: Mapping[str, tuple[Model, float]]) -> DataFrame:
    """R2, AIC, BIC, n, entities and residual sd of named ``(model, r2)``, with differences to the first."""
    first = next(iter(models.values()))
    rows = [(k, float(r2), m.aic, m.bic, m.n, m.n_groups, math.sqrt(m.sigma2), m.aic - first[0].aic, m.bic - first[0].bic, float(r2 - first[1])) for k, (m, r2) in models.items()]
    return lookup(spark, rows, "model string, r2 double, aic double, bic double, n bigint, n_groups bigint, sd double, delta_aic double, delta_bic double, delta_r2 double")


def emmeans(spark: SparkSession, m: Model, d: Design, factor: str, within: str | None = None, at: Mapping[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """Marginal means of a factor's levels (within another's), other factors averaged and covariates as given (0), and their pairwise contrasts with normal p."""
    others = [f for f in d.levels if f not in (factor, within)]
    combos: list[dict[str, str]] = [{}]
    for f in others:
        combos = [{**c, f: lv} for c in combos for lv in d.levels[f]]

    def row(fixed: Mapping[str, str]) -> np.ndarray:
        out = np.zeros(len(m.names))
        for i, name in enumerate(m.names):
            v = 1.0
            for part in [] if name == "(Intercept)" else name.split(":"):
                f = next((f for f in d.levels if part.startswith(f) and part[len(f) :] in d.levels[f]), None)
                v *= float(fixed[f] == part[len(f) :]) if f else (at or {}).get(part, 0.0)
            out[i] = v
        return out

    means, contrasts = [], []
    for w in d.levels[within] if within else [None]:
        own = {lv: np.mean([row({factor: lv, **({within: w} if within else {}), **c}) for c in combos], axis=0) for lv in d.levels[factor]}
        for lv, v in own.items():
            means.append((w, lv, float(v @ m.beta), float(math.sqrt(max(v @ m.vcov @ v, 0)))))
        for a, b in combinations(own, 2):
            v = own[a] - own[b]
            est, se = float(v @ m.beta), float(math.sqrt(max(v @ m.vcov @ v, 0)))
            contrasts.append((w, a, b, est, se, math.erfc(abs(est / se) / math.sqrt(2)) if se > 0 else None, float(own[a] @ m.beta / (own[b] @ m.beta)) if own[b] @ m.beta else None))
    return lookup(spark, means, "within string, level string, emmean double, se double"), lookup(spark, contrasts, "within string, a string, b string, estimate double, se double, p double, fold double")


def gvif_of(m: Model) -> dict[str, tuple[int, float]]:
    """Columns and generalised variance inflation of each term, from determinants of the coefficients' correlations."""
    keep = [i for i, x in enumerate(m.names) if x != "(Intercept)"]
    v = m.vcov[np.ix_(keep, keep)]
    s = np.sqrt(np.diag(v))
    r, names = v / np.outer(s, s), [m.names[i] for i in keep]
    out = {}
    for term in dict.fromkeys(m.term[x] for x in names):
        own = [i for i, x in enumerate(names) if m.term[x] == term]
        rest = [i for i in range(len(names)) if i not in own]
        det = lambda ix: np.linalg.det(r[np.ix_(ix, ix)]) if ix else 1.0
        out[term] = (len(own), float(det(own) * det(rest) / np.linalg.det(r)))
    return out


def gvif(spark: SparkSession, m: Model, limit: float = 5.0) -> DataFrame:
    rows = [(term, k, g, g ** (1 / (2 * k)), bool(g ** (1 / k) > limit)) for term, (k, g) in gvif_of(m).items()]
    return lookup(spark, rows, "term string, df int, gvif double, scaled double, high boolean")


# --- selection ------------------------------------------------------------------------------


def _shape(d: Design) -> Design:
    """A design without its columns, which stay on the driver."""
    return Design(dict.fromkeys(d.columns), d.term, d.levels)


def _r2_of(sums: CrossProducts | tuple[np.ndarray, list[str]], d: Design, terms: Sequence[str]) -> float:
    """Of some terms: the marginal R2 of the mixed model (ML), or R2 of least squares."""
    if isinstance(sums, CrossProducts):
        return sums.marginal_r2(sums.fit(d.names(terms)))
    c, names = sums
    at = [names.index(x) for x in d.names(terms) if x != "(Intercept)"]
    explained = float(solve(c[np.ix_(at, at)], c[at, -1]) @ c[at, -1]) if at else 0.0
    return float(explained / c[-1, -1]) if c[-1, -1] > 0 else 0.0


def _add_steps(sums, d: Design, core: Sequence[str], candidates: Sequence[str], steps: int) -> list[tuple[int, str, float, float]]:
    """Step, variable, R2 and its gain: the candidate of largest R2 is added (ties by name) while R2 grows."""
    chosen, rows, now = list(core), [], _r2_of(sums, d, core)
    for step in range(1, steps + 1):
        left = {c: _r2_of(sums, d, [*chosen, c]) for c in candidates if c not in chosen}
        best = min(left, key=lambda c: (-left[c], c), default=None)
        if best is None or left[best] - now <= 1e-12:
            break
        rows.append((step, best, left[best], left[best] - now))
        chosen, now = [*chosen, best], left[best]
    return rows


def forward_select(df: DataFrame, y: str, core: Sequence[str], candidates: Sequence[str], steps: int = 6, group: str | None = None, factors: Sequence[str] = ()) -> DataFrame:
    """Adds, step by step, the candidate of largest R2, while it grows: R2 of least squares or, with ``group``, the marginal R2 of the model with its random intercept. All fits come from one aggregate."""
    d = design(df, [*core, *candidates], factors)
    if group is None:
        row = gram(df, y, d).first()
        sums = (square(row["cov"], len(d.columns)), [x for x in d.columns if x != "(Intercept)"])
    else:
        sums = cross_products(df, y, d, group)
    return lookup(df.sparkSession, _add_steps(sums, d, core, candidates, steps), "step int, variable string, r2 double, gain double")


def selection_frequency(df: DataFrame, key: str, y: str, core: Sequence[str], candidates: Sequence[str], steps: int = 6, runs: int = 100, share: float = 0.8, group: str | None = None, factors: Sequence[str] = ()) -> DataFrame:
    """How often each candidate is chosen over hash-weighted resamples: Poisson(1) weights from a hash and the run, one grouped aggregate for all runs, each run's steps in a task of its own.

    Rows are drawn by ``key`` and fitted by least squares; with ``group`` entities are drawn, whose sums alone are multiplied, and the
    steps go by the marginal R2 of the mixed model.
    """
    d = design(df, [*core, *candidates], factors)
    shape, width, picked = _shape(d), len(d.columns), "run int, step int, variable string"
    run = F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run")
    if group is None:
        rows, made = values(df.withColumn("_k", F.col(key)), y, d, ["_k"])
        # sums about the overall means, so that no digits go
        means = rows.agg(*[F.avg(c).alias(f"_m{c}") for c in made])
        rows = rows.crossJoin(F.broadcast(means)).select("_k", *[(F.col(c) - F.col(f"_m{c}")).alias(c) for c in made])
        x, w = [F.col(c) for c in made], F.col("_w")
        drawn = rows.select("*", run).withColumn("_w", poisson_weight(F.col("_k"), F.col("run"))).where("_w > 0")
        sums = drawn.groupBy("run").agg(F.sum(w).alias("n"), F.array(*[F.sum(w * a) for a in x]).alias("first"), F.array(*[F.sum(w * a * b) for i, a in enumerate(x) for b in x[i:]]).alias("second"))
    else:
        entities, _ = entity_products(df, y, d, group)
        drawn = entities.select("*", run)
        sums = sized_products(drawn, width, ["run"], poisson_weight(F.col(group).cast("string"), F.col("run")))
    names = [x for x in shape.columns if x != "(Intercept)"]

    def steps_of(pdf):
        import pandas as pd

        own = pdf.to_dict("records")
        if group is None:
            first = np.array(own[0]["first"])
            found = (square(own[0]["second"], width) - np.outer(first, first) / own[0]["n"], names)
        else:
            found = products_of_sizes(shape, group, own)
        return pd.DataFrame([(own[0]["run"], step, v) for step, v, *_ in _add_steps(found, shape, core, candidates, steps)], columns=["run", "step", "variable"])

    chosen = sums.groupBy("run").applyInPandas(steps_of, picked).groupBy("variable").agg(F.count("*").alias("n"), F.avg("step").alias("mean_step"), F.min("step").alias("min_step"), F.max("step").alias("max_step"))
    every = lookup(df.sparkSession, [(c,) for c in candidates], "variable string").join(chosen, "variable", "left")
    n = F.coalesce("n", F.lit(0)).cast("int")
    return every.select("variable", n.alias("n"), (n / runs).alias("frequency"), "mean_step", "min_step", "max_step", (n / runs >= share).alias("consensus"))


def _additions(sums: CrossProducts, d: Design, base: Sequence[str], candidates: Sequence[str], factor: str) -> list[tuple]:
    small, rows = sums.fit(d.names(base)), []
    for c in candidates:
        for kind, term in (("main", c), ("by factor", f"{c}*{factor}")):
            m = sums.fit(d.names([*base, term]))
            x, k, p = lrt_nested(small, m)
            rows.append((c, kind, m.aic - small.aic, m.bic - small.bic, x, k, p))
    return sorted(rows, key=lambda r: (r[2], r[0]))


def addition_tests(df: DataFrame, y: str, base: Sequence[str], candidates: Sequence[str], group: str, factor: str, factors: Sequence[str] = ()) -> DataFrame:
    """For each candidate, as main effect and by the factor: change of AIC, likelihood ratio and p against the base model (ML), best first. One scan for all; rows with a NULL in any candidate take no part."""
    d = design(df, [*base, *(f"{c}*{factor}" for c in candidates)], factors)
    rows = _additions(cross_products(df, y, d, group), d, base, candidates, factor)
    return lookup(df.sparkSession, rows, "variable string, kind string, delta_aic double, delta_bic double, chi2 double, df int, p double")


def extend_terms(base: Sequence[str], tests: Sequence[tuple], factor: str, most: float = -2.0, alpha: float = 0.05) -> list[str]:
    """Base terms and each variable that lowers AIC by more than 2 with a significant likelihood ratio, in its better form."""
    best: dict[str, tuple[float, str]] = {}
    for variable, kind, delta_aic, _, _, _, p in tests:
        if p < alpha and (variable not in base or kind != "main"):
            own = (delta_aic, variable if kind == "main" else f"{variable}*{factor}")
            best[variable] = min(own, best.get(variable, own))
    return [*base, *(term for delta, term in sorted(best.values()) if delta < most)]


def bic_step(df: DataFrame, y: str, base: Sequence[str], candidates: Sequence[str], group: str, factor: str, factors: Sequence[str] = ()) -> tuple[DataFrame, Model]:
    """The core model beside that with all significant additions, which is accepted where it lowers BIC; and the model accepted. All fits come from one scan."""
    d = design(df, [*base, *(f"{c}*{factor}" for c in candidates)], factors)
    sums = cross_products(df, y, d, group)
    terms = {"core": list(base), "extended": extend_terms(base, _additions(sums, d, base, candidates, factor), factor)}
    fits = {k: sums.fit(d.names(v)) for k, v in terms.items()}
    accepted = "extended" if fits["extended"].bic < fits["core"].bic else "core"
    rows = [(k, " + ".join(terms[k]), m.n, m.n_params, sums.marginal_r2(m), m.aic, m.bic, *lrt_nested(fits["core"], m)[::2], k == accepted) for k, m in fits.items()]
    return lookup(df.sparkSession, rows, "model string, terms string, n bigint, n_params int, r2 double, aic double, bic double, chi2 double, p double, accepted boolean"), fits[accepted]


def interaction_screen(df: DataFrame, y: str, base: Sequence[str], pairs: Sequence[tuple[str, str]], group: str, factors: Sequence[str] = ()) -> DataFrame:
    """Change of AIC and likelihood ratio of each pair's interaction on top of the base, by p; one scan for all pairs."""
    d = design(df, [*base, *(f"{a}:{b}" for a, b in pairs)], factors)
    sums = cross_products(df, y, d, group)
    small, rows = sums.fit(d.names(base)), []
    for a, b in pairs:
        m = sums.fit(d.names([*base, f"{a}:{b}"]))
        x, k, p = lrt_nested(small, m)
        rows.append((f"{a}:{b}", m.aic - small.aic, x, k, p))
    return lookup(df.sparkSession, sorted(rows, key=lambda r: (r[4], r[0])), "pair string, delta_aic double, chi2 double, df int, p double")


def drop_collinear(df: DataFrame, y: str, terms: Sequence[str], group: str, factors: Sequence[str] = (), keep: Sequence[str] = (), limit: float = 10.0) -> tuple[DataFrame, Model]:
    """Drops the term of largest GVIF over ``limit`` (none of ``keep``) and refits, until none is left: a row for each model's terms, and the last model. Refits are sub-matrices of one aggregate."""
    d = design(df, terms, factors)
    sums, left, rows = cross_products(df, y, d, group), list(terms), []
    for step in range(len(terms)):
        m = sums.fit(d.names(left))
        inflated = gvif_of(m)
        worst = max((t for t in left if t in inflated and t not in keep), key=lambda t: (inflated[t][1], t), default=None)
        drop = worst if worst is not None and inflated[worst][1] > limit and len(left) > 1 else None
        rows += [(step, t, df_, g, m.aic, t == drop) for t, (df_, g) in inflated.items()]
        if drop is None:
            break
        left.remove(drop)
    return lookup(df.sparkSession, rows, "step int, term string, df int, gvif double, aic double, dropped boolean"), m


def window_grid(features: DataFrame, y: str, a: str, b: str, key: str) -> DataFrame:
    """AIC of y on two drivers for every pair of their windows. ``features``: key, variable, window, mean, y. One join of a's and b's windows by measurement, one grouping by pair."""
    one = features.where(F.col("variable") == a).select(key, y, F.col("window").alias("w1"), F.col("mean").alias("x1"))
    two = features.where(F.col("variable") == b).select(key, F.col("window").alias("w2"), F.col("mean").alias("x2"))
    d = one.join(two, key).dropna(subset=["x1", "x2", y])
    v = lambda p, q: F.covar_pop(p, q)
    g = d.groupBy("w1", "w2").agg(F.count("*").alias("n"), v("x1", "x1").alias("aa"), v("x2", "x2").alias("bb"), v("x1", "x2").alias("ab"), v("x1", y).alias("ay"), v("x2", y).alias("by"), v(y, y).alias("yy"))
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    explained = F.try_divide(F.col("bb") * F.col("ay") ** 2 + F.col("aa") * F.col("by") ** 2 - 2 * F.col("ab") * F.col("ay") * F.col("by"), det)
    rss = (F.col("yy") - explained) * F.col("n")
    aic = F.col("n") * (F.log(2 * math.pi * rss / F.col("n")) + 1) + 2 * 4
    return g.select("w1", "w2", "n", F.try_divide(explained, F.col("yy")).alias("r2"), F.when(rss > 0, aic).alias("aic"))


def slopes_by_level(spark: SparkSession, m: Model, d: Design, variables: Sequence[str], factor: str) -> DataFrame:
    """Slope of each variable at each level: the reference's plus its interaction, with standard errors."""
    at, rows = {n: i for i, n in enumerate(m.names)}, []
    for x in variables:
        for lv in d.levels[factor]:
            v = np.zeros(len(m.names))
            v[at[x]] = 1
            other = next((n for n in (f"{x}:{factor}{lv}", f"{factor}{lv}:{x}") if n in at), None)
            if other:
                v[at[other]] = 1
            rows.append((x, lv, float(v @ m.beta), float(math.sqrt(max(v @ m.vcov @ v, 0)))))
    return lookup(spark, rows, "variable string, level string, slope double, se double")


# --- predictions ----------------------------------------------------------------------------


def prediction_grid(df: DataFrame, m: Model, d: Design, x: str, z: str, factor: str, *, steps: int = 100, probs: Sequence[float] = (0.1, 0.5, 0.9), near: float = 0.1, min_rows: int = 10) -> DataFrame:
    """Predictions over x at percentiles of z and all levels, other numeric predictors at their means.

    x runs from its 5th to its 95th percentile among rows near the percentile (within ``near`` of
    the range's share), or over its whole range where there are too few. ``fit`` and ``se`` come from coefficients and covariances.
    """
    numeric = [t for t in dict.fromkeys(p for term in m.term.values() for p in term.split(":")) if t not in d.levels and t not in ("(Intercept)", x, z)]
    q = df.agg(F.percentile(z, F.array(*[F.lit(float(p)) for p in probs])).alias("_z")).select(F.posexplode("_z").alias("_i", "_z"))
    prob = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("_i") + 1)
    bands = df.agg(F.percentile(z, F.array(*[F.lit(max(p - near, 0.0)) for p in probs])).alias("_l"), F.percentile(z, F.array(*[F.lit(min(p + near, 1.0)) for p in probs])).alias("_h"), F.min(x).alias("_x0"), F.max(x).alias("_x1"), *[F.avg(c).alias(c) for c in numeric])
    g = q.crossJoin(F.broadcast(bands)).withColumn("_lo", F.col("_l")[F.col("_i")]).withColumn("_hi", F.col("_h")[F.col("_i")])
    inside = df.select(F.col(x).alias("_vx"), F.col(z).alias("_vz")).join(F.broadcast(g.select("_i", "_lo", "_hi")), F.col("_vz").between(F.col("_lo"), F.col("_hi")))
    span = inside.groupBy("_i").agg(F.count("_vx").alias("_n"), F.percentile("_vx", F.array(F.lit(0.05), F.lit(0.95))).alias("_s"))
    g = g.join(F.broadcast(span), "_i", "left")
    few = F.coalesce(F.col("_n"), F.lit(0)) < min_rows
    a, b = F.when(few, F.col("_x0")).otherwise(F.col("_s")[0]), F.when(few, F.col("_x1")).otherwise(F.col("_s")[1])
    g = g.withColumn("_a", a).withColumn("_b", b).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn(factor, F.explode(F.array(*[F.lit(v) for v in d.levels[factor]])))
    g = g.withColumn(x, F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_k") / (steps - 1)).withColumn(z, F.col("_z")).withColumn("percentile", prob)
    columns = [d.columns[n] for n in m.names]
    fit, var = F.lit(0.0), F.lit(0.0)
    for i, c in enumerate(columns):
        fit = fit + float(m.beta[i]) * c
        for j, e in enumerate(columns):
            if m.vcov[i, j]:
                var = var + float(m.vcov[i, j]) * c * e
    return g.select("percentile", factor, F.col("_k").alias("step"), x, z, fit.alias("fit"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("se"))


def fit_by_group(df: DataFrame, by: Sequence[str], y: str, x: str, z: str, *, offset: float = 0.01, probs: Sequence[float] = tuple(k / 10 for k in range(1, 10)), steps: int = 100, near: int = 10, min_rows: int = 30) -> DataFrame:
    """Fits ``log(y + offset) ~ x * z`` by group and predicts over x at quantiles of z, with 95 % limits, all put back by exp.

    x runs between its 5th and 95th percentile among rows whose z lies between the midpoints to the neighbouring quantiles (open at the ends), both ends
    included, or in the whole group where there are fewer than ``near``. Groups of fewer than ``min_rows`` complete rows are left out.

    Coefficients and their covariance are columns of a group's row, solved from its cross-products in the task that holds them, and carried through the grid; quantiles are exact
    and spread over tasks. NULL is a group like others.
    """
    keys = [f"_g{i}" for i in range(len(by))]
    d = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.log(F.col(y).cast("double") + offset).alias("_y"), F.col(x).cast("double").alias("_px"), F.col(z).cast("double").alias("_pz"))
    d = d.where(F.col("_y").isNotNull() & ~F.isnan("_y")).dropna(subset=["_px", "_pz"])
    made = design(d, ["_px*_pz"])
    shape, kinds = _shape(made), dict(d.dtypes)

    def solved(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                m = ols_from_gram(r, shape)
                rows.append([*(r[k] for k in keys), int(r["n"]), m.beta.tolist(), m.vcov.reshape(-1).tolist()])
            yield pd.DataFrame(rows, columns=[*keys, "_n", "_beta", "_vcov"])

    fits = gram(d, "_y", made, keys).where(F.col("n") >= min_rows).mapInPandas(solved, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "_n bigint, _beta array<double>, _vcov array<double>"]))
    at = {f"z{i}": p for i, p in enumerate(probs)}
    cuts = summarise(d, keys, "_pz", at, {"_rows": F.count("*")})
    q = [F.col(f"z{i}") for i in range(len(probs))]
    middle = [None, *((a + b) / 2 for a, b in zip(q, q[1:], strict=False)), None]
    ranged = join_groups(d, cuts, keys, "inner")
    inside = [reduce(and_, [F.col("_pz") >= lo] * (lo is not None) + [F.col("_pz") <= hi] * (hi is not None), F.lit(True)) for lo, hi in zip(middle, middle[1:], strict=False)]
    whole = summarise_where(ranged, keys, F.col("_px"), [F.lit(True), *inside], [0.05, 0.95], {**{f"_in{i}": F.count_if(F.col(f"_t{i + 1}")) for i in range(len(probs))}, **{f"_z{i}": F.first(c) for i, c in enumerate(q)}})
    few = [F.col(f"_in{i}") < near for i in range(len(probs))]
    bands = F.array(*[F.struct(F.lit(float(p)).alias("percentile"), F.col(f"_z{i}").alias("z"), F.when(few[i], F.col("q0_0")).otherwise(F.col(f"q{i + 1}_0")).alias("a"), F.when(few[i], F.col("q0_1")).otherwise(F.col(f"q{i + 1}_1")).alias("b")) for i, p in enumerate(probs)])
    g = join_groups(fits, whole, keys, "inner").select(*keys, "_n", "_beta", "_vcov", F.explode(bands).alias("_b"))
    g = g.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    g = g.withColumn("_px", F.col("_b.a") + (F.col("_b.b") - F.col("_b.a")) * F.col("step") / (steps - 1)).withColumn("_pz", F.col("_b.z"))
    columns = [made.columns[c] for c in ["(Intercept)", *(c for c in made.columns if c != "(Intercept)")]]
    fit = reduce(add, [F.col("_beta")[i] * c for i, c in enumerate(columns)])
    var = reduce(add, [F.col("_vcov")[i * len(columns) + j] * a * b for i, a in enumerate(columns) for j, b in enumerate(columns)])
    g = g.withColumn("log_fit", fit).withColumn("log_se", F.sqrt(F.greatest(var, F.lit(0.0))))
    back = lambda c: F.exp(c) - offset
    return g.select(*[F.col(k).alias(b) for b, k in zip(by, keys, strict=True)], F.col("_b.percentile").alias("percentile"), "step", F.col("_px").alias(x), F.col("_pz").alias(z), F.col("_n").alias("n"), "log_fit", "log_se", back(F.col("log_fit")).alias("fit"), back(F.col("log_fit") - LIMIT * F.col("log_se")).alias("lower"), back(F.col("log_fit") + LIMIT * F.col("log_se")).alias("upper"))


def back_transform(pred: DataFrame, to: Callable[[Column], Column], fit: str = "fit", se: str = "se") -> DataFrame:
    """Predictions and their 95 % limits (on the scale of the fit) in the response's own units, such as ``F.sinh``."""
    limit = lambda k: to(F.col(fit) + k * LIMIT * F.col(se))
    return pred.withColumn("response", limit(0)).withColumn("lower", limit(-1)).withColumn("upper", limit(1))


def extremes(pred: DataFrame, by: Sequence[str], value: str = "fit") -> DataFrame:
    return pred.groupBy(*by).agg(F.min(value).alias("lowest"), F.max(value).alias("highest"), (F.max(value) - F.min(value)).alias("range"))


# --- components, classes, forests -----------------------------------------------------------


def pca_by_group_norm(df: DataFrame, key: str, by: Sequence[str], metrics: Sequence[str], anchor: str, k: int = 2) -> tuple[DataFrame, DataFrame]:
    """``(scores, loadings)`` of metrics standardised in groups (0 where they can't be), not centred again; signs make the anchor's loading positive."""
    d = with_group(df.select(key, *by, *metrics), by, **{f"_m_{m}": F.avg(m) for m in metrics}, **{f"_s_{m}": F.stddev_samp(m) for m in metrics})
    z = d.select(key, *by, *[F.coalesce(F.try_divide(F.col(m) - F.col(f"_m_{m}"), F.col(f"_s_{m}")), F.lit(0.0)).alias(m) for m in metrics])
    row = z.agg(F.count("*").alias("n"), F.array(*[F.sum(F.col(a) * F.col(b)) for i, a in enumerate(metrics) for b in metrics[i:]]).alias("xx")).first()
    values, vectors = np.linalg.eigh(square(row["xx"], len(metrics)) / max(row["n"] - 1, 1))
    order = np.argsort(values)[::-1][:k]
    vectors = vectors[:, order] * np.where(vectors[metrics.index(anchor), order] < 0, -1, 1)
    share = values[order] / values.sum()
    scores = z.select(key, *by, *[sum((float(vectors[i, c]) * F.col(m) for i, m in enumerate(metrics)), F.lit(0.0)).alias(f"pc{c + 1}") for c in range(k)])
    rows = [(m, c + 1, float(vectors[i, c]), float(share[c])) for c in range(k) for i, m in enumerate(metrics)]
    return scores, lookup(df.sparkSession, rows, "metric string, component int, loading double, variance_share double")


def decay_phase(df: DataFrame, by: Sequence[str], damage: str, cv: str, threshold: float = 1.0) -> DataFrame:
    """Four phases from a damage threshold and whether the variation is above its group's mean."""
    z = F.try_divide(F.col(cv) - F.col("_m"), F.col("_s"))
    d = with_group(df, by, _m=F.avg(cv), _s=F.stddev_samp(cv)).withColumn("cv_z", z).drop("_m", "_s")
    low, high = F.col(damage) <= threshold, F.col(damage) > threshold
    # Names of the phases.
    phase = F.when(low & (F.col("cv_z") <= 0), "I: Sound").when(low & (F.col("cv_z") > 0), "II: Incipient").when(high & (F.col("cv_z") > 0), "III: Active").when(high & (F.col("cv_z") <= 0), "IV: Cavity")
    return d.withColumn("decay_phase", phase)


def forest(df: DataFrame, y: str, xs: Sequence[str], trees: int = 500, seed: int = 42, max_depth: int = 10, hold_out: float = 0.3, key: str | None = None):
    """``(model, R2 on held-out rows, assembled table)``; rows are held out by a hash of their key."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    d = VectorAssembler(inputCols=list(xs), outputCol="features").transform(df.dropna(subset=[y, *xs]).withColumn("label", F.col(y).cast("double")))
    h = F.pmod(F.xxhash64(key or y), F.lit(1000)) < int(1000 * hold_out)
    model = RandomForestRegressor(numTrees=trees, maxDepth=max_depth, minInstancesPerNode=5, featureSubsetStrategy="sqrt", seed=seed).fit(d.where(~h))
    return model, RegressionEvaluator(metricName="r2").evaluate(model.transform(d.where(h))), d


#: Rows of a bucket in which rows exchange values, on average.
BUCKET_ROWS = 20_000


def exchanged(df: DataFrame, xs: Sequence[str], key: str, n: int) -> DataFrame:
    """``_o_<x>`` beside each feature: that of the row that follows in the order of a hash of the key, within hash buckets whose number follows the ``n`` rows."""
    w = Window.partitionBy(F.pmod(F.xxhash64(key), F.lit(n // BUCKET_ROWS + 1))).orderBy(F.xxhash64(key, F.lit(1)), key)
    return df.select(key, "label", *xs, *[F.coalesce(F.lead(x).over(w), F.first(x).over(w)).alias(f"_o_{x}") for x in xs])


def permutation_importance(model, df: DataFrame, xs: Sequence[str], key: str, top: int = 20) -> DataFrame:
    """Growth of the squared error when one feature is exchanged between rows: all features in one pass over exploded copies."""
    from pyspark.ml.feature import VectorAssembler

    d = exchanged(df, xs, key, df.count())
    d = d.withColumn("feature", F.explode(F.array(F.lit(""), *[F.lit(x) for x in xs])))
    d = d.select(key, "label", "feature", *[F.when(F.col("feature") == x, F.col(f"_o_{x}")).otherwise(F.col(x)).alias(x) for x in xs])
    scored = model.transform(VectorAssembler(inputCols=list(xs), outputCol="features").transform(d))
    err = scored.groupBy("feature").agg(F.avg((F.col("prediction") - F.col("label")) ** 2).alias("mse"))
    base = err.where("feature = ''").select(F.col("mse").alias("_b"))
    out = err.where("feature <> ''").crossJoin(F.broadcast(base)).select("feature", (F.col("mse") - F.col("_b")).alias("importance"))
    return out.orderBy(F.desc("importance"), "feature").limit(top)


def shapley(model, df: DataFrame, xs: Sequence[str], key: str, nsim: int = 50, max_obs: int = 300) -> DataFrame:
    """Sampled Shapley values of up to ``max_obs`` rows (a sampling operator: rows of the smallest hashes).

    For each row, simulation and feature, a random order (hashes) decides which features come from the row and which from a random other
    row of the sample; the model sees both versions and the differences are averaged.
    """
    from pyspark.ml.feature import VectorAssembler

    rows = df.dropna(subset=list(xs)).select(F.col(key).alias("_key"), F.struct(*[F.col(x).cast("double").alias(x) for x in xs]).alias("_v")).orderBy(F.xxhash64("_key"), "_key").limit(max_obs)
    base = rows.agg(F.collect_list("_v").alias("_all"))  # max_obs rows at most
    d = rows.crossJoin(F.broadcast(base)).withColumn("sim", F.explode(F.sequence(F.lit(1), F.lit(nsim)))).withColumn("feature", F.explode(F.array(*[F.lit(x) for x in xs])))
    d = d.withColumn("_o", F.col("_all")[F.pmod(F.xxhash64("_key", "sim"), F.size("_all")).cast("int")])
    turn = lambda x: F.xxhash64(F.col("_key"), F.col("sim"), x)
    pick = lambda x, with_own: F.when((turn(F.lit(x)) < turn(F.col("feature"))) | ((F.col("feature") == x) & F.lit(with_own)), F.col(f"_v.{x}")).otherwise(F.col(f"_o.{x}"))
    d = d.withColumn("_side", F.explode(F.array(F.lit(True), F.lit(False))))
    d = d.select("_key", "sim", "feature", "_side", F.col("_v").alias("_v"), *[F.when(F.col("_side"), pick(x, True)).otherwise(pick(x, False)).alias(x) for x in xs])
    scored = model.transform(VectorAssembler(inputCols=list(xs), outputCol="features").transform(d))
    sign = F.when(F.col("_side"), 1.0).otherwise(-1.0)
    own = F.coalesce(*[F.when(F.col("feature") == x, F.col(f"_v.{x}")) for x in xs])
    out = scored.groupBy(F.col("_key").alias(key), "feature").agg((F.sum(sign * F.col("prediction")) / nsim).alias("shapley"), F.first(own).alias("value"))
    w = Window.partitionBy("feature")
    return out.withColumn("scaled_value", F.try_divide(F.col("value") - F.min("value").over(w), F.max("value").over(w) - F.min("value").over(w)))


def gamma_glm(df: DataFrame, y: str, factors: Sequence[str]) -> DataFrame:
    """Coefficients of a Gamma model with log link on positive values, factors crossed."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    d = df.where(F.col(y) > 0)
    made = design(d, ["*".join(factors)], factors)
    names = [n for n in made.columns if n != "(Intercept)"]
    d = d.select(F.col(y).cast("double").alias("label"), *[made.columns[n].alias(f"x{i}") for i, n in enumerate(names)])
    m = GeneralizedLinearRegression(family="gamma", link="log", maxIter=50).fit(VectorAssembler(inputCols=[f"x{i}" for i in range(len(names))], outputCol="features").transform(d))
    rows = [("(Intercept)", float(m.intercept)), *((n, float(c)) for n, c in zip(names, m.coefficients.toArray(), strict=True))]
    return lookup(df.sparkSession, [(n, c, math.exp(c)) for n, c in rows], "term string, estimate double, fold double")


def gamma_mixed(df: DataFrame, y: str, factors: Sequence[str], date: str, rounds: int = 200) -> tuple[DataFrame, DataFrame]:
    """``(coefficients, summary)`` of a Gamma model with log link on positive values, factors crossed, and a random intercept of each date.

    Penalised quasi-likelihood: a linear mixed model of the working response, fitted again until coefficients settle. Rows of one date and factor
    cell share their linear predictor, so their number, mean and variance are all that any round needs: one scan, and a row for each date and cell
    (calendar days times cells) reaches the driver.
    """
    d = df.where(F.col(y) > 0).dropna(subset=[date, *factors])
    made = design(d, ["*".join(factors)], factors)
    names = list(made.columns)
    yc = F.col(y).cast("double")
    cells = d.groupBy(F.col(date).cast("string").alias("_d"), *factors).agg(F.count("*").alias("_n"), F.avg(yc).alias("_m"), F.var_pop(yc).alias("_v"))
    got = cells.select("_d", "_n", "_m", "_v", *[c.alias(f"_x{i}") for i, c in enumerate(made.columns.values())]).orderBy("_d", *[f"_x{i}" for i in range(len(names))]).collect()
    schema = "term string, estimate double, se double, fold double", "n bigint, n_dates bigint, dispersion double, sigma2_date double, rounds int"
    if not got:
        return lookup(df.sparkSession, [], schema[0]), lookup(df.sparkSession, [], schema[1])
    n, mean, var = (np.array([r[c] for r in got], float) for c in ("_n", "_m", "_v"))
    x = np.array([[r[f"_x{i}"] for i in range(len(names))] for r in got], float)
    days, day = np.unique([r["_d"] for r in got], return_inverse=True)
    size, p = np.bincount(day, weights=n), len(names)
    sx = np.stack([np.bincount(day, weights=n * x[:, j]) for j in range(p)], axis=1)
    xx0 = (x * n[:, None]).T @ x
    eta, beta, done = np.log(mean), np.full(p, np.inf), 0
    for done in range(1, rounds + 1):
        mu = np.exp(eta)
        z, inside = eta + (mean - mu) / mu, float(n @ (var / mu**2))
        sz, xz0, zz0 = np.bincount(day, weights=n * z), x.T @ (n * z), float(n @ (z * z)) + inside

        def profile(theta, sz=sz, xz0=xz0, zz0=zz0):
            w = theta / (1 + theta * size)
            xx, xz = xx0 - (sx * w[:, None]).T @ sx, xz0 - sx.T @ (w * sz)
            b = solve(xx, xz)
            s2 = max(zz0 - float(w @ (sz * sz)) - float(b @ xz), 1e-300) / n.sum()
            return -0.5 * (n.sum() * math.log(s2) + np.log1p(theta * size).sum()), b, xx, s2

        grid = np.concatenate([[0.0], np.logspace(-6, 4, 41)])
        for _ in range(10):
            best = int(np.argmax([profile(t)[0] for t in grid]))
            grid = np.linspace(grid[max(best - 1, 0)], grid[min(best + 1, len(grid) - 1)], 11)
        theta = float(grid[int(np.argmax([profile(t)[0] for t in grid]))])
        _, new, xx, s2 = profile(theta)
        u = theta / (1 + theta * size) * (sz - sx @ new)
        eta = x @ new + u[day]
        settled = np.abs(new - beta).max() < 1e-10
        beta = new
        if settled:
            break
    se = np.sqrt(np.maximum(np.diag(s2 * np.linalg.pinv(xx)), 0))
    rows = [(a, float(b), float(e), math.exp(b)) for a, b, e in zip(names, beta, se, strict=True)]
    return lookup(df.sparkSession, rows, schema[0]), lookup(df.sparkSession, [(int(n.sum()), len(days), float(s2), float(theta * s2), done)], schema[1])


def poisson_weight(key: Column, run: Column) -> Column:
    """A Poisson(1) number from a hash of key and run: the same in every run and partitioning."""
    u = F.pmod(F.xxhash64(key, run), F.lit(1_000_003)) / 1_000_003.0
    out, total, term = F.lit(0), 0.0, math.exp(-1)
    for k in range(1, 8):
        total += term
        out = F.when(u >= total, k).otherwise(out)
        term /= k
    return out


def positions(d: DataFrame, key: str, n: int, bucket_rows: int = 1 << 20) -> DataFrame:
    """A number from 0 to n - 1 for each row, in the order of a hash of its key: ranks within hash buckets, and the buckets' totals. Bounded buckets make it the one sort of a table of any size."""
    buckets = F.pmod(F.xxhash64(key, F.lit(5)), F.lit(n // bucket_rows + 1))
    own = d.withColumn("_b", buckets).withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(F.xxhash64(key, F.lit(6)), key)) - 1)
    sizes = d.groupBy(buckets.alias("_b")).agg(F.count("*").alias("_s"))
    before = sizes.select("_b", F.coalesce(F.sum("_s").over(Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return own.join(before, "_b").withColumn("position", F.col("_r") + F.col("_before")).drop("_b", "_r", "_before")


def affine(run: int, n: int) -> tuple[int, int]:
    """Factor without a common divisor with n, and shift, of a run's permutation ``position -> (factor * position + shift) mod n``; products stay below 2**62."""
    rng = np.random.Generator(np.random.PCG64(run))
    factor = int(rng.integers(1, max(2, min(n, (1 << 62) // max(n, 1)))))
    while math.gcd(factor, n) > 1:
        factor += 1
    return factor, int(rng.integers(0, n))


def _blocks(placed: DataFrame, rows: int = 1 << 13) -> DataFrame:
    """``p, v``: positions and values of up to ``rows`` rows as bytes, through the checkpoint folder."""

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(0, len(batch), rows):
                part = batch.slice(i, rows)
                yield pa.record_batch([pa.array([part.column(c).to_numpy().astype(t).tobytes()], pa.binary()) for c, t in ((0, np.uint64), (1, np.float64))], ["p", "v"])

    return stored(placed.select("position", "v").mapInArrow(pack, "p binary, v binary"))


def permuted_sums(placed: DataFrame, sizes: Sequence[tuple[int, int]], n: int, runs: Sequence[int], held: int = 1 << 22, together: int = 1 << 18) -> DataFrame:
    """``run, m, e, s``: sums of ``v`` of the ``e``-th entity of ``m`` rows, when each run deals the values at ``position`` anew.

    Entities of one size are alike, so the places of size m's entities are one interval of positions, m for each: the table of
    ``(m, how many)`` is all that tells a place's entity. A task has some runs, or a range of one run's entities, of ``held`` sums at most, and reads
    all values in blocks, ``together`` rows at once: every sum is one task's own, so neither rows nor parts of sums are shuffled.
    """
    m = np.array([s for s, _ in sizes], np.int64)
    k = np.array([c for _, c in sizes], np.int64)
    first, offset, entities = np.cumsum(m * k) - m * k, np.cumsum(k) - k, int(k.sum())
    permutations = {run: affine(run, n) for run in runs}
    spark = placed.sparkSession
    span, even = max(1, min(held, entities)), -(-len(permutations) // (4 * spark.sparkContext.defaultParallelism))
    each = max(1, min(held // max(entities, 1), even))
    works = [(list(runs)[i : i + each], low) for i in range(0, len(runs), each) for low in range(0, entities, span)]

    def add(batches):
        import pyarrow as pa

        work, sums, kept, waiting = None, None, [], 0

        def settle():
            position, v = (np.concatenate([np.frombuffer(x, t) for x in column]) for column, t in zip(zip(*kept, strict=True), (np.uint64, np.float64), strict=True))
            for i, run in enumerate(work[0]):
                factor, shift = (np.uint64(x) for x in permutations[run])
                place = factor * position + shift
                place -= place // np.uint64(n) * np.uint64(n)
                place = place.view(np.int64)
                size = np.searchsorted(first, place, side="right") - 1
                entity = offset[size] + (place - first[size]) // m[size] - work[1]
                if span < entities:
                    inside = (entity >= 0) & (entity < sums.shape[1])
                    sums[i] += np.bincount(entity[inside], weights=v[inside], minlength=sums.shape[1])
                else:
                    sums[i] += np.bincount(entity, weights=v, minlength=entities)

        for batch in batches:
            for w, p, v in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if work is None:
                    work = works[w]
                    sums = np.zeros((len(work[0]), min(span, entities - work[1])))
                kept.append((p, v))
                waiting += len(p) // 8
                if waiting >= together:
                    settle()
                    kept, waiting = [], 0
        if kept:
            settle()
        for i, run in enumerate(work[0] if work else []):
            at = np.flatnonzero(sums[i])
            if len(at):
                e = at + work[1]
                size = np.searchsorted(offset, e, side="right") - 1
                yield pa.record_batch([pa.array(np.full(len(at), run)), pa.array(m[size]), pa.array(e - offset[size]), pa.array(sums[i][at])], ["run", "m", "e", "s"])

    tasks = spark.range(0, len(works), 1, len(works)).withColumnRenamed("id", "w").hint("shuffle_replicate_nl")
    return tasks.crossJoin(_blocks(placed).coalesce(1)).mapInArrow(add, "run bigint, m bigint, e bigint, s double")


def repeatability(df: DataFrame, key: str, entity: str, y: str, nboot: int = 1000, nperm: int = 1000, seed: int = 42) -> DataFrame:
    """ICC with a bootstrap interval over entities and a permutation p.

    Boot runs give entities Poisson weights, so they multiply entities' sums and not rows. Permutation runs are affine permutations of row
    positions, which one sort gives; each task adds up some runs over blocks of all values, so rows are neither multiplied nor
    shuffled by run. Keys should be distinct: rows of equal keys have one order, but not a stated one.
    """
    d = df.where(F.col(y).isNotNull()).select(F.col(key).alias("_k"), F.col(entity).cast("string").alias("_e"), F.col(y).cast("double").alias("_y"))
    own = icc(d.withColumn("run", F.lit(0)), ["run"], "_e", "_y").first()
    schema = "icc double, sigma2_u double, sigma2_e double, n bigint, n_entities bigint, lower double, upper double, p double"
    if own is None:
        return lookup(df.sparkSession, [], schema)
    entities = _entities(d, [], "_e", "_y")
    drawn = entities.withColumn("run", F.explode(F.sequence(F.lit(seed + 1), F.lit(seed + nboot))))
    ci = _icc_of_entities(drawn, ["run"], poisson_weight(F.col("_e"), F.col("run"))).agg(F.percentile("icc", F.array(F.lit(0.025), F.lit(0.975))).alias("q")).first()["q"]
    sizes = [(r["_m"], r["k"]) for r in entities.groupBy("_m").agg(F.count("*").alias("k")).orderBy("_m").collect()]  # a row for each distinct number of rows
    n = sum(m * k for m, k in sizes)
    whole = d.agg(F.avg("_y").alias("mean"), F.var_pop("_y").alias("v")).first()
    placed = positions(d.select("_k", "_y"), "_k", n).withColumn("v", F.col("_y") - F.lit(whole["mean"]))
    sums = permuted_sums(placed, sizes, n, range(seed + 1, seed + nperm + 1))
    mean = F.col("s") / F.col("m")
    # entities whose sum is 0 in a run have no row there: how many there are is known
    by_size = sums.groupBy("run", F.col("m").alias("_m")).agg(F.sum(mean).alias("_a"), F.sum(mean * mean).alias("_b"))
    count = lookup(df.sparkSession, sizes, "_m bigint, _k bigint")
    runs = df.sparkSession.range(seed + 1, seed + nperm + 1).withColumnRenamed("id", "run").crossJoin(F.broadcast(count)).join(by_size, ["run", "_m"], "left").na.fill(0.0, ["_a", "_b"])
    within = F.lit(n * whole["v"]) - F.sum(F.col("_m") * F.col("_b")).over(Window.partitionBy("run"))
    one = F.row_number().over(Window.partitionBy("run").orderBy("_m")) == 1
    runs = runs.withColumn("_w", F.when(one, F.greatest(within, F.lit(0.0))).otherwise(0.0))
    perm = runs.groupBy("run").applyInPandas(_icc_of_sizes(["run"]), "run bigint, icc double, sigma2_u double, sigma2_e double, n bigint, n_entities bigint")
    above = perm.agg(F.count_if(F.col("icc") >= own["icc"]).alias("a"), F.count("*").alias("n")).first()
    rows = [(own["icc"], own["sigma2_u"], own["sigma2_e"], own["n"], own["n_entities"], ci[0] if ci else None, ci[1] if ci else None, (above["a"] + 1) / (above["n"] + 1))]
    return lookup(df.sparkSession, rows, schema)


def p_of_t(t: float, df: float) -> float | None:
    return t_p(t, df)
