"""Designs, least squares and random-intercept models from centred cross-products.

Cross-products are sums of products of distances from the means (population covariances, which
Spark merges without loss), so a large constant in y or x costs no digits. For random intercepts one aggregation by entity and one by
entities' size hold what the likelihood of every sub-model of the design needs: any number of models is fitted from one scan.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lookups import lookup
from .numerics import Z95, t_p

# --- design ---------------------------------------------------------------------------------


@dataclass
class Design:
    """Named columns of a model matrix. ``term`` maps each to the term that it codes."""

    columns: dict[str, Column]
    term: dict[str, str]
    levels: dict[str, list[str]] = field(default_factory=dict)

    def names(self, terms: Sequence[str]) -> list[str]:
        """The intercept and the columns of some of the terms."""
        own = {"(Intercept)", *expand(terms)}
        return [n for n, t in self.term.items() if t in own]


def expand(terms: Sequence[str]) -> list[str]:
    """Single terms of crossed ones: ``x*f`` is ``x``, ``f`` and ``x:f``."""
    flat: list[str] = []
    for term in terms:
        parts = [p.strip() for p in term.split("*")]
        flat += [":".join(c) for k in range(1, len(parts) + 1) for c in combinations(parts, k)]
    return list(dict.fromkeys(flat))


def design(df: DataFrame, terms: Sequence[str], factors: Sequence[str] = ()) -> Design:
    """Treatment-coded columns of terms such as ``x``, ``f``, ``x:f`` or ``x*z*f`` (all interactions up to three ways); a factor's first level by name is its reference."""
    levels = {f: sorted(r[0] for r in df.select(F.col(f).cast("string")).where(F.col(f).isNotNull()).distinct().collect()) for f in factors}
    columns, owner = {"(Intercept)": F.lit(1.0)}, {"(Intercept)": "(Intercept)"}
    for term in expand(terms):
        made: list[tuple[str, Column]] = [("", F.lit(1.0))]
        for p in term.split(":"):
            own = [(f"{p}{lv}", (F.col(p).cast("string") == lv).cast("double")) for lv in levels[p][1:]] if p in levels else [(p, F.col(p).cast("double"))]
            made = [(f"{a}:{b}" if a else b, x * y) for a, x in made for b, y in own]
        columns |= dict(made)
        owner |= {name: term for name, _ in made}
    return Design(columns, owner, levels)


# --- models ---------------------------------------------------------------------------------


def marks(p: float) -> str:
    return "***" if p < 0.001 else "**" if p < 0.01 else "*" if p < 0.05 else ""


@dataclass
class Model:
    """A fitted model: coefficients, their covariance, variances and likelihood."""

    names: list[str]
    beta: np.ndarray
    vcov: np.ndarray
    n: int
    sigma2: float
    loglik: float
    n_params: int
    tss: float
    group: str | None = None
    sigma2_u: float = 0.0
    n_groups: int = 0
    term: dict[str, str] = field(default_factory=dict)

    @property
    def aic(self) -> float:
        return 2 * self.n_params - 2 * self.loglik

    @property
    def bic(self) -> float:
        return math.log(self.n) * self.n_params - 2 * self.loglik

    def coefficients(self, spark: SparkSession) -> DataFrame:
        """Estimate, standard error, t, 95 % interval, significance by |t| > 2, the order of the effect, and the two-sided p of t with n minus terms degrees of freedom and its stars."""
        rows, free = [], max(self.n - len(self.names), 1)
        for name, b, se in zip(self.names, self.beta, np.sqrt(np.maximum(np.diag(self.vcov), 0)), strict=True):
            t = b / se if se > 0 else None
            kind = "intercept" if name == "(Intercept)" else ("main", "two-way", "three-way")[min(name.count(":"), 2)]
            p = None if t is None else float(t_p(t, free))
            rows.append((name, float(b), float(se), None if t is None else float(t), float(b - Z95 * se), float(b + Z95 * se), None if t is None else bool(abs(t) > 2), kind, p, None if p is None else marks(p)))
        return lookup(spark, rows, "term string, estimate double, se double, t double, lower double, upper double, significant boolean, effect string, p double, stars string")

    def covariances(self, spark: SparkSession) -> DataFrame:
        rows = [(a, b, float(self.vcov[i, j])) for i, a in enumerate(self.names) for j, b in enumerate(self.names)]
        return lookup(spark, rows, "a string, b string, value double")

    def summary(self, spark: SparkSession, name: str = "model") -> DataFrame:
        rows = [(name, self.n, self.n_groups, self.sigma2, self.sigma2_u, self.loglik, self.aic, self.bic)]
        return lookup(spark, rows, "model string, n bigint, n_groups bigint, sigma2 double, sigma2_u double, loglik double, aic double, bic double")


def square(upper: Sequence[float], p: int) -> np.ndarray:
    """The symmetric matrix of an upper triangle by rows."""
    out = np.zeros((p, p))
    out[np.triu_indices(p)] = upper
    return out + np.triu(out, 1).T


# --- least squares --------------------------------------------------------------------------


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of a symmetric system; columns of any scale, dependent ones share."""
    s = np.sqrt(np.maximum(np.diag(a), 0))
    s[s == 0] = 1
    return np.linalg.lstsq(a / np.outer(s, s), b / s, rcond=None)[0] / s


def inverse(a: np.ndarray) -> np.ndarray:
    s = np.sqrt(np.maximum(np.diag(a), 0))
    s[s == 0] = 1
    return np.linalg.pinv(a / np.outer(s, s)) / np.outer(s, s)


def uncentred(beta: np.ndarray, vcov: np.ndarray, means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of a fit in distances from the means (``means``: of the predictors, then y), intercept first, as those of the values."""
    back = np.eye(len(beta))
    back[0, 1:] = -means[:-1]
    out = back @ beta
    out[0] += means[-1]
    return out, back @ vcov @ back.T


def values(df: DataFrame, y: str, d: Design, by: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Complete rows of the columns but the intercept, and y, as ``_x0`` and so on."""
    names = [n for n in d.columns if n != "(Intercept)"]
    columns = [*(d.columns[n] for n in names), F.col(y).cast("double")]
    made = [f"_x{i}" for i in range(len(columns))]
    return df.select(*by, *[c.alias(n) for c, n in zip(columns, made, strict=True)]).dropna(subset=made), made


def centred(names: Sequence[str]) -> tuple[Column, Column]:
    """Means, and population covariances by rows of the upper triangle."""
    return F.array(*[F.avg(a) for a in names]).alias("mean"), F.array(*[F.covar_pop(a, b) for i, a in enumerate(names) for b in names[i:]]).alias("cov")


def gram(df: DataFrame, y: str, d: Design, by: Sequence[str] = ()) -> DataFrame:
    """``n, mean, cov`` by group over complete rows: of the columns but the intercept, then y."""
    rows, names = values(df, y, d, by)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *centred(names))


def ols_from_gram(row, d: Design) -> Model:
    names = ["(Intercept)", *(x for x in d.columns if x != "(Intercept)")]
    n, mean = int(row["n"]), np.array(row["mean"], float)
    return least_squares(names, d.term, n, mean, n * square(row["cov"], len(mean)))


def least_squares(names: list[str], term: dict[str, str], n: int, mean: np.ndarray, c: np.ndarray) -> Model:
    """From sums of centred products, y last."""
    p = len(names)
    slopes = solve(c[:-1, :-1], c[:-1, -1])
    rss = max(float(c[-1, -1] - slopes @ c[:-1, -1]), 0.0)
    sigma2 = rss / max(n - p, 1)
    vcov = np.zeros((p, p))
    vcov[0, 0], vcov[1:, 1:] = 1 / n, inverse(c[:-1, :-1])
    beta, vcov = uncentred(np.concatenate([[0.0], slopes]), sigma2 * vcov, mean)
    loglik = -n / 2 * (math.log(2 * math.pi * max(rss, 1e-300) / n) + 1)
    return Model(names, beta, vcov, n, sigma2, loglik, p + 1, float(c[-1, -1]), term=term)


def ols(df: DataFrame, y: str, d: Design) -> Model:
    row = gram(df, y, d).first()
    if not row["n"]:
        raise ValueError("no complete row")
    return ols_from_gram(row, d)


def r_squared(m: Model) -> float:
    return 1 - m.sigma2 * (m.n - len(m.names)) / m.tss if m.tss > 0 else math.nan


def ols_by(df: DataFrame, y: str, d: Design, by: Sequence[str]) -> DataFrame:
    """Coefficients by group: cross-products by group in one pass, solved in the tasks that hold them."""
    p, names = len(d.columns), list(d.columns)
    kinds = dict(df.select(*by).dtypes)

    def fit(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                if r["n"] <= p:
                    continue
                m = ols_from_gram(r, d_names)
                for name, b, v in zip(names, m.beta, np.diag(m.vcov), strict=True):
                    rows.append([*(r[c] for c in by), name, float(b), float(math.sqrt(max(v, 0))), int(r["n"]), r_squared(m)])
            yield pd.DataFrame(rows, columns=[*by, "term", "estimate", "se", "n", "r2"])

    d_names = Design(dict.fromkeys(names), d.term)  # the columns themselves stay on the driver
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "term string, estimate double, se double, n bigint, r2 double"])
    return gram(df, y, d, by).mapInPandas(fit, schema)


# --- random intercepts ----------------------------------------------------------------------


@dataclass
class CrossProducts:
    """Of a design and an entity: all that random-intercept models of any of its columns need.

    An entity's share of the likelihood depends on the ratio of variances only through its number of rows. So for
    each such number there are the number of entities, the sums of their means' distances from the overall means, and
    of the products of these distances; y is last.
    """

    names: list[str]
    term: dict[str, str]
    group: str
    n: int
    mean: np.ndarray
    c: np.ndarray
    m: np.ndarray
    k: np.ndarray
    first: np.ndarray
    second: np.ndarray

    def fit(self, names: Sequence[str] | None = None, reml: bool = False) -> Model:
        """The model of some of the columns, by profile likelihood of theta = variance of the intercepts / residual variance."""
        chosen = [x for x in self.names if names is None or x in set(names) or x == "(Intercept)"]
        at = [self.names.index(x) - 1 for x in chosen[1:]] + [len(self.mean) - 1]
        p, n = len(chosen), self.n
        whole = np.zeros((p + 1, p + 1))
        whole[0, 0], whole[1:, 1:] = n, self.c[np.ix_(at, at)]
        share = np.zeros((len(self.m), p + 1, p + 1))
        share[:, 0, 0], share[:, 0, 1:] = self.k, self.first[:, at]
        share[:, 1:, 0], share[:, 1:, 1:] = self.first[:, at], self.second[:, at][:, :, at]
        share *= (self.m**2)[:, None, None]

        def profile(theta: float) -> tuple[float, np.ndarray, np.ndarray, float]:
            g = whole - np.tensordot(theta / (1 + self.m * theta), share, 1)
            xx, xy = g[:-1, :-1], g[:-1, -1]
            beta = solve(xx, xy)
            free = n - p if reml else n
            sigma2 = max(float(g[-1, -1] - beta @ xy), 1e-300) / free
            ll = -0.5 * (free * (math.log(2 * math.pi * sigma2) + 1) + float(self.k @ np.log1p(self.m * theta)))
            if reml:
                ll -= 0.5 * np.linalg.slogdet(xx)[1]
            return ll, beta, xx, sigma2

        grid = np.concatenate([[0.0], np.logspace(-6, 6, 37)])
        best = int(np.argmax([profile(t)[0] for t in grid]))
        low, high, ratio = grid[max(best - 1, 0)], grid[min(best + 1, len(grid) - 1)], (math.sqrt(5) - 1) / 2
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        fa, fb = profile(a)[0], profile(b)[0]
        for _ in range(45):  # golden section
            if fa >= fb:
                high, b, fb = b, a, fa
                a = high - ratio * (high - low)
                fa = profile(a)[0]
            else:
                low, a, fa = a, b, fb
                b = low + ratio * (high - low)
                fb = profile(b)[0]
        theta = max((0.0, float(grid[best]), float((low + high) / 2)), key=lambda t: profile(t)[0])
        ll, beta, xx, sigma2 = profile(theta)
        beta, vcov = uncentred(beta, sigma2 * inverse(xx), self.mean[at])
        return Model(chosen, beta, vcov, n, float(sigma2), float(ll), p + 2, float(self.c[-1, -1]), self.group, float(theta * sigma2), int(self.k.sum()), self.term)

    def marginal_r2(self, m: Model) -> float:
        """Variance of the fixed part / variance of y."""
        at = [self.names.index(x) - 1 for x in m.names[1:]]
        return float(m.beta[1:] @ self.c[np.ix_(at, at)] @ m.beta[1:] / self.c[-1, -1]) if self.c[-1, -1] > 0 else math.nan


def entity_products(df: DataFrame, y: str, d: Design, group: str) -> tuple[DataFrame, list[str]]:
    """``m, mean, cov`` of each entity, and the names of the products' columns."""
    rows, made = values(df, y, d, [group])
    return rows.dropna(subset=[group]).groupBy(group).agg(F.count("*").alias("m"), *centred(made)), made


def sized_products(entities: DataFrame, width: int, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """``m, k, mean, cov, within`` by group and number of rows of an entity: the number of entities, means and covariances of their means, and the summed covariances within them. ``weight``: how often an entity counts, a whole number."""
    one = entities.select(*by, "m", (F.lit(1) if weight is None else weight).alias("_w"), *[F.col("mean")[i].alias(f"_x{i}") for i in range(width)], F.col("cov").alias("_cov"))
    if weight is not None:
        one = one.where("_w > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_w"))))
    inside = F.array(*[F.sum(F.col("_cov")[i]) for i in range(width * (width + 1) // 2)]).alias("within")
    return one.groupBy(*by, "m").agg(F.count("*").alias("k"), *centred([f"_x{i}" for i in range(width)]), inside)


def products_of_sizes(d: Design, group: str, sizes: Sequence) -> CrossProducts:
    """From the rows of ``sized_products``."""
    names = ["(Intercept)", *(x for x in d.columns if x != "(Intercept)")]
    width = len(names)
    m, k = (np.array([r[c] for r in sizes], float) for c in ("m", "k"))
    means = np.array([r["mean"] for r in sizes], float).reshape(-1, width)
    n = float(m @ k)
    mean = (m * k) @ means / n
    off = means - mean
    second = np.array([r["k"] * (square(r["cov"], width) + np.outer(o, o)) for r, o in zip(sizes, off, strict=True)])
    within = np.array([square(r["within"], width) for r in sizes])
    return CrossProducts(names, d.term, group, int(n), mean, np.tensordot(m, within + second, 1), m, k, k[:, None] * off, second)


def cross_products(df: DataFrame, y: str, d: Design, group: str) -> CrossProducts:
    """One scan; a row for each distinct number of rows of an entity is collected. Rows with a NULL in any column take no part, so all models of the design are fitted on the same rows."""
    entities, made = entity_products(df, y, d, group)
    sizes = sized_products(entities, len(made)).orderBy("m").collect()
    if not sizes:
        raise ValueError("no complete row")
    return products_of_sizes(d, group, sizes)


def lmm(df: DataFrame, y: str, d: Design, group: str, reml: bool = True) -> Model:
    """Random-intercept model of all columns of a design."""
    return cross_products(df, y, d, group).fit(reml=reml)
