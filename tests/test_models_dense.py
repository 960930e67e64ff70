"""Registered model queries without SQL against dense matrices in numpy, at the smallest size."""

import math

import numpy as np
import pytest

from conftest import DATA
from sensorloom.operators import numerics as U
from sensorloom.plans import catalog
from sensorloom.plans.views import flux

SF = f"{DATA}/sf0.001"


def rows_of(spark, name):
    return [r.asDict() for r in catalog.QUERIES[name](spark, SF).collect()]


@pytest.fixture(scope="module")
def f(spark):
    d = flux(spark, SF).toPandas()
    d["hour_of_day"] = d["ts"].dt.hour.astype(float)
    return d.sort_values("event_id").reset_index(drop=True)


def dummies(values, levels):
    return np.stack([(values == x).astype(float) for x in levels[1:]], axis=1)


def dense(y, x, group, reml=True):
    """Theta, log-likelihood, coefficients, their covariance, residual variance and weighted residuals of a random-intercept model, from the eigenvectors of the whole covariance matrix."""
    z = (np.asarray(group)[:, None] == np.unique(group)[None, :]).astype(float)
    values, q = np.linalg.eigh(z @ z.T)
    values, n, p = np.maximum(values, 0), len(y), x.shape[1]
    qy, qx = q.T @ y, q.T @ x

    def fit(theta):
        d = 1 + theta * values
        xx = qx.T @ (qx / d[:, None])
        beta = np.linalg.solve(xx, qx.T @ (qy / d))
        r = qy - qx @ beta
        free = n - p if reml else n
        s2 = float((r * r / d).sum()) / free
        ll = -0.5 * (free * (math.log(2 * math.pi * s2) + 1) + np.log(d).sum() + (np.linalg.slogdet(xx)[1] if reml else 0))
        return ll, beta, s2 * np.linalg.inv(xx), s2, q @ (r / d), z

    grid = np.concatenate([[0.0], np.logspace(-5, 2, 15)])
    for _ in range(10):
        best = int(np.argmax([fit(t)[0] for t in grid]))
        grid = np.linspace(grid[max(best - 1, 0)], grid[min(best + 1, len(grid) - 1)], 9)
    theta = float(grid[int(np.argmax([fit(t)[0] for t in grid]))])
    return theta, *fit(theta)


def test_random_intercepts(spark, f):
    y, h, wet = f["value"].to_numpy(), f["hour_of_day"].to_numpy(), (f["site"] == "Wetland").to_numpy(float)
    x = np.stack([np.ones(len(y)), h, wet, h * wet], axis=1)
    _, _, beta, vcov, *_ = dense(y, x, f["tree"])
    got = {r["term"]: r for r in rows_of(spark, "lmm_fit")}
    for i, term in enumerate(("(Intercept)", "hour_of_day", "siteWetland", "hour_of_day:siteWetland")):
        assert got[term]["estimate"] == pytest.approx(beta[i], abs=2e-4) and got[term]["se"] == pytest.approx(math.sqrt(vcov[i, i]), rel=2e-3)

    x = np.stack([np.ones(len(y)), h], axis=1)
    theta, _, beta, _, s2, vr, z = dense(y, x, f["tree"])
    u = dict(zip(np.unique(f["tree"]).tolist(), (theta * z.T @ vr).tolist(), strict=True))
    for r in rows_of(spark, "blups"):
        assert r["blup"] == pytest.approx(u[r["tree"]], abs=max(1e-3, 0.01 * math.sqrt(theta * s2)))

    ones = np.ones((len(y), 1))
    mixed, fixed = dense(y, ones, f["tree"], reml=False)[1], -len(y) / 2 * (math.log(2 * math.pi * y.var()) + 1)
    got = rows_of(spark, "lrt_random")[0]
    assert got["loglik_mixed"] == pytest.approx(mixed, abs=1e-3) and got["loglik_fixed"] == pytest.approx(fixed, abs=1e-4)
    assert got["p"] == pytest.approx(math.erfc(math.sqrt(max(mixed - fixed, 0))), abs=2e-3)


def test_repeatability_by_site(spark, f):
    for r in rows_of(spark, "icc"):
        own = f[(f["site"] == r["site"]) & f["reading"].notna()]
        theta = dense(own["reading"].to_numpy(), np.ones((len(own), 1)), own["tree"])[0]
        assert r["icc"] == pytest.approx(theta / (1 + theta), abs=1e-3) and r["n"] == len(own)
    one = rows_of(spark, "repeatability")[0]
    own = f[f["reading"].notna()]
    theta = dense(own["reading"].to_numpy(), np.ones((len(own), 1)), own["tree"])[0]
    assert one["icc"] == pytest.approx(theta / (1 + theta), abs=1e-3)
    assert one["lower"] <= one["icc"] + 1e-9 <= one["upper"] + 1e-6 and 1 / 1001 <= one["p"] <= 1


def test_marginal_means(spark, f):
    species, wet = sorted(f["species"].unique()), (f["site"] == "Wetland").to_numpy(float)
    d = dummies(f["species"].to_numpy(), species)
    x = np.concatenate([np.ones((len(f), 1)), d, wet[:, None], d * wet[:, None]], axis=1)
    beta = dense(f["value"].to_numpy(), x, f["tree"])[2]
    got = {(r["within"], r["level"]): r["emmean"] for r in rows_of(spark, "emmeans")}
    assert len(got) == 2 * len(species)
    for w, on in (("Upland", 0.0), ("Wetland", 1.0)):
        for k, s in enumerate(species):
            e = np.eye(len(species))[k][1:]
            assert got[w, s] == pytest.approx(float(np.concatenate([[1.0], e, [on], e * on]) @ beta), abs=2e-3)


@pytest.fixture(scope="module")
def metrics(spark):
    return catalog._metrics(spark, SF).toPandas().sort_values("vec_id")


def test_forward_selection(spark, metrics):
    y = metrics["d0"].to_numpy()

    def r2(cols):
        x = np.concatenate([np.ones((len(y), 1)), metrics[cols].to_numpy()], axis=1)
        return 1 - ((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum() / ((y - y.mean()) ** 2).sum()

    chosen = ["d1"]
    for r in sorted(rows_of(spark, "forward_select"), key=lambda r: r["step"]):
        best = max((c for c in (f"d{i}" for i in range(2, 8)) if c not in chosen), key=lambda c: r2([*chosen, c]))
        chosen.append(best)
        assert r["variable"] == best and r["r2"] == pytest.approx(r2(chosen), abs=1e-6)
    assert len(chosen) == 7


def test_components(spark, metrics):
    cols = [f"d{i}" for i in range(8)]
    g = metrics.groupby("label")[cols]
    z = ((metrics[cols] - g.transform("mean")) / g.transform("std")).fillna(0.0).to_numpy()
    values, vectors = np.linalg.eigh(z.T @ z / (len(z) - 1))
    vectors = vectors[:, np.argsort(values)[::-1][:2]]
    vectors = vectors * np.where(vectors[0] < 0, -1, 1)
    got = sorted(rows_of(spark, "pca_scores"), key=lambda r: r["vec_id"])
    assert np.allclose([[r["pc1"], r["pc2"]] for r in got], z @ vectors, atol=1e-5)


def test_prediction_grid(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_extendedprice", "l_quantity", "l_discount", "l_returnflag").toPandas()
    flags, y = sorted(li["l_returnflag"].unique()), li["l_extendedprice"].to_numpy()

    def matrix(q, z, flag):
        d = dummies(np.asarray(flag), flags)
        base = np.stack([np.ones(len(q)), q, z, q * z], axis=1)
        return np.concatenate([base, *(base * d[:, [k]] for k in range(d.shape[1]))], axis=1)

    x = matrix(li["l_quantity"].to_numpy(), li["l_discount"].to_numpy(), li["l_returnflag"].to_numpy())
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    s2 = ((y - x @ beta) ** 2).sum() / (len(y) - x.shape[1])
    cov = s2 * np.linalg.inv(x.T @ x)
    got = rows_of(spark, "prediction_grid")
    at = matrix(np.array([r["l_quantity"] for r in got]), np.array([r["l_discount"] for r in got]), np.array([r["l_returnflag"] for r in got]))
    assert len(got) == 3 * len(flags) * 100
    assert np.allclose([r["fit"] for r in got], at @ beta, rtol=1e-5, atol=0.05)
    assert np.allclose([r["se"] for r in got], np.sqrt(np.einsum("ij,jk,ik->i", at, cov, at)), rtol=1e-3)
    for p in (0.1, 0.5, 0.9):
        assert {round(r["l_discount"], 6) for r in got if r["percentile"] == p} == {round(float(np.quantile(li["l_discount"], p)), 6)}


def test_student_quantiles():
    for df in (1, 2, 5, 30, 300):
        for p in (0.95, 0.975, 0.995):
            assert 1 - U.t_p(U.t_quantile(p, df), df) / 2 == pytest.approx(p, abs=1e-9)
    assert U.t_quantile(0.975, 1) == pytest.approx(math.tan(math.pi * 0.475), rel=1e-9)
    assert U.t_quantile(0.975, 2) == pytest.approx(0.95 * math.sqrt(2 / (1 - 0.95**2)), rel=1e-9)
