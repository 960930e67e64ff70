"""Models from one aggregate, permuted repeatability, per-group predictions and mixed Gamma models against dense fits."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import fits as T
from sensorloom.operators import models as M
from test_models_dense import dense, dummies


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(11)
    n = 240
    d = pd.DataFrame({"k": range(n), "e": rng.integers(0, 18, n).astype(str), "f": rng.choice(list("uvw"), n), "a": rng.normal(0, 1, n), "b": rng.normal(0, 1, n), "c": rng.normal(0, 1, n)})
    d["dup"] = d["a"] + 0.01 * rng.normal(0, 1, n)
    u = dict(zip(sorted(set(d["e"])), rng.normal(0, 1.2, 18), strict=True))
    d["y"] = 2 + 1.5 * d["a"] - 0.8 * d["b"] * (d["f"] == "v") + d["e"].map(u) + rng.normal(0, 0.7, n)
    return d


@pytest.fixture(scope="module")
def df(spark, frame):
    return spark.createDataFrame(frame).repartition(3).cache()


def matrix(frame, terms):
    """Columns of plain terms, factors by treatment, and products ``x:f``."""
    out = [np.ones((len(frame), 1))]
    for t in terms:
        part = np.ones((len(frame), 1))
        for p in t.split(":"):
            own = dummies(frame[p].to_numpy(), sorted(frame[p].unique())) if p == "f" else frame[[p]].to_numpy()
            part = np.concatenate([part * own[:, [j]] for j in range(own.shape[1])], axis=1)
        out.append(part)
    return np.concatenate(out, axis=1)


@pytest.mark.parametrize("reml", [False, True])
def test_sub_models_are_the_separate_fits(df, frame, reml):
    d = M.design(df, ["a*f", "b*f", "c"], ["f"])
    sums = M.cross_products(df, "y", d, "e")
    for terms in ([], ["a"], ["f", "a"], ["a", "f", "a:f", "c"], ["a", "f", "a:f", "b", "b:f", "c"]):
        x = matrix(frame, terms)
        theta, ll, beta, vcov, s2, *_ = dense(frame["y"].to_numpy(), x, frame["e"], reml)
        m = sums.fit(d.names(terms), reml=reml)
        at = [m.names.index(c) for c in order_of(d, terms)]
        assert m.loglik == pytest.approx(ll, abs=1e-4) and m.sigma2 == pytest.approx(s2, rel=2e-3)
        assert np.allclose(m.beta[at], beta, atol=2e-3) and np.allclose(m.vcov[np.ix_(at, at)], vcov, atol=2e-3)
        fixed = x @ beta
        assert sums.marginal_r2(m) == pytest.approx(fixed.var() / frame["y"].var(ddof=0), abs=2e-3)


def order_of(d, terms):
    return ["(Intercept)", *(n for t in terms for n in d.columns if d.term[n] == t)]


def test_large_constants_cost_no_digits(df):
    far = df.withColumns({"y": F.col("y") + 1e8, "a": F.col("a") + 1e8})
    for fit in (lambda d: M.ols(d, "y", M.design(d, ["a", "b"])), lambda d: M.lmm(d, "y", M.design(d, ["a", "b"]), "e")):
        near, moved = fit(df), fit(far)
        assert np.allclose(near.beta[1:], moved.beta[1:], atol=1e-6) and moved.sigma2 == pytest.approx(near.sigma2, rel=1e-5) and moved.tss == pytest.approx(near.tss, rel=1e-6)


def test_one_scan_for_all_candidates(df, monkeypatch):
    calls, original = [], M.cross_products
    monkeypatch.setattr(M, "cross_products", lambda *a: calls.append(1) or original(*a))
    M.addition_tests(df, "y", ["f"], ["a", "b", "c"], "e", "f", ["f"])
    M.interaction_screen(df, "y", ["f", "a", "b"], [("a", "f"), ("b", "f"), ("a", "b")], "e", ["f"])
    assert len(calls) == 2


def aic(frame, terms):
    x = matrix(frame, terms)
    ll = dense(frame["y"].to_numpy(), x, frame["e"], False)[1]
    return 2 * (x.shape[1] + 2) - 2 * ll, math.log(len(frame)) * (x.shape[1] + 2) - 2 * ll


def test_additions_and_bic_step(df, frame):
    base = ["f"]
    got = {(r["variable"], r["kind"]): r for r in M.addition_tests(df, "y", base, ["a", "b", "c"], "e", "f", ["f"]).collect()}
    small = aic(frame, base)
    for (v, kind), r in got.items():
        own = aic(frame, [*base, v] if kind == "main" else [*base, v, f"{v}:f"])
        assert r["delta_aic"] == pytest.approx(own[0] - small[0], abs=1e-3) and r["delta_bic"] == pytest.approx(own[1] - small[1], abs=1e-3)
    table, chosen = M.bic_step(df, "y", base, ["a", "b", "c"], "e", "f", ["f"])
    rows = {r["model"]: r for r in table.collect()}
    assert rows["extended"]["terms"] == "f + b*f + a" or rows["extended"]["terms"] == "f + a + b*f"
    assert rows["extended"]["bic"] == pytest.approx(aic(frame, ["f", "a", "b", "b:f"])[1], abs=1e-3)
    assert rows["extended"]["accepted"] and not rows["core"]["accepted"] and "a" in chosen.names
    kept, _ = M.bic_step(df, "y", ["a", "b*f"], ["c"], "e", "f", ["f"])
    assert {r["model"]: r["accepted"] for r in kept.collect()} == {"core": True, "extended": False}


def test_selection_by_marginal_r2(df, frame):
    got = M.forward_select(df, "y", ["f"], ["a", "b", "c"], group="e", factors=["f"]).collect()
    chosen = ["f"]

    def r2(terms):
        x = matrix(frame, terms)
        return (x @ dense(frame["y"].to_numpy(), x, frame["e"], False)[2]).var() / frame["y"].var(ddof=0)

    for r in got:
        best = max((c for c in "abc" if c not in chosen), key=lambda c: r2([*chosen, c]))
        chosen.append(best)
        assert r["variable"] == best and r["r2"] == pytest.approx(r2(chosen), abs=2e-3)
    assert chosen[1] == "a"
    freq = {r["variable"]: r for r in M.selection_frequency(df, "k", "y", ["f"], ["a", "b", "c"], steps=1, runs=12, group="e", factors=["f"]).collect()}
    assert freq["a"]["frequency"] == 1.0 and freq["a"]["consensus"] and freq["c"]["n"] == 0


def test_weighted_entities_are_repeated_ones(spark, df):
    """A run's sums are those of a table in which drawn entities stand as often as drawn."""
    d = M.design(df, ["a"])
    entities, made = T.entity_products(df, "y", d, "e")
    weight = (F.col("e").cast("int") % 3).cast("int")
    sizes = T.sized_products(entities, len(made), (), weight).orderBy("m").collect()
    got = T.products_of_sizes(d, "e", sizes).fit()
    again = df.withColumn("w", F.explode(F.expr("sequence(1, 2)"))).where(F.col("w") <= F.col("e").cast("int") % 3).withColumn("e", F.concat_ws("-", "e", "w"))
    want = M.lmm(again, "y", d, "e", reml=False)
    assert got.n == want.n and got.loglik == pytest.approx(want.loglik, abs=1e-6) and np.allclose(got.beta, want.beta, atol=1e-6)


def test_collinear_terms_are_dropped(df):
    table, m = M.drop_collinear(df, "y", ["a", "dup", "b", "f"], "e", ["f"], keep=["a", "f"])
    rows = table.collect()
    assert [r["term"] for r in rows if r["dropped"]] == ["dup"] and "dup" not in m.names
    assert {r["step"] for r in rows} == {0, 1} and max(r["gvif"] for r in rows if r["step"] == 1) < 2


def test_a_saved_model_predicts(spark, df, tmp_path):
    d = M.design(df, ["a*f"], ["f"])
    m = M.lmm(df, "y", d, "e")
    M.save_model(m, spark, str(tmp_path / "m"))
    again = M.restore_model(spark, str(tmp_path / "m"))
    assert again.names == m.names and np.array_equal(again.vcov, m.vcov) and again.term == m.term and (again.aic, again.group, again.n_groups) == (m.aic, "e", m.n_groups)
    diff = df.select(F.max(F.abs(M.predict_column(m, d) - M.predict_column(again, d))).alias("x")).first()["x"]
    assert diff == 0
    stars = {r["term"]: (r["p"], r["stars"]) for r in m.coefficients(spark).collect()}
    assert stars["a"][0] < 1e-6 and stars["a"][1] == "***"


# --- permutations


def test_positions_and_permutations(spark):
    d = spark.range(1000).select(F.col("id").alias("_k"))
    p = {r["_k"]: r["position"] for r in M.positions(d, "_k", 1000, bucket_rows=50).collect()}
    assert sorted(p.values()) == list(range(1000)) and sum(k == v for k, v in p.items()) < 20
    for n in (1, 2, 12, 1000):
        for run in range(20):
            a, b = M.affine(run, n)
            assert sorted((a * i + b) % n for i in range(n)) == list(range(n))


@pytest.mark.parametrize("held", [1 << 22, 0])
def test_permuted_sums_by_brute_force(spark, held):
    rng = np.random.default_rng(4)
    sizes, v = [(1, 3), (2, 2), (5, 4)], rng.normal(0, 1, 27)
    placed = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "position bigint, v double").repartition(4)
    got = {(r["run"], r["m"], r["e"]): r["s"] for r in M.permuted_sums(placed, sizes, 27, range(5, 9), held).collect()}
    owner = [(m, e) for m, k in sizes for e in range(k) for _ in range(m)]
    want = {}
    for run in range(5, 9):
        a, b = M.affine(run, 27)
        for i, x in enumerate(v):
            key = (run, *owner[(a * i + b) % 27])
            want[key] = want.get(key, 0) + x
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_permuted_sums_are_not_shuffled(spark):
    """A sum is one task's own, whether tasks have some runs or ranges of a run's entities; values come in several blocks."""
    rng = np.random.default_rng(5)
    sizes = [(1, 30), (3, 40), (7, 10)]
    placed = spark.createDataFrame([(i, float(x)) for i, x in enumerate(rng.normal(0, 1, 220))], "position bigint, v double").repartition(6)
    found = []
    for held in (1 << 22, 80, 33):
        sums = M.permuted_sums(placed, sizes, 220, range(3, 9), held, together=50)
        assert "Exchange" not in sums._jdf.queryExecution().executedPlan().toString()
        rows = sums.collect()
        assert len(rows) == len({(r["run"], r["m"], r["e"]) for r in rows}) == 6 * 80
        found.append({(r["run"], r["m"], r["e"]): r["s"] for r in rows})
    for other in found[1:]:
        assert other.keys() == found[0].keys() and all(other[k] == pytest.approx(x, abs=1e-12) for k, x in found[0].items())


def test_repeatability_tells_groups_from_noise(spark):
    rng = np.random.default_rng(9)
    rows = [(i, i % 12, float(3 * rng.normal() if i < 12 else 0)) for i in range(120)]
    means = {e: rng.normal(0, 2) for e in range(12)}
    d = spark.createDataFrame([(i, e, means[e] + float(rng.normal())) for i, e, _ in rows], "k int, e int, y double")
    strong = M.repeatability(d, "k", "e", "y", nboot=50, nperm=99).first()
    noise = M.repeatability(d.withColumn("y", F.rand(3)), "k", "e", "y", nboot=50, nperm=99).first()
    assert strong["p"] == 0.01 and strong["icc"] > 0.5 and noise["p"] > 0.05 and strong["lower"] < strong["icc"] < strong["upper"]
    assert M.repeatability(d.limit(0), "k", "e", "y", nboot=5, nperm=5).count() == 0


def test_exchange_buckets_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET_ROWS", 100)
    d = spark.range(5000).select(F.col("id").alias("k"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("label"))
    out = M.exchanged(d, ["x"], "k", 5000)
    got = out.collect()
    assert sorted(r["_o_x"] for r in got) == sorted(r["x"] for r in got) and sum(r["_o_x"] == r["x"] for r in got) < 60
    sizes = d.groupBy(F.pmod(F.xxhash64("k"), F.lit(5000 // 100 + 1))).count().agg(F.max("count")).first()[0]
    assert sizes < 200


# --- predictions by group


def test_predictions_by_group(spark):
    rng = np.random.default_rng(6)
    parts = {"g": 200, "h": 60, None: 40, "few": 29}
    d = pd.concat([pd.DataFrame({"s": [g] * n, "x": rng.uniform(0, 10, n), "z": rng.normal(0, 1, n).round(1)}) for g, n in parts.items()])
    d["y"] = np.exp(0.1 * d["x"] - 0.2 * d["z"] + rng.normal(0, 0.3, len(d)))
    got = M.fit_by_group(spark.createDataFrame(d.where(d.notna(), None)), ["s"], "y", "x", "z", probs=(0.1, 0.5, 0.9), steps=5).toPandas()
    assert len(got) == 3 * 3 * 5
    for g in ("g", "h", None):
        own = d[d["s"].isna() if g is None else d["s"] == g]
        m = np.stack([np.ones(len(own)), own["x"], own["z"], own["x"] * own["z"]], axis=1)
        y = np.log(own["y"].to_numpy() + 0.01)
        beta = np.linalg.lstsq(m, y, rcond=None)[0]
        cov = ((y - m @ beta) ** 2).sum() / (len(own) - 4) * np.linalg.inv(m.T @ m)
        q = np.quantile(own["z"], [0.1, 0.5, 0.9])
        edges = [-np.inf, (q[0] + q[1]) / 2, (q[1] + q[2]) / 2, np.inf]
        mine = got[got["s"].isna() if g is None else got["s"] == g].sort_values(["percentile", "step"])
        for i, p in enumerate((0.1, 0.5, 0.9)):
            near = own["x"][(own["z"] >= edges[i]) & (own["z"] <= edges[i + 1])]
            a, b = np.quantile(near if len(near) >= 10 else own["x"], [0.05, 0.95])
            at = np.linspace(a, b, 5)
            row = np.stack([np.ones(5), at, np.full(5, q[i]), at * q[i]], axis=1)
            r = mine[mine["percentile"] == p]
            fit, se = row @ beta, np.sqrt(np.einsum("ij,jk,ik->i", row, cov, row))
            assert np.allclose(r["x"], at) and np.allclose(r["log_fit"], fit) and np.allclose(r["log_se"], se)
            assert np.allclose(r["upper"], np.exp(fit + 1.96 * se) - 0.01) and np.allclose(r["fit"], np.exp(fit) - 0.01)


def test_back_transform(spark):
    d = spark.createDataFrame([(1.0, 0.5)], "fit double, se double")
    r = M.back_transform(d, F.sinh).first()
    assert (r["response"], r["lower"], r["upper"]) == pytest.approx((math.sinh(1), math.sinh(1 - 0.98), math.sinh(1 + 0.98)))


def test_gamma_with_date_intercepts(spark):
    """Against penalised quasi-likelihood with a row for each observation and the whole covariance matrix."""
    rng = np.random.default_rng(8)
    n = 300
    d = pd.DataFrame({"day": rng.integers(0, 25, n).astype(str), "f": rng.choice(list("uv"), n), "s": rng.choice(list("pq"), n)})
    u = dict(zip(sorted(set(d["day"])), rng.normal(0, 0.5, 25), strict=True))
    d["y"] = rng.gamma(4, np.exp(1 + 0.5 * (d["f"] == "v") - 0.3 * (d["s"] == "q") + d["day"].map(u)) / 4)
    rows = spark.createDataFrame(d).unionByName(spark.createDataFrame([("1", "u", "p", -1.0), (None, "u", "p", 2.0), ("1", None, "p", 2.0)], "day string, f string, s string, y double"))
    coef, summary = M.gamma_mixed(rows, "y", ["f", "s"], "day")
    fv, sq = (d["f"] == "v").to_numpy(float), (d["s"] == "q").to_numpy(float)
    x, y = np.stack([np.ones(n), fv, sq, fv * sq], axis=1), d["y"].to_numpy()
    days = sorted(set(d["day"]))
    z = (d["day"].to_numpy()[:, None] == np.array(days)[None, :]).astype(float)
    cell = d.groupby(["day", "f", "s"])["y"].transform("mean").to_numpy()
    eta = np.log(cell)
    for _ in range(60):
        work = eta + (y - np.exp(eta)) / np.exp(eta)
        theta, _, beta, vcov, s2, vr, _ = dense(work, x, d["day"], reml=False)
        eta = x @ beta + z @ (theta * z.T @ vr)
    got = {r["term"]: r for r in coef.collect()}
    for i, name in enumerate(("(Intercept)", "fv", "sq", "fv:sq")):
        assert got[name]["estimate"] == pytest.approx(beta[i], abs=2e-3) and got[name]["se"] == pytest.approx(math.sqrt(vcov[i, i]), rel=2e-2)
    one = summary.first()
    assert one["n"] == n and one["n_dates"] == 25 and one["dispersion"] == pytest.approx(s2, rel=1e-2) and one["sigma2_date"] == pytest.approx(theta * s2, rel=2e-2)
    assert M.gamma_mixed(rows.limit(0), "y", ["f", "s"], "day")[0].count() == 0
