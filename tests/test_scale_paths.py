"""The forms for large groups and long series, forced at small sizes, against plain ones."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sensorloom.operators import joins as J
from sensorloom.operators import quality as Q
from sensorloom.operators import quantiles as X
from sensorloom.operators import series as Z
from sensorloom.operators import stats as K
from sensorloom.operators import windows as W


@pytest.fixture
def short_chunks(monkeypatch):
    monkeypatch.setattr(Z, "PLAIN_ROWS", 20)
    monkeypatch.setattr(Z, "CHUNK_ROWS", 7)
    monkeypatch.setattr(Z, "BINS", 8)
    monkeypatch.setattr(Z, "PER_BIN", 2)


@pytest.fixture(scope="module")
def long_series(spark):
    rng = random.Random(1)
    rows = [(s, t, rng.choice([None, rng.gauss(0, 1)]), rng.choice("hhhln")) for s, n in (("a", 400), ("b", 15), (None, 90)) for t in rng.sample(range(1000), n)]
    return spark.createDataFrame(rows, "s string, t int, x double, state string").repartition(3).cache()


def rows(df, *cols):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect()), key=str)


def test_positions_and_halos(spark, long_series, short_chunks):
    c = Z.chunks(long_series, ["s"], ["t"], 5).rows.collect()
    own = [r for r in c if not r["_halo"]]
    assert len(own) == long_series.count()
    for s in ("a", "b", None):
        mine = sorted((r for r in own if r["s"] == s), key=lambda r: r["t"])
        assert [r["_pos"] for r in mine] == list(range(1, len(mine) + 1))
        for k in {r["_chunk"] for r in mine if r["_chunk"]}:
            assert sorted(r["_pos"] for r in c if r["s"] == s and r["_chunk"] == k and r["_halo"]) == [7 * k - i for i in range(4, -1, -1)]
    assert max(r["_chunk"] for r in own) == 57


@pytest.mark.parametrize("n", [1, 3, 30])
def test_rolling_frames_over_chunks(spark, long_series, short_chunks, n):
    w = Window.partitionBy("s").orderBy("t").rowsBetween(-(n - 1), 0)
    full = F.row_number().over(Window.partitionBy("s").orderBy("t")) >= n
    want = long_series.select("s", "t", F.when(full, F.avg("x").over(w)).alias("m"), F.when(full, F.coalesce(F.sum("x").over(w), F.lit(0.0))).alias("u"), F.when(full, F.stddev_samp("x").over(w)).alias("d"), F.when(F.count("x").over(w) == n, F.avg("x").over(w)).alias("k"))
    for name, got in (("m", W.roll_mean(long_series, ["s"], "t", "x", n)), ("u", W.roll_sum(long_series, ["s"], "t", "x", n)), ("d", W.roll_sd(long_series, ["s"], "t", "x", n)), ("k", W.roll_mean(long_series, ["s"], "t", "x", n, strict=True))):
        assert rows(got, "s", "t", "roll") == rows(want, "s", "t", name)


def test_runs_differences_and_last_values_over_chunks(spark, long_series, short_chunks, monkeypatch):
    long_runs = long_series.withColumn("state", F.when(F.col("t") < 600, "h").otherwise(F.col("state")))
    small = [W.episodes(long_runs, ["s"], "t", "state"), W.first_difference(long_series, ["s"], ["t"], "x"), Q.allan_sd(long_series, ["s"], ["t"], ["x"])]
    got = [rows(d, *d.columns) for d in small]
    right = long_series.select("s", F.col("t").alias("t"), (F.col("t") * 2.0).alias("v")).where("t % 3 = 0")
    left = long_series.select("s", (F.col("t") + 1).alias("t"), F.col("x"))
    asof = J.join_asof(left, right, "t", ["s"], ["v"])
    found = rows(asof, "s", "t", "v")
    monkeypatch.setattr(Z, "PLAIN_ROWS", 10**9)
    plain = [W.episodes(long_runs, ["s"], "t", "state"), W.first_difference(long_series, ["s"], ["t"], "x"), Q.allan_sd(long_series, ["s"], ["t"], ["x"])]
    assert got == [rows(d, *d.columns) for d in plain] and max(r[5] if len(r) > 5 else 0 for r in got[0]) >= 0
    assert found == rows(J.join_asof(left, right, "t", ["s"], ["v"]), "s", "t", "v")
    times = {}
    for r in right.collect():
        times.setdefault(r["s"], []).append((r["t"], r["v"]))
    for s, t, v in found:
        before = [p for p in times.get(s, []) if p[0] <= t]
        assert v == (max(before)[1] if before else None)


def test_means_in_order_over_chunks(spark, long_series, short_chunks, monkeypatch):
    got = W.means_in_order(long_series, ["s"], ["t"], m=F.col("x"), few=F.when(F.col("t") < 30, F.col("x")), none=F.lit(None).cast("double"))
    found = rows(got, "s", "m", "few", "none")
    assert found == rows(long_series.groupBy("s").agg(F.avg("x").alias("m"), F.avg(F.when(F.col("t") < 30, F.col("x"))).alias("few"), F.lit(None).alias("none")), "s", "m", "few", "none")
    monkeypatch.setattr(Z, "PLAIN_ROWS", 10**9)
    assert found == rows(W.means_in_order(long_series, ["s"], ["t"], m=F.col("x"), few=F.when(F.col("t") < 30, F.col("x")), none=F.lit(None).cast("double")), "s", "m", "few", "none")


@pytest.mark.parametrize("held", [10, 10**9])
def test_allan_of_intervals_equals_that_of_pairs(spark, monkeypatch, held):
    """Overlapping intervals, empty ones, such without a key's group, a key that stands twice, NULLs, NaN, a spike and a far constant; whole series and bins of them."""
    from sensorloom.operators import intervals as I

    monkeypatch.setattr(I, "HELD_ROWS", held)
    monkeypatch.setattr(Z, "BINS", 8)
    monkeypatch.setattr(Z, "PER_BIN", 2)
    rng = random.Random(4)
    at = lambda s: f"2024-01-01 {s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}"
    x = lambda i: 1e12 if i == 100 else math.nan if i == 300 else rng.choice([None, rng.gauss(0, 1), rng.gauss(0, 1)])
    data = [(rng.choice(["m", "n", None]), at(rng.randrange(9000)), i, x(i), None if i < 390 else 1e8 + i) for i in range(400)]
    samples = spark.createDataFrame(data, "g string, ts string, line int, x double, y double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).repartition(3)
    spans = [(k if k < 190 else 7, rng.choice(["m", "n", "o", None]), a := rng.randrange(9000), a + rng.choice([0, 9, 700, 3000, 9000, -5])) for k in range(200)]
    iv = spark.createDataFrame([(k, g, at(a), at(b)) for k, g, a, b in spans], "k int, g string, start_ts string, end_ts string").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start_ts", "end_ts")})
    got = {r["k"]: r for r in Q.interval_allan(samples, iv, ["g"], "k", ["ts", "line"], ["x", "y"]).collect()}
    pairs = iv.alias("i").join(samples.alias("s"), F.expr("i.g = s.g and s.ts between i.start_ts and i.end_ts")).select("k", "ts", "line", "x", "y")
    found = {}
    for r in sorted(pairs.collect(), key=lambda r: (r["ts"], r["line"])):
        found.setdefault(r["k"], []).append(r)
    assert got.keys() == found.keys() and len(got) > 40
    for k, rs in found.items():
        assert got[k]["n"] == len(rs)
        for c in "xy":
            d = np.diff([r[c] for r in rs if r[c] is not None])
            if len(d) < 2:
                assert got[k][f"allan_sd_{c}"] is None
            else:
                assert got[k][f"allan_sd_{c}"] == pytest.approx(d.std(ddof=1) / math.sqrt(2), rel=1e-9, nan_ok=True)


def test_allan_of_intervals_makes_no_pairs(spark):
    from conftest import DATA
    from sensorloom.plans import catalog

    plan = catalog.QUERIES["interval_allan"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
    plan = catalog.QUERIES["allan_by_interval"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan and "Window" not in plan and plan.count("FlatMapCoGroups") == 1


def test_nearest_rows_by_brute_force_without_pairs(spark):
    """Equal gaps before and after, several rows at one time, NULL groups and times, gaps of just the tolerance."""
    rng = random.Random(6)
    group, when = lambda: rng.choice(["a", "b", None]), lambda: rng.choice([None, *range(0, 2000, 10)])
    ls, rs = [(k, group(), when(), f"x{k}") for k in range(300)], [(rng.randrange(50), group(), when(), float(i)) for i in range(200)]
    at = lambda c: F.timestamp_seconds(c).cast("timestamp_ntz")
    left = spark.createDataFrame(ls, "k int, g string, t int, x string").withColumn("ts", at("t")).repartition(3)
    right = spark.createDataFrame(rs, "tie int, g string, t int, v double").withColumn("rts", at("t")).drop("t").repartition(3)
    out = J.join_nearest(left, right, "k", ["g"], "ts", "rts", 60, "tie")
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["k"]: r for r in out.collect()}
    assert len(got) == len(ls) and out.columns == ["k", "g", "t", "x", "ts", "tie", "v", "rts", "gap_s"]
    for k, g, t, x in ls:
        near = [(abs(t - u), tie, v) for tie, h, u, v in rs if g is not None and g == h and t is not None and u is not None and abs(t - u) <= 60]
        assert (got[k]["g"], got[k]["t"], got[k]["x"]) == (g, t, x)
        assert (got[k]["gap_s"], got[k]["tie"], got[k]["v"]) == (min(near) if near else (None, None, None))
    assert sum(r["tie"] is not None for r in got.values()) > 100


def test_intervals_with_fallback_shuffle_samples_once(spark):
    rng = random.Random(8)
    at = lambda s: f"2024-01-{1 + s // 86400:02d} {s // 3600 % 24:02d}:{s // 60 % 60:02d}:00"
    some = lambda: rng.choice(["m", "n", None])
    ss, spans = [(i, some(), at(rng.randrange(172_800))) for i in range(300)], [(k, rng.choice(["m", "n", "o", None]), a := rng.randrange(86_400 * 3), a + rng.choice([0, 600, 9000])) for k in range(60)]
    cast = lambda df, *cs: df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cs})
    samples = cast(spark.createDataFrame(ss, "i int, g string, ts string"), "ts").withColumn("day", F.to_date("ts"))
    samples = samples.where("g is null or g <> 'n' or day = '2024-01-01'").cache()
    iv = cast(spark.createDataFrame([(k, g, at(a), at(b)) for k, g, a, b in spans], "k int, g string, start_ts string, end_ts string"), "start_ts", "end_ts").withColumn("day", F.to_date("start_ts"))
    out = J.assign_with_fallback(samples, iv, "g", "day")
    assert out.columns == ["g", "day", "i", "ts", "k", "start_ts", "end_ts"]
    rows, logs = samples.collect(), iv.collect()
    seen = {(r["g"], r["day"]) for r in rows if r["g"] is not None}
    want = sorted((r["i"], v["k"], str(v["g"])) for v in logs for r in rows if r["day"] == v["day"] and v["start_ts"] <= r["ts"] <= v["end_ts"] and (r["g"] == v["g"] or (v["g"], v["day"]) not in seen))
    assert sorted((r["i"], r["k"], str(r["g"])) for r in out.collect()) == want and len(want) > 100 and {g for *_, g in want} == {"m", "n", "o", "None"}
    # of the exchanges' inputs, those with the samples' own column
    said = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = said(J.assign_with_fallback(samples, iv, "g", "day")._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sum("i#" in c for c in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]", plan)) == 1


def test_ties_of_right_rows_are_settled(spark):
    left = spark.createDataFrame([(1,)], "t int")
    right = spark.createDataFrame([(1, 5.0), (1, 7.0), (1, 6.0), (0, 9.0)], "t int, v double").repartition(4)
    assert [r["v"] for r in J.join_asof(left, right, "t", [], ["v"]).collect()] == [7.0]


def heavy(n, seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([np.exp(rng.normal(0, 6, n)), [1e18, -1e18], np.zeros(n // 10), -rng.pareto(0.3, n // 4)])
    rng.shuffle(x)
    return x


def test_bins_of_heavy_tails_are_even(spark):
    """100,000 values and far ones: no bin holds over four times the mean."""
    x = heavy(100_000, 3)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    found = X.binned_values(df, [], "x", large=1000).groupBy("bin").count().collect()
    sizes = [r["count"] for r in found]
    assert len(sizes) > 200 and max(sizes) <= 4 * len(np.unique(x)) / len(sizes)


def test_ranks_of_large_groups(spark):
    x = {"a": heavy(3000, 1), "b": heavy(50, 2), "c": np.repeat([1.0, 2.0], 2000)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in x.items() for v in vs] + [("a", None)], "g string, x double")
    for large in (100, 10**9):
        got = {(r["g"], r["x"]): (r["c"], r["before"], r["n"]) for r in X.value_ranks(df, ["g"], "x", large=large).collect()}
        want = {(g, float(v)): (int((vs == v).sum()), int((vs < v).sum()), len(vs)) for g, vs in x.items() for v in np.unique(vs)}
        assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_quantiles_of_heavy_tails_are_exact(spark, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(X, "ACCURACY", 100)
    rng = np.random.default_rng(seed)
    x = {"a": heavy(40_000, seed), "b": heavy(20, 7), "c": np.array([3.0]), "d": np.repeat([1.0, 2.0, 2.0], 7000), "e": rng.integers(0, 5, 9000).astype(float)}
    probs = [0.0, 0.001, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]
    df = spark.createDataFrame([(g, float(v)) for g, vs in x.items() for v in vs] + [("a", None), ("z", None)], "g string, x double").repartition(5)
    got = {r["g"]: r for r in X.summarise(df, ["g"], "x", {f"p{i}": p for i, p in enumerate(probs)}, {"n": F.count("*")}).collect()}
    for g, vs in x.items():
        want = np.quantile(vs, probs)
        assert np.allclose([got[g][f"p{i}"] for i in range(len(probs))], want, rtol=1e-12, atol=0), g
    assert got["a"]["n"] == len(x["a"]) + 1 and got["z"]["p4"] is None


def test_quantiles_under_conditions(spark):
    rng = np.random.default_rng(5)
    x, k = rng.normal(0, 1, 3000), rng.integers(0, 4, 3000)
    df = spark.createDataFrame([(float(v), int(j)) for v, j in zip(x, k, strict=True)] + [(None, 1)], "x double, k int")
    tests = [F.col("k") == 1, F.col("k") > 1, F.col("k") > 9, F.lit(None).cast("boolean")]
    got = X.summarise_where(df, [], F.col("x"), tests, [0.3, 0.5], {"n": F.count("*")}).first()
    for i, own in enumerate((x[k == 1], x[k > 1])):
        assert [got[f"q{i}_0"], got[f"q{i}_1"]] == pytest.approx(np.quantile(own, [0.3, 0.5]).tolist(), rel=1e-12)
    assert got["n"] == 3001 and got["q2_0"] is None and got["q3_1"] is None


def test_a_grouped_table_scans_twice(spark, tmp_path):
    """Statistics and three quantiles: two scans, and no window over a whole group but over what lies inside brackets."""
    from sensorloom.operators.aggregates import describe_by

    spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") * 1.5).alias("x")).write.parquet(str(tmp_path / "t"))
    df = describe_by(spark.read.parquet(str(tmp_path / "t")), ["g"], "x")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 3  # the statistics stand twice in the plan, as one exchange that is used twice
    df.collect()
    run = df._jdf.queryExecution().executedPlan().toString()
    assert run.split("== Initial Plan ==")[0].count("FileScan parquet") <= 3


@pytest.mark.parametrize("large", [50, 10**9])
def test_benjamini_hochberg_over_bins(spark, large):
    rng = np.random.default_rng(2)
    p = {"a": rng.beta(0.3, 2, 900).round(3), "b": rng.uniform(0, 1, 40), None: rng.uniform(0, 0.01, 300)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in p.items() for v in vs] + [("a", None)], "g string, p double")
    got = K.bh_adjust(df, ["g"], "p", large=large).collect()
    for g, vs in p.items():
        order = np.argsort(vs)
        q = np.minimum.accumulate((vs[order] * len(vs) / np.arange(1, len(vs) + 1))[::-1])[::-1].clip(max=1)
        want = sorted(zip(vs[order].tolist(), q.tolist(), strict=True))
        mine = sorted((r["p"], r["p_adj"]) for r in got if r["g"] == g and r["p"] is not None)
        assert np.allclose(mine, want, rtol=1e-12)
    assert [r["p_adj"] for r in got if r["p"] is None] == [None] and math.isclose(len(got), 1241)
