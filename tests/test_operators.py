"""Hand-computed cases and invariants of the measurement operators."""

import datetime as dt
import math
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.functions import scalars as S
from sensorloom.operators import aggregates as A
from sensorloom.operators import joins as J
from sensorloom.operators import models as M
from sensorloom.operators import numerics as U
from sensorloom.operators import quality as Q
from sensorloom.operators import reshape as R
from sensorloom.operators import sensors as N
from sensorloom.operators import stats as K
from sensorloom.operators import windows as W
from sensorloom.sources import files
from sensorloom.streaming.rollup import hourly_rollup


def series(spark, values, kind="double"):
    return spark.createDataFrame([("a", i, None if v is None else float(v)) for i, v in enumerate(values)], f"s string, t int, x {kind}")


def column(df, name, order="t"):
    return [r[name] for r in df.orderBy(order).collect()]


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(("values", "want"), [([1.0, 2, 4], 0.5), ([1.0, None, 2, 4], 0.5), ([5.0, 6], None), ([0.0, 3, 6, 9], 0.0)])
def test_allan(spark, values, want):
    got = Q.allan_sd(series(spark, values), ["s"], ["t"], ["x"]).first()
    assert got["n"] == len(values) and (got["allan_sd_x"] is None if want is None else math.isclose(got["allan_sd_x"], want, abs_tol=1e-12))


def test_noise_and_limits(spark):
    d = spark.createDataFrame([(1, "LI-7810", 100.0, 0.01, 0.5, 100.0, -100.0)], "k int, instrument string, nmol double, surfarea double, allan_sd double, t_sec double, flux double")
    r = Q.noise_metrics(d).first()
    assert (r.flux_term, r.noise_floor, r.snr_allan) == (10_000, 50, 2)
    r = Q.mdf_manufacturer(Q.noise_metrics(d).withColumn("t_sec_est", F.lit(300.0)), F.lit(0.9)).first()
    assert math.isclose(r.MDF_manuf, 30)
    r = Q.mdf_wassmann(Q.noise_metrics(d), d.select("instrument", "allan_sd"), "instrument").first()
    assert math.isclose(r.MDF_wass95, 97.9981992270027)
    r = Q.mdf_christiansen(Q.noise_metrics(d)).first()
    assert math.isclose(r.MDF_chr95, 3 * U.t_quantile(0.975, 98) * 50)
    flags = spark.createDataFrame([(-97.0, 97.998), (-97.0, None)], "flux double, MDF_wass95 double")
    assert [r.below_MDF for r in Q.mdf_flags(flags).collect()] == [True, None]


def test_filters_and_treatments(spark):
    d = spark.createDataFrame([(1.0, False), (-2.0, True), (3.0, False)], "flux double, b boolean")
    got = {r.treatment: (r.n, r.mean) for r in Q.treatment_effects(d, {"m": "b"}).collect()}
    assert got == {"remove": (2, 2.0), "zero": (3, 4 / 3), "keep": (3, 2 / 3)}
    nulls = spark.createDataFrame([(1.0, None)], "flux double, below_MDF_manuf boolean")
    assert Q.filter_sensitivity(nulls, {"m": Q.passes("below_MDF_manuf")}).first().n_pass == 1
    assert len(Q.filter_registry()) == 19


def test_benjamini_hochberg(spark):
    d = spark.createDataFrame([("a", 0.01), ("a", 0.02), ("a", 0.03), ("a", 0.04), ("b", 0.005), ("b", 0.04), ("b", 0.03), ("b", None)], "g string, p double")
    got = K.bh_adjust(d, ["g"], "p").orderBy("g", F.asc_nulls_last("p")).collect()
    want = [0.04] * 4 + [0.015, 0.04, 0.04, None]
    assert [r.p_adj if r.p_adj is None else round(r.p_adj, 12) for r in got] == want


def test_ranks_and_rolling(spark):
    assert column(W.rank_avg(series(spark, [5.0, 3, 3, None]), ["s"], "x"), "rank") == [1, 2.5, 2.5, None]
    d = series(spark, [1.0, None, 4, None, None])
    assert column(W.roll_mean(d, ["s"], "t", "x", 2), "roll") == [None, 1, 4, 4, None]
    assert column(W.roll_sum(d, ["s"], "t", "x", 2), "roll") == [None, 1, 4, 4, 0]
    assert column(W.roll_mean(d, ["s"], "t", "x", 2, strict=True), "roll") == [None] * 5


def test_rounds_and_episodes(spark):
    day = lambda n: dt.date(2024, 1, n)
    d = spark.createDataFrame([(day(n),) for n in (1, 3, 11, 11, 19)], "date date")
    assert [r["round"] for r in W.sampling_rounds(d, "date", 7).orderBy("date").collect()] == [1, 1, 2, 2, 3]
    d = spark.createDataFrame([(day(1),), (day(8),)], "date date")
    assert {r["round"] for r in W.sampling_rounds(d, "date", 7).collect()} == {1}
    d = spark.createDataFrame([("a", i + 1, s) for i, s in enumerate("mhhmh")], "s string, t int, state string")
    assert [(r.start, r.end) for r in W.episodes(d, ["s"], "t", "state", ["h"]).orderBy("start").collect()] == [(2, 3), (5, 5)]


def test_cut_and_dates(spark):
    d = spark.createDataFrame([(x,) for x in (0.0, 15.0, 15.1, 35.0, 70.0, 71.0)], "x double")
    assert [r[0] for r in d.select(S.cut("x", (0, 15, 35, 70), ("shallow", "mid", "deep"))).collect()] == ["shallow", "shallow", "mid", "mid", "deep", None]
    d = spark.createDataFrame([(x,) for x in ("9/5/2023", "9/5/23", "09-05-2023", "23-09-05", "2023-09-05", "x", None)], "x string")
    assert [r[0] for r in d.select(S.parse_date_multi("x")).collect()] == [dt.date(2023, 9, 5)] * 5 + [None, None]
    assert one(spark, S.parse_ts12(F.lit(202301010030))) == dt.datetime(2023, 1, 1, 0, 30)
    assert [one(spark, S.water_year(F.lit(x).cast("date"))) for x in ("2023-09-30", "2023-10-01")] == [2023, 2024]
    assert one(spark, S.parse_iso(F.lit("2024-01-02T03:04:05.25Z"))) == dt.datetime(2024, 1, 2, 3, 4, 5, 250_000)
    assert one(spark, S.floor_time(F.lit("2024-01-03 10:00:00").cast("timestamp_ntz"), "week", "sunday")) == dt.datetime(2023, 12, 31)
    assert one(spark, S.shift_clock(F.lit("2024-01-03 10:00:00").cast("timestamp_ntz"), -5, -90)) == dt.datetime(2024, 1, 3, 4, 58, 30)


def test_text_scalars(spark):
    assert [one(spark, S.normalize_machine(F.lit(x).cast("string"))) for x in (" lgr #2", "LGR3", "", None, "LI 7810")] == ["LGR", "LGR", "LGR", "LGR", "LI7810"]
    assert one(spark, S.strip_date(F.lit("1899-12-31 10:05:00"))) == "10:05:00"
    assert one(spark, S.prefer(F.lit("a"), F.lit("  "))) == "a" and one(spark, S.prefer(F.lit("a"), F.lit("b"))) == "b"
    assert one(spark, S.position_key(F.lit("001"), F.lit("502"))) == "001.502"
    assert tuple(one(spark, S.parse_feature_name(F.lit("swc_ha1_raw_24h")))) == ("swc_ha1", "raw", 24)
    assert [one(spark, S.stars(F.lit(p))) for p in (0.0001, 0.005, 0.03, 0.2)] == ["***", "**", "*", ""]


def test_null_handling(spark):
    d = spark.createDataFrame([(-9999.0, 1.0), (float("nan"), 2.0), (3.0, None)], "a double, b double")
    assert [r.a for r in S.null_sentinels(d, ["a"]).collect()] == [None, None, 3]
    assert S.drop_sparse(d, 2).columns == ["a"]
    r = R.replicate_mean(spark.createDataFrame([(2.0, None, 4.0), (None, None, None)], "r1 double, r2 double, r3 double"), "m", "r[0-9]")
    assert [x.m for x in r.collect()] == [3, None]
    t = spark.createDataFrame([(dt.datetime(2024, 1, 1), None, None)], "ts timestamp_ntz, a double, rain double")
    assert A.hourly_agg(t, "ts", {"a": "mean", "rain": "sum"}).first()[1:] == (None, 0.0)


def test_baseline_adjusted_mean(spark):
    t = [dt.datetime(2024, 1, d) for d in (1, 20)]
    rows = [("A", t[0], 10.0), ("B", t[0], 20.0), ("A", t[1], 12.0), ("B", t[1], 21.0)]
    long = spark.createDataFrame(rows, "sensor string, datetime timestamp_ntz, value double")
    got = {r.datetime: (r.adjusted, r.n_sensors) for r in N.baseline_adjusted_mean(long, "2024-01-01", "2024-01-10", min_sensors=2).collect()}
    assert got[t[1]] == (16.5, 2)
    alone = long.where("not (sensor = 'B' and datetime > '2024-01-10')")
    assert {r.datetime: r.adjusted for r in N.baseline_adjusted_mean(alone, "2024-01-01", "2024-01-10", min_sensors=1).collect()}[t[1]] == 17


def test_additive_anomaly_is_zero(spark):
    rows = [("v", dt.datetime(2024, 1, 1 + d, h), x) for d, h, x in ((0, 0, 1.0), (0, 1, 3.0), (1, 0, 5.0), (1, 1, 7.0))]
    got = K.anomaly(spark.createDataFrame(rows, "variable string, datetime timestamp_ntz, value double")).collect()
    assert all(abs(r.anomaly) < 1e-12 for r in got)


def test_interval_and_nearest_joins(spark):
    at = lambda s: dt.datetime(2024, 1, 1, 10, 0, 0) + dt.timedelta(seconds=s)
    samples = spark.createDataFrame([("m", i, at(i)) for i in (0, 5, 6)], "machine string, i int, ts timestamp_ntz")
    iv = spark.createDataFrame([("m", "u", at(0), at(5))], "machine string, key string, start_ts timestamp_ntz, end_ts timestamp_ntz")
    assert sorted(r.i for r in J.assign_intervals(samples, iv, ["machine"]).collect()) == [0, 5]
    left = spark.createDataFrame([(k, at(1000 * k)) for k in (1, 2, 3, 4)], "k int, ts timestamp_ntz").withColumn("d", F.lit(1))
    right = [(1, at(1119)), (2, at(2120)), (3, at(3121)), (4, at(4060)), (5, at(3940))]
    right = spark.createDataFrame(right, "log int, log_ts timestamp_ntz").withColumn("d", F.lit(1))
    got = {r.k: r.log for r in J.join_nearest(left, right, "k", ["d"], "ts", "log_ts", 120, "log").collect()}
    assert got == {1: 1, 2: 2, 3: None, 4: 4}
    r2 = spark.createDataFrame([(1, at(0)), (2, at(120))], "log int, log_ts timestamp_ntz").withColumn("d", F.lit(1))
    l2 = spark.createDataFrame([(1, at(60))], "k int, ts timestamp_ntz").withColumn("d", F.lit(1))
    assert J.join_nearest(l2, r2, "k", ["d"], "ts", "log_ts", 120, "log").first().log == 1
    src = spark.createDataFrame([("s", 1, 7), ("s", 5, 9)], "s string, t int, v int")
    q = spark.createDataFrame([("s", t) for t in (0, 1, 4, 6)], "s string, t int")
    assert column(J.join_asof(q, src, "t", ["s"], ["v"]), "v") == [None, 7, 7, 9]


def test_fallback_to_all_machines(spark):
    at = lambda s: dt.datetime(2024, 1, 1, 10, 0, s)
    samples = spark.createDataFrame([("a", dt.date(2024, 1, 1), at(1))], "machine string, date date, ts timestamp_ntz")
    iv = spark.createDataFrame([("b", dt.date(2024, 1, 1), "u", at(0), at(5))], "machine string, date date, key string, start_ts timestamp_ntz, end_ts timestamp_ntz")
    got = J.assign_with_fallback(samples, iv, "machine", "date").collect()
    assert [(r.machine, r.key) for r in got] == [("b", "u")]


def test_durations(spark):
    rows = [(dt.date(2024, 1, 1), "10:00:00", e) for e in ("10:00:30", "10:00:31", "10:29:59", "10:30:00")]
    got = S.build_intervals(spark.createDataFrame(rows, "date date, a string, b string"), "date", "a", "b").collect()
    assert sorted(r.seconds for r in got) == [31, 1799]


def test_tails():
    assert math.isclose(U.t_p(2, 4), 0.116116523516816, rel_tol=1e-10)
    assert math.isclose(U.chi2_p(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(U.f_p(4.0, 1, 4), U.t_p(2, 4), rel_tol=1e-10)
    assert math.isclose(U.t_quantile(0.975, 10), 2.2281388519649385, rel_tol=1e-9)


def test_running_sums_equal_frames(spark):
    rng = random.Random(2)
    rows = [("v", dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * i), None if rng.random() < 0.2 else rng.gauss(50, 5)) for i in range(300)]
    long = spark.createDataFrame(rows, "variable string, datetime timestamp_ntz, value double")
    got = K.window_features(long.select("datetime"), long, [24])
    want = W.roll_sd(W.roll_sum(W.roll_mean(long, ["variable"], "datetime", "value", 24, out="m"), ["variable"], "datetime", "value", 24, out="t"), ["variable"], "datetime", "value", 24, out="d")
    both = got.join(want, ["variable", "datetime"]).collect()
    assert len(both) == 277
    for r in both:
        assert math.isclose(r["mean"], r.m, rel_tol=1e-9) and math.isclose(r["sum"], r.t, rel_tol=1e-9) and math.isclose(r.sd, r.d, rel_tol=1e-6)


def test_clusters(spark):
    pairs = {("a", "b"): 0.9, ("b", "c"): -0.8, ("a", "c"): 0.1, ("d", "a"): 0.2, ("d", "b"): 0.0, ("d", "c"): 0.3}
    rows = [(a, b, r, 9) for (x, y), r in pairs.items() for a, b in ((x, y), (y, x))]
    cm = spark.createDataFrame(rows, "a string, b string, r double, n int")
    assert {r.variable: r.cluster for r in K.corr_clusters(cm, 0.7).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d"}
    feats = spark.createDataFrame([("a", 0.5, 0.0), ("b", -0.9, 0.1), ("c", 0.9, 0.0), ("d", 0.1, 0.0)], "variable string, r double, missing double")
    got = {r.representative: r.dropped for r in K.select_representatives(feats, K.corr_clusters(cm, 0.7)).collect()}
    assert got == {"c": "a,b", "d": ""}


def test_mixed_model_on_balanced_groups(spark):
    d = spark.createDataFrame([("g", 1.0), ("g", 3.0), ("h", 5.0), ("h", 7.0)], "e string, y double")
    m = M.lmm(d, "y", M.design(d, []), "e")
    assert math.isclose(m.sigma2_u, 7, rel_tol=1e-3) and math.isclose(m.sigma2, 2, rel_tol=1e-3)
    r = M.icc(d.withColumn("k", F.lit(1)), ["k"], "e", "y").first()
    assert abs(r.icc - 7 / 9) < 0.01
    v = A.variance_decomp(d.withColumn("k", F.lit(1)), ["k"], "e", "y").first()
    assert (v.between, v.within, v.ratio) == (8, 2, 4)
    b = {x.e: x.blup for x in M.blups(d, "y", M.design(d, []), m).collect()}
    assert math.isclose(b["h"], -b["g"], rel_tol=1e-6) and 0 < b["h"] < 2


def test_mixed_model_without_group_effect_is_least_squares(spark):
    rng = random.Random(4)
    rows = []
    for i in range(200):
        x = rng.random()
        rows.append((i % 20, x, "uv"[i % 2], 1 + 2 * x + (i % 2) + rng.gauss(0, 0.5)))
    d = spark.createDataFrame(rows, "e int, x double, f string, y double")
    des = M.design(d, ["x*f"], ["f"])
    assert list(des.columns) == ["(Intercept)", "x", "fv", "x:fv"]
    a, b = M.lmm(d, "y", des, "e", reml=False), M.ols(d, "y", des)
    xs = np.array([[1, x, f == "v", x * (f == "v")] for _, x, f, _ in rows], float)
    assert np.allclose(b.beta, np.linalg.lstsq(xs, np.array([r[3] for r in rows]), rcond=None)[0])
    assert a.loglik >= b.loglik - 1e-9 and np.allclose(a.beta, b.beta, atol=0.2)
    means, contrasts = M.emmeans(spark, b, des, "f", at={"x": 0.5})
    got = {r.level: r.emmean for r in means.collect()}
    assert math.isclose(got["v"] - got["u"], b.beta[2] + 0.5 * b.beta[3], rel_tol=1e-9)
    assert contrasts.first().p < 1e-6
    sl = {r.level: r.slope for r in M.slopes_by_level(spark, b, des, ["x"], "f").collect()}
    assert math.isclose(sl["v"], b.beta[1] + b.beta[3])
    grid = M.prediction_grid(d.withColumn("z", F.col("e").cast("double")), M.ols(d.withColumn("z", F.col("e").cast("double")), "y", M.design(d.withColumn("z", F.lit(0.0)), ["x*z*f"], ["f"])), M.design(d.withColumn("z", F.col("e").cast("double")), ["x*z*f"], ["f"]), "x", "z", "f", steps=5)
    assert grid.count() == 3 * 2 * 5 and grid.where("se is null or fit is null").count() == 0


def test_selection(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        a, b, c = rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((i, 3 * a + b + rng.gauss(0, 0.3), a, b, c))
    d = spark.createDataFrame(rows, "k int, y double, a double, b double, c double")
    got = M.forward_select(d, "y", [], ["a", "b", "c"]).collect()
    assert [r.variable for r in got][:2] == ["a", "b"] and got[0].r2 < got[1].r2
    freq = {r.variable: r.frequency for r in M.selection_frequency(d, "k", "y", [], ["a", "b", "c"], steps=2, runs=5).collect()}
    assert freq == {"a": 1.0, "b": 1.0, "c": 0.0}
    vif = {r.term: r.gvif for r in M.gvif(spark, M.ols(d, "y", M.design(d, ["a", "b", "c"]))).collect()}
    assert all(0.99 < v < 1.2 for v in vif.values())


def test_poisson_weights(spark):
    w = spark.range(20_000).select(M.poisson_weight(F.col("id"), F.lit(1)).alias("w")).agg(F.avg("w").alias("m"), F.var_samp("w").alias("v")).first()
    assert abs(w.m - 1) < 0.05 and abs(w.v - 1) < 0.08


def test_five_percent_and_empty(spark):
    empty = spark.createDataFrame([], "s string, t int, x double")
    assert Q.allan_sd(empty, ["s"], ["t"], ["x"]).count() == 0
    assert A.describe_by(empty, ["s"], "x").count() == 0
    assert W.roll_mean(empty, ["s"], "t", "x", 3).count() == 0
    assert A.coverage(empty, ["x"]).first().pct is None
    assert K.pearson(empty, ["s"], "x", "t").count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "tower.csv").write_text("# site\n# version\nTIMESTAMP_START,SWC_1_1_1,TS_PI_1\n202301010030,-9999,1.5\n202301010100,0.25,\n")
    t = files.read_tower_csv(spark, str(tmp_path / "tower.csv"))
    assert [r.SWC_1_1_1 for r in t.collect()] == [None, 0.25]
    long = N.sensor_long(t, r"SWC($|_)")
    assert [(r.datetime, r.sensor, r.value) for r in long.collect()] == [(dt.datetime(2023, 1, 1, 1), "SWC_1_1_1", 0.25)]
    folder = tmp_path / "raw" / "LGR1" / "2023-06-01"
    folder.mkdir(parents=True)
    body = "banner 1\nTime, [CH4]d_ppm, [CH4]d_ppm_sd, [CO2]d_ppm\n06/01/2023 10:00:00.000, 2.0, 0.1, 400\nbad, 1, 1, 1\n06/01/2023 10:00:01.000, 2.1, 0.1, 401\n"
    (folder / "a.txt").write_text(body)
    with zipfile.ZipFile(folder / "b.zip", "w") as z:
        z.writestr("b.txt", body)
    (folder / "c.txt").write_text("nothing to read")
    lgr, failures, _ = files.read_lgr_traces(spark, str(tmp_path / "raw"))
    assert [(r["path"].rsplit("/", 1)[1], r["error"][:13]) for r in failures.collect()] == [("c.txt", "EmptyDataErro")]
    assert lgr.count() == 4 and {r.machine for r in files.trace_catalog(lgr).collect()} == {"LGR1"}
    assert files.read_optional(spark, str(tmp_path / "none.csv")) is None
    d = spark.createDataFrame([(1, 0, None), (2, 1, None), (3, None, 0)], "k int, q1 int, q2 int")
    files.write_all_and_qf0(d, str(tmp_path / "out"), ["q1", "q2"])
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out/qf0.parquet")).collect()) == [1, 3]
    assert files.latest_version(spark.createDataFrame([("x/SITE_2.csv",), ("x/SITE_10.csv",), ("x/OTHER_9.csv",)], "path string"), "SITE").first().path == "x/SITE_2.csv"
    m = M.ols(d.withColumn("y", F.col("k") * 2.0), "y", M.design(d, ["k"]))
    M.save_model(m, spark, str(tmp_path / "model"))
    assert M.load_model(spark, str(tmp_path / "model"))["coefficients"].count() == 2


def test_stream_gives_the_batch_rows(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, h, m), float(h + m)) for h in range(5) for m in (0, 20, 40)]
    d = spark.createDataFrame(rows, "ts timestamp, x double")
    d.write.parquet(str(tmp_path / "in"))
    stream = hourly_rollup(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), "ts", "x")
    q = stream.writeStream.format("memory").queryName("rollup_test").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("rollup_test").collect()}
    assert got == {tuple(r) for r in hourly_rollup(d, "ts", "x").collect()} and len(got) == 5


def test_end_to_end_quality_flags(spark):
    at = lambda s: dt.datetime(2024, 6, 1, 10, 0, s)
    day = dt.date(2024, 6, 1)
    flux = spark.createDataFrame([("u1", "f1", day, at(0), 1, -5.0, None, None, None, 0.01, 120, "LI-7810"), ("u2", "f9", day, at(30), 2, 50.0, 1000.0, 20.0, 9.0, 0.01, None, "LGR/UGGA")], "UniqueID string, file_key string, date date, ts timestamp_ntz, Tag int, flux double, bar double, airt double, vol_system double, surfarea double, t_sec int, instrument string")
    volumes = spark.createDataFrame([(1, 7.0)], "Tag int, Volume double")
    by_file = spark.createDataFrame([("f1", 0.5, "LI-7810")], "file_key string, allan_sd double, instrument string")
    by_iv = spark.createDataFrame([("other", day, at(59), 0.8, "LGR/UGGA")], "UniqueID string, date date, start_ts timestamp_ntz, allan_sd double, instrument string")
    got = {r.UniqueID: r for r in Q.quality_flags(flux, volumes, by_file, by_iv).collect()}
    assert got["u1"].allan_from == "file" and got["u2"].allan_from == "nearest" and got["u2"].allan_sd == 0.8
    assert got["u1"].vol_system == 7 and got["u2"].t_sec_est == 300 and got["u1"].below_MDF is not None and got["u2"].MDF_chr99 > got["u2"].MDF_chr90
