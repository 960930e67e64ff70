"""Readers: headers, names, many small files, bad files, and the chain from trace files to quality flags."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import aggregates as A
from sensorloom.operators import lookups
from sensorloom.operators import quality as Q
from sensorloom.sources import files


def test_sentinels_and_nan_become_null(spark, tmp_path):
    (tmp_path / "t.csv").write_text("# a\nTIMESTAMP_START,TS,N\n-9999,-9999,7\n202301010030,NaN,-9999\n202301010100,1.5,1\n")
    got = files.read_tower_csv(spark, str(tmp_path / "t.csv")).collect()
    assert [(r["TIMESTAMP_START"], r["TS"], r["N"]) for r in got] == [(-9999, None, 7), (202301010030, None, None), (202301010100, 1.5, 1)]


def test_logger_header_is_replaced(spark, tmp_path):
    (tmp_path / "l.csv").write_text("Date Time GMT-04,Temp F (SN 1),\n2023-06-01 10:00:00,71.5,x\n2023-06-01 10:15:00,,\n")
    got = files.read_logger_csv(spark, str(tmp_path / "l.csv"), "ts timestamp_ntz, temp double, event string")
    assert got.columns == ["ts", "temp", "event"] and [(r["ts"].minute, r["temp"], r["event"]) for r in got.collect()] == [(0, 71.5, "x"), (15, None, None)]


def test_tables_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,x\n1,0.5\n2,\n")
    assert [(r["k"], r["x"]) for r in files.read_table(spark, str(tmp_path / "a.csv")).collect()] == [(1, 0.5), (2, None)]
    assert files.read_table(spark, str(tmp_path / "a.csv"), "k string, x string").dtypes == [("k", "string"), ("x", "string")]
    files.write_table(spark.createDataFrame([(1, "u")], "k int, p string"), str(tmp_path / "b.parquet"), partition_by=["p"])
    assert files.read_table(spark, str(tmp_path / "b.parquet/")).first()["p"] == "u"


def trace(folder, name, values, remark="u1"):
    folder.mkdir(parents=True, exist_ok=True)
    day = next(x for x in reversed(folder.parts) if x[:2] == "20")
    body = "".join(f"{remark},{day},{day} 10:00:{i:02d},{400 + v},{2000 + v}\n" for i, v in enumerate(values))
    (folder / name).write_text("REMARK,DATE,ts,CO2,CH4\n" + body)


def test_traces_by_folder(spark, tmp_path):
    trace(tmp_path / "LGR2" / "2024-06-01" / "tables", "a.csv", [0, 1, 3])
    trace(tmp_path / "LGR2" / "2024-06-01" / "other", "b.csv", [0, 1])
    (tmp_path / "LGR2" / "2024-06-01" / "tables" / "c.dat").write_text("x")
    got = files.read_traces(spark, str(tmp_path)).orderBy("line").collect()
    assert [r["CH4"] for r in got] == [2000, 2001, 2003] and {r["file"].rsplit("/", 1)[1] for r in got} == {"a.csv"}
    assert files.read_traces(spark, str(tmp_path), must_contain="/other/").count() == 2


def test_ten_thousand_files_in_few_tasks(spark, tmp_path):
    for k in range(100):
        (tmp_path / f"d{k}").mkdir()
        for i in range(100):
            (tmp_path / f"d{k}" / f"{i}.csv").write_text("REMARK,DATE,ts,CO2,CH4\nu,2024-06-01,2024-06-01 10:00:00,400,2\n")
    d = files.read_traces(spark, str(tmp_path), must_contain=".csv")
    most = -(-10_000 * (files.OPEN_BYTES + 100) // files.PACK_BYTES)
    assert d.rdd.getNumPartitions() <= max(most, spark.sparkContext.defaultParallelism) < 10
    assert d.count() == 10_000


def test_bad_files_are_told(spark, tmp_path):
    for name, body in (("a", b"1"), ("b", b"x"), ("c", b" "), ("d", b"")):
        (tmp_path / name).write_bytes(body)
    raw = spark.read.format("binaryFile").load(str(tmp_path))
    parse = lambda path, content: pd.DataFrame({"path": [path], "v": [int(content)]})
    rows, failures, both = files.map_files(raw, parse, "path string, v int")
    assert [r["v"] for r in rows.collect()] == [1] and rows.columns == ["path", "v"]
    assert sorted((r["path"][-1], r["error"][:10]) for r in failures.collect()) == [("b", "ValueError"), ("c", "ValueError")]
    assert both.count() == 3
    with pytest.raises(Exception, match="invalid literal"):
        files.map_files(raw, parse, "path string, v int", safe=False).rows.collect()
    assert files.map_files(raw.limit(0), parse, "path string, v int").failures.count() == 0


def test_bad_groups_are_told(spark):
    d = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 4.0), (None, 2, 5.0), ("c", 3, 0.0)], "g string, k int, x double")

    def fn(pdf):
        if (pdf["x"] == 0).any():
            raise ZeroDivisionError("zero")
        return pd.DataFrame({"inv": [float((1 / pdf["x"]).sum())]})

    rows, failures, _ = A.apply_by_checked(d, ["g", "k"], fn, "inv double")
    assert sorted(r["inv"] for r in rows.collect()) == [0.2, 0.75]
    assert [tuple(r) for r in failures.collect()] == [("c", 3, "ZeroDivisionError: zero")]
    assert A.apply_by(d, ["g"], fn, "inv double", safe=True).count() == 2
    with pytest.raises(Exception, match="zero"):
        A.apply_by(d, ["g"], fn, "inv double").collect()


def test_all_combinations(spark):
    got = lookups.param_grid(spark, a=[1, 2], b=["x", "y", "z"])
    assert got.columns == ["a", "b"] and sorted(map(tuple, got.collect())) == [(a, b) for a in (1, 2) for b in "xyz"]


def test_from_trace_files_to_flags(spark, tmp_path):
    """Traces of two machines, their Allan values by file and by interval, and the flags of fluxes measured on them."""
    day = dt.date(2024, 6, 1)
    trace(tmp_path / "LGR1" / str(day) / "tables", "a.csv", [0, 1, 0, 1, 0, 1], "u1")
    trace(tmp_path / "LGR2" / str(day) / "tables", "b.csv", [0, 3, 0, 3, 0, 3, 0], "u2")
    traces = files.read_traces(spark, str(tmp_path)).cache()
    machines = files.trace_catalog(traces)
    assert {(r["machine"], r["date"]) for r in machines.collect()} == {("LGR1", day), ("LGR2", day)}
    by_file = Q.allan_by_file(traces)
    allan = {r["remark"]: r["allan_sd_CH4"] for r in by_file.collect()}
    # first differences are +1, -1, +1, ... (five of them) and +3, -3, ... (six)
    assert allan["u1"] == pytest.approx((6 / 5 / 2) ** 0.5) and allan["u2"] == pytest.approx((54 / 5 / 2) ** 0.5)
    instrument = F.when(F.col("machine") == "LGR1", "LGR/UGGA").otherwise("LI-7810")
    per_file = by_file.join(machines.drop("date"), "file").select(F.col("key").alias("file_key"), F.col("allan_sd_CH4").alias("allan_sd"), instrument.alias("instrument"))
    no_interval = spark.createDataFrame([], "UniqueID string, date date, start_ts timestamp_ntz, allan_sd double, instrument string")
    at = dt.datetime(2024, 6, 1, 10)
    flux = spark.createDataFrame([("f1", f"u1_{day}", day, at, 1, -0.1, None, None, None, 0.01, 120, "LGR/UGGA"), ("f2", f"u2_{day}", day, at, 1, 500.0, 1000.0, 20.0, 9.0, 0.01, 200, "LI-7810")], "UniqueID string, file_key string, date date, ts timestamp_ntz, Tag int, flux double, bar double, airt double, vol_system double, surfarea double, t_sec int, instrument string")
    volumes = spark.createDataFrame([(1, 7.0)], "Tag int, Volume double")
    got = {r["UniqueID"]: r for r in Q.quality_flags(flux, volumes, per_file, no_interval).collect()}
    assert {r["allan_from"] for r in got.values()} == {"file"} and got["f2"]["allan_sd"] == pytest.approx(allan["u2"])
    for name, sigma, t in (("f1", 0.9, 120), ("f2", 0.6, 200)):
        r = got[name]
        assert r["noise_floor"] == pytest.approx(r["allan_sd"] / t * r["nmol"] / 0.01) and r["MDF_manuf"] == pytest.approx(sigma / t * r["nmol"] / 0.01)
        assert r["below_MDF_wass95"] == (abs(r["flux"]) < 1.959963984540054 * r["noise_floor"])
    assert got["f1"]["below_MDF"] and not got["f2"]["below_MDF"]
