"""Every registered query of the measurement operators against its SQL, at the smallest size."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from conftest import DATA
from sensorloom.plans import catalog

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=lambda r: [(x is None, type(x).__name__, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    if name not in catalog.ORACLE_SQL:
        assert got or name in ("significance_report",)
        return
    res = duck.execute(catalog.ORACLE_SQL[name])
    columns = [x[0] for x in res.description]
    assert sorted(columns) == sorted(df.columns)
    want = table(columns, res.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-5)) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_aligned_replicates_equals_its_sql_to_the_last_digit(spark, size):
    import duckdb

    con = duckdb.connect()
    con.execute("set threads = 1")
    for p in Path(f"{DATA}/{size}").glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    res = con.execute(catalog.ORACLE_SQL["aligned_replicates"])
    columns = [x[0] for x in res.description]
    got = catalog.QUERIES["aligned_replicates"](spark, f"{DATA}/{size}").select(*columns).collect()
    assert sorted(tuple(r) for r in got) == sorted(res.fetchall())


@pytest.mark.parametrize("name", ["spearman_rho", "spearman_p"])
def test_ranks_of_means_do_not_hang_on_where_rows_stand(spark, tmp_path, name):
    """Twenty copies of every user, whose means must tie, with rows dealt by two hashes, against the SQL over rows in order."""
    import duckdb
    from pyspark.sql import functions as F

    e = spark.read.parquet(f"{SF}/events.parquet").crossJoin(spark.range(20).withColumnRenamed("id", "k"))
    e = e.withColumn("user_id", F.col("user_id") + F.col("k") * 1000).withColumn("event_id", F.col("event_id") + F.col("k") * 100_000).drop("k")
    con = duckdb.connect()
    con.execute("set threads = 1")
    for seed in (1, 2):
        e.repartition(7, F.xxhash64("event_id", F.lit(seed))).write.parquet(str(tmp_path / f"{seed}" / "events.parquet"))
        got = catalog.QUERIES[name](spark, str(tmp_path / f"{seed}")).collect()
        con.execute(f"create or replace table events as select * from '{tmp_path}/{seed}/events.parquet/*.parquet' order by event_id")
        res = con.execute(catalog.ORACLE_SQL[name])
        columns = [x[0] for x in res.description]
        assert sorted(tuple(r[c] for c in columns) for r in got) == sorted(res.fetchall())


def test_entry_imports_without_the_corpus_folders(tmp_path):
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries()) and set(catalog.ORACLE_SQL) <= set(e.oracle_sql())
    root = Path(e.__file__).parent
    shutil.copytree(root / "sensorloom", tmp_path / "sensorloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.stdout.split() == [str(len(catalog.QUERIES)), str(len(catalog.ORACLE_SQL))], said.stderr
