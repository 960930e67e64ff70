"""Readers and writers of instrument files. All go through Spark's sources, so paths may be on any store it reads."""

from __future__ import annotations

import io
import math
import re
import zipfile
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import null_sentinels
from ..operators.aggregates import Parsed, split_failures
from ..operators.joins import union_all

#: Bytes that a task reads of small files, and what opening one costs, in bytes.
PACK_BYTES, OPEN_BYTES = 128 << 20, 64 << 10


def packed(df: DataFrame, spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """A scan of many small files in as many tasks as their bytes need, opening included: Spark's own splits take a file for 4 MB at least. A listing gives number and bytes; no shuffle."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    n, size = files.agg(F.count("length"), F.coalesce(F.sum("length"), F.lit(0))).first()
    return df.coalesce(max(spark.sparkContext.defaultParallelism, math.ceil((size + n * OPEN_BYTES) / PACK_BYTES)))


def read_commented_csv(spark: SparkSession, path: str | list[str], schema: str | None = None) -> DataFrame:
    reader = spark.read.option("comment", "#").option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_tower_csv(spark: SparkSession, path: str | list[str], sentinel: float = -9999) -> DataFrame:
    """A file with ``#`` lines before its header; sentinels and NaN become NULL in all but time columns."""
    df = read_commented_csv(spark, path)
    return null_sentinels(df, [c for c, t in df.dtypes if t in ("int", "bigint", "double") and not c.startswith("TIMESTAMP")], (sentinel,))


def read_logger_csv(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """A file whose header is replaced by a fixed list of columns."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)


def read_table(spark: SparkSession, path: str | list[str], schema: str | None = None) -> DataFrame:
    """Parquet by its name, else CSV with a header."""
    if str(path).rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_traces(spark: SparkSession, root: str, must_contain: str = "/tables/", pattern: str = "*.csv", schema: str = "REMARK string, DATE string, ts timestamp_ntz, CO2 double, CH4 double") -> DataFrame:
    """All trace files under ``root`` whose path holds a text, with their path and the row's place in them."""
    df = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).csv(root)
    df = packed(df.select("*", F.col("_metadata.file_path").alias("file")), spark, root, pattern).withColumn("line", F.monotonically_increasing_id())
    return df.where(F.col("file").contains(must_contain))


def trace_catalog(df: DataFrame, file: str = "file") -> DataFrame:
    """Machine and date of the folders in the files' paths (``.../<machine>/<YYYY-MM-DD>/...``)."""
    part = lambda i: F.regexp_extract(file, r"/([^/]+)/(\d{4}-\d{2}-\d{2})/", i)
    found = df.select(file).distinct().select(file, part(1).alias("machine"), part(2).alias("day"))
    return found.where(F.col("machine") != "").select(file, "machine", F.col("day").cast("date").alias("date"))


def map_files(files: DataFrame, fn: Callable[[str, bytes], pd.DataFrame], schema: str, safe: bool = True) -> Parsed:
    """A function of path and content for each file: its rows, and path and error of each file on which it failed. Without ``safe`` a failure ends the job. Spark's listing leaves out files without a byte."""
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    yield fn(path, content)[names].assign(failed_path=None, failed_error=None)
                except Exception as e:
                    if not safe:
                        raise
                    yield pd.DataFrame({**dict.fromkeys(names, [None]), "failed_path": [path], "failed_error": [f"{type(e).__name__}: {e}"]})

    return split_failures(files.select("path", "content").mapInPandas(run, f"{schema}, failed_path string, failed_error string"), names, {"failed_path": "path"})


def parse_lgr(path: str, content: bytes) -> pd.DataFrame:
    """A banner line, then a header that differs from file to file: time in the first column, gases in the columns named like dry mole fractions."""
    if path.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            content = z.read(z.namelist()[0])
    raw = pd.read_csv(io.BytesIO(content), skiprows=1, skipinitialspace=True, dtype=str, on_bad_lines="skip")
    raw.columns = [c.strip() for c in raw.columns]
    pick = lambda gas: next(c for c in raw.columns if re.search(rf"{gas}.*d_ppm", c))
    ts = pd.to_datetime(raw[raw.columns[0]].str.strip(), format="%m/%d/%Y %H:%M:%S.%f", errors="coerce")
    out = pd.DataFrame({"file": path, "line": range(len(raw)), "ts": ts, "CH4": pd.to_numeric(raw[pick("CH4")], errors="coerce"), "CO2": pd.to_numeric(raw[pick("CO2")], errors="coerce")})
    return out[out["ts"].notna()]


def read_lgr_traces(spark: SparkSession, root: str, pattern: str = "*.{txt,zip}") -> Parsed:
    """Traces of all files, and the files that could not be parsed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return map_files(packed(files, spark, root, pattern), parse_lgr, "file string, line bigint, ts timestamp_ntz, CH4 double, CO2 double")


def latest_version(paths: DataFrame, site: str, path: str = "path") -> DataFrame:
    """The last file by name of a site."""
    return paths.where(F.col(path).contains(site)).agg(F.max(path).alias(path))


def stack_parts(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Part files of one product; columns that some parts lack are NULL there."""
    return union_all([read_table(spark, p) for p in paths])


def read_optional(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return read_table(spark, path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)


def write_all_and_qf0(df: DataFrame, path: str, qf_cols: Sequence[str], month_of: str | None = None) -> None:
    """All rows, and those whose quality flags are 0 or missing, each as Parquet and CSV."""
    good = F.lit(True)
    for c in qf_cols:
        good = good & (F.col(c).isNull() | (F.col(c) == 0))
    d = df if month_of is None else df.withColumn("month", F.date_format(month_of, "yyyy-MM"))
    for name, rows in (("all", d), ("qf0", d.where(good))):
        write_table(rows, f"{path}/{name}.parquet", partition_by=["month"] if month_of else ())
        write_table(rows, f"{path}/{name}.csv", "csv")
