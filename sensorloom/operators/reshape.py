"""Long and wide forms, completed grids and replicate means."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_long(df: DataFrame, id_cols: Sequence[str], value_cols: Sequence[str], name: str = "sensor", value: str = "value") -> DataFrame:
    """One row for each value that is not NULL."""
    cast = df.select(*id_cols, *[F.col(c).cast("double").alias(c) for c in value_cols])
    return cast.unpivot(list(id_cols), list(value_cols), name, value).where(F.col(value).isNotNull())


def to_wide(df: DataFrame, keys: Sequence[str], name: str, value: str, names: Sequence[str], prefix: str = "", agg=F.first) -> DataFrame:
    """A column for each of the given names; giving them saves the pass that would find them."""
    wide = df.groupBy(*keys).pivot(name, list(names)).agg(agg(value))
    return wide.select(*keys, *[F.col(f"`{n}`").alias(f"{prefix}{n}") for n in names])


def to_wide_multi(df: DataFrame, keys: Sequence[str], name: str, names: Sequence[str], measures: Mapping[str, Column]) -> DataFrame:
    """Columns ``measure_name`` for several aggregates at once."""
    wide = df.groupBy(*keys).pivot(name, list(names)).agg(*[c.alias(m) for m, c in measures.items()])
    glued = lambda n, m: F.col(f"`{n}_{m}`" if len(measures) > 1 else f"`{n}`").alias(f"{m}_{n}")
    return wide.select(*keys, *[glued(n, m) for n in names for m in measures])


def wide_mean(df: DataFrame, keys: Sequence[str], label: str, value: str, labels: Sequence[str], prefix: str = "") -> DataFrame:
    return to_wide(df, keys, label, value, labels, prefix, F.avg)


def expand_to_hours(df: DataFrame, date: str, ts: str = "datetime") -> DataFrame:
    """A row for each hour of each day."""
    hours = df.withColumn("_h", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return hours.withColumn(ts, F.col(date).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("_h"))).drop("_h")


def complete(df: DataFrame, nest: Sequence[str], values: Mapping[str, Sequence]) -> DataFrame:
    """Every combination of the nested keys that occurs with all given values; NULL where ``df`` has no row. The values are exploded from literals, so keys are not multiplied by a join."""
    grid = df.select(*nest).distinct()
    for col, own in values.items():
        grid = grid.withColumn(col, F.explode(F.array(*[F.lit(x) for x in own])))
    return grid.join(df, [*nest, *values], "left")


def complete_days(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """Each key's days from its first to its last."""
    span = df.groupBy(*keys).agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
    days = span.withColumn(date, F.explode(F.sequence("_a", "_b", F.expr("interval 1 day")))).drop("_a", "_b")
    return days.join(df, [*keys, date], "left")


def row_mean(cols: Sequence[str]) -> Column:
    """Mean of the values that are not NULL; NULL if none is."""
    n = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in cols])
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols])
    return F.try_divide(total, n)


def replicate_mean(df: DataFrame, out: str, pattern: str) -> DataFrame:
    """``out`` as the mean of the columns whose whole names match; NULL if there is none."""
    cols = [c for c in df.columns if re.fullmatch(pattern, c)]
    return df.withColumn(out, row_mean(cols) if cols else F.lit(None).cast("double"))


def metrics_long(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return df.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(list(ids), list(metrics), "metric", "value")
