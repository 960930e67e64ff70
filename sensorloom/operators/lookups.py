"""Small tables given in code."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame, SparkSession


def lookup(spark: SparkSession, rows: Sequence[Sequence], cols: Sequence[str] | str) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], cols if isinstance(cols, str) else list(cols))


def param_grid(spark: SparkSession, **lists: Sequence) -> DataFrame:
    """All combinations of the given values, a column for each name."""
    return lookup(spark, list(product(*lists.values())), list(lists))
