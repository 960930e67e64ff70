"""Ordered series of any length: chunks of rows with a halo, and state carried from chunk to chunk.

A window over a series gathers it in one task. Where some series has more than ``PLAIN_ROWS`` rows, rows get their position
first: bins of time with about equal numbers of rows (splitters from a sample of times by hash, the same whenever drawn), ranks
inside bins, and the bins' totals. Positions cut the series into chunks of equal size; the last rows of a chunk stand a second
time before the next one, for frames that reach back. What reaches back without limit (last value, runs) is carried by
a table with a row for each chunk.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .quantiles import BINS, PER_BIN, join_groups

#: Rows of a series that one task sorts; rows of a chunk of a longer one.
PLAIN_ROWS, CHUNK_ROWS = 5_000_000, 1_000_000
_OWN = ("_chunk", "_pos", "_halo")


def _cuts(df: DataFrame, series: Sequence[str], ts: str, sizes: DataFrame) -> DataFrame:
    """``_cuts``: ascending times that cut the series of ``sizes`` (``_rows``) into bins with about equal numbers of rows."""
    at = join_groups(df.select(*series, F.col(ts).alias("_at")), sizes, series, "inner")
    drawn = at.where(F.pmod(F.xxhash64("_at", F.lit(17)), F.lit(1 << 30)) < F.lit(float(BINS * PER_BIN)) / F.col("_rows") * (1 << 30))
    return drawn.groupBy(*series).agg(F.sort_array(F.collect_set("_at")).alias("_v")).select(*series, F.filter("_v", lambda x, i: i % PER_BIN == PER_BIN - 1).alias("_cuts"))


def _long(df: DataFrame, series: Sequence[str], large: int) -> DataFrame:
    return df.groupBy(*series).agg(F.count("*").alias("_rows")).where(F.col("_rows") > large)


def time_bins(df: DataFrame, series: Sequence[str], ts: str, large: int) -> DataFrame | None:
    """``_cuts`` by series of more than ``large`` rows, if there are any; a time's bin is the number of smaller cuts."""
    sizes = _long(df, series, large)
    return None if sizes.isEmpty() else _cuts(df, series, ts, sizes)


def with_bins(df: DataFrame, series: Sequence[str], ts: str, large: int) -> DataFrame:
    """``_bin``: of time, ascending, in series of more than ``large`` rows; 0 in others. Rows of one time are in one bin."""
    cuts = _cuts(df, series, ts, _long(df, series, large))
    return join_groups(df, cuts, series).withColumn("_bin", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(ts))), F.lit(0))).drop("_cuts")


def with_positions(df: DataFrame, series: Sequence[str], order: Sequence[str], large: int) -> DataFrame:
    """``_pos``: place of each row in its series, from 1."""
    b = with_bins(df, series, order[0], large)
    over = Window.partitionBy(*(series or [F.lit(0)])).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    totals = b.groupBy(*series, "_bin").agg(F.count("*").alias("_t")).select(*series, "_bin", F.coalesce(F.sum("_t").over(over), F.lit(0)).alias("_carried"))
    own = b.withColumn("_own", F.row_number().over(Window.partitionBy(*series, "_bin").orderBy(*order)))
    return join_groups(own, totals, [*series, "_bin"]).withColumn("_pos", F.col("_own") + F.col("_carried")).drop("_own", "_carried", "_bin")


class Chunks(NamedTuple):
    """Rows with ``_chunk``, ``_pos`` and ``_halo``; whether every series is a single chunk."""

    rows: DataFrame
    plain: bool


def chunks(df: DataFrame, series: Sequence[str], order: Sequence[str], halo: int = 0, plain: int | None = None, chunk: int | None = None) -> Chunks:
    """``df`` with ``_chunk``, ``_pos`` and ``_halo``: rows of the halo are copies from the chunk before, ``halo`` of them. NULL times come first.

    Whether a series is too long for one task is checked by a count.
    """
    plain, chunk = plain or PLAIN_ROWS, max(chunk or CHUNK_ROWS, halo)
    if _long(df, series, plain).isEmpty():
        pos = F.row_number().over(Window.partitionBy(*(series or [F.lit(0)])).orderBy(*order))
        return Chunks(df.withColumns({"_chunk": F.lit(0).cast("bigint"), "_pos": pos, "_halo": F.lit(False)}), True)
    d, at = with_positions(df, series, order, plain), F.col("_pos") - 1
    home, place = F.floor(at / chunk), at % chunk
    if not halo:
        return Chunks(d.withColumn("_chunk", home).withColumn("_halo", F.lit(False)), False)
    here, next_ = F.struct(home.alias("c"), F.lit(False).alias("h")), F.struct((home + 1).alias("c"), F.lit(True).alias("h"))
    d = d.withColumn("_at", F.explode(F.when(place >= chunk - halo, F.array(here, next_)).otherwise(F.array(here))))
    return Chunks(d.withColumn("_chunk", F.col("_at.c")).withColumn("_halo", F.col("_at.h")).drop("_at"), False)


def in_chunk(series: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*series, "_chunk").orderBy("_pos")


def own_rows(c: DataFrame) -> DataFrame:
    """Without halos and the columns of ``chunks``."""
    return c.where(~F.col("_halo")).drop(*_OWN)


def rolled(df: DataFrame, series: Sequence[str], ts: str, n: int, **columns) -> DataFrame:
    """Columns over the last ``n`` rows: functions of the frame and of whether there are ``n`` rows."""
    c, w = chunks(df, series, [ts], n - 1).rows, in_chunk(series).rowsBetween(-(n - 1), 0)
    return own_rows(c.withColumns({name: f(w, F.col("_pos") >= n) for name, f in columns.items()}))


def last_before(c: Chunks, series: Sequence[str], cols: Sequence[str], here: bool) -> DataFrame:
    """``_last_<col>``: the last value that is not NULL in earlier rows or, with ``here``, up to the row itself. ``c``: chunks without halo."""
    w = in_chunk(series).rowsBetween(Window.unboundedPreceding, 0 if here else -1)
    own = c.rows.withColumns({f"_last_{x}": F.last(x, ignorenulls=True).over(w) for x in cols})
    if c.plain:
        return own
    ends = c.rows.groupBy(*series, "_chunk").agg(*[F.max(F.when(F.col(x).isNotNull(), F.struct("_pos", F.col(x).alias("v")))).alias(f"_end_{x}") for x in cols])
    over = Window.partitionBy(*(series or [F.lit(0)])).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*series, "_chunk", *[F.last(f"_end_{x}", ignorenulls=True).over(over)["v"].alias(f"_carried_{x}") for x in cols])
    d = join_groups(own, ends, [*series, "_chunk"])
    return d.withColumns({f"_last_{x}": F.coalesce(f"_last_{x}", f"_carried_{x}") for x in cols}).drop(*[f"_carried_{x}" for x in cols])


def running_sum(c: Chunks, series: Sequence[str], value: Column, out: str) -> DataFrame:
    """Sum up to the row itself. ``c``: chunks without rows of halos."""
    d = c.rows.withColumn("_v", value)
    if c.plain:
        return d.withColumn(out, F.sum("_v").over(in_chunk(series))).drop("_v")
    over = Window.partitionBy(*(series or [F.lit(0)])).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = d.groupBy(*series, "_chunk").agg(F.sum("_v").alias("_t")).select(*series, "_chunk", F.coalesce(F.sum("_t").over(over), F.lit(0)).alias("_carried"))
    d = join_groups(d.withColumn("_own", F.sum("_v").over(in_chunk(series))), totals, [*series, "_chunk"])
    return d.withColumn(out, F.col("_own") + F.col("_carried")).drop("_v", "_own", "_carried")
