"""Window functions over series and groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import join_groups, quantiles, value_ranks, with_group
from .series import chunks, in_chunk, own_rows, rolled, running_sum


def roll_mean(df: DataFrame, series: Sequence[str], ts: str, col: str, n: int, strict: bool = False, out: str = "roll") -> DataFrame:
    """Mean of the last n rows without NULLs; NULL before there are n rows or, with ``strict``, if one of them is NULL. As all rolling functions, over chunks where a series is long."""
    return rolled(df, series, ts, n, **{out: lambda w, full: F.when(F.count(col).over(w) == n if strict else full, F.avg(col).over(w))})


def roll_sum(df: DataFrame, series: Sequence[str], ts: str, col: str, n: int, out: str = "roll") -> DataFrame:
    """Sum of the last n rows; without any value it is 0."""
    return rolled(df, series, ts, n, **{out: lambda w, full: F.when(full, F.coalesce(F.sum(col).over(w), F.lit(0.0)))})


def roll_sd(df: DataFrame, series: Sequence[str], ts: str, col: str, n: int, out: str = "roll") -> DataFrame:
    return rolled(df, series, ts, n, **{out: lambda w, full: F.when(full, F.stddev_samp(col).over(w))})


def means_in_order(df: DataFrame, by: Sequence[str], order: Sequence[str], **columns: Column) -> DataFrame:
    """Means by group whose values are added one after the other in the order given: equal groups have equal means to the last digit however rows are dealt, which ranks of means need. A long group is many chunks, whose sums are added in their order."""
    c = chunks(df, by, order).rows.withColumns({f"_v_{n}": v.cast("double") for n, v in columns.items()})
    w = in_chunk(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = c.withColumns({f"_s_{n}": F.sum(f"_v_{n}").over(w) for n in columns})
    each = sums.groupBy(*by, "_chunk").agg(*[a for n in columns for a in (F.max_by(f"_s_{n}", "_pos").alias(f"_s_{n}"), F.count(f"_v_{n}").alias(f"_n_{n}"))])
    parts = lambda n: F.array_sort(F.collect_list(F.when(F.col(f"_n_{n}") > 0, F.struct("_chunk", F.col(f"_s_{n}").alias("s")))))
    total = lambda n: F.aggregate(parts(n), F.lit(0.0), lambda a, x: a + x["s"])
    return each.groupBy(*by).agg(*[F.try_divide(total(n), F.sum(f"_n_{n}")).alias(n) for n in columns])


def sampling_rounds(df: DataFrame, date: str, gap_days: int = 7, by: Sequence[str] = ()) -> DataFrame:
    """``round`` from 1: a new one begins after more than ``gap_days`` days without a row. Worked out on distinct dates and joined back."""
    days = df.select(*by, date).where(F.col(date).isNotNull()).distinct()
    w = Window.partitionBy(*by).orderBy(date) if by else Window.partitionBy(F.lit(0)).orderBy(date)
    fresh = (F.coalesce(F.datediff(F.col(date), F.lag(date).over(w)), F.lit(0)) > gap_days).cast("int")
    numbered = days.withColumn("_f", fresh).withColumn("round", F.sum("_f").over(w) + 1).drop("_f")
    return df.join(numbered, [*by, date])


def episodes(df: DataFrame, series: Sequence[str], ts: str, state: str, keep: Sequence[str] | None = None) -> DataFrame:
    """First and last time of each run of one state, by series. In long series a run's number is counted up in chunks and carried, so a run may span any number of them."""
    c = chunks(df, series, [ts], 1)
    changes = c.rows.withColumn("_change", (~F.col(state).eqNullSafe(F.lag(state).over(in_chunk(series)))).cast("int")).where(~F.col("_halo"))
    runs = running_sum(c._replace(rows=changes), series, F.col("_change"), "_run")
    out = runs.groupBy(*series, "_run", state).agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n"))
    return (out if keep is None else out.where(F.col(state).isin(list(keep)))).drop("_run")


def clip_intervals(df: DataFrame, lo: Column, hi: Column, start: str = "start", end: str = "end") -> DataFrame:
    inside = df.where((F.col(end) >= lo) & (F.col(start) <= hi))
    return inside.withColumn(start, F.greatest(F.col(start), lo)).withColumn(end, F.least(F.col(end), hi))


def zscore(df: DataFrame, by: Sequence[str], col: str, out: str = "z", zero: bool = False) -> DataFrame:
    """(x - mean) / sd in groups, or in the whole table as one aggregate beside it. With ``zero``, what can't be divided is 0."""
    z = F.try_divide(F.col(col) - F.col("_m"), F.col("_s"))
    return with_group(df, by, _m=F.avg(col), _s=F.stddev_samp(col)).withColumn(out, F.coalesce(z, F.lit(0.0)) if zero else z).drop("_m", "_s")


def minmax(df: DataFrame, by: Sequence[str], col: str, out: str = "scaled") -> DataFrame:
    return with_group(df, by, _a=F.min(col), _b=F.max(col)).withColumn(out, F.try_divide(F.col(col) - F.col("_a"), F.col("_b") - F.col("_a"))).drop("_a", "_b")


def rank_avg(df: DataFrame, by: Sequence[str], col: str, out: str = "rank", descending: bool = True) -> DataFrame:
    """Ranks with ties at their mean rank; NULL has none. Distinct values are ranked over bins of a group's range, and joined back."""
    r = value_ranks(df, by, col)
    first = F.col("n") - F.col("before") - F.col("c") if descending else F.col("before")
    r = r.select(*by, F.col("x").alias("_x"), (first + 1 + (F.col("c") - 1) / 2).alias(out))
    return join_groups(df.withColumn("_x", F.col(col).cast("double")), r, [*by, "_x"]).drop("_x")


def topn(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, ties: bool = True) -> DataFrame:
    f = F.rank() if ties else F.row_number()
    return df.withColumn("_k", f.over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def top1(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return topn(df, by, order, 1, ties=False)


def head_by(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    return topn(df, by, order, n, ties=False)


def dedupe(df: DataFrame, key: Sequence[str], priority: Column, then: Sequence[Column] = ()) -> DataFrame:
    """One row a key: the highest priority, unranked last."""
    return top1(df, key, [priority.desc_nulls_last(), *then])


def first_per(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top1(df, key, order)


def fill_first(df: DataFrame, by: Sequence[str], col: str, order: str, out: str | None = None) -> DataFrame:
    """NULLs take the entity's first value."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn(out or col, F.coalesce(col, F.first(col, ignorenulls=True).over(w)))


def date_index(df: DataFrame, date: str, out: str = "date_index") -> DataFrame:
    """Ordinal of each distinct date; the window is over the dates only."""
    days = df.select(date).where(F.col(date).isNotNull()).distinct()
    return df.join(days.withColumn(out, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(date))), date)


def rank_variables(df: DataFrame, group: str, variable: str, value: str) -> DataFrame:
    """Variables ordered by mean value in their group, groups by their mean of those; ties by name."""
    each = df.groupBy(group, variable).agg(F.avg(F.abs(value)).alias("strength"))
    each = each.withColumn("rank_in_group", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("strength"), variable)))
    whole = each.groupBy(group).agg(F.avg("strength").alias("group_strength"))
    whole = whole.withColumn("group_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("group_strength"), group)))
    return each.join(whole, group).select(group, variable, "strength", "rank_in_group", "group_rank")


def pct_retained(df: DataFrame, by: Sequence[str], test: Column, out: str = "pct_retained") -> DataFrame:
    return with_group(df, by, **{out: 100 * F.avg(F.coalesce(test, F.lit(False)).cast("int"))})


def quantile_bands(df: DataFrame, col: str, probs: Sequence[float]) -> DataFrame:
    """A band around each quantile: midpoints to its neighbours, NULL for no end."""
    names = [f"q{i}" for i in range(len(probs))]
    q = quantiles(df, [], col, dict(zip(names, probs, strict=True))).select(F.posexplode(F.array(*names)).alias("band", "centre"))
    w = Window.partitionBy(F.lit(0)).orderBy("band")
    return q.select("band", "centre", ((F.lag("centre").over(w) + F.col("centre")) / 2).alias("lower"), ((F.lead("centre").over(w) + F.col("centre")) / 2).alias("upper"))


def thin_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int = 6) -> DataFrame:
    """Every ceil(n/k)-th row of each group, from its first, and its last."""
    w = Window.partitionBy(*by)
    d = df.withColumn("_i", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count("*").over(w))
    return d.where(((F.col("_i") - 1) % F.ceil(F.col("_n") / k) == 0) | (F.col("_i") == F.col("_n"))).drop("_i", "_n")


def first_difference(df: DataFrame, by: Sequence[str], order: Sequence[str], col: str, out: str = "diff") -> DataFrame:
    """x - previous x; rows without a value are left out first."""
    c = chunks(df.where(F.col(col).isNotNull()), by, order, 1).rows
    return own_rows(c.withColumn(out, F.col(col) - F.lag(col).over(in_chunk(by))))


def top_abs(df: DataFrame, col: str, k: int, then: Sequence[Column] = ()) -> DataFrame:
    return df.orderBy(F.abs(col).desc_nulls_last(), *then).limit(k)
