"""Exact ranks and quantiles of groups of any size.

``percentile`` and a window over a group both gather a whole group in one task.

Quantiles: one aggregation sketches each group (mergeable, so it combines before the shuffle) and
gives a bracket of values around each quantile, with room for the sketch's error. A second one counts the values between the
brackets as one each, and keeps apart only the distinct values inside: some thousandths of a group. Running counts over these give the exact
order statistics; a bracket that missed its rank would be an error, never a wrong number.

Ranks: rows become distinct values with their counts. A large group's values are cut into ``BINS`` of about
equal number at splitters from a sample of its distinct values by hash, which is the same whenever it is drawn. Counts run inside bins and are carried over by the bins' totals.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Of the sketch: a rank's relative error is at most 1 / ACCURACY; brackets reach three times as far.
ACCURACY = 10_000
#: Bins of a large group, sampled values for each splitter, distinct values from which a group is large.
BINS, PER_BIN, LARGE = 256, 16, 65_536


def join_groups(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "left") -> DataFrame:
    """Join on group columns in which NULL is a group like others; without any, beside the one row."""
    if not by:
        return left.crossJoin(F.broadcast(right))
    r = right.select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], *[c for c in right.columns if c not in by])
    test = reduce(and_, [left[b].eqNullSafe(r[f"_by{i}"]) for i, b in enumerate(by)])
    return left.join(r, test, how).drop(*[f"_by{i}" for i in range(len(by))])


def with_group(df: DataFrame, by: Sequence[str], **columns: Column) -> DataFrame:
    """Each row with aggregates of its group: one grouping joined back, not a window, so a few large groups are not a few tasks."""
    return join_groups(df, df.groupBy(*by).agg(*[c.alias(n) for n, c in columns.items()]), by)


def splitters(d: DataFrame, by: Sequence[str], large: int = LARGE) -> DataFrame:
    """``by, splitters``: ascending values that cut the distinct values of groups with more than ``large`` into ``BINS``. ``d``: ``by, x, distinct``."""
    share = F.lit(float(BINS * PER_BIN)) / F.col("distinct")
    drawn = d.where((F.col("distinct") > large) & (F.pmod(F.xxhash64("x", F.lit(17)), F.lit(1 << 30)) < share * (1 << 30)))
    values = drawn.groupBy(*by).agg(F.sort_array(F.collect_list("x")).alias("v"))
    return values.select(*by, F.filter("v", lambda x, i: i % PER_BIN == PER_BIN - 1).alias("splitters"))


def binned_values(df: DataFrame, by: Sequence[str], col: str, large: int = LARGE) -> DataFrame:
    """``by, x, c, n, bin``: each distinct value with its count, its group's, and its bin; smaller values are in smaller bins."""
    v = df.select(*by, F.col(col).cast("double").alias("x")).where("x is not null")
    d = v.groupBy(*by, "x").agg(F.count("*").alias("c"))
    d = join_groups(d, d.groupBy(*by).agg(F.sum("c").alias("n"), F.count("*").alias("distinct")), by)
    cuts = splitters(d, by, large)
    d = join_groups(d, cuts, by) if by else d.join(F.broadcast(cuts), F.lit(True), "left")
    return d.select(*by, "x", "c", "n", F.coalesce(F.size(F.filter("splitters", lambda s: s < F.col("x"))), F.lit(0)).alias("bin"))


def value_ranks(df: DataFrame, by: Sequence[str], col: str, large: int = LARGE) -> DataFrame:
    """``by, x, c, before, n, bin``: each distinct value with its count, the number of smaller ones and of all in its group, and its bin; NULL is left out."""
    names = [f"g{i}" for i in range(len(by))]
    d = binned_values(df.select(*[F.col(b).alias(g) for b, g in zip(by, names, strict=True)], F.col(col).alias("_v")), names, "_v", large)
    inside = Window.partitionBy(*names, "bin").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*(names or [F.lit(0)])).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    total = d.groupBy(*names, "bin").agg(F.sum("c").alias("t"))
    total = total.select(*names, "bin", F.coalesce(F.sum("t").over(over), F.lit(0)).alias("carried"))
    d = join_groups(d.withColumn("own", F.coalesce(F.sum("c").over(inside), F.lit(0))), total, [*names, "bin"])
    return d.select(*[F.col(g).alias(b) for b, g in zip(by, names, strict=True)], "x", "c", (F.col("own") + F.col("carried")).alias("before"), "n", "bin")


def summarise_where(df: DataFrame, by: Sequence[str], value: Column, tests: Sequence[Column], probs: Sequence[float], aggs: Mapping[str, Column]) -> DataFrame:
    """``by``, the aggregates, and for test i and probability j a column ``q{i}_{j}``: the exact quantile, interpolated between neighbours, of the values whose row passes the test. NULL without such a value.

    Aggregates may use ``_x`` (the value) and ``_t{i}`` (the tests, false for NULL values).
    """
    span, k, ps = 3 / ACCURACY, range(len(tests)), range(len(probs))
    edges = ", ".join(f"{min(1.0, max(0.0, p + s))!r}D" for p in probs for s in (-span, span))
    d = df.withColumn("_x", value.cast("double")).withColumns({f"_t{i}": F.coalesce(t, F.lit(False)) & F.col("_x").isNotNull() for i, t in enumerate(tests)})
    first = d.groupBy(*by).agg(*[a.alias(n) for n, a in aggs.items()], *[F.expr(f"percentile_approx(if(_t{i}, _x, null), array({edges}), {ACCURACY}) as _e{i}") for i in k])
    some = d.select(*by, "_x", *[f"_t{i}" for i in k]).where(" or ".join(f"_t{i}" for i in k))
    near = join_groups(some, first.select(*by, *[f"_e{i}" for i in k]), by, "inner")
    inside = " or ".join(f"coalesce(_x >= _e{i}[{2 * j}] and _x <= _e{i}[{2 * j + 1}], false)" for i in k for j in ps)
    gap = " + ".join(f"coalesce(cast(_x > _e{i}[{2 * j + 1}] as int), 0)" for i in k for j in ps)
    # a row for each value inside a bracket and for all values between two neighbouring ones
    near = near.withColumn("_inside", F.expr(inside))
    rows = near.groupBy(*by, F.expr("if(_inside, _x, null) as _value"), F.expr(f"if(_inside, null, {gap}) as _gap"))
    rows = rows.agg(F.expr("min(_x) as _at"), *[F.expr(f"{f}(if(_t{i}, _x, null)) as _{n}{i}") for i in k for n, f in (("c", "count"), ("a", "min"), ("b", "max"))])
    group = ", ".join(f"`{b}`" for b in by) or "0"
    over = f"over (partition by {group} order by _at rows between unbounded preceding and 1 preceding)"
    rows = rows.selectExpr(*[f"`{b}`" for b in by], *[c for i in k for c in (f"_c{i}", f"_a{i}", f"_b{i}", f"coalesce(sum(_c{i}) {over}, 0) as _before{i}", f"sum(_c{i}) over (partition by {group}) as _n{i}")])
    picks, made = [], []
    missed = "cast(raise_error('a quantile lies outside its bracket') as double)"
    for i in k:
        for j, p in enumerate(probs):
            at = f"({float(p)!r}D * (_n{i} - 1))"
            for name, rank in (("l", f"floor({at})"), ("h", f"ceil({at})")):
                found = f"case when _a{i} = _b{i} or {rank} = _before{i} then _a{i} when {rank} = _before{i} + _c{i} - 1 then _b{i} else {missed} end"
                picks.append(f"max(case when _before{i} <= {rank} and {rank} < _before{i} + _c{i} then {found} end) as _{name}{i}_{j}")
            picks.append(f"max({at} - floor({at})) as _f{i}_{j}")
            made.append(f"_l{i}_{j} + _f{i}_{j} * (_h{i}_{j} - _l{i}_{j}) as q{i}_{j}")
    exact = rows.groupBy(*by).agg(*map(F.expr, picks)).selectExpr(*[f"`{b}`" for b in by], *made)
    plain = first.select(*by, *aggs)
    return join_groups(plain, exact, by) if by else plain.join(F.broadcast(exact), F.lit(True), "left")


def summarise(df: DataFrame, by: Sequence[str], col: str | Column, probs: Mapping[str, float], aggs: Mapping[str, Column]) -> DataFrame:
    """A grouped table: the aggregates, and a column for each named exact quantile of ``col``, NULL for groups without a value. Two scans."""
    out = summarise_where(df, by, F.col(col) if isinstance(col, str) else col, [F.lit(True)], list(probs.values()), aggs)
    return out.select(*by, *aggs, *[F.col(f"q0_{j}").alias(n) for j, n in enumerate(probs)])


def quantiles(df: DataFrame, by: Sequence[str], col: str, probs: Mapping[str, float]) -> DataFrame:
    """A column for each named quantile, interpolated between neighbours; groups without a value have no row."""
    out = summarise(df.where(F.col(col).isNotNull()), by, col, probs, {"_rows": F.count("*")})
    return out.where("_rows > 0").drop("_rows")


def with_quantiles(out: DataFrame, df: DataFrame, by: Sequence[str], col: str, probs: Mapping[str, float]) -> DataFrame:
    """A grouped table with exact quantiles of ``df``'s groups beside it."""
    if by:
        return join_groups(out, quantiles(df, by, col, probs), by)
    return out.join(F.broadcast(quantiles(df, by, col, probs)), F.lit(True), "left")
