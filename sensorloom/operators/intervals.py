"""Allan deviations of intervals that overlap at will, without a row for each sample and interval.

An interval's samples are a run of its series in order of time. Differences are merged in pairs, pairs of pairs and so on (number, mean and
squares within), so the differences of any run are a few merged ones: no sum reaches outside the interval, and
a spike or a NaN in front of it changes nothing. A series of many rows is cut into bins of time, and an interval's parts are put together.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import join_groups
from .series import time_bins

#: Rows of a series that one task holds.
HELD_ROWS = 500_000


def merged(a: Sequence[np.ndarray], b: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Number, mean and squares within of two sets together."""
    (k, m, s), (l, n, t) = a, b
    with np.errstate(invalid="ignore", over="ignore"):
        d, share = n - m, l / np.maximum(k + l, 1)
        return [k + l, np.where(l == 0, m, m + d * share), s + t + np.where(k * l > 0, d * d * k * share, 0.0)]


def runs(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Number, mean and squares within of ``x[a[i]:b[i]]`` for each i."""
    a, b = a.copy(), np.maximum(a, b)
    level = [np.ones(len(x)), x, np.zeros(len(x))]
    left, right = ([np.zeros(len(a)) for _ in range(3)] for _ in range(2))
    while (a < b).any():
        at = np.flatnonzero((a < b) & (a % 2 == 1))
        for mine, new in zip(left, merged([c[at] for c in left], [c[a[at]] for c in level]), strict=True):
            mine[at] = new
        a[at] += 1
        at = np.flatnonzero((a < b) & (b % 2 == 1))
        b[at] -= 1
        for mine, new in zip(right, merged([c[b[at]] for c in level], [c[at] for c in right]), strict=True):
            mine[at] = new
        a, b = a // 2, b // 2
        level = [np.append(c, 0.0) if len(c) % 2 else c for c in level]
        level = merged([c[::2] for c in level], [c[1::2] for c in level])
    return merged(left, right)


def once_and_again(intervals: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """Intervals whose key stands once, and those of other keys, if there are any."""
    again = intervals.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)
    if again.isEmpty():
        return intervals, None
    return join_groups(intervals, again, [key], "left_anti"), join_groups(intervals, again, [key], "left_semi")


def allan_of_intervals(samples: DataFrame, intervals: DataFrame, by: Sequence[str], key: str, order: Sequence[str], cols: Sequence[str], start: str = "start_ts", end: str = "end_ts", part: tuple[str, str] | None = None) -> DataFrame:
    """``key, n, allan_sd_<col>``: as ``quality.allan_sd`` over ``joins.assign_intervals``, for keys that stand once. ``order``: time first.

    ``part``: a column of the samples and one of the intervals; an interval takes the samples of its series with the same value, or all where it has none.
    """
    ts, names = order[0], [f"v{i}" for i in range(len(cols))]
    kind = dict(samples.dtypes)[ts]
    kind = kind if kind.startswith("timestamp") else "timestamp_ntz"
    series = [f"g{i}" for i in range(len(by))]
    keep = [F.col(b).alias(g) for b, g in zip(by, series, strict=True)]
    mine, theirs = [F.col(c) for c in part] if part else [F.lit(None).cast("string")] * 2
    s = samples.select(*keep, mine.alias("part"), F.col(ts).cast(kind).alias("t"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order[1:])], *[F.col(c).cast("double").alias(v) for c, v in zip(cols, names, strict=True)]).dropna(subset=[*series, "t"])
    iv = intervals.select(*keep, theirs.alias("part"), F.col(key).alias("key"), F.col(start).cast(kind).alias("a"), F.col(end).cast(kind).alias("b")).dropna(subset=series).where("a <= b")
    cuts = time_bins(s, series, "t", HELD_ROWS)
    whole = cuts is None
    bin_of = lambda c: F.coalesce(F.size(F.filter("_cuts", lambda x: x < F.col(c))), F.lit(0))
    if whole:
        s, iv = s.withColumn("bin", F.lit(0)), iv.withColumn("bin", F.lit(0))
    else:
        s = join_groups(s, cuts, series).withColumn("bin", bin_of("t")).drop("_cuts")
        iv = join_groups(iv, cuts, series).withColumn("bin", F.explode(F.sequence(bin_of("a"), bin_of("b")))).drop("_cuts")
    sort = [("t", "ascending"), *[(f"o{i}", "ascending") for i in range(len(order) - 1)]]

    def of_one(d, intervals):
        import pyarrow as pa

        micros = lambda c: c.cast(pa.int64()).to_numpy()
        t = micros(d["t"])
        a, b = np.searchsorted(t, micros(intervals["a"]), "left"), np.searchsorted(t, micros(intervals["b"]), "right")
        out = {"key": intervals["key"], "bin": intervals["bin"], "n": b - a}
        for v in names:
            at = np.flatnonzero(d[v].is_valid().to_numpy())
            x = d[v].to_numpy()[at]
            p, q = np.searchsorted(at, a), np.searchsorted(at, b)
            with np.errstate(invalid="ignore", over="ignore"):
                k, mean, squares = runs(np.diff(x), p, np.maximum(q - 1, p))
            some, x = q > p, x if len(x) else np.zeros(1)
            edge = lambda i: pa.array(x[np.where(some, i, 0)], mask=~some)  # noqa: E731, B023
            out |= {f"{v}_first": edge(p), f"{v}_last": edge(q - 1), f"{v}_k": k, f"{v}_mean": mean, f"{v}_squares": squares}
        return pa.table(out)

    def parts(samples, intervals):
        import pyarrow as pa
        import pyarrow.compute as pc

        d = samples.take(pc.sort_indices(samples, sort_keys=sort, null_placement="at_start"))
        every = pc.is_null(intervals["part"])
        found, own = [of_one(d, intervals.filter(every))], intervals.filter(pc.invert(every))
        if len(own):
            kinds = pc.unique(own["part"])
            places = lambda c: pc.fill_null(pc.index_in(c, value_set=kinds), len(kinds)).to_numpy()
            of_d, of_own = places(d["part"]), places(own["part"])
            rows, cuts = np.argsort(of_d, kind="stable"), np.searchsorted(np.sort(of_d), np.arange(len(kinds) + 1))
            for i in range(len(kinds)):
                found.append(of_one(d.take(rows[cuts[i] : cuts[i + 1]]), own.filter(pa.array(of_own == i))))
        return pa.concat_tables(found)

    each = "".join(f", {v}_first double, {v}_last double, {v}_k double, {v}_mean double, {v}_squares double" for v in names)
    schema = f"key {iv.schema['key'].dataType.simpleString()}, bin int, n bigint{each}"
    found = s.groupBy(*series, "bin").cogroup(iv.groupBy(*series, "bin")).applyInArrow(parts, schema)
    if not whole:
        found = _together(found, names)
    sd = [F.when(F.col(f"{v}_k") >= 2, F.sqrt(F.col(f"{v}_squares") / (F.col(f"{v}_k") - 1) / 2)).alias(f"allan_sd_{c}") for v, c in zip(names, cols, strict=True)]
    return found.where("n > 0").select(F.col("key").alias(key), "n", *sd)


def _together(found: DataFrame, names: Sequence[str]) -> DataFrame:
    """Parts of an interval as one: those between two parts' last and first values are differences too."""
    own = lambda v: F.struct("bin", *[F.col(f"{v}_{x}").alias(x) for x in ("first", "last", "k", "mean", "squares")])
    d = found.groupBy("key").agg(F.sum("n").alias("n"), *[F.array_sort(F.collect_list(F.when(F.col(f"{v}_first").isNotNull(), own(v)))).alias(v) for v in names])
    for v in names:
        between = f"transform({v}, (p, i) -> if(i > 0, named_struct('k', 1D, 'mean', p.first - {v}[i - 1].last, 'squares', 0D), named_struct('k', 0D, 'mean', 0D, 'squares', 0D)))"
        d = d.withColumn(v, F.expr(f"filter(concat(transform({v}, p -> named_struct('k', p.k, 'mean', p.mean, 'squares', p.squares)), {between}), p -> p.k > 0)"))
        d = d.withColumn(f"{v}_k", F.expr(f"aggregate({v}, 0D, (a, p) -> a + p.k)"))
        d = d.withColumn(f"{v}_mean", F.expr(f"aggregate({v}, 0D, (a, p) -> a + p.k / {v}_k * p.mean)"))
        d = d.withColumn(f"{v}_squares", F.expr(f"aggregate({v}, 0D, (a, p) -> a + p.squares + p.k * (p.mean - {v}_mean) * (p.mean - {v}_mean))"))
    return d
