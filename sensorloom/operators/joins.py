"""Joins of measurements: backbones, intervals, nearest and last values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import chunks, last_before


def backbone(sources: Sequence[DataFrame], ts: str = "datetime") -> DataFrame:
    """All distinct times of the sources."""
    return reduce(DataFrame.unionAll, [s.select(ts) for s in sources]).where(F.col(ts).isNotNull()).distinct()


def align(base: DataFrame, sources: Sequence[DataFrame], ts: str = "datetime") -> DataFrame:
    return reduce(lambda a, b: a.join(b, ts, "left"), sources, base)


def merge_all(dfs: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Full outer merge of sources with one row a key each, as one union and one grouping: one shuffle for any number of sources."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
    return every.groupBy(*on).agg(*[F.first(c, ignorenulls=True).alias(c) for c in every.columns if c not in on])


def merge_outer(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    return a.join(b, list(on), "full")


def left_lookup(df: DataFrame, dim: DataFrame, left_key: str, right_key: str, fill: Sequence[str] = (), broadcast: bool = False) -> DataFrame:
    """Left join on differently named keys; columns of ``fill`` take the dimension's value where they are NULL."""
    own = dim.select(F.col(right_key).alias("_key"), *[F.col(c).alias(f"_dim_{c}" if c in df.columns else c) for c in dim.columns if c != right_key])
    out = df.join(F.broadcast(own) if broadcast else own, F.col(left_key) == F.col("_key"), "left").drop("_key")
    for c in fill:
        out = out.withColumn(c, F.coalesce(c, f"_dim_{c}"))
    return out.drop(*[c for c in out.columns if c.startswith("_dim_")])


def attach_labels(df: DataFrame, dim: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(dim, list(on), "left")


def keep_in(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys, list(on), "left_semi")


def not_in(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys, list(on), "left_anti")


def reconcile(expected: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """``key, expected, actual, status``: match, differs, missing or extra."""
    e = expected.select(key, F.col(value).alias("expected"), F.lit(True).alias("_e"))
    a = actual.select(key, F.col(value).alias("actual"), F.lit(True).alias("_a"))
    status = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "extra").when(F.col("expected").eqNullSafe(F.col("actual")), "match").otherwise("differs")
    return e.join(a, key, "full").select(key, "expected", "actual", status.alias("status"))


def assign_intervals(samples: DataFrame, intervals: DataFrame, by: Sequence[str], ts: str = "ts", start: str = "start_ts", end: str = "end_ts", bucket_s: int = 3600) -> DataFrame:
    """Each sample with the intervals that contain it (both ends included).

    An interval is exploded into the time buckets that it touches, so the join is an equality on
    the keys and the bucket, whatever the length of a day's trace; a sample lies in one bucket.
    """
    at = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / bucket_s)
    spread = intervals.withColumn("_b", F.explode(F.sequence(at(start), at(end))))
    keyed = samples.withColumn("_b", at(ts))
    return keyed.join(spread, [*by, "_b"]).where(F.col(ts).between(F.col(start), F.col(end))).drop("_b")


def known_and_alone(samples: DataFrame, intervals: DataFrame, machine: str, date: str) -> tuple[DataFrame, DataFrame]:
    """Intervals of machines with and without samples on their date."""
    seen = samples.select(machine, date).distinct()
    return intervals.join(seen, [machine, date], "left_semi"), intervals.join(seen, [machine, date], "left_anti")


def assign_with_fallback(samples: DataFrame, intervals: DataFrame, machine: str, date: str, **names) -> DataFrame:
    """As above by machine and date; intervals of a machine without samples on its date take those of all machines.

    Such an interval stands once for each machine of its date, so that one join does for both kinds and samples are shuffled once.
    """
    known, alone = known_and_alone(samples, intervals, machine, date)
    own = F.coalesce(F.concat(F.lit("="), F.col(machine).cast("string")), F.lit(""))  # samples of no machine count too
    s = samples.withColumn("_on", own)
    each = known.withColumn("_on", own).unionByName(alone.join(s.select(date, "_on").distinct(), date))
    out = assign_intervals(s.drop(machine), each, [date, "_on"], **names)
    return out.select(machine, date, *[c for d in (samples, intervals) for c in d.columns if c not in (machine, date)])


def join_nearest(left: DataFrame, right: DataFrame, key: str, by: Sequence[str], left_ts: str, right_ts: str, tolerance_s: int, tie: str) -> DataFrame:
    """Each left row with the right row nearest in time within the tolerance (included), ties to the smallest ``tie``.

    Right rows go to their own and both neighbouring buckets of the tolerance's width. In a bucket's order of time the nearest row is the last one
    before a left row or the first one after it, so there is no row for each pair. ``key`` names left rows; each counts by itself.
    """
    width = max(tolerance_s, 1)
    sec = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    values = [c for c in right.columns if c not in by]
    names = [f"_by{i}" for i in range(len(by))]
    keys = [F.col(b).alias(n) for b, n in zip(by, names, strict=True)]
    bucket = F.floor(F.col("_at") / (width * 1_000_000))
    r = right.select(*keys, sec(right_ts).alias("_at"), F.struct(F.col(tie).alias("_tie"), F.struct(*values).alias("_row")).alias("_r")).dropna(subset=[*names, "_at"])
    r = r.withColumn("_b", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    both = left.select(*keys, sec(left_ts).alias("_at"), F.struct(*left.columns).alias("_left")).withColumn("_b", bucket).unionByName(r, allowMissingColumns=True)
    found = []
    for side, order in (("_before", F.col("_at").asc()), ("_after", F.col("_at").desc())):
        # of right rows at one time the smallest comes last, and left rows after them
        w = Window.partitionBy(*names, "_b").orderBy(order, F.col("_left").isNotNull(), F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        both = both.withColumn(side, F.last(F.when(F.col("_left").isNull(), F.struct("_at", "_r")), ignorenulls=True).over(w))
        gap = F.abs(F.col("_at") - F.col(f"{side}._at"))
        found.append(F.when(gap <= tolerance_s * 1_000_000, F.struct(gap.alias("_gap"), F.col(f"{side}._r._tie").alias("_tie"), F.col(f"{side}._r._row").alias("_row"))))
    near = both.where(F.col("_left").isNotNull()).select("_left", F.least(*found).alias("_m"))
    return near.select(*[F.col(f"_left.{c}").alias(c) for c in left.columns], *[F.col(f"_m._row.{c}").alias(c if c not in left.columns else f"{c}_near") for c in values], (F.col("_m._gap") / 1_000_000).alias("gap_s"))


def join_asof(left: DataFrame, right: DataFrame, ts: str, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Each left row with the last right value at or before its time, by series: one union, no pairs; a long series is many tasks, with the last values carried between them.

    Of several right rows at one time the largest values count (the first column decides, then the next).
    """
    l = left.withColumn("_side", F.lit(1))  # noqa: E741
    r = right.select(*by, ts, *values).withColumn("_side", F.lit(0))
    both = chunks(l.unionByName(r, allowMissingColumns=True), by, [ts, "_side", *values])
    filled = last_before(both, by, values, here=True)
    return filled.select(*[c for c in filled.columns if c not in values and c not in [f"_last_{v}" for v in values]], *[F.col(f"_last_{v}").alias(v) for v in values]).where("_side = 1").drop("_side", "_chunk", "_pos", "_halo")


def compare_modes(best: DataFrame, keys: Sequence[str], mode: str, modes: tuple[str, str], values: Sequence[str]) -> DataFrame:
    """Two modes of one table side by side in one pass."""
    aggs = [F.max(F.when(F.col(mode) == m, F.col(v))).alias(f"{v}_{m}") for v in values for m in modes]
    return best.groupBy(*keys).agg(*aggs)


def union_all(dfs: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def union_tagged(tagged: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    return union_all([df.withColumn(tag, F.lit(name)) for name, df in tagged.items()])


def common_keys(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    return a.select(*on).intersect(b.select(*on))


def only_in(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    return a.select(*on).subtract(b.select(*on))


def both_differences(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    return union_tagged({"left_only": only_in(a, b, on), "right_only": only_in(b, a, on)}, "side")


def with_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """``df`` beside the columns of a one-row aggregate."""
    return df.crossJoin(F.broadcast(scalars))


def first_non_null(*cols: Column) -> Column:
    return F.coalesce(*cols)
