"""The driver tables as measurement tables, in Spark and as the SQL that defines the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as measurements of trees at two sites, some without a reading."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        "ts",
        F.col("user_id").alias("tree"),
        F.when(F.col("user_id") % 2 == 0, "Wetland").otherwise("Upland").alias("site"),
        F.col("event_type").alias("species"),
        "value",
        (F.col("value") - 40).alias("flux"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("reading"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"),
    )


FLUX = """flux as (select event_id, ts, user_id as tree, case when user_id % 2 = 0 then 'Wetland' else 'Upland' end as site, event_type as species,
 value, value - 40 as flux, case when event_id % 7 <> 0 then value end as reading, date_trunc('hour', ts)::timestamp as hour from events)"""

SPECIES = ("click", "error", "purchase", "signup", "view")


def driver_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly drivers in long form: mean reading by hour and species (``variable``); every hour of every driver is there."""
    f = flux(spark, sf_dir)
    wide = f.groupBy(F.col("hour").alias("datetime")).agg(*[F.avg(F.when(F.col("species") == s, F.col("reading"))).alias(s) for s in SPECIES])
    return wide.select("datetime", F.explode(F.array(*[F.struct(F.lit(s).alias("variable"), F.col(s).alias("value")) for s in SPECIES])).alias("_v")).select("datetime", "_v.variable", "_v.value")


LONG = (
    FLUX
    + """,
species as (select unnest(['click', 'error', 'purchase', 'signup', 'view']) as variable),
long as (select h.hour as datetime, s.variable, avg(f.reading) as value from (select distinct hour from flux) h cross join species s
 left join flux f on f.hour = h.hour and f.species = s.variable group by 1, 2)"""
)


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as four sensor channels by ship date."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))


CHANNELS = "channels as (select l_shipdate as ts, l_quantity as quantity, l_extendedprice as price, l_discount as discount, l_tax as tax from lineitem)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded, without -0."""
    return df.select(*[(F.round(F.col(c), digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rounded_scaled(df: DataFrame, digits: int) -> DataFrame:
    """All doubles rounded as the SQL does it: scaled, to the nearest whole number, and back. ``F.round`` takes the shortest decimal of a double instead, and goes the other way at some ties."""
    scaled = lambda c: F.round(F.col(c) * 10.0**digits) / 10.0**digits + 0.0
    return df.select(*[scaled(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
