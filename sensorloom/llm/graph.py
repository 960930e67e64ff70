"""Connected components as iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int | None = None) -> DataFrame:
    """``node, root``: the smallest node reachable from each node of ``edges`` (long columns ``a`` and ``b``).

    Each round takes the least label among the neighbours and then the label's
    own label, so distances halve; rounds end when no label changes, or after ``rounds``: then
    nodes with one label are connected, but a component may still have several. Edges and
    labels stay distributed and each round's labels are cut off from their
    lineage. Minima are pre-aggregated before each shuffle, so a node with very
    many neighbours costs no single task. Rows with a null end are ignored; an
    empty input gives an empty result.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    both = cut(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")))
    for done in range(1, 100):
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("root").alias("near"))
        least = labels.join(near, labels.node == near.u).select("node", F.least("root", "near").alias("low"), "root")
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("far"))
        new = cut(least.join(jump, "low", "left").select("node", F.least("low", F.coalesce("far", "low")).alias("next"), "root"))
        labels = new.select("node", F.col("next").alias("root"))
        if done == rounds or not new.where("next <> root").limit(1).count():
            return labels
    raise RuntimeError("components did not settle")
