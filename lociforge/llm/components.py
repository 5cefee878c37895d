"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _smallest(edges: DataFrame, both: bool) -> DataFrame:
    """One star step. For every node u and m, the least of u and its neighbours: the larger neighbours (both) or the
    smaller ones and u itself are linked to m instead. Minima are combined before the shuffle, so hubs do no harm."""
    near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if both:
        near = near.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("low"))
    pairs = near.join(least, "u").select("u", "v", F.least("u", "low").alias("m"))
    if both:
        new = pairs.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        new = pairs.select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b"))
    return new.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link, root being the least node of its component.

    `edges` has two columns of longs, in any order and with repeats; rows with a null are not links. No links: no rows.
    """
    a, b = edges.columns[:2]
    now = written(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(f"`{a}` <> `{b}`").distinct(), "links")
    mark = None
    while True:
        now = written(_smallest(_smallest(now, True), False), "links")
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
