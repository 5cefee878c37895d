"""Exact quantiles by selection: the different values are cut into ranges, the totals of the ranges tell where an order
statistic lies, and only that range is read again.

Ranges are those of Spark's range partitioning over keys and value together, as many as the number of different values
asks for, so that neither a large key nor a table without keys makes one task hold more than a range. They are written
once, since a sampled range partitioning may cut elsewhere when it is made again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import in_ranges
from .shared import checkpointed

#: Different values to a range, about.
RANGE_VALUES = 500_000


def value_ranges_of(df: DataFrame, keys: list[str], value: str, adds: dict[str, Column] | None = None, per: int = RANGE_VALUES) -> tuple[DataFrame, DataFrame]:
    """Written counts (keys, value, __n, the aggregates `adds`, __range) of the different values that aren't null, and the
    totals of each range, (keys, __range, __t, __before, __all): its rows, those of smaller ranges and those of its keys."""
    keys, spark = list(keys), df.sparkSession
    counts = checkpointed(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"), *(c.alias(a) for a, c in (adds or {}).items())))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-counts.count() // per))
    ranged = in_ranges(counts, [F.col(c) for c in (*keys, value)], True, ranges)
    return ranged, range_totals(ranged, keys)


def range_totals(ranged: DataFrame, keys: list[str]) -> DataFrame:
    """The second table of `value_ranges_of`: no more rows than keys and ranges."""
    over = Window.partitionBy(*keys)
    t = ranged.groupBy(*keys, "__range").agg(F.sum("__n").alias("__t"))
    return t.withColumns({"__before": F.sum("__t").over(over.orderBy("__range")) - F.col("__t"), "__all": F.sum("__t").over(over)})


def quantiles(df: DataFrame, value: str, qs: dict[str, float], keys: list[str] = ()) -> DataFrame:
    """One row per keys that have values, with a column for each share of `qs`: linear between the neighbouring order
    statistics. Nulls don't count, NaN is the largest value and null keys are a group; a table
    without values has no rows, without keys one of nulls."""
    keys = list(keys)
    ranged, totals = value_ranges_of(df.select(*keys, value), keys, value)
    at = {name: (F.col("__all") - 1) * float(q) for name, q in qs.items()}
    places = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(a), F.ceil(a)) for a in at.values()))))
    inside = F.filter(places, lambda p: (p >= F.col("__before")) & (p < F.col("__before") + F.col("__t")))
    wanted = totals.withColumn("__places", inside).where(F.size("__places") > 0)
    # Only ranges with a place in them are dealt out, by key and range, and summed up inside.
    up = Window.partitionBy(*keys, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    wanted = wanted.select(*(F.col(k).alias(f"__on_{k}") for k in keys), F.col("__range").alias("__at"), "__before", "__places", "__all")
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__on_{k}")) for k in keys), F.col("__range") == F.col("__at"))
    near = ranged.join(wanted, same)
    near = near.withColumn("__upto", F.col("__before") + F.sum("__n").over(up))
    hit = F.filter("__places", lambda p: (p < F.col("__upto")) & (p >= F.col("__upto") - F.col("__n")))
    found = near.select(*keys, "__all", F.explode(hit).alias("__place"), F.col(value).cast("double").alias("__v"))
    got = found.groupBy(*keys).agg(F.max("__all").alias("__all"), F.map_from_entries(F.collect_list(F.struct("__place", "__v"))).alias("__got"))  # two places a quantile

    def between(name: str) -> Column:
        low, high = F.floor(at[name]), F.ceil(at[name])
        a, b = F.element_at("__got", low), F.element_at("__got", high)
        return F.when(a == b, a).otherwise((high - at[name]) * a + (at[name] - low) * b)

    return got.select(*keys, *(between(name).alias(name) for name in qs))
