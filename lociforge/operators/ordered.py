"""Places and running totals down one long order, without a task that holds the whole order.

The order is cut into ranges; rows are counted inside their range, and what the ranges before it hold is added from a
small table of totals. Hash orders are cut by bits of the hash; orders by value at values that are drawn by their hash
among the different ones, so that every run and every retried task cuts at the same places.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpointed, shared_folder

#: Ranges of a hash order, and the most bounds of an order by value.
HASH_RANGES, VALUE_BOUNDS = 1024, 127


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join in which null keys meet; without keys `right` has one row. Columns of `left`, then the others of `right`."""
    if not on:
        return left.crossJoin(F.broadcast(right))  # one row
    right = right.select(*(F.col(c).alias(f"__on_{c}") if c in on else F.col(c) for c in right.columns))
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"__on_{c}")) for c in on))
    return left.join(right, same, how).drop(*(f"__on_{c}" for c in on))


def numbered(df: DataFrame, keys: list[str], h: Column, ties: list[str], name: str, total: str | None = None) -> DataFrame:
    """Adds each row's place (from 0) in a hash order inside its keys, and with `total` the rows of its keys. Rows of equal
    hashes are in the order of `ties`."""
    keys = list(keys)
    d = df.withColumn("__h", h).withColumn("__range", F.pmod(F.shiftright("__h", 40), F.lit(HASH_RANGES)).cast("int"))
    n = d.groupBy(*keys, "__range").agg(F.count("*").alias("__n"))
    over = Window.partitionBy(*keys)
    n = n.withColumns({"__before": F.sum("__n").over(over.orderBy("__range")) - F.col("__n"), "__all": F.sum("__n").over(over)}).drop("__n")
    d = d.withColumn("__within", F.row_number().over(Window.partitionBy(*keys, "__range").orderBy("__h", *ties)))
    d = joined(d, n, [*keys, "__range"]).withColumn(name, F.col("__before") + F.col("__within") - 1)
    d = d.withColumn(total, F.col("__all")) if total else d
    return d.drop("__h", "__range", "__before", "__all", "__within")


def value_totals(df: DataFrame, keys: list[str], value: str, adds: dict[str, Column]) -> DataFrame:
    """One row per keys and different value that isn't null, with the aggregates `adds` (sums or counts), and of each
    <add>_upto, its total of this and smaller values, and <add>_all, that of the keys; and the value's range, __range."""
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(*(c.alias(a) for a, c in adds.items()))
    draw = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(value), value))
    drawn = counts.select(*keys, value).withColumn("__draw", draw).where(F.col("__draw") <= VALUE_BOUNDS)
    bounds = drawn.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("__bounds"))  # at most VALUE_BOUNDS
    d = joined(counts, bounds, keys).withColumn("__range", F.size(F.filter("__bounds", lambda b: b < F.col(value)))).drop("__bounds")
    over = Window.partitionBy(*keys)
    t = d.groupBy(*keys, "__range").agg(*(F.sum(a).alias(f"__t_{a}") for a in adds))
    t = t.select(*keys, "__range", *(F.sum(f"__t_{a}").over(over).alias(f"{a}_all") for a in adds), *((F.sum(f"__t_{a}").over(over.orderBy("__range")) - F.col(f"__t_{a}")).alias(f"__b_{a}") for a in adds))
    up = Window.partitionBy(*keys, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({f"__w_{a}": F.sum(a).over(up) for a in adds})
    d = joined(d, t, [*keys, "__range"]).withColumns({f"{a}_upto": F.col(f"__b_{a}") + F.col(f"__w_{a}") for a in adds})
    return d.drop(*(f"__{x}_{a}" for a in adds for x in "bw"))


def least_from_here(df: DataFrame, keys: list[str], value: str, col: str, name: str) -> DataFrame:
    """Adds to rows of `value_totals` the least of a column among this and larger values of the keys."""
    keys = list(keys)
    later = Window.partitionBy(*keys).orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)
    ends = df.groupBy(*keys, "__range").agg(F.min(col).alias("__least")).withColumn("__later", F.min("__least").over(later)).drop("__least")
    down = Window.partitionBy(*keys, "__range").orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, 0)
    return joined(df.withColumn("__here", F.min(col).over(down)), ends, [*keys, "__range"]).withColumn(name, F.least("__here", "__later")).drop("__here", "__later")


def in_ranges(df: DataFrame, order: list[Column], by_folder: bool = False, ranges: int | None = None) -> DataFrame:
    """The rows with __range, their range of the order (numbers rise with it, rows equal in it share one). Spark samples the
    order and cuts as many ranges as it shuffles partitions, if no number is
    given; they are written once, since another run may cut elsewhere,
    with `by_folder` in a folder a range, so that joins on it read only those that they need."""
    spark = df.sparkSession
    cut = df.repartitionByRange(ranges or int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("__range", F.spark_partition_id())
    if not by_folder:
        return checkpointed(cut)
    path = f"{shared_folder(spark)}/ranges-{uuid.uuid4().hex}"
    cut.write.partitionBy("__range").parquet(path)
    return spark.read.schema(cut.schema).parquet(path)


def carried(ranged: DataFrame, keys: list[str], adds: dict[str, tuple[Column, str]]) -> DataFrame:
    """What earlier ranges of the same keys hand on: (keys, __range, one column an entry of `adds`), an entry being an
    aggregate of a range and how to go on with it over the ranges before: sum, min, max or last. A row a range and keys."""
    keys = list(keys)
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    how = {"sum": F.sum, "min": F.min, "max": F.max, "last": F.last}
    t = ranged.groupBy(*keys, "__range").agg(*(a.alias(f"__a_{n}") for n, (a, _) in adds.items()))
    return t.select(*keys, "__range", *(how[h](f"__a_{n}").over(before).alias(n) for n, (_, h) in adds.items()))


def running(df: DataFrame, keys: list[str], order: list[Column], name: str, value: Column, how: str) -> DataFrame:
    """Adds the running sum or minimum of a value down an order that is total inside the keys, range by range."""
    keys, fold = list(keys), {"sum": F.sum, "min": F.min}[how]
    d = in_ranges(df.withColumn("__x", value), [*(F.col(k) for k in keys), *order])
    up = Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = joined(d.withColumn("__here", fold("__x").over(up)), carried(d, keys, {"__b": (fold("__x"), how)}), [*keys, "__range"])
    both = F.col("__here") + F.coalesce("__b", F.lit(0)) if how == "sum" else F.least("__here", "__b")
    return d.withColumn(name, F.coalesce(both, F.col("__b")) if how == "sum" else both).drop("__x", "__here", "__b", "__range")
