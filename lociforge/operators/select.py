"""Picking, ranking, set and sampling operators. Every order is made total by the remaining columns or a hash, so reruns agree."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import chrom_order
from .ordered import carried, in_ranges, joined, numbered, running, value_totals
from .resample import bootstrap_counts, shuffled_place


def _cols(keys) -> list[Column]:
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def best_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order. A max over structs, combined before the shuffle, where the order is by
    plain columns is left to Spark's window group limit."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*_cols(order)))
    return df.withColumn("__rn", rank).where("__rn = 1").drop("__rn")


def pivot_components(df: DataFrame, components: list[str], key: str = "rsid", component: str = "component", id_col: str = "identifier", signal: str = "mean_signal") -> DataFrame:
    """The best id and signal of each listed component as columns <component>_id and <component>_mean_signal."""
    out = []
    for c in components:
        best = F.max(F.when(F.col(component) == c, F.struct(F.col(signal), F.col(id_col))))
        out += [best[id_col].alias(f"{c}_id"), best[signal].alias(f"{c}_mean_signal")]
    return df.groupBy(key).agg(*out)


def melt_components(df: DataFrame, components: list[str], key: str = "rsid") -> DataFrame:
    """The inverse: (key, component, identifier, mean_signal) rows of the pairs that are there."""
    parts = F.array(*(F.struct(F.lit(c).alias("component"), F.col(f"{c}_id").alias("identifier"), F.col(f"{c}_mean_signal").alias("mean_signal")) for c in components))
    return df.select(key, F.explode(parts).alias("x")).select(key, "x.*").where("identifier is not null")


def avg_rank(df: DataFrame, col: str, keys: list[str] = (), pct: bool = False, asc: bool = True, name: str = "rank") -> DataFrame:
    """Average rank of ties, or its share of the group. Nulls have no rank. Ranks are those of the different values, which
    are counted first."""
    t = value_totals(df, keys, col, {"__n": F.count("*")})
    rank = F.col("__n_upto") - (F.col("__n") - 1) / 2.0 if asc else F.col("__n_all") - F.col("__n_upto") + (F.col("__n") + 1) / 2.0
    rank = rank / F.col("__n_all") if pct else rank
    return joined(df, t.select(*keys, col, rank.alias(name)), [*keys, col], "left")


def unique_rank(df: DataFrame, col: str, keys: list[str] = (), ties: list[str] = (), name: str = "rank") -> DataFrame:
    """Places from 1 by falling value, nulls last, ties by the given columns: counted inside ranges of that order, behind
    what earlier ranges hold."""
    keys, order = list(keys), [F.col(col).desc_nulls_last(), *(F.col(t) for t in ties)]
    d = in_ranges(df, [*(F.col(k) for k in keys), *order])
    d = joined(d.withColumn("__place", F.row_number().over(Window.partitionBy(*keys, "__range").orderBy(*order))), carried(d, keys, {"__b": (F.count("*"), "sum")}), [*keys, "__range"])
    return d.withColumn(name, (F.col("__place") + F.coalesce("__b", F.lit(0))).cast("int")).drop("__place", "__b", "__range")


def share(df: DataFrame, col: str, keys: list[str], name: str = "share") -> DataFrame:
    """The value over the sum of its keys, which is summed first and joined."""
    total = df.groupBy(*keys).agg(F.sum(col).alias("__total"))
    return joined(df, total, list(keys)).withColumn(name, F.try_divide(F.col(col), F.col("__total"))).drop("__total")


def running_min(df: DataFrame, col: str, order: list[Column], keys: list[str] = (), name: str = "running_min") -> DataFrame:
    """The least value so far; the order must be total inside the keys."""
    return running(df, list(keys), _cols(order), name, F.col(col), "min")


def running_es(df: DataFrame, keys: list[str], score: str, hit: str, gene: str, weight: float = 1.0, name: str = "es") -> DataFrame:
    """The running enrichment sum down the ranked genes: hits add their share of |score|^weight, misses take off one part of theirs."""
    keys = list(keys)
    w = F.when(F.col(hit), F.pow(F.abs(F.col(score)), F.lit(float(weight)))).otherwise(0.0)
    whole = df.groupBy(*keys).agg(F.sum(w).alias("__up"), F.sum((~F.col(hit)).cast("int")).alias("__misses"))
    step = F.when(F.col(hit), F.try_divide(w, F.col("__up"))).otherwise(-F.try_divide(F.lit(1.0), F.col("__misses")))
    d = joined(df, whole, keys).withColumn("__step", step).drop("__up", "__misses")
    return running(d, keys, [F.col(score).desc(), F.col(gene)], name, F.col("__step"), "sum").drop("__step")


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, balanced: bool = False, both_tails: list[Column] | None = None) -> DataFrame:
    """The first n rows of each key; balanced: as many as the smallest group has, if that is less; both_tails: also the
    first n of a second order."""
    w = Window.partitionBy(*keys)
    df = df.withColumn("__rn", F.row_number().over(w.orderBy(*_cols(order))))
    keep = F.col("__rn") <= n
    if balanced:
        least = df.groupBy(*keys).count().agg(F.min("count").alias("__least"))
        df = df.crossJoin(F.broadcast(least))  # one row
        keep = keep & (F.col("__rn") <= F.col("__least"))
    if both_tails:
        df = df.withColumn("__rn2", F.row_number().over(w.orderBy(*_cols(both_tails))))
        keep = keep | (F.col("__rn2") <= n)
    return df.where(keep).drop("__rn", "__rn2", "__least")


def coalesce_positions(df: DataFrame, gap: int = 50_000, chrom: str = "chrom", pos: str = "pos") -> DataFrame:
    """(chrom, start, end, n): runs of distinct positions at most `gap` apart. Null positions are left out.

    Ranges of positions are scanned apart. A range learns the last position before it and how many runs began so far from a
    row a range, so runs that cross borders get one number.
    """
    d = in_ranges(df.select(chrom, pos).where(F.col(pos).isNotNull()).distinct(), [F.col(chrom), F.col(pos)])
    w = Window.partitionBy(chrom, "__range").orderBy(pos)
    last = carried(d, [chrom], {"__last": (F.max(pos), "last")})
    d = joined(d.withColumn("__near", F.lag(pos).over(w)), last, [chrom, "__range"])
    d = d.withColumn("__new", F.coalesce((F.col(pos) - F.coalesce("__near", "__last") > gap).cast("int"), F.lit(1))).drop("__near", "__last")
    here = d.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    here = here.groupBy(chrom, "__range", "__run").agg(F.min(pos).alias("start"), F.max(pos).alias("end"), F.count("*").alias("n"), F.sum("__new").alias("__new"))
    here = joined(here, carried(here, [chrom], {"__b": (F.sum("__new"), "sum")}), [chrom, "__range"]).withColumn("__run", F.col("__run") + F.coalesce("__b", F.lit(0)))
    return here.groupBy(chrom, "__run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n")).drop("__run")


def genomic_sort(df: DataFrame, chrom: str = "chrom", pos: str = "pos") -> DataFrame:
    return df.orderBy(chrom_order(F.col(chrom)), pos)


def binned_curve(df: DataFrame, prob: str, y: str, n: int = 10, keys: list[str] = ()) -> DataFrame:
    """Calibration bins of equal width: rows, mean prediction and observed rate."""
    b = F.least(F.floor(F.col(prob) * n), F.lit(n - 1)).cast("int").alias("bin")
    return df.where(F.col(prob).isNotNull()).groupBy(*keys, b).agg(F.count("*").alias("n"), F.avg(prob).alias("mean_pred"), F.avg(F.col(y).cast("double")).alias("observed"))


def union_labeled(tables: dict[str, DataFrame], name: str = "label") -> DataFrame:
    """All rows by column name, missing columns null, with the label of their table."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (d.withColumn(name, F.lit(k)) for k, d in tables.items()))


def distinct_rows(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return df.dropDuplicates(keys) if keys else df.distinct()


def set_overlap(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Every key of either side with flags of where it is."""
    x, y = a.select(*on).distinct().withColumn("in_a", F.lit(True)), b.select(*on).distinct().withColumn("in_b", F.lit(True))
    return x.join(y, on, "full").na.fill(False, ["in_a", "in_b"])


def _hash(id_cols: list[str], *more: Column) -> Column:
    return F.xxhash64(*id_cols, *more)


def balanced_sample(df: DataFrame, strata: list[str], group: str, id_cols: list[str], cap: int = 10_000, total: int | None = None, seed: int = 1) -> DataFrame:
    """At most `cap` rows of each stratum: an equal quota of each group, what groups leave over is filled from the others
    in hash order; then at most `total` rows in all, by hash. Sizes are exact, members depend on the seed. Rows without a group are one."""
    strata = list(strata)
    n = df.groupBy(*strata, group).agg(F.count("*").alias("__n"))
    groups = n.groupBy(*strata).agg(F.floor(F.lit(cap) / F.count("*")).alias("__quota"))
    base = joined(n, groups, strata).groupBy(*strata).agg(F.first("__quota").alias("__quota"), F.sum(F.least("__n", "__quota")).alias("__base"))
    d = joined(numbered(df, [*strata, group], _hash(id_cols, F.lit(seed)), id_cols, "__rn"), base, strata)
    d = d.withColumn("__over", F.col("__rn") >= F.col("__quota"))
    d = numbered(d, [*strata, "__over"], _hash(id_cols, F.lit(seed + 1)), id_cols, "__place")
    d = d.where(F.col("__place") + F.when(F.col("__over"), F.col("__base")).otherwise(0) < cap)
    if total is not None:
        d = d.orderBy(_hash(id_cols, F.lit(seed + 2)), *id_cols).limit(total)
    return d.drop("__rn", "__quota", "__base", "__over", "__place")


def match_controls(df: DataFrame, target: list[str], group: str, id_cols: list[str], case: str = "case", control: str = "control", seed: int = 1) -> DataFrame:
    """All cases of each target and as many controls, in hash order."""
    target = list(target)
    cases = df.groupBy(*target).agg(F.count_if(F.col(group) == case).alias("__n"))
    d = joined(numbered(df, [*target, group], _hash(id_cols, F.lit(seed)), id_cols, "__rn"), cases, target)
    return d.where((F.col(group) == case) | ((F.col(group) == control) & (F.col("__rn") < F.col("__n")))).drop("__n", "__rn")


def assign_folds(df: DataFrame, id_cols: list[str], k: int = 5, repeats: int = 1, seed: int = 1, strata: list[str] = ()) -> DataFrame:
    """repeat and fold (both from 0): rows in hash order dealt round, inside each stratum, so that fold sizes differ by one at most."""
    d = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    d = numbered(d, ["repeat", *strata], _hash(id_cols, F.lit(seed), F.col("repeat")), id_cols, "__i")
    return d.withColumn("fold", F.pmod("__i", F.lit(k)).cast("int")).drop("__i")


def permute_labels(df: DataFrame, id_cols: list[str], value: str, n: int, seed: int = 1, mode: str = "values", keys: list[str] = ()) -> DataFrame:
    """n copies of the rows (perm from 0) whose values are dealt anew inside their keys; mode signs keeps sizes and deals only the signs.

    Rows are numbered once; each permutation is a bijection of the numbers by formula, so only the copies look up their
    value, in a table as long as the rows.
    """
    keys = list(keys)

    @F.pandas_udf("long")
    def place(i: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series(shuffled_place(i.to_numpy(), n.to_numpy(), key.to_numpy()))

    a = numbered(df, keys, _hash(id_cols, F.lit(seed)), id_cols, "__i", "__n")
    moved = F.signum(value) if mode == "signs" else F.col(value)
    b = a.select(*keys, F.col("__i").alias("__j"), moved.alias("__v"))
    a = a.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    a = a.withColumn("__j", place("__i", "__n", F.xxhash64("perm", F.lit(seed), *keys))).drop("__i", "__n")
    out = joined(a, b, [*keys, "__j"])
    return out.withColumn(value, F.abs(value) * F.col("__v") if mode == "signs" else F.col("__v")).drop("__v", "__j")


def bootstrap(df: DataFrame, keys: list[str], n: int, id_cols: list[str], seed: int = 1) -> DataFrame:
    """n resamples with replacement of each group as rows (boot from 0), each as large as the group: `bootstrap_counts` laid
    out. Statistics that can be taken from counts need no rows; see `resample.py`."""
    d = bootstrap_counts(df, keys, n, id_cols, seed, "__times").select(*df.columns, F.posexplode("__times").alias("boot", "__k")).where("__k > 0")
    return d.withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__k")))).drop("__k")
