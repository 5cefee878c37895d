"""Resamples and permutations that don't copy the rows.

A resample of n rows with replacement is a vector of counts. Those of many resamples are drawn for blocks of 1,024 numbered
rows at a time: how many draws fall into a block follows from binomial splits down a binary tree over the numbers, whose
draws are seeded by the tree's nodes, so that every block finds the same ones by itself. Medians need still less: the middle
order statistics of n uniform draws are Beta distributed, and tell which places of the original order a resample's median
reads. A permutation is a keyed bijection of the places.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import numbered
from .quantiles import value_ranges_of

#: Rows to a block of counts, and different values to a range of a resampled curve.
BLOCK, CURVE_VALUES = 1024, 20_000


def _rng(*parts: int) -> np.random.Generator:
    return np.random.default_rng([p & 0xFFFFFFFFFFFFFFFF for p in parts])


def block_draws(n: int, block: int, boot: int, *seed: int) -> np.ndarray:
    """How many of the n draws of each of `boot` resamples fall into the block, out of n numbered rows."""
    low, high, count = 0, -(-n // BLOCK), np.full(boot, n, np.int64)  # in blocks
    while high - low > 1:
        mid = (low + high) // 2
        left = _rng(*seed, low, high).binomial(count, (mid - low) * BLOCK / (min(n, high * BLOCK) - low * BLOCK))
        low, high, count = (low, mid, left) if block < mid else (mid, high, count - left)
    return count


def bootstrap_counts(df: DataFrame, keys: list[str], n: int, id_cols: list[str], seed: int = 1, name: str = "times") -> DataFrame:
    """Adds to each row how often each of n resamples with replacement of its keys draws it, an array of n numbers. Every
    resample is as large as its keys' rows; null keys are a group. Rows are dealt out once, whatever n is."""
    keys, cols = list(keys), df.columns
    d = numbered(df, keys, F.xxhash64(*id_cols, F.lit(seed)), id_cols, "__i", "__n")
    d = d.withColumns({"__block": F.expr(f"__i div {BLOCK}"), "__key": F.xxhash64(*keys, F.lit(seed))})

    def run(t: pa.Table) -> pa.Table:
        size, block, key = (t.column(c)[0].as_py() for c in ("__n", "__block", "__key"))
        t = t.sort_by("__i")
        draws = block_draws(size, block, n, seed, key)
        times = _rng(seed, key, block).multinomial(draws, np.full(t.num_rows, 1 / t.num_rows)).T.astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, times.size + 1, n, dtype=np.int32)), pa.array(times.ravel()))
        return t.select(cols).append_column(name, lists)

    kinds = df.schema.simpleString()[len("struct<") : -1]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) or kinds
    return d.groupBy(*keys, "__block").applyInArrow(run, f"{kinds}, `{name}` array<int>")


def middle_places(n: int, boot: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """For each resample of n ordered rows, the places (from 0) of the rows that its two middle order statistics are; one
    place twice where n is odd. Order statistic k of n uniforms is Beta(k, n + 1 - k), the next one above it the least of
    the n - k that are left."""
    k = (n + 1) // 2
    low = rng.beta(k, n + 1 - k, boot)
    high = low if n % 2 else low + (1 - low) * rng.beta(1, n - k, boot)
    return tuple(np.minimum((u * n).astype(np.int64), n - 1) for u in (low, high))


def resampled_medians(df: DataFrame, keys: list[str], value: str, boot: int, seed: int = 1) -> DataFrame:
    """(keys, boot, median) for `boot` resamples of each keys' rows (boot from 0), and the median itself as boot -1.

    The values are counted and cut into ranges once; what moves afterwards are two places a resample, which look up their
    values in the ranges. Nulls don't count, null keys are a group, keys without values have no rows.
    """
    keys = list(keys)
    ranged, totals = value_ranges_of(df.select(*keys, F.col(value).cast("double").alias("__v")), keys, "__v")
    of = totals.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__range", "__before"))).alias("__ranges"), F.max("__all").cast("long").alias("__all"))  # a range each

    def places(all_: pd.Series, key: pd.Series, starts: pd.Series) -> pd.Series:
        out = []
        for n, h, s in zip(all_, key, starts, strict=True):
            low, high = middle_places(n, boot, _rng(seed, int(h)))
            place = np.concatenate(([(n - 1) // 2, n // 2], low, high))
            which = np.concatenate(([-1, -1], np.arange(boot), np.arange(boot)))
            at = np.searchsorted(np.asarray(s, np.int64), place, side="right") - 1
            out.append(np.stack((which, at, place), 1).tolist())
        return pd.Series(out)

    drawn = F.pandas_udf(places, "array<array<bigint>>")("__all", F.xxhash64(*keys, F.lit(seed)), F.col("__ranges.__before"))
    want = of.withColumn("__x", F.explode(drawn))
    range_of = F.get("__ranges", F.get("__x", 1).cast("int"))
    want = want.select(*keys, range_of["__range"].alias("__range"), (F.get("__x", 2) - range_of["__before"]).alias("__at"), F.get("__x", 0).cast("int").alias("boot"))

    def look(values: pa.Table, wanted: pa.Table) -> pa.Table:
        values = values.sort_by("__v")
        upto = np.cumsum(values.column("__n").to_numpy())
        found = values.column("__v").to_numpy()[np.searchsorted(upto, wanted.column("__at").to_numpy(), side="right")]
        return wanted.select([*keys, "boot"]).append_column("__v", pa.array(found, pa.float64()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)
    met = ranged.groupBy(*keys, "__range").cogroup(want.groupBy(*keys, "__range")).applyInArrow(lambda a, b: look(a, b) if b.num_rows else b.select([*keys, "boot"]).append_column("__v", pa.array([], pa.float64())), f"{kinds + ', ' if keys else ''}boot int, __v double")
    return met.groupBy(*keys, "boot").agg(F.avg("__v").alias("median"))


def resampled_auroc(df: DataFrame, y: str, p: str, boot: int, seed: int = 1) -> DataFrame:
    """(boot, auroc) of `boot` resamples of the rows with y (0 or 1) and p; null where a resample has one class only.

    Each range of different scores draws its share of all resamples (the shares of the ranges are drawn alike by all of
    them) and returns, per resample, its positives, negatives and the ordered pairs inside; ranges are then put in line.
    """
    d = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).select(F.col(p).cast("double").alias("__v"), F.col(y).cast("long").alias("__y"))
    ranged, totals = value_ranges_of(d, [], "__v", {"__pos": F.sum("__y")}, CURVE_VALUES)
    size = {x["__range"]: x["__t"] for x in totals.select("__range", "__t").collect()}  # a row a range
    order = sorted(size)

    def run(t: pa.Table) -> pa.Table:
        at = order.index(t.column("__range")[0].as_py())
        share = np.array([size[r] for r in order], float)
        draws = _rng(seed).multinomial(int(share.sum()), share / share.sum(), boot)[:, at]
        t = t.sort_by("__v")
        pos = t.column("__pos").to_numpy()
        cells = np.stack((pos, t.column("__n").to_numpy() - pos), 1).ravel()
        inner, out, step = _rng(seed, at), [], max(1, (1 << 22) // len(cells))
        for i in range(0, boot, step):
            m = inner.multinomial(draws[i : i + step], cells / cells.sum())
            up, down = m[:, ::2].astype(float), m[:, 1::2].astype(float)
            below = np.cumsum(down, 1) - down
            out.append(np.stack((up.sum(1), down.sum(1), (up * (below + down / 2)).sum(1)), 1))
        rows = np.concatenate(out)
        return pa.table({"__range": pa.array(np.full(boot, order[at], np.int32)), "boot": pa.array(np.arange(boot, dtype=np.int32)), **{c: rows[:, j] for j, c in enumerate(("up", "down", "pairs"))}})

    parts = ranged.groupBy("__range").applyInArrow(run, "__range int, boot int, up double, down double, pairs double")
    # One short array a resample, as long as there are ranges.
    line = parts.groupBy("boot").agg(F.sort_array(F.collect_list(F.struct("__range", "up", "down", "pairs"))).alias("x"))
    zero = F.struct(F.lit(0.0).alias("up"), F.lit(0.0).alias("down"), F.lit(0.0).alias("pairs"))
    total = F.aggregate("x", zero, lambda s, r: F.struct((s["up"] + r["up"]).alias("up"), (s["down"] + r["down"]).alias("down"), (s["pairs"] + r["pairs"] + r["up"] * s["down"]).alias("pairs")))
    return line.select("boot", total.alias("x")).select("boot", F.try_divide(F.col("x.pairs"), F.col("x.up") * F.col("x.down")).alias("auroc"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shuffled_place(i: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 8) -> np.ndarray:
    """A bijection of 0..n-1 for each key: a Feistel network on the least power of four that holds n, walked until it is back
    inside."""
    x, n, key = (np.asarray(a).astype(np.uint64) for a in (i, n, key))
    half = np.ceil(np.log2(np.maximum(n, 2).astype(float)) / 2).astype(np.uint64)
    mask, left = (np.uint64(1) << half) - np.uint64(1), np.ones(len(x), bool)
    while left.any():
        h, m, k = half[left], mask[left], key[left]
        a, b = x[left] >> h, x[left] & m
        for r in range(rounds):
            a, b = b, a ^ ((_mixed(b + k + np.uint64(r * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(17)) & m)
        x[left] = (a << h) | b
        left[left] = x[left] >= n[left]
    return x.astype(np.int64)
