"""Findings of round 4: what grows as a product is told apart last."""

from pyspark.sql import functions as F

import __spark_entry__ as e
from lociforge.operators import ranges
from tests.conftest import SF


def test_points_of_a_position_meet_spans_together(spark, monkeypatch):
    """rows that are dealt out grow with positions, not with points, and all pairs are there, whatever repeats."""
    near = [("1", 10, j) for j in range(7)] + [("1", 400, 7), ("2", 10, 8), ("2", 10, 9), ("1", 9_000, 10), (None, 10, 11), ("1", None, 12), ("1", 10, None)]
    spans = [("1", 5, 15, "a"), ("1", 12, 90, "b"), ("1", 300, 3_000, "c"), ("2", 9, 9, "d"), ("2", 11, 10, "e"), ("1", None, 20, "f"), (None, 0, 99, "g"), ("1", 5, 15, "a")]
    p = spark.createDataFrame(near, "chrom string, pos long, j int")
    s = spark.createDataFrame(spans, "chrom string, tx_start long, tx_end long, `gene.id` string")
    met, looking = [], ranges._looking
    monkeypatch.setattr(ranges, "_looking", lambda points, *rest: met.append(points.count()) or looking(points, *rest))
    monkeypatch.setattr(ranges, "TOGETHER", 3)
    pairs = lambda fits: sorted(((x[0], x[1], x[2], y[3]) for x in near for y in spans if x[0] == y[0] and None not in (x[0], x[1], y[1]) and fits(x[1], y[1], y[2])), key=str)
    got = ranges.window_overlap_join(p, s, 6, 5)
    assert got.columns == ["chrom", "pos", "j", "tx_start", "tx_end", "gene.id", "window_start", "window_end"]
    rows = got.collect()
    assert all(x["window_start"] == x["pos"] - 6 and x["window_end"] == x["pos"] + 5 for x in rows)
    assert sorted(((x["chrom"], x["pos"], x["j"], x["gene.id"]) for x in rows), key=str) == pairs(lambda at, low, high: low <= high and high >= at - 6 and low <= at + 5)
    got = ranges.interval_join(p, s, start="tx_start", end="tx_end")
    assert sorted(((x["chrom"], x["pos"], x["j"], x["gene.id"]) for x in got.collect()), key=str) == pairs(lambda at, low, high: low < at <= high)
    assert met == [6, 6]  # 8 points of (1, 10) in threes, 3 positions more
    bare = ranges.interval_join(p.select("chrom", "pos"), s, start="tx_start", end="tx_end")
    assert bare.columns == ["chrom", "pos", "tx_start", "tx_end", "gene.id"] and bare.count() == got.count()


def test_signals_are_rounded_before_pairs(spark):
    """an interval's signal is rounded once, not once a pair."""
    got = e.queries()["j1_interval_join"](spark, SF)
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(i for i, line in enumerate(plan) if "Join Inner" in line)
    rounds = [i for i, line in enumerate(plan) if "round(" in line.lower()]
    assert rounds and min(rounds) > join
    want = spark.sql("select round(p_retailprice, 6) as s from {p}", p=spark.read.parquet(f"{SF}/part.parquet"))
    assert got.select(F.col("mean_signal").alias("s")).join(want.distinct(), "s", "left_anti").count() == 0
