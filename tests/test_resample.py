"""Quantiles by selection, resamples and permutations without copies, walks from hits, bins by levels, orders by ranges."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lociforge.operators import effects, meta, programs, quantiles, ranges, resample, select, stats

SCHEMA = "k string, v double, id long, g string"


def _rows(n: int, seed: int = 3) -> list[tuple]:
    r = random.Random(seed)
    return [(r.choice(["a", "b", None]), None if r.random() < 0.05 else r.choice([1.0, 2.5]) if r.random() < 0.3 else round(r.gauss(0, 5), 3), i, r.choice(["case", "control"])) for i in range(n)]


def _frame(rows) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["k", "v", "id", "g"])


# --- quantiles


def test_quantiles_as_in_numpy(spark):
    rows = _rows(2000)
    d, f = spark.createDataFrame(rows, SCHEMA), _frame(rows)
    qs = {"low": 0.0, "a": 0.01, "m": 0.5, "z": 0.977, "high": 1.0}
    have = quantiles.quantiles(d, "v", qs, ["k"]).collect()
    assert len(have) == 3
    for x in have:
        mine = f[f.k.isna() if x["k"] is None else f.k == x["k"]].v.dropna()
        assert np.allclose([x[n] for n in qs], np.quantile(mine, list(qs.values())), atol=1e-12)
    assert abs(quantiles.quantiles(d, "v", {"m": 0.5}).first()["m"] - f.v.median()) < 1e-12
    assert quantiles.quantiles(spark.createDataFrame([], SCHEMA), "v", {"m": 0.5}, ["k"]).count() == 0
    assert quantiles.quantiles(spark.createDataFrame([("a", None, 1, "g")], SCHEMA), "v", {"m": 0.5}).first()["m"] is None
    one = quantiles.quantiles(spark.createDataFrame([("a", 4.0, 1, "g")], SCHEMA), "v", {"m": 0.3}, ["k"]).first()
    assert (one["k"], one["m"]) == ("a", 4.0)


def test_ranges_hold_their_part_and_no_more(spark):
    """Without keys and with a key that holds nearly all rows, values are spread over the ranges, and totals add up."""
    d = spark.range(20_000).selectExpr("if(id % 50 = 0, 'rare', 'hot') as k", "cast(id * 7919 % 20011 as double) as v")
    for keys in ([], ["k"]):
        ranged, totals = quantiles.value_ranges_of(d, keys, "v", per=2000)
        sizes = [x["count"] for x in ranged.groupBy("__range").count().collect()]
        assert len(sizes) >= 8 and max(sizes) < 3 * sum(sizes) / len(sizes)
        t = totals.orderBy(*keys, "__range").collect()
        assert sum(x["__t"] for x in t) == 20_000
        assert all(b["__before"] == a["__before"] + a["__t"] for a, b in zip(t, t[1:]) if not keys or a["k"] == b["k"])
    plan = quantiles.quantiles(d, "v", {"m": 0.5})._jdf.queryExecution().executedPlan().toString()
    assert "Percentile" not in plan.title() and "PartitionFilters" in plan


def test_operators_on_selected_quantiles(spark):
    d = spark.createDataFrame(_rows(400), SCHEMA)
    f = _frame(_rows(400))
    med = f.v.median()
    mad = (f.v - med).abs().median()
    for x in effects.robust_z(d, "v").collect():
        assert (x["v"] is None and x["robust_z"] is None) or abs(x["robust_z"] - (x["v"] - med) / mad) < 1e-9
    assert effects.robust_z(d.limit(0), "v").count() == 0
    same = effects.robust_z(spark.createDataFrame([("a", 1.0, i, "g") for i in range(3)], SCHEMA), "v").collect()
    assert [x["robust_z"] for x in same] == [None] * 3


# --- resamples


def test_bootstrap_counts_are_resamples(spark):
    d = spark.createDataFrame(_rows(5000), SCHEMA)
    got = resample.bootstrap_counts(d, ["k"], 100, ["id"]).collect()
    assert len(got) == 5000
    for k in ("a", "b", None):
        t = np.array([x["times"] for x in got if x["k"] == k])
        assert (t.sum(0) == len(t)).all()  # each resample as large as its group
        assert abs(t.var() - (1 - 1 / len(t))) < 0.02 and abs(t.mean() - 1) < 1e-12
        assert abs((t == 0).mean() - math.exp(-1)) < 0.01
    again = resample.bootstrap_counts(d.repartition(7), ["k"], 100, ["id"]).collect()
    assert {x["id"]: x["times"] for x in got} == {x["id"]: x["times"] for x in again}
    rows = Counter((x["k"], x["boot"]) for x in select.bootstrap(d, ["k"], 3, ["id"]).collect())
    assert rows == {(k, b): n for k, n in Counter(x["k"] for x in got).items() for b in range(3)}
    assert resample.bootstrap_counts(d.limit(0), [], 3, ["id"]).count() == 0


@pytest.mark.parametrize("n", [1, 2, 40, 41])
def test_resampled_medians_as_in_numpy(spark, n):
    x = np.round(np.random.default_rng(n).normal(0, 3, n), 2)
    got = resample.resampled_medians(spark.createDataFrame([(float(v),) for v in x], "v double"), [], "v", 20_000).collect()
    assert abs(next(r["median"] for r in got if r["boot"] < 0) - np.median(x)) < 1e-12
    mine = np.array([r["median"] for r in got if r["boot"] >= 0])
    want = np.median(np.random.default_rng(1).choice(x, (20_000, n)), axis=1)
    assert len(mine) == 20_000 and abs(mine.mean() - want.mean()) < 0.02 + 0.05 * want.std() and abs(mine.std() - want.std()) < 0.03 * want.std() + 1e-9
    for q in (0.025, 0.25, 0.5, 0.75, 0.975):
        assert abs((mine <= np.quantile(want, q)).mean() - (want <= np.quantile(want, q)).mean()) < 0.015


def test_median_interval_at_production_size(spark):
    """5,000 resamples: ends within a tenth of the interval's width of NumPy's, and what is dealt out doesn't grow with them."""
    r = np.random.default_rng(5)
    a, b = r.normal(1, 2, 120), r.normal(0, 2, 90)
    d = spark.createDataFrame([("x", float(v), i, "case") for i, v in enumerate(a)] + [("x", float(v), 1000 + i, "control") for i, v in enumerate(b)] + [("y", 1.0, 5000, "case"), (None, 1.0, 1, "case"), (None, 3.0, 2, "control")], SCHEMA)
    got = {x["k"]: x for x in stats.median_diff_ci(d, ["k"], "g", "v", ["id"]).collect()}
    boots = np.median(r.choice(a, (5000, 120)), 1) - np.median(r.choice(b, (5000, 90)), 1)
    low, high = np.quantile(boots, [0.025, 0.975])
    assert abs(got["x"]["diff"] - (np.median(a) - np.median(b))) < 1e-12
    assert abs(got["x"]["ci_low"] - low) < 0.1 * (high - low) and abs(got["x"]["ci_high"] - high) < 0.1 * (high - low)
    assert got["y"]["diff"] is None and got["y"]["ci_low"] is None
    assert (got[None]["diff"], got[None]["ci_low"], got[None]["ci_high"]) == (-2.0, -2.0, -2.0)


def test_effect_sizes_as_in_plain_python(spark):
    r = np.random.default_rng(2)
    a, b = np.round(r.normal(0.5, 1, 60), 1), np.round(r.normal(0, 1, 50), 1)
    d = spark.createDataFrame([("x", float(v), i, "case") for i, v in enumerate(a)] + [("x", float(v), 100 + i, "control") for i, v in enumerate(b)], SCHEMA)
    x = stats.effect_sizes(d, ["k"], "g", "v", ["id"], [("case", "control")]).first()
    wins = sum((u > w) + (u == w) / 2 for u in a for w in b)
    assert x["u"] == wins and abs(x["cliffs_delta"] - (2 * wins / 3000 - 1)) < 1e-12
    assert abs(x["diff"] - (np.median(a) - np.median(b))) < 1e-12 and x["ci_low"] <= x["diff"] <= x["ci_high"]
    assert abs(x["fdr"] - x["p"]) < 1e-12 and 0 < x["kruskal_p"] < 1


def _auroc(y: np.ndarray, p: np.ndarray) -> float:
    q, n1 = pd.Series(p).rank().to_numpy(), y.sum()
    return (q[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_resampled_auroc_as_in_numpy(spark, monkeypatch):
    monkeypatch.setattr(resample, "CURVE_VALUES", 10)  # many ranges
    r = np.random.default_rng(2)
    y = (r.random(300) < 0.4).astype(int)
    p = np.round(np.clip(0.3 * y + 0.7 * r.random(300), 0, 1), 2)
    d = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)] + [(None, 0.5), (1, None)], "y int, p double")
    mine = np.array([x["auroc"] for x in resample.resampled_auroc(d, "y", "p", 2000).collect()])
    draws = [r.integers(0, 300, 300) for _ in range(2000)]
    want = np.array([_auroc(y[i], p[i]) for i in draws])
    assert len(mine) == 2000 and abs(mine.mean() - want.mean()) < 0.003 and abs(mine.std() - want.std()) < 0.003
    x = stats.auroc_ci(d, "y", "p", ["y"]).first()
    low, high = np.quantile(want, [0.025, 0.975])
    assert abs(x["auroc_low"] - low) < 0.01 and abs(x["auroc_high"] - high) < 0.01


# --- permutations


def test_shuffled_places_are_permutations():
    for n in (1, 2, 3, 4, 5):
        c = Counter(tuple(resample.shuffled_place(np.arange(n), np.full(n, n), np.full(n, k * 7919 + 11))) for k in range(3000))
        assert len(c) == math.factorial(n) and all(sorted(p) == list(range(n)) for p in c)
        assert max(c.values()) < 1.7 * 3000 / math.factorial(n) + 15
    x = resample.shuffled_place(np.arange(5000), np.full(5000, 5000), np.full(5000, 5))
    assert sorted(x.tolist()) == list(range(5000)) and abs(np.corrcoef(x, np.arange(5000))[0, 1]) < 0.05


def test_walk_peak_from_hits_alone():
    r = np.random.default_rng(0)
    for _ in range(500):
        n = int(r.integers(1, 12))
        hit, score = r.random(n) < 0.4, np.round(r.random(n), 1)
        up = score[hit].sum()
        step = np.where(hit, score / up if up else 0.0, -1 / max(1, (~hit).sum()))
        es = np.cumsum(step)
        have = stats.walk_peak(np.flatnonzero(hit), score[hit], n)
        assert abs(abs(have) - np.abs(es).max()) < 1e-12 and (np.abs(es - have) < 1e-12).any() or np.abs(es).max() < 1e-12


def test_set_nulls_as_in_plain_permutations(spark):
    r = random.Random(4)
    rows = [("s" if i % 2 else None, f"G{i:03}", round(r.gauss(0, 1), 1) + (1.0 if i % 9 == 0 else 0.0), i % 9 == 0) for i in range(240)]
    rows += [("s", "none", None, True)]
    d = spark.createDataFrame(rows, "k string, gene string, score double, hit boolean")
    rng = np.random.default_rng(0)
    got = {x["k"]: x for x in stats.gsea(d, "score", "hit", "gene", ["k"]).collect()}
    for k in ("s", None):
        order = sorted((x for x in rows if x[0] == k and x[2] is not None), key=lambda x: (-x[2], x[1]))
        s, hit = np.array([abs(x[2]) for x in order]), np.array([x[3] for x in order])
        peak = lambda h: stats.walk_peak(np.flatnonzero(h), s[h], len(s))  # noqa: E731, B023
        es = np.cumsum(np.where(hit, s / s[hit].sum(), -1 / (~hit).sum()))
        assert abs(got[k]["es"] - es[np.abs(es).argmax()]) < 1e-9
        null = np.array([peak(rng.permutation(hit)) for _ in range(3000)])
        same = np.abs(null[null * got[k]["es"] > 0])
        assert abs(got[k]["nes"] - abs(got[k]["es"]) / same.mean() * np.sign(got[k]["es"])) < 0.08 * abs(got[k]["nes"])
        assert abs(got[k]["p"] - (same >= abs(got[k]["es"])).mean()) < 0.03
    one = spark.createDataFrame([x[1:] for x in rows if x[0] == "s"], "gene string, score double, hit boolean")
    x = stats.ks_set_score(one, "score", "hit", "gene").first()
    order = sorted((y for y in rows if y[0] == "s" and y[2] is not None), key=lambda y: (-y[2], y[1]))
    hit = np.array([y[3] for y in order])
    null = np.array([stats.walk_peak(np.flatnonzero(h), np.ones(hit.sum()), len(hit)) for h in (rng.permutation(hit) for _ in range(3000))])
    assert abs(x["null_mean"] - null.mean()) < 0.04 and abs(x["null_sd"] - null.std()) < 0.02 and abs(x["p"] - (np.abs(null) >= abs(x["ks"])).mean()) < 0.03
    assert abs(x["z"] - (x["ks"] - x["null_mean"]) / x["null_sd"]) < 1e-9
    assert stats.gsea(d.limit(0), "score", "hit", "gene", ["k"]).count() == 0


# --- weighted medians


def test_weighted_median_and_its_error():
    r = np.random.default_rng(1)
    bx, by, sx, so = r.uniform(0.1, 0.5, 25), r.normal(0.1, 0.1, 25), np.full(25, 0.02), r.uniform(0.05, 0.2, 25)
    w = bx * bx / (so * so)

    def plain(ratio):
        i = np.argsort(ratio, kind="stable")
        at = (np.cumsum(w[i]) - w[i] / 2) / w.sum()
        return np.interp(0.5, at, ratio[i])

    b, se = meta.weighted_median_se(bx, by, sx, so, 1000, 7)
    assert abs(b - plain(by / bx)) < 1e-12
    boots = np.std([plain((by + so * r.standard_normal(25)) / (bx + sx * r.standard_normal(25))) for _ in range(4000)], ddof=1)
    assert abs(se - boots) < 0.1 * boots
    assert meta.weighted_median_se(bx, by, sx, so, 1000, 7, block=50) == (b, pytest.approx(se, rel=0.2))
    assert np.allclose(meta.weighted_medians(np.array([[3.0, 3.0, 3.0], [1.0, 2.0, 9.0]]), np.array([1.0, 1.0, 1.0])), [3.0, 2.0])


# --- walks of samples


def test_sparse_walks_as_dense_ones(spark):
    r = np.random.default_rng(3)
    genes, samples = [f"g{i:02}" for i in range(30)], list(range(12))
    x = {(s, g): float(np.round(r.gamma(2), 2)) if r.random() < 0.8 else None for s in samples for g in genes}
    e = spark.createDataFrame([(s, g, v) for (s, g), v in x.items() if v is not None], "sample_id long, gene string, value double")
    p = spark.createDataFrame([("p1", g) for g in genes[:7]] + [("p2", g) for g in genes[5:25:3]] + [("all", g) for g in genes] + [("p1", "absent"), ("tiny", "g01")], "program string, gene string")
    have = {(y["sample_id"], y["program"]): y["score"] for y in programs.gsva(e, p, "ssgsea", min_size=3).collect()}
    raw = {}
    for s in samples:
        order = sorted(genes, key=lambda g: (x[s, g] or 0.0, g))
        rank = {g: i + 1 for i, g in enumerate(order)}
        for name, mine in (("p1", genes[:7]), ("p2", genes[5:25:3]), ("all", genes)):
            w = {g: rank[g] ** 0.25 for g in mine}
            es = total = 0.0
            for g in reversed(order):
                es += w[g] / sum(w.values()) if g in w else -1 / (30 - len(mine))
                total += es
            raw[s, name] = total
    span = max(raw.values()) - min(raw.values())
    assert have.keys() == raw.keys() and all(abs(have[k] - raw[k] / span) < 1e-9 for k in raw)
    few = programs.gsva(e, p, "gsva", min_size=3, block=5)
    assert few.count() == 36 and few.where("score is null or abs(score) > 2").count() == 0


# --- ranges


def test_long_intervals_are_listed_twice_at_most(spark):
    spans = [("1", 0, 200_000_000, 1), ("1", 999, 1000, 2), ("1", 5_000, 5_000, 3), ("1", 1023, 2049, 4), ("2", 10, 90_000, 5), (None, 0, 50, 6), ("1", 1_000_000, 1_600_000, 7)]
    i = spark.createDataFrame(spans, "chrom string, start long, end long, i long")
    assert ranges._listed(i.where("start < end"), F.col("start") + 1, F.col("end"), 1024).groupBy("i").count().agg(F.max("count")).first()[0] <= 2
    r = random.Random(2)
    points = [(r.choice(["1", "2", None]), r.choice([0, 1, 999, 1000, 1023, 1024, 2049, 2050, 5000, 90_000, 200_000_000, 200_000_001, r.randrange(2_000_000)]), j) for j in range(300)] + [("1", None, 999)]
    p = spark.createDataFrame(points, "chrom string, pos long, j long")
    have = sorted((x["j"], x["i"]) for x in ranges.interval_join(p, i).collect())
    assert have == sorted((j, k) for c, x, j in points for d, a, b, k in spans if c is not None and c == d and x is not None and a < x <= b)
    w = ranges.window_overlap_join(p, i, 300, 200, start="start", end="end", bin_size=64)
    have = sorted((x["j"], x["i"]) for x in w.collect())
    assert have == sorted((j, k) for c, x, j in points for d, a, b, k in spans if c is not None and c == d and x is not None and a <= b and b >= x - 300 and a <= x + 200)
    assert ranges.interval_join(p, i.limit(0)).count() == 0


def test_runs_across_range_borders(spark):
    """One run over nearly all positions of a chromosome, which many ranges share, and short ones around it."""
    pos = [("1", 10 * i) for i in range(3000)] + [("1", 40_000), ("1", 40_010), ("1", 40_021), ("2", 5), ("2", 5), ("3", 1), (None, 4), ("2", None)]
    d = spark.createDataFrame(pos, "chrom string, pos long")
    have = sorted((str(x["chrom"]), x["start"], x["end"], x["n"]) for x in select.coalesce_positions(d, 10).collect())
    assert have == [("1", 0, 29_990, 3000), ("1", 40_000, 40_010, 2), ("1", 40_021, 40_021, 1), ("2", 5, 5, 1), ("3", 1, 1, 1), ("None", 4, 4, 1)]


def test_orders_without_keys_by_ranges(spark):
    rows = [(i, (i * 7919) % 1009 - 500.0 if i % 11 else None, "ab"[i % 2]) for i in range(1500)]
    d = spark.createDataFrame(rows, "id long, v double, k string")
    low, have = math.inf, {x["id"]: x["m"] for x in select.running_min(d, "v", [F.col("id")], [], "m").collect()}
    for i, v, _ in rows:
        low = low if v is None else min(low, v)
        assert have[i] == (None if low == math.inf else low)
    order = sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0.0), x[0]))
    have = {x["id"]: x["rank"] for x in select.unique_rank(d, "v", [], ["id"]).collect()}
    assert have == {x[0]: i + 1 for i, x in enumerate(order)}
    have = {x["id"]: x["share"] for x in select.share(d, "id", ["k"]).collect()}
    total = {k: sum(x[0] for x in rows if x[2] == k) for k in "ab"}
    assert all(abs(have[i] - i / total[k]) < 1e-12 for i, _, k in rows)


def test_weighted_medians_sort_what_lies_about_them(monkeypatch):
    """F16: most of a resample's ratios are only compared; the medians are those of whole sorts, also far from the others."""
    r = np.random.default_rng(5)
    ratio, weight = np.round(r.standard_normal((400, 500)) * 20) / 20, r.integers(1, 9, 500).astype(float)
    ratio[77] += 9  # lies outside of what is sorted
    ratio[300] = 1e9
    plain, cells = meta._medians, []
    expected = plain(ratio, weight, 0.0, weight.sum())[0]
    monkeypatch.setattr(meta, "_medians", lambda x, *a: cells.append(x.size) or plain(x, *a))
    assert np.allclose(meta.weighted_medians(ratio, weight), expected, rtol=1e-12, atol=1e-12)
    assert sum(cells) < ratio.size / 2
