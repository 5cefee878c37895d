"""Ranks, running totals and draws by ranges, against plain versions."""

from __future__ import annotations

import random
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

from lociforge.operators import select, stats
from lociforge.operators.ordered import numbered, value_totals


def _rows(n: int, seed: int = 3) -> list[tuple]:
    """Null keys and values, a third of all rows at one value, and more different values than there are bounds."""
    r = random.Random(seed)
    return [(r.choice(["a", "b", None]), None if r.random() < 0.05 else 7.0 if r.random() < 0.3 else float(r.randrange(600)), i, r.choice(["case", "control", "other", None])) for i in range(n)]


SCHEMA = "k string, v double, id long, g string"


def test_average_rank_as_in_pandas(spark):
    rows = _rows(3000)
    d = spark.createDataFrame(rows, SCHEMA)
    want = pd.DataFrame(rows, columns=["k", "v", "id", "g"]).assign(k=lambda x: x["k"].fillna("~"))
    for keys, pct, asc in (([], True, True), (["k"], False, False), (["k"], False, True)):
        have = {x["id"]: x["rank"] for x in select.avg_rank(d, "v", keys, pct, asc).collect()}
        by = want.groupby(keys)["v"] if keys else want["v"]
        assert len(have) == len(rows)
        for i, x in zip(want["id"], by.rank(method="average", ascending=asc, pct=pct), strict=True):
            assert (have[i] is None) == pd.isna(x) and (have[i] is None or abs(have[i] - x) < 1e-9)


def test_running_totals_and_empty_tables(spark):
    rows = _rows(2000, 5)
    t = value_totals(spark.createDataFrame(rows, SCHEMA), ["k"], "v", {"n": F.count("*"), "s": F.sum("id")}).collect()
    assert len({x["__range"] for x in t}) > 50
    for x in t:
        mine = [r for r in rows if r[0] == x["k"] and r[1] is not None]
        assert (x["n_upto"], x["n_all"]) == (sum(r[1] <= x["v"] for r in mine), len(mine))
        assert x["s_upto"] == sum(r[2] for r in mine if r[1] <= x["v"])
    empty = spark.createDataFrame([], SCHEMA)
    assert value_totals(empty, ["k"], "v", {"n": F.count("*")}).count() == 0
    assert select.avg_rank(empty, "v").count() == 0
    assert stats.bh_fdr(empty, "v").count() == 0
    assert stats.mann_whitney(empty, ["k"], "g", "v").count() == 0
    assert select.permute_labels(empty, ["id"], "v", 2).count() == select.bootstrap(empty, ["k"], 2, ["id"]).count() == select.assign_folds(empty, ["id"]).count() == 0


def test_false_discovery_without_scope(spark):
    r = random.Random(8)
    p = [None if r.random() < 0.1 else r.choice([0.001, round(r.random(), 3)]) for _ in range(1500)]
    have = {x["id"]: x["fdr"] for x in stats.bh_fdr(spark.createDataFrame(list(enumerate(p)), "id long, p double"), "p").collect()}
    there = sorted((x, i) for i, x in enumerate(p) if x is not None)
    least = 1.0
    want = dict.fromkeys(range(len(p)))
    for place in range(len(there), 0, -1):
        x, i = there[place - 1]
        least = min(least, x * len(there) / place)
        want[i] = least
    for i in range(len(p)):
        assert (have[i] is None) == (want[i] is None) and (want[i] is None or abs(have[i] - want[i]) < 1e-9)


def test_median_ranks_and_binary_metrics(spark):
    rows = _rows(800, 9)
    have = {x["k"]: x for x in stats.rank_sums(spark.createDataFrame(rows, SCHEMA), ["k"], "g", "v").collect()}
    for k, x in have.items():
        f = pd.DataFrame([r for r in rows if r[0] == k and r[1] is not None and r[3] in ("case", "control")], columns=["k", "v", "id", "g"])
        ranks = f["v"].rank()
        for side, c in (("case", "median_rank_case"), ("control", "median_rank_control")):
            assert x[c] == ranks[f["g"] == side].median()
        assert abs(x["r1"] - ranks[f["g"] == "case"].sum()) < 1e-6 and x["ties"] == sum(c**3 - c for c in Counter(f["v"]).values())
    m = stats.binary_metrics(spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1), (None, 0.3)], "y int, p double"), "y", "p").first()
    assert (m["n"], m["n_pos"], m["auroc"]) == (4, 2, 0.625) and abs(m["average_precision"] - (0.5 + 2 / 3) / 2) < 1e-9


def test_draws_are_whole_and_repeatable(spark):
    rows = _rows(900, 4)
    d = spark.createDataFrame(rows, SCHEMA)
    n = [(x["k"], x["i"], x["all"]) for x in numbered(d, ["k"], F.xxhash64("id"), ["id"], "i", "all").collect()]
    for k in ("a", "b", None):
        places = sorted(i for kk, i, _ in n if kk == k)
        assert places == list(range(len(places))) and {a for kk, _, a in n if kk == k} == {len(places)}
    moved = select.permute_labels(d, ["id"], "v", 3, keys=["k"]).collect()
    for perm in range(3):
        for k in ("a", "b", None):
            assert Counter(x["v"] for x in moved if x["perm"] == perm and x["k"] == k) == Counter(r[1] for r in rows if r[0] == k)
    assert sorted(map(str, moved)) == sorted(map(str, select.permute_labels(d.repartition(5), ["id"], "v", 3, keys=["k"]).collect()))
    by_id = {(x["id"], x["perm"]): x["v"] for x in moved}
    assert sum(by_id[i, 0] != by_id[i, 1] for i in range(900)) > 300
    kept = select.balanced_sample(d, ["k"], "g", ["id"], cap=60).collect()
    assert Counter(x["k"] for x in kept) == {"a": 60, "b": 60, None: 60}
    assert all(Counter((x["k"], x["g"]) for x in kept)[k, g] >= 15 for k in ("a", "b", None) for g in ("case", "control", "other"))


def test_no_task_holds_the_whole_order(spark):
    """Without keys the rows themselves are never sent to one task: only counts, bounds and ends of ranges are."""
    d = spark.range(5000).selectExpr("id", "cast(id * 7919 % 1009 as double) as v")
    plan = select.avg_rank(d, "v")._jdf.queryExecution().executedPlan().toString()
    before = plan.split("Exchange SinglePartition")[1:]
    assert before and all(any(x in part[:400] for x in ("HashAggregate", "ObjectHashAggregate", "WindowGroupLimit", "LocalLimit", "TakeOrdered")) for part in before)
