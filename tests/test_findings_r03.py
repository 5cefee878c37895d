"""Findings of round 3: sums before cross products, bins by length, exact sums and ties, all samples of a kernel."""

import math

import numpy as np
from pyspark.sql import functions as F

from lociforge.operators import contrib, effects, meta, programs, ranges, stats


def rows(df, *cols):
    return sorted((tuple(x) for x in (df.select(*cols) if cols else df).collect()), key=str)


def test_contexts_meet_sums_only(spark, monkeypatch):
    """the same rows as the roll-up of every contribution in every context, but only a row a gene meets the contexts."""
    d = spark.createDataFrame([(f"g{i % 3}", f"r{i}", f"w{i % 5}", (i % 7 - 3) / 4) for i in range(60)], "gene string, reg_rsid string, gwas_rsid string, contribution double")
    ctx = spark.createDataFrame([("T", "PD", 2.0), ("B", "PD", -1.5), ("B", "normal", 0.25)], "cell_type string, disease string, cscore double")
    cols = ("cell_type", "disease", "gene", F.round("value", 9), F.round("share", 9), "n_rows", "rank")
    want = rows(contrib.deconvolve_rollup(contrib.deconvolve(d, ctx), ["gene"]), *cols)
    met, cross = [], contrib.cross_context
    monkeypatch.setattr(contrib, "cross_context", lambda a, b: met.append(a.count()) or cross(a, b))
    assert rows(contrib.deconvolve_sums(d, ctx, ["gene"]), *cols) == want and met == [3]


def test_short_intervals_meet_few_points_in_vain(spark):
    """bins are less than twice as long as a span, so at most a few candidates a pair."""
    p = spark.range(5000).selectExpr("'1' as chrom", "id as pos", "id as j")
    i = spark.range(1000).selectExpr("'1' as chrom", "id * 5 as start", "id * 5 + 20 as end", "id as i")
    listed = ranges._listed(i, F.col("start") + 1, F.col("end"), 16)
    met = ranges._looking(p, listed, F.col("pos"), 16).join(listed, ["chrom", "__level", "__bin"]).count()
    pairs = ranges.interval_join(p, i).count()
    assert pairs == sum(max(0, min(4999, 5 * k + 20) - 5 * k) for k in range(1000)) and met < 3 * pairs


def test_best_interval_of_each_point(spark):
    """points that share a position are not looked up one by one."""
    p = spark.createDataFrame([("1", 10, "a"), ("1", 10, "b"), ("1", 30, "c"), ("2", 10, "d")], "chrom string, pos long, j string")
    i = spark.createDataFrame([("1", 5, 10, "x", 1.0), ("1", 9, 12, "z", 2.0), ("1", 0, 20, "y", 2.0), ("1", 30, 40, "w", 9.0)], "chrom string, start long, end long, id string, signal double")
    assert rows(ranges.best_interval(p, i, [F.desc("signal"), F.col("id")]), "j", "id") == [("a", "y"), ("b", "y")]


def test_kruskal_beyond_whole_numbers(spark):
    """the cube of three million is no long."""
    d = spark.range(3_000_000).selectExpr("'k' as k", "id % 3 as g", "id % 4 as x")
    r = stats.kruskal(d, ["k"], "g", "x").first()
    assert r["n"] == 3_000_000 and r["n_groups"] == 3 and abs(r["h"]) < 1e-3


def test_equal_strengths_are_dominant_in_order(spark):
    """0.1 + 0.2 in blood and 0.3 in brain tie, so blood is named."""
    d = spark.createDataFrame([("g", "a", 0.1), ("g", "b", 0.2), ("g", "c", 0.3)], "gene string, rsid string, sumabs_d double")
    for blood, brain in ((("a", "b"), ("c",)), (("c",), ("a", "b"))):
        reg = spark.createDataFrame([(x, "Blood") for x in blood] + [(x, "Brain") for x in brain], "rsid string, dhs_tissue string")
        assert effects.dhs_tissue_summary(d, reg, ["blood"], ["brain"]).first()["dominant"] == "blood"


def test_context_ranks_go_on_where_p_is_0(spark):
    """z of 50 and 60 have a p of 0, and equal genes are in the order of their names."""
    d = spark.createDataFrame([("a", "t", 50.0), ("b", "t", 60.0), ("d", "t", 60.0 + 1e-14), ("e", "t", 3.0)], "gene string, context string, beta double").withColumn("se", F.lit(1.0))
    assert rows(meta.gene_context_summary(d), "rank", "gene") == [(1, "b"), (2, "d"), (3, "a"), (4, "e")]


def test_weighted_median_without_draws(spark):
    """without resamples the estimate is the same and has no error."""
    r = np.random.default_rng(3)
    d = spark.createDataFrame([("g", f"s{i}", *map(float, r.random(4) + 0.1)) for i in range(30)], "gene string, snp string, beta_exposure double, se_exposure double, beta_outcome double, se_outcome double")
    at = lambda boot: meta.mr_estimate(d, boot=boot).where("method = 'Weighted median'").first()
    assert at(0)["b"] == at(20)["b"] and at(0)["se"] is None and at(20)["se"] > 0


def test_kernel_takes_all_samples(spark):
    """without a block the kernel runs over all samples, by their different values and their counts."""
    r = np.random.default_rng(5)
    v = np.floor(r.random((70, 12)) * 9)
    e = spark.createDataFrame([(f"s{i:02}", f"g{j:02}", float(v[i, j])) for i in range(70) for j in range(12)], "sample_id string, gene string, value double").repartition(3)
    p = spark.createDataFrame([("up", f"g{j:02}") for j in range(4)], "program string, gene string")
    z = (v[:, None, :] - v[None, :, :]) / (v.std(0, ddof=1) / 4)
    k = np.vectorize(lambda x: 0.5 * math.erfc(-x / math.sqrt(2)))(z).mean(1)
    for table in (spark.createDataFrame([(f"s{i:02}", f"g{j:02}", float(k[i, j])) for i in range(70) for j in range(12)], "sample_id string, gene string, value double"),):
        got = {(x["sample_id"], x["gene"]): x["value"] for x in programs.kernel_cdf(e, 4).collect()}
        assert all(abs(got[x["sample_id"], x["gene"]] - x["value"]) < 1e-6 for x in table.collect()) and len(got) == 840
    want = rows(programs.gsva(e, p, min_size=3, block=70), "sample_id", "program", F.round("score", 6))
    assert rows(programs.gsva(e, p, min_size=3), "sample_id", "program", F.round("score", 6)) == want


def test_predictions_meet_deltas_first(spark):
    """the join that multiplies rows is the last one, so its rows are not dealt out by gene."""
    delta = spark.createDataFrame([("r1", "g1", 1.0), ("r1", "g2", 2.0), ("r2", "g1", 3.0), ("r3", "g3", 4.0)], "reg_rsid string, gene string, effect double")
    links = spark.createDataFrame([("r1", "w1", 0.1), ("r1", "w2", 0.2), ("r2", "w1", 0.3), ("r3", "w3", 0.4)], "reg_rsid string, gwas_rsid string, p double")
    pred = spark.createDataFrame([("g1", -1.0), ("g2", 0.5)], "gene string, pred double")
    got = contrib.contribution_rows(delta, links, pred)
    assert got.columns == ["gene", "reg_rsid", "effect", "gwas_rsid", "p", "pred"]
    assert rows(got) == [("g1", "r1", 1.0, "w1", 0.1, -1.0), ("g1", "r1", 1.0, "w2", 0.2, -1.0), ("g1", "r2", 3.0, "w1", 0.3, -1.0), ("g2", "r1", 2.0, "w1", 0.1, 0.5), ("g2", "r1", 2.0, "w2", 0.2, 0.5)]
    first = got._jdf.queryExecution().optimizedPlan().toString().split("Join ")[1].splitlines()[0]
    assert "reg_rsid" in first and "gene" not in first


def test_collapse_genes_sorts_leading_rows_only(spark):
    """rows behind a gene's first value of the order reach no sort; nulls, nan and ties are in the order of a whole sort."""
    from itertools import product

    nan, some = float("nan"), [None, float("nan"), -0.5, 0.0, 0.5, 2.0]
    pairs = [(f"g{i % 40}", b, p) for i, (b, p) in enumerate(list(product(some, [None, nan, 0.0, 0.25, 1.0])) * 4)] + [("one", 1.0, 0.5), ("none", None, None)]
    d = spark.createDataFrame(pairs, "gene string, beta double, pvalue double")
    null, low, high = (0, 0.0), lambda x: (1, x) if x == x else (2, 0.0), lambda x: (0, 0.0) if x is not None and x != x else (2, 0.0) if x is None else (1, -abs(x))
    up = lambda x: null if x is None else low(x)
    order = {"strongest_p": lambda b, p: (up(p), high(b), up(b)), "largest_abs_beta": lambda b, p: (high(b), up(p), up(b))}
    order["exclude"] = order["strongest_p"]
    for policy, key in order.items():
        want = {}
        for g in {x[0] for x in pairs}:
            mine = [x[1:] for x in pairs if x[0] == g]
            signs = [-1 if b < 0 else int(b > 0) for b, _ in mine if b is not None]
            conflict = None if not signs else all(b == b for b, _ in mine if b is not None) and min(signs) * max(signs) < 0
            if policy != "exclude" or conflict is False:
                want[g] = str((*min(mine, key=lambda x: key(*x)), len(mine), conflict))
        got = {x["gene"]: str((x["beta"], x["pvalue"], x["n_rows"], x["conflict"])) for x in meta.collapse_genes(d, policy).collect()}
        assert got == want
    wide = spark.range(20_000).selectExpr("concat('g', id % 3) as gene", "cast(id as double) - 5000.5 as beta", "cast(id as double) as pvalue")
    out = meta.collapse_genes(wide)
    assert len(out.collect()) == 3
    plan = out._jdf.queryExecution().executedPlan().toString()
    sorts = [line for line in plan.split("Final Plan")[1].split("Initial Plan")[0].splitlines() if "Sort [" in line]
    assert "ShuffledHashJoin" in plan and len(sorts) <= 2


def test_decompose_in_tasks_of_a_size(spark, monkeypatch):
    """shares need no sort of a gene's rows, and tasks that count different ones grow in number, not in size."""
    from lociforge.operators import shared

    r = np.random.default_rng(7)
    pick = lambda x: None if r.random() < 0.05 else x
    d = [(f"g{r.integers(5)}", pick(f"r{r.integers(9)}"), pick(f"w{r.integers(7)}"), pick(float(r.integers(4)) * (i % 5 > 0)), pick(float(r.integers(-3, 4)))) for i in range(200)]
    d += [(None, "r1", "w1", 0.0, 2.0), (None, "r1", "w2", 0.0, -1.0), ("none", None, None, None, None)]
    df = spark.createDataFrame([(*x, 1.0) for x in d], "gene string, reg_rsid string, gwas_rsid string, weight double, effect double, pred double")
    monkeypatch.setattr(shared, "DEALT_ROWS", 10)
    assert shared.dealt(df, ["gene"]).rdd.getNumPartitions() == 21
    got = contrib.decompose(df)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "ShuffledHashJoin" in plan
    some = lambda x: [v for v in x if v is not None]
    share, summary = [], {}
    for g in {x[0] for x in d}:
        mine = [x for x in d if x[0] == g]
        total = sum(some(x[3] for x in mine))
        s = [(x[3] if x[3] is None else x[3] / total) if total > 0 else 1 / len(mine) for x in mine]
        c = [None if a is None or x[4] is None else a * x[4] for a, x in zip(s, mine, strict=True)]
        size = sum(map(abs, some(c)))
        share += [(str(g), str(x[1]), str(x[2]), str(a if a is None else round(a, 9)), round((v or 0) / size, 9) + 0.0 if size else 0.0) for x, a, v in zip(mine, s, c, strict=True)]
        summary[g] = (len(mine), len(set(some(x[1] for x in mine))), len(set(some(x[2] for x in mine))))
    seen = [(str(x[0]), str(x[1]), str(x[2]), str(x[3] if x[3] is None else round(x[3], 9)), round(x[4], 9) + 0.0) for x in got.select("gene", "reg_rsid", "gwas_rsid", "share", "relative").collect()]
    assert sorted(seen) == sorted(share)
    assert {x["gene"]: (x["n_rows"], x["n_variants"], x["n_loci"]) for x in contrib.decompose_summary(got).collect()} == summary
