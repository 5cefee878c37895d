"""Walks, cross-validation, baselines, trees, calibration and components against NumPy."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociforge.operators import effects, graph, linkage, models, stats
from lociforge.operators.shared import bucketed


def _graph(spark, n=24, seed=3):
    r = random.Random(seed)
    genes = [f"G{i:02}" for i in range(n)]
    pairs = {tuple(sorted(r.sample(genes, 2))) for _ in range(3 * n)} | {(genes[i], genes[i + 1]) for i in range(n - 1)}
    a = np.zeros((n, n))
    for u, v in pairs:
        a[genes.index(u), genes.index(v)] = a[genes.index(v), genes.index(u)] = 1
    return genes, a / a.sum(1, keepdims=True), spark.createDataFrame(sorted(pairs), "u string, v string")


def test_edges_stay_where_they_are(spark):
    """A join of the vector with the bucketed edges deals out the vector only."""
    _, _, edges = _graph(spark)
    steps = bucketed(edges.select(F.col("u").alias("gene"), F.col("v").alias("near")), "near")
    f = spark.range(1000).select(F.format_string("G%02d", F.col("id") % 24).alias("near"), "id")
    plan = steps.hint("merge").join(f, "near")._jdf.queryExecution().executedPlan().toString()
    scan = plan.split("FileScan")[0]
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1
    assert "Exchange" not in scan.split("SortMergeJoin")[1].split("Sort [")[1] or scan.rstrip().endswith("+- *")


def test_cross_validated_walk_as_a_dense_solve(spark):
    genes, p, edges = _graph(spark)
    r = random.Random(1)
    labels = [(g, r.choice([-1.0, 0.5, 2.0]), r.choice([0.5, 1.0])) for g in genes[:15]]
    oof, metrics = graph.rwr_cv(edges, spark.createDataFrame(labels, "gene string, beta double, confidence double"), [0.3, 0.6], k=3, repeats=2)
    rows = oof.collect()
    assert len(rows) == 15 * 2 * 2 and {x["alpha"] for x in metrics.collect()} == {0.3, 0.6}
    fold = {(x["repeat"], x["gene"]): x["fold"] for x in rows}
    beta = {g: (b, c) for g, b, c in labels}
    want = {}
    for alpha, repeat, held in itertools.product((0.3, 0.6), range(2), range(3)):
        solve = alpha * np.linalg.inv(np.eye(len(genes)) - (1 - alpha) * p)
        train = [g for g in beta if fold[repeat, g] != held]
        signed, mass = np.zeros(len(genes)), np.zeros(len(genes))
        for g in train:
            signed[genes.index(g)], mass[genes.index(g)] = beta[g][0] * beta[g][1], beta[g][1]
        pred = (solve @ signed) / (solve @ mass + 1e-12)
        for g in beta:
            if fold[repeat, g] == held:
                want[alpha, repeat, g] = pred[genes.index(g)]
    assert all(abs(x["pred"] - want[x["alpha"], x["repeat"], x["gene"]]) < 1e-5 for x in rows)
    for x in metrics.collect():
        mine = [y for y in rows if y["alpha"] == x["alpha"]]
        assert abs(x["rmse"] - np.sqrt(np.mean([(y["beta"] - y["pred"]) ** 2 for y in mine]))) < 1e-9
        assert abs(x["sign_accuracy"] - np.mean([np.sign(y["beta"]) == np.sign(y["pred"]) for y in mine])) < 1e-9


def _features(spark, n=90, seed=2):
    r = np.random.default_rng(seed)
    x = r.normal(0, 1, (n, 3))
    y = 2 * x[:, 0] - x[:, 1] + r.normal(0, 0.5, n)
    return x, y, spark.createDataFrame([(f"g{i:03}", *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))], "gene string, x1 double, x2 double, x3 double, y double")


def test_baselines_against_plain_fits(spark):
    x, y, d = _features(spark)
    got = {m["model"]: m for m in models.cv_models(d, {"size": ["x3"], "all": ["x1", "x2", "x3"]}, "y", trees=5).collect()}
    assert got.keys() == {"mean", "ridge_size", "ridge_all", "random_forest"} and all(m["n"] == 90 for m in got.values())
    fold = {v["gene"]: v["fold"] for v in models.assign_folds(d, ["gene"], 5, 1, 1).collect()}
    f = np.array([fold[f"g{i:03}"] for i in range(90)])
    mean = np.array([y[f != k].mean() for k in f])
    assert abs(got["mean"]["rmse"] - np.sqrt(((y - mean) ** 2).mean())) < 1e-9
    ridge = np.zeros(90)
    for k in range(5):
        a, b = f != k, f == k
        m, s = x[a].mean(0), x[a].std(0)
        z = (x - m) / s
        w = np.linalg.solve(z[a].T @ z[a] + 10 * np.eye(3), z[a].T @ (y[a] - y[a].mean()))
        ridge[b] = y[a].mean() + z[b] @ w
    assert abs(got["ridge_all"]["rmse"] - np.sqrt(((y - ridge) ** 2).mean())) < 1e-6
    assert got["ridge_all"]["rmse"] < got["random_forest"]["rmse"] < got["mean"]["rmse"] < got["ridge_size"]["rmse"] * 1.1


def test_sensitivity_ranks_features_by_what_they_explain(spark):
    _, y, d = _features(spark)
    pred, importance = models.sensitivity_model(d, ["x1", "x2", "x3"], "y", iterations=10, shuffles=4)
    rows = pred.select("y", "pred").collect()
    assert len(rows) == 90 and np.mean([(r["y"] - r["pred"]) ** 2 for r in rows]) < 0.3 * y.var()
    got = {r["feature"]: r["importance_mean"] for r in importance.collect()}
    assert got["x1"] > got["x2"] > max(0.0, got["x3"]) and got["x1"] > 1


def test_calibration_as_plain_fits(spark):
    r = np.random.default_rng(4)
    score = np.round(r.normal(0, 1, 120), 2)
    y = (r.random(120) < 1 / (1 + np.exp(-2 * score))).astype(int)
    d = spark.createDataFrame([(float(s), int(v)) for s, v in zip(score, y)] + [(0.3, None)], "s double, y int")
    out, metrics = models.calibrate(d, "s", "y")
    rows = [x for x in out.collect() if x["y"] is not None]
    w = np.zeros(2)
    for _ in range(50):  # Newton's method
        x = np.column_stack((score, np.ones(120)))
        p = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p))
    assert all(abs(x["p_platt"] - 1 / (1 + np.exp(-(w[0] * x["s"] + w[1])))) < 1e-3 for x in rows)
    levels, sizes, low = [], [], []  # pool adjacent violators
    for s in sorted(set(score)):
        levels, sizes, low = [*levels, y[score == s].mean()], [*sizes, (score == s).sum()], [*low, s]
        while len(levels) > 1 and levels[-2] >= levels[-1]:
            n = sizes[-2] + sizes[-1]
            levels[-2:], sizes[-2:], low[-2:] = [(levels[-2] * sizes[-2] + levels[-1] * sizes[-1]) / n], [n], [low[-2]]
    at = {x["s"]: x["p_isotonic"] for x in rows}
    assert all(abs(at[float(s)] - levels[np.searchsorted(low, s, side="right") - 1]) < 1e-9 for s in score)
    m = metrics.collect()
    best = {x["method"]: x["brier"] for x in m}
    assert m[0]["brier"] == min(best.values()) and abs(best["p_platt"] - np.mean([(x["p_platt"] - x["y"]) ** 2 for x in rows])) < 1e-9


@pytest.mark.parametrize("scale", [False, True])
def test_components_as_in_numpy(spark, scale):
    """32 of 1,500 columns, up to nothing: the sign is fixed by the largest loading."""
    r = np.random.default_rng(6)
    x = r.normal(0, 1, (60, 32)) * np.linspace(9, 2, 32) @ r.normal(0, 1, (32, 1500)) + r.normal(0, 0.1, (60, 1500)) + 5
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, v array<double>").repartition(4)
    got = effects.pca(d, "v", scale=scale).orderBy("i").collect()
    z = (x - x.mean(0)) / (x.std(0, ddof=1) if scale else 1)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    load = vt[:32].T * np.sign(vt[:32].T[np.abs(vt[:32]).argmax(1), np.arange(32)])
    want = z @ load
    assert np.abs(np.array([g["pcs"] for g in got]) - want).max() < 1e-5 * np.abs(want).max()
    assert np.allclose(got[0]["explained"], (s**2 / (s**2).sum())[:32], atol=1e-9)


def test_components_of_awkward_rows(spark):
    d = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [2.0, None]), (4, [1.0, 2.0])], "i int, v array<double>")
    got = {x["i"]: x["pcs"] for x in effects.pca(d, "v", 5).collect()}
    assert len(got) == 4 and all(len(p) == 2 for p in got.values()) and got[1] == got[4]
    assert effects.pca(d.limit(0), "v").count() == 0 and effects.pca(d.where("i = 2"), "v").first()["pcs"] == []


def test_exact_u_for_any_size():
    for n1, n2 in ((2, 3), (3, 7), (4, 6), (7, 2)):
        us = [sum(r) - n1 * (n1 + 1) // 2 for r in itertools.combinations(range(1, n1 + n2 + 1), n1)]
        for u in range(n1 * n2 + 1):
            assert abs(stats._exact_u(n1, n2, u) - min(1.0, 2 * np.mean([v <= min(u, n1 * n2 - u) for v in us]))) < 1e-12
    assert 0.9 < stats._exact_u(8, 100_000, 400_000) <= 1 and stats._exact_u(1, 1_000_000, 0) == pytest.approx(2 / 1_000_001)


def test_blocks_of_long_chains_in_few_rounds(spark, monkeypatch):
    made = []
    monkeypatch.setattr(linkage, "checkpointed", lambda d, f=linkage.checkpointed: made.append(1) or f(d))
    chain = list(range(1000))
    random.Random(3).shuffle(chain)
    edges = [("a", u, v) for u, v in itertools.pairwise(chain)] + [("b", 5, 900), ("b", 900, 7), ("b", 30, 31), ("a", 2000, 2001)]
    got = {(x["k"], x["u"]): x["block"] for x in linkage.keyed_components(spark.createDataFrame(edges, "k string, u long, v long"), ["k"]).collect()}
    assert got == {**{("a", i): 0 for i in range(1000)}, ("a", 2000): 2000, ("a", 2001): 2000, **{("b", i): 5 for i in (5, 7, 900)}, ("b", 30): 30, ("b", 31): 30}
    assert len(made) <= 16
    assert linkage.keyed_components(spark.createDataFrame([], "k string, u long, v long"), ["k"]).count() == 0


def test_permutation_control_walks_permutations_not_genes(spark, monkeypatch):
    """a gene's vector has a number a fold and permutation, however many genes are labelled."""
    seen = []
    monkeypatch.setattr(models, "packed_walk", lambda e, s, alphas, f=models.packed_walk, **how: seen.append(len(alphas)) or f(e, s, alphas, **how))
    genes, _, edges = _graph(spark, 26, 8)
    labels = spark.createDataFrame([(g, (-1.0) ** i, 1.0) for i, g in enumerate(genes)], "gene string, beta double, confidence double")
    null, _ = models.permutation_control(edges, spark.createDataFrame([(g, 1.0) for g in genes], "gene string, x double"), labels, ["x"], 0.6, n=4, k=2)
    assert seen == [2 * (4 + 1)] and null.count() == 4


def test_permutation_control_as_a_plain_loop(spark, monkeypatch):
    """Blocks of few genes and permutations, against refitting each permutation on whole arrays."""
    monkeypatch.setattr(models, "CONTROL_GENES", 4)
    monkeypatch.setattr(models, "CONTROL_PERMS", 3)
    dealt = []
    monkeypatch.setattr(models, "permute_labels", lambda *a, f=models.permute_labels: dealt.append(f(*a)) or dealt[-1])
    genes, p, edges = _graph(spark, 26, 8)
    r = random.Random(2)
    labels = [(g, r.choice([-2.0, -1.0, 0.5, 1.5]), r.choice([0.5, 1.0, None])) for g in genes[:22]]
    feats = [(g, r.gauss(0, 1), None if i == 3 else r.gauss(0, 1)) for i, g in enumerate(genes)]
    args = edges, spark.createDataFrame(feats, "gene string, x double, z double"), spark.createDataFrame([*labels, ("G25", None, 1.0), ("G24", 0.0, 1.0)], "gene string, beta double, confidence double"), ["x", "z"]
    null, seen = models.permutation_control(*args, 0.6, n=8, k=3, tol=1e-12)
    got = {x["permutation"]: x for x in null.collect()}
    fold = {x["gene"]: x["fold"] for x in models.assign_folds(args[2].where("beta is not null and beta <> 0").withColumn("sign", F.col("beta") > 0), ["gene"], 3, 1, 1, ["sign"]).collect()}
    mine = sorted(fold)
    f, beta = np.array([fold[g] for g in mine]), np.array([dict((a, b) for a, b, _ in labels)[g] for g in mine])
    conf = np.array([dict((a, c) for a, _, c in labels)[g] or 0.0 for g in mine])
    w = np.where(conf > 0, conf, 1.0)
    base = np.array([[dict((a, (b, c)) for a, b, c in feats)[g][j] or 0.0 for j in range(2)] for g in mine])
    at = [genes.index(g) for g in mine]
    reach = (0.3 * np.linalg.inv(np.eye(26) - 0.7 * p))[np.ix_(at, at)]
    signs = {(x["gene"], x["perm"]): x["y"] for x in dealt[0].collect()}
    assert sorted(got) == list(range(1, 9))
    for perm in range(8):
        y, prob = np.array([signs[g, perm] for g in mine]), np.zeros(22)
        assert sorted(np.sign(y)) == sorted(np.sign(beta)) and (np.abs(y) == np.abs(beta)).all()
        for k in range(3):
            tr, te = f != k, f == k
            mass = reach[:, tr] @ conf[tr]
            x = np.column_stack((base, reach[:, tr] @ (conf[tr] * y[tr]) / (mass + 1e-12), mass))
            sd = x[tr].std(0)
            z, m = x[tr] / sd, np.average(y[tr], weights=w[tr])
            c = z - np.average(z, axis=0, weights=w[tr])
            b = np.linalg.solve((c * w[tr, None]).T @ c + 10 * np.eye(4), (c * w[tr, None]).T @ (y[tr] - m))
            pred = m + (x[te] / sd - np.average(z, axis=0, weights=w[tr])) @ b
            prob[te] = 1 / (1 + np.exp(-pred / y[tr].std()))
        wins = sum((a > d) + (a == d) / 2 for a in prob[beta > 0] for d in prob[beta < 0])
        assert abs(got[perm + 1]["auroc"] - wins / ((beta > 0).sum() * (beta < 0).sum())) < 1e-6
        assert abs(got[perm + 1]["sign_accuracy"] - np.mean((prob > 0.5) == (beta > 0))) < 1e-9
    s = seen.first()
    assert s["n_permutations"] == 8 and s["empirical_p"] == pytest.approx((1 + sum(x["auroc"] >= 0.6 for x in got.values())) / 9)
