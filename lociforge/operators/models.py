"""Direction models over gene features: ridge by Gram sums, trees, calibration, tiers and their reports."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import to_prob
from .graph import rwr_predict
from .shared import bucketed, checkpointed
from .quantiles import quantiles
from .select import assign_folds, avg_rank, best_per_key, binned_curve, permute_labels
from .stats import binary_metrics, regression_metrics
from .walk import packed_walk


def _gram(df: DataFrame, features: list[str], y: str, w: str | None, by: str) -> dict[int, np.ndarray]:
    """For each value of the whole number `by` the sums of products of [1, features, y], weighted and plain: what a ridge fit
    needs, in one pass. Tasks sum whole batches; their sums are added as vectors before and after the shuffle."""
    n = len(features) + 2
    z = F.array(F.lit(1.0), *(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features), F.col(y).cast("double"))
    rows = df.where(F.col(y).isNotNull() & F.col(by).isNotNull()).select(F.col(by).cast("int").alias("k"), z.alias("z"), (F.col(w).cast("double") if w else F.lit(1.0)).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            k, w = b.column("k").to_numpy(), np.nan_to_num(b.column("w").to_numpy(zero_copy_only=False))
            x = b.column("z").flatten().to_numpy().reshape(-1, n)
            for i in np.unique(k).tolist():
                mine = x[k == i]
                sums[i] = sums.get(i, 0.0) + np.concatenate(((mine.T @ (mine * w[k == i, None])).ravel(), (mine.T @ mine).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["k", "g"])

    parts = rows.mapInArrow(run, "k int, g array<double>").groupBy("k").agg(vector_to_array(Summarizer.sum(array_to_vector("g"))).alias("g"))
    return {r["k"]: np.array(r["g"]).reshape(2, n, n) for r in parts.collect()}  # one row a fold


def _solve(grams: np.ndarray, alpha: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Intercept, raw and standardised coefficients of the weighted ridge on features scaled by their plain deviation, from Gram sums."""
    g, plain = grams
    n, k = g[0, 0], g.shape[0] - 2
    if n <= 0 or plain[0, 0] <= 0:
        return 0.0, np.zeros(k), np.zeros(k)
    mean = g[0, 1:] / n
    cov = g[1:, 1:] - n * np.outer(mean, mean)
    sd = np.sqrt(np.maximum(0, np.diag(plain)[1:-1] / plain[0, 0] - (plain[0, 1:-1] / plain[0, 0]) ** 2))
    inv = np.where(sd > 1e-12, 1 / np.where(sd > 1e-12, sd, 1), 0.0)
    b = np.linalg.solve((cov[:k, :k] * inv) * inv[:, None] + alpha * np.eye(k), cov[:k, k] * inv)
    raw = b * inv
    return float(mean[k] - raw @ mean[:k]), raw, b


def _label_sd(grams: np.ndarray) -> float:
    """The plain population deviation of the labels, 1 if they don't vary."""
    plain = grams[1]
    return float(np.sqrt(max(0.0, plain[-1, -1] / plain[0, 0] - (plain[0, -1] / plain[0, 0]) ** 2))) or 1.0


def _linear(features: list[str], cut: float, coef: np.ndarray):
    return reduce(lambda a, b: a + b, (F.lit(float(c)) * F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f, c in zip(features, coef, strict=True)), F.lit(cut))


def weighted_ridge(df: DataFrame, features: list[str], y: str, w: str | None = None, alpha: float = 10.0, id_cols: list[str] = ("gene",), k: int = 5, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Rows with fold, oof_pred (fold models, labelled rows only) and pred (all labelled rows); and (fold, feature,
    coefficient) of standardised features. Fold sums are taken from the whole, so one pass serves all fits."""
    labelled = assign_folds(df.where(F.col(y).isNotNull()), list(id_cols), k, 1, seed).drop("repeat")
    d = checkpointed(labelled.unionByName(df.where(F.col(y).isNull()), allowMissingColumns=True))
    per = _gram(d, features, y, w, "fold")
    whole = sum(per.values()) if per else np.zeros((2, len(features) + 2, len(features) + 2))
    fits = {f: _solve(whole - g, alpha) for f, g in sorted(per.items())}
    oof = F.lit(None).cast("double")
    for f, (cut, raw, _) in fits.items():
        oof = F.when(F.col("fold") == f, _linear(features, cut, raw)).otherwise(oof)
    cut, raw, std = _solve(whole, alpha)
    rows = [(int(f), n, float(c)) for f, (_, _, s) in fits.items() for n, c in zip(features, s, strict=True)] + [(-1, n, float(c)) for n, c in zip(features, std, strict=True)]
    return d.withColumns({"oof_pred": oof, "pred": _linear(features, cut, raw)}), df.sparkSession.createDataFrame(rows, "fold int, feature string, coefficient double")


def walk_ridge(edges: DataFrame, features: DataFrame, labels: DataFrame, names: list[str], walk_alpha: float = 0.3, alpha: float = 10.0, k: int = 5, repeats: int = 5, seed: int = 1, **how) -> tuple[DataFrame, DataFrame]:
    """Repeated cross-validation of the ridge with the walk inside each fold: the training labels walk, their signed result
    and its mass join the features, and weights are the training confidences (1 where there is none).

    Returns (repeat, fold, gene, beta, oof_pred, oof_prob), whose probability is the logistic of the prediction over the
    deviation of the training labels, and (repeat, fold, feature, coefficient). All folds walk and are summed together.
    """
    folds = checkpointed(assign_folds(labels.where("beta is not null").select("gene", "beta", F.coalesce("confidence", F.lit(0.0)).alias("confidence")), ["gene"], k, repeats, seed))
    rows = folds.withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    walk = rwr_predict(edges, rows.where("held <> fold").drop("fold"), [walk_alpha], ["repeat", "held"], with_mass=True, **how)
    walk = walk.select("repeat", "held", "gene", F.col("pred").alias("rwr_pred_beta"), F.col("mass").alias("rwr_confidence"))
    every = [*names, "rwr_pred_beta", "rwr_confidence"]
    x = rows.join(features.select("gene", *names), "gene", "left").join(walk, ["repeat", "held", "gene"], "left")
    x = checkpointed(x.withColumns({"key": F.col("repeat") * k + F.col("held"), "w": F.when(F.col("confidence") > 0, F.col("confidence")).otherwise(1.0)}))
    fits = {key: (_solve(g, alpha), _label_sd(g)) for key, g in _gram(x.where("held <> fold"), every, "beta", "w", "key").items()}
    spark = labels.sparkSession
    table = spark.createDataFrame([(key, cut, raw.tolist(), sd) for key, ((cut, raw, _), sd) in sorted(fits.items())], "key int, cut double, coef array<double>, sd double")
    values = F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in every))
    oof = x.where("held = fold").join(F.broadcast(table), "key")  # one row a fold
    oof = oof.withColumn("oof_pred", F.aggregate(F.zip_with(values, "coef", lambda a, b: a * b), F.col("cut"), lambda s, v: s + v))
    coef = [(key // k, key % k, n, float(c)) for key, ((_, _, std), _) in sorted(fits.items()) for n, c in zip(every, std, strict=True)]
    return oof.select("repeat", "fold", "gene", "beta", "oof_pred", to_prob(F.col("oof_pred"), F.col("sd")).alias("oof_prob")), spark.createDataFrame(coef, "repeat int, fold int, feature string, coefficient double")


#: Labelled genes of a permutation control whose refits a task sums at once, and permutations to a row.
CONTROL_GENES, CONTROL_PERMS = 512, 50


def _control_rows(rows: DataFrame, edges: DataFrame, names: list[str], n: int, walk_alpha: float, k: int, seed: int, **how) -> DataFrame:
    """A row (fold, up, confidence, base, perms, y, walk, mass) for each labelled gene and CONTROL_PERMS permutations: its
    permuted labels, and the walks of permuted signed confidences (walk, fold after fold) and of confidences (mass) from the
    genes outside of each fold. All permutations and folds walk together, as k * (n + 1) numbers of a gene's vector.
    """
    base = F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in names)).cast("array<double>").alias("base")
    moved = permute_labels(rows.select("gene", F.col("beta").alias("y")), ["gene"], "y", n, seed, "signs")
    moved = moved.groupBy("gene").agg(F.sort_array(F.collect_list(F.struct("perm", "y"))).alias("y")).select("gene", F.col("y.y").alias("y"))  # n of them
    labels = bucketed(rows.select("gene", "fold", (F.col("beta") > 0).alias("up"), "confidence", base).join(moved, "gene"), "gene")
    signed = F.concat(F.transform("y", lambda y: y * F.col("confidence")), F.array("confidence"))
    seeds = labels.select("gene", F.flatten(F.array(*(F.when(F.col("fold") != h, signed).otherwise(F.array_repeat(F.lit(0.0), n + 1)) for h in range(k)))).alias("vec"))
    met = packed_walk(edges, seeds, [walk_alpha] * (k * (n + 1)), by_gene=True, **how)
    at = F.col("perms") * CONTROL_PERMS
    part = lambda c, start: F.slice(c, start + at + 1, F.least(F.lit(CONTROL_PERMS), F.lit(n) - at))
    d = labels.join(met, "gene", "left").withColumn("vec", F.coalesce("vec", F.array_repeat(F.lit(0.0), k * (n + 1))))
    d = d.withColumn("perms", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // CONTROL_PERMS))))
    walk = F.flatten(F.array(*(part("vec", h * (n + 1)) for h in range(k)))).alias("walk")
    return d.select("fold", "up", "confidence", "base", "perms", part("y", 0).alias("y"), walk, F.array(*(F.get("vec", F.lit(h * (n + 1) + n)) for h in range(k))).alias("mass"))


def permutation_control(edges: DataFrame, features: DataFrame, labels: DataFrame, names: list[str], observed: float, n: int = 1000, walk_alpha: float = 0.3, alpha: float = 10.0, k: int = 5, seed: int = 1, **how) -> tuple[DataFrame, DataFrame]:
    """The direction AUROC of the cross-validated walk and ridge, refitted on labels whose signs are dealt anew.

    Returns (permutation, auroc, sign_accuracy), measured against the true signs, and one row of observed, mean_permuted,
    sd_permuted, empirical_p = (1 + how many reach the observed one) / (n + 1) and n_permutations. All permutations walk
    together. Refits are sums of products of blocks: no task holds more than a block of genes and of permutations, and
    nothing but the fits' sums is gathered.
    """
    rows = labels.where("beta is not null and beta <> 0").select("gene", F.col("beta").cast("double").alias("beta"), F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence"))
    rows = assign_folds(rows.withColumn("sign", F.col("beta") > 0).dropDuplicates(["gene"]), ["gene"], k, 1, seed, ["sign"]).join(features.select("gene", *names), "gene", "left")
    blocks = _control_rows(checkpointed(rows.drop("repeat", "sign")), edges, names, n, walk_alpha, k, seed, **how)
    width = len(names) + 4  # 1, features, walk, mass, label
    matrix = lambda b, c: b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)

    def parts(b: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
        """A batch's rows of the same permutations, CONTROL_GENES of them."""
        perms = b.column("perms").to_numpy()
        for p in np.unique(perms).tolist():
            at = np.flatnonzero(perms == p)
            for i in range(0, len(at), CONTROL_GENES):
                yield p, b.take(pa.array(at[i : i + CONTROL_GENES]))

    def design(b: pa.RecordBatch, held: int) -> np.ndarray:
        """The rows for the fit without fold `held`, (permutations, genes, width)."""
        y, mass = matrix(b, "y"), matrix(b, "mass")[:, held]
        z = np.empty((y.shape[1], len(b), width))
        z[:, :, 0], z[:, :, -2], z[:, :, -1] = 1, mass, y.T
        if names:
            z[:, :, 1:-3] = matrix(b, "base")
        z[:, :, -3] = (matrix(b, "walk")[:, held * y.shape[1] : (held + 1) * y.shape[1]] / (mass + 1e-12)[:, None]).T
        return z

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}  # k * n fits
        for batch in batches:
            for p, b in parts(batch):
                fold, conf = b.column("fold").to_numpy(), b.column("confidence").to_numpy()
                w = np.where(conf > 0, conf, 1.0)
                for held in range(k):
                    keep = fold != held
                    if not keep.any():
                        continue
                    z = design(b, held)[:, keep]
                    zt = z.transpose(0, 2, 1)
                    sums[held, p] = sums.get((held, p), 0.0) + np.stack((zt @ (z * w[keep, None]), zt @ z), 1).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in sums], pa.int32()), pa.array([p for _, p in sums], pa.int32()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["held", "perms", "g"])

    sums = blocks.mapInArrow(grams, "held int, perms int, g array<double>").groupBy("held", "perms").agg(vector_to_array(Summarizer.sum(array_to_vector("g"))).alias("g"))

    fits = {(r["held"], r["perms"]): np.array(r["g"]).reshape(-1, 2, width, width) for r in sums.collect()}  # k * n of them
    table = {at: [(*_solve(pair, alpha)[:2], _label_sd(pair)) for pair in g] for at, g in fits.items()}

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for p, b in parts(batch):
                fold = b.column("fold").to_numpy()
                for held in (h for h in np.unique(fold).tolist() if (h, p) in table):
                    mine = b.take(pa.array(np.flatnonzero(fold == held)))
                    z, fit = design(mine, held)[:, :, 1:-1], table[held, p]
                    pred = np.array([cut for cut, _, _ in fit])[:, None] + (z @ np.array([raw for _, raw, _ in fit])[:, :, None])[:, :, 0]
                    prob = 1 / (1 + np.exp(-pred / np.array([sd for _, _, sd in fit])[:, None]))
                    up = np.tile(mine.column("up").to_numpy(zero_copy_only=False), len(fit))
                    for c, x in zip(cols, (np.repeat(p * CONTROL_PERMS + 1 + np.arange(len(fit)), len(mine)), up, pred.ravel(), prob.ravel()), strict=True):
                        c.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(cols, (pa.int64(), pa.bool_(), pa.float64(), pa.float64()), strict=True)], ["permutation", "up", "pred", "prob"])

    seen_ = checkpointed(blocks.mapInArrow(predict, "permutation long, up boolean, pred double, prob double").withColumn("y", F.col("up").cast("int")))
    right = seen_.groupBy("permutation").agg(F.avg(((F.col("pred") > 0) == F.col("up")).cast("double")).alias("sign_accuracy"))
    null = checkpointed(binary_metrics(seen_, "y", "prob", ["permutation"]).select("permutation", "auroc").join(right, "permutation"))
    seen = F.lit(float(observed))
    p = (1 + F.count_if(F.col("auroc") >= seen)) / (F.count("*") + 1)
    return null, null.agg(seen.alias("observed"), F.avg("auroc").alias("mean_permuted"), F.stddev_samp("auroc").alias("sd_permuted"), p.alias("empirical_p"), F.count("*").alias("n_permutations"))


def _vector(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumn("__x", array_to_vector(F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features))))


def cv_models(df: DataFrame, groups: dict[str, list[str]], y: str, id_cols: list[str] = ("gene",), k: int = 5, seed: int = 1, alpha: float = 10.0, trees: int = 50) -> DataFrame:
    """Out-of-fold metrics by model: the mean, a ridge on each feature group, a random forest on all features."""
    d = checkpointed(assign_folds(df.where(F.col(y).isNotNull()), list(id_cols), k, 1, seed))
    sums = d.groupBy("fold").agg(F.sum(y).alias("s"), F.count("*").alias("n"))
    rest = sums.crossJoin(F.broadcast(sums.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn")))).select("fold", ((F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n"))).alias("p"))
    parts = [d.join(rest, "fold").select(F.lit("mean").alias("model"), F.col(y).alias("y"), "p")]
    for name, features in groups.items():
        r, _ = weighted_ridge(df, features, y, None, alpha, id_cols, k, seed)
        parts.append(r.where(F.col(y).isNotNull()).select(F.lit(f"ridge_{name}").alias("model"), F.col(y).alias("y"), F.col("oof_pred").alias("p")))
    every = sorted({f for fs in groups.values() for f in fs})
    x = _vector(d, every)
    for fold in range(k):
        m = RandomForestRegressor(featuresCol="__x", labelCol=y, numTrees=trees, seed=seed, predictionCol="p").fit(x.where(F.col("fold") != fold))
        parts.append(m.transform(x.where(F.col("fold") == fold)).select(F.lit("random_forest").alias("model"), F.col(y).alias("y"), "p"))
    return regression_metrics(reduce(DataFrame.union, parts), "y", "p", ["model"])


def sensitivity_model(df: DataFrame, features: list[str], y: str, id_cols: list[str] = ("gene",), seed: int = 1, iterations: int = 50, shuffles: int = 10) -> tuple[DataFrame, DataFrame]:
    """Boosted trees on all labelled rows: predictions, and each feature's importance: mean and population deviation of the
    rise of the squared error over `shuffles` shuffles of its values, all made in one pass a feature."""
    d = checkpointed(_vector(df.where(F.col(y).isNotNull()), features))
    m = GBTRegressor(featuresCol="__x", labelCol=y, maxIter=iterations, seed=seed, predictionCol="pred").fit(d)
    error = F.avg(F.pow(F.col(y) - F.col("pred"), F.lit(2.0)))
    base, rows = m.transform(d).agg(error).first()[0], []
    for i, f in enumerate(features):
        moved = permute_labels(d.drop("__x"), list(id_cols), f, shuffles, seed + 1000 * i)
        rises = [x[1] - base for x in m.transform(_vector(moved, features)).groupBy("perm").agg(error).collect()]  # one row a shuffle
        rows.append((f, float(np.mean(rises)), float(np.std(rises))))
    return m.transform(d).drop("__x"), df.sparkSession.createDataFrame(rows, "feature string, importance_mean double, importance_std double")


def calibrate(df: DataFrame, score: str, y: str, sd: float | None = None, bins: int = 10) -> tuple[DataFrame, DataFrame]:
    """Adds p_raw (logistic of score over its scale), p_platt, p_isotonic and p_best; and the metrics of each, best first by
    brier, then ece, then auroc. `y` is 0 or 1, null where unknown."""
    sd = sd or df.agg(F.stddev_samp(score)).first()[0] or 1.0
    d = _vector(df, [score]).withColumn("p_raw", to_prob(F.col(score), float(sd)))
    known = d.where(F.col(y).isNotNull()).withColumn("__y", F.col(y).cast("double"))
    platt = LogisticRegression(featuresCol="__x", labelCol="__y", predictionCol="__pp", probabilityCol="__pr", rawPredictionCol="__rw").fit(known)
    iso = IsotonicRegression(featuresCol="__x", labelCol="__y", predictionCol="p_isotonic").fit(known)
    b, a = float(platt.coefficients[0]), float(platt.intercept)
    d = iso.transform(d).withColumn("p_platt", 1 / (1 + F.exp(-(F.lit(b) * F.col(score) + F.lit(a))))).drop("__x")
    names = ("p_raw", "p_platt", "p_isotonic")
    m = reduce(DataFrame.union, (binary_metrics(d, y, n, bins=bins).select(F.lit(n).alias("method"), "n", "n_pos", "auroc", "average_precision", "brier", "ece") for n in names)).orderBy("brier", "ece", F.desc("auroc"), "method")
    best = m.first()["method"]
    return d.withColumn("p_best", F.col(best)), m


def calibration_checks(df: DataFrame, score: str, y: str, p: str = "p_best", bins: int = 10) -> DataFrame:
    """For either class as the positive one: bins, mean predictions and observed rates, and how many rows share a probability."""
    turned = df.withColumns({"__y": 1 - F.col(y), "__p": 1 - F.col(p)})
    a = binned_curve(df.where(F.col(y).isNotNull()), p, y, bins).withColumn("positive", F.lit("risk"))
    b = binned_curve(turned.where(F.col(y).isNotNull()), "__p", "__y", bins).withColumn("positive", F.lit("protective"))
    return a.union(b)


def value_profile(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    """(column, value, n, fraction): rounded values and how often they occur."""
    long = df.select(*(F.col(c).cast("double") for c in cols)).unpivot([], cols, "column", "value").where("value is not null")
    g = long.groupBy("column", F.bround("value", digits).alias("value")).agg(F.count("*").alias("n"))
    return g.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy("column")))


def value_ranges(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    """Per column n, min, q01, q05, q25, median, q75, q95, q99, max and how many rounded values differ, over finite values."""
    qs = {"q01": 0.01, "q05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95, "q99": 0.99}
    long = df.select(*(F.col(c).cast("double") for c in cols)).unpivot([], cols, "column", "value").where("value is not null and not isnan(value) and abs(value) < double('infinity')")
    g = long.groupBy("column").agg(F.count("*").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.countDistinct(F.bround("value", digits)).alias("n_unique"))
    return g.join(quantiles(long, "value", qs, ["column"]), "column").select("column", "n", "min", *qs, "max", "n_unique")


def reciprocity(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Per method, from the probability of risk and that of protection fitted apart: how far the one is from one less the other."""
    delta = lambda a, b: F.abs(F.col(a) - (1 - F.col(b)))
    long = df.select(*(delta(a, b).alias(m) for m, (a, b) in pairs.items())).unpivot([], list(pairs), "method", "d").where("d is not null")
    q = quantiles(long, "d", {"median_abs_delta": 0.5, "q95_abs_delta": 0.95}, ["method"])
    g = long.groupBy("method").agg(
        F.count("*").alias("n"), F.avg("d").alias("mean_abs_delta"), F.max("d").alias("max_abs_delta"),
        F.count_if(F.col("d") > 0.05).alias("n_above_0p05"), F.count_if(F.col("d") > 0.10).alias("n_above_0p10"),
    )
    return g.join(q, "method").select("method", "n", "mean_abs_delta", "median_abs_delta", "q95_abs_delta", "max_abs_delta", "n_above_0p05", "n_above_0p10")


def support_tiers(df: DataFrame, q1: float = 0.9, q2: float = 0.75, source: str = "raw", seed_col: str = "is_seed", min_abs_raw_score_q: float | None = None) -> DataFrame:
    """Adds pred_direction, direction_confidence, rwr_direction, rwr_agree, brain_dhs_supported, variant_contribution_supported,
    tier_score, direction_confidence_percentile and support_tier.

    The direction is risk where calibrated_prob_risk is 0.5 or more, else protective. The score (raw, platt or calibrated)
    is taken for the predicted direction and ranked among the genes of that direction that aren't seeds. Both upper tiers
    need brain peaks: tier 1 also the walk's agreement, a relative contribution of 0.20 or more (if the column is there) and
    percentile q1; tier 2 percentile q2 with agreement, or q1. With `min_abs_raw_score_q` both also need that percentile of
    the score's size in the direction. Other genes are tier 3, seeds their own.
    """
    have = set(df.columns)
    seed = F.coalesce(F.col(seed_col), F.lit(False))
    protective = F.col("calibrated_prob_protective") if "calibrated_prob_protective" in have else 1 - F.col("calibrated_prob_risk")
    risk = F.coalesce(F.col("calibrated_prob_risk") >= 0.5, F.lit(False))
    dhs = F.lit(False)
    if "n_brain_or_neural_dhs_snvs" in have:
        dhs = dhs | (F.coalesce(F.col("n_brain_or_neural_dhs_snvs"), F.lit(0)) > 0)
    if "top_dhs_tissue" in have:
        dhs = dhs | F.coalesce(F.col("top_dhs_tissue").rlike("(?i)brain|neural|neuron|cns"), F.lit(False))
    strong = F.coalesce(F.col("top_relative_contribution"), F.lit(0.0)) >= 0.20 if "top_relative_contribution" in have else F.lit(True)
    other = F.col("platt_prob_protective") if "platt_prob_protective" in have else 1 - F.col("platt_prob_risk") if "platt_prob_risk" in have else None
    scores = {"raw": (F.col("raw_pred_beta_score"), -F.col("raw_pred_beta_score")), "calibrated": (F.col("calibrated_prob_risk"), protective)}
    if other is not None:
        scores["platt"] = (F.col("platt_prob_risk"), other)
    if source not in scores:
        raise ValueError(f"no score {source}")
    walk = F.when(F.coalesce(F.col("rwr_pred_beta"), F.lit(0.0)) > 0, "risk").otherwise("protective")
    d = df.withColumns({"pred_direction": F.when(risk, "risk").otherwise("protective"), "direction_confidence": F.greatest("calibrated_prob_risk", protective), "rwr_direction": walk, "brain_dhs_supported": dhs, "variant_contribution_supported": strong})
    d = d.withColumns({"rwr_agree": F.col("pred_direction") == F.col("rwr_direction"), "tier_score": F.when(F.col("pred_direction") == "risk", scores[source][0]).otherwise(scores[source][1])})
    new = avg_rank(d.where(~seed), "tier_score", ["pred_direction"], pct=True, name="direction_confidence_percentile")
    big = F.lit(True)
    if min_abs_raw_score_q is not None:
        new = avg_rank(new.withColumn("abs_raw_pred_beta_score", F.abs("raw_pred_beta_score")), "abs_raw_pred_beta_score", ["pred_direction"], pct=True, name="abs_raw_score_percentile")
        big = F.col("abs_raw_score_percentile") >= min_abs_raw_score_q
    pct = F.col("direction_confidence_percentile")
    tier1 = F.col("brain_dhs_supported") & F.col("rwr_agree") & F.col("variant_contribution_supported") & big & (pct >= q1)
    tier2 = F.col("brain_dhs_supported") & big & (pct >= q2) & (F.col("rwr_agree") | (pct >= q1))
    new = new.withColumn("support_tier", F.when(tier1, "Tier 1").when(tier2, "Tier 2").otherwise("Tier 3"))
    return new.unionByName(d.where(seed).withColumn("support_tier", F.lit("MR seed")), allowMissingColumns=True)


def tier_balance(df: DataFrame, seed_col: str = "is_seed") -> DataFrame:
    """Per tier of the genes that aren't seeds: risk and protective genes, total, fractions and their ratio."""
    side = lambda n: F.count_if(F.col("pred_direction") == n).alias(n)
    g = df.where(~F.coalesce(F.col(seed_col), F.lit(False))).groupBy("support_tier").agg(side("risk"), side("protective")).withColumn("total", F.col("risk") + F.col("protective"))
    return g.withColumns({"risk_fraction": F.try_divide("risk", "total"), "protective_fraction": F.try_divide("protective", "total"), "risk_to_protective_ratio": F.try_divide("risk", "protective")})


def label_stats(nodes: DataFrame, label: str = "beta") -> DataFrame:
    """Nodes with and without a label: count, mean degree, mean and deviation of the label."""
    return nodes.groupBy(F.col(label).isNotNull().alias("labelled")).agg(F.count("*").alias("n"), F.avg("degree").alias("mean_degree"), F.avg(label).alias("mean_label"), F.stddev_samp(label).alias("sd_label"))


def ensemble(df: DataFrame, cols: list[str], walk: str | None = None) -> DataFrame:
    """Adds over the model columns (missing ones count as 0) pred_beta_mean, _sd (population), _median, _q025, _q975 (linear
    between neighbours), prob_risk and prob_protective (shares of positive and negative ones), model_agreement (the larger),
    pred_direction and, with the walk's column, confidence_class."""
    n = len(cols)
    x = F.array_sort(F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols)))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)

    def quantile(q: float) -> Column:
        at = q * (n - 1)
        low = F.get("__x", int(at))
        return low + (F.get("__x", min(int(at) + 1, n - 1)) - low) * (at - int(at))

    d = df.withColumn("__x", x).withColumn("pred_beta_mean", total(F.col("__x")) / n)
    d = d.withColumns({
        "pred_beta_sd": F.sqrt(total(F.transform("__x", lambda v: (v - F.col("pred_beta_mean")) * (v - F.col("pred_beta_mean")))) / n), "pred_beta_median": quantile(0.5), "pred_beta_q025": quantile(0.025),
        "pred_beta_q975": quantile(0.975), "prob_risk": F.size(F.filter("__x", lambda v: v > 0)) / n, "prob_protective": F.size(F.filter("__x", lambda v: v < 0)) / n,
    }).drop("__x")
    up, down = (F.col("prob_risk") >= 0.8) & (F.col("pred_beta_q025") > 0), (F.col("prob_protective") >= 0.8) & (F.col("pred_beta_q975") < 0)
    d = d.withColumns({"model_agreement": F.greatest("prob_risk", "prob_protective"), "pred_direction": F.when(up, "risk").when(down, "protective").otherwise("ambiguous")})
    if walk is None:
        return d
    c = F.when(up & (F.col(walk) > 0), "high_confidence_risk").when(down & (F.col(walk) < 0), "high_confidence_protective")
    return d.withColumn("confidence_class", c.when(F.col("model_agreement") >= 0.7, "moderate_confidence").otherwise("ambiguous"))


def attach_top_contribution(pred: DataFrame, contrib: DataFrame, tissue: str = "brain", gene: str = "gene") -> DataFrame:
    """Predictions with their gene's largest contribution, one of the preferred tissue before any other."""
    top = best_per_key(contrib, [gene], [(F.lower("dhs_tissue") == tissue).desc_nulls_last(), F.abs("contribution").desc(), F.col("rsid")])
    return pred.join(top.select(gene, F.col("rsid").alias("top_rsid"), F.col("contribution").alias("top_contribution"), F.col("dhs_tissue").alias("top_tissue")), gene, "left")


def union_performance(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def normalize_predictions(df: DataFrame, candidates: dict[str, list[str]], gene: str = "gene") -> DataFrame:
    """Each output column from the first of its candidates that the table has (null if none); one row a gene, best rank first, then confidence."""
    from .contrib import coalesce_cols

    d = coalesce_cols(df, candidates)
    order = [c for c in (F.col("rank").asc_nulls_last() if "rank" in candidates else None, F.col("confidence").desc_nulls_last() if "confidence" in candidates else None) if c is not None]
    return best_per_key(d, [gene], [*order, *(F.col(c) for c in candidates)])
