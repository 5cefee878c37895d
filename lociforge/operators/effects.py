"""Variant effects: track reductions, gene features, link rollups and scores."""

from __future__ import annotations

import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import exact_sum, neg_log10, reduced_tracks
from .quantiles import quantiles
from .select import unique_rank


def reduce_tracks(df: DataFrame, d: str = "d", scale: float = 1.0) -> DataFrame:
    return df.withColumns(reduced_tracks(F.col(d), scale))


def gwas_weight(df: DataFrame, p: str = "gwas_pval", r2: str = "r2", cap_q: float = 0.99, name: str = "weight") -> DataFrame:
    """r2 * -log10(p): p of 0 counts as the smallest positive one, weights are cut at the quantile of the positive ones."""
    least = df.agg(F.min(F.when(F.col(p) > 0, F.col(p))).alias("__least"))
    d = df.crossJoin(F.broadcast(least))  # one row
    d = d.withColumn(name, F.col(r2) * neg_log10(F.col(p), F.coalesce("__least", F.lit(1e-300)))).drop("__least")
    cap = quantiles(d.where(F.col(name) > 0), name, {"__cap": cap_q}).agg(F.max("__cap").alias("__cap"))  # one row, also without a weight
    return d.crossJoin(F.broadcast(cap)).withColumn(name, F.least(name, F.coalesce("__cap", name))).drop("__cap")


def scale_confidence(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """Scaled to a mean of 1 over the positive values."""
    mean = df.where(F.col(col) > 0).agg(F.avg(col).alias("__mean"))
    return df.crossJoin(F.broadcast(mean)).withColumn(name or col, F.try_divide(F.col(col), F.col("__mean"))).drop("__mean")


def robust_z(df: DataFrame, col: str, name: str = "robust_z") -> DataFrame:
    """(x - median) / MAD; null where the MAD is 0. Both medians are selected by ranges."""
    med = quantiles(df, col, {"__med": 0.5}).agg(F.max("__med").alias("__med"))  # one row, also without a value
    d = df.crossJoin(F.broadcast(med))
    mad = quantiles(d.select(F.abs(F.col(col) - F.col("__med")).alias("__off")), "__off", {"__mad": 0.5}).agg(F.max("__mad").alias("__mad"))
    d = d.crossJoin(F.broadcast(mad))
    return d.withColumn(name, F.try_divide(F.col(col) - F.col("__med"), F.nullif(F.col("__mad"), F.lit(0.0)))).drop("__med", "__mad")


def link_rollup(df: DataFrame, key: str = "reg_rsid") -> DataFrame:
    """Links by regulatory variant: largest |beta|, least se and p, largest |r|, r2 and weight, distinct loci."""
    return df.groupBy(key).agg(
        F.max(F.abs("gwas_beta")).alias("max_abs_beta"), F.min("gwas_se").alias("min_se"), F.min("gwas_pval").alias("min_pval"),
        F.max(F.abs("r")).alias("max_abs_r"), F.max("r2").alias("max_r2"), F.max("weight").alias("max_weight"), F.countDistinct("gwas_rsid").alias("n_loci"),
    )


def gene_blocks(deltas: DataFrame, ann: DataFrame, key: str = "rsid", gene: str = "gene", d: str = "d", active: float = 1e-8) -> DataFrame:
    """Features of each gene over its linked and its background variants, one row a (gene, linked).

    `ann` has per variant: linked, weight, locus (the GWAS variant), r2, gwas_beta, gwas_pval, dhs and af_alt, null where it
    has none; a variant that isn't there is background. Scalars are plain aggregates over rows and tracks; the signed,
    absolute, weighted signed and weighted absolute sums of tracks are vector sums in the same grouped pass. Means divide by
    rows, weighted ones by the sum of weights; a track is active where its absolute sum is above `active`.
    """
    a = ann.select(key, "linked", "weight", "locus", "r2", "gwas_beta", "gwas_pval", "dhs", "af_alt")
    x = deltas.join(a, key, "left").withColumns({"linked": F.coalesce("linked", F.lit(False)), "weight": F.coalesce(F.col("weight").cast("double"), F.lit(0.0))})
    x = x.withColumn("weight", F.when(F.col("linked"), F.col("weight")).otherwise(0.0)).withColumn("__d", F.transform(d, lambda v: v.cast("double"))).withColumn("__a", F.transform("__d", lambda v: F.abs(v)))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    vector = lambda c, w=None: vector_to_array(Summarizer.sum(array_to_vector(F.transform(c, lambda v: v * F.col(w)) if w else F.col(c))))
    x = x.withColumns({"__s": total(F.col("__d")), "__sa": total(F.col("__a")), "__ss": total(F.transform("__d", lambda v: v * v)), "__mx": F.array_max("__a"), "__n": F.size(d)})
    # Apart from the vector sums, since several distinct counts repeat the rows with nulls in the other columns.
    kinds = x.groupBy(gene, "linked").agg(F.countDistinct(key).alias("n_snvs"), F.countDistinct("dhs").alias("n_dhs"), F.countDistinct("locus").alias("n_loci"))
    g = x.groupBy(gene, "linked").agg(
        F.count("*").alias("n_rows"), F.sum("__sa").alias("sum_abs"), F.sum("__ss").alias("__sq"), F.sum("__s").alias("__sum"), F.max("__mx").alias("max_abs"), F.sum("__n").alias("__cells"),
        F.max("r2").alias("max_r2"), F.max(F.abs("gwas_beta")).alias("max_abs_gwas_beta"), F.min("gwas_pval").alias("min_gwas_pval"), F.max("weight").alias("max_weight"), F.sum("weight").alias("sum_weight"),
        F.avg("af_alt").alias("mean_af"), F.min("af_alt").alias("min_af"), F.max("af_alt").alias("max_af"),
        vector("__d").alias("signed_sum"), vector("__a").alias("abs_sum"), vector("__d", "weight").alias("weighted_signed_sum"), vector("__a", "weight").alias("weighted_abs_sum"),
    ).join(kinds, [gene, "linked"])
    cells = F.greatest("__cells", F.lit(1))
    mean = F.col("sum_abs") / cells
    per = lambda c, by, name: F.transform(c, lambda v: v / F.greatest(by, F.lit(1e-12))).alias(name)
    return g.select(
        gene, "linked", "n_rows", "n_snvs", "n_dhs", mean.alias("mean_abs"), "sum_abs", "max_abs", (F.col("__sum") / cells).alias("mean_signed"), F.sqrt(F.greatest(F.col("__sq") / cells - mean * mean, F.lit(0.0))).alias("std_abs"),
        F.size(F.filter("abs_sum", lambda v: v > active)).alias("active_tracks"), "n_loci", "max_r2", "max_abs_gwas_beta", "min_gwas_pval", "max_weight", (F.col("sum_weight") / F.col("n_rows")).alias("mean_weight"), "mean_af", "min_af", "max_af",
        per("signed_sum", F.col("n_rows").cast("double"), "signed_mean"), per("abs_sum", F.col("n_rows").cast("double"), "abs_mean"), per("weighted_signed_sum", F.col("sum_weight"), "weighted_signed_mean"), per("weighted_abs_sum", F.col("sum_weight"), "weighted_abs_mean"),
    )


def gene_contrasts(blocks: DataFrame, gene: str = "gene", eps: float = 1e-12) -> DataFrame:
    """One row a gene: both blocks' scalars side by side (0 where a gene has none), the linked share of absolute sums and of
    variants, the ratio of means, and the specificity score: the difference of log(1 + absolute sum)."""
    cols = ("n_rows", "n_snvs", "sum_abs", "mean_abs", "max_abs", "active_tracks")
    side = {True: "linked", False: "background"}
    g = blocks.groupBy(gene).agg(*(F.coalesce(F.max(F.when(F.col("linked") == k, F.col(c))), F.lit(0)).alias(f"{n}_{c}") for k, n in side.items() for c in cols))
    part = lambda c: F.col(f"linked_{c}") / (F.col(f"linked_{c}") + F.col(f"background_{c}") + eps)
    return g.withColumns({
        "linked_fraction_abs": part("sum_abs"), "linked_background_abs_ratio": F.col("linked_mean_abs") / (F.col("background_mean_abs") + eps),
        "linked_specificity_score": F.log1p("linked_sum_abs") - F.log1p("background_sum_abs"), "linked_variant_fraction": part("n_snvs"),
    })


def dhs_tissue_summary(deltas: DataFrame, reg: DataFrame, blood: list[str], brain: list[str], key: str = "rsid", gene: str = "gene", value: str = "sumabs_d") -> DataFrame:
    """Per gene the distinct variants and strengths in blood, brain and other peaks, and the strongest of the three."""
    t = F.lower("dhs_tissue")
    bucket = F.when(t.isin(*map(str.lower, blood)), "blood").when(t.isin(*map(str.lower, brain)), "brain").otherwise("other")
    x = deltas.join(reg.select(key, bucket.alias("bucket")).distinct(), key)
    names = ("blood", "brain", "other")
    aggs = [F.countDistinct(F.when(F.col("bucket") == n, F.col(key))).alias(f"n_{n}") for n in names]
    aggs += [F.coalesce(exact_sum(F.when(F.col("bucket") == n, F.col(value))), F.lit(0.0)).alias(f"strength_{n}") for n in names]
    top = F.greatest(*(f"strength_{n}" for n in names))
    g = x.groupBy(gene).agg(*aggs)
    label = F.when(top <= 0, None)
    for n in names:
        label = label.when(F.col(f"strength_{n}") == top, n)
    return g.withColumn("dominant", label)


def gene_scores(df: DataFrame, gene: str = "gene", gwas: str = "gwas_rsid", z_gwas: str = "gwas_z", z_effect: str = "effect_z") -> DataFrame:
    """Per (gene, GWAS variant) its |z| times the sum of |effect z|; per gene the mean of these, counts and rank."""
    per = df.groupBy(gene, gwas).agg(F.max(F.abs(z_gwas)).alias("z"), F.sum(F.abs(z_effect)).alias("effect"), F.count("*").alias("n_variants"))
    g = per.withColumn("score", F.col("z") * F.col("effect")).groupBy(gene).agg(F.avg("score").alias("score"), F.count("*").alias("n_gwas"), F.sum("n_variants").alias("n_variants"))
    return unique_rank(g, "score", [], [gene])


def selection_stats(df: DataFrame, keys: list[str], item: str) -> DataFrame:
    """metric, value: distinct keys and items, mean, median, least and most items of a key, and keys with more than one."""
    n = df.groupBy(*keys).agg(F.countDistinct(item).alias("n"))
    g = n.agg(F.count("*").alias("keys"), F.avg("n").alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"), F.count_if(F.col("n") > 1).alias("violations"))
    g = g.crossJoin(F.broadcast(quantiles(n, "n", {"median": 0.5}).agg(F.max("median").alias("median"))))
    g = g.crossJoin(F.broadcast(df.agg(F.countDistinct(item).alias("items"), F.count("*").alias("rows"))))
    return g.select(*(F.col(c).cast("double") for c in g.columns)).unpivot([], g.columns, "metric", "value")


def pca(df: DataFrame, vec: str, k: int = 32, scale: bool = False) -> DataFrame:
    """Adds pcs (array) and explained (array, shares of the variance): principal components of centred (and scaled) vectors,
    the sign such that the largest loading is positive.

    Tasks sum products of whole batches, and their sums are added up in bands of rows of the matrix, so one pass over the
    vectors gives counts, means and covariance; what comes to the driver is a square of the columns (tracks, a few thousand
    at most), whatever rows there are. Loadings go back as arrays. Null vectors and null components count as 0 in the sums
    and get components like any other; without rows or columns the arrays are empty.
    """
    import numpy as np
    import pyarrow as pa

    x = F.transform(F.coalesce(F.col(vec), F.array().cast("array<double>")), lambda v: F.coalesce(v.cast("double"), F.lit(0.0)))
    width = df.agg(F.max(F.size(vec)).alias("w")).first()["w"] or 0
    if width <= 0:
        return df.withColumns({"pcs": F.array().cast("array<double>"), "explained": F.array().cast("array<double>")})

    def table(vectors) -> np.ndarray:
        flat, ends = vectors.flatten().to_numpy(zero_copy_only=False), np.diff(vectors.offsets.to_numpy())
        if (ends == width).all():
            return flat.reshape(-1, width)
        out = np.zeros((len(ends), width))
        out[np.repeat(np.arange(len(ends)), ends), np.concatenate([np.arange(n) for n in ends]) if len(ends) else []] = flat
        return out

    def sums(batches):
        total = np.zeros((width + 1, width + 1))
        for b in batches:
            m = np.column_stack((np.ones(b.num_rows), table(b.column(0))))
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width + 1)), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "row"])

    made = df.select(x.alias("x")).mapInArrow(sums, "i long, row array<double>").groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row"))
    gram = np.zeros((width + 1, width + 1))
    for r in made.collect():  # a row a column
        gram[r["i"]] = r["row"]
    n = gram[0, 0]
    mean = gram[0, 1:] / n
    cov = gram[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0) * n / max(1.0, n - 1))
    inv = np.where(sd > 0, 1 / np.where(sd > 0, sd, 1), 0.0) if scale else np.ones(width)
    value, load = np.linalg.eigh(cov * np.outer(inv, inv))
    k = min(k, width)
    value, load = np.maximum(value[::-1], 0), load[:, ::-1][:, :k]
    load = load * np.sign(load[np.abs(load).argmax(0), np.arange(k)])
    explained = (value[:k] / value.sum() if value.sum() > 0 else np.zeros(k)).tolist()
    sent = df.sparkSession.sparkContext.broadcast((mean, inv[:, None] * load))  # columns times k

    @F.pandas_udf("array<double>")
    def project(v: pd.Series) -> pd.Series:
        centre, back = sent.value
        m = np.zeros((len(v), width))
        for i, y in enumerate(v):
            m[i, : len(y)] = y
        return pd.Series(list((m - centre) @ back))

    return df.withColumns({"pcs": project(x), "explained": F.array(*map(F.lit, explained))})
