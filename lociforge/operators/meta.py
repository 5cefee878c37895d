"""Catalogue cleaning, inverse-variance merging, label unions and Mendelian randomisation: sums in one grouped pass."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import allele_pair_ok, clean_null, is_snv, num, palindromic
from ..functions.tails import t_two_sided_p, two_sided_p
from .ordered import joined
from .select import best_per_key


def clean_qtl(df: DataFrame, label: str, p: float = 1e-5) -> DataFrame:
    """rsid, ea, oa, beta, se, pvalue, gene, type: rows with id, gene, effect and p, p below the bound, alleles in upper case."""
    d = df.select(
        clean_null(F.col("rsid")).alias("rsid"), F.upper("ea").alias("ea"), F.upper("oa").alias("oa"), num(F.col("beta")).alias("beta"),
        num(F.col("se")).alias("se"), num(F.col("pvalue")).alias("pvalue"), clean_null(F.col("gene")).alias("gene"), F.lit(label).alias("type"),
    )
    return d.where((F.col("pvalue") < p) & F.col("rsid").isNotNull() & F.col("gene").isNotNull() & F.col("beta").isNotNull())


def filter_assoc(df: DataFrame, max_p: float, af_lo: float | None = None, af_hi: float | None = None, snv_only: bool = False, strict: bool = False, p: str = "pval", af: str = "af_alt") -> DataFrame:
    """Associations by p, allele frequency (both bounds included, strict: the lower one not) and allele kind."""
    cond = F.col(p) < max_p if strict else F.col(p) <= max_p
    if af_lo is not None:
        cond = cond & (F.col(af) > af_lo if strict else F.col(af) >= af_lo)
    if af_hi is not None:
        cond = cond & (F.col(af) <= af_hi)
    return df.where(cond & is_snv(F.col("ref"), F.col("alt"))) if snv_only else df.where(cond)


def filter_peaks(df: DataFrame, components: list[str], min_signal: float = 0.0) -> DataFrame:
    return df.where(F.col("component").isin(*components) & (F.col("mean_signal") >= min_signal))


def map_values(df: DataFrame, col: str, names: dict[str, str], keep_unmapped: bool = False, to: str | None = None) -> DataFrame:
    """Values by a table of names; without one they go, or stay as they are."""
    m = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    out = df.withColumn(to or col, F.coalesce(F.try_element_at(m, F.col(col)), F.col(col)) if keep_unmapped else F.try_element_at(m, F.col(col)))
    return out if keep_unmapped else out.where(F.col(to or col).isNotNull())


def ivw_merge(df: DataFrame, keys: list[str], beta: str = "beta", se: str = "se", pvalue: str | None = None, max_p: float | None = None) -> DataFrame:
    """Fixed-effect merge by key: beta = sum(beta / se^2) / sum(1 / se^2), se = sqrt(1 / sum(1 / se^2)), p from the normal
    tail. A key of one row passes its own values through (its p too, if `pvalue` is given); rows without a positive se are left out."""
    d = df.where((F.col(se) > 0) & F.col(beta).isNotNull())
    w = 1 / (F.col(se) * F.col(se))
    g = d.groupBy(*keys).agg(F.count("*").alias("n_merged"), F.sum(F.col(beta) * w).alias("bw"), F.sum(w).alias("w"), F.min(beta).alias("b1"), F.min(se).alias("s1"), *([F.min(pvalue).alias("p1")] if pvalue else []))
    one = F.col("n_merged") == 1
    g = g.withColumns({"beta": F.when(one, F.col("b1")).otherwise(F.col("bw") / F.col("w")), "se": F.when(one, F.col("s1")).otherwise(F.sqrt(1 / F.col("w")))})
    p = two_sided_p(F.col("beta") / F.col("se"))
    g = g.withColumn("pvalue", F.when(one, F.col("p1")).otherwise(p) if pvalue else p)
    out = g.select(*keys, "beta", "se", "pvalue", "n_merged")
    return out if max_p is None else out.where(F.col("pvalue") < max_p)


def ivw_merge_guarded(df: DataFrame, keys: list[str], beta: str = "mr_beta", se: str = "mr_se", p: str = "mr_pvalue", method: str = "method_used") -> DataFrame:
    """As `ivw_merge`, for every key: without a usable row all values are null, one usable row is unchanged, and the method
    is the common one or IVW_merge."""
    ok = (F.col(se) > 0) & F.col(beta).isNotNull()
    w = F.when(ok, 1 / (F.col(se) * F.col(se)))
    g = df.groupBy(*keys).agg(
        F.count_if(ok).alias("n"), F.sum(F.col(beta) * w).alias("bw"), F.sum(w).alias("w"), F.max(F.when(ok, F.struct(beta, se, p))).alias("one"),
        F.min(F.when(ok, F.col(method))).alias("m1"), F.max(F.when(ok, F.col(method))).alias("m2"),
    )
    b, s = F.col("bw") / F.col("w"), F.sqrt(1 / F.col("w"))
    pick = lambda own, merged: F.when(F.col("n") == 1, own).when(F.col("n") > 1, merged)
    return g.select(
        *keys, pick(F.col("one")[beta], b).alias(beta), pick(F.col("one")[se], s).alias(se), pick(F.col("one")[p], two_sided_p(b / s)).alias(p),
        F.when(F.col("n") == 0, None).when(F.col("m1") == F.col("m2"), F.col("m1")).otherwise("IVW_merge").alias(method), F.col("n").alias("n_merged"),
    )


def merge_tissue_labels(df: DataFrame, tissues: tuple[str, str] = ("blood", "brain"), gene: str = "gene") -> DataFrame:
    """One row a gene with each tissue's beta, se, p and confidence, null where a tissue has none. The best p of a tissue counts."""
    a, b = tissues
    best = lambda t: F.min(F.when(F.col("tissue") == t, F.struct(F.col("pvalue"), F.col("beta"), F.col("se"), F.col("confidence"))))
    g = df.where(F.col("tissue").isin(a, b)).groupBy(gene).agg(best(a).alias("a"), best(b).alias("b"))
    return g.select(gene, *(F.col(k)[c].alias(f"{t}_{c}") for k, t in (("a", a), ("b", b)) for c in ("beta", "se", "pvalue", "confidence")))


def union_labels(df: DataFrame, policy: str = "exclude", tissues: tuple[str, str] = ("blood", "brain"), gene: str = "gene") -> DataFrame:
    """One label a gene: one tissue as it is; two of one sign merged by inverse variance with the sum of confidences; two of
    different signs no label (exclude), or the one of the smaller p (maxconf)."""
    m = merge_tissue_labels(df, tissues, gene)
    a, b = tissues
    c = lambda t, x: F.col(f"{t}_{x}")
    both = c(a, "beta").isNotNull() & c(b, "beta").isNotNull()
    agree = c(a, "beta") * c(b, "beta") > 0
    wa, wb = (F.try_divide(F.lit(1.0), c(t, "se") * c(t, "se")) for t in (a, b))
    merged = F.try_divide(c(a, "beta") * wa + c(b, "beta") * wb, wa + wb)
    stronger = lambda x: F.when(c(a, "pvalue") <= c(b, "pvalue"), c(a, x)).otherwise(c(b, x))
    clash = (lambda x: stronger(x)) if policy == "maxconf" else (lambda x: F.lit(None).cast("double"))
    beta = F.when(both & agree, merged).when(both, clash("beta")).otherwise(F.coalesce(c(a, "beta"), c(b, "beta")))
    conf = F.when(both & agree, c(a, "confidence") + c(b, "confidence")).when(both, clash("confidence")).otherwise(F.coalesce(c(a, "confidence"), c(b, "confidence")))
    status = F.when(both & agree, "concordant").when(both, "discordant").when(c(a, "beta").isNotNull(), a).otherwise(b)
    return m.select(gene, beta.alias("beta"), conf.alias("confidence"), status.alias("status"))


def collapse_genes(df: DataFrame, policy: str = "strongest_p", gene: str = "gene", beta: str = "beta", p: str = "pvalue") -> DataFrame:
    """One row a gene, with conflict (both signs occur) and reason. Policies: strongest_p, largest_abs_beta, exclude (conflicting genes go).

    Tasks combine each gene's first value of the order, counts and signs; only rows that have that value are sorted."""
    if policy not in ("strongest_p", "largest_abs_beta", "exclude"):
        raise ValueError(f"unknown policy {policy}")
    size, largest = F.abs(F.col(beta)), policy == "largest_abs_beta"
    lead, first = (size, F.max(size)) if largest else (F.col(p), F.when(F.count_if(F.col(p).isNull()) == 0, F.min(p)))  # nulls come last, and first
    g = df.groupBy(gene).agg(F.count("*").alias("n_rows"), (F.min(F.signum(beta)) * F.max(F.signum(beta)) < 0).alias("conflict"), first.alias("__lead"))
    g = g.where(~F.col("conflict")) if policy == "exclude" else g
    d = joined(df, g.hint("shuffle_hash"), [gene]).where(lead.eqNullSafe(F.col("__lead"))).drop("__lead")
    out = best_per_key(d, [gene], [*([size.desc(), F.col(p)] if largest else [F.col(p), size.desc()]), F.col(beta)])
    return out.withColumn("reason", F.when(F.col("n_rows") == 1, "single").when(F.col("conflict"), policy).otherwise("concordant"))


def captured_counts(sc: DataFrame, bulk: DataFrame, by: str = "cell_type", gene: str = "gene") -> DataFrame:
    """Genes of each cell type, and how many of them the bulk table has too."""
    b = bulk.select(gene).distinct().withColumn("hit", F.lit(1))
    d = sc.select(by, gene).distinct().join(b, gene, "left")
    return d.groupBy(by).agg(F.count("*").alias("n_genes"), F.count("hit").alias("n_captured"), (F.count("hit") / F.count("*")).alias("fraction"))


def retention(df: DataFrame, source: str, kept: Column) -> DataFrame:
    g = df.groupBy(source).agg(F.count("*").alias("n_raw"), F.count_if(kept).alias("n_kept"))
    return g.withColumn("percent", 100 * F.try_divide("n_kept", "n_raw"))


def gene_context_summary(df: DataFrame, gene: str = "gene", context: str = "context", top: int = 30) -> DataFrame:
    """Genes over contexts: each (gene, context) is merged by inverse variance, then each gene over its contexts, with the
    number of contexts, of positive and negative ones, and consistency; the first `top` of each direction by |beta / se|, which goes on where p is 0. It counts to nine places, so
    that genes of equal rows, summed in another order, are in the order of their names."""
    per = ivw_merge(df, [gene, context])
    n = per.groupBy(gene).agg(F.count("*").alias("n_contexts"), F.count_if(F.col("beta") > 0).alias("n_pos"), F.count_if(F.col("beta") < 0).alias("n_neg"))
    m = ivw_merge(per, [gene]).drop("n_merged").join(n, gene)
    m = m.withColumns({"consistent": F.least("n_pos", "n_neg") == 0, "direction": F.when(F.col("beta") > 0, "risk").otherwise("protective")})
    z = F.round(F.abs(F.col("beta") / F.col("se")), 9)
    rn = F.row_number().over(Window.partitionBy("direction").orderBy(z.desc_nulls_last(), gene))
    return m.withColumn("rank", rn).where(F.col("rank") <= top)


def read_mr_side(df: DataFrame, side: str, label: str) -> DataFrame:
    """The columns of one side of a Mendelian-randomisation join; allele frequency null where the source has none."""
    eaf = F.col("eaf").cast("double") if "eaf" in df.columns else F.lit(None).cast("double")
    gene = [F.col("gene")] if side == "exposure" else []
    return df.select(
        F.col("SNP").alias("snp"), *gene, F.upper("effect_allele").alias(f"ea_{side}"), F.upper("other_allele").alias(f"oa_{side}"), num(F.col("beta")).alias(f"beta_{side}"),
        num(F.col("se")).alias(f"se_{side}"), num(F.col("pval")).alias(f"pval_{side}"), eaf.alias(f"eaf_{side}"), F.lit(label).alias(f"id_{side}"),
    )


def mr_join(exposure: DataFrame, outcome: DataFrame) -> DataFrame:
    """Both sides by SNP with the same pair of single-base alleles, all genes at once."""
    ok = allele_pair_ok(F.col("ea_exposure"), F.col("oa_exposure"), F.col("ea_outcome"), F.col("oa_outcome"))
    return exposure.join(outcome, "snp").where(ok).distinct()


def mr_harmonise(df: DataFrame, ambiguous: float = 0.08) -> DataFrame:
    """The outcome's effect for the exposure's effect allele. Palindromic pairs are settled by allele frequencies, and
    dropped where one is missing or within `ambiguous` of a half."""
    same = F.col("ea_exposure") == F.col("ea_outcome")
    crossed = (F.col("ea_exposure") == F.col("oa_outcome")) & (F.col("oa_exposure") == F.col("ea_outcome"))
    pal = palindromic(F.col("ea_exposure"), F.col("oa_exposure"))
    clear = (F.abs(F.col("eaf_exposure") - 0.5) > ambiguous) & (F.abs(F.col("eaf_outcome") - 0.5) > ambiguous)
    outcome_eaf = F.when(same, F.col("eaf_outcome")).otherwise(1 - F.col("eaf_outcome"))
    agree = (F.col("eaf_exposure") - 0.5) * (outcome_eaf - 0.5) > 0
    sign = F.when(~pal, F.when(same, 1).when(crossed, -1)).otherwise(F.when(clear, F.when(same == agree, 1).otherwise(-1)))
    return df.withColumn("__sign", sign).where("__sign is not null").withColumn("beta_outcome", F.col("beta_outcome") * F.col("__sign")).drop("__sign")


def mr_estimate(df: DataFrame, keys: list[str] = ("gene",), boot: int = 1000, seed: int = 1) -> DataFrame:
    """(keys, nsnp, method, single_snp, b, se, pval) from harmonised rows: one SNP: Wald ratio; two: inverse variance and
    each SNP's ratio; three or more: inverse variance, Egger and weighted median.

    Inverse variance is the weighted regression through the origin with weights 1 / se_outcome^2 and a standard error
    of at least the fixed-effect one; Egger has an intercept, with exposure effects made positive. The weighted median's
    error comes from `boot` parametric resamples with normal draws, made from one row a gene that packs its instruments.
    """
    keys = list(keys)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, since resamples take longer than their rows' size tells
    d = df.where("beta_exposure <> 0 and se_outcome > 0").repartition(n, *keys).withColumns({"bx": F.abs("beta_exposure"), "by": F.col("beta_outcome") * F.signum("beta_exposure"), "so": F.col("se_outcome"), "sx": F.col("se_exposure")})
    d = d.withColumns({"w": 1 / (F.col("so") * F.col("so")), "nsnp": F.count("*").over(Window.partitionBy(*keys))})
    b, s = F.col("by") / F.col("bx"), F.col("so") / F.col("bx")
    none = F.lit(None).cast("string")
    wald = d.where("nsnp <= 2").select(*keys, "nsnp", F.lit("Wald ratio").alias("method"), F.when(F.col("nsnp") == 2, F.col("snp")).alias("single_snp"), b.alias("b"), s.alias("se"), two_sided_p(b / s).alias("pval"))
    m = d.where("nsnp >= 2").groupBy(*keys).agg(*(F.sum(e).alias(n) for n, e in {"n": F.lit(1), "sw": F.col("w"), "sx1": F.col("w") * F.col("bx"), "sy": F.col("w") * F.col("by"), "sxx": F.col("w") * F.col("bx") * F.col("bx"), "sxy": F.col("w") * F.col("bx") * F.col("by"), "syy": F.col("w") * F.col("by") * F.col("by")}.items()))
    beta = F.col("sxy") / F.col("sxx")
    rss = F.greatest(F.lit(0.0), F.col("syy") - beta * F.col("sxy"))
    se = F.sqrt(1 / F.col("sxx")) * F.greatest(F.lit(1.0), F.sqrt(rss / (F.col("n") - 1)))
    ivw = m.select(*keys, F.col("n").alias("nsnp"), F.lit("Inverse variance weighted").alias("method"), none.alias("single_snp"), beta.alias("b"), se.alias("se"), two_sided_p(beta / se).alias("pval"))
    det = F.col("sw") * F.col("sxx") - F.col("sx1") * F.col("sx1")
    slope = F.try_divide(F.col("sw") * F.col("sxy") - F.col("sx1") * F.col("sy"), det)
    cut = F.try_divide(F.col("sy") - slope * F.col("sx1"), F.col("sw"))
    rss = F.greatest(F.lit(0.0), F.col("syy") - cut * F.col("sy") - slope * F.col("sxy"))
    se = F.sqrt(F.try_divide(F.col("sw"), det)) * F.greatest(F.lit(1.0), F.sqrt(rss / (F.col("n") - 2)))
    egger = m.where("n >= 3").select(*keys, F.col("n").alias("nsnp"), F.lit("MR Egger").alias("method"), none.alias("single_snp"), slope.alias("b"), se.alias("se"), t_two_sided_p(slope / se, F.col("n") - 2.0).alias("pval"))

    many = d.where("nsnp >= 3")
    packed = many.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("snp", "bx", "by", F.coalesce("sx", F.lit(0.0)).alias("sx"), "so"))).alias("x"))  # the instruments of one gene
    packed = packed.withColumn("key", F.xxhash64(*keys, F.lit(seed)))

    @F.pandas_udf("b double, se double")
    def median_of(key: pd.Series, bx: pd.Series, by: pd.Series, sx: pd.Series, so: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([weighted_median_se(*(np.asarray(c, float) for c in x), boot, int(k)) for k, *x in zip(key, bx, by, sx, so, strict=True)], columns=["b", "se"])

    found = packed.select(*keys, F.size("x").cast("long").alias("nsnp"), median_of("key", *(F.col(f"x.{c}") for c in ("bx", "by", "sx", "so"))).alias("m"))
    median = found.select(*keys, "nsnp", F.lit("Weighted median").alias("method"), none.alias("single_snp"), "m.b", "m.se", two_sided_p(F.try_divide("m.b", "m.se")).alias("pval"))
    return wald.unionByName(ivw).unionByName(egger).unionByName(median)


def weighted_medians(ratio: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each row of ratios their median by weight, linear between the midpoints of the cumulative weights; equal ratios in
    the order given. Of many long rows, only what lies about the medians of the first 32 is sorted, behind the weight of what
    lies below; rows whose median isn't there are sorted whole."""
    n, m = ratio.shape
    if n < 96 or m < 64:
        return _medians(ratio, weight, 0.0, weight.sum())[0]
    out, total = np.empty(n), weight.sum()
    out[:32] = _medians(ratio[:32], weight, 0.0, total)[0]
    mid, reach = np.median(out[:32]), 3.5 * out[:32].std()
    rest = ratio[32:]
    under = rest <= mid - reach
    inside = (rest <= mid + reach) & ~under
    count = inside.sum(1)
    row, col = np.nonzero(inside)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    r, w = np.full((n - 32, max(2, count.max())), np.inf), np.zeros((n - 32, max(2, count.max())))
    r[row, place], w[row, place] = rest[row, col], weight[col]
    out[32:], high = _medians(r, w, (under @ weight)[:, None], total)
    whole = 32 + np.flatnonzero((high < 1) | (high >= count))
    if len(whole):
        out[whole] = _medians(ratio[whole], weight, 0.0, total)[0]
    return out


def _medians(ratio: np.ndarray, weight: np.ndarray, below: np.ndarray | float, total: float) -> tuple[np.ndarray, np.ndarray]:
    """`weighted_medians` of rows behind a weight below them, and how many midpoints of each lie under a half."""
    order = np.argsort(ratio, axis=1, kind="stable")
    r, w = np.take_along_axis(ratio, order, 1), weight[order] if weight.ndim == 1 else np.take_along_axis(weight, order, 1)
    at = (below + np.cumsum(w, 1) - w / 2) / total
    first = (at < 0.5).sum(1)
    high = np.minimum(first, at.shape[1] - 1)
    low, i = np.maximum(high - 1, 0), np.arange(len(r))
    with np.errstate(invalid="ignore"):  # rows without their median in them
        share = np.where(at[i, high] > at[i, low], (0.5 - at[i, low]) / np.where(at[i, high] > at[i, low], at[i, high] - at[i, low], 1), 0.0)
        return np.where((high == low) | (at[i, high] < 0.5), r[i, high], r[i, low] + np.clip(share, 0, 1) * (r[i, high] - r[i, low])), first


def weighted_median_se(bx: np.ndarray, by: np.ndarray, sx: np.ndarray, so: np.ndarray, boot: int, key: int, block: int = 1 << 20) -> tuple[float, float | None]:
    """The weighted median ratio of a gene's instruments, weights bx^2 / so^2, and the deviation of `boot` parametric
    resamples: normal effects around the observed ones, with the observed weights. Resamples are made a block at a time."""
    weight, rng = bx * bx / (so * so), np.random.default_rng(key & 0xFFFFFFFFFFFFFFFF)
    point = float(weighted_medians((by / bx)[None, :], weight)[0])
    step, drawn = max(1, block // len(bx)), []
    for at in range(0, boot, step):
        n = (min(step, boot - at), len(bx))
        ratio, under = rng.standard_normal(n), rng.standard_normal(n)
        ratio *= so
        ratio += by
        under *= sx
        under += bx
        ratio /= under
        drawn.append(weighted_medians(ratio, weight))
    drawn = np.concatenate(drawn) if drawn else np.empty(0)
    return point, float(drawn.std(ddof=1)) if len(drawn) > 1 else None
