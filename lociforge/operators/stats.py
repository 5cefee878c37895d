"""Tests, false discovery control, enrichment and metrics as grouped operators."""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tails import chi2_tail, t_two_sided_p, two_sided_p
from .ordered import joined, least_from_here, value_totals
from .resample import resampled_auroc, resampled_medians
from .select import avg_rank
from .shared import checkpointed


def _ranks(df: DataFrame, keys: list[str], value: str, adds: dict[str, Column]) -> DataFrame:
    """`value_totals` with __n, the rows of a value, and __r, their average rank."""
    t = value_totals(df, keys, value, {"__n": F.count("*"), **adds})
    return t.withColumn("__r", F.col("__n_upto") - (F.col("__n") - 1) / 2.0)


def _ties() -> Column:
    n = F.col("__n").cast("double")
    return F.sum(n * n * n - n)


def rank_sums(df: DataFrame, keys: list[str], group: str, value: str, case: str = "case", control: str = "control") -> DataFrame:
    """Per key: n1, n2, rank sum and U of the cases, tie term, medians. All are taken from counts of the different values."""
    keys = list(keys)
    sides = df.where(F.col(group).isin(case, control))
    t = _ranks(sides, keys, value, {"__x": F.count_if(F.col(group) == case)})
    t = t.withColumns({f"__y{e}": F.col(f"__n{e}") - F.col(f"__x{e}") for e in ("", "_upto", "_all")})

    def middle(c: str) -> Column:
        """Half the sum of the ranks at the two middle places of a side."""
        at = lambda place: F.min(F.when(F.col(f"{c}_upto") >= place, F.col("__r")))
        return F.when(F.max(f"{c}_all") > 0, (at(F.floor((F.col(f"{c}_all") + 1) / 2)) + at(F.floor(F.col(f"{c}_all") / 2) + 1)) / 2.0)

    g = t.groupBy(*keys).agg(
        F.sum("__x").alias("n1"), F.sum("__y").alias("n2"), F.sum(F.when(F.col("__x") > 0, F.col("__r") * F.col("__x"))).alias("r1"), _ties().alias("ties"),
        middle("__x").alias("median_rank_case"), middle("__y").alias("median_rank_control"),
    )
    return g.withColumn("u", F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2.0)


def _exact_u(n1: int, n2: int, u: float) -> float:
    """Two-sided p of U without ties. How many rank subsets have each U are the coefficients of the product over i up to n1 of
    (1 - q^(n2 + i)) / (1 - q^i); only those of the smaller tail are made."""
    n1, n2 = sorted((n1, n2))
    low = int(min(u, n1 * n2 - u))
    c = np.zeros(low + 1)
    c[0] = 1
    for i in range(1, n1 + 1):
        steps = np.pad(c, (0, -len(c) % i)).reshape(-1, i)
        c = np.cumsum(steps, 0).ravel()[: low + 1]
        if n2 + i <= low:
            c[n2 + i :] -= c[: low + 1 - n2 - i].copy()
    return float(min(1.0, 2 * c.sum() / comb(n1 + n2, n1)))


def mann_whitney(df: DataFrame, keys: list[str], group: str, value: str, case: str = "case", control: str = "control", exact_up_to: int = 8) -> DataFrame:
    """Two-sided U test by key: n1, n2, u, p, rank_biserial, median ranks. The normal form has tie and continuity
    corrections; groups without ties whose smaller side has at most `exact_up_to` rows get the exact p, however many rows
    the other side has. Keys with an empty side have a null p."""
    g = rank_sums(df, keys, group, value, case, control)
    n1, n2, n = F.col("n1"), F.col("n2"), F.col("n1") + F.col("n2")
    mean = n1 * n2 / 2.0
    sd = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1))))
    z = F.try_divide(F.greatest(F.lit(0.0), F.abs(F.col("u") - mean) - 0.5), F.nullif(sd, F.lit(0.0)))
    both = (n1 > 0) & (n2 > 0)
    g = g.withColumns({"p": F.when(both, F.coalesce(F.least(F.lit(1.0), two_sided_p(z)), F.lit(1.0))), "rank_biserial": F.when(both, F.try_divide(2.0 * F.col("u"), n1 * n2) - 1)})

    @F.pandas_udf("double")
    def exact(n1: pd.Series, n2: pd.Series, u: pd.Series) -> pd.Series:
        return pd.Series([_exact_u(int(a), int(b), c) for a, b, c in zip(n1, n2, u, strict=True)])

    small = both & (F.least(n1, n2) <= exact_up_to) & (F.col("ties") == 0)
    few = g.where(small).withColumn("p", exact("n1", "n2", "u"))  # one row a key, only where it applies
    return g.where(~small | small.isNull()).unionByName(few).drop("r1", "ties")


def rank_sum(df: DataFrame, keys: list[str], group: str, value: str, case: str = "case", control: str = "control") -> DataFrame:
    """Rank-sum z without corrections, and its p."""
    g = rank_sums(df, keys, group, value, case, control)
    n1, n2 = F.col("n1"), F.col("n2")
    z = F.try_divide(F.col("u") - n1 * n2 / 2.0, F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12.0))
    return g.select(*keys, "n1", "n2", z.alias("z"), two_sided_p(z).alias("p"))


def kruskal(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """H with tie correction over the groups that have values, and its chi-square p; null with fewer than two groups."""
    keys, d = list(keys), df.where(F.col(group).isNotNull())
    ranks = _ranks(d, keys, value, {})
    ties = ranks.groupBy(*keys).agg(_ties().alias("t"))
    per = d.groupBy(*keys, value, group).agg(F.count("*").alias("__m"))
    per = joined(per, ranks.select(*keys, value, "__r"), [*keys, value]).groupBy(*keys, group).agg(F.sum("__m").alias("m"), F.sum(F.col("__r") * F.col("__m")).alias("r"))
    g = per.groupBy(*keys).agg(F.count("*").alias("n_groups"), F.sum("m").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("m")).alias("q"))
    g = joined(g, ties, keys)
    n = F.col("n").cast("double")  # its cube is beyond whole numbers from 2.1 million rows
    h = 12.0 / (n * (n + 1)) * F.col("q") - 3.0 * (n + 1)
    h = F.try_divide(h, F.nullif(1 - F.try_divide(F.col("t"), n * n * n - n), F.lit(0.0)))
    h = F.when(F.col("n_groups") > 1, h)
    return g.select(*keys, "n_groups", "n", h.alias("h"), chi2_tail(h, (F.col("n_groups") - 1).cast("double")).alias("p"))


def correlate(df: DataFrame, keys: list[str], x: str, y: str, method: str = "spearman", min_n: int = 10) -> DataFrame:
    """Correlation by key with the p of its t; null with fewer than `min_n` pairs."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if method == "spearman":
        d = avg_rank(avg_rank(d, x, keys, name="__x"), y, keys, name="__y")
        x, y = "__x", "__y"
    spread = F.least(F.stddev_pop(x), F.stddev_pop(y)) > 0
    g = d.groupBy(*keys).agg(F.count("*").alias("n"), F.when(spread, F.corr(x, y)).alias("r"))
    r = F.when(F.col("n") >= min_n, F.col("r"))
    t = F.try_divide(r * F.sqrt((F.col("n") - 2).cast("double")), F.nullif(F.sqrt(F.greatest(F.lit(0.0), 1 - r * r)), F.lit(0.0)))
    p = F.when(F.abs(r) >= 1, F.lit(0.0)).otherwise(t_two_sided_p(t, (F.col("n") - 2).cast("double")))
    return g.select(*keys, "n", r.alias("r"), p.alias("p"))


def fisher_2x2(df: DataFrame, a: str = "a", b: str = "b", c: str = "c", d: str = "d") -> DataFrame:
    """Adds odds_ratio and p (two-sided) to rows of counts [[a, b], [c, d]]: the hypergeometric terms not above the observed one.

    Neighbouring terms differ by a ratio, so two passes over the possible counts do: the first finds the logs of the
    observed and the largest term, the second sums, both with a few running values and no list of terms.
    """
    A, B, C, D = (F.col(x).cast("double") for x in (a, b, c, d))
    r1, c1, n = A + B, A + C, A + B + C + D
    lo, hi = F.greatest(F.lit(0.0), r1 + c1 - n), F.least(r1, c1)
    ks = F.sequence(lo.cast("long"), hi.cast("long"))
    none = F.lit(0.0)

    def term(prev: Column, k: Column) -> Column:
        return F.when(k == lo, none).otherwise(prev + F.log((r1 - k + 1) * (c1 - k + 1)) - F.log(k * (n - r1 - c1 + k)))

    def look(acc: Column, k: Column) -> Column:
        k = k.cast("double")
        new = term(acc["l"], k)
        return F.struct(new.alias("l"), F.greatest(acc["top"], new).alias("top"), F.when(k == A, new).otherwise(acc["seen"]).alias("seen"))

    out = df.withColumn("__s", F.aggregate(ks, F.struct(none.alias("l"), none.alias("top"), none.alias("seen")), look))

    def add(acc: Column, k: Column) -> Column:
        new = term(acc["l"], k.cast("double"))
        mass = F.exp(new - F.col("__s.top"))
        return F.struct(new.alias("l"), (acc["all"] + mass).alias("all"), (acc["rare"] + F.when(new <= F.col("__s.seen") + 1e-7, mass).otherwise(0.0)).alias("rare"))

    out = out.withColumn("__m", F.aggregate(ks, F.struct(none.alias("l"), none.alias("all"), none.alias("rare")), add))
    p = F.least(F.lit(1.0), F.col("__m.rare") / F.col("__m.all"))
    return out.withColumns({"odds_ratio": F.when(B * C > 0, A * D / F.nullif(B * C, F.lit(0.0))).when(A * D > 0, F.lit(float("inf"))), "p": p}).drop("__s", "__m")


def cliffs_delta(df: DataFrame, keys: list[str], group: str, value: str, case: str = "case", control: str = "control") -> DataFrame:
    g = rank_sums(df, keys, group, value, case, control)
    return g.select(*keys, "n1", "n2", (F.try_divide(2.0 * F.col("u"), F.col("n1") * F.col("n2")) - 1).alias("delta"))


def median_diff_ci(df: DataFrame, keys: list[str], group: str, value: str, id_cols: list[str], case: str = "case", control: str = "control", n: int = 5000, seed: int = 1, level: float = 0.95) -> DataFrame:
    """Median of cases less that of controls, with the percentile interval of n resamples of either side. Keys without a
    value have no row, those with one side only nulls. `id_cols` is not read: equal values can stand for each other."""
    keys = list(keys)
    d = df.where(F.col(group).isin(case, control)).select(*keys, group, value)
    m = resampled_medians(d, [*keys, group], value, n, seed)
    side = lambda k: F.max(F.when(F.col(group) == k, F.col("median")))  # noqa: E731  one row each
    diff = checkpointed(m.groupBy(*keys, "boot").agg((side(case) - side(control)).alias("b")))
    a = (1 - level) / 2
    point = diff.where("boot < 0").select(*keys, F.col("b").alias("diff"))
    ci = diff.where("boot >= 0").groupBy(*keys).agg(F.percentile("b", F.lit(a)).alias("ci_low"), F.percentile("b", F.lit(1 - a)).alias("ci_high"))  # n values a key
    return joined(point, ci, keys, "left")


def bh_fdr(df: DataFrame, p: str, scope: list[str] = (), nan_policy: str = "ignore", name: str = "fdr") -> DataFrame:
    """Benjamini-Hochberg within each scope. Missing p: ignored (null result, not counted) or taken as 1."""
    v = F.when(~F.isnan(F.col(p)), F.col(p))
    d = df.withColumn("__p", F.coalesce(v, F.lit(1.0)) if nan_policy == "one" else v)
    t = value_totals(d, scope, "__p", {"__n": F.count("*")}).withColumn("__q", F.col("__p") * F.col("__n_all") / F.col("__n_upto"))
    t = least_from_here(t, scope, "__p", "__q", name).withColumn(name, F.least(name, F.lit(1.0)))
    return joined(d, t.select(*scope, "__p", name), [*scope, "__p"], "left").drop("__p")


def effect_sizes(df: DataFrame, keys: list[str], group: str, value: str, id_cols: list[str], pairs: list[tuple[str, str]], n: int = 5000, seed: int = 1) -> DataFrame:
    """Per key and pair of groups: U test, Cliff's delta, median difference with its interval, Kruskal's p, and FDR over all."""
    parts = []
    for a, b in pairs:
        t = mann_whitney(df, keys, group, value, a, b).select(*keys, "n1", "n2", "u", "p", F.col("rank_biserial").alias("cliffs_delta"))
        parts.append(t.join(median_diff_ci(df, keys, group, value, id_cols, a, b, n, seed), keys, "left").withColumns({"case": F.lit(a), "control": F.lit(b)}))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return bh_fdr(checkpointed(out.join(kruskal(df, keys, group, value).select(*keys, F.col("p").alias("kruskal_p")), keys, "left")), "p")


def walk_peak(places: np.ndarray, weights: np.ndarray, n: int) -> float:
    """The value farthest from 0 of the running enrichment sum, from the hits alone: their places (from 0, ascending) among
    n ranked genes and their weights. Between hits the sum falls evenly, so it is farthest just before or at a hit."""
    m = len(places)
    up = np.cumsum(weights)
    up = up / up[-1] if m and up[-1] > 0 else np.zeros(m)
    down = (places - np.arange(m)) / (n - m) if n > m else np.zeros(m)
    end = (up[-1] if m else 0.0) - (n > m)
    at = np.concatenate((up - down, np.concatenate(([0.0], up[:-1])) - down if m else [], [end]))
    return float(at[np.lexsort((-at, -np.abs(at)))[0]])


#: Permutations that a row of packed ranks makes at a time.
PERMS = 100


def _peaks(df: DataFrame, score: str, hit: str, gene: str, keys: list[str], n: int, weight: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """(keys, es) and (keys, null_es) of n permutations of the scores.

    Each keys' ranked scores are packed once, 8 bytes a gene, with the places of the hits. A permutation of the scores puts
    the hits at random places, so tasks get the packed row with a number of permutations to make and walk only the hits.
    """
    ranked = df.where(F.col(score).isNotNull()).select(*keys, F.struct((-F.col(score).cast("double")).alias("s"), F.col(gene).alias("g"), F.coalesce(F.col(hit), F.lit(False)).alias("h")).alias("x"))
    packed = ranked.groupBy(*keys).agg(F.sort_array(F.collect_list("x")).alias("x"))  # the genes of one ranking
    hits = F.expr("filter(transform(x, (e, i) -> if(e.h, i, -1)), i -> i >= 0)").alias("hits")
    packed = checkpointed(packed.select(*keys, F.xxhash64(*keys, F.lit(seed)).alias("key"), F.expr("transform(x, e -> abs(e.s))").alias("s"), hits))

    @F.pandas_udf("double")
    def real(s: pd.Series, hits: pd.Series) -> pd.Series:
        return pd.Series([walk_peak(np.asarray(h, np.int64), np.asarray(x)[np.asarray(h, np.int64)] ** weight, len(x)) for x, h in zip(s, hits, strict=True)])

    @F.pandas_udf("array<double>")
    def null(s: pd.Series, hits: pd.Series, key: pd.Series, block: pd.Series) -> pd.Series:
        out = []
        for x, h, k, b in zip(s, hits, key, block, strict=True):
            x, rng = np.asarray(x) ** weight, np.random.default_rng([seed & 0xFFFFFFFF, int(k) & 0xFFFFFFFFFFFFFFFF, int(b)])
            places = (np.sort(rng.choice(len(x), len(h), replace=False, shuffle=False)) for _ in range(min(PERMS, n - b * PERMS)))
            out.append([walk_peak(p, x[p], len(x)) for p in places])
        return pd.Series(out)

    dealt = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(-(-n // PERMS) - 1)))).repartition(df.sparkSession.sparkContext.defaultParallelism, "key", "block")
    return packed.select(*keys, real("s", "hits").alias("es")), dealt.select(*keys, F.explode(null("s", "hits", "key", "block")).alias("null_es"))


def gsea(df: DataFrame, score: str, hit: str, gene: str, keys: list[str] = (), n: int = 1000, weight: float = 1.0, seed: int = 1) -> DataFrame:
    """es, nes and p by key: n permutations of the scores; nes divides by the mean of the null of the same sign, p is
    (k + 1) / (m + 1) among these. Genes without a score are left out; null keys are a group; no genes, no row."""
    keys = list(keys)
    real, null = _peaks(df, score, hit, gene, keys, n, weight, seed)
    both = joined(null, real, keys)
    same = F.col("null_es") * F.col("es") > 0
    g = both.groupBy(*keys, "es").agg(F.avg(F.when(same, F.abs("null_es"))).alias("__m"), F.count_if(same & (F.abs("null_es") >= F.abs("es"))).alias("__k"), F.count_if(same).alias("__n"))
    return g.select(*keys, "es", F.try_divide("es", "__m").alias("nes"), ((F.col("__k") + 1.0) / (F.col("__n") + 1)).alias("p"))


def ks_set_score(df: DataFrame, score: str, hit: str, gene: str, n: int = 1000, seed: int = 1) -> DataFrame:
    """The largest difference of the hits' and the others' distribution down the ranks, against n permutations: null mean and
    sd, z, p. Genes without a score are left out."""
    real, null = _peaks(df, score, hit, gene, [], n, 0.0, seed)
    g = null.crossJoin(F.broadcast(real.withColumnRenamed("es", "ks"))).groupBy("ks")  # one row
    g = g.agg(F.avg("null_es").alias("null_mean"), F.stddev_samp("null_es").alias("null_sd"), ((F.count_if(F.abs("null_es") >= F.abs("ks")) + 1.0) / (F.count("*") + 1)).alias("p"))
    return g.withColumn("z", F.try_divide(F.col("ks") - F.col("null_mean"), F.nullif(F.col("null_sd"), F.lit(0.0))))


def binary_metrics(df: DataFrame, y: str, p: str, keys: list[str] = (), bins: int = 10) -> DataFrame:
    """n, n_pos, auroc (by ranks), average precision (ties taken together), brier, ece (equal bins)."""
    keys = list(keys)
    d = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).withColumn("__y", F.col(y).cast("double"))
    gap = F.col("__y") - F.col(p)
    t = _ranks(d, keys, p, {"__sy": F.sum("__y"), "__ones": F.count_if(F.col("__y") == 1), "__sq": F.sum(gap * gap)})
    prec = (F.col("__sy_all") - F.col("__sy_upto") + F.col("__sy")) / (F.col("__n_all") - F.col("__n_upto") + F.col("__n"))
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    ece = d.groupBy(*keys, b.alias("b")).agg((F.abs(F.sum("__y") - F.sum(p))).alias("e"), F.count("*").alias("n")).groupBy(*keys).agg((F.sum("e") / F.sum("n")).alias("ece"))
    g = t.groupBy(*keys).agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("n"), F.sum("__sy").alias("n_pos"), F.sum(F.when(F.col("__ones") > 0, F.col("__r") * F.col("__ones"))).alias("r"),
        F.try_divide(F.sum(prec * F.col("__sy")), F.sum("__sy")).alias("average_precision"), (F.sum("__sq") / F.sum("__n")).alias("brier"),
    )
    pos, neg = F.col("n_pos"), F.col("n") - F.col("n_pos")
    g = g.withColumn("auroc", F.try_divide(F.col("r") - pos * (pos + 1) / 2.0, pos * neg)).drop("r")
    return joined(g, ece, keys)


def auroc_ci(df: DataFrame, y: str, p: str, id_cols: list[str], n: int = 1000, seed: int = 1) -> DataFrame:
    """The percentile interval of the AUROC over n resamples of the rows. `id_cols` is not read."""
    boots = resampled_auroc(df, y, p, n, seed)
    return boots.agg(F.percentile("auroc", F.lit(0.025)).alias("auroc_low"), F.percentile("auroc", F.lit(0.975)).alias("auroc_high"))  # n values


def regression_metrics(df: DataFrame, y: str, yhat: str, keys: list[str] = ()) -> DataFrame:
    """n, rmse, mae, r2, pearson, spearman and the share of equal signs."""
    keys = list(keys)
    d = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull())
    d = avg_rank(avg_rank(d, y, keys, name="__ry"), yhat, keys, name="__rh")
    e = F.col(y) - F.col(yhat)
    varied = F.least(F.stddev_pop(y), F.stddev_pop(yhat)) > 0
    return d.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.try_divide(F.avg(e * e), F.nullif(F.var_pop(y), F.lit(0.0)))).alias("r2"),
        F.when(varied, F.corr(y, yhat)).alias("pearson"), F.when(varied, F.corr("__ry", "__rh")).alias("spearman"), F.avg((F.signum(y) == F.signum(yhat)).cast("double")).alias("sign_accuracy"),
    )
