"""Cells: quality control, pseudobulk, normalisation, group comparisons. Expression is long with zeros left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .linkage import semi
from .select import best_per_key, top_n
from .linkage import checkpointed
from .stats import bh_fdr, fisher_2x2, mann_whitney, rank_sum

SOURCES = ("donor_id", "disease", "class", "subclass", "subtype", "cell_type", "author_cell_type")


def assign_group(df: DataFrame, rule: str) -> DataFrame:
    """Adds group (case or control) by a cohort's rule; other rows go. disease: case unless normal; flag: Parkinson_disease
    is Yes, against No with a normal disease."""
    d = F.lower(F.trim("disease"))
    if rule == "disease":
        g = F.when(d == "normal", "control").when(d.isNotNull() & (d != ""), "case")
    elif rule == "flag":
        f = F.lower(F.trim("Parkinson_disease"))
        g = F.when(f == "yes", "case").when((f == "no") & (d == "normal"), "control")
    else:
        raise ValueError(f"unknown rule {rule}")
    return df.withColumn("group", g).where("group is not null")


def filter_by_regex(df: DataFrame, cols: list[str], pattern: str) -> DataFrame:
    return df.where(F.concat_ws(" ", *cols).rlike(f"(?i){pattern}"))


def cell_qc(expr: DataFrame, universe: DataFrame | None = None, programs: DataFrame | None = None) -> DataFrame:
    """Per cell: detected genes, total counts, detected share of the universe, and detected genes of each direction."""
    e = expr if universe is None else semi(expr, universe.select("gene").distinct(), ["gene"])
    n = (universe if universe is not None else expr).select("gene").distinct().agg(F.count("*").alias("__n"))
    side = []
    if programs is not None:
        e = e.join(programs.groupBy("gene").agg(F.max(F.col("direction") == "risk").alias("__r"), F.max(F.col("direction") == "protective").alias("__p")), "gene", "left")
        side = [F.count_if((F.col("value") > 0) & F.col(c)).alias(m) for c, m in (("__r", "n_risk"), ("__p", "n_protective"))]
    g = e.groupBy("sample_id").agg(F.count_if(F.col("value") > 0).alias("n_genes"), F.sum("value").alias("n_counts"), *side)
    return g.crossJoin(F.broadcast(n)).withColumn("detected_fraction", F.try_divide("n_genes", "__n")).drop("__n")


def qc_cells(qc: DataFrame, min_genes: int = 200, min_counts: float = 500, max_counts: float = 1e5, min_frac: float = 0.0, min_risk: int = 0, min_prot: int = 0, strict_frac: bool = False) -> DataFrame:
    f = F.col("detected_fraction")
    c = (F.col("n_genes") >= min_genes) & (F.col("n_counts") >= min_counts) & (F.col("n_counts") <= max_counts) & (f > min_frac if strict_frac else f >= min_frac)
    for name, least in (("n_risk", min_risk), ("n_protective", min_prot)):
        c = c & (F.col(name) >= least) if least else c
    return qc.where(c)


def pseudobulk(cells: DataFrame, expr: DataFrame, keys: list[str], min_cells: int = 20, mode: str = "sum") -> DataFrame:
    """(keys, gene, value, n_cells): sums of counts, or means over all cells of the group (absent genes are zeros), of groups
    with at least `min_cells` cells."""
    n = cells.groupBy(*keys).agg(F.count("*").alias("n_cells")).where(F.col("n_cells") >= min_cells)
    g = expr.join(cells.select("sample_id", *keys), "sample_id").groupBy(*keys, "gene").agg(F.sum("value").alias("value")).join(n, keys)
    return g.withColumn("value", F.col("value") / F.col("n_cells")) if mode == "mean" else g


def log2cpm(expr: DataFrame, keys: list[str] = ("sample_id",), library_from: str = "all", programs: DataFrame | None = None) -> DataFrame:
    """log2(CPM + 1); the library is all genes, or those of programs, to which the result is then restricted."""
    e = semi(expr, programs.select("gene").distinct(), ["gene"]) if library_from == "programs" else expr
    lib = F.sum("value").over(Window.partitionBy(*keys))
    return e.withColumn("value", F.log2(F.coalesce(F.try_divide(F.col("value") * 1e6, F.nullif(lib, F.lit(0.0))), F.lit(0.0)) + 1))


def collapse_genes_expr(expr: DataFrame, how: str = "sum", keys: list[str] = ("sample_id",), feature: str = "feature") -> DataFrame:
    """Several features of a gene into one: sum, mean, or the feature of the largest total (max_total)."""
    if how == "max_total":
        totals = expr.groupBy("gene", feature).agg(F.sum("value").alias("t"))
        return semi(expr, best_per_key(totals, ["gene"], [F.desc("t"), F.col(feature)]), ["gene", feature]).drop(feature)
    return expr.groupBy(*keys, "gene").agg({"sum": F.sum, "mean": F.avg}[how]("value").alias("value"))


def is_count_like(expr: DataFrame, rule: str = "strict") -> bool:
    """Whether values are counts: not negative, nearly all whole, and large enough: strict and loose bounds, or by the 99th percentile."""
    r = expr.agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg((F.abs(F.col("value") - F.round("value")) < 1e-6).cast("double")).alias("whole"), F.percentile_approx("value", F.lit(0.99)).alias("p99")).first()
    if r["lo"] is None:
        return False
    whole, high = {"strict": (0.99, r["hi"] > 20), "loose": (0.95, r["hi"] > 10), "p99": (0.95, r["p99"] > 5), "any": (0.9, True)}[rule]
    return bool(r["lo"] >= 0 and r["whole"] >= whole and high)


def summarize(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    sd = F.stddev_samp(col)
    return df.groupBy(*keys).agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.median(col).alias("median"), sd.alias("sd"), F.try_divide(sd, F.sqrt(F.count(col).cast("double"))).alias("sem"))


def compare_groups(df: DataFrame, keys: list[str], value: str, case: str = "case", control: str = "control", min_n: int = 3, group: str = "group", donor: str | None = None, test: str = "mann_whitney") -> DataFrame:
    """Per label: counts, means and medians of either side, their differences, p (null with a side below min_n) and FDR."""
    d = df.where(F.col(group).isin(case, control) & F.col(value).isNotNull())
    on = {"case": F.col(group) == case, "control": F.col(group) == control}
    aggs = [F.count_if(c).alias(f"n_{n}") for n, c in on.items()] + [F.avg(F.when(c, F.col(value))).alias(f"mean_{n}") for n, c in on.items()] + [F.median(F.when(c, F.col(value))).alias(f"median_{n}") for n, c in on.items()]
    aggs += [F.countDistinct(F.when(c, F.col(donor))).alias(f"donors_{n}") for n, c in on.items()] if donor else []
    g = d.groupBy(*keys).agg(*aggs).withColumns({"delta_mean": F.col("mean_case") - F.col("mean_control"), "delta_median": F.col("median_case") - F.col("median_control")})
    t = (mann_whitney if test == "mann_whitney" else rank_sum)(d, keys, group, value, case, control).select(*keys, "p")
    g = g.join(t, keys, "left").withColumn("p", F.when(F.least("n_case", "n_control") >= min_n, F.col("p")))
    return bh_fdr(checkpointed(g), "p")


def donor_mean(df: DataFrame, keys: list[str], value: str, donor: str = "donor_id", group: str = "group") -> DataFrame:
    return df.groupBy(*keys, donor, group).agg(F.avg(value).alias(value), F.count("*").alias("n_cells"))


def shifted_delta(df: DataFrame, value: str = "score", label: str = "cell_type", disease: str = "disease", control: str = "normal", min_cells: int = 20) -> DataFrame:
    """Per cell type and disease: its median less the controls' median, both from at least `min_cells` cells."""
    g = df.groupBy(label, disease).agg(F.median(value).alias("median"), F.count("*").alias("n")).where(F.col("n") >= min_cells)
    c = g.where(F.col(disease) == control).select(label, F.col("median").alias("base"))
    return g.where(F.col(disease) != control).join(c, label).select(label, disease, "n", (F.col("median") - F.col("base")).alias("delta"))


def extreme_burden(df: DataFrame, keys: list[str], value: str, q: float = 0.95, case: str = "case", control: str = "control", group: str = "group") -> DataFrame:
    """Per label: the controls' q-quantile, cells of either side above it, fractions, odds ratio and Fisher's p."""
    cut = df.where(F.col(group) == control).groupBy(*keys).agg(F.percentile(value, F.lit(q)).alias("threshold"))
    d, hi = df.where(F.col(group).isin(case, control)).join(cut, keys), F.col(value) > F.col("threshold")
    side = {"case": F.col(group) == case, "control": F.col(group) == control}
    g = d.groupBy(*keys, "threshold").agg(*(F.count_if(c & (hi if x == "hi" else ~hi)).alias(f"{n}_{x}") for n, c in side.items() for x in ("hi", "lo")))
    g = g.withColumns({f"{n}_fraction": F.try_divide(F.col(f"{n}_hi"), F.col(f"{n}_hi") + F.col(f"{n}_lo")) for n in side})
    return fisher_2x2(g, "case_hi", "case_lo", "control_hi", "control_lo")


def assign_high(df: DataFrame, value: str, keys: list[str] = (), q: float = 0.9, within: str = "all", group: str = "group", case: str = "case") -> DataFrame:
    """Adds high: at least the q-quantile of all rows, or of the cases, of the key."""
    base = df if within == "all" else df.where(F.col(group) == case)
    cut = base.groupBy(*keys).agg(F.percentile(value, F.lit(q)).alias("__cut"))
    d = df.join(cut, list(keys), "left") if keys else df.crossJoin(F.broadcast(cut))
    return d.withColumn("high", F.coalesce(F.col(value) >= F.col("__cut"), F.lit(False))).drop("__cut")


def nominate(df: DataFrame, min_donors: int = 3) -> DataFrame:
    """primary: FDR below 0.05, a positive difference and enough donors of either side; relaxed: FDR below 0.1 or p below 0.05."""
    enough = F.least("donors_case", "donors_control") >= min_donors
    up = F.col("delta_mean") > 0
    return df.withColumns({"primary": F.coalesce((F.col("fdr") < 0.05) & up & enough, F.lit(False)), "relaxed": F.coalesce(((F.col("fdr") < 0.1) | (F.col("p") < 0.05)) & up & enough, F.lit(False))})


def label_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, label, n) of every label column."""
    return df.select(*(F.col(c).cast("string") for c in cols)).unpivot([], cols, "column", "label").groupBy("column", "label").agg(F.count("*").alias("n"))


def top_delta_labels(df: DataFrame, keys: list[str], value: str, label: str, n: int, case: str = "case", control: str = "control", group: str = "group") -> DataFrame:
    side = lambda k: F.avg(F.when(F.col(group) == k, F.col(value)))
    g = df.groupBy(*keys, label).agg((side(case) - side(control)).alias("delta")).where("delta is not null")
    return top_n(g, keys, [F.abs("delta").desc(), F.col(label)], n)


def case_label_summary(df: DataFrame, label: str, value: str = "rstar", group: str = "group", case: str = "case", donor: str = "donor_id", min_cells: int = 20, min_donors: int = 1) -> DataFrame:
    g = df.where(F.col(group) == case).groupBy(label).agg(F.avg(value).alias(f"mean_{value}"), F.count("*").alias("n_cells"), F.countDistinct(donor).alias("n_donors"))
    g = g.where((F.col("n_cells") >= min_cells) & (F.col("n_donors") >= min_donors))
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(f"mean_{value}"), label)))


def order_by_mean(df: DataFrame, label: str, value: str, where: Column | None = None) -> DataFrame:
    g = (df if where is None else df.where(where)).groupBy(label).agg(F.avg(value).alias("mean"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean"), label)))


def centers(df: DataFrame, label: str, x: str = "UMAP1", y: str = "UMAP2") -> DataFrame:
    return df.groupBy(label).agg(F.median(x).alias("x"), F.median(y).alias("y"), F.count("*").alias("n"))


def sym_limits(df: DataFrame, col: str, q: float = 0.99, floor: float = 1e-6) -> DataFrame:
    """(low, high): the q-quantile of absolutes either way, not below the floor."""
    return df.agg(F.greatest(F.coalesce(F.percentile(F.abs(col), F.lit(q)), F.lit(floor)), F.lit(floor)).alias("high")).select((-F.col("high")).alias("low"), "high")
