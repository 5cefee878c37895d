"""Gene programs: building them and scoring samples with them. Expression is long: (sample_id, gene, value)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import erfc, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tails import ERFC
from .linkage import semi
from .meta import collapse_genes
from .ordered import joined, numbered
from .select import best_per_key
from .shared import checkpointed


def build_programs(mr: DataFrame, model: DataFrame, p: float = 0.05, tiers: tuple[str, ...] = ("tier1", "tier2"), policy: str = "strongest_p") -> DataFrame:
    """(gene_set, program, gene, direction, source, pvalue, confidence): significant MR genes, each tier's genes, and both
    merged, by direction; a gene of several sources counts by its p, then its confidence."""
    m = collapse_genes(mr.where(F.col("pvalue") < p), policy)
    m = m.select(F.lit("mr").alias("gene_set"), "gene", F.when(F.col("beta") > 0, "risk").otherwise("protective").alias("direction"), F.lit("mr").alias("source"), "pvalue", F.lit(None).cast("double").alias("confidence"))
    t = model.where(F.col("support_tier").isin(*tiers) & F.col("pred_direction").isin("risk", "protective"))
    t = t.select(F.col("support_tier").alias("gene_set"), "gene", F.col("pred_direction").alias("direction"), F.lit("model").alias("source"), F.lit(None).cast("double").alias("pvalue"), F.col("confidence").cast("double").alias("confidence"))
    both = m.unionByName(t)
    merged = best_per_key(both, ["gene"], [F.col("pvalue").asc_nulls_last(), F.col("confidence").desc_nulls_last(), F.col("gene_set")]).withColumn("gene_set", F.lit("merged"))
    return both.unionByName(merged).withColumn("program", F.concat_ws("_", "gene_set", "direction"))


def expand_programs(df: DataFrame, tiers: list[str], drop_overlap: bool = False, min_genes: int = 5) -> DataFrame:
    """(program, gene, direction) of the listed tiers by direction, programs of at least `min_genes`; optionally without genes of both directions."""
    d = df.where(F.col("support_tier").isin(*tiers)).select("gene", F.col("pred_direction").alias("direction")).where(F.col("direction").isin("risk", "protective")).distinct()
    if drop_overlap:
        d = d.withColumn("__n", F.count("*").over(Window.partitionBy("gene"))).where("__n = 1").drop("__n")
    d = d.withColumn("__n", F.count("*").over(Window.partitionBy("direction"))).where(F.col("__n") >= min_genes).drop("__n")
    return d.select(F.concat(F.lit("expand_"), "direction").alias("program"), "gene", "direction")


def program_qc(programs: DataFrame, genes: DataFrame, min_genes: int = 5) -> DataFrame:
    """Per program its genes, those in the expression table, the missing ones, and whether enough are there."""
    g = genes.select("gene").distinct().withColumn("__hit", F.lit(1))
    out = programs.select("program", "gene").distinct().join(g, "gene", "left").groupBy("program").agg(F.count("*").alias("n_total"), F.count("__hit").alias("n_present"))
    return out.withColumns({"n_missing": F.col("n_total") - F.col("n_present"), "status": F.when(F.col("n_present") >= min_genes, "ok").otherwise("too_few")})


def zscore_by_gene(expr: DataFrame) -> DataFrame:
    """Adds z: value less its gene's mean over the population deviation; null for genes that don't vary."""
    m = expr.groupBy("gene").agg(F.avg("value").alias("__mean"), F.stddev_pop("value").alias("__sd"))
    z = F.try_divide(F.col("value") - F.col("__mean"), F.nullif(F.col("__sd"), F.lit(0.0)))
    return joined(expr, m, ["gene"]).withColumn("z", z).drop("__mean", "__sd")


def mean_z_scores(expr: DataFrame, programs: DataFrame) -> DataFrame:
    """(sample_id, program, score, n_genes): mean z over the program's genes."""
    p = programs.select("program", "gene").distinct()
    z = zscore_by_gene(semi(expr, p, ["gene"])).where("z is not null")
    return z.join(p, "gene").groupBy("sample_id", "program").agg(F.avg("z").alias("score"), F.count("*").alias("n_genes"))


def rstar(scores: DataFrame, risk: str = "risk", protective: str = "protective", keys: list[str] = ("sample_id",)) -> DataFrame:
    """Risk and protective scores side by side, and their difference."""
    side = lambda n: F.max(F.when(F.col("program") == n, F.col("score")))
    g = scores.where(F.col("program").isin(risk, protective)).groupBy(*keys).agg(side(risk).alias("risk"), side(protective).alias("protective"))
    return g.withColumn("rstar", F.col("risk") - F.col("protective"))


def module_rstar(expr: DataFrame, modules: DataFrame, pred: DataFrame, min_dir: int = 3) -> tuple[DataFrame, DataFrame]:
    """Per sample and module the mean z of its risk genes less that of its protective ones, for modules with at least
    `min_dir` genes of either; and a count of genes by module."""
    p = modules.select("gene", "module_id").join(pred.select("gene", F.col("pred_direction").alias("program")), "gene").where(F.col("program").isin("risk", "protective"))
    p = semi(p, expr.select("gene").distinct(), ["gene"])
    qc = p.groupBy("module_id").agg(F.count_if(F.col("program") == "risk").alias("n_risk"), F.count_if(F.col("program") == "protective").alias("n_protective"))
    qc = qc.withColumn("used", F.least("n_risk", "n_protective") >= min_dir)
    z = zscore_by_gene(semi(expr, p, ["gene"])).where("z is not null").join(semi(p, qc.where("used"), ["module_id"]), "gene")
    s = z.groupBy("sample_id", "module_id", "program").agg(F.avg("z").alias("score"))
    return rstar(s, keys=["sample_id", "module_id"]), qc


def module_ranking(effects: DataFrame, qc: DataFrame, n: int = 30, floor: float = 1e-300) -> DataFrame:
    """The modules of the largest absolute effect, with -log10 of their FDR and gene counts."""
    d = effects.join(qc, "module_id", "left").withColumn("neg_log10_fdr", -F.log10(F.greatest(F.col("fdr"), F.lit(floor))))
    return d.orderBy(F.abs("delta").desc(), "module_id").limit(n)


def cell_rank_score(expr: DataFrame, programs: DataFrame, min_frac: float = 0.2, min_hits: int = 100, n_universe: int | None = None) -> DataFrame:
    """Per cell, among its detected genes: ES = ((n - 1) / 2 - mean rank) / (n / 2) of risk and protective genes, ranks from 0
    by falling value. Cells need `min_frac` of the universe detected and `min_hits` genes of both programs."""
    total = n_universe or expr.select("gene").distinct().count()
    w = Window.partitionBy("sample_id")
    d = expr.where("value > 0").withColumns({"__r": F.row_number().over(w.orderBy(F.desc("value"), "gene")) - 1, "__n": F.count("*").over(w)})
    d = d.where(F.col("__n") >= min_frac * total)
    p = programs.select("program", "gene").distinct()
    g = d.join(p, "gene").groupBy("sample_id", "program").agg(F.count("*").alias("hits"), F.avg("__r").alias("mean_rank"), F.max("__n").alias("n"))
    g = g.where(F.col("hits") >= min_hits).withColumn("score", ((F.col("n") - 1) / 2.0 - F.col("mean_rank")) / (F.col("n") / 2.0))
    return rstar(g).where("risk is not null and protective is not null")


@cache
def _normal_table() -> tuple[np.ndarray, np.ndarray]:
    grid = np.linspace(-8, 8, 32_001)
    return grid, np.array([0.5 * erfc(-z / sqrt(2.0)) for z in grid])


def _upper(z: np.ndarray) -> np.ndarray:
    """The normal distribution at z, by the fit of `tails.two_sided_p`."""
    x = np.abs(z) / np.sqrt(2.0)
    t = 1 / (1 + 0.5 * x)
    poly = np.full_like(t, ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = poly * t + c
    p = t * np.exp(-x * x + poly) / 2
    return np.where(z >= 0, 1 - p, p)


def _kernel_cdf(t: pa.Table) -> pa.Table:
    """For one gene: the Gaussian kernel estimate of its distribution at every sample of the block."""
    x = t.column("value").to_numpy().astype(float)
    h = x.std(ddof=1) / 4 if len(x) > 1 else 0.0
    h, out = (h if h > 0 else 1e-3), np.zeros(len(x))
    for at in range(0, len(x), 512):
        out[at : at + 512] = np.interp((x[at : at + 512, None] - x[None, :]) / h, *_normal_table()).mean(axis=1)
    return pa.table({"sample_id": t.column("sample_id"), "gene": t.column("gene"), "block": t.column("block"), "value": out})


#: Different values of a gene to a block of a kernel's sums.
KERNEL_VALUES = 2048


def kernel_cdf(expr: DataFrame, per: int = KERNEL_VALUES) -> DataFrame:
    """Each gene's Gaussian kernel distribution over all its rows, at each of them, instead of the value. A gene's different
    values are counted and dealt to blocks; pairs of blocks are summed apart, so that a task holds two blocks at most. The
    work is the square of the different values."""
    h = expr.groupBy("gene").agg((F.stddev_samp("value") / 4).alias("h"), F.count("*").alias("all"))
    counts = expr.groupBy("gene", "value").agg(F.count("*").alias("n"))
    counts = numbered(counts, ["gene"], F.xxhash64("value"), ["value"], "__i").withColumn("b", (F.col("__i") / per).cast("int")).drop("__i")
    packed = checkpointed(counts.groupBy("gene", "b").agg(F.collect_list("value").alias("x"), F.collect_list(F.col("n").cast("double")).alias("n")))  # `per` of them
    pairs = packed.select("gene", "b", "x").join(packed.select("gene", F.col("b").alias("o"), F.col("x").alias("y"), "n"), "gene").join(h, "gene")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for i in range(t.num_rows):
                x, y, n = (t.column(c)[i].values.to_numpy().astype(float) for c in ("x", "y", "n"))
                h = t.column("h")[i].as_py() or 1e-3
                out = np.concatenate([_upper((x[at : at + 64, None] - y[None, :]) / h) @ n for at in range(0, len(x), 64)]) / t.column("all")[i].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([t.column("gene")[i].as_py()] * len(x), t.schema.field("gene").type), pa.array(x), pa.array(out)], ["gene", "value", "k"])

    sums = pairs.select("gene", "x", "y", "n", "h", "all").mapInArrow(run, f"gene {dict(expr.dtypes)['gene']}, value double, k double")
    sums = sums.groupBy("gene", "value").agg(F.sum("k").alias("__k"))
    rest = [c for c in expr.columns if c != "value"]
    return expr.join(sums, ["gene", "value"]).select(*rest, F.col("__k").alias("value"))


def gsva(expr: DataFrame, programs: DataFrame, method: str = "gsva", universe: str = "all", block: int | None = None, min_size: int = 5, max_size: int | None = None, tau: float | None = None, seed: int = 1) -> DataFrame:
    """(sample_id, program, score) for programs with min_size to max_size genes present.

    gsva: a kernel distribution of each gene over all samples, or with `block` over those of a block (at most so many of them, dealt by hash), genes
    ranked in each sample by it, a weighted walk down the ranks, and the sum of its largest rise and fall. ssgsea: ranks of
    the values, walk with weight tau (0.25), sum of the differences, scaled by the range of all scores. zscore: sum of z
    over the root of the number of genes. universe `programs` keeps only genes of programs, `all` those that vary. Genes
    that a sample lacks count as 0.
    """
    p = programs.select("program", "gene").distinct()
    if method == "zscore":
        z = zscore_by_gene(expr).where("z is not null").join(p, "gene")
        g = z.groupBy("sample_id", "program").agg(F.count("*").alias("m"), F.sum("z").alias("s"))
        return g.where(F.col("m") >= min_size).select("sample_id", "program", (F.col("s") / F.sqrt(F.col("m").cast("double"))).alias("score"))
    e = semi(expr, p, ["gene"]) if universe == "programs" else expr
    samples = e.select("sample_id").distinct()
    n_blocks = max(1, -(-samples.count() // block)) if block else 1
    samples = numbered(samples, [], F.xxhash64("sample_id", F.lit(seed)), ["sample_id"], "__i", "__of")
    samples = samples.select("sample_id", F.expr(f"cast(__i * {n_blocks} div __of as int)").alias("block"))
    e = e.select("sample_id", "gene", "value").join(samples, "sample_id")
    genes = e.groupBy("block", "gene").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("c"))
    size = samples.groupBy("block").agg(F.count("*").alias("n"))
    varied = genes.join(size, "block").where("hi > lo or (c < n and (hi <> 0 or lo <> 0))").select("block", "gene")
    dense = varied.join(samples, "block").join(e, ["block", "sample_id", "gene"], "left").select("block", "sample_id", "gene", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))
    if method == "gsva" and not block:
        dense = kernel_cdf(dense)
    elif method == "gsva":
        kind = dict(dense.dtypes)
        schema = f"sample_id {kind['sample_id']}, gene {kind['gene']}, block int, value double"
        dense = dense.groupBy("block", "gene").applyInArrow(_kernel_cdf, schema)
    w = Window.partitionBy("sample_id")
    n = F.count("*").over(w)
    ranked = dense.withColumns({"rank": F.row_number().over(w.orderBy("value", "gene")), "n": n})
    weight = F.abs(F.col("rank") - F.col("n") / 2.0) if method == "gsva" else F.pow(F.col("rank").cast("double"), F.lit(0.25 if tau is None else tau))
    if method == "gsva" and tau is not None:
        weight = F.pow(weight, F.lit(tau))
    present = semi(p, ranked.select("gene").distinct(), ["gene"])
    sized = present.groupBy("program").count().where((F.col("count") >= min_size) & (F.col("count") <= (max_size or 1 << 60))).select("program")
    # Only the hits are walked: between them the sum falls evenly, so it is highest at a hit, lowest just before one, or 0.
    hits = ranked.withColumn("w", weight).join(semi(present, sized, ["program"]), "gene")
    over = Window.partitionBy("sample_id", "program")
    if method == "ssgsea":  # the sum over all places: a hit counts at its rank and below, a miss likewise
        g = hits.groupBy("sample_id", "program").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("rank")).alias("wr"), F.sum("rank").alias("r"), F.count("*").alias("m"), F.max("n").alias("n"))
        down = F.try_divide(F.col("n") * (F.col("n") + 1) / 2.0 - F.col("r"), F.nullif(F.col("n") - F.col("m"), F.lit(0)).cast("double"))
        g = g.select("sample_id", "program", (F.coalesce(F.try_divide("wr", "w"), F.lit(0.0)) - F.coalesce(down, F.lit(0.0))).alias("score"))
        span = g.agg((F.max("score") - F.min("score")).alias("__span"))
        return g.crossJoin(F.broadcast(span)).withColumn("score", F.try_divide(F.col("score"), F.nullif(F.col("__span"), F.lit(0.0)))).drop("__span")
    down_ranks = over.orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumns({"__i": F.row_number().over(over.orderBy(F.desc("rank"))), "__m": F.count("*").over(over), "__w": F.sum("w").over(down_ranks), "__all": F.sum("w").over(over)})
    misses = F.coalesce(F.try_divide((F.col("n") - F.col("rank") - F.col("__i") + 1).cast("double"), F.nullif(F.col("n") - F.col("__m"), F.lit(0)).cast("double")), F.lit(0.0))
    at = F.coalesce(F.try_divide("__w", "__all"), F.lit(0.0)) - misses
    before = F.coalesce(F.try_divide(F.col("__w") - F.col("w"), F.col("__all")), F.lit(0.0)) - misses
    g = hits.groupBy("sample_id", "program").agg(F.max(at).alias("high"), F.min(before).alias("low"), F.min(F.when(F.col("__all") > 0, 0.0).otherwise(-1.0)).alias("end"))
    return g.select("sample_id", "program", (F.greatest("high", F.lit(0.0)) + F.least("low", "end", F.lit(0.0))).alias("score"))
