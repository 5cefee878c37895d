"""Variant contributions and their spread over cell contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import contribution_class, support_class
from .ordered import joined
from .select import share, unique_rank
from .shared import checkpointed, dealt

#: Contexts are sent to every task; a table beyond so many rows is joined by blocks of them instead.
CONTEXT_ROWS = 10_000


def first_existing(df: DataFrame, names: list[str]) -> str | None:
    return next((n for n in names if n in df.columns), None)


def coalesce_cols(df: DataFrame, candidates: dict[str, list[str]]) -> DataFrame:
    """Adds each output column: the first value among the candidates that the table has, null if it has none."""
    made = {}
    for out, names in candidates.items():
        there = [F.col(n) for n in names if n in df.columns]
        made[out] = F.coalesce(*there) if there else F.lit(None).cast("string")
    return df.withColumns(made)


def contribution_rows(delta: DataFrame, links: DataFrame, pred: DataFrame) -> DataFrame:
    """Variant, gene and GWAS variant together: deltas by regulatory variant, predictions by gene. Predictions meet the deltas
    before links multiply them, so the rows of the result are not dealt out."""
    rest = lambda d, *keys: [c for c in d.columns if c not in keys]
    d = delta.join(pred, "gene").join(links, "reg_rsid")
    return d.select("gene", "reg_rsid", *rest(delta, "gene", "reg_rsid"), *rest(links, "reg_rsid"), *rest(pred, "gene"))


def decompose(df: DataFrame, gene: str = "gene", weight: str = "weight", effect: str = "effect", pred: str = "pred") -> DataFrame:
    """Each row's share of its gene's weight (equal shares if all are 0), signed and relative contribution, and whether its
    effect agrees with the prediction."""
    w, e = F.col(weight), F.col(effect)
    t = df.groupBy(gene).agg(F.sum(w).alias("__total"), F.count("*").alias("__n"), F.sum(F.abs(w * e)).alias("__weighed"), F.sum(F.abs(e)).alias("__equal"))
    d = joined(df, t.hint("shuffle_hash"), [gene])
    by_weight = F.col("__total") > 0
    d = d.withColumn("share", F.when(by_weight, w / F.col("__total")).otherwise(1.0 / F.col("__n")))
    d = d.withColumn("contribution", F.col("share") * e)
    size = F.when(by_weight, F.col("__weighed") / F.col("__total")).otherwise(F.col("__equal") / F.col("__n"))
    return d.withColumns({
        "relative": F.coalesce(F.try_divide(F.col("contribution"), F.nullif(size, F.lit(0.0))), F.lit(0.0)), "aligned": F.col("contribution") * F.signum(pred),
        "contribution_class": contribution_class(F.col("share")), "support": support_class(F.col(effect), F.col(pred)),
    }).drop("__total", "__n", "__weighed", "__equal")


def decompose_summary(df: DataFrame, gene: str = "gene") -> DataFrame:
    """Per gene: rows, variants, loci, the largest contribution, effective number 1 / sum of squared shares, entropy, share that agrees."""
    p = F.col("share")
    df = checkpointed(df.select(gene, "reg_rsid", "gwas_rsid", "share", "contribution", "support"))
    top = F.max(F.struct(F.abs("contribution").alias("a"), "reg_rsid", "contribution"))
    g = df.groupBy(gene).agg(
        F.count("*").alias("n_rows"), top.alias("top"),
        F.try_divide(F.lit(1.0), F.sum(p * p)).alias("effective_n"), (-F.sum(F.when(p > 0, p * F.ln(p)).otherwise(0.0))).alias("entropy"), F.sum("contribution").alias("total"),
        F.avg((F.col("support") == "concordant").cast("double")).alias("concordant_fraction"),
    )
    for name, c in (("n_variants", "reg_rsid"), ("n_loci", "gwas_rsid")):  # different ones apart, in tasks of a size
        g = joined(g, dealt(df.select(gene, c), [gene, c]).distinct().groupBy(gene).agg(F.count(c).alias(name)), [gene])
    return g.select(gene, "n_rows", "n_variants", "n_loci", F.col("top.reg_rsid").alias("top_rsid"), F.col("top.contribution").alias("top_contribution"), "effective_n", "entropy", "total", "concordant_fraction")


def cross_context(contrib: DataFrame, contexts: DataFrame) -> DataFrame:
    """Every contribution in every context. Contexts (cell types by disease) are counted first: up to CONTEXT_ROWS they travel
    as one array, beyond that contributions are dealt to numbered blocks of contexts."""
    cols = contexts.columns
    n = contexts.count()
    blocks = max(1, -(-n // CONTEXT_ROWS))
    numbered = contexts.withColumn("__block", F.pmod(F.xxhash64(*cols), F.lit(blocks)).cast("int"))
    if blocks == 1:
        packed = contexts.agg(F.collect_list(F.struct(*cols)).alias("__ctx"))  # CONTEXT_ROWS at most
        return contrib.join(F.broadcast(packed)).select(*contrib.columns, F.explode("__ctx").alias("__c")).select(*contrib.columns, "__c.*")
    spread = contrib.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return spread.join(numbered, "__block").drop("__block")


def deconvolve(contrib: DataFrame, contexts: DataFrame, context: list[str] = ("cell_type", "disease"), gene: str = "gene") -> DataFrame:
    """Contribution times the context's activity, its share and rank inside the context, and its gene's share there."""
    context = list(context)
    d = cross_context(contrib, contexts).withColumn("value", F.col("contribution") * F.col("cscore"))
    d = d.withColumn("__a", F.abs("value"))
    d = share(share(d, "__a", context, "context_share"), "__a", [*context, gene], "gene_share")
    return unique_rank(d, "__a", context, [gene, "reg_rsid", "gwas_rsid"], "context_rank").drop("__a")


def deconvolve_rollup(df: DataFrame, level: list[str], context: list[str] = ("cell_type", "disease")) -> DataFrame:
    """Sums by context and level (genes, variants of genes, or peaks) with share and rank in the context."""
    context, level = list(context), list(level)
    g = df.groupBy(*context, *level).agg(F.sum("value").alias("value"), F.sum(F.abs("value")).alias("abs_value"), F.count("*").alias("n_rows"))
    return unique_rank(share(g, "abs_value", context), "abs_value", context, level)


def deconvolve_sums(contrib: DataFrame, contexts: DataFrame, level: list[str], context: list[str] = ("cell_type", "disease")) -> DataFrame:
    """`deconvolve_rollup` of `deconvolve`, without a row a contribution and context: a context scales all contributions of
    a level alike, so they are summed by level first and only the sums meet the contexts."""
    context, level = list(context), list(level)
    s = contrib.groupBy(*level).agg(F.sum("contribution").alias("__s"), F.sum(F.abs("contribution")).alias("__a"), F.count("*").alias("__n"))
    g = cross_context(s, contexts).groupBy(*context, *level)
    g = g.agg(F.sum(F.col("__s") * F.col("cscore")).alias("value"), F.sum(F.col("__a") * F.abs("cscore")).alias("abs_value"), F.sum("__n").alias("n_rows"))
    return unique_rank(share(g, "abs_value", context), "abs_value", context, level)


def network_tables(df: DataFrame, context: str = "cell_type") -> tuple[DataFrame, DataFrame]:
    """Typed nodes and summed edges of variant -> gene -> context."""
    kind = lambda t, c: F.concat(F.lit(f"{t}:"), F.col(c))
    nodes = [df.select(kind(t, c).alias("node_id"), F.lit(t).alias("kind"), F.col(c).alias("name")) for t, c in (("variant", "reg_rsid"), ("gene", "gene"), ("context", context))]
    edges = [df.select(kind(a, x).alias("source"), kind(b, y).alias("target"), F.col("value")) for (a, x), (b, y) in ((("variant", "reg_rsid"), ("gene", "gene")), (("gene", "gene"), ("context", context)))]
    n = nodes[0].union(nodes[1]).union(nodes[2]).where("name is not null").dropDuplicates(["node_id"])
    e = edges[0].union(edges[1]).where("source is not null and target is not null").groupBy("source", "target").agg(F.sum("value").alias("value"), F.count("*").alias("n"))
    return n, e
