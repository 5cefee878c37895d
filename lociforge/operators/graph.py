"""Protein networks: cleaning, random walk with restart, cross-validated propagation, subgraphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.columns import clean_gene
from .shared import checkpointed
from .ordered import value_totals
from .select import assign_folds, top_n
from .stats import binary_metrics, regression_metrics
from .walk import packed_walk


def build_graph(edges: DataFrame, u: str = "gene_u", v: str = "gene_v") -> tuple[DataFrame, DataFrame]:
    """Undirected edges (u, v), u < v, without loops or repeats; nodes (gene, degree, log_degree, node_id by name)."""
    e = edges.select(clean_gene(F.col(u)).alias("a"), clean_gene(F.col(v)).alias("b")).where("a <> b")
    e = e.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    n = e.select(F.explode(F.array("u", "v")).alias("gene")).groupBy("gene").agg(F.count("*").alias("degree"))
    n = value_totals(n, [], "gene", {"degree": F.first("degree"), "__i": F.count("*")})
    return e, n.select("gene", "degree", F.log1p("degree").alias("log_degree"), (F.col("__i_upto") - 1).alias("node_id"))


def rwr(edges: DataFrame, seeds: DataFrame, alphas: list[float] = (0.3,), signals: list[str] = ("s",), keys: list[str] = (), tol: float = 1e-8, max_iter: int = 500) -> DataFrame:
    """Random walk with restart: f <- alpha s + (1 - alpha) D^-1 A f, for all signals, keys (folds: few) and alphas together.

    `seeds` has gene, the keys and the signals. Returns (keys, alpha, gene, signals) of every node that any key reached, to
    within tol times the size of f, or after max_iter steps if those are too few for that. A node has all its numbers in
    one vector, whose walk is `walk.packed_walk`.
    """
    keys, signals, alphas, spark = list(keys), list(signals), list(map(float, alphas)), edges.sparkSession
    n = len(signals)
    groups = [tuple(r) for r in seeds.select(*keys).distinct().orderBy(*keys).collect()] if keys else [()]
    place = spark.createDataFrame([(*g, i) for i, g in enumerate(groups)], StructType([*(seeds.schema[k] for k in keys), StructField("__k", IntegerType())]))
    s = seeds.join(F.broadcast(place), keys) if keys else seeds.withColumn("__k", F.lit(0))  # a row a fold
    s = s.groupBy("gene").agg(F.collect_list(F.struct("__k", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"s{j}") for j, c in enumerate(signals)))).alias("r"))  # a row a fold
    width = len(groups) * n

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = b.column("r")
            row, at, x = r.value_parent_indices().to_numpy(), r.flatten().field(0).to_numpy(), np.zeros((len(r), width))
            for j in range(n):
                np.add.at(x, (row, at * n + j), r.flatten().field(j + 1).to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("gene"), pa.array(list(np.tile(x, len(alphas))), pa.list_(pa.float64()))], ["gene", "vec"])

    f = packed_walk(edges, s.mapInArrow(dense, "gene string, vec array<double>"), np.repeat(alphas, width).tolist(), tol, max_iter)
    rows = F.explode(F.transform(F.sequence(F.lit(0), F.lit(len(groups) * len(alphas) - 1)), lambda i: F.struct(i.alias("i"), *(F.get("vec", i * n + j).alias(f"s{j}") for j in range(n)))))
    f = f.select("gene", rows.alias("r")).select("gene", F.pmod("r.i", F.lit(len(groups))).alias("__k"), F.get(F.array(*map(F.lit, alphas)), F.floor(F.col("r.i") / len(groups)).cast("int")).alias("alpha"), *(F.col(f"r.s{j}").alias(c) for j, c in enumerate(signals)))
    return (f.join(F.broadcast(place), "__k") if keys else f).select(*keys, "alpha", "gene", *signals)


def rwr_predict(edges: DataFrame, labels: DataFrame, alphas: list[float] = (0.3,), keys: list[str] = (), eps: float = 1e-12, with_mass: bool = False, **how) -> DataFrame:
    """Signed prediction: the walk of confidence * beta over that of confidence (kept as mass if asked for)."""
    seeds = labels.select(*keys, "gene", (F.col("confidence") * F.col("beta")).alias("signed"), F.col("confidence").alias("mass"))
    f = rwr(edges, seeds, alphas, ["signed", "mass"], keys, **how)
    return f.withColumn("pred", F.col("signed") / (F.col("mass") + eps)).drop("signed", *([] if with_mass else ["mass"]))


def rwr_cv(edges: DataFrame, labels: DataFrame, alphas: list[float], k: int = 5, repeats: int = 1, seed: int = 1, **how) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold predictions (repeat, fold, alpha, gene, beta, pred) and metrics of each alpha, best first: the
    largest auroc of the direction, then the largest sign accuracy, then the least rmse."""
    folds = checkpointed(assign_folds(labels, ["gene"], k, repeats, seed))
    held = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("held")
    train = folds.select("*", held).where("held <> fold").select("repeat", "held", "gene", "beta", "confidence")
    pred = rwr_predict(edges, train, alphas, ["repeat", "held"], **how)
    test = folds.select("repeat", F.col("fold").alias("held"), "gene", "beta").crossJoin(F.broadcast(labels.sparkSession.createDataFrame([(float(a),) for a in alphas], "alpha double")))
    oof = test.join(pred, ["repeat", "held", "alpha", "gene"], "left").na.fill(0.0, ["pred"]).withColumnRenamed("held", "fold")
    direction = binary_metrics(oof.withColumn("risk", (F.col("beta") > 0).cast("int")), "risk", "pred", ["alpha"]).select("alpha", F.col("auroc").alias("auroc_direction"))
    m = regression_metrics(oof, "beta", "pred", ["alpha"]).join(direction, "alpha")
    return oof, m.orderBy(F.desc("auroc_direction"), F.desc("sign_accuracy"), "rmse", "alpha")


def module_subgraph(edges: DataFrame, modules: DataFrame, top: int = 80) -> DataFrame:
    """Edges inside each module among its `top` genes by degree there."""
    m = modules.select("gene", "module_id")
    a, b = (m.select(F.col("gene").alias(c), F.col("module_id")) for c in ("u", "v"))
    inside = edges.join(a, "u").join(b, ["v", "module_id"])
    deg = inside.select("module_id", F.explode(F.array("u", "v")).alias("gene")).groupBy("module_id", "gene").agg(F.count("*").alias("degree"))
    keep = top_n(deg, ["module_id"], [F.desc("degree"), F.col("gene")], top).select("module_id", "gene")
    out = inside.join(keep.withColumnRenamed("gene", "u"), ["module_id", "u"], "left_semi")
    return out.join(keep.withColumnRenamed("gene", "v"), ["module_id", "v"], "left_semi").select("module_id", "u", "v")
