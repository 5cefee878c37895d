"""Key joins, lookups and linkage-disequilibrium operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .select import best_per_key
from .shared import checkpointed


def join_checked(left: DataFrame, right: DataFrame, on: list[str], checks: list[tuple[str, str]], null_ok: bool = False) -> DataFrame:
    """Inner join, then only rows whose checked pairs of columns agree; with null_ok a missing side agrees."""
    cond = F.lit(True)
    for a, b in checks:
        same = F.col(a) == F.col(b)
        cond = cond & (same | F.col(a).isNull() | F.col(b).isNull() if null_ok else same)
    return left.join(right, on).where(cond)


def gwas_peak_join(gwas: DataFrame, peaks: DataFrame, key: str = "rsid", p: str = "pval", peak: str = "identifier", signal: str = "mean_signal") -> DataFrame:
    """Each variant's strongest association with its best peak, then one row per peak: the smallest p."""
    g = best_per_key(gwas, [key], [F.col(p), *(c for c in gwas.columns if c != p)])
    q = best_per_key(peaks, [key], [F.col(signal).desc(), peak])
    return best_per_key(g.join(q, key), [peak], [F.col(p), key])


def attach(df: DataFrame, attrs: DataFrame, on: list[str], order: list[Column] | None = None) -> DataFrame:
    """Left join of attributes, first made unique by key (in the given order, else by all columns)."""
    rest = [c for c in attrs.columns if c not in on]
    return df.join(best_per_key(attrs, on, order or [F.col(c) for c in rest] or [F.lit(1)]), on, "left")


def semi(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on), on, "left_semi")


def anti(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on), on, "left_anti")


def flag_member(df: DataFrame, keys: DataFrame, on: list[str], name: str) -> DataFrame:
    d = keys.select(*on).distinct().withColumn(name, F.lit(True))
    return df.join(d, on, "left").na.fill(False, [name])


def drop_ambiguous(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Without the keys that have more than one label."""
    many = df.groupBy(*keys).agg(F.min(label).alias("lo"), F.max(label).alias("hi")).where("lo <> hi")
    return anti(df, many, keys)


def join_predictions(pred: DataFrame, reg: DataFrame) -> DataFrame:
    """Joined on chrom, pos, ref, alt, and rsid if both sides have it."""
    on = ["chrom", "pos", "ref", "alt", *(["rsid"] if "rsid" in pred.columns and "rsid" in reg.columns else [])]
    return pred.join(reg, on)


def lookup_two_keys(df: DataFrame, by_first: DataFrame, key1: str, by_second: DataFrame, key2: str, cols: list[str], flag: str = "linked") -> DataFrame:
    """Values by the first key, else by the second, else null; the flag tells whether either key was found. Each map's
    first row by key is used."""
    out = df
    for i, (m, k) in enumerate(((by_first, key1), (by_second, key2))):
        m = best_per_key(m.select(k, *cols), [k], [F.col(c) for c in cols])
        out = out.join(m.select(k, F.struct(*cols).alias(f"__hit{i}")), k, "left")
    hit = F.coalesce("__hit0", "__hit1")
    return out.withColumns({**{c: hit[c] for c in cols}, flag: hit.isNotNull()}).drop("__hit0", "__hit1")


def ld_link(qtl: DataFrame, gwas: DataFrame, ld: DataFrame, r2: float = 0.8) -> DataFrame:
    """(qtl_vid, gwas_vid, r, r2): pairs whose first variant is a QTL and second a GWAS variant with r2 at least the bound,
    the largest r2 of each, and every QTL variant that is a GWAS variant itself with 1."""
    q, g = qtl.select(F.col("vid").alias("qtl_vid")).distinct(), gwas.select(F.col("vid").alias("gwas_vid")).distinct()
    edges = ld.where(F.col("r2") >= r2).select(F.col("variant1").alias("qtl_vid"), F.col("variant2").alias("gwas_vid"), "r", "r2")
    edges = edges.join(q, "qtl_vid", "left_semi").join(g, "gwas_vid", "left_semi").select("qtl_vid", "gwas_vid", "r", "r2")
    own = q.join(g, F.col("qtl_vid") == F.col("gwas_vid")).select("qtl_vid", "gwas_vid", F.lit(1.0).alias("r"), F.lit(1.0).alias("r2"))
    best = edges.union(own).groupBy("qtl_vid", "gwas_vid").agg(F.max(F.struct("r2", "r")).alias("x"))
    return best.select("qtl_vid", "gwas_vid", "x.r", "x.r2")


def ld_best_proxy(reg: DataFrame, gwas: DataFrame, ld: DataFrame, r2: float = 0.8) -> DataFrame:
    """For each regulatory variant the linked GWAS variant of the smallest p, r2 strictly above the bound; itself counts with 1."""
    v, g = reg.select(F.col("vid").alias("reg_vid")).distinct(), gwas.select(F.col("vid").alias("gwas_vid"), "pval")
    edges = ld.where(F.col("r2") > r2).select(F.col("variant1").alias("reg_vid"), F.col("variant2").alias("gwas_vid"), "r", "r2")
    edges = edges.join(v, "reg_vid", "left_semi")
    own = v.select("reg_vid", F.col("reg_vid").alias("gwas_vid"), F.lit(1.0).alias("r"), F.lit(1.0).alias("r2"))
    met = edges.select("reg_vid", "gwas_vid", "r", "r2").union(own).join(g, "gwas_vid")
    return best_per_key(met, ["reg_vid"], [F.col("pval"), F.col("r2").desc(), F.col("gwas_vid")])


def ld_adjacency(ld: DataFrame, nodes: DataFrame, r2: float = 0.01) -> DataFrame:
    """(u, v, r2) in both directions among the given variants (column vid), the largest r2 of a pair."""
    n = nodes.select("vid").distinct()
    e = ld.where((F.col("r2") >= r2) & (F.col("variant1") != F.col("variant2")))
    e = e.join(n, e.variant1 == n.vid, "left_semi").join(n, F.col("variant2") == n.vid, "left_semi")
    both = e.select(F.col("variant1").alias("u"), F.col("variant2").alias("v"), "r2").union(e.select("variant2", "variant1", "r2"))
    return both.groupBy("u", "v").agg(F.max("r2").alias("r2"))


def _star(edges: DataFrame, keys: list[str], large: bool) -> DataFrame:
    """One star step over edges (keys, u, v), u > v. With m the least of a node and its neighbours, the larger neighbours are
    linked to m (large), or the smaller ones and the node itself. Minima are combined before the shuffle."""
    near = edges.select(*keys, "u", "v")
    if large:
        near = near.union(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
    low = near.groupBy(*keys, "u").agg(F.min("v").alias("m"))
    met = near.join(low, [*keys, "u"]).withColumn("m", F.least("u", "m"))
    new = met.where("v > u").select(*keys, F.col("v").alias("u"), F.col("m").alias("v")) if large else met.select(*keys, F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return new.where("u <> v").distinct()


def keyed_components(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, u, block): the least node that each node with an edge (keys, u, v) reaches inside its keys. Stars are contracted
    over all keys at once, in a number of rounds that grows as the logarithm of the longest chain."""
    keys, seen = list(keys), None
    now = checkpointed(edges.select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen:
            break
        seen, now = mark, checkpointed(_star(_star(now, keys, True), keys, False))
    return now.select(*keys, "u", F.col("v").alias("block")).union(now.select(*keys, F.col("v").alias("u"), F.col("v").alias("block")).distinct())


def ld_prune(links: DataFrame, adjacency: DataFrame, keys: list[str], node: str = "gwas_vid", p: str = "pval") -> DataFrame:
    """Within each key the linked variants fall into connected blocks of the adjacency; the smallest p of each block stays."""
    nodes = links.select(*keys, F.col(node).alias("u")).distinct()
    a, b = nodes.alias("a"), nodes.select(*keys, F.col("u").alias("v"))
    edges = a.join(adjacency.select("u", "v"), "u").join(b, [*keys, "v"]).select(*keys, "u", "v")
    block = nodes.join(keyed_components(edges, keys), [*keys, "u"], "left").withColumn("block", F.coalesce("block", "u"))
    met = links.join(block.withColumnRenamed("u", node), [*keys, node])
    return best_per_key(met, [*keys, "block"], [F.col(p), F.col(node)]).drop("block")


def edge_ids(edges: DataFrame, nodes: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    n = nodes.select("gene", "node_id")
    a = n.select(F.col("gene").alias(u), F.col("node_id").alias(f"{u}_id"))
    b = n.select(F.col("gene").alias(v), F.col("node_id").alias(f"{v}_id"))
    return edges.join(a, u).join(b, v)


def attach_features(nodes: DataFrame, features: DataFrame, on: str = "gene", flag: str = "has_features", fill: float | None = 0.0) -> DataFrame:
    """Left join with a presence flag; missing numbers become `fill` unless it is None."""
    out = nodes.join(features.withColumn(flag, F.lit(True)), on, "left").na.fill(False, [flag])
    numeric = [f.name for f in features.schema if f.dataType.typeName() in ("double", "float", "long", "integer") and f.name != on]
    return out.na.fill(fill, numeric) if fill is not None and numeric else out


def align_matrices(tables: list[DataFrame], how: str = "outer", gene: str = "gene") -> DataFrame:
    """Long matrices one under the other; inner: only genes that all of them have. Missing values of long matrices are zeros."""
    parts = [t.withColumn("__source", F.lit(i)) for i, t in enumerate(tables)]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if how == "inner":
        common = out.select(gene, "__source").distinct().groupBy(gene).count().where(F.col("count") == len(tables))
        out = semi(out, common, [gene])
    return out.drop("__source")


def join_scores(scores: DataFrame, meta: DataFrame, on: str = "sample_id", keep: str = "first", how: str = "inner") -> DataFrame:
    """Scores with metadata; of repeated metadata rows the first or last in the order of all columns counts."""
    rest = [c for c in meta.columns if c != on]
    order = [F.col(c).asc() if keep == "first" else F.col(c).desc() for c in rest]
    return scores.join(best_per_key(meta, [on], order or [F.lit(1)]), on, how)


def scores_with_meta(scores: DataFrame, meta: DataFrame, dataset: str = "dataset", on: str = "sample_id") -> DataFrame:
    return scores.join(meta, [dataset, on])
