"""The genomics operators on small hand-made tables: ties, nulls, empty and single-row groups, and brute force."""

import math
import random
from unittest.mock import MagicMock

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociforge.functions import columns as c
from lociforge.functions import tails
from lociforge.operators import cells, contrib, effects, graph, linkage, meta, models, programs, ranges, select, stats
from lociforge.sources import tables

SF = "/root/testdata/sf0.001"


def rows(df, *cols):
    return sorted((tuple(x) for x in (df.select(*cols) if cols else df).collect()), key=str)


def one(spark, **values):
    cols = [F.lit(v).alias(k) for k, v in values.items()]
    return spark.range(1).select(*cols)


# --- columns and tails


def test_keys_and_cleaning(spark):
    d = spark.createDataFrame([("CHR1", 5, "a", "t", "rs1;rs2", " brca1 ", "yes"), ("chrX.0", 6, "AC", "G", ".", "NA", "no"), (None, None, None, None, None, None, None)], "chrom string, pos int, ref string, alt string, ids string, gene string, flag string")
    got = d.select(
        c.norm_chrom(F.col("chrom")), c.variant_key(*map(F.col, ("chrom", "pos", "ref", "alt"))), c.variant_key(*map(F.col, ("chrom", "pos", "ref", "alt")), style="colon"), c.is_snv(F.col("ref"), F.col("alt")),
        c.first_rsid(F.col("ids")), c.clean_gene(F.col("gene")), c.parse_bool(F.col("flag")), c.chrom_split(F.col("chrom")),
    ).collect()
    assert tuple(got[0]) == ("chr1", "chr1_5_A_T", "1:5:A:T", True, "rs1", "BRCA1", True, "test")
    assert tuple(got[1])[:6] == ("chrX", "chrX_6_AC_G", "X:6:AC:G", False, None, None)
    assert tuple(got[2])[:6] == (None, None, None, False, None, None)


def test_labels_and_ids(spark):
    d = one(spark, x="a||b; c,d/e", y="DHS:12", z="Control", w="x", p="pre_v")
    got = d.select(c.labels(F.col("x")), c.norm_dhs_id(F.col("y")), c.norm_group(F.col("z")), c.num(F.col("w")), c.strip_prefix(F.col("p"), "pre_"), c.abbreviate(F.lit("B cell; T cell"), {"b cell": "B"}), c.safe_name(F.lit(" a b/c ")), c.parse_vid(F.lit("chr2_7_A_C"))).first()
    assert got[:7] == (["a", "b", "c", "d", "e"], "12.0", "normal", None, "v", "B+T cell", "a_b_c") and tuple(got[7]) == ("chr2", 7, "A", "C")


def test_normal_tail(spark):
    zs = [0.0, 0.1, 1.0, -1.96, 5.0, 20.0, 35.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select(tails.two_sided_p(F.col("z"))).collect()
    for z, x in zip(zs, got, strict=True):
        assert x[0] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=2e-7)


def test_chi2_and_t_tails(spark):
    cases = [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (18.307038053275146, 10, 0.05), (100.0, 2, math.exp(-50)), (0.0, 3, 1.0)]
    got = spark.createDataFrame([(x, float(n)) for x, n, _ in cases], "x double, n double").select(tails.chi2_tail(F.col("x"), F.col("n"))).collect()
    assert [g[0] for g in got] == pytest.approx([p for *_, p in cases], rel=1e-6)
    cases = [(12.706204736432095, 1, 0.05), (2.2281388519649385, 10, 0.05), (1.0, 1, 0.5), (0.0, 5, 1.0)]
    got = spark.createDataFrame([(x, float(n)) for x, n, _ in cases], "x double, n double").select(tails.t_two_sided_p(F.col("x"), F.col("n"))).collect()
    assert [g[0] for g in got] == pytest.approx([p for *_, p in cases], rel=1e-5)


def test_tracks(spark):
    d = one(spark, k=1).withColumn("d", F.array(F.lit(1.0), F.lit(-3.0), F.lit(3.0), F.lit(float("nan"))))
    x = effects.reduce_tracks(d).first()
    assert (x["mean_d"], x["maxabs_d"], x["sumabs_d"], x["top_track"], x["top_value"]) == (0.25, 3.0, 7.0, 2, -3.0)
    assert x["mean_d_std"] == pytest.approx(np.std([1, -3, 3, 0], ddof=1))


# --- joins


@pytest.mark.parametrize("bin_size", [1, 7, 64])
def test_range_joins_equal_brute_force(spark, bin_size):
    r = random.Random(bin_size)
    pts = [(f"c{r.randrange(2)}", r.randrange(120), i) for i in range(80)]
    spans = [(f"c{r.randrange(2)}", s := r.randrange(110), s + r.randrange(0, 30), i) for i in range(40)]
    p, s = spark.createDataFrame(pts, "chrom string, pos long, p long"), spark.createDataFrame(spans, "chrom string, start long, end long, s long")
    want = sorted((i, j) for ch, x, i in pts for c2, a, b, j in spans if ch == c2 and a < x <= b)
    assert rows(ranges.interval_join(p, s, bin_size=bin_size), "p", "s") == sorted(want, key=str)
    want = sorted((i, j) for ch, x, i in pts for c2, a, b, j in spans if ch == c2 and b >= x - 9 and a <= x + 8)
    assert rows(ranges.window_overlap_join(p, s, 9, 8, start="start", end="end", bin_size=bin_size), "p", "s") == sorted(want, key=str)


def test_linkage_bounds(spark):
    ld = spark.createDataFrame([("a", "b", 0.9, 0.8), ("a", "c", 0.95, 0.85), ("b", "a", 0.9, 0.99)], "variant1 string, variant2 string, r double, r2 double")
    q, g = spark.createDataFrame([("a",)], "vid string"), spark.createDataFrame([("b", 0.01), ("c", 0.5), ("a", 0.2)], "vid string, pval double")
    assert rows(linkage.ld_link(q, g, ld), "gwas_vid", "r2") == [("a", 1.0), ("b", 0.8), ("c", 0.85)]
    assert linkage.ld_best_proxy(q, g, ld).first()["gwas_vid"] == "a"  # 0.8 is not above the bound


def test_ld_prune_follows_chains(spark):
    links = spark.createDataFrame([("q", f"n{i}", 0.9 - i / 100) for i in range(12)] + [("q", "far", 0.5), ("z", "n3", 0.1)], "qtl string, gwas_vid string, pval double")
    adj = spark.createDataFrame([x for i in range(11) for x in ((f"n{i}", f"n{i + 1}"), (f"n{i + 1}", f"n{i}"))], "u string, v string")
    assert rows(linkage.ld_prune(links, adj, ["qtl"]), "qtl", "gwas_vid") == [("q", "far"), ("q", "n11"), ("z", "n3")]
    assert linkage.ld_prune(links.limit(0), adj, ["qtl"]).count() == 0


def test_lookup_and_flags(spark):
    d = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "a long, b string")
    m1, m2 = spark.createDataFrame([(1, "one"), (1, "uno")], "a long, v string"), spark.createDataFrame([("y", "two")], "b string, v string")
    assert rows(linkage.lookup_two_keys(d, m1, "a", m2, "b", ["v"]), "a", "v", "linked") == [(1, "one", True), (2, "two", True), (3, None, False)]
    assert rows(linkage.flag_member(d, m1, ["a"], "hit"), "a", "hit") == [(1, True), (2, False), (3, False)]


# --- selection


def test_coalesce_positions_golden(spark):
    d = spark.createDataFrame([("1", p) for p in (100, 150, 200, 60000, 60050, 60050)], "chrom string, pos long")
    assert rows(select.coalesce_positions(d, 1000), "start", "end", "n") == [(100, 200, 3), (60000, 60050, 2)]


def test_avg_rank_with_ties_and_nulls(spark):
    d = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 7.0), (4, None)], "i long, x double")
    assert rows(select.avg_rank(d, "x"), "i", "rank") == [(1, 1.5), (2, 1.5), (3, 3.0), (4, None)]


def test_sampling_sizes(spark):
    d = spark.range(1000).selectExpr("id", "'s' as s", "case when id < 900 then 'a' else 'b' end as g")
    got = {x["g"]: x["n"] for x in select.balanced_sample(d, ["s"], "g", ["id"], cap=400).groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 300, "b": 100}
    m = select.match_controls(d, ["s"], "g", ["id"], "b", "a").groupBy("g").count().collect()
    assert {x["g"]: x["count"] for x in m} == {"a": 100, "b": 100}
    f = select.assign_folds(d, ["id"], 3, 2).groupBy("repeat", "fold").count().collect()
    assert len(f) == 6 and {x["count"] for x in f} == {333, 334}
    b = select.bootstrap(d.limit(50), [], 4, ["id"]).groupBy("boot").count().collect()
    assert [x["count"] for x in b] == [50] * 4
    p = select.permute_labels(d, ["id"], "g", 2).groupBy("perm", "g").count().collect()
    assert sorted((x["perm"], x["g"], x["count"]) for x in p) == [(0, "a", 900), (0, "b", 100), (1, "a", 900), (1, "b", 100)]
    s = tables.split_shards(d, "s", ["id"], 300).groupBy("shard").count().collect()
    assert sorted(x["count"] for x in s) == [250] * 4


# --- meta-analysis and tests


def test_ivw_merge_guards(spark):
    d = spark.createDataFrame([("a", 1.0, 0.5), ("a", 3.0, 1.0), ("b", 2.0, 0.3), ("c", 2.0, 0.0), ("c", None, 1.0)], "g string, beta double, se double")
    got = {x["g"]: x for x in meta.ivw_merge(d, ["g"]).collect()}
    assert set(got) == {"a", "b"} and got["a"]["beta"] == pytest.approx(1.4) and got["a"]["se"] == pytest.approx(math.sqrt(0.2)) and got["b"]["beta"] == 2.0
    g = d.selectExpr("g", "beta as mr_beta", "se as mr_se", "0.1 as mr_pvalue", "'w' as method_used")
    got = {x["g"]: x for x in meta.ivw_merge_guarded(g, ["g"]).collect()}
    assert got["c"]["mr_beta"] is None and got["c"]["n_merged"] == 0 and got["b"]["method_used"] == "w"


def test_mr_harmonise(spark):
    cols = "snp string, ea_exposure string, oa_exposure string, ea_outcome string, oa_outcome string, beta_outcome double, eaf_exposure double, eaf_outcome double"
    d = spark.createDataFrame([("same", "A", "C", "A", "C", 1.0, None, None), ("flip", "A", "C", "C", "A", 1.0, None, None), ("pal", "A", "T", "A", "T", 1.0, 0.2, 0.2), ("palx", "A", "T", "A", "T", 1.0, 0.2, 0.8), ("noeaf", "A", "T", "A", "T", 1.0, None, 0.2)], cols)
    assert rows(meta.mr_harmonise(d), "snp", "beta_outcome") == [("flip", -1.0), ("pal", 1.0), ("palx", -1.0), ("same", 1.0)]


def test_mr_estimates(spark):
    d = spark.createDataFrame([("g1", "a", 2.0, 0.1, 1.0, 0.2), ("g2", "a", 1.0, 0.1, 0.5, 0.1), ("g2", "b", -1.0, 0.1, -0.7, 0.1)] + [("g3", f"s{i}", 1.0 + i, 0.1, 0.5 * (1 + i), 0.1) for i in range(5)], "gene string, snp string, beta_exposure double, se_exposure double, beta_outcome double, se_outcome double")
    got = {(x["gene"], x["method"], x["single_snp"]): x for x in meta.mr_estimate(d, boot=20).collect()}
    assert got["g1", "Wald ratio", None]["b"] == 0.5 and got["g1", "Wald ratio", None]["se"] == 0.1
    assert got["g2", "Inverse variance weighted", None]["b"] == pytest.approx(0.6) and ("g2", "Wald ratio", "b") in got
    for m in ("Inverse variance weighted", "MR Egger", "Weighted median"):
        assert got["g3", m, None]["b"] == pytest.approx(0.5, abs=1e-9)


def test_mann_whitney_exact_and_normal(spark):
    d = spark.createDataFrame([("k", "case", 1.0), ("k", "case", 2.0), ("k", "control", 3.0), ("k", "control", 4.0), ("k", "control", 5.0), ("one", "case", 1.0)], "k string, g string, x double")
    got = {x["k"]: x for x in stats.mann_whitney(d, ["k"], "g", "x").collect()}
    assert got["k"]["u"] == 0 and got["k"]["p"] == pytest.approx(0.2) and got["k"]["rank_biserial"] == -1 and got["one"]["p"] is None


def test_bh_and_fisher(spark):
    d = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None), (5, float("nan"))], "i long, p double")
    assert [x[1] for x in rows(stats.bh_fdr(d, "p"), "i", "fdr")] == pytest.approx([0.03, 0.04, 0.04, None, None])
    assert [x[1] for x in rows(stats.bh_fdr(d, "p", nan_policy="one"), "i", "fdr")] == pytest.approx([0.05, 0.2 / 3, 0.2 / 3, 1.0, 1.0])
    t = spark.createDataFrame([(8, 2, 1, 5), (0, 0, 3, 4)], "a long, b long, c long, d long")
    got = stats.fisher_2x2(t).orderBy("a").collect()
    assert got[1]["p"] == pytest.approx(0.03496503496503495) and got[1]["odds_ratio"] == 20 and got[0]["p"] == pytest.approx(1.0)


def test_metrics_with_ties(spark):
    d = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)], "y int, p double")
    x = stats.binary_metrics(d, "y", "p").first()
    assert x["auroc"] == pytest.approx(0.625) and x["average_precision"] == pytest.approx((0.5 + 2 / 3) / 2) and x["brier"] == pytest.approx((0.01 + 0.81 + 0.25 + 0.01) / 4)


# --- network, models, contributions


def test_rwr_reaches_its_fixed_point(spark):
    e = graph.build_graph(spark.createDataFrame([("a", "b"), ("B", "c"), ("c", "d"), ("d", "d"), ("b", "A"), (None, "x")], "gene_u string, gene_v string"))[0]
    assert e.count() == 3
    f = {x["gene"]: x["s"] for x in graph.rwr(e, spark.createDataFrame([("A", 1.0)], "gene string, s double"), [0.4], tol=1e-6).collect()}
    near = {"A": ["B"], "B": ["A", "C"], "C": ["B", "D"], "D": ["C"]}
    for g in near:
        assert f[g] == pytest.approx(0.4 * (g == "A") + 0.6 * sum(f[n] for n in near[g]) / len(near[g]), abs=1e-5)


def test_ridge_equals_numpy(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((60, 3))
    y = x @ [1.0, -2.0, 0.5] + 0.3 + 0.1 * r.standard_normal(60)
    d = spark.createDataFrame([(f"g{i}", *map(float, x[i]), float(y[i])) for i in range(60)], "gene string, a double, b double, c double, y double")
    pred, coef = models.weighted_ridge(d, ["a", "b", "c"], "y", alpha=10.0, k=3)
    z = (x - x.mean(0)) / x.std(0)
    b = np.linalg.solve(z.T @ z + 10 * np.eye(3), z.T @ (y - y.mean()))
    assert [v[1] for v in rows(coef.where("fold = -1"), "feature", "coefficient")] == pytest.approx(b.tolist())
    got = {v["gene"]: v for v in pred.collect()}
    assert got["g5"]["pred"] == pytest.approx(float(z[5] @ b + y.mean())) and all(v["oof_pred"] is not None for v in got.values())


def test_contribution_shares(spark):
    d = spark.createDataFrame([("g", "r1", "w1", 3.0, 1.0, 1.0), ("g", "r2", "w1", 1.0, -1.0, 1.0), ("h", "r1", "w1", 0.0, 2.0, -1.0), ("h", "r3", "w2", 0.0, 2.0, -1.0)], "gene string, reg_rsid string, gwas_rsid string, weight double, effect double, pred double")
    got = contrib.decompose(d)
    assert rows(got, "gene", "reg_rsid", "share", "support") == [("g", "r1", 0.75, "concordant"), ("g", "r2", 0.25, "discordant"), ("h", "r1", 0.5, "discordant"), ("h", "r3", 0.5, "discordant")]
    s = {x["gene"]: x for x in contrib.decompose_summary(got).collect()}
    assert s["h"]["effective_n"] == pytest.approx(2) and s["h"]["entropy"] == pytest.approx(math.log(2))
    ctx = spark.createDataFrame([("T", "PD", 2.0), ("B", "PD", -1.0)], "cell_type string, disease string, cscore double")
    v = contrib.deconvolve(got, ctx)
    assert v.count() == 8 and [round(x[0], 9) for x in v.groupBy("cell_type").agg(F.sum("context_share")).select("sum(context_share)").collect()] == [1, 1]
    old, contrib.CONTEXT_ROWS = contrib.CONTEXT_ROWS, 1
    try:
        assert rows(contrib.cross_context(d, ctx)) == rows(d.crossJoin(ctx))
    finally:
        contrib.CONTEXT_ROWS = old
    nodes, edges = contrib.network_tables(v)
    assert nodes.count() == 7 and edges.count() == 8


# --- cells and programs


def test_pseudobulk_means_count_zeros(spark):
    m = spark.createDataFrame([(f"c{i}", "d1") for i in range(4)], "sample_id string, donor string")
    e = spark.createDataFrame([("c0", "g", 4.0), ("c1", "g", 2.0)], "sample_id string, gene string, value double")
    assert rows(cells.pseudobulk(m, e, ["donor"], 4, "mean"), "gene", "value", "n_cells") == [("g", 1.5, 4)]
    assert cells.pseudobulk(m, e, ["donor"], 5).count() == 0
    assert cells.is_count_like(e.union(e.withColumn("value", F.lit(30.0)))) and not cells.is_count_like(e.withColumn("value", F.lit(0.5))) and not cells.is_count_like(e.limit(0))


def test_gsva_prefers_the_raised_program(spark):
    r = np.random.default_rng(0)
    data = [(f"s{s}", f"g{g}", float(r.standard_normal() + (3 if s < 5 and g < 6 else 0))) for s in range(12) for g in range(30)]
    e = spark.createDataFrame(data, "sample_id string, gene string, value double")
    p = spark.createDataFrame([("up", f"g{g}") for g in range(6)] + [("few", "g1")], "program string, gene string")
    for method in ("gsva", "ssgsea", "zscore"):
        got = {x["sample_id"]: x["score"] for x in programs.gsva(e, p, method).where("program = 'up'").collect()}
        assert len(got) == 12 and min(got[f"s{i}"] for i in range(5)) > max(got[f"s{i}"] for i in range(5, 12))
    assert programs.gsva(e, p, block=4).select("sample_id").distinct().count() == 12


# --- sources


def test_sources(spark, tmp_path):
    (tmp_path / "a.vcf").write_text("##x\n#CHROM\tPOS\n1\t10\trs1\tA\tC\tq\n")
    assert rows(tables.read_variants_vcf(spark, str(tmp_path / "a.vcf"))) == [("1", 10, "rs1", "A", "C")]
    f = 'chr1\th\t{}\t{}\t{}\t.\t-\t.\tgene_id "E1"; transcript_id "{}"; gene_name "N1";\n'
    (tmp_path / "a.gtf").write_text("#c\n" + f.format("transcript", 1, 50, "T1") + f.format("transcript", 1, 90, "T2") + f.format("exon", 61, 90, "T2") + f.format("exon", 1, 10, "T2") + 'chr1\th\tgene\t1\t90\t.\t-\t.\tgene_id "E1";\nbad line\n')
    g = tables.gene_geometry(tables.read_gtf(spark, str(tmp_path / "a.gtf"))).first()
    assert (g["gene_name"], g["transcript_id"], g["tss"], g["tes"], g["exonic_length"], len(g["exons"])) == ("N1", "T2", 90, 1, 40, 2)
    p = spark.createDataFrame([("s", "a"), ("s", "b"), ("t", "c")], "program string, gene string")
    tables.write_gmt(p, str(tmp_path / "gmt"))
    assert rows(tables.read_gmt(spark, str(tmp_path / "gmt")), "program", "gene") == [("s", "a"), ("s", "b"), ("t", "c")]
    (tmp_path / "w.tsv").write_text("gene_name\tx\ty\nA\t1\t\nB\tz\t2\n")
    assert rows(tables.read_expression_wide(spark, str(tmp_path / "w.tsv"))) == [("A", "x", 1.0), ("B", "y", 2.0)]
    for text, n in (("a,b\n1,2\n", 2), ("a b\n1 2\n", 2), ("x\ny\n", 1)):
        (tmp_path / "t.txt").write_text(text)
        assert len(tables.read_table_auto(spark, str(tmp_path / "t.txt")).columns) == n
    (tmp_path / "m.tsv").write_text("path\nm1.parquet\n")
    p.write.parquet(str(tmp_path / "m1.parquet"))
    assert tables.read_manifest(spark, str(tmp_path / "m.tsv")).count() == 3


def test_append_new_resumes(spark, tmp_path):
    path = str(tmp_path / "out")
    tables.append_new(spark.range(5), path, ["id"])
    tables.append_new(spark.range(8), path, ["id"])
    assert rows(spark.read.parquet(path)) == [(i,) for i in range(8)]


def test_checks(spark):
    d = spark.range(3)
    ok = tables.check(d, {"some": (F.count("*") > 0, "critical"), "many": (F.count("*") > 10, "warn")})
    assert rows(ok, "rule", "ok") == [("many", False), ("some", True)]
    with pytest.raises(tables.CheckFailed):
        tables.check(d, {"many": (F.count("*") > 10, "critical")})


def test_streaming_append(spark, tmp_path):
    from lociforge.streaming.append import append_unseen

    spark.range(4).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    append_unseen(s, str(tmp_path / "out"), ["id"], str(tmp_path / "ck")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


# --- entry points


def test_entry_points_have_matching_names(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_queries_read_whole_views(spark):
    from lociforge.plans import queries as q
    from lociforge.plans import views

    cells_ = views.view(spark, SF, "v_cell").select("cell_type", "grp", "score").collect()
    table = {t: [sum(x["cell_type"] == t and x["grp"] == g and (x["score"] > 60) == hi for x in cells_) for g in ("case", "control") for hi in (True, False)] for t in {x["cell_type"] for x in cells_}}
    fisher = {x["cell_type"]: x for x in q.QUERIES["t5_fisher_all"](spark, SF).collect()}
    assert {t: [x[k] for k in "abcd"] for t, x in fisher.items()} == table
    for t, (a, b, c_, d) in table.items():
        ways = {k: math.comb(a + b, k) * math.comb(c_ + d, a + c_ - k) for k in range(max(0, a - d), min(a + b, a + c_) + 1)}
        assert fisher[t]["p"] == pytest.approx(sum(w for w in ways.values() if w <= ways[a]) / sum(ways.values()), abs=2e-6)
    sizes = {x["cell_type"]: (x["n_case"], x["n_control"]) for x in q.QUERIES["r2_matched_sizes_all"](spark, SF).collect()}
    assert sizes == {t: (a + b, min(a + b, c_ + d)) for t, (a, b, c_, d) in table.items()}
    labels = {}
    for x in views.view(spark, SF, "v_mr").select("gene", "beta").collect():
        labels.setdefault(x["gene"], []).append(x["beta"])
    got = {x["gene"]: x["y"] for x in q._features(lambda v: views.view(spark, SF, v)).collect()}
    assert got == pytest.approx({g: sum(b) / len(b) for g, b in labels.items()})


def test_walk_and_mr_queries_are_whole(spark):
    from lociforge.plans import queries as q
    from lociforge.plans import views

    edges = {(x["u"], x["v"]) for x in graph.build_graph(views.view(spark, SF, "v_ppi"))[0].collect()}
    seed = {x["gene"]: float(x["tx_start"] % 7 == 0) for x in views.view(spark, SF, "v_gene").collect()}
    names = sorted({g for e in edges for g in e} | set(seed))
    a, s = np.zeros((len(names), len(names))), np.array([seed.get(g, 0.0) for g in names])
    for u, w in edges:
        a[names.index(u), names.index(w)] = a[names.index(w), names.index(u)] = 1
    a /= np.maximum(a.sum(1, keepdims=True), 1)
    want = dict(zip(names, np.linalg.solve(np.eye(len(names)) - 0.7 * a, 0.3 * s), strict=True))
    got = {x["gene"]: x["f"] for x in q.QUERIES["m2_rwr"](spark, SF).collect()}
    assert got == pytest.approx({g: want[g] for g in got}, abs=2e-6) and all(want[g] == 0 for g in set(names) - set(got))
    snps = {}
    for x in q._mr_rows(lambda v: views.view(spark, SF, v)).collect():
        snps[x["gene"]] = snps.get(x["gene"], 0) + 1
    mr = q.QUERIES["t14_mr_all"](spark, SF).collect()
    assert {x["gene"]: x["nsnp"] for x in mr} == snps
    assert all(x["se"] > 0 for x in mr if x["method"] == "Weighted median") and any(n >= 3 for n in snps.values())


def test_queries_call_operators_in_full(monkeypatch):
    from lociforge.plans import queries as q
    from lociforge.plans import registry

    seen, df = {}, MagicMock()
    monkeypatch.setattr(registry, "tidy", lambda x: x)
    monkeypatch.setattr(registry, "view", lambda *a: df)
    monkeypatch.setattr(q, "F", MagicMock())
    monkeypatch.setattr(graph, "build_graph", lambda *a: (df, df))
    monkeypatch.setattr(linkage, "flag_member", lambda *a: df)
    monkeypatch.setattr(graph, "rwr_cv", lambda *a, **k: seen.update(m3=(a[2:], k)) or (df, df))
    monkeypatch.setattr(stats, "gsea", lambda *a, **k: seen.update(t10=k) or df)
    q.QUERIES["m3_rwr_cross_validation"](None, SF)
    q.QUERIES["t10_gsea"](None, SF)
    assert seen == {"m3": (([0.1, 0.2, 0.3, 0.5, 0.7], 5, 5), {}), "t10": {}}


def test_walk_ridge_and_permutation_control(spark):
    genes = [f"G{i}" for i in range(12)]
    edges = spark.createDataFrame([(genes[i], genes[(i + d) % 12]) for i in range(12) for d in (1, 3)], "u string, v string")
    features = spark.createDataFrame([(g, float(i % 5), None if i == 2 else float(i)) for i, g in enumerate(genes)], "gene string, x double, z double")
    labels = spark.createDataFrame([(g, (-1.0) ** i * (1 + i / 7), None if i == 3 else 1.0) for i, g in enumerate(genes[:10])] + [("G11", None, 1.0)], "gene string, beta double, confidence double")
    oof, coef = models.walk_ridge(edges, features, labels, ["x", "z"], k=2, repeats=2, max_iter=20)
    got = oof.collect()
    assert len(got) == 20 and all(0 < x["oof_prob"] < 1 and (x["oof_prob"] > 0.5) == (x["oof_pred"] > 0) for x in got)
    assert coef.count() == 2 * 2 * 4
    null, seen = models.permutation_control(edges, features, labels, ["x", "z"], 0.9, n=20, k=2, max_iter=20)
    rows, s = null.collect(), seen.first()
    assert sorted(x["permutation"] for x in rows) == list(range(1, 21)) and s["n_permutations"] == 20
    assert s["empirical_p"] == pytest.approx((1 + sum(x["auroc"] >= 0.9 for x in rows)) / 21)


def test_support_tiers_without_optional_columns(spark):
    d = spark.createDataFrame([("a", False, 2.0, 0.9, 1.0), ("b", False, -1.0, None, None), ("c", None, 0.5, 0.5, -1.0), ("d", True, 3.0, 0.8, 1.0)], "gene string, is_seed boolean, raw_pred_beta_score double, calibrated_prob_risk double, rwr_pred_beta double")
    got = {x["gene"]: (x["pred_direction"], x["support_tier"], x["rwr_agree"]) for x in models.support_tiers(d).collect()}
    assert got == {"a": ("risk", "Tier 3", True), "b": ("protective", "Tier 3", True), "c": ("risk", "Tier 3", False), "d": ("risk", "MR seed", True)}
    full = models.support_tiers(d.selectExpr("*", "1 as n_brain_or_neural_dhs_snvs"))
    assert {x["gene"]: x["support_tier"] for x in full.collect()} == {"a": "Tier 1", "b": "Tier 1", "c": "Tier 3", "d": "MR seed"}
    assert models.support_tiers(d.limit(0)).count() == 0
