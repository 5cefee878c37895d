"""Queries of joins, set operators, programs, cells and Mendelian randomisation that the main file doesn't have."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import cells, contrib, effects, graph, linkage, meta, models, programs, select
from .registry import query


@query("""select v.vid, v.pos, round(v.pval, 6) + 0e0 as pval, round(x.beta, 6) + 0e0 as pred from v_variant v join (select chrom, pos, ref, case when vid % 3 = 0 then alt else ref end as alt, rsid, beta + 1 as beta from v_variant) x using (chrom, pos, ref, alt, rsid)""")
def j9_join_predictions(v):
    """Two thirds of the predictions are for another allele, and meet no variant."""
    pred = v("v_variant").selectExpr("chrom", "pos", "ref", "case when vid % 3 = 0 then alt else ref end as alt", "rsid", "beta + 1 as pred")
    return linkage.join_predictions(pred, v("v_variant").select("chrom", "pos", "ref", "alt", "rsid", "vid", "pval")).select("vid", "pos", "pval", "pred")


@query("""with n as (select distinct gene_u as gene from v_ppi), f as (select case when tx_start % 2 = 0 then gene else concat('X', gene) end as gene, avg(tx_start) as x, count(*) as n_rows from v_gene group by 1)
select n.gene, round(coalesce(x, 0), 6) + 0e0 as x, coalesce(n_rows, 0) as n_rows, x is not null as has_features from n left join f on f.gene = n.gene""")
def j15_attach_features(v):
    f = v("v_gene").withColumn("gene", F.expr("case when tx_start % 2 = 0 then gene else concat('X', gene) end")).groupBy("gene").agg(F.avg("tx_start").alias("x"), F.count("*").alias("n_rows"))
    return linkage.attach_features(v("v_ppi").select(F.col("gene_u").alias("gene")).distinct(), f)


@query("""with n as (select gene, row_number() over (order by gene) - 1 as node_id from (select distinct gene from v_gene) t) select gene_u as u, gene_v as v, a.node_id as u_id, b.node_id as v_id from v_ppi join n a on a.gene = gene_u join n b on b.gene = gene_v""")
def j16_edge_ids(v):
    genes = v("v_gene").select("gene").distinct()
    ids = select.unique_rank(genes.withColumn("one", F.lit(1)), "one", [], ["gene"], "rank").select("gene", (F.col("rank") - 1).alias("node_id"))
    return linkage.edge_ids(v("v_ppi").toDF("u", "v"), ids)


@query("""with a as (select gene, sample_id, value from v_expr), b as (select case when gene > 'g2' then gene else concat('x', gene) end as gene, sample_id + 1000000 as sample_id, value from v_expr), c as (select gene from a intersect select gene from b)
select gene, sample_id, round(value, 6) + 0e0 as value from (select * from a union all select * from b) t where gene in (select gene from c)""")
def j17_align_matrices(v):
    e = v("v_expr").withColumn("value", F.col("value").cast("double"))
    other = e.withColumns({"gene": F.expr("case when gene > 'g2' then gene else concat('x', gene) end"), "sample_id": F.col("sample_id") + 1_000_000})
    return linkage.align_matrices([e, other], "inner")


@query("""with d as (select reg_rsid, gene, max(effect) as effect from v_link group by 1, 2), l as (select reg_rsid, gwas_rsid, min(gwas_pval) as p from v_link group by 1, 2), m as (select gene, avg(beta) as pred from v_mr group by 1)
select reg_rsid, gene, gwas_rsid, round(effect, 6) + 0e0 as effect, round(p, 6) + 0e0 as p, round(pred, 6) + 0e0 as pred from d join l using (reg_rsid) join m using (gene)""")
def j19_contribution_rows(v):
    x = v("v_link")
    d = x.groupBy("reg_rsid", "gene").agg(F.max("effect").alias("effect"))
    return contrib.contribution_rows(d, x.groupBy("reg_rsid", "gwas_rsid").agg(F.min("gwas_pval").alias("p")), v("v_mr").groupBy("gene").agg(F.avg("beta").alias("pred")))


CELL_META = "m as (select distinct sample_id, cell_type, grp from v_cell)"


@query(f"""with s as (select sample_id, sum(value) as score from v_expr group by 1), {CELL_META}, k as (select *, row_number() over (partition by sample_id order by cell_type, grp) as rn from m), l as (select *, row_number() over (partition by sample_id order by cell_type desc, grp desc) as rn from m)
select 'first' as pick, sample_id, round(score, 6) + 0e0 as score, cell_type, grp from s join k using (sample_id) where rn = 1 union all select 'last', sample_id, round(score, 6) + 0e0, cell_type, grp from s join l using (sample_id) where rn = 1""")
def j20_join_scores(v):
    s = v("v_expr").groupBy("sample_id").agg(F.sum("value").cast("double").alias("score"))
    m = v("v_cell").select("sample_id", "cell_type", "grp").distinct()
    parts = [linkage.join_scores(s, m, keep=k).select(F.lit(k).alias("pick"), "sample_id", "score", "cell_type", "grp") for k in ("first", "last")]
    return parts[0].union(parts[1])


@query("""with s as (select cell_type as dataset, sample_id, avg(score) as score from v_cell group by 1, 2), m as (select case when event_id % 2 = 0 then cell_type else concat('not ', cell_type) end as dataset, sample_id, min(grp) as grp, count(*) as n from v_cell group by 1, 2)
select dataset, sample_id, round(score, 6) + 0e0 as score, grp, n from s join m using (dataset, sample_id)""")
def j21_scores_with_meta(v):
    d = v("v_cell").withColumnRenamed("cell_type", "dataset")
    m = d.withColumn("dataset", F.expr("case when event_id % 2 = 0 then dataset else concat('not ', dataset) end")).groupBy("dataset", "sample_id").agg(F.min("grp").alias("grp"), F.count("*").alias("n"))
    return linkage.scores_with_meta(d.groupBy("dataset", "sample_id").agg(F.avg("score").alias("score")), m)


MR_SIDES = """e as (select distinct rsid as snp, gene, substr('ACGT', cast(1 + vid % 4 as int), 1) as ea, substr('ACGT', cast(1 + (vid + 1 + vid % 3) % 4 as int), 1) as oa, min(beta) over (partition by rsid, gene) as b, (vid % 100) / 100e0 as f from v_qtl),
 o as (select distinct rsid as snp, case when vid % 2 = 0 then alt else ref end as ea, case when vid % 2 = 0 then ref else alt end as oa, beta as b, se, af_alt as f from v_variant),
 j as (select e.snp, e.gene, e.ea as ea1, e.oa as oa1, e.b as b1, e.f as f1, o.ea as ea2, o.oa as oa2, o.b as b2, o.se, o.f as f2 from e join o using (snp) where least(e.ea, e.oa) || greatest(e.ea, e.oa) = least(o.ea, o.oa) || greatest(o.ea, o.oa))"""


def _mr_sides(v):
    e = v("v_qtl").selectExpr("rsid as SNP", "gene", "substr('ACGT', cast(1 + vid % 4 as int), 1) as effect_allele", "substr('ACGT', cast(1 + (vid + 1 + vid % 3) % 4 as int), 1) as other_allele", "min(beta) over (partition by rsid, gene) as beta", "1.0 as se", "0.01 as pval", "(vid % 100) / 100e0 as eaf").distinct()
    o = v("v_variant").selectExpr("rsid as SNP", "case when vid % 2 = 0 then lower(alt) else ref end as effect_allele", "case when vid % 2 = 0 then ref else lower(alt) end as other_allele", "beta", "se", "pval", "af_alt as eaf")
    return meta.mr_join(meta.read_mr_side(e, "exposure", "qtl"), meta.read_mr_side(o, "outcome", "gwas"))


@query(f"with {MR_SIDES} select snp, gene, ea1 as ea_exposure, oa1 as oa_exposure, ea2 as ea_outcome, round(b1, 6) + 0e0 as beta_exposure, round(b2, 6) + 0e0 as beta_outcome, round(f2, 6) + 0e0 as eaf_outcome, 'qtl' as id_exposure from j")
def j22_s11_mr_join(v):
    return _mr_sides(v).select("snp", "gene", "ea_exposure", "oa_exposure", "ea_outcome", "beta_exposure", "beta_outcome", "eaf_outcome", "id_exposure")


@query(f"""with {MR_SIDES}, h as (select *, ea1 || oa1 in ('AT', 'TA', 'CG', 'GC') as pal, ea1 = ea2 as same, case when ea1 = ea2 then f2 else 1 - f2 end as g2 from j),
 s as (select *, case when not pal then case when same then 1 else -1 end when abs(f1 - 0.5e0) > 0.08e0 and abs(f2 - 0.5e0) > 0.08e0 then case when same = ((f1 - 0.5e0) * (g2 - 0.5e0) > 0) then 1 else -1 end end as sign from h)
select snp, gene, pal, round(b1, 6) + 0e0 as beta_exposure, round(b2 * sign, 6) + 0e0 as beta_outcome from s where sign is not null""")
def t15_mr_harmonise(v):
    d = meta.mr_harmonise(_mr_sides(v))
    return d.select("snp", "gene", F.concat("ea_exposure", "oa_exposure").isin("AT", "TA", "CG", "GC").alias("pal"), "beta_exposure", "beta_outcome")


# --- sets, windows, samples


@query("select 'low' as label, identifier, component, cast(null as double) as mean_signal from v_interval where mean_signal < 950 union all select 'high', identifier, null, round(mean_signal, 6) + 0e0 from v_interval where mean_signal >= 950")
def o1_union_labeled(v):
    d = v("v_interval")
    return select.union_labeled({"low": d.where("mean_signal < 950").select("identifier", "component"), "high": d.where("mean_signal >= 950").select("identifier", "mean_signal")}).select("label", "identifier", "component", "mean_signal")


@query("select distinct gene, tissue from v_mr")
def o2_distinct(v):
    return select.distinct_rows(v("v_mr").select("gene", "tissue"))


@query("select chrom, identifier, start, round(min(mean_signal) over (partition by chrom order by start, identifier rows unbounded preceding), 6) + 0e0 as running_min from v_interval")
def w4_running_min(v):
    return select.running_min(v("v_interval"), "mean_signal", ["start", "identifier"], ["chrom"]).select("chrom", "identifier", "start", "running_min")


@query("select chrom, cast(min(n) as bigint) as first_row, count(*) as n from (select chrom, row_number() over (order by cast(substr(chrom, 4) as int), pos, vid) as n from v_variant) t group by 1")
def w8_genomic_sort(v):
    d = select.genomic_sort(v("v_variant").groupBy("chrom").agg(F.count("*").alias("n"), F.min("pos").alias("pos")))
    place = F.monotonically_increasing_id()  # in the order of the sorted partitions
    before = F.sum("n").over(Window.orderBy("place")) - F.col("n") + 1
    return d.withColumn("place", place).select("chrom", before.alias("first_row"), "n")


@query("select cast(p as bigint) as perm, count(*) as n, round(sum(beta), 6) + 0e0 as total, round(sum(beta * beta), 6) + 0e0 as squares, cast(0 as bigint) as lost from (select avg(beta) as beta, gene from v_mr group by gene) t, (select unnest([0, 1, 2]) as p) u group by 1")
def r4_permuted_sums(v):
    d = v("v_mr").groupBy("gene").agg(F.avg("beta").alias("beta"))
    moved = select.permute_labels(d, ["gene"], "beta", 3)
    return moved.groupBy("perm").agg(F.count("*").alias("n"), F.sum("beta").alias("total"), F.sum(F.col("beta") * F.col("beta")).alias("squares"), F.count_if(F.col("gene").isNull()).alias("lost"))


@query("select cell_type, cast(b as bigint) as boot, count(*) as n, true as inside from v_cell, (select unnest([0, 1]) as b) t group by 1, 2")
def r5_bootstrap_sizes(v):
    d = v("v_cell").select("cell_type", "event_id", "score")
    ends = d.groupBy("cell_type").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    inside = F.min(F.col("score").between(F.col("lo"), F.col("hi")))
    return select.bootstrap(d, ["cell_type"], 2, ["event_id"]).join(ends, "cell_type").groupBy("cell_type", "boot").agg(F.count("*").alias("n"), inside.alias("inside"))


# --- programs


MODEL = "model as (select gene, case when avg(confidence) > 1.4e0 then 'Tier 1' when avg(confidence) > 1.35e0 then 'Tier 2' else 'Tier 3' end as support_tier, case when avg(beta) > 0 then 'risk' else 'protective' end as pred_direction, avg(confidence) as confidence from v_mr group by 1)"
TIERS = ("Tier 1", "Tier 2")


def _model(v):
    g = v("v_mr").groupBy("gene").agg(F.avg("confidence").alias("confidence"), F.avg("beta").alias("b"))
    return g.select("gene", F.expr("case when confidence > 1.4e0 then 'Tier 1' when confidence > 1.35e0 then 'Tier 2' else 'Tier 3' end").alias("support_tier"), F.expr("case when b > 0 then 'risk' else 'protective' end").alias("pred_direction"), "confidence")


@query(f"""with {MODEL}, k as (select *, row_number() over (partition by gene order by pvalue, abs(beta) desc, beta) as rn from v_mr where pvalue < 0.01e0),
 m as (select 'mr' as gene_set, gene, case when beta > 0 then 'risk' else 'protective' end as direction, 'mr' as source, pvalue, cast(null as double) as confidence from k where rn = 1),
 t as (select support_tier, gene, pred_direction, 'model', cast(null as double), confidence from model where support_tier in {TIERS}), b as (select * from m union all select * from t),
 g as (select 'merged' as gene_set, gene, direction, source, pvalue, confidence from (select *, row_number() over (partition by gene order by pvalue nulls last, confidence desc nulls last, gene_set) as rn from b) x where rn = 1)
select gene_set, gene_set || '_' || direction as program, gene, direction, source, round(pvalue, 6) + 0e0 as pvalue, round(confidence, 6) + 0e0 as confidence from (select * from b union all select * from g) y""")
def a12_build_programs(v):
    return programs.build_programs(v("v_mr"), _model(v), 0.01, TIERS)


@query(f"""with {MODEL}, d as (select distinct gene, pred_direction as direction from model where support_tier in {TIERS}), k as (select *, count(*) over (partition by direction) as n from d) select 'expand_' || direction as program, gene, direction from k where n >= 2""")
def a13_expand_programs(v):
    return programs.expand_programs(_model(v), list(TIERS), drop_overlap=True, min_genes=2)


@query("""with g as (select distinct gene from v_expr where gene > 'g2') select program, count(*) as n_total, count(g.gene) as n_present, count(*) - count(g.gene) as n_missing, case when count(g.gene) >= 3 then 'ok' else 'too_few' end as status from (select distinct program, gene from v_program) p left join g on g.gene = p.gene group by 1""")
def a14_program_qc(v):
    return programs.program_qc(v("v_program"), v("v_expr").where("gene > 'g2'"), 3)


MODULES = "md as (select gene, 'm' || cast(cast(substr(gene, 2) as bigint) % 3 as varchar) as module_id, case when cast(substr(gene, 2) as bigint) % 2 = 0 then 'risk' else 'protective' end as d from (select distinct gene from v_expr) t)"


@query(f"""with {MODULES}, z as (select sample_id, gene, (value - avg(value) over g) / nullif(stddev_pop(value) over g, 0) as z from v_expr window g as (partition by gene)), ok as (select module_id from md group by 1 having count(case when d = 'risk' then 1 end) >= 3 and count(case when d = 'protective' then 1 end) >= 3),
 s as (select sample_id, module_id, avg(case when d = 'risk' then z end) as risk, avg(case when d = 'protective' then z end) as protective from z join md using (gene) where z is not null and module_id in (select module_id from ok) group by 1, 2)
select sample_id, module_id, round(risk, 6) + 0e0 as risk, round(protective, 6) + 0e0 as protective, round(risk - protective, 6) + 0e0 as rstar from s""")
def a23_module_rstar(v):
    e = v("v_expr").withColumn("value", F.col("value").cast("double"))
    md = e.select("gene").distinct().withColumns({"module_id": F.expr("concat('m', cast(cast(substr(gene, 2) as bigint) % 3 as string))"), "pred_direction": F.expr("case when cast(substr(gene, 2) as bigint) % 2 = 0 then 'risk' else 'protective' end")})
    return programs.module_rstar(e, md, md.select("gene", "pred_direction"))[0]


@query("""with e as (select chrom as module_id, avg(beta) as delta, min(pval) as fdr from v_variant group by 1), q as (select chrom as module_id, count(*) as n_risk from v_gene group by 1)
select module_id, round(delta, 6) + 0e0 as delta, round(fdr, 6) + 0e0 as fdr, n_risk, round(-log10(greatest(fdr, 1e-300)), 6) + 0e0 as neg_log10_fdr from e left join q using (module_id) order by abs(delta) desc, module_id limit 7""")
def a46_module_ranking(v):
    e = v("v_variant").groupBy(F.col("chrom").alias("module_id")).agg(F.avg("beta").alias("delta"), F.min("pval").alias("fdr"))
    return programs.module_ranking(e, v("v_gene").groupBy(F.col("chrom").alias("module_id")).agg(F.count("*").alias("n_risk")), 7)


# --- cells


@query("""with f as (select sample_id, case when cast(substr(gene, 2) as bigint) % 2 = 0 then 'even' else 'odd' end as gene, gene as feature, value from v_expr), t as (select gene, feature, row_number() over (partition by gene order by sum(value) desc, feature) as rn from f group by 1, 2)
select 'sum' as how, sample_id, gene, round(sum(value), 6) + 0e0 as value from f group by 2, 3 union all select 'mean', sample_id, gene, round(avg(value), 6) + 0e0 from f group by 2, 3 union all select 'max_total', sample_id, f.gene, round(value, 6) + 0e0 from f join t on t.gene = f.gene and t.feature = f.feature where rn = 1""")
def a17_collapse_genes_expr(v):
    e = v("v_expr").selectExpr("sample_id", "case when cast(substr(gene, 2) as bigint) % 2 = 0 then 'even' else 'odd' end as gene", "gene as feature", "cast(value as double) as value")
    parts = [cells.collapse_genes_expr(e, how).select(F.lit(how).alias("how"), "sample_id", "gene", "value") for how in ("sum", "mean", "max_total")]
    return parts[0].union(parts[1]).union(parts[2])


@query("""with s as (select min(value) as lo, max(value) as hi, avg(case when abs(value - round(value)) < 1e-6 then 1e0 else 0e0 end) as whole from v_expr) select rule, lo >= 0 and whole >= least_whole and hi > least_high as counts from s, (values ('strict', 0.99e0, 20), ('loose', 0.95e0, 10)) t(rule, least_whole, least_high)""")
def a18_count_like(v):
    e = v("v_expr").withColumn("value", F.col("value").cast("double"))
    return e.sparkSession.createDataFrame([(rule, cells.is_count_like(e, rule)) for rule in ("strict", "loose")], "rule string, counts boolean")


@query("""with t as (select cell_type, count(distinct case when grp = 'case' then donor_id end) as a, count(distinct case when grp = 'control' then donor_id end) as b, avg(case when grp = 'case' then score end) - avg(case when grp = 'control' then score end) as d, min(score) / 100 as p from v_cell group by 1)
select cell_type, coalesce(p < 0.05e0 and d > 0 and least(a, b) >= 3, false) as "primary", coalesce((p < 0.1e0 or p / 2 < 0.05e0) and d > 0 and least(a, b) >= 3, false) as relaxed from t""")
def a30_nominate(v):
    side = lambda k: F.when(F.col("grp") == k, F.col("donor_id"))
    mean = lambda k: F.avg(F.when(F.col("grp") == k, F.col("score")))
    t = v("v_cell").groupBy("cell_type").agg(F.countDistinct(side("case")).alias("donors_case"), F.countDistinct(side("control")).alias("donors_control"), (mean("case") - mean("control")).alias("delta_mean"), (F.min("score") / 100).alias("fdr"))
    return cells.nominate(t.withColumn("p", F.col("fdr") / 2)).select("cell_type", "primary", "relaxed")


@query("select 'cell_type' as \"column\", cell_type as label, count(*) as n from v_cell group by 2 union all select 'grp', grp, count(*) from v_cell group by 2")
def a40_label_counts(v):
    return cells.label_counts(v("v_cell"), ["cell_type", "grp"])


@query("""with g as (select cell_type, cast((donor_id // 2) % 10 as bigint) as label, avg(case when grp = 'case' then score end) - avg(case when grp = 'control' then score end) as delta from v_cell group by 1, 2), k as (select *, row_number() over (partition by cell_type order by abs(delta) desc, label) as rn from g where delta is not null)
select cell_type, label, round(delta, 6) + 0e0 as delta from k where rn <= 3""")
def a44_top_delta_labels(v):
    d = v("v_cell").withColumn("label", F.expr("cast(floor(donor_id / 2) % 10 as bigint)"))
    return cells.top_delta_labels(d, ["cell_type"], "score", "label", 3, group="grp")


@query("""with g as (select cell_type, avg(score) as m, count(*) as n_cells, count(distinct donor_id) as n_donors from v_cell where grp = 'case' group by 1 having count(*) >= 20 and count(distinct donor_id) >= 2) select cell_type, round(m, 6) + 0e0 as mean_score, n_cells, n_donors, row_number() over (order by m desc, cell_type) as rank from g""")
def a45_case_label_summary(v):
    return cells.case_label_summary(v("v_cell"), "cell_type", "score", "grp", min_donors=2)


# --- links and effects


@query("""with x as (select distinct rsid, lower(case vid % 3 when 0 then 'Whole_Blood' when 1 then 'Brain' else 'Liver' end) as t from v_variant), d as (select distinct reg_rsid as rsid, gene, effect from v_link),
 y as (select gene, d.rsid, abs(effect) as e, case t when 'whole_blood' then 'blood' when 'brain' then 'brain' else 'other' end as b from d join x using (rsid)),
 g as (select gene, count(distinct case when b = 'blood' then rsid end) as n_blood, count(distinct case when b = 'brain' then rsid end) as n_brain, count(distinct case when b = 'other' then rsid end) as n_other,
  coalesce(sum(case when b = 'blood' then e end), 0e0) as s1, coalesce(sum(case when b = 'brain' then e end), 0e0) as s2, coalesce(sum(case when b = 'other' then e end), 0e0) as s3 from y group by 1)
select gene, n_blood, n_brain, n_other, round(s1, 6) + 0e0 as strength_blood, round(s2, 6) + 0e0 as strength_brain, round(s3, 6) + 0e0 as strength_other, case when greatest(s1, s2, s3) <= 0 then null when s1 = greatest(s1, s2, s3) then 'blood' when s2 = greatest(s1, s2, s3) then 'brain' else 'other' end as dominant from g""")
def a9_dhs_tissue_summary(v):
    reg = v("v_variant").selectExpr("rsid", "case vid % 3 when 0 then 'Whole_Blood' when 1 then 'Brain' else 'Liver' end as dhs_tissue")
    d = v("v_link").select(F.col("reg_rsid").alias("rsid"), "gene", "effect").distinct().withColumn("sumabs_d", F.abs("effect"))
    return effects.dhs_tissue_summary(d, reg, ["whole_blood"], ["brain"])


NETWORK = "x as (select reg_rsid, gene, type as cell_type, beta as value from (select rsid as reg_rsid, gene, type, beta from v_qtl) t)"


@query(f"""with {NETWORK}, e as (select 'variant:' || reg_rsid as source, 'gene:' || gene as target, value from x union all select 'gene:' || gene, 'context:' || cell_type, value from x) select source, target, round(sum(value), 6) + 0e0 as value, count(*) as n from e group by 1, 2""")
def a35_network_edges(v):
    return contrib.network_tables(v("v_qtl").select(F.col("rsid").alias("reg_rsid"), "gene", F.col("type").alias("cell_type"), F.col("beta").alias("value")))[1]


@query(f"with {NETWORK} select distinct 'variant:' || reg_rsid as node_id, 'variant' as kind, reg_rsid as name from x union select 'gene:' || gene, 'gene', gene from x union select 'context:' || cell_type, 'context', cell_type from x")
def a35_network_nodes(v):
    return contrib.network_tables(v("v_qtl").select(F.col("rsid").alias("reg_rsid"), "gene", F.col("type").alias("cell_type"), F.col("beta").alias("value")))[0]


@query("""with p as (select gene, type, sum(beta / (se * se)) as bw, sum(1 / (se * se)) as w, count(*) as n, min(beta) as b1, min(se) as s1 from v_qtl group by 1, 2), c as (select gene, type, case when n = 1 then b1 else bw / w end as b, case when n = 1 then s1 else sqrt(1 / w) end as s from p),
 m as (select gene, count(*) as n_contexts, count(case when b > 0 then 1 end) as n_pos, count(case when b < 0 then 1 end) as n_neg, case when count(*) = 1 then min(b) else sum(b / (s * s)) / sum(1 / (s * s)) end as beta, case when count(*) = 1 then min(s) else sqrt(1 / sum(1 / (s * s))) end as se from c group by 1),
 d as (select *, case when beta > 0 then 'risk' else 'protective' end as direction, abs(beta / se) as z from m), k as (select *, row_number() over (partition by direction order by z desc, gene) as rank from d)
select gene, round(beta, 6) + 0e0 as beta, round(se, 6) + 0e0 as se, n_contexts, n_pos, n_neg, least(n_pos, n_neg) = 0 as consistent, direction, rank from k where rank <= 30""")
def a43_gene_context_summary(v):
    return meta.gene_context_summary(v("v_qtl"), context="type").select("gene", "beta", "se", "n_contexts", "n_pos", "n_neg", "consistent", "direction", "rank")


@query("""with e as (select distinct least(gene_u, gene_v) as u, greatest(gene_u, gene_v) as v from v_ppi where gene_u <> gene_v), n as (select gene, count(*) as degree from (select u as gene from e union all select v from e) t group by 1), b as (select gene, avg(beta) as beta from v_mr where tissue = 'brain' and pvalue < 0.05e0 group by 1)
select beta is not null as labelled, count(*) as n, round(avg(degree), 6) + 0e0 as mean_degree, round(avg(beta), 6) + 0e0 as mean_label, round(stddev_samp(beta), 6) + 0e0 as sd_label from n left join b using (gene) group by 1""")
def a38_label_stats(v):
    b = v("v_mr").where("tissue = 'brain' and pvalue < 0.05").groupBy("gene").agg(F.avg("beta").alias("beta"))
    return models.label_stats(graph.build_graph(v("v_ppi"))[1].join(b, "gene", "left"))
