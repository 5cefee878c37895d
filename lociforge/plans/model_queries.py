"""Queries of models, their reports, gene features and tests that the main file doesn't have."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import effects, graph, linkage, models, select, stats
from .registry import query

TIERED = """d as (select *, case when calibrated_prob_risk >= 0.5e0 then 'risk' else 'protective' end as pred_direction, case when rwr_pred_beta > 0 then 'risk' else 'protective' end as rwr_direction,
  n_brain_or_neural_dhs_snvs > 0 or coalesce(regexp_matches(top_dhs_tissue, 'brain|neural|neuron|cns', 'i'), false) as dhs, top_relative_contribution >= 0.2e0 as strong from v_pred),
 s as (select *, case when pred_direction = 'risk' then {risk} else {protective} end as tier_score, pred_direction = rwr_direction as agree from d),
 k as (select *, (rank() over (partition by pred_direction order by tier_score) + (count(*) over (partition by pred_direction, tier_score) - 1) / 2e0) / count(*) over (partition by pred_direction) as pct,
  (rank() over (partition by pred_direction order by abs(raw_pred_beta_score)) + (count(*) over (partition by pred_direction, abs(raw_pred_beta_score)) - 1) / 2e0) / count(*) over (partition by pred_direction) as big from s where not is_seed),
 t as (select gene, is_seed, pred_direction, tier_score, agree, dhs, pct, case when dhs and agree and strong and pct >= 0.9e0{size} then 'Tier 1' when dhs and pct >= 0.75e0 and (agree or pct >= 0.9e0){size} then 'Tier 2' else 'Tier 3' end as support_tier from k
  union all select gene, is_seed, pred_direction, tier_score, agree, dhs, null, 'MR seed' from s where is_seed)"""
RAW = {"risk": "raw_pred_beta_score", "protective": "-raw_pred_beta_score", "size": ""}


@query(f"""with {TIERED.format(**RAW)} select gene, pred_direction, round(tier_score, 6) + 0e0 as tier_score, agree as rwr_agree, dhs as brain_dhs_supported, round(pct, 6) + 0e0 as direction_confidence_percentile, support_tier from t""")
def m9_support_tiers(v):
    return models.support_tiers(v("v_pred")).select("gene", "pred_direction", "tier_score", "rwr_agree", "brain_dhs_supported", "direction_confidence_percentile", "support_tier")


@query(f"""with {TIERED.format(risk='platt_prob_risk', protective='(1 - platt_prob_risk)', size=' and big >= 0.3e0')} select gene, pred_direction, support_tier from t""")
def m9_support_tiers_platt(v):
    return models.support_tiers(v("v_pred"), source="platt", min_abs_raw_score_q=0.3).select("gene", "pred_direction", "support_tier")


@query(f"""with {TIERED.format(**RAW)}, g as (select support_tier, count(case when pred_direction = 'risk' then 1 end) as risk, count(case when pred_direction = 'protective' then 1 end) as protective, count(*) as total from t where not is_seed group by 1)
select support_tier, risk, protective, total, round(risk * 1e0 / total, 6) + 0e0 as risk_fraction, round(protective * 1e0 / total, 6) + 0e0 as protective_fraction, round(risk * 1e0 / nullif(protective, 0), 6) + 0e0 as risk_to_protective_ratio from g""")
def m9_tier_balance(v):
    return models.tier_balance(models.support_tiers(v("v_pred")))


TRACK_ROWS = """t as (select concat('T', cast(vec_id % 40 as varchar)) as gene, concat('v', cast(vec_id % 97 as varchar)) as rsid, list_transform(embedding, lambda x: cast(x as double)) as d from embeddings where embedding is not null),
 a as (select distinct 'v' || cast(i as varchar) as rsid, i % 3 = 0 as linked, case when i % 3 = 0 then (i % 7) / 4e0 end as weight, case when i % 3 = 0 then 'g' || cast(i % 11 as varchar) end as locus, case when i % 3 = 0 then (i % 5) / 5e0 end as r2, case when i % 3 = 0 then i % 9 - 4e0 end as gb,
  case when i % 3 = 0 then 1e0 / (1 + i) end as gp, 'd' || cast(i % 13 as varchar) as dhs, (i % 50) / 100e0 as af from range(0, 97) r(i)),
 x as (select t.*, a.* exclude (rsid), case when linked then coalesce(weight, 0e0) else 0e0 end as w, list_sum(d) as s, list_sum(list_transform(d, lambda x: abs(x))) as sa, list_sum(list_transform(d, lambda x: x * x)) as ss, list_max(list_transform(d, lambda x: abs(x))) as mx from t join a using (rsid)),
 b as (select gene, linked, count(*) as n_rows, count(distinct rsid) as n_snvs, count(distinct dhs) as n_dhs, sum(sa) / sum(len(d)) as mean_abs, sum(sa) as sum_abs, max(mx) as max_abs, sum(s) / sum(len(d)) as mean_signed,
  sqrt(greatest(0e0, sum(ss) / sum(len(d)) - (sum(sa) / sum(len(d))) * (sum(sa) / sum(len(d))))) as std_abs, count(distinct locus) as n_loci, max(r2) as max_r2, max(abs(gb)) as max_abs_gwas_beta, min(gp) as min_gwas_pval, max(w) as max_weight, sum(w) / count(*) as mean_weight,
  avg(af) as mean_af, min(af) as min_af, max(af) as max_af, sum(d[1]) / count(*) as signed_first, sum(abs(d[1])) / count(*) as abs_first, sum(w * d[1]) / greatest(sum(w), 1e-12) as weighted_signed_first, sum(w * abs(d[1])) / greatest(sum(w), 1e-12) as weighted_abs_first from x group by 1, 2)"""


def _blocks(v):
    d = v("v_track").selectExpr("concat('T', cast(vec_id % 40 as string)) as gene", "concat('v', cast(vec_id % 97 as string)) as rsid", "d")
    i = v("v_track").selectExpr("vec_id % 97 as i").distinct()
    linked = lambda x: f"case when i % 3 = 0 then {x} end"
    ann = i.selectExpr(
        "concat('v', cast(i as string)) as rsid", "i % 3 = 0 as linked", f"{linked('(i % 7) / 4e0')} as weight", f"{linked('concat(' + chr(39) + 'g' + chr(39) + ', cast(i % 11 as string))')} as locus", f"{linked('(i % 5) / 5e0')} as r2",
        f"{linked('i % 9 - 4e0')} as gwas_beta", f"{linked('1e0 / (1 + i)')} as gwas_pval", "concat('d', cast(i % 13 as string)) as dhs", "(i % 50) / 100e0 as af_alt",
    )
    return effects.gene_blocks(d, ann)


BLOCK_COLS = ("mean_abs", "sum_abs", "max_abs", "mean_signed", "std_abs", "max_r2", "max_abs_gwas_beta", "min_gwas_pval", "max_weight", "mean_weight", "mean_af", "min_af", "max_af", "signed_first", "abs_first", "weighted_signed_first", "weighted_abs_first")


@query(f"with {TRACK_ROWS} select gene, linked, n_rows, n_snvs, n_dhs, n_loci, cast(64 as bigint) as active_tracks, {', '.join(f'round({c}, 6) + 0e0 as {c}' for c in BLOCK_COLS)} from b")
def a8_gene_blocks(v):
    b = _blocks(v)
    first = [F.get(f"{n}_mean", 0).alias(f"{n}_first") for n in ("signed", "abs", "weighted_signed", "weighted_abs")]
    return b.select("gene", "linked", "n_rows", "n_snvs", "n_dhs", "n_loci", "active_tracks", *BLOCK_COLS[:-4], *first)


@query(f"""with {TRACK_ROWS}, g as (select gene, coalesce(max(case when linked then n_snvs end), 0) as a, coalesce(max(case when not linked then n_snvs end), 0) as c, coalesce(max(case when linked then sum_abs end), 0e0) as sa, coalesce(max(case when not linked then sum_abs end), 0e0) as sc,
  coalesce(max(case when linked then mean_abs end), 0e0) as ma, coalesce(max(case when not linked then mean_abs end), 0e0) as mc from b group by 1)
select gene, a as linked_n_snvs, c as background_n_snvs, round(sa / (sa + sc + 1e-12), 6) + 0e0 as linked_fraction_abs, round(ma / (mc + 1e-12), 6) + 0e0 as linked_background_abs_ratio, round(ln(1 + sa) - ln(1 + sc), 6) + 0e0 as linked_specificity_score, round(a / (a + c + 1e-12), 6) + 0e0 as linked_variant_fraction from g where mc > 0""")
def a8_gene_contrasts(v):
    g = effects.gene_contrasts(_blocks(v)).where("background_mean_abs > 0")
    return g.select("gene", "linked_n_snvs", "background_n_snvs", "linked_fraction_abs", "linked_background_abs_ratio", "linked_specificity_score", "linked_variant_fraction")


@query("""with l as (select 'beta' as "column", beta as x from v_variant union all select 'pval', pval from v_variant) select "column", count(*) as n, round(min(x), 6) + 0e0 as min, round(quantile_cont(x, 0.01), 6) + 0e0 as q01, round(quantile_cont(x, 0.05), 6) + 0e0 as q05, round(quantile_cont(x, 0.25), 6) + 0e0 as q25,
 round(median(x), 6) + 0e0 as median, round(quantile_cont(x, 0.75), 6) + 0e0 as q75, round(quantile_cont(x, 0.95), 6) + 0e0 as q95, round(quantile_cont(x, 0.99), 6) + 0e0 as q99, round(max(x), 6) + 0e0 as max, count(distinct round(x, 6)) as n_unique from l group by 1""")
def a39_value_ranges(v):
    return models.value_ranges(v("v_variant"), ["beta", "pval"])


@query("""with l as (select 'beta' as "column", beta as x from v_variant union all select 'af_alt', af_alt from v_variant) select "column", round(x, 1) + 0e0 as value, count(*) as n, round(count(*) * 1e0 / sum(count(*)) over (partition by "column"), 6) + 0e0 as fraction from l group by 1, 2""")
def a39_value_profile(v):
    d = v("v_variant").select(F.round("beta", 1).alias("beta"), F.round("af_alt", 1).alias("af_alt"))
    return models.value_profile(d, ["beta", "af_alt"])


@query("""with d as (select 'isotonic' as method, abs(calibrated_prob_risk - (1 - calibrated_prob_protective * 0.9e0)) as d from v_pred union all select 'platt', abs(platt_prob_risk - (1 - calibrated_prob_protective)) from v_pred)
select method, count(*) as n, round(avg(d), 6) + 0e0 as mean_abs_delta, round(median(d), 6) + 0e0 as median_abs_delta, round(quantile_cont(d, 0.95), 6) + 0e0 as q95_abs_delta, round(max(d), 6) + 0e0 as max_abs_delta, count(case when d > 0.05e0 then 1 end) as n_above_0p05, count(case when d > 0.1e0 then 1 end) as n_above_0p10 from d group by 1""")
def m8_reciprocity(v):
    d = v("v_pred").withColumn("other", F.col("calibrated_prob_protective") * 0.9)
    return models.reciprocity(d, {"isotonic": ("calibrated_prob_risk", "other"), "platt": ("platt_prob_risk", "calibrated_prob_protective")})


@query("""with d as (select case when grp = 'case' then 1e0 else 0e0 end as y, score / 101 as p from v_cell), u as (select 'risk' as positive, y, p from d union all select 'protective', 1 - y, 1 - p from d)
select positive, cast(least(floor(p * 10), 9) as bigint) as bin, count(*) as n, round(avg(p), 6) + 0e0 as mean_pred, round(avg(y), 6) + 0e0 as observed from u group by 1, 2""")
def m8_calibration_checks(v):
    return models.calibration_checks(v("v_cell").select((F.col("grp") == "case").cast("int").alias("y"), (F.col("score") / 101).alias("p")), "p", "y", "p")


@query("""with c as (select gene, rsid, tissue, c, row_number() over (partition by gene order by tissue = 'brain' desc, abs(c) desc, rsid) as rn from (select gene, reg_rsid as rsid, case when n % 2 = 0 then 'Brain' else 'Blood' end as t, lower(case when n % 2 = 0 then 'Brain' else 'Blood' end) as tissue, sum(effect) as c from v_link group by 1, 2, 3, 4) x)
select m.gene, n, rsid as top_rsid, round(c, 6) + 0e0 as top_contribution, case tissue when 'brain' then 'Brain' else 'Blood' end as top_tissue from (select gene, count(*) as n from v_mr group by 1) m left join c on c.gene = m.gene and rn = 1""")
def m11_top_contribution(v):
    c = v("v_link").selectExpr("gene", "reg_rsid as rsid", "case when n % 2 = 0 then 'Brain' else 'Blood' end as dhs_tissue", "effect").groupBy("gene", "rsid", "dhs_tissue").agg(F.sum("effect").alias("contribution"))
    return models.attach_top_contribution(v("v_mr").groupBy("gene").agg(F.count("*").alias("n")), c)


@query("select 'walk' as model, chrom, count(*) as n, round(avg(beta), 6) + 0e0 as rmse, cast(null as double) as auroc from v_variant group by 2 union all select 'ridge', chrom, count(*), null, round(avg(af_alt), 6) + 0e0 from v_variant group by 2")
def m13_union_performance(v):
    part = lambda model, c, n: v("v_variant").groupBy("chrom").agg(F.count("*").alias("n"), F.avg(c).alias(n)).withColumn("model", F.lit(model))
    return models.union_performance([part("walk", "beta", "rmse"), part("ridge", "af_alt", "auroc")]).select("model", "chrom", "n", "rmse", "auroc")


@query("""with k as (select gene, pvalue as rank, confidence, beta as score, tissue, row_number() over (partition by gene order by pvalue, confidence desc, gene, beta, tissue) as rn from v_mr) select gene, round(rank, 6) + 0e0 as rank, round(confidence, 6) + 0e0 as confidence, round(score, 6) + 0e0 as score, tissue, cast(null as varchar) as note from k where rn = 1""")
def m14_normalize_predictions(v):
    d = v("v_mr").select(F.col("gene").alias("g"), "pvalue", "confidence", "beta", "tissue").withColumnRenamed("g", "gene")
    d = models.normalize_predictions(d, {"rank": ["absent", "pvalue"], "confidence": ["confidence"], "score": ["beta"], "tissue": ["tissue"], "note": ["absent"]})
    return d.select("gene", "rank", "confidence", "score", "tissue", "note")


@query("""with m as (select gene, cast(cast(substr(gene, 2) as bigint) % 3 as varchar) as module_id from (select gene_u as gene from v_ppi union select gene_v from v_ppi) t), e as (select distinct least(gene_u, gene_v) as u, greatest(gene_u, gene_v) as v from v_ppi where gene_u <> gene_v),
 i as (select a.module_id, u, v from e join m a on a.gene = u join m b on b.gene = v and b.module_id = a.module_id), g as (select module_id, gene, count(*) as n from (select module_id, u as gene from i union all select module_id, v from i) t group by 1, 2),
 k as (select module_id, gene from (select *, row_number() over (partition by module_id order by n desc, gene) as rn from g) t where rn <= 5) select i.module_id, u, v from i join k a on a.module_id = i.module_id and a.gene = u join k b on b.module_id = i.module_id and b.gene = v""")
def m16_module_subgraph(v):
    e = graph.build_graph(v("v_ppi"))[0]
    m = e.select(F.explode(F.array("u", "v")).alias("gene")).distinct().withColumn("module_id", F.expr("cast(cast(substr(gene, 2) as bigint) % 3 as string)"))
    return graph.module_subgraph(e, m, 5)


@query("""with k as (select cell_type, grp, rank() over (partition by cell_type order by score) + (count(*) over (partition by cell_type, score) - 1) / 2e0 as r from v_cell), g as (select cell_type, count(case when grp = 'case' then 1 end) * 1e0 as n1, count(case when grp = 'control' then 1 end) * 1e0 as n2, sum(case when grp = 'case' then r end) as r1 from k group by 1)
select cell_type, cast(n1 as bigint) as n1, cast(n2 as bigint) as n2, round(2 * (r1 - n1 * (n1 + 1) / 2) / (n1 * n2) - 1, 6) + 0e0 as delta from g""")
def t6_cliffs_delta(v):
    return stats.cliffs_delta(v("v_cell"), ["cell_type"], "grp", "score")


@query("select cell_type, round(median(case when grp = 'case' then score end) - median(case when grp = 'control' then score end), 6) + 0e0 as diff, true as ordered from v_cell group by 1")
def t7_median_difference(v):
    """Ordered: the difference lies between the ends of its interval, which has a query of its own."""
    d = stats.median_diff_ci(v("v_cell"), ["cell_type"], "grp", "score", ["event_id"])
    return d.select("cell_type", "diff", ((F.col("ci_low") <= F.col("diff")) & (F.col("diff") <= F.col("ci_high"))).alias("ordered"))


@query()
def t7_median_interval(v):
    return stats.median_diff_ci(v("v_cell"), ["cell_type"], "grp", "score", ["event_id"])


@query()
def t9_effect_sizes(v):
    return stats.effect_sizes(v("v_cell"), ["cell_type"], "grp", "score", ["event_id"], [("case", "control")])


@query("""with g as (select gene, sum(beta) as score, gene in (select gene from v_gene where tx_start % 3 = 0) as hit from v_qtl group by 1), s as (select *, sum(case when hit then 1e0 / h else -1e0 / (n - h) end) over (order by score desc, gene rows unbounded preceding) as es from g, (select count(*) as n, sum(case when hit then 1 else 0 end) as h from g) t)
select round(arg_max(es, abs(es)), 6) + 0e0 as ks, true as valid from s""")
def t11_ks_set_score(v):
    g = linkage.flag_member(v("v_qtl").groupBy("gene").agg(F.sum("beta").alias("score")), v("v_gene").where("tx_start % 3 = 0"), ["gene"], "hit")
    return stats.ks_set_score(g, "score", "hit", "gene").select("ks", F.col("p").between(0, 1).alias("valid"))


@query()
def t11_ks_null(v):
    """The score with its null's mean and deviation, z and p."""
    g = linkage.flag_member(v("v_qtl").groupBy("gene").agg(F.sum("beta").alias("score")), v("v_gene").where("tx_start % 3 = 0"), ["gene"], "hit")
    return stats.ks_set_score(g, "score", "hit", "gene")


@query()
def t12_auroc_interval(v):
    """A thousand resamples of all rows."""
    return stats.auroc_ci(v("v_cell").select("event_id", (F.col("grp") == "case").cast("int").alias("y"), (F.col("score") / 101).alias("p")), "y", "p", ["event_id"])


def _labels(v):
    return v("v_mr").groupBy("gene").agg(F.avg("beta").alias("beta"), F.avg("confidence").alias("confidence"))


def _node_features(v):
    return v("v_qtl").groupBy("gene").agg(F.avg("se").alias("x1"), F.avg("pvalue").alias("x2"), F.count("*").cast("double").alias("x3"))


@query()
def m5_walk_ridge(v):
    """Five times five folds, with the walk inside each."""
    return models.walk_ridge(graph.build_graph(v("v_ppi"))[0], _node_features(v), _labels(v), ["x1", "x2", "x3"])[0]


@query()
def t13_permutation_control(v):
    """A thousand refits, against the AUROC of the true labels."""
    edges, features, labels = graph.build_graph(v("v_ppi"))[0], _node_features(v), _labels(v)
    oof = models.walk_ridge(edges, features, labels, ["x1", "x2", "x3"], repeats=1)[0]
    seen = stats.binary_metrics(oof.withColumn("y", (F.col("beta") > 0).cast("int")), "y", "oof_prob").first()["auroc"]
    return models.permutation_control(edges, features, labels, ["x1", "x2", "x3"], seen)[1]


@query()
def m4_baselines(v):
    return models.cv_models(_node_features(v).join(_labels(v).withColumnRenamed("beta", "y"), "gene"), {"size": ["x3"], "all": ["x1", "x2", "x3"]}, "y")


@query()
def m6_sensitivity(v):
    return models.sensitivity_model(_node_features(v).join(_labels(v).withColumnRenamed("beta", "y"), "gene"), ["x1", "x2", "x3"], "y")[1]


@query()
def m12_pca(v):
    return effects.pca(v("v_track"), "d").select("vec_id", *(F.get("pcs", i).alias(f"pc{i + 1}") for i in range(32)))


@query("select cast(fold as bigint) as fold, true as even from (select unnest([0, 1, 2, 3, 4]) as fold) t")
def r3_stratified_folds(v):
    """In every stratum fold sizes differ by one at most."""
    d = select.assign_folds(v("v_variant").select("vid", "chrom"), ["vid"], 5, 1, strata=["chrom"]).groupBy("chrom", "fold").agg(F.count("*").alias("n"))
    ends = d.groupBy("chrom").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    return d.join(ends, "chrom").groupBy("fold").agg((F.max(F.col("hi") - F.col("lo")) <= 1).alias("even"))
