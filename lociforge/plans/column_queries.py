"""Queries of the column functions: keys, cleaning, labels, small formulas and the filters made of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import cells, contrib, effects, meta
from .registry import query

NULLS = "('', '.', 'NA', 'NAN', 'NONE', 'NULL', 'N/A')"
RAW_CHROM = "case vid % 6 when 0 then chrom when 1 then concat('CHR', substr(chrom, 4)) when 2 then concat(substr(chrom, 4), '.0') when 3 then ' chrX ' when 4 then 'nan' else substr(chrom, 4) end"


def clean_sql(x: str) -> str:
    return f"case when upper(trim({x})) not in {NULLS} then trim({x}) end"


@query(f"""with a as (select vid, {clean_sql(RAW_CHROM)} as t from v_variant), b as (select vid, upper(regexp_replace(regexp_replace(t, '^chr', '', 'i'), '\\.0$', '')) as clean from a)
select vid, clean, 'chr' || clean as norm, 'chr' || clean in ({', '.join(f"'{x}'" for x in c.AUTOSOMES)}) as autosome from b""")
def p1_p2_chromosomes(v):
    d = v("v_variant").selectExpr("vid", f"{RAW_CHROM} as raw")
    x = F.col("raw")
    return d.select("vid", c.clean_chrom(x).alias("clean"), c.norm_chrom(x).alias("norm"), c.is_autosome(x).alias("autosome"))


@query("""select vid, chrom || '_' || pos || '_' || ref || '_' || alt as key, substr(chrom, 4) || ':' || pos || ':' || ref || ':' || alt as colon, chrom as p_chrom, pos as p_pos, ref as p_ref, alt as p_alt from v_variant""")
def p3_variant_keys(v):
    parts = [F.col("chrom"), F.col("pos"), F.lower("ref"), F.col("alt")]
    d = v("v_variant").select("vid", c.variant_key(*parts).alias("key"), c.variant_key(*parts, style="colon").alias("colon"))
    return d.withColumn("p", c.parse_vid(F.col("key"))).select("vid", "key", "colon", *(F.col(f"p.{x}").alias(f"p_{x}") for x in ("chrom", "pos", "ref", "alt")))


@query("select identifier, case identifier % 3 when 0 then cast(identifier as varchar) || '.0' when 1 then cast(identifier as varchar) || '.5' else 'x' || identifier end as dhs from v_interval")
def p4_dhs_ids(v):
    raw = F.expr("case identifier % 3 when 0 then concat('DHS:', identifier) when 1 then concat(' peak:DHS:', identifier, '.50') else concat('DHS:x', identifier) end")
    return v("v_interval").select("identifier", c.norm_dhs_id(raw).alias("dhs"))


@query("""with a as (select vid, case when vid % 7 = 0 then 'AT' when vid % 5 = 0 then lower(ref) when vid % 11 = 0 then null else ref end as a, case when vid % 3 = 0 then ref else alt end as b from v_variant)
select vid, coalesce(regexp_full_match(upper(a), '[ACGT]') and regexp_full_match(upper(b), '[ACGT]'), false) as snv, coalesce(regexp_full_match(upper(a), '[ACGT]') and regexp_full_match(upper(b), '[ACGT]') and upper(a) <> upper(b), false) as snv_distinct from a""")
def p5_snv(v):
    d = v("v_variant").selectExpr("vid", "case when vid % 7 = 0 then 'AT' when vid % 5 = 0 then lower(ref) when vid % 11 = 0 then null else ref end as a", "case when vid % 3 = 0 then ref else alt end as b")
    return d.select("vid", c.is_snv(F.col("a"), F.col("b")).alias("snv"), c.is_snv(F.col("a"), F.col("b"), distinct=True).alias("snv_distinct"))


RSIDS = "case vid % 4 when 0 then concat(rsid, ',rs1;.') when 1 then concat('; ', rsid, '  rs2') when 2 then null else rsid end"


@query(f"""with a as (select vid, list_filter(regexp_split_to_array(coalesce({RSIDS}, ''), '[,;\\s]+'), lambda x: x not in ('', '.')) as ids from v_variant)
select vid, ids[1] as first, array_to_string(ids, '|') as every, len(ids) as n from a""")
def p6_rsid_lists(v):
    d = v("v_variant").selectExpr("vid", f"{RSIDS} as raw")
    ids = c.split_rsids(F.col("raw"))
    return d.select("vid", c.first_rsid(F.col("raw")).alias("first"), F.array_join(ids, "|").alias("every"), F.size(ids).alias("n"))


@query(f"""with a as (select k, case k % 4 when 0 then concat(' ', lower(gene), ' ') when 1 then 'n/a' when 2 then concat(gene, ' b') else gene end as g, case k % 5 when 0 then 'Yes' when 1 then ' TRUE ' when 2 then 'no' when 3 then null else '1' end as f,
 case k % 6 when 0 then '1e-3' when 1 then 'abc' when 2 then 'NaN' when 3 then null else cast(k as varchar) end as x from (select distinct gene, k from v_mr) t)
select k, {clean_sql('g').replace('then trim(g)', 'then upper(trim(g))')} as gene, case when upper(trim(g)) not in {NULLS} then upper(regexp_replace(trim(g), '\\s+', '', 'g')) end as squeezed, coalesce(lower(trim(f)) in ('true', '1', 'yes', 'y', 't'), false) as flag,
 case when not isnan(try_cast(x as double)) then round(try_cast(x as double), 6) + 0e0 end as number from a""")
def p7_p8_p9_texts(v):
    d = v("v_mr").select("gene", "k").distinct().selectExpr(
        "k", "case k % 4 when 0 then concat(' ', lower(gene), ' ') when 1 then 'n/a' when 2 then concat(gene, ' b') else gene end as g", "case k % 5 when 0 then 'Yes' when 1 then ' TRUE ' when 2 then 'no' when 3 then null else '1' end as f",
        "case k % 6 when 0 then '1e-3' when 1 then 'abc' when 2 then 'NaN' when 3 then null else cast(k as string) end as x",
    )
    return d.select("k", c.clean_gene(F.col("g")).alias("gene"), c.clean_gene(F.col("g"), squeeze=True).alias("squeezed"), c.parse_bool(F.col("f")).alias("flag"), c.num(F.col("x")).alias("number"))


RAW_QTL = (
    "case vid % 9 when 0 then 'NA' else rsid end as rsid", "lower(substr('ACGT', cast(1 + vid % 4 as int), 1)) as ea", "substr('ACGT', cast(1 + (vid + 1) % 4 as int), 1) as oa",
    "case vid % 8 when 0 then 'x' else cast(beta as string) end as beta", "cast(se as string) as se", "cast(pvalue as string) as pvalue", "case vid % 10 when 0 then ' . ' else gene end as gene",
)


@query(f"""with a as (select {', '.join(RAW_QTL)} from v_qtl), b as (select {clean_sql('rsid')} as rsid, upper(ea) as ea, upper(oa) as oa, try_cast(beta as double) as beta, try_cast(se as double) as se, try_cast(pvalue as double) as pvalue, {clean_sql('gene')} as gene from a)
select rsid, ea, oa, round(beta, 6) + 0e0 as beta, round(se, 6) + 0e0 as se, round(pvalue, 6) + 0e0 as pvalue, gene, 'eqtl' as type from b where pvalue < 0.4e0 and rsid is not null and gene is not null and beta is not null""")
def p10_clean_qtl(v):
    return meta.clean_qtl(v("v_qtl").selectExpr(*RAW_QTL), "eqtl", 0.4)


@query("""select vid, rsid from v_variant where pval < 0.7e0 and af_alt > 0.1e0 and af_alt <= 0.8e0 and regexp_full_match(ref, '[ACGT]') and regexp_full_match(alt, '[ACGT]')""")
def p11_filter_strict(v):
    return meta.filter_assoc(v("v_variant"), 0.7, 0.1, 0.8, snv_only=True, strict=True).select("vid", "rsid")


@query("select identifier, component, round(mean_signal, 6) + 0e0 as mean_signal from v_interval where component in (select min(component) from v_interval union all select max(component) from v_interval) and mean_signal >= 910")
def p12_filter_peaks(v):
    d = v("v_interval")
    ends = d.agg(F.min("component"), F.max("component")).first()
    return meta.filter_peaks(d, list(ends), 910.0).select("identifier", "component", "mean_signal")


@query("select gene, tissue, n, case tissue when 'brain' then 'CNS' else tissue end as kept, case tissue when 'brain' then 'CNS' end as mapped from (select gene, tissue, count(*) as n from v_mr group by 1, 2) t where tissue = 'brain'")
def p14_map_values(v):
    d = v("v_mr").groupBy("gene", "tissue").agg(F.count("*").alias("n"))
    d = meta.map_values(d, "tissue", {"brain": "CNS"}, keep_unmapped=True, to="kept")
    return meta.map_values(d, "tissue", {"brain": "CNS"}, to="mapped")


@query("""with a as (select vid, ref, alt, beta, case vid % 3 when 0 then lower(ref) else alt end as ea, case vid % 3 when 0 then alt when 1 then ref else 'AC' end as oa from v_variant)
select vid, round(case when upper(ref) = upper(ea) then beta else -beta end, 6) + 0e0 as turned, round(sign(beta) * sign(case when upper(ref) = upper(ea) then beta else -beta end), 6) + 0e0 as direction,
 regexp_full_match(upper(ea), '[ACGT]') and regexp_full_match(upper(oa), '[ACGT]') and least(ref, alt) || greatest(ref, alt) = least(upper(ea), upper(oa)) || greatest(upper(ea), upper(oa)) as pair_ok, ref || alt in ('AT', 'TA', 'CG', 'GC') as palindromic from a""")
def p15_p16_alleles(v):
    d = v("v_variant").selectExpr("vid", "ref", "alt", "beta", "case vid % 3 when 0 then lower(ref) else alt end as ea", "case vid % 3 when 0 then alt when 1 then ref else 'AC' end as oa")
    turned = c.harmonize_beta(F.col("beta"), F.col("ref"), F.col("ea"))
    return d.select(
        "vid", turned.alias("turned"), c.risk_direction(F.col("beta"), turned).alias("direction"), c.allele_pair_ok(F.col("ref"), F.col("alt"), F.col("ea"), F.col("oa")).alias("pair_ok"), c.palindromic(F.col("ref"), F.col("alt")).alias("palindromic")
    )


@query("""with a as (select identifier, component, case identifier % 3 when 0 then lower(component) || '||T cell; b-cell' when 1 then ' T cell ' else component end as raw, case identifier % 5 when 0 then 'Healthy' when 1 then 'Parkinson disease' when 2 then ' MSA ' when 3 then 'pd' else null end as grp from v_interval),
 b as (select *, list_filter(list_transform(regexp_split_to_array(raw, '\\|\\||[;,/]'), lambda x: trim(x)), lambda x: x <> '') as parts from a)
select identifier, case when starts_with(component, 'PROMO ') then substr(component, 7) else component end as stripped, array_to_string(parts, '|') as parts, array_to_string(list_transform(parts, lambda x: case when lower(x) = 't cell' then 'T' else x end), '+') as short,
 regexp_replace(regexp_replace(trim(raw), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as safe, case when lower(trim(grp)) in ('normal', 'control', 'controls', 'ctrl', 'healthy', 'healthy control', 'hc') then 'normal' when regexp_matches(lower(trim(grp)), '^(pd|parkinson.*)$') then 'PD' else trim(grp) end as grp from b""")
def p13_p17_p18_p19_labels(v):
    d = v("v_interval").selectExpr("identifier", "component", "case identifier % 3 when 0 then concat(lower(component), '||T cell; b-cell') when 1 then ' T cell ' else component end as raw", "case identifier % 5 when 0 then 'Healthy' when 1 then 'Parkinson disease' when 2 then ' MSA ' when 3 then 'pd' else null end as grp")
    x = F.col("raw")
    return d.select("identifier", c.strip_prefix(F.col("component"), "PROMO ").alias("stripped"), F.array_join(c.labels(x), "|").alias("parts"), c.abbreviate(x, {"T cell": "T"}).alias("short"), c.safe_name(x).alias("safe"), c.norm_group(F.col("grp")).alias("grp"))


DISEASE = "case donor_id % 4 when 0 then ' Normal ' when 1 then 'PD' when 2 then '' else 'dementia' end as disease, case donor_id % 3 when 0 then 'Yes' when 1 then 'no' else null end as Parkinson_disease"


@query(f"""with a as (select event_id, {DISEASE} from v_cell) select event_id, 'disease' as rule, case when lower(trim(disease)) = 'normal' then 'control' else 'case' end as "group" from a where trim(disease) <> ''
 union all select event_id, 'flag', case when lower(Parkinson_disease) = 'yes' then 'case' else 'control' end from a where lower(Parkinson_disease) = 'yes' or (lower(Parkinson_disease) = 'no' and lower(trim(disease)) = 'normal')""")
def p20_assign_group(v):
    d = v("v_cell").select("event_id", "donor_id").selectExpr("event_id", *DISEASE.replace(" as disease, ", " as disease\n").split("\n"))
    a, b = (cells.assign_group(d, rule).select("event_id", F.lit(rule).alias("rule"), "group") for rule in ("disease", "flag"))
    return a.union(b)


@query("select event_id, cell_type, grp from v_cell where regexp_matches(cell_type || ' ' || disease, '(CLICK|purchase).*normal', 'i')")
def p21_filter_by_regex(v):
    return cells.filter_by_regex(v("v_cell"), ["cell_type", "disease"], "(CLICK|purchase).*normal").select("event_id", "cell_type", "grp")


@query("""with n as (select count(distinct gene) as m from v_expr), q as (select sample_id, count(case when value > 0 then 1 end) as n_genes, sum(value) as n_counts, count(case when value > 0 then 1 end) * 1e0 / m as f from v_expr, n group by 1, m)
select sample_id, n_genes, round(n_counts, 6) + 0e0 as n_counts, round(f, 6) + 0e0 as detected_fraction from q where n_genes >= 2 and n_counts >= 50 and n_counts <= 2000 and f > 0.02e0""")
def p22_cell_qc(v):
    q = cells.cell_qc(v("v_expr").withColumn("value", F.col("value").cast("double")))
    return cells.qc_cells(q, 2, 50, 2000, min_frac=0.02, strict_frac=True)


@query("select gene, tissue, n, coalesce(tissue, gene) as label, gene as name, cast(null as varchar) as missing from (select gene, case when gene < 'G3' then null else tissue end as tissue, count(*) as n from v_mr group by 1, 2) t")
def p23_optional_columns(v):
    d = v("v_mr").select("gene", F.expr("case when gene < 'G3' then null else tissue end as tissue")).groupBy("gene", "tissue").agg(F.count("*").alias("n"))
    assert contrib.first_existing(d, ["absent", "gene"]) == "gene"
    return contrib.coalesce_cols(d, {"label": ["absent", "tissue", "gene"], "name": ["gene"], "missing": ["absent"]})


@query("""with m as (select avg(confidence) as m from v_mr where confidence > 0) select k, k2, gene, round(confidence / m, 6) + 0e0 as scaled, round(pow(10e0, -least(confidence, 300e0)), 6) + 0e0 as pseudo_p from v_mr, m""")
def p25_confidence(v):
    return effects.scale_confidence(v("v_mr"), "confidence", "scaled").select("k", "k2", "gene", "scaled", c.pseudo_p(F.col("confidence")).alias("pseudo_p"))


TRACKS = """t as (select vec_id, list_transform(embedding, lambda x: cast(x as double) * 2e0) as d from embeddings where embedding is not null), u as (select *, list_transform(d, lambda x: abs(x)) as a from t)"""


@query(f"""with {TRACKS} select vec_id, round(list_avg(d), 6) + 0e0 as mean_d, round(list_avg(a), 6) + 0e0 as meanabs_d, round(list_stddev_samp(d), 6) + 0e0 as mean_d_std, round(list_stddev_samp(a), 6) + 0e0 as meanabs_d_std, round(list_max(a), 6) + 0e0 as maxabs_d,
 round(list_sum(a), 6) + 0e0 as sumabs_d, cast(list_position(a, list_max(a)) as bigint) as top_track, round(d[list_position(a, list_max(a))], 6) + 0e0 as top_value from u""")
def p26_reduce_tracks(v):
    d = effects.reduce_tracks(v("v_track"), "d", 2.0)
    return d.select("vec_id", "mean_d", "meanabs_d", "mean_d_std", "meanabs_d_std", "maxabs_d", "sumabs_d", "top_track", "top_value")


@query("""select vec_id, list_transform(range(1, len(embedding) + 1), lambda i: round(log2((abs(cast(embedding[i] as double)) + 2) / (abs(cast(embedding[len(embedding) + 1 - i] as double)) + 2)), 5) + 0e0)[1] as first,
 round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: (1 + i % 3) * log2((abs(cast(embedding[i] as double)) + 2) / (abs(cast(embedding[len(embedding) + 1 - i] as double)) + 2)))), 6) + 0e0 as weighted from embeddings where embedding is not null""")
def p27_track_delta(v):
    size = F.transform("d", lambda x: F.abs(x.cast("double")))
    d = v("v_track").withColumn("x", c.track_delta(F.reverse(size), size, 2.0))
    weighted = F.aggregate(F.transform("x", lambda x, i: x * (1 + (i + 1) % 3)), F.lit(0.0), lambda s, x: s + x)
    return d.select("vec_id", F.round(F.get("x", 0), 5).alias("first"), weighted.alias("weighted"))


@query("""with a as (select gene, tx_start, list_transform(range(0, 6), lambda i: struct_pack(s := tx_start - 40 + i * 32, e := tx_start - 40 + (i + 1) * 32)) as bins from v_gene)
select gene, tx_start, bins[1].s as first_start, bins[6].e as last_end, array_to_string(list_filter(range(0, 6), lambda i: (tx_start < bins[i + 1].e and tx_start + 20 > bins[i + 1].s) or (tx_start + 60 < bins[i + 1].e and tx_start + 70 > bins[i + 1].s)), ',') as hits, cast(21 + 11 as bigint) as exonic from a""")
def p28_bins(v):
    at = lambda a, b: F.struct((F.col("tx_start") + a).alias("start"), (F.col("tx_start") + b).alias("end"))
    d = v("v_gene").select("gene", "tx_start", c.bins_for_window(F.col("tx_start") - 40, 6).alias("bins"), F.array(at(0, 20), at(60, 70)).alias("exons"))
    hits = F.array_join(F.transform(c.bins_overlapping(F.col("bins"), F.col("exons")), lambda i: i.cast("string")), ",")
    return d.select("gene", "tx_start", F.get("bins", 0)["start"].alias("first_start"), F.get("bins", 5)["end"].alias("last_end"), hits.alias("hits"), c.exonic_length(F.col("exons")).alias("exonic"))


@query("select vid, round(1 / (1 + exp(-beta / 0.5e0)), 6) + 0e0 as p, case when beta > 0 then 'risk' when beta < 0 then 'protective' else 'neutral' end as sign, case when af_alt >= 0.2e0 then 'major' when af_alt >= 0.05e0 then 'moderate' else 'minor' end as size, case when beta * (pval - 0.5e0) > 0 then 'concordant' when beta * (pval - 0.5e0) < 0 then 'discordant' else 'unresolved' end as support, round(beta / se, 6) + 0e0 as z from v_variant")
def p31_p32_classes(v):
    x = F.col("beta")
    return v("v_variant").select("vid", c.to_prob(x, 0.5).alias("p"), c.sign_label(x).alias("sign"), c.contribution_class(F.col("af_alt")).alias("size"), c.support_class(x, F.col("pval") - 0.5).alias("support"), c.ratio_z(x, F.col("se")).alias("z"))


@query("""with m as (select cell_type, avg(score) as mean, median(score) as x, median(donor_id) as y, count(*) as n from v_cell group by 1), l as (select greatest(quantile_cont(abs(score - 50), 0.99), 1e-6) as high from v_cell)
select cell_type, round(mean, 6) + 0e0 as mean, row_number() over (order by mean desc, cell_type) as place, round(x, 6) + 0e0 as x, round(y, 6) + 0e0 as y, n, round(-high, 6) + 0e0 as low, round(high, 6) + 0e0 as high from m, l""")
def p35_p36_plot_tables(v):
    d = v("v_cell").withColumns({"shifted": F.col("score") - 50, "UMAP1": F.col("score"), "UMAP2": F.col("donor_id")})
    return cells.order_by_mean(d, "cell_type", "score").join(cells.centers(d, "cell_type"), "cell_type").join(F.broadcast(cells.sym_limits(d, "shifted")))  # one row
