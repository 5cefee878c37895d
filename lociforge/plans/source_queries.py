"""Queries of readers and writers: each writes files of a view to the shared folder and reads them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.shared import shared_folder
from ..sources import tables
from .registry import query


def _new(df: DataFrame, name: str) -> str:
    return f"{shared_folder(df.sparkSession)}/source-{uuid.uuid4().hex}/{name}"


@query("select rsid, pos, round(beta, 6) + 0e0 as beta, case when vid % 5 = 0 then null else ref end as ref from v_variant")
def s1_s14_delimited(v):
    d = v("v_variant").selectExpr("pos", "rsid", "case when vid % 5 = 0 then null else ref end as ref", "beta", "chrom")
    tables.write_table(d, path := _new(d, "variants.tsv.gz"), "tsv.gz")
    return tables.read_table(d.sparkSession, path, "pos bigint, rsid string, ref string, beta double, chrom string", parts=3).select("rsid", "pos", "beta", "ref")


@query("select chrom, pos, rsid, ref, alt from v_variant")
def s2_vcf(v):
    d = v("v_variant")
    lines = d.select(F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "rsid", "ref", "alt").alias("value"))
    head = d.sparkSession.createDataFrame([("##fileformat=VCFv4.2",), ("#CHROM\tPOS\tID\tREF\tALT",)], "value string")
    head.union(lines).write.text(path := _new(d, "variants.vcf"))
    return tables.read_variants_vcf(d.sparkSession, path)


@query("""with t as (select gene, chrom, tx_start, tx_end, cast(substr(gene, 2) as bigint) % 2 = 0 as plus from v_gene)
select gene as gene_name, 'E' || gene as gene_id, gene || '.1' as transcript_id, chrom, case when plus then '+' else '-' end as strand, tx_start, tx_end, case when plus then tx_start else tx_end end as tss, case when plus then tx_end else tx_start end as tes, cast(11 + 31 as bigint) as exonic_length,
 tx_start + 100 as last_exon from t""")
def s3_p29_a41_gene_geometry(v):
    g = v("v_gene").selectExpr("gene", "chrom", "tx_start", "tx_end", "case when cast(substr(gene, 2) as bigint) % 2 = 0 then '+' else '-' end as strand")
    line = lambda kind, a, b, tx: F.concat_ws("\t", "chrom", F.lit("x"), F.lit(kind), a.cast("string"), b.cast("string"), F.lit("."), "strand", F.lit("."), F.format_string(f'gene_id "E%s"; gene_name "%s"; transcript_id "%s.{tx}";', "gene", "gene", "gene"))
    at = F.col("tx_start")
    every = F.array(line("gene", at, at, 0), line("transcript", at, F.col("tx_end"), 1), line("transcript", at, at + 20, 2), line("exon", at + 100, at + 130, 1), line("exon", at, at + 10, 1), line("exon", at, at + 20, 2), F.lit("#comment"), F.lit("a\tb"))
    g.select(F.explode(every).alias("value")).write.text(path := _new(g, "genes.gtf"))
    out = tables.gene_geometry(tables.read_gtf(g.sparkSession, path).where("feature <> 'gene'"))
    return out.select("gene_name", "gene_id", "transcript_id", "chrom", "strand", "tx_start", "tx_end", "tss", "tes", "exonic_length", F.element_at("exons", -1)["start"].alias("last_exon"))


@query("select chrom, count(*) as n, true as named from v_variant group by 1")
def s4_s5_many_files(v):
    d = v("v_variant")
    d.write.partitionBy("chrom").parquet(path := _new(d, "variants"))
    got = tables.read_many(d.sparkSession, path)
    assert tables.read_parquet(d.sparkSession, path, ["vid", "pos"]).columns == ["vid", "pos"]
    return got.groupBy("chrom").agg(F.count("*").alias("n"), F.min(F.length("source_file") > 0).alias("named"))


@query("select vid, rsid, case when vid % 2 = 0 then 'even' else 'odd' end as part from v_variant")
def s6_manifest(v):
    d = v("v_variant").select("vid", "rsid")
    base = _new(d, "parts")
    d.where("vid % 2 = 0").withColumn("part", F.lit("even")).write.parquet(f"{base}/even")
    d.where("vid % 2 = 1").withColumn("part", F.lit("odd")).write.parquet(f"{base}/odd")
    m = d.sparkSession.createDataFrame([("a", "even"), ("b", f"{base}/odd"), ("c", None)], "name string, file string")
    m.coalesce(1).write.csv(f"{base}/manifest.tsv", sep="\t", header=True)
    return tables.read_manifest(d.sparkSession, f"{base}/manifest.tsv").select("vid", "rsid", "part")


@query("select distinct program, 'na' as description, gene from v_program")
def s7_gmt(v):
    d = v("v_program")
    tables.write_gmt(d, path := _new(d, "sets.gmt"))
    return tables.read_gmt(d.sparkSession, path)


@query("""select 'parquet' as form, gene, cast(tx_start as varchar) as x from v_gene union all select 'tab', gene, cast(tx_start as varchar) from v_gene union all select 'comma', gene, cast(tx_start as varchar) from v_gene union all select 'spaces', gene, cast(tx_start as varchar) from v_gene union all select 'list', gene, null from v_gene""")
def s8_format_fallback(v):
    d = v("v_gene").selectExpr("gene", "cast(tx_start as string) as x")
    spark, base = d.sparkSession, _new(d, "forms")
    d.write.parquet(f"{base}/a.parquet")
    for name, sep in (("tab", "\t"), ("comma", ","), ("spaces", " ")):
        d.coalesce(1).write.csv(f"{base}/{name}", sep=sep, header=True)
    d.select("gene").write.text(f"{base}/list")
    parts = [tables.read_table_auto(spark, f"{base}/{p}").select(F.lit(n).alias("form"), "gene", F.col("x").cast("string").alias("x")) for n, p in (("parquet", "a.parquet"), ("tab", "tab"), ("comma", "comma"), ("spaces", "spaces"))]
    parts.append(tables.read_table_auto(spark, f"{base}/list").select(F.lit("list").alias("form"), F.col("value").alias("gene"), F.lit(None).cast("string").alias("x")))
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).union(parts[4])


@query("""with c as (select distinct cell_type from v_cell), g as (select distinct donor_id % 9 as g from v_cell) select concat('g', cast(cast(g.g as bigint) as varchar)) as gene, c.cell_type as sample_id, coalesce(max(n), 0e0) as value
 from g cross join c left join (select donor_id % 9 as g, cell_type, count(*) * 1e0 as n from v_cell group by 1, 2) t on t.g = g.g and t.cell_type = c.cell_type group by 1, 2""")
def s9_s16_matrix(v):
    d = v("v_cell").selectExpr("concat('g', cast(donor_id % 9 as string)) as gene_name", "cell_type").groupBy("gene_name", "cell_type").agg(F.count("*").cast("double").alias("n"))
    names = sorted(x[0] for x in d.select("cell_type").distinct().collect())
    tables.write_matrix(d, "gene_name", "cell_type", "n", path := _new(d, "matrix"), names)
    return tables.read_expression_wide(d.sparkSession, path)


@query("select sample_id, count(*) as n, min(label) as label, min(coalesce(kind, 'none')) as kind from (select sample_id, case when cell_type = 'view' then grp else cell_type end as label, cast(null as varchar) as kind from v_cell) t group by 1")
def s10_cells(v):
    c = v("v_cell").selectExpr("sample_id", "event_id", "case when cell_type = 'view' then 'NA' else cell_type end as cell_type", "grp")
    v("v_expr").write.parquet(e := _new(c, "expr"))
    c.write.parquet(o := _new(c, "obs"))
    _, m = tables.read_cells(c.sparkSession, e, o, {"label": ["absent", "cell_type", "grp"], "kind": ["absent"]})
    return m.groupBy("sample_id").agg(F.count("*").alias("n"), F.min("label").alias("label"), F.min(F.coalesce("kind", F.lit("none"))).alias("kind"))


@query("select 'p' as rule, vid from v_variant where pval < 0.05e0 union all select 'mlogp', vid from v_variant where -log10(pval) >= 1.3e0 and chrom in ('chr1', 'chr22', 'chr3', 'chr4') and chrom <> 'chr3'")
def s12_s13_sumstats(v):
    d = v("v_variant").withColumns({"text_p": F.col("pval").cast("string"), "mlogp": -F.log10("pval")})
    a = tables.filter_sumstats(d, "text_p").select(F.lit("p").alias("rule"), "vid")
    b = tables.filter_sumstats(d.where("chrom in ('chr1', 'chr22', 'chr3', 'chr4')").withColumn("chrom", F.regexp_replace("chrom", "chr3", "chrX")), log10p_col="mlogp", autosomes_of="chrom")
    return a.union(b.select(F.lit("mlogp").alias("rule"), "vid"))


@query("select vid, rsid from v_variant")
def s15_append_resume(v):
    d = v("v_variant").select("vid", "rsid")
    path = _new(d, "grown")
    tables.append_new(d.where("vid % 3 = 0"), path, ["vid"])
    for _ in range(2):
        tables.append_new(d, path, ["vid"])
    return d.sparkSession.read.parquet(path)


@query("""with n as (select cell_type, count(*) as n, cast(ceil(count(*) / 37e0) as bigint) as s from v_cell group by 1) select cell_type, shard, cast(ceil((shard + 1) * n * 1e0 / s) - ceil(shard * n * 1e0 / s) as bigint) as n from (select *, unnest(range(0, s)) as shard from n) t""")
def s17_shards(v):
    return tables.shard_manifest(tables.split_shards(v("v_cell"), "cell_type", ["event_id"], 37), "cell_type")


@query("select 'rows' as metric, count(*) * 1e0 as value from v_variant union all select 'mean_beta', round(avg(beta), 6) + 0e0 from v_variant union all select 'rare', count(case when af_alt < 0.01e0 then 1 end) * 1e0 from v_variant")
def s18_metrics(v):
    return tables.metrics_table(v("v_variant"), {"rows": F.count("*"), "mean_beta": F.avg("beta"), "rare": F.count_if(F.col("af_alt") < 0.01)})


@query("select pos, chrom, vid from (select *, row_number() over (partition by pos order by cast(substr(chrom, 4) as int), vid) as rn from v_variant) t where rn = 1")
def s19_chromosomes(v):
    d = v("v_variant").select("vid", "pos", "chrom")
    tables.write_by_chrom(d, path := _new(d, "by_chrom"))
    return tables.merge_chroms(d.sparkSession, path, ["pos"]).select("pos", "chrom", "vid")


@query("select 'rows' as rule, 'critical' as level, count(*) > 0 as ok from v_variant union all select 'p', 'critical', min(pval) > 0 and max(pval) <= 1 from v_variant union all select 'no_zero_beta', 'warn', count(case when beta = 0 then 1 end) = 0 from v_variant")
def s20_checks(v):
    rules = {"rows": (F.count("*") > 0, "critical"), "p": ((F.min("pval") > 0) & (F.max("pval") <= 1), "critical"), "no_zero_beta": (F.count_if(F.col("beta") == 0) == 0, "warn")}
    return tables.check(v("v_variant"), rules)
