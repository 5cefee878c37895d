"""Genomics-shaped views of the supplied tables, in SQL that Spark and DuckDB read alike: whole numbers only, doubles as 1e0."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")
VIEWS = {
    "v_variant": """select concat('chr', cast(1 + o_orderkey % 22 as string)) as chrom, cast(1 + (o_orderkey * 37) % 5000 as bigint) as pos,
        concat('rs', cast(o_orderkey as string)) as rsid, o_orderkey as vid, substr('ACGT', cast(1 + o_orderkey % 4 as int), 1) as ref,
        substr('ACGT', cast(1 + (o_orderkey + 1 + o_custkey % 3) % 4 as int), 1) as alt, ((o_orderkey * 7919) % 10007 + 1) / 10008e0 as pval,
        (o_custkey % 41 - 20) / 10e0 as beta, (1 + o_custkey % 9) / 10e0 as se, (o_orderkey % 100) / 100e0 as af_alt from orders""",
    "v_interval": """select concat('chr', cast(1 + p_partkey % 22 as string)) as chrom, cast((p_partkey * 53) % 5000 as bigint) as start,
        cast((p_partkey * 53) % 5000 + p_size as bigint) as stop, p_partkey as identifier, p_type as component, p_retailprice as mean_signal from part""",
    "v_gene": """select concat('chr', cast(1 + s_suppkey % 22 as string)) as chrom, cast((s_suppkey * 97) % 4800 as bigint) as tx_start,
        cast((s_suppkey * 97) % 4800 + 150 as bigint) as tx_end, concat('G', cast(s_suppkey as string)) as gene from supplier""",
    "v_qtl": """select concat('rs', cast(l_orderkey as string)) as rsid, l_orderkey as vid, concat('G', cast(l_suppkey as string)) as gene,
        concat(l_returnflag, l_linestatus) as type, l_quantity - 25 as beta, 1 + l_linenumber / 10e0 as se,
        ((l_partkey * 31 + l_orderkey * 7) % 9973 + 1) / 9974e0 as pvalue from lineitem""",
    "v_ld": """select a.o_orderkey as variant1, b.o_orderkey as variant2, 1e0 / (b.o_orderkey - a.o_orderkey) as r2, 1e0 / (b.o_orderkey - a.o_orderkey) as r
        from (select distinct o_orderkey, d, o_orderkey + d as other from orders cross join (select 1 as d union all select 2 union all select 3) s) a
        join (select distinct o_orderkey from orders) b on b.o_orderkey = a.other""",
    "v_mr": """select concat('G', cast(l_suppkey as string)) as gene, case when l_linestatus = 'O' then 'brain' else 'blood' end as tissue,
        (l_quantity - 25) / 10e0 as beta, (1 + l_linenumber) / 10e0 as se, ((l_partkey * 17 + l_orderkey) % 9973 + 1) / 9974e0 as pvalue,
        1 + l_linenumber / 10e0 as confidence, l_orderkey as k, l_partkey as k2 from lineitem""",
    "v_ppi": """select distinct concat('G', cast(l_suppkey as string)) as gene_u, concat('G', cast(l_partkey % 100 as string)) as gene_v from lineitem""",
    "v_cell": """select user_id as sample_id, user_id as donor_id, event_type as cell_type, case when user_id % 2 = 0 then 'case' else 'control' end as grp,
        case when user_id % 2 = 0 then 'PD' else 'normal' end as disease, value as score, event_id from events""",
    "v_expr": """select user_id as sample_id, concat('g', cast(event_id % 40 as string)) as gene, sum(floor(value)) as value from events group by 1, 2""",
    "v_pred": """select concat('P', cast(p_partkey as string)) as gene, p_partkey % 7 = 0 as is_seed, ((p_partkey * 37) % 101 - 50) / 25e0 as raw_pred_beta_score,
        ((p_partkey * 37 + p_size) % 101) / 100e0 as calibrated_prob_risk, 1e0 - ((p_partkey * 37 + p_size) % 101) / 100e0 as calibrated_prob_protective,
        ((p_partkey * 41) % 91) / 90e0 as platt_prob_risk, ((p_partkey * 11) % 21 - 10) / 10e0 as rwr_pred_beta, p_size % 4 as n_brain_or_neural_dhs_snvs,
        case when p_partkey % 9 = 0 then 'Frontal_Neuron' when p_partkey % 5 = 0 then 'Liver' end as top_dhs_tissue, ((p_partkey * 29) % 100) / 200e0 as top_relative_contribution from part""",
    "v_track": """select vec_id, embedding as d from embeddings where embedding is not null""",
    "v_program": """select concat('g', cast(r_regionkey * 3 + 1 as string)) as gene, 'risk' as program, 'risk' as direction from region
        union all select concat('g', cast(r_regionkey * 3 + 20 as string)), 'protective', 'protective' from region""",
    "v_link": """select l_orderkey as reg_vid, concat('rs', cast(l_orderkey as string)) as reg_rsid, concat('rs', cast(l_partkey as string)) as gwas_rsid,
        concat('G', cast(l_suppkey as string)) as gene, (l_quantity - 25) / 10e0 as gwas_beta, (1 + l_linenumber) / 10e0 as gwas_se,
        ((l_partkey * 13 + l_orderkey) % 9973) / 9974e0 as gwas_pval, (l_linenumber % 5 - 2) / 2e0 as r, (l_linenumber % 5) / 4e0 as r2,
        l_linenumber as n, (l_quantity - 25) / 5e0 as effect, (l_suppkey % 7 - 3) / 2e0 as pred from lineitem""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the tables of a folder, which are read by path: nothing is registered in the caller's session."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b(from|join) {t}\b", VIEWS[name])}
    return spark.sql(re.sub(r"\b(from|join) (" + "|".join(TABLES) + r")\b", r"\1 {\2}", VIEWS[name]), **tables)


def with_views(sql: str) -> str:
    """Oracle SQL with the views it names in front."""
    used = [v for v in VIEWS if v in sql]
    body = ",\n".join(f"{v} as ({VIEWS[v].replace('as string)', 'as varchar)')})" for v in used)
    sql = sql.lstrip()
    if not used:
        return sql
    for head in ("with recursive ", "with "):
        if sql.startswith(head):
            return f"{head}{body},\n{sql[len(head):]}"
    return f"with {body}\n{sql}"
