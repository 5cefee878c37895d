"""Readers and writers. Schemas are explicit: text columns are read as text and cast with errors to null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import clean_null, num
from ..operators.select import best_per_key


class CheckFailed(ValueError):
    """A critical data check didn't hold."""


def read_table(spark: SparkSession, path: str, schema: str | T.StructType, sep: str = "\t", parts: int | None = None) -> DataFrame:
    """A delimited table with a header. Columns are taken by name; unsplittable (gz) files can be dealt out after reading."""
    df = spark.read.schema(schema).csv(path, sep=sep, header=True, enforceSchema=False, mode="PERMISSIVE")
    return df.repartition(parts) if parts else df


def read_variants_vcf(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos, rsid, ref, alt of a VCF body."""
    return spark.read.schema("chrom string, pos int, rsid string, ref string, alt string").csv(path, sep="\t", comment="#")


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """seqname, feature, start, end, strand, gene_id, gene_name, transcript_id: lines of nine fields with a transcript; the
    gene's name is its id where it has none."""
    lines = spark.read.text(path).where(~F.startswith("value", F.lit("#"))).select(F.split("value", "\t").alias("f")).where(F.size("f") == 9)
    attr = lambda n: F.nullif(F.regexp_extract(F.get("f", 8), n + r' "([^"]*)"', 1), F.lit(""))
    d = lines.select(
        F.get("f", 0).alias("seqname"), F.get("f", 2).alias("feature"), F.get("f", 3).try_cast("int").alias("start"), F.get("f", 4).try_cast("int").alias("end"), F.get("f", 6).alias("strand"),
        attr("gene_id").alias("gene_id"), F.coalesce(attr("gene_name"), attr("gene_id")).alias("gene_name"), attr("transcript_id").alias("transcript_id"),
    )
    return d.where("transcript_id is not null")


def gene_geometry(gtf: DataFrame) -> DataFrame:
    """One row a gene: its longest transcript with span, tss and tes by strand, ordered exons and exonic length."""
    tx = gtf.where("feature = 'transcript'").withColumn("len", F.col("end") - F.col("start") + 1)
    best = best_per_key(tx, ["gene_name"], [F.desc("len"), F.col("transcript_id")])
    exons = gtf.where("feature = 'exon'").groupBy("transcript_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("exons"))
    d = best.join(exons, "transcript_id", "left")
    plus = F.col("strand") == "+"
    length = F.aggregate(F.coalesce("exons", F.array().cast("array<struct<start:int,end:int>>")), F.lit(0), lambda s, e: s + e["end"] - e["start"] + 1)
    return d.select(
        "gene_name", "gene_id", "transcript_id", F.col("seqname").alias("chrom"), "strand", F.col("start").alias("tx_start"), F.col("end").alias("tx_end"),
        F.when(plus, F.col("start")).otherwise(F.col("end")).alias("tss"), F.when(plus, F.col("end")).otherwise(F.col("start")).alias("tes"), length.alias("exonic_length"), "exons",
    )


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_many(spark: SparkSession, glob: str, with_source: bool = True, fmt: str = "parquet", **options) -> DataFrame:
    """All files of a pattern in one scan, with the name of the file that each row is from."""
    df = spark.read.format(fmt).options(**options).load(glob)
    return df.withColumn("source_file", F.col("_metadata.file_name")) if with_source else df


def read_manifest(spark: SparkSession, manifest: str, path_cols: tuple[str, ...] = ("path", "file", "filename"), fmt: str = "parquet", sep: str = "\t") -> DataFrame:
    """The tables that a manifest lists, relative paths from its folder, in one scan with source_file."""
    m = spark.read.csv(manifest, sep=sep, header=True)
    col = next((c for c in path_cols if c in m.columns), None)
    if col is None:
        raise ValueError(f"no path column among {m.columns}")
    base = manifest.rsplit("/", 1)[0]
    paths = [x[0] if "://" in x[0] or x[0].startswith("/") else f"{base}/{x[0]}" for x in m.select(col).where(f"{col} is not null").distinct().collect()]
    return spark.read.format(fmt).load(sorted(paths)).withColumn("source_file", F.col("_metadata.file_name"))


def read_gmt(spark: SparkSession, path: str) -> DataFrame:
    """(program, description, gene) of a gene-set file."""
    f = spark.read.text(path).select(F.split("value", "\t").alias("f")).where(F.size("f") >= 3)
    genes = F.filter(F.slice("f", F.lit(3), F.size("f")), lambda g: F.trim(g) != "")
    return f.select(F.get("f", 0).alias("program"), F.get("f", 1).alias("description"), F.explode(genes).alias("gene"))


def write_gmt(df: DataFrame, path: str, program: str = "program", gene: str = "gene", description: str = "na") -> None:
    sets = df.groupBy(program).agg(F.array_sort(F.collect_set(gene)).alias("g"))
    sets.select(F.concat_ws("\t", F.col(program), F.lit(description), F.array_join("g", "\t")).alias("value")).write.mode("overwrite").text(path)


def read_table_auto(spark: SparkSession, path: str) -> DataFrame:
    """Parquet by suffix; else text with the separator that the first line has: tab, comma or spaces; a bare list is one column."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    head = spark.read.text(path).limit(1).collect()
    line = head[0][0] if head else ""
    if "\t" in line or "," in line:
        return spark.read.csv(path, sep="\t" if "\t" in line else ",", header=True)
    if " " in line.strip():
        names = line.split()
        rows = spark.read.text(path).where(F.col("value") != line).select(F.split(F.trim("value"), r"\s+").alias("f"))
        return rows.select(*(F.get("f", i).alias(n) for i, n in enumerate(names)))
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")


def read_expression_wide(spark: SparkSession, path: str, gene_col: str = "gene_name", drop: tuple[str, ...] = ("Geneid", "gene_type", "Length"), sep: str = "\t") -> DataFrame:
    """Genes by samples to long (gene, sample_id, value); genes without any value go."""
    df = spark.read.csv(path, sep=sep, header=True)
    gene = gene_col if gene_col in df.columns else df.columns[0]
    samples = [c for c in df.columns if c != gene and c not in drop]
    d = df.select(F.col(f"`{gene}`").alias("gene"), *(num(F.col(f"`{c}`")).alias(c) for c in samples))
    return d.unpivot(["gene"], samples, "sample_id", "value").where("value is not null and gene is not null")


def read_cells(spark: SparkSession, expr: str, obs: str, fallbacks: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """Long expression and cell metadata, each wanted label from the first of its columns that is there."""
    e, m = spark.read.parquet(expr), spark.read.parquet(obs)
    made = {k: F.coalesce(*(clean_null(F.col(c)) for c in names if c in m.columns)) if any(c in m.columns for c in names) else F.lit(None).cast("string") for k, names in fallbacks.items()}
    return e, m.withColumns(made)


def filter_sumstats(df: DataFrame, p_col: str | None = None, max_p: float = 0.05, log10p_col: str | None = None, min_log10p: float = 1.3, autosomes_of: str | None = None) -> DataFrame:
    """Summary statistics by p (below the bound) or -log10 p (at least the bound), optionally autosomes only."""
    from ..functions.columns import is_autosome

    d = df.where(num(F.col(p_col)) < max_p) if p_col else df.where(num(F.col(log10p_col)) >= min_log10p)
    return d.where(is_autosome(F.col(autosomes_of))) if autosomes_of else d


def gene_from_file(df: DataFrame, pattern: str = r"^[0-9]+_[0-9]+_([^_]+)_") -> DataFrame:
    return df.withColumn("gene", F.nullif(F.regexp_extract("source_file", pattern, 1), F.lit("")))


def write_table(df: DataFrame, path: str, fmt: str = "tsv", mode: str = "overwrite") -> None:
    if fmt == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        df.write.mode(mode).csv(path, sep="\t", header=True, compression="gzip" if fmt == "tsv.gz" else None)


def append_new(df: DataFrame, path: str, keys: list[str]) -> None:
    """Appends the rows whose key isn't in the table yet: a stopped job goes on where it was."""
    spark = df.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        df = df.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    df.write.mode("append").parquet(path)


def write_matrix(df: DataFrame, row: str, col: str, value: str, path: str, columns: list[str]) -> None:
    """Rows by the listed columns; missing values are 0. Long tables are the better form beyond some thousands of columns."""
    wide = df.groupBy(row).pivot(col, columns).agg(F.first(value)).na.fill(0.0)
    wide.write.mode("overwrite").csv(path, sep="\t", header=True)


def split_shards(df: DataFrame, label: str, id_cols: list[str], max_rows: int = 200_000) -> DataFrame:
    """Adds shard: each label's rows dealt evenly to as few shards of at most `max_rows` as can be. Ranks are taken in ranges
    of the hash order with their offsets, so that a label with most of the rows is spread."""
    d = df.withColumns({"__h": F.xxhash64(*id_cols), "__b": F.pmod(F.shiftright(F.xxhash64(*id_cols), 40), F.lit(1024)).cast("int")})
    n = d.groupBy(label, "__b").agg(F.count("*").alias("__n"))
    over = Window.partitionBy(label)
    n = n.withColumns({"__before": F.sum("__n").over(over.orderBy("__b")) - F.col("__n"), "__all": F.sum("__n").over(over)}).withColumnRenamed(label, "__label")
    d = d.withColumn("__rn", F.row_number().over(Window.partitionBy(label, "__b").orderBy("__h", *id_cols)))
    d = d.alias("d").join(n.alias("n"), F.col(f"d.{label}").eqNullSafe(F.col("n.__label")) & (F.col("d.__b") == F.col("n.__b")))
    shards = F.ceil(F.col("__all") / max_rows)
    return d.withColumn("shard", F.floor((F.col("__before") + F.col("__rn") - 1) * shards / F.col("__all")).cast("int")).select(*(F.col(f"d.{c}") for c in df.columns), "shard")


def shard_manifest(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label, "shard").agg(F.count("*").alias("n"))


def metrics_table(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """(metric, value) rows of one aggregation."""
    return df.agg(*(c.cast("double").alias(n) for n, c in metrics.items())).unpivot([], list(metrics), "metric", "value")


def write_by_chrom(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("chrom").parquet(path)


def merge_chroms(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """All chromosomes in one table; of a repeated key the first in genomic order stays."""
    from ..functions.columns import chrom_order

    df = spark.read.parquet(path)
    return best_per_key(df, keys, [chrom_order(F.col("chrom")), F.col("pos"), *(F.col(c) for c in df.columns if c not in ("chrom", "pos"))])


def check(df: DataFrame, rules: dict[str, tuple[Column, str]]) -> DataFrame:
    """Evaluates all rules (an aggregate condition and critical or warn) in one pass: (rule, level, ok). A critical one that
    doesn't hold raises CheckFailed."""
    r = df.agg(*(F.coalesce(c, F.lit(False)).alias(f"r{i}") for i, (c, _) in enumerate(rules.values()))).first()
    rows = [(n, level, bool(r[f"r{i}"])) for i, (n, (_, level)) in enumerate(rules.items())]
    bad = [n for n, level, ok in rows if not ok and level == "critical"]
    if bad:
        raise CheckFailed(", ".join(bad))
    return df.sparkSession.createDataFrame(rows, "rule string, level string, ok boolean")
