"""Column functions: keys, cleaning, labels and small formulas. All are built-in expressions; bad input gives null, not an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of a missing text, of a true one, and of the control group.
NULL_WORDS = ("", ".", "NA", "NAN", "NONE", "NULL", "N/A")
TRUE_WORDS = ("true", "1", "yes", "y", "t")
CONTROL_WORDS = ("normal", "control", "controls", "ctrl", "healthy", "healthy control", "hc")
AUTOSOMES = tuple(f"chr{i}" for i in range(1, 23))
TEST_CHROMS, VALIDATION_CHROMS = ("chr1", "chr6", "chr19"), ("chr2", "chr7", "chr17")


def clean_null(c: Column) -> Column:
    """Trimmed text; null for any spelling of missing."""
    t = F.trim(c.cast("string"))
    return F.when(~F.upper(t).isin(*NULL_WORDS), t)


def num(c: Column) -> Column:
    """A double; null where it can't be read or isn't a number."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def clean_chrom(c: Column) -> Column:
    """Chromosome name without chr in any case or a trailing .0, in upper case."""
    return F.upper(F.regexp_replace(F.regexp_replace(clean_null(c), r"(?i)^chr", ""), r"\.0$", ""))


def norm_chrom(c: Column) -> Column:
    """Chromosome name as chrN."""
    return F.concat(F.lit("chr"), clean_chrom(c))


def is_autosome(c: Column) -> Column:
    return norm_chrom(c).isin(*AUTOSOMES)


def chrom_order(c: Column) -> Column:
    """Natural order of chromosomes: 1 to 22, then X, Y, M, then others."""
    x = clean_chrom(c)
    return F.when(x == "X", 23).when(x == "Y", 24).when(x.isin("M", "MT"), 25).otherwise(F.coalesce(x.try_cast("int"), F.lit(99)))


def variant_key(chrom: Column, pos: Column, ref: Column, alt: Column, style: str = "vid") -> Column:
    """vid: chrN_pos_REF_ALT; colon: N:pos:REF:ALT; both with upper-case alleles."""
    r, a, p = F.upper(ref), F.upper(alt), pos.cast("long").cast("string")
    if style == "vid":
        parts, sep = (norm_chrom(chrom), p, r, a), "_"
    elif style == "colon":
        parts, sep = (clean_chrom(chrom), p, r, a), ":"
    else:
        raise ValueError(f"unknown style {style}")
    return _joined(parts, sep)


def _joined(parts, sep: str) -> Column:
    """Parts with a separator; null if any part is, unlike concat_ws."""
    out = parts[0]
    for p in parts[1:]:
        out = F.concat(out, F.lit(sep), p)
    return out


def parse_vid(c: Column) -> Column:
    """A struct of chrom, pos, ref and alt from a chrN_pos_REF_ALT key; null fields where parts are missing."""
    p = F.split(c, "_")
    return F.struct(norm_chrom(F.get(p, 0)).alias("chrom"), F.get(p, 1).try_cast("long").alias("pos"), F.get(p, 2).alias("ref"), F.get(p, 3).alias("alt"))


def norm_dhs_id(c: Column) -> Column:
    """An interval id without its prefix, as the text of a float where it is one."""
    last = F.element_at(F.split(F.trim(c.cast("string")), ":"), -1)
    return F.coalesce(last.try_cast("double").cast("string"), last)


def is_snv(ref: Column, alt: Column, distinct: bool = False) -> Column:
    ok = F.upper(ref).rlike("^[ACGT]$") & F.upper(alt).rlike("^[ACGT]$")
    return F.coalesce(ok & (F.upper(ref) != F.upper(alt)) if distinct else ok, F.lit(False))


def split_rsids(c: Column) -> Column:
    """All ids of a list parted by commas, semicolons or spaces."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"[,;\s]+"), lambda x: ~x.isin("", "."))


def first_rsid(c: Column) -> Column:
    return F.get(split_rsids(c), 0)


def clean_gene(c: Column, upper: bool = True, squeeze: bool = False) -> Column:
    """A trimmed gene symbol, null if missing; `squeeze` takes out inner spaces."""
    g = clean_null(c)
    g = F.regexp_replace(g, r"\s+", "") if squeeze else g
    return F.upper(g) if upper else g


def parse_bool(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def strip_prefix(c: Column, prefix: str) -> Column:
    return F.when(F.startswith(c, F.lit(prefix)), F.substring(c, F.lit(len(prefix) + 1), F.length(c))).otherwise(c)


def harmonize_beta(beta: Column, effect_allele: Column, other_effect_allele: Column) -> Column:
    """The effect for the other study's effect allele: its sign is turned if the alleles differ."""
    return F.when(F.upper(effect_allele) == F.upper(other_effect_allele), beta).otherwise(-beta)


def risk_direction(qtl_beta: Column, gwas_beta: Column) -> Column:
    return F.signum(qtl_beta) * F.signum(gwas_beta)


def allele_pair_ok(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Whether two studies have the same pair of single-base alleles, in either order."""
    pair = lambda x, y: F.concat(F.least(F.upper(x), F.upper(y)), F.greatest(F.upper(x), F.upper(y)))
    return F.coalesce(is_snv(a1, a2) & is_snv(b1, b2) & (pair(a1, a2) == pair(b1, b2)), F.lit(False))


def palindromic(a1: Column, a2: Column) -> Column:
    return F.concat(F.upper(a1), F.upper(a2)).isin("AT", "TA", "CG", "GC")


def labels(c: Column) -> Column:
    """The labels of a composite one (a||b; c,d/e), in order."""
    return F.filter(F.transform(F.split(c, r"\|\||[;,/]"), lambda x: F.trim(x)), lambda x: x != "")


def abbreviate(c: Column, names: dict[str, str], initials: bool = False) -> Column:
    """Each label's short form, joined with +; labels without one stay or give their initials."""

    def short(x: Column) -> Column:
        first = F.array_join(F.transform(F.split(x, r"[\s_-]+"), lambda w: F.upper(F.substring(w, 1, 1))), "")
        out = first if initials else x
        for k, v in names.items():
            out = F.when(F.lower(x) == k.lower(), F.lit(v)).otherwise(out)
        return out

    return F.array_join(F.transform(labels(c), short), "+")


def safe_name(c: Column) -> Column:
    """A label fit for ids and file names."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", "")


def norm_group(c: Column, cases: dict[str, str] | None = None) -> Column:
    """normal for any spelling of the control group; case spellings by pattern; others as they are."""
    x = F.lower(F.trim(c))
    out = F.when(x.isin(*CONTROL_WORDS), F.lit("normal"))
    for pattern, name in (cases or {r"^(pd|parkinson.*)$": "PD"}).items():
        out = out.when(x.rlike(pattern), F.lit(name))
    return out.otherwise(F.trim(c))


def pseudo_p(confidence: Column) -> Column:
    """The p of a -log10 confidence, which counts up to 300."""
    return F.pow(F.lit(10.0), -F.least(confidence, F.lit(300.0)))


def neg_log10(p: Column, smallest: Column | float = 1e-300) -> Column:
    return -F.log10(F.greatest(p, smallest if isinstance(smallest, Column) else F.lit(smallest)))


def track_delta(ref: Column, alt: Column, pseudo: float = 1.0) -> Column:
    """log2 fold change of each track."""
    return F.zip_with(ref, alt, lambda r, a: F.log2((a + pseudo) / (r + pseudo)))


def bins_for_window(start: Column, n: int, bin_size: int = 32) -> Column:
    """Centred bins of a window as structs of start and end, 0-based and half-open."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((start + i * bin_size).alias("start"), (start + (i + 1) * bin_size).alias("end")))


def bins_overlapping(bins: Column, exons: Column) -> Column:
    """Indexes of the bins that any interval overlaps."""
    hits = F.transform(bins, lambda b, i: F.when(F.exists(exons, lambda e: (e["start"] < b["end"]) & (e["end"] > b["start"])), i))
    return F.filter(hits, lambda i: i.isNotNull())


def exonic_length(exons: Column) -> Column:
    return F.aggregate(exons, F.lit(0).cast("long"), lambda s, e: s + e["end"].cast("long") - e["start"].cast("long") + 1)


def ratio_z(beta: Column, se: Column) -> Column:
    return F.try_divide(beta, se)


def to_prob(x: Column, sd: Column | float = 1.0) -> Column:
    z = F.try_divide(x, sd if isinstance(sd, Column) else F.lit(float(sd)))
    return F.least(F.greatest(1 / (1 + F.exp(-z)), F.lit(0.0)), F.lit(1.0))


def sign_label(c: Column) -> Column:
    return F.when(c > 0, "risk").when(c < 0, "protective").when(c == 0, "neutral")


def contribution_class(share: Column, major: float = 0.20, minor: float = 0.05) -> Column:
    return F.when(share >= major, "major").when(share >= minor, "moderate").when(share.isNotNull(), "minor")


def support_class(a: Column, b: Column) -> Column:
    """Whether two effects agree in sign."""
    return F.when(a * b > 0, "concordant").when(a * b < 0, "discordant").otherwise("unresolved")


def chrom_split(c: Column) -> Column:
    x = norm_chrom(c)
    return F.when(x.isin(*TEST_CHROMS), "test").when(x.isin(*VALIDATION_CHROMS), "val").otherwise("train")


def reduced_tracks(d: Column, scale: float = 1.0) -> dict[str, Column]:
    """Per row of tracks: mean, mean of absolutes, sample deviations of both, largest and summed absolute, and the first
    track of the largest absolute with its value. Nulls and non-finite values count as 0."""
    x = F.transform(d, lambda v: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(0.0)).otherwise(v.cast("double") * scale))
    n = F.size(d)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)

    def sd(a: Column) -> Column:
        mean = F.try_divide(total(a), n)
        return F.sqrt(F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)), n - 1))

    absolute = F.transform(x, F.abs)
    top = F.array_max(F.transform(absolute, lambda v, i: F.struct(v.alias("v"), (-i).alias("i"))))
    return {
        "mean_d": F.try_divide(total(x), n),
        "meanabs_d": F.try_divide(total(absolute), n),
        "mean_d_std": sd(x),
        "meanabs_d_std": sd(absolute),
        "maxabs_d": F.array_max(absolute),
        "sumabs_d": total(absolute),
        "top_track": -top["i"] + 1,
        "top_value": F.get(x, -top["i"]),
    }


def exact_sum(c: Column) -> Column:
    """The sum at 18 decimal places, which no order of the rows changes; so equal values have equal sums. For sums up
    to 1e20."""
    return F.sum(c.cast("decimal(38,18)")).cast("double")
