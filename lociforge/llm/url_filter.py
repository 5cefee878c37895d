"""URL filters: host and path rules, and a list of canonical URLs behind a blocked Bloom filter.

The filter has blocks of 256 bits in four longs; a URL sets two bits in each long of its one block. Its size is bounded
whatever the list holds, so it is broadcast; a full filter passes more rows and loses none. What it passes meets the
list itself in a hash join, which removes the false positives. Everything is a Spark expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks of the filter at most: 65,536 x 40 bytes.
MAX_BLOCKS = 1 << 16
KEYS_PER_BLOCK = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Host and path rules of the query: verdict, host, path start.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def _rest(url: Column) -> Column:
    """What follows the first :// ; null where there is none."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host_: Column, path_: Column) -> Column:
    """Host without a leading www. or m., path without .html or slashes at its end; null without a host."""
    bare = F.regexp_replace(path_, r"(\.html)?/*$", "")
    return F.when(host_ != "", F.concat(F.regexp_replace(host_, r"^(www|m)\.", ""), bare))


def longest_rule(host_: Column, path_: Column, rules=RULES) -> tuple[Column, Column]:
    """The text and verdict of the longest rule that fits host and path; nulls if none does."""
    text = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # the last that fits wins
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def _masks(url: str) -> list[str]:
    """SQL of the two bits that a URL has in each long of its block."""
    bits = f"xxhash64({url}, 7)"
    return [f"(shiftleft(1L, cast(shiftrightunsigned({bits}, {16 * w}) & 63 as int)) | shiftleft(1L, cast(shiftrightunsigned({bits}, {16 * w + 8}) & 63 as int)))" for w in range(4)]


def bloom_blocks(listed: DataFrame, n_blocks: int) -> DataFrame:
    """The filter as rows (block, w0..w3); `listed` has a column url."""
    made = listed.select(F.expr(f"pmod(xxhash64(url), {n_blocks}L)").alias("block"), *(F.expr(m).alias(f"m{i}") for i, m in enumerate(_masks("url"))))
    return made.groupBy("block").agg(*(F.bit_or(f"m{i}").alias(f"w{i}") for i in range(4)))


def block_count(n_listed: int) -> int:
    return min(MAX_BLOCKS, 1 << max(0, (n_listed // KEYS_PER_BLOCK).bit_length()))


def on_list(rows: DataFrame, url: str, listed: DataFrame) -> DataFrame:
    """`rows` with listed (boolean): whether the column `url` is in `listed.url`. Null URLs are not. Repeats in the list do no harm."""
    listed = listed.select("url").where("url is not null").distinct()
    n_blocks = block_count(listed.count())
    blocks = bloom_blocks(listed, n_blocks).withColumnRenamed("block", "__block")
    probe = rows.withColumn("__probe", F.expr(f"pmod(xxhash64({url}), {n_blocks}L)"))
    probe = probe.join(F.broadcast(blocks), probe["__probe"] == blocks["__block"], "left")  # at most MAX_BLOCKS rows
    all_set = F.lit(True)
    for i, m in enumerate(_masks(url)):
        all_set = all_set & (F.col(f"w{i}").bitwiseAND(F.expr(m)) == F.expr(m))
    probe = probe.withColumn("__maybe", F.coalesce(all_set & F.col(url).isNotNull(), F.lit(False))).select(*rows.columns, "__maybe")
    hits = probe.where("__maybe").drop("__maybe")
    exact = hits.join(listed.select(F.col("url").alias("__listed")), hits[url] == F.col("__listed"), "left")
    exact = exact.withColumn("listed", F.col("__listed").isNotNull()).drop("__listed")
    return exact.unionByName(probe.where("not __maybe").drop("__maybe").withColumn("listed", F.lit(False)))


def listed_urls(pages: DataFrame, labels: DataFrame, bad: str = "toxic = 1") -> DataFrame:
    """The list of the query: canonical URLs of pages whose number at the end of the path is that of a document with a bad label."""
    p = pages.select(path(F.col("url")).alias("p"), canonical(host(F.col("url")), path(F.col("url"))).alias("url"))
    p = p.select("url", F.expr(r"try_cast(nullif(regexp_extract(p, '([0-9]+)([.]html)?/*$', 1), '') as bigint)").alias("doc_id"))
    return p.join(labels.where(bad).select("doc_id").distinct(), "doc_id", "left_semi").select("url").where("url is not null").distinct()


def judge_urls(pages: DataFrame, listed: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule (text of the longest rule that fits, or null), verdict and listed of every row.

    The rule's verdict stands; without a rule, URLs on the list are blocked and others allowed. Null URLs and those
    without :// have an empty host and path, fit no rule, are on no list and are allowed. Null ids stay, repeated rows
    are judged one by one, an empty list blocks nothing, an empty table gives no rows, other columns are not read.
    """
    p = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("__url"))
    p = p.select("page_id", host(F.col("__url")).alias("host"), path(F.col("__url")).alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    p = p.withColumns({"rule": rule, "__verdict": verdict, "__canonical": canonical(F.col("host"), F.col("path"))})
    p = on_list(p, "__canonical", listed)
    return p.select("page_id", "host", "path", "rule", F.coalesce("__verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


ORACLE = r"""
with parts as (
  select page_id, case when url is not null and contains(url, '://') then substr(url, strpos(url, '://') + 3) end as rest from pages
), hp as (
  select page_id,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path
  from parts
), named as (
  select *, case when host <> '' then regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(\.html)?/*$', '') end as url,
    try_cast(nullif(regexp_extract(path, '([0-9]+)([.]html)?/*$', 1), '') as bigint) as num
  from hp
), listed as (
  select distinct url from named where url is not null and num in (select doc_id from labels where toxic = 1)
), ruled as (
  select *, case
    when (host = 'example.org' or host like '%.example.org') and path like '/en/1%' then 'example.org/en/1'
    when (host = 'example.org' or host like '%.example.org') and path like '/es/%' then 'example.org/es/'
    when (host = 'com' or host like '%.com') and path like '/fr/%' then 'com/fr/'
    when (host = 'com' or host like '%.com') and path like '/de/%' then 'com/de/'
    when (host = 'org' or host like '%.org') and path like '/%' then 'org/'
    end as rule
  from named
)
select page_id, host, path, rule,
  case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block'
    when url in (select url from listed) then 'block' else 'allow' end as verdict,
  coalesce(url in (select url from listed), false) as listed
from ruled
"""
