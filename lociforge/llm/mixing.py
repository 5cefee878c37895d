"""Mixing sources to target weights by a splitting tree over blocks, all in Spark expressions.

Every source's documents are put in a fixed random order and read as one stream of words, again from its start when it
is used up; the stream is cut into blocks of equally many words. A source gives exactly its quota of blocks (the last
one cut to the word). A binary tree deals the blocks of all sources to the output shards: each node draws half of its
blocks at random, so that the sources' shares of each side are a multivariate hypergeometric draw, down to the shards.
Blocks are disjoint; inside a shard documents are ordered by a random key.

Running sums are taken inside small ranges of the random order and over the totals of these ranges, so that a source
with most of the rows is spread over many tasks. The tree's size is bounded by the number of blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (5.0, 2.0, 1.0)
#: Ranges of the random order that each source is dealt to, blocks of all sources together (about), and output shards.
RANGES, BLOCKS, SHARDS = 2048, 8192, 16


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, share: float, most: float, weights=WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, size). Sources by code point, null last, weigh `weights` in turn and
    share `share` times all words; none gets more than `most` times its own, what is over goes to the others by weight.

    In the order of cap by weight, a source is capped if an equal share of what those before it leave is above its cap.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))
    s = s.select("source", "source_size", weight.alias("w"), (F.col("source_size") * F.lit(float(most))).alias("cap"))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("pool", F.sum("source_size").over(everything) * F.lit(float(share)))
    left = F.col("pool") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    heavy = F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("capped", F.col("cap") <= left * F.col("w") / heavy)
    free = F.col("pool") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0.0))
    open_w = F.sum(F.when(~F.col("capped"), F.col("w"))).over(everything)
    return s.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(free * F.col("w") / open_w).alias("target"))


def split_tree(blocks: DataFrame, shards: int, seed: int) -> DataFrame:
    """Adds shard to (source, block) rows: every node of the tree sends a random half of its blocks, in proportion to the
    shards on that side, to the left. Sizes of the sides are exact; which sources they come from is the draw."""
    tree = blocks.withColumns({"shard": F.lit(0), "width": F.lit(shards)})
    level, widest = 0, shards
    while widest > 1:
        node = Window.partitionBy("shard")
        rank = F.row_number().over(node.orderBy(F.xxhash64("source", "block", F.lit(seed), F.lit(level)), "source", "block"))
        left = F.floor(F.col("width") / 2).cast("int")
        n = F.count("*").over(node)
        tree = tree.withColumns({"rank": rank, "n": n})
        goes_left = F.col("rank") * F.col("width") <= F.col("n") * left
        tree = tree.select("source", "block", F.when(goes_left, F.col("shard")).otherwise(F.col("shard") + left).alias("shard"), F.when(goes_left, left).otherwise(F.col("width") - left).alias("width"))
        widest, level = -(-widest // 2), level + 1
    return tree.select("source", "block", "shard")


def mix(docs: DataFrame, keep: list[str], share: float = 1.5, most: float = 2.0, whole: bool = False, shards: int = SHARDS, seed: int = 11, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row of `docs` a struct `kept` of the columns named in `keep`, with size, source_size, target, taken (words the
    mix takes, repeats counted) and copies (array of words, shard and key: one for each time the document is used).

    With `whole`, the document at the end of a source's quota is used if at least half of it lies inside; otherwise only
    its first words up to the quota are, and a source's taken words are its rounded target exactly.

    Null texts have size 0 and are never taken; a null source is a source of its own, last in order; repeated rows are
    documents of their own; an empty table gives no rows. Runs on the same rows agree.
    """
    text, source = F.col(f"`{text_col}`"), F.col(f"`{source_col}`").cast("string")
    kept = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)))
    rows = docs.select(kept.alias("kept"), source.alias("source"), word_count(text).alias("size"), F.xxhash64(F.lit(seed), text, *(F.col(f"`{c}`") for c in keep if c != text_col)).alias("h"))
    rows = rows.withColumns({"sk": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")), "range": F.pmod(F.shiftright("h", 33), F.lit(RANGES)).cast("int")})
    goal = targets(rows.select("source", "size"), share, most).withColumn("quota", F.round("target").cast("long"))
    goal = goal.withColumn("sk", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))).drop("source")
    goal = goal.withColumn("per_block", F.greatest(F.lit(1), F.ceil(F.sum("quota").over(Window.partitionBy()) / BLOCKS)).cast("long"))
    last = F.ceil(F.col("quota") / F.col("per_block")).cast("long") - 1
    blocks = goal.where("quota > 0").select(F.col("sk").alias("source"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    dealt = split_tree(blocks, shards, seed).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("block", "shard"))).alias("x"))
    dealt = dealt.select(F.col("source").alias("sk"), F.transform("x", lambda x: x["shard"]).alias("shard_of"))

    ranges = rows.groupBy("sk", "range").agg(F.sum("size").alias("n"))
    ranges = ranges.withColumn("before", F.sum("n").over(Window.partitionBy("sk").orderBy("range")) - F.col("n"))
    span = ranges.join(goal, "sk").join(dealt, "sk", "left")
    turns = range(max(1, math.ceil(most)))
    for e in turns:  # each range keeps only the shards of the blocks that it reaches
        lo = F.expr(f"({e} * source_size + before) div per_block")
        hi = F.expr(f"({e} * source_size + before + n) div per_block")
        reach = F.when(lo < F.size("shard_of"), F.slice("shard_of", (lo + 1).cast("int"), (hi - lo + 1).cast("int")))
        span = span.withColumns({f"lo{e}": lo, f"shards{e}": reach})
    span = span.drop("n", "shard_of")

    order = Window.partitionBy("sk", "range").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("within", F.sum("size").over(order) - F.col("size")).join(span, ["sk", "range"])
    copies = []
    for e in turns:
        start = F.expr(f"{e} * source_size + before + within")
        words = F.when(2 * start + F.col("size") <= 2 * F.col("quota"), F.col("size")).otherwise(0) if whole else F.greatest(F.lit(0), F.least("size", F.col("quota") - start))
        shard = F.get(f"shards{e}", (F.expr(f"({e} * source_size + before + within) div per_block") - F.col(f"lo{e}")).cast("int"))
        copies.append(F.struct(words.cast("long").alias("words"), shard.alias("shard"), F.xxhash64("h", F.lit(seed), F.lit(e)).alias("key")))
    placed = placed.withColumn("copies", F.filter(F.array(*copies), lambda c: c["words"] > 0))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda s, c: s + c["words"])
    return placed.select("kept", "size", "source_size", "target", taken.alias("taken"), "copies")


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the rows of `docs`, whole, each as often as it is used, dealt to its shard and shuffled there."""
    names = docs.columns
    m = mix(docs, names, whole=True, **how).select("kept", F.explode("copies").alias("copy"))
    m = m.select("kept", "copy.shard", "copy.key").repartition("shard", F.pmod(F.shiftright("key", 20), F.lit(64))).sortWithinPartitions("shard", "key")
    return m.select(*(F.col(f"kept.c{i}").alias(c) for i, c in enumerate(names)))


def mix_words(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the shards that its copies go to."""
    m = mix(docs, ["doc_id"], **how)
    return m.select(F.col("kept.c0").alias("doc_id"), "size", "source_size", "target", "taken", F.transform("copies", lambda c: c["shard"]).alias("shards"))
