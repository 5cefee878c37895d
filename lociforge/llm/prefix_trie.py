"""The trie of conversations' prefixes, by a skeleton of range splitters.

A conversation is its path: the digests of its turns, 16 bytes each, one after the other, so that the order of bytes is
the order of paths and every trie node is a prefix. Paths are cut into segments of SEGMENT turns, each behind the hash of
all that comes before it, so that no row grows with a conversation; the segments with one beginning are a trie of their own.

Segments are dealt to shards by splitters, sorted there, and walked once with a stack. Splitters are (path, conv_id), so
copies of one conversation are split as well. A node that is a prefix of no splitter lies in one shard and is finished
there. The nodes on splitter paths, the skeleton, are at most as many as splitters times SEGMENT + 1: shards return partial
sums for them, which are reduced by node and then added up along the skeleton. Tries of later segments are added last.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, shuffle_partitions, written

#: Turns to a segment, at most; bytes of a turn's digest, and of what stands before a segment's path: its number and beginning.
SEGMENT, DIGEST, HEAD = 256, 16, 20
#: Sampled segments to a shard, from which the splitters are taken.
SAMPLE = 20
#: Rows to a batch that a shard returns, and ids to a chunk of a skeleton node's list of ends.
ROWS, CHUNK = 8192, 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()


# --- rebuilt conversations ------------------------------------------------------------------------------------------


def turn_digest(role: Column, text: Column) -> Column:
    """16 bytes of SHA-256 over a turn's role and text, null as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, DIGEST)


def placed_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns in order, (conv_id, part, row, digest, chars), row counting up inside a part; and each conversation's runs of
    rows, (conv_id, part, low, before, total): `row - low + before` is the turn's number. The order is cut into ranges, so
    no task holds a long conversation. Turns of the same number are in the order of their digests."""
    spark = conversations.sparkSession
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_digest(F.col("role"), F.col("text")).alias("digest"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"), F.monotonically_increasing_id().alias("salt")
    ).where("conv_id is not null")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "digest", "salt"]
    dealt = turns.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    dealt = written(dealt.select("conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"), "digest", "chars"), "turns")
    runs = dealt.groupBy("conv_id", "part").agg(F.min("row").alias("low"), F.count("*").alias("n"))
    of = Window.partitionBy("conv_id")
    before = F.coalesce(F.sum("n").over(of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt, written(runs.select("conv_id", "part", "low", before.alias("before"), F.sum("n").over(of).alias("total")), "runs")


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, length) of every rebuilt conversation and its turns (conv_id, length, pos, digest, chars): the first h turns
    of conversation conv_id - conv_id % 100 (% keeps the sign), then its own after the first h, h = crc32(conv_id) % 6."""
    dealt, runs = placed_turns(conversations)
    runs = runs.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6)
    number = F.col("row") - F.col("low") + F.col("before")
    first = dealt.where("conv_id % 100 = 0").join(runs.where("before < 5"), ["conv_id", "part"]).withColumn("i", number).where("i < 5")
    first = first.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("i", "digest", "chars"))).alias("head"))  # five at most
    all_ = runs.where("before = 0").withColumn("base", F.expr("conv_id - conv_id % 100")).join(first, "base", "left")
    head = F.when(F.col("h") > 0, F.slice(F.coalesce("head", F.array().cast("array<struct<i:bigint,digest:binary,chars:bigint>>")), 1, F.greatest(F.col("h"), F.lit(1)).cast("int")))
    all_ = all_.select("conv_id", "h", "total", head.alias("head")).withColumn("shared", F.coalesce(F.greatest(F.size("head"), F.lit(0)), F.lit(0)))
    all_ = written(all_.withColumn("length", F.col("shared") + F.greatest(F.lit(0), F.col("total") - F.col("h"))), "rebuilt")
    own = dealt.join(runs.join(all_.select("conv_id", "shared", "length"), "conv_id"), ["conv_id", "part"]).where(number >= F.col("h"))
    own = own.select("conv_id", "length", (number - F.col("h") + F.col("shared")).alias("pos"), "digest", "chars")
    heads = all_.select("conv_id", "length", F.explode("head").alias("t")).select("conv_id", "length", F.col("t.i").alias("pos"), "t.digest", "t.chars")
    return all_.select("conv_id", "length"), own.union(heads)


# --- segments -------------------------------------------------------------------------------------------------------


def segments(lengths: DataFrame, turns: DataFrame, size: int) -> DataFrame:
    """Rows (key, conv_id, chars, ended, next, k): key is the segment's number, the hash of what comes before it and its
    path; next the hash of what comes before the following segment, null where the conversation ends."""
    t = turns.groupBy("conv_id", "length", F.expr(f"pos div {size}").cast("int").alias("k")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "chars"))).alias("t"))  # `size` at most
    t = t.select("conv_id", "length", "k", F.expr("aggregate(t, cast('' as binary), (a, x) -> concat(a, x.digest))").alias("path"), F.col("t.chars").alias("chars"))
    none = lengths.where("length = 0").select("conv_id", "length", F.lit(0).alias("k"), F.lit(b"").alias("path"), F.array().cast("array<bigint>").alias("chars"))
    of = Window.partitionBy("conv_id").orderBy("k")

    def begins(upto: int) -> Column:
        lanes = [F.coalesce(F.sum(F.xxhash64("path", "k", F.lit(i)).cast("decimal(38,0)")).over(of.rowsBetween(Window.unboundedPreceding, upto)), F.lit(0)).cast("string") for i in (1, 2)]
        return F.unhex(F.md5(F.concat_ws(",", *lanes)))

    zero = F.lit(bytes(DIGEST))
    short = t.where(F.col("length") <= size).union(none).select("*", zero.alias("start"), F.lit(None).cast("binary").alias("next"))
    long = t.where(F.col("length") > size).select("*", F.when(F.col("k") == 0, zero).otherwise(begins(-1)).alias("start"), F.when((F.col("k") + 1) * size < F.col("length"), begins(0)).alias("next"))
    number = F.unhex(F.lpad(F.hex("k"), 8, "0"))
    return short.union(long).select(F.concat(number, "start", "path").alias("key"), "conv_id", "chars", "next", "k", "start")


# --- shards ---------------------------------------------------------------------------------------------------------


def _common(a: bytes, b: bytes) -> int:
    """How many turns of one segment trie two keys share; -1 for different tries."""
    if a[:HEAD] != b[:HEAD]:
        return -1
    n, most = 0, (min(len(a), len(b)) - HEAD) // DIGEST
    while n < most and a[HEAD + n * DIGEST : HEAD + (n + 1) * DIGEST] == b[HEAD + n * DIGEST : HEAD + (n + 1) * DIGEST]:
        n += 1
    return n


def node_id(key: bytes, j: int) -> bytes:
    """Of the node at depth j of its segment trie: for the trie's root the hash of what comes before it."""
    return key[4:HEAD] if j == 0 else hashlib.sha256(key[: HEAD + DIGEST * j]).digest()[:DIGEST]


class _Open:
    """A node on the stack."""

    __slots__ = ("buffer", "chars", "chunk", "cont", "conv", "ends", "key", "kids", "leaves", "mark", "n", "next", "saved", "skeleton")

    def __init__(self, key: bytes, chars: int, skeleton: bool):
        self.key, self.chars, self.skeleton = key, chars, skeleton
        self.conv, self.n, self.kids, self.leaves, self.saved, self.cont = None, 0, 0, 0, 0, 0
        self.ends, self.next, self.mark = None, None, False
        self.buffer, self.chunk = [], []


_KINDS = {
    "kind": pa.int32(), "conv_id": pa.int64(), "depth": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "saved": pa.int64(), "ends": pa.string(), "parent_conv": pa.int64(),
    "parent": pa.binary(), "id": pa.binary(), "anc": pa.list_(pa.binary()), "chars": pa.int64(), "cont": pa.int64(), "next": pa.binary(), "inner": pa.bool_(),
}
_SCHEMA = "kind int, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved long, ends string, parent_conv long, parent binary, id binary, anc array<binary>, chars long, cont long, next binary, inner boolean"
#: Kinds of rows that a shard returns: finished nodes, partial sums of skeleton nodes, chunks of their ends.
_NODE, _PART, _ENDS = range(3)


class _Shard:
    """Walks the sorted segments of one shard between the splitters `low` and `high`. Finished nodes wait in their parent's
    buffer for its least conv_id; the sums of what is finished rise to the skeleton nodes above."""

    def __init__(self, low: bytes | None, high: bytes | None, size: int):
        self.borders, self.size = [x for x in (low, high) if x is not None], size
        self.stack: list[_Open] = []
        self.last, self.out = b"", []

    def row(self, key: bytes, conv: int, chars: list[int], next_: bytes | None) -> None:
        shared = _common(self.last, key) if self.last else -1
        while len(self.stack) > shared + 1:
            self.close()
        skeleton = max((_common(key, x) for x in self.borders), default=-1)
        for j in range(len(self.stack), len(chars) + 1):
            self.stack.append(_Open(key[: HEAD + DIGEST * j], chars[j - 1] if j else 0, j <= skeleton))
        self.last, top = key, self.stack[-1]
        top.n += 1
        top.conv = conv if top.conv is None else min(top.conv, conv)
        if next_ is not None:
            top.cont, top.next = top.cont + 1, next_
        elif top.skeleton:
            top.chunk.append(conv)
            if len(top.chunk) == CHUNK:
                self.ends(top)
        else:
            first = top.ends is None
            top.ends = top.ends or hashlib.sha256()
            top.ends.update(str(conv).encode() if first else b",%d" % conv)

    def ends(self, f: _Open) -> None:
        if f.chunk:
            self.out.append({"kind": _ENDS, "id": node_id(f.key, (len(f.key) - HEAD) // DIGEST), "conv_id": f.chunk[0], "ends": ",".join(map(str, f.chunk))})
            f.chunk = []

    def close(self) -> None:
        f = self.stack.pop()
        j, k = len(self.stack), int.from_bytes(f.key[:4], "big")
        up, inner = self.stack[-1] if j else None, j == 0 and k > 0
        r = {"kind": _NODE, "conv_id": f.conv, "depth": k * self.size + j, "n_convs": f.n, "inner": inner, "next": f.next}
        if f.skeleton:
            self.ends(f)
            r |= {"kind": _PART, "id": node_id(f.key, j), "parent": node_id(f.key, j - 1) if j else None, "anc": [node_id(f.key, i) for i in range(j)], "chars": f.chars, "cont": f.cont}
        else:
            f.leaves += not f.kids and not f.cont
            f.saved += 0 if inner else (f.n - 1) * f.chars
            f.mark |= f.cont > 0
            r |= {"ends": f.ends.hexdigest() if f.ends else NO_ENDS, "id": node_id(f.key, j) if f.mark or inner else None}
            r |= {"anc": [node_id(f.key, i) for i in range(j)]} if f.cont else {}
            for x in f.buffer:
                x |= {"parent": node_id(f.key, 0)} if inner else {"parent_conv": f.conv}
            self.out += f.buffer
        r |= {"n_children": f.kids, "n_leaves": f.leaves, "saved": f.saved}
        if up is None or f.skeleton:
            self.out.append(r)
        elif up.skeleton:
            self.out.append(r | {"parent": node_id(f.key, j - 1)})
        else:
            up.buffer.append(r)
        if up is not None:
            up.conv = f.conv if up.conv is None else min(up.conv, f.conv)
            up.n, up.leaves, up.saved, up.mark = up.n + f.n, up.leaves + f.leaves, up.saved + f.saved, up.mark or f.mark
            up.kids += not f.skeleton

    def taken(self, last: bool) -> Iterator[pa.RecordBatch]:
        while last and self.stack:
            self.close()
        if self.out and (last or len(self.out) >= ROWS):
            yield pa.RecordBatch.from_pydict({c: pa.array([x.get(c) for x in self.out], kind) for c, kind in _KINDS.items()}, pa.schema(list(_KINDS.items())))
            self.out = []


def _splitters(segs: DataFrame, shards: int) -> list[tuple[bytes, int]]:
    """At most shards - 1 of the segments, from a sample of SAMPLE to a shard that their hashes draw."""
    seen = segs.select("key", "conv_id").orderBy(F.xxhash64("key", "conv_id"), "key", "conv_id").limit(SAMPLE * shards).collect()
    seen = sorted({(bytes(x.key), x.conv_id) for x in seen})
    return [seen[i * len(seen) // shards] for i in range(1, shards) if seen]


def _walked(segs: DataFrame, size: int, shards: int) -> DataFrame:
    """What the shards return."""
    spark = segs.sparkSession
    split = sorted(set(_splitters(segs, shards)))
    sent = spark.sparkContext.broadcast(split)  # at most shards - 1 paths of one segment

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = [bisect_right(sent.value, x) for x in zip(b.column("key").to_pylist(), b.column("conv_id").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(of, pa.int32())], [*b.schema.names, "shard"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = at = None
        for b in batches:
            for key, conv, chars, next_, to in zip(*(b.column(c).to_pylist() for c in ("key", "conv_id", "chars", "next", "shard")), strict=True):
                if to != at:
                    if shard:
                        yield from shard.taken(True)
                    border = [sent.value[i][0] if 0 <= i < len(sent.value) else None for i in (to - 1, to)]
                    shard, at = _Shard(*border, size), to
                shard.row(key, conv, chars, next_)
                yield from shard.taken(False)
        if shard:
            yield from shard.taken(True)

    rows = segs.select("key", "conv_id", "chars", "next")
    dealt = arrow_map(rows, deal, "key binary, conv_id long, chars array<long>, next binary, shard int")
    dealt = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "key", "conv_id")
    return arrow_map(dealt, walk, _SCHEMA)


def _ends(chunks: DataFrame) -> DataFrame:
    """(id, ends) of skeleton nodes: their chunks in order go through one running hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = h = None
        for b in batches:
            ids, found = [], []
            for i, text in zip(b.column("id").to_pylist(), b.column("ends").to_pylist(), strict=True):
                if i != at:
                    if h:
                        ids, found = [*ids, at], [*found, h.hexdigest()]
                    at, h = i, hashlib.sha256(text.encode())
                else:
                    h.update(b"," + text.encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(found, pa.string())], ["id", "ends"])
        if h:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([h.hexdigest()], pa.string())], ["id", "ends"])

    dealt = chunks.select("id", "conv_id", "ends").repartition(shuffle_partitions(chunks.sparkSession), "id").sortWithinPartitions("id", "conv_id")
    return arrow_map(dealt, run, "id binary, ends string")


_COLUMNS = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved", "ends", "parent_conv", "parent", "id", "anc", "next", "inner"]


def _skeleton(parts: DataFrame, chunks: DataFrame) -> DataFrame:
    """The skeleton's nodes: partial sums reduced by node, then each node's own share added to all above it."""
    first = [F.first(c).alias(c) for c in ("depth", "parent", "anc", "chars", "inner")]
    red = parts.groupBy("id").agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved", "cont")), F.max("next").alias("next"), *first)
    kids = red.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("more"))
    red = red.join(kids, "id", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more")
    red = red.withColumns({"leaf": F.expr("if(n_children = 0 and cont = 0, 1L, 0L)"), "own": F.expr("if(inner, 0L, (n_convs - 1) * chars)")})
    red = written(red, "skeleton")
    up = red.select(F.explode(F.concat("anc", F.array("id"))).alias("id"), "leaf", "own").groupBy("id").agg(F.sum("leaf").alias("leaves_up"), F.sum("own").alias("saved_up"))
    red = red.join(up, "id").join(_ends(chunks), "id", "left")
    return red.withColumns({"n_leaves": F.expr("n_leaves + leaves_up"), "saved": F.expr("saved + saved_up"), "ends": F.coalesce("ends", F.lit(NO_ENDS)), "parent_conv": F.lit(None).cast("long")}).select(*_COLUMNS)


def _with_later(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """Adds the tries of later segments (rows `inner` of `nodes` are their roots) to the nodes that they stand on and to all
    above those. A trie's sums are given to its least conversation; what a conversation carries from a segment on, added up
    over the conversations that pass there, is what lies below."""
    roots = nodes.where("inner").select(F.col("id").alias("start"), "n_children", "n_leaves", "saved")
    least = starts.groupBy("start").agg(F.min("conv_id").alias("least"))
    carried = starts.join(roots.join(least, "start"), "start")
    carried = carried.select("conv_id", "k", "start", *(F.expr(f"if(conv_id = least, {c}, 0L)").alias(c) for c in ("n_leaves", "saved")))
    down = Window.partitionBy("conv_id").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    below = carried.select("start", *(F.sum(c).over(down).alias(c) for c in ("n_leaves", "saved"))).groupBy("start").agg(F.sum("n_leaves").alias("leaves_on"), F.sum("saved").alias("saved_on"))
    below = written(below.join(roots.select("start", F.col("n_children").alias("kids_on")), "start"), "later")
    ends = nodes.where("next is not null and not inner").withColumnRenamed("next", "start").join(below, "start")
    above = ends.select(F.explode("anc").alias("id"), "leaves_on", "saved_on").groupBy("id").agg(F.sum("leaves_on").alias("leaves_up"), F.sum("saved_on").alias("saved_up"))
    rest = nodes.where("not inner")
    added = {"n_leaves": F.expr("n_leaves + coalesce(leaves_on, 0) + coalesce(leaves_up, 0)"), "saved": F.expr("saved + coalesce(saved_on, 0) + coalesce(saved_up, 0)"), "n_children": F.expr("n_children + coalesce(kids_on, 0)")}
    with_id = rest.where("id is not null").join(below.withColumnRenamed("start", "next"), "next", "left").join(above, "id", "left").withColumns(added)
    return rest.where("id is null").select(*_COLUMNS).union(with_id.select(*_COLUMNS))


def prefix_trie(lengths: DataFrame, turns: DataFrame, size: int = SEGMENT, shards: int | None = None) -> DataFrame:
    """All nodes of the trie of conversations (conv_id, length) with turns (conv_id, length, pos, digest, chars), pos from 0.

    Returns per node conv_id (its smallest member), depth, parent_conv_id (null for the root), n_convs (members), n_children,
    n_leaves (childless nodes in its subtree, itself included), saved_tokens (over its subtree, (n_convs - 1) times the code
    points of a node's last text) and ends_sha256 (of the ascending conv_ids, comma-joined, that end there). Conversations
    without turns are members of the root only; no conversations, no nodes. Turns are told apart by 128 bits of SHA-256.
    """
    spark = lengths.sparkSession
    segs = written(segments(lengths, turns, size), "segments")
    out = written(_walked(segs, size, shards or shuffle_partitions(spark)), "walked")
    chunks, parts = out.where(f"kind = {_ENDS}"), out.where(f"kind = {_PART}")
    skeleton = written(_skeleton(parts, chunks), "skeleton")
    nodes = out.where(f"kind = {_NODE}").select(*_COLUMNS).union(skeleton)
    starts = segs.where("k > 0").select("conv_id", "k", "start")
    later = not starts.isEmpty()
    if later:
        stands = nodes.where("next is not null and not inner").select(F.col("next").alias("parent"), F.col("conv_id").alias("above"))
        nodes = written(_with_later(nodes, starts), "nodes")
    done = nodes.where("parent is null")
    on_skeleton = skeleton.where("not inner").select(F.col("id").alias("parent"), F.col("conv_id").alias("above"))  # at most shards times size + 1 rows
    waits = nodes.where("parent is not null").join(F.broadcast(on_skeleton), "parent", "left")
    if later:
        rest = waits.where("above is null").drop("above").join(stands, "parent", "left")
        waits = waits.where("above is not null").select(*_COLUMNS, "above").union(rest.select(*_COLUMNS, "above"))
    nodes = done.select(*_COLUMNS, F.col("parent_conv").alias("above")).union(waits.select(*_COLUMNS, "above"))
    return nodes.select("conv_id", "depth", F.col("above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, size: int = SEGMENT, shards: int | None = None) -> DataFrame:
    """`prefix_trie` of the rebuilt conversations of a table (conv_id, turn, role, text): see `rebuilt_turns`.

    Null roles and texts are empty, null turns come first, turns of equal number are ordered by their digest and repeated
    rows are turns of their own. Rows without a conv_id are left out, other columns are not read, no rows give no nodes.
    """
    return prefix_trie(*rebuilt_turns(conversations), size, shards)


#: The nodes in plain steps: every conversation's prefixes as lists, grouped; crc32 bit by bit.
ORACLE = r"""
with t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, sha256(concat(length(coalesce(role, ''))::varchar, ':', coalesce(role, ''), coalesce(text, '')))) as i
  from conversations where conv_id is not null
), own as (
  select conv_id, list(struct_pack(r := role, x := text) order by i) as ts from t group by 1
), c as (
  select conv_id, ts, cast(xor(list_reduce(list_concat([4294967295::ubigint], list_transform(range(1, length(conv_id::varchar) + 1), lambda i: ascii(substr(conv_id::varchar, i, 1))::ubigint)),
    lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::ubigint[]), lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end)), 4294967295::ubigint) % 6 as bigint) as h from own
), r as (
  select c.conv_id, list_concat(coalesce(b.ts, [])[1:c.h], c.ts[c.h + 1:]) as p from c left join own b on b.conv_id = c.conv_id - c.conv_id % 100
), m as (select conv_id, p, unnest(range(0, len(p) + 1)) as d from r),
n as (
  select p[1:d] as path, d as depth, min(conv_id) as conv_id, count(*) as n_convs,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where d = len(p)), '')) as ends_sha256 from m group by 1, 2
), k as (select path[1:depth - 1] as path, count(*) as n_children from n where depth > 0 group by 1),
v as (
  select n.*, coalesce(n_children, 0) as n_children, case when depth = 0 then 0 else (n_convs - 1) * length(n.path[depth].x) end as own from n left join k on k.path = n.path
), u as (
  select path[1:e] as path, sum((n_children = 0)::int) as n_leaves, sum(own) as saved_tokens from (select *, unnest(range(0, depth + 1)) as e from v) group by 1
)
select v.conv_id, v.depth, a.conv_id as parent_conv_id, v.n_convs, v.n_children, cast(u.n_leaves as bigint) as n_leaves, cast(u.saved_tokens as bigint) as saved_tokens, v.ends_sha256
from v join u on u.path = v.path left join n a on v.depth > 0 and a.path = v.path[1:v.depth - 1]
"""
