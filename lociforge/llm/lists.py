"""Links between sets that meet on lists: the part that the n-gram join and the MinHash join have in common.

A list holds the sets that show one key. A few turns pair each list's members with one leader, so that a large group of near
copies costs few more comparisons than it has members; what matters of a list then are pairs of different components. Where
they are few to a member they are formed outright, by the filters that places and sizes allow. Other lists are split by the
next key that their members show: sets that can be linked show several common keys, so they meet again under their first
two, three or more. Splitting works by set, so no task holds a list, and members that can't be linked any more with so many
keys passed are left out on the way. Large sets show too many keys for that, but their places tell them apart well; they are
paired without splitting. Pairs also have to agree on the parity bits of their whole sets, which can differ in no more bits than
the sets do in elements. Where keys don't tell members apart enough, the sets of longer lists are handed back, to meet on
lists of another kind. No link between components is lost.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components

#: Lists that hold more than one in so many of all members are hot: there are at most so many of them.
HOT_LISTS = 10_000
#: Pairs of different components to a member that a list may have to be paired outright, and the size from which sets
#: aren't split.
FEW, LARGE = 32, 32
#: Turns in which lists meet a leader.
LEADERS = 2
#: Columns of a set's parity bits, 64 to each.
BITS = ("m0", "m1", "m2", "m3")


@dataclass(frozen=True)
class Rules:
    """What two members l and r of a list can have to do with each other, in SQL over their sizes and the places of the key
    in them (l.n, l.pos, r.n, r.pos), if the key is the d-th that they share: `pair(d)`. `member(d)`: whether a set can be
    linked with any, over n and pos, `short(d)`: whether with one that isn't smaller. `least`: how many keys linked sets share at least, `depth` the smallest such number,
    but for pairs that `early` lets meet at depth - 1. `apart`: how many elements at most are in one of two linked sets only."""

    pair: Callable[[int], str]
    member: Callable[[int], str]
    short: Callable[[int], str]
    least: str
    depth: int
    apart: str
    early: str = "false"


def hot_lists(members: DataFrame) -> DataFrame:
    """Keys of the hot lists of a written table of members."""
    sizes = members.groupBy("key").agg(F.count("*").alias("size"))
    return written(sizes.where(F.col("size") * HOT_LISTS > members.count()).select("key"), "hot")


def on_lists(left: DataFrame, right: DataFrame, hot: DataFrame, how: str, then: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """Members joined on the key with a table of one row a key. Rows of hot lists meet it by broadcast, of at most HOT_LISTS
    rows, so that no task reads a whole hot list; the others are dealt by key."""
    few = F.broadcast(hot)
    rest = left.join(few, "key", "left_anti").join(right, "key", how)
    return then(rest).union(then(left.join(F.broadcast(right.join(few, "key", "left_semi")), "key", how)))


def _sides(met: DataFrame, rules: Rules, d: int, also: str = "", bits: bool = True) -> DataFrame:
    """The pairs (a, b) that pass the filters, of members l and r that met, with their parity bits or without."""
    met = met.where(f"l.root <> r.root and {rules.pair(d)}")
    if bits:
        met = met.where(" + ".join(f"bit_count(l.{m} ^ r.{m})" for m in BITS) + f" <= {rules.apart}")
    return met.selectExpr("least(l.sid, r.sid) as a", "greatest(l.sid, r.sid) as b", *([also] if also else []))


def _led(members: DataFrame, hot: DataFrame, rules: Rules, turn: int) -> DataFrame:
    """Pairs of a list's members with its leader, the set that is in most lists, later one of another component."""
    often = members.groupBy("sid").agg(F.count("*").alias("often"))
    turn_of = F.xxhash64("root", F.lit(turn)) if turn else F.lit(0)
    pick = F.struct(turn_of.alias("turn"), "often", "sid", "n", "pos", "root")
    lead = members.join(often, "sid").groupBy("key").agg(F.max(pick).alias("x")).select("key", "x.sid", "x.n", "x.pos", "x.root")
    pairs = on_lists(members.alias("l"), lead.alias("r"), hot, "inner", lambda met: _sides(met, rules, 1, f"{rules.least} as least", bits=False))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("lists"), F.min("least").alias("least")).where("lists >= least").select("a", "b")


def split(members: DataFrame, rules: Rules, only_few: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """All pairs of different components that may be linked, of members (key, sid, n, pos, root, BITS) whose lists hold several
    components. With `only_few` longer lists are not split: the sets (sid) on them are returned as well."""
    now, out, mine = members.where(rules.member(1)).withColumnRenamed("key", "list"), None, None
    for d in range(1, rules.depth + 1):
        last = d == rules.depth
        now = now.select("list", "sid", "n", "pos", "root", *BITS, F.expr(rules.short(d)).alias("short"))
        of = now.groupBy("list", "root").agg(F.count("*").alias("m"), F.count_if("short").alias("s")).groupBy("list").agg(F.sum("m").alias("m"), F.sum("s").alias("s"), F.sum(F.col("m") * F.col("m")).alias("same"))
        of = of.where("m * m > same and s > 0").select("list", F.expr(f"least(s * m, m * m - same) <= {FEW} * m").alias("few"))
        now = written(now.join(written(of, "sizes"), "list"), "lists")
        direct = "few" if only_few else "true" if last else f"few or n > {LARGE}"
        left = now.where("short").where("true" if last or only_few else f"few or n * 2 > {LARGE}")  # linked sets aren't half as large
        met = left.where(direct if only_few else "true").alias("l").join(now.where(direct).alias("r"), F.col("l.list") == F.col("r.list"))
        met = met.where("l.n < r.n or (l.n = r.n and l.sid < r.sid)")
        rest = now.where("not few" if only_few else f"not few and n <= {LARGE}")
        if d == 1:  # the keys that two sets share are in lists that are paired here, where they are counted, or in the others
            other = rest.groupBy("sid").agg(F.count("*").alias("other"))
            pairs = _sides(met, rules, d, f"{rules.least} as least").groupBy("a", "b").agg(F.count("*").alias("lists"), F.min("least").alias("least"))
            for side in "ab":
                pairs = pairs.join(other.select(F.col("sid").alias(side), F.col("other").alias(f"other_{side}")), side, "left")
            pairs = pairs.where("lists + least(coalesce(other_a, 0), coalesce(other_b, 0)) >= least").select("a", "b")
        else:
            pairs = _sides(met, rules, d)
        out = pairs if out is None else out.union(pairs)
        if last or rest.isEmpty():
            break
        if only_few:
            return out.distinct(), written(rest.select("sid").distinct(), "long")
        if d == rules.depth - 1 and rules.early != "false":
            first = rest.where(rules.early)  # at most one a list
            out = out.union(_sides(first.alias("l").join(rest.alias("r"), F.col("l.list") == F.col("r.list")), rules, d))
        if mine is None:  # a set's own keys, of at most LARGE shingles
            mine = written(rest.select("sid").distinct().join(members, "sid").groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("pos", "key"))).alias("keys")), "keys")
        later = rest.join(mine, "sid").select("list", "sid", "n", "root", *BITS, F.expr("explode(filter(keys, x -> x.pos > pos))").alias("x"))
        now = later.select(F.xxhash64("list", "x.key").alias("list"), "sid", "n", "x.pos", "root", *BITS).where(rules.member(d + 1))
    return out.distinct(), None


def linked(members: DataFrame, bits: DataFrame, rules: Rules, verified: Callable[[DataFrame], DataFrame], links: DataFrame | None = None, only_few: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Links (a, b) enough to give every component of the full join, from members (key, sid, np), np packing a set's size and
    the key's place, from `bits` (sid, BITS) of all sets, and from links that are known already. `verified` returns those of distinct pairs (a, b) that are links.
    With `only_few` the links don't tell components apart on longer lists, and the sets (sid) that those hold come with them."""
    tried = long = None
    hot = hot_lists(members)
    members = members.selectExpr("key", "sid", "cast(shiftright(np, 32) as int) as n", "cast(np & 4294967295 as int) as pos")
    for turn in range(LEADERS + 1):
        if links is None:
            now = members.withColumn("root", F.col("sid"))
        else:
            root = written(components(links), "roots")
            now = members.join(root, members.sid == root.node, "left").select("key", "sid", "n", "pos", F.coalesce("root", "sid").alias("root"))
            mixed = now.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
            members = now = written(on_lists(now, mixed, hot, "left_semi"), "members")
            members = members.drop("root")
            if now.isEmpty():
                break
        if turn < LEADERS:
            pairs = _led(now, hot, rules, turn if links is None else turn + 1)
        else:
            pairs, long = split(now.join(bits, "sid"), rules, only_few)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        tried = pairs if tried is None else tried.union(pairs)
        new = written(verified(pairs), "links")
        links = new if links is None else links.union(new)
    return links, long
