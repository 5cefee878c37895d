"""How far the sources of a language differ in their terms, counted on packed words.

Terms are runs of letters A-Z, a-z and of characters beyond ASCII, A-Z lower-cased. A block of texts is cut into terms as
arrays: terms of up to 8 bytes become one uint64, of up to 16 two, both big-endian, so that the order of numbers is the
order of bytes and no two terms share a number (no term holds a zero byte). They are sorted digit by digit (a stable radix
sort, 16 bits a pass) and counted by runs; the stable order keeps the texts of a block in order, so the same runs give a
term's texts. Longer terms are sorted as bytes in buckets of their own length. Tasks add up what their blocks hold, Spark
adds up the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, shuffle_partitions, written

#: Texts of a language that a term has to be in, what is added to each count, the scale of shares, and ranks of terms kept.
LEAST_TEXTS, ADDED, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Bytes of a block of texts, and counted terms that a task holds before it passes them on.
BLOCK, HELD = 1 << 22, 1_000_000
#: Sources of a block when sources meet sources.
SIDE = 512

_IS_TERM = np.zeros(256, bool)
_IS_TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEEP = np.array([0, *(((1 << 8 * i) - 1) << (64 - 8 * i) for i in range(1, 9))], np.uint64)


def radix_order(lanes: list[np.ndarray]) -> np.ndarray:
    """The stable order of numbers whose digits are the lanes' (the first one weighs most), by 16 bits at a time. Digits that
    are the same everywhere are passed over."""
    order = np.arange(len(lanes[0]))
    for lane in reversed(lanes):
        for shift in (0, 16, 32, 48):
            digit = (lane >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _runs(lanes: list[np.ndarray], text: np.ndarray, weight: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Different (number, text) in order of number and text, with how often they come; texts come in ascending order."""
    order = radix_order(lanes)
    lanes, text = [x[order] for x in lanes], text[order]
    new = np.ones(len(order), bool)
    new[1:] = text[1:] != text[:-1]
    for x in lanes:
        new[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(order))) if weight is None else np.add.reduceat(weight[order], at) if len(at) else weight[:0]
    return [x[at] for x in lanes], text[at], n


def _long_order(chars: np.ndarray, starts: np.ndarray, size: int) -> tuple[list[np.ndarray], list[bytes]]:
    """Terms of one length beyond 16 bytes: their ranks among the different ones, as a lane, and those."""
    cells = chars[starts[:, None] + np.arange(size)]
    found, rank = np.unique(cells.view(f"V{size}").reshape(-1) if size else cells, return_inverse=True)
    return [rank.astype(np.uint64)], [x.tobytes() for x in found]


class TermCounts:
    """Counts of (group, term): occurrences and texts. Groups are small numbers; texts are given a block at a time, in
    ascending order of their groups."""

    def __init__(self) -> None:
        self.held: dict[int, list[tuple]] = {1: [], 2: []}  # by lanes: (lanes, group, n, texts)
        self.long: dict[tuple[int, bytes], list[int]] = {}
        self.size = 0

    def block(self, texts: list[bytes], groups: np.ndarray, piece: int = 1 << 24) -> None:
        """Adds a block. One text beyond `piece` bytes goes in pieces that end between terms, whose counts are united."""
        data = b"\0".join(texts)
        if len(data) <= piece:
            self._add([self._cut(data, np.cumsum([len(x) + 1 for x in texts]))], groups)
            return
        for text, g in zip(texts, groups, strict=True):
            parts, at = [], 0
            while at < len(text):
                end = min(at + piece, len(text))
                while end < len(text) and _IS_TERM[text[end]]:
                    end += 1
                parts.append(self._cut(text[at:end], np.array([end - at + 1])))
                at = end
            self._add(parts, np.array([g]))

    @staticmethod
    def _cut(data: bytes, ends: np.ndarray) -> dict[int, tuple]:
        """Terms of a block by lanes: 1, 2 (lanes, text, n), and 0: a dictionary of (term, text) to n."""
        buf = np.frombuffer(data + bytes(24), np.uint8)
        chars = _LOWER[buf]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], _IS_TERM[buf]))))
        starts, sizes = edge[::2], edge[1::2] - edge[::2]
        text = np.searchsorted(ends, starts, side="right")
        wide = np.ndarray(len(chars) - 7, ">u8", chars.tobytes(), 0, (1,))
        out: dict[int, tuple] = {}
        for lanes, low, high in ((1, 0, 8), (2, 8, 16)):
            i = np.flatnonzero((sizes > low) & (sizes <= high))
            packed = [wide[starts[i] + 8 * k].astype(np.uint64) & _KEEP[np.clip(sizes[i] - 8 * k, 0, 8)] for k in range(lanes)]
            out[lanes] = _runs(packed, text[i], None)
        many: dict[tuple[bytes, int], int] = {}
        for size in np.unique(sizes[sizes > 16]).tolist():
            i = np.flatnonzero(sizes == size)
            (rank,), found = _long_order(chars, starts[i], size)
            (rank,), of, n = _runs([rank], text[i], None)
            many |= {(found[r], t): c for r, t, c in zip(rank.tolist(), of.tolist(), n.tolist(), strict=True)}
        out[0] = many
        return out

    def _add(self, parts: list[dict], groups: np.ndarray) -> None:
        for lanes in (1, 2):
            got = [p[lanes] for p in parts]
            key, text, n = ([np.concatenate(x) for x in zip(*(g[0] for g in got), strict=True)], np.concatenate([g[1] for g in got]), np.concatenate([g[2] for g in got])) if len(got) > 1 else got[0]
            if len(got) > 1:
                key, text, n = _runs(key, text, n)
            if len(n):
                self.held[lanes].append((key, groups[text], n, np.ones(len(n), np.int64)))
                self.size += len(n)
        united: dict[tuple[bytes, int], int] = {}
        for p in parts:
            for k, n in p[0].items():
                united[k] = united.get(k, 0) + n
        for (term, t), n in united.items():
            x = self.long.setdefault((int(groups[t]), term), [0, 0])
            x[0], x[1] = x[0] + n, x[1] + 1
        self._unite(4 * HELD)

    def _unite(self, most: int) -> None:
        """Adds up blocks, once they are that many rows."""
        if self.size <= most:
            return
        self.size = 0
        for lanes, held in self.held.items():
            if held:
                key = [np.concatenate(x) for x in zip(*(h[0] for h in held), strict=True)]
                group, n, texts = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
                order = np.argsort(group, kind="stable")
                key, group, n, texts = [x[order] for x in key], group[order], n[order], texts[order]
                k, g, total = _runs(key, group, n)
                self.held[lanes] = [(k, g, total, _runs(key, group, texts)[2])]
                self.size += len(g)

    def full(self) -> bool:
        return self.size > HELD and (self._unite(HELD) or self.size > HELD) or len(self.long) > HELD

    def taken(self) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
        """(terms, groups, occurrences, texts) of all that was added, and starts anew."""
        self._unite(0)
        for lanes, held in self.held.items():
            for key, group, n, texts in held:
                raw = np.stack(key, 1).astype(">u8").tobytes()
                yield [raw[i : i + 8 * lanes].rstrip(b"\0") for i in range(0, len(raw), 8 * lanes)], group, n, texts
        if self.long:
            n = np.array(list(self.long.values()))
            yield [k[1] for k in self.long], np.array([k[0] for k in self.long]), n[:, 0], n[:, 1]
        self.__init__()


def term_counts(docs: DataFrame) -> DataFrame:
    """Partial counts (lang, source, term, n, texts) of documents with text, lang and source; nulls are ''."""
    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, names, number = TermCounts(), [], {}
        held: list[tuple[int, bytes]] = []

        def flush() -> None:
            held.sort(key=lambda x: x[0])
            counts.block([x[1] for x in held], np.array([x[0] for x in held], np.int64))
            held.clear()

        def passed() -> Iterator[pa.RecordBatch]:
            for terms, group, n, texts in counts.taken():
                for i in range(0, len(terms), 65_536):
                    of = group[i : i + 65_536].tolist()
                    cols = [pa.array([names[g][0] for g in of]), pa.array([names[g][1] for g in of]), pa.array(terms[i : i + 65_536], pa.binary()).cast(pa.string()), pa.array(n[i : i + 65_536]), pa.array(texts[i : i + 65_536])]
                    yield pa.RecordBatch.from_arrays(cols, ["lang", "source", "term", "n", "texts"])
            names.clear()
            number.clear()

        size = 0
        for b in batches:
            for text, lang, source in zip(b.column("text").cast(pa.binary()), b.column("lang").to_pylist(), b.column("source").to_pylist(), strict=True):
                g = number.setdefault((lang, source), len(number))
                if g == len(names):
                    names.append((lang, source))
                held.append((g, text.as_py()))
                size += len(held[-1][1])
                if size >= BLOCK:
                    flush()
                    size = 0
                    if counts.full():
                        yield from passed()
        flush()
        yield from passed()

    return arrow_map(rows, run, "lang string, source string, term string, n long, texts long")


def shares(count: np.ndarray, total: np.ndarray | int, terms: int, added: int, scale_digits: int = 9) -> np.ndarray:
    """1 + floor(10**scale_digits * (count + added) / (total + added * terms)), exactly: three digits at a time, so that
    nothing passes 64 bits while the divisor is below 9e15."""
    whole = np.asarray(total, np.int64) + added * terms
    rest, out = np.asarray(count, np.int64) + added, np.zeros(np.broadcast(count, whole).shape, np.int64)
    out, rest = rest // whole, rest % whole
    for _ in range(scale_digits // 3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return 1 + out


def source_divergence(docs: DataFrame, least: int = LEAST_TEXTS, added: int = ADDED, top: int = TOP, side: int = SIDE) -> DataFrame:
    """How the sources of each language differ in the terms that at least `least` of the language's texts hold.

    A term's share p of a source or a language is 1 + floor(10**9 * (count + added) / (N + added * V)), N the occurrences of
    the V kept terms there. Part `pair` has for each (lang, source) every other source of the language, and the sum over all
    kept terms of the differences of their shares (0 without kept terms); part `term` the `top` terms that occur in the
    source and whose share is above the language's, and by how much. Ranks go by value, largest first, then by the bytes of
    the item.

    Null texts, languages and sources are ''; a source without terms counts as one; repeated rows are texts of their own; a
    text is read whole however long; other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    groups = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    counts = term_counts(docs).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))
    kept = counts.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("by"), F.sum("n").alias("n"), F.sum("texts").alias("texts")).where(F.col("texts") >= least)
    kept = written(kept.drop("texts"), "terms")
    sums = kept.select("lang", F.explode("by").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("all"))
    # Every task gets a head row of each language and block of sources before the language's terms: all sources with their totals.
    full = groups.join(sums, ["lang", "source"], "left").select("lang", F.struct("source", F.coalesce("total", F.lit(0)).alias("total")).alias("x"))
    heads = written(full.groupBy("lang").agg(F.sort_array(F.collect_list("x")).alias("heads")).join(langs, "lang", "left"), "heads")
    blocks = F.explode(F.sequence(F.lit(0), F.expr(f"cast((size(heads) - 1) div {side} as int)")))
    salts = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    head = heads.where("terms is not null").withColumn("block", blocks).withColumn("salt", salts)
    head = head.select("lang", "block", "salt", F.lit(0).alias("kind"), "heads", F.lit(None).cast("string").alias("term"), F.col("heads").alias("by"), F.col("all").alias("n"), "terms")
    head = head.drop("heads").select("lang", "block", "salt", "kind", "term", F.expr("transform(by, x -> struct(x.source as source, x.total as n))").alias("by"), "n", "terms")
    many = heads.select("lang", F.expr(f"cast((size(heads) - 1) div {side} as int)").alias("last"))
    rows = kept.join(many, "lang").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("last"))))
    rows = rows.select("lang", "block", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int").alias("salt"), F.lit(1).alias("kind"), "term", "by", "n", F.lit(None).cast("bigint").alias("terms"))
    dealt = head.union(rows).repartition(parts, "lang", "block", "salt").sortWithinPartitions("lang", "block", "kind")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of differences between a block of sources and all others (item a source), and terms above the language's share."""
        at = None
        names, index, totals, terms, of_all, block, sums_, vectors = [], {}, None, 0, 0, 0, None, []

        def out(kind: str, source: list, item: list, value: np.ndarray) -> pa.RecordBatch:
            cols = [pa.array([at[0]] * len(item), pa.string()), pa.array(source, pa.string()), pa.array([kind] * len(item), pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())]
            return pa.RecordBatch.from_arrays(cols, ["lang", "source", "part", "item", "value"])

        def above() -> Iterator[pa.RecordBatch]:
            """Adds the gathered terms to the sums."""
            nonlocal vectors
            if not vectors:
                return
            count = np.zeros((len(vectors), len(names)), np.int64)
            for i, (_, by, _) in enumerate(vectors):
                for x in by:
                    count[i, index[x["source"]]] = x["n"]
            p = shares(count, totals, terms, added)
            low = block * side
            for j in range(low, min(low + side, len(names))):
                sums_[j - low] += np.abs(p - p[:, j : j + 1]).sum(0)
            if block == 0:
                q = shares(np.array([v[2] for v in vectors]), of_all, terms, added)[:, None]
                i, j = np.nonzero((count > 0) & (p > q))
                yield out("term", [names[x] for x in j.tolist()], [vectors[x][0] for x in i.tolist()], (p - q)[i, j])
            vectors = []

        def ended() -> Iterator[pa.RecordBatch]:
            yield from above()
            low = block * side
            for j in range(low, min(low + side, len(names)) if at else low):
                others = [k for k in range(len(names)) if k != j]
                yield out("pair", [names[j]] * len(others), [names[k] for k in others], sums_[j - low][others])

        for b in batches:
            for lang, blk, kind, term, by, n, v in zip(*(b.column(c).to_pylist() for c in ("lang", "block", "kind", "term", "by", "n", "terms")), strict=True):
                if kind == 0:
                    if (lang, blk) == at:
                        continue
                    if at:
                        yield from ended()
                    at, block = (lang, blk), blk
                    names = [x["source"] for x in by]
                    index, totals, terms, of_all = {x: i for i, x in enumerate(names)}, np.array([x["n"] for x in by], np.int64), v, n
                    sums_ = np.zeros((side if len(names) > side else len(names), len(names)), np.int64)
                else:
                    vectors.append((term, by, n))
                    if len(vectors) * len(names) >= 1 << 18:
                        yield from above()
        if at:
            yield from ended()

    found = arrow_map(dealt, meet, "lang string, source string, part string, item string, value long")
    found = written(found, "found")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    bare = heads.where("terms is null").select("lang", "heads.source", F.explode("heads.source").alias("item")).select("lang", F.explode("source").alias("source"), F.lit("pair").alias("part"), "item", F.lit(0).cast("bigint").alias("value")).where("source <> item")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda d: d.withColumn("rank", F.row_number().over(order))
    return ranked(pairs.union(bare)).union(ranked(found.where("part = 'term'")).where(F.col("rank") <= top))


#: The same in plain steps, with hugeint arithmetic.
ORACLE = r"""
with d as (
  select row_number() over () as k, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents
), t as (select k, lang, source, unnest(ts) as term from d),
kept as (select lang, term, count(*) as n from t group by 1, 2 having count(distinct k) >= 30),
g as (select distinct lang, source from d),
v as (select lang, count(*) as terms, sum(n) as total from kept group by 1),
c as (select t.lang, t.source, t.term, count(*) as n from t join kept using (lang, term) group by 1, 2, 3),
s as (select g.lang, g.source, coalesce(sum(c.n), 0) as total from g left join c using (lang, source) group by 1, 2),
p as (
  select s.lang, s.source, kept.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (s.total + 5 * v.terms)::hugeint as p,
    1 + (1000000000::hugeint * (kept.n + 5)) // (v.total + 5 * v.terms)::hugeint as q
  from s join v using (lang) join kept using (lang) left join c on c.lang = s.lang and c.source = s.source and c.term = kept.term
), f as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
r as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
  union all select lang, source, 'term', term, p - q from p where n > 0 and p > q
)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from r) where part = 'pair' or rank <= 50
"""
