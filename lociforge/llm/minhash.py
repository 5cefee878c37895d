"""MinHash near-duplicates with sequential Bayesian verification.

Every set of shingles has a signature of HASHES minima under different hashes; BANDS bands of them are the lists on which
sets meet (`lists.py`). A pair that met is compared a batch of its signatures at a time: with m of n minima equal and a
uniform prior, its similarity is Beta(m + 1, n - m + 1), and the pair is dropped as soon as the chance that it reaches the
threshold is below the chosen miss probability. Pairs that pass all batches are compared on their whole sets.

Bands don't part sets just below the threshold from those above it, so what the leaders leave of a long list would all meet
all. Its sets are candidates only if they also share one of their rarest shingles, which sets above the threshold do: the
prefix filter of `ngram_join.py`, which loses nothing.

Two sets of similarity 0.85 share no band with a probability of 6e-11 (32 bands of 4 hashes); the more similar, the less.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bucketed, mix64, shingle_sets, shuffle_partitions, texts_of, written
from .components import components
from .lists import Rules, linked
from .ngram_join import BATCH_BYTES, join_rules, most_apart, needed_sets, parity_bits, prefix_members, set_id, verified

#: Hashes of a signature, bands that they form, and hashes to a batch of the comparison.
HASHES, BANDS, STEP = 128, 32, 32
#: Probability at which a pair is given up although it may reach the threshold.
MISS = 1e-6
#: Shingles that are hashed at a time.
BLOCK = 1 << 15

_SEEDS = mix64(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTORS = mix64(_SEEDS) | np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The minima (uint32, a row to a set) of sets that aren't empty, a block of shingles at a time."""
    out = np.full((len(sets), HASHES), 0xFFFFFFFF, np.uint32)
    flat, ends = np.concatenate(sets) if sets else np.empty(0, np.uint64), np.cumsum([len(s) for s in sets])
    for at in range(0, len(flat), BLOCK):
        part = flat[at : at + BLOCK]
        first = int(np.searchsorted(ends, at, side="right"))
        cuts = np.concatenate(([0], ends[first:] - at))
        cuts = cuts[: int(np.searchsorted(cuts, len(part)))]
        rows = slice(first, first + len(cuts))
        for i in range(HASHES):
            least = np.minimum.reduceat((part ^ _SEEDS[i]) * _FACTORS[i], cuts) >> np.uint64(32)
            out[rows, i] = np.minimum(out[rows, i], least.astype(np.uint32))
    return out


def least_matches(percent: int, miss: float = MISS) -> list[int]:
    """For each batch, how many of all minima up to it must be equal for a pair to go on. The posterior chance to reach t,
    with m of n equal, is that of at most m successes in n + 1 draws of t."""
    t, out = percent / 100, []
    for n in range(STEP, HASHES + 1, STEP):
        chance, m = 0.0, -1
        while chance < miss:
            m += 1
            chance += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def described(docs: DataFrame, width: int) -> DataFrame:
    """Per document doc_id, n (set size) and sid (its set's name, null without words); in rows of their own, once a task,
    the signature of each set."""
    kinds = [("doc_id", pa.int64()), ("n", pa.int32()), ("sid", pa.int64()), ("sig", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()

        def signed(new: dict[int, np.ndarray]) -> pa.RecordBatch:
            sig = signatures(list(new.values())).astype("<u4")
            cols = [[None] * len(new), [len(s) for s in new.values()], list(new), [x.tobytes() for x in sig]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, kinds, strict=True)], [n for n, _ in kinds])

        for batch in batches:
            n, sid, new, held = [], [], {}, 0
            for s in shingle_sets(texts_of(batch, "text"), width):
                n.append(len(s))
                sid.append(set_id(s) if len(s) else None)
                if len(s) and sid[-1] not in seen:
                    if len(seen) >= 200_000:
                        seen.clear()
                    seen.add(sid[-1])
                    new[sid[-1]] = s
                    held += s.nbytes
                    if held > BATCH_BYTES:
                        yield signed(new)
                        new, held = {}, 0
            if new:
                yield signed(new)
            cols = [batch.column(0).to_pylist(), n, sid, [None] * len(n)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, kinds, strict=True)], [n for n, _ in kinds])

    return arrow_map(docs, run, "doc_id long, n int, sid long, sig binary")


def banded(sigs: DataFrame) -> DataFrame:
    """Rows (key, sid, np) of the bands that more than one set shows; np packs the set's size and the band."""
    rows = HASHES // BANDS
    band = f"transform(sequence(0, {BANDS - 1}), b -> xxhash64(substring(sig, 1 + {4 * rows} * b, {4 * rows}), b))"
    all_ = sigs.select("sid", "n", F.expr(f"posexplode({band})").alias("band", "key")).selectExpr("key", "sid", "shiftleft(cast(n as bigint), 32) | band as np")
    several = all_.groupBy("key").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("lo <> hi").select("key")
    return written(all_.join(written(several, "bands"), "key", "left_semi"), "members")


def survivors(pairs: DataFrame, sigs: DataFrame, percent: int, miss: float = MISS) -> DataFrame:
    """The pairs (a, b) whose posterior chance to reach the threshold stays at `miss` or above, batch after batch."""
    least = least_matches(percent, miss)
    both = pairs.join(sigs.select(F.col("sid").alias("a"), F.col("sig").alias("x")), "a").join(sigs.select(F.col("sid").alias("b"), F.col("sig").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, HASHES) for c in ("x", "y"))
            alive, equal = np.arange(len(x)), np.zeros(len(x), np.int64)
            for i, m in enumerate(least):
                step = slice(STEP * i, STEP * (i + 1))
                equal = equal + (x[alive, step] == y[alive, step]).sum(1)
                alive, equal = alive[equal >= m], equal[equal >= m]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(alive)) for c in ("a", "b")], ["a", "b"])

    return arrow_map(both.select("a", "b", "x", "y"), run, "a long, b long")


def band_rules(percent: int) -> Rules:
    """Sets on one list may be linked if their sizes allow it."""
    size = f"least(l.n, r.n) * 100 >= {percent} * greatest(l.n, r.n) and {percent} * (l.n + r.n) <= {100 + percent} * (least(l.n, r.n) - if(l.n = r.n, 1, 0))"
    return Rules(lambda d: size, lambda d: "true", lambda d: "true", "1", 2, most_apart(percent))


def minhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 85, miss: float = MISS) -> DataFrame:
    """Near-duplicate groups: documents are linked when 100 * shared shingles >= percent * all their shingles, found by bands
    of MinHash signatures, pruned by the posterior of their similarity at the miss probability `miss`, confirmed on whole sets.

    Returns per row of `docs`: doc_id, n_shingles (set size), component_id (the smallest doc_id reachable by links, itself
    included) and kept (whether the row names its component). A-Z are lower-cased, words are runs of anything but space and
    tab to carriage return, and a text of fewer than `width` words has the whole sequence as its only shingle.

    Null texts and texts without words have an empty set, n_shingles 0, and are linked with nothing; rows with the same id
    are compared as separate texts (all of the least id are kept); a null id never names a component while another id is in
    it and is kept only where there is none; an empty table gives no rows; other columns are not read. Whole sets are
    compared by 64-bit hashes of their shingles.
    """
    docs = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text")
    parts = shuffle_partitions(docs.sparkSession)
    about = written(described(docs, width), "described")
    mine = about.where("sig is null").select("doc_id", "n", "sid")
    sigs = bucketed(about.where("sig is not null").groupBy("sid").agg(F.first("n").alias("n"), F.first("sig").alias("sig")), "sid", parts, "signatures")
    members = banded(sigs)
    sets = needed_sets(docs, width, members.select("sid"), parts)
    confirm = lambda pairs: verified(written(survivors(pairs, sigs, percent, miss), "survivors"), sets, percent)
    bits = parity_bits(sets, parts)
    links, long = linked(members, bits, band_rules(percent), confirm, only_few=True)
    if long is not None:
        links, _ = linked(prefix_members(long, sets, percent, parts), bits, join_rules(percent), confirm, links)
    root = components(links)
    named = mine.join(root, mine.sid == root.node, "left").select("doc_id", "n", F.coalesce("root", "sid").alias("root"))
    group = named.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    found = named.join(group, "root", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


#: The groups by brute force: every pair of texts that share a shingle is counted. Rows are told apart by number.
ORACLE = r"""
with recursive w as (
  select row_number() over () as k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents
), s as (
  select k, doc_id, case when len(ws) >= 5 then list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end as sh from w
), p as (select k, unnest(sh) as x from s),
j as (select a.k as a, b.k as b, count(*) as c from p a join p b on a.x = b.x and a.k < b.k group by 1, 2),
l as (select a, b from j join s x on x.k = j.a join s y on y.k = j.b where 100 * c >= 85 * (len(x.sh) + len(y.sh) - c)),
e as (select a, b from l union all select b, a from l),
reach as (select k, k as root from s union select e.b, r.root from reach r join e on e.a = r.k),
g as (select r.k, min(s.doc_id) as component_id from reach r join s on s.k = r.root group by 1)
select s.doc_id, cast(len(sh) as bigint) as n_shingles, coalesce(g.component_id, s.doc_id) as component_id, s.doc_id is not distinct from coalesce(g.component_id, s.doc_id) as kept from s join g using (k)
"""
