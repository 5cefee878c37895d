"""N-gram Jaccard self-join: rare-first prefix filtering with length, positional and suffix filters.

A document is the set of its five-word shingles, as 64-bit hashes. Equal sets form a class, named by the hash of the
set; all work below is on classes. Shingles are ordered rarest first by the count of their hash bucket over the whole
corpus, then by hash: any total order gives exact results, a rare-first one short lists. Two sets of Jaccard similarity
of at least the threshold share a shingle among the first few of each, so only these prefixes are dealt out and met.

The sets that share a shingle in their prefixes form a list. Lists are joined to a leader first, and what other components
remain meet on more common shingles (`lists.py`). No link between components is lost and no list is cut.

Prefixes are SHARED - 1 longer than one common shingle asks for, so two linked sets have at least SHARED of them in common
(or all that their overlap allows). Sets in fewer lists, as chance makes them, are left out before any comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, bucketed, mix64, shingle_sets, shuffle_partitions, texts_of, written
from .components import components
from .lists import BITS, Rules, hot_lists, linked, on_lists

#: Hash buckets whose counts order the shingles, and how many of them travel in one row.
SKETCH_BITS, CHUNK_BITS = 20, 14
#: Shingles that two linked sets have in common in their prefixes.
SHARED = 4
#: Bytes to a batch that goes back, about.
BATCH_BYTES = 1 << 22
#: Bits of the filter that spares documents without candidates from being sent.
NEEDED_BITS, NEEDED_CHUNK_BITS = 23, 17


def set_id(s: np.ndarray) -> int:
    """A signed 64-bit name of a set of hashes: sums of two mixed forms, which the order doesn't touch."""
    x, y = (int(mix64(v).sum()) for v in (s + np.uint64(0x632BE59BD9B4E019), s ^ np.uint64(0xA0761D6478BD642F)))
    both = (x * 0x9E3779B97F4A7C15 + y + len(s)) & 0xFFFFFFFFFFFFFFFF
    return int(mix64(np.array([both], np.uint64)).view(np.int64)[0])


def _with_set_id(width: int, text_at: int):
    """Adds the set's name (null for none) to whole rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sid = [set_id(s) if len(s) else None for s in shingle_sets(texts_of(b, b.schema.names[text_at]), width)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sid, pa.int64())], [*b.schema.names, "sid"])

    return run


def _chunks(bits: int, per: int, values: np.ndarray) -> Iterator[tuple[int, bytes, int]]:
    kind = "u1" if values.max(initial=0) < 256 else "<u2" if values.max() < 65536 else "<u8"
    for i, x in enumerate(values.astype(kind).reshape(1 << (bits - per), 1 << per)):
        if x.any():
            yield i, x.tobytes(), x.itemsize


def _rows(columns: dict[str, list], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(v, kinds[k]) for k, v in columns.items()}, pa.schema(list(kinds.items())))


def describe(docs: DataFrame, width: int) -> DataFrame:
    """Per document its id, set size and set name; and, in rows of their own, each task's counts of hash buckets."""
    kinds = {"doc_id": pa.int64(), "n": pa.int32(), "sid": pa.int64(), "chunk": pa.int32(), "counts": pa.binary(), "itemsize": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            n, sid, held = [], [], []
            for s in shingle_sets(texts_of(batch, "text"), width):
                n.append(len(s))
                sid.append(set_id(s) if len(s) else None)
                held.append((s & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int32))
                if len(held) == 256:
                    count += np.bincount(np.concatenate(held), minlength=len(count))
                    held = []
            if held:
                count += np.bincount(np.concatenate(held), minlength=len(count))
            none = [None] * len(n)
            yield _rows({"doc_id": batch.column(0).to_pylist(), "n": n, "sid": sid, "chunk": none, "counts": none, "itemsize": none}, kinds)
        made = list(_chunks(SKETCH_BITS, CHUNK_BITS, count))
        none = [None] * len(made)
        yield _rows({"doc_id": none, "n": none, "sid": none, "chunk": [x[0] for x in made], "counts": [x[1] for x in made], "itemsize": [x[2] for x in made]}, kinds)

    return arrow_map(docs, run, "doc_id long, n int, sid long, chunk int, counts binary, itemsize int")


def summed(chunks: DataFrame, per: int, parts: int) -> DataFrame:
    """Sums (or, for one-byte marks, unites) the tasks' chunks: rows of a chunk meet in one task and are added as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(raw, f"<u{size}")
                total[i] = total.get(i, np.zeros(1 << per, np.int64)) + x
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in total.values()], pa.binary())], ["chunk", "counts"])

    return arrow_map(chunks.select("chunk", "counts", "itemsize").repartition(parts, "chunk"), run, "chunk int, counts binary")


def _table(chunks: DataFrame, bits: int, per: int, parts: int) -> np.ndarray:
    """The summed counts on the driver: 2**bits of them, whatever the corpus holds."""
    out = np.zeros(1 << bits, np.int64)
    for x in summed(chunks, per, parts).collect():
        out[x["chunk"] << per : (x["chunk"] + 1) << per] = np.frombuffer(x["counts"], "<i8")
    return out


def order_keys(s: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Sorted keys of a set: the class of its bucket's count in the top byte, the hash below."""
    top = rarity[s & np.uint64((1 << SKETCH_BITS) - 1)].astype(np.uint64)
    return np.sort((top << np.uint64(56)) | (s & np.uint64((1 << 56) - 1)))


def rarity_classes(count: np.ndarray) -> np.ndarray:
    """Sixteen classes to every doubling of a bucket's count, one byte each."""
    return np.minimum(255, np.floor(8 * np.log2(1 + count))).astype(np.uint8)


def probe_length(n, percent: int):
    """How many first keys a set of n must show to meet any set that is not longer."""
    return n - -(-percent * n // 100) + 1


def index_length(n, percent: int):
    """How many first keys it must show to be met by sets that are not shorter."""
    return n - -(-2 * percent * n // (100 + percent)) + 1


def least_overlap(na, nb, percent: int):
    """100 * intersection >= percent * union, for the intersection."""
    return -(-percent * (na + nb) // (100 + percent))


def least_lists(n: str, percent: int) -> str:
    """SQL of how many lists a set of n must be in to be linked at all."""
    return f"least({SHARED}, ceil({percent} * {n} / 100))"


def prefixes(docs: DataFrame, width: int, percent: int, rarity: np.ndarray) -> DataFrame:
    """Rows (key, sid, np) of each set's prefix; np packs set size and position. Sets seen before in the task are left out."""

    def out(keys: list, sids: list, sizes: list) -> pa.RecordBatch:
        p = np.array([x[1] for x in sizes])
        at = np.arange(p.sum()) - np.repeat(np.cumsum(p) - p, p)
        packed = (np.repeat(np.array([x[0] for x in sizes], np.int64), p) << 32) | at
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(np.array(sids, np.int64), p)), pa.array(packed)], ["key", "sid", "np"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, sids, sizes, held = [], [], [], 0
            for s in shingle_sets(texts_of(batch, "text"), width):
                if not len(s) or (sid := set_id(s)) in seen:
                    continue
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(sid)
                p = min(len(s), int(probe_length(len(s), percent)) + SHARED - 1)
                keys.append(order_keys(s, rarity)[:p].view(np.int64))
                sids.append(sid)
                sizes.append((len(s), p))
                held += 24 * p
                if held > BATCH_BYTES:
                    yield out(keys, sids, sizes)
                    keys, sids, sizes, held = [], [], [], 0
            if keys:
                yield out(keys, sids, sizes)

    return arrow_map(docs.select("text"), run, "key long, sid long, np long")


def bucket_counts(sets: DataFrame, parts: int) -> np.ndarray:
    """Counts of the hash buckets over the sets of a table (sid, keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for x in batch.column("keys"):
                count += np.bincount(np.frombuffer(x.as_buffer(), np.uint64).astype(np.int64) & ((1 << SKETCH_BITS) - 1), minlength=len(count))
        made = list(_chunks(SKETCH_BITS, CHUNK_BITS, count))
        yield _rows({"chunk": [x[0] for x in made], "counts": [x[1] for x in made], "itemsize": [x[2] for x in made]}, {"chunk": pa.int32(), "counts": pa.binary(), "itemsize": pa.int32()})

    return _table(arrow_map(sets.select("keys"), run, "chunk int, counts binary, itemsize int"), SKETCH_BITS, CHUNK_BITS, parts)


def set_prefixes(sets: DataFrame, percent: int, rarity: np.ndarray) -> DataFrame:
    """As `prefixes`, of the sets of a table (sid, keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sid, x in zip(batch.column("sid").to_pylist(), batch.column("keys"), strict=True):
                s = np.frombuffer(x.as_buffer(), np.uint64)
                p = min(len(s), int(probe_length(len(s), percent)) + SHARED - 1)
                yield pa.RecordBatch.from_arrays([pa.array(order_keys(s, rarity)[:p].view(np.int64)), pa.array(np.full(p, sid, np.int64)), pa.array((len(s) << 32) | np.arange(p))], ["key", "sid", "np"])

    return arrow_map(sets.select("sid", "keys"), run, "key long, sid long, np long")


def prefix_members(some: DataFrame, sets: DataFrame, percent: int, parts: int) -> DataFrame:
    """Members of the prefix lists (key, sid, np) of some classes (sid)."""
    mine = written(sets.join(some, "sid", "left_semi"), "some")
    rarity = rarity_classes(bucket_counts(mine, parts))
    return _in_enough_lists(written(meetings(set_prefixes(mine, percent, rarity), percent, parts), "members"), percent)


def _meets(na, pa_, nb, pb, percent: int):
    """Length, prefix and positional filters for a (not longer) and b at the places of a shared key, if it is among the
    first SHARED that they share: those, and the rest behind the key, bound the overlap."""
    fits = 100 * na >= percent * nb
    fits &= pa_ < index_length(na, percent) + SHARED - 1
    return fits & (np.minimum(na - pa_, nb - pb) + SHARED - 1 >= least_overlap(na, nb, percent))


def meetings(prefix: DataFrame, percent: int, parts: int) -> DataFrame:
    """The members (key, sid, np) of all lists of at least two sets. Rows are walked in order of their keys, batch by
    batch; a list of exactly two that fail the filters is left out at once."""
    dealt = prefix.repartition(parts, "key").sortWithinPartitions("key", "np", "sid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = tuple(np.empty(0, np.int64) for _ in range(3))
        kept, passing = nothing, None  # a list that may go on in the next batch; the key of one that is being passed on

        def members(key, sid, packed, last: bool):
            nonlocal kept, passing
            again = np.concatenate(([False], (key[1:] == key[:-1]) & (sid[1:] == sid[:-1])))
            key, sid, packed = key[~again], sid[~again], packed[~again]
            cuts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
            size = np.diff(cuts)
            kept = nothing
            if not last and size[-1] <= 2 and key[-1] != passing:
                kept = key[cuts[-2] :], sid[cuts[-2] :], packed[cuts[-2] :]
                cuts, size = cuts[:-1], size[:-1]
                key, sid, packed = key[: cuts[-1]], sid[: cuts[-1]], packed[: cuts[-1]]
            if not len(size):
                return None
            go = size > 2
            i = cuts[:-1][size == 2]
            n, at = packed >> 32, packed & 0xFFFFFFFF
            go[size == 2] = _meets(n[i], at[i], n[i + 1], at[i + 1], percent)
            if passing is not None:
                go |= key[cuts[:-1]] == passing
            if not last and not len(kept[0]):
                passing = int(key[-1])
            go = np.repeat(go, size)
            return pa.RecordBatch.from_arrays([pa.array(x[go]) for x in (key, sid, packed)], ["key", "sid", "np"])

        for batch in batches:
            cols = [np.concatenate((k, batch.column(i).to_numpy())) for i, k in enumerate(kept)]
            if len(cols[0]) and (out := members(*cols, False)) is not None:
                yield out
        if len(kept[0]) and (out := members(*kept, True)) is not None:
            yield out

    return arrow_map(dealt, run, "key long, sid long, np long")


def _marks(sids: DataFrame, parts: int) -> np.ndarray:
    """A fixed-size bitmap of the classes that have candidates, united from the tasks' own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = np.zeros(1 << NEEDED_BITS, bool)
        for batch in batches:
            mark[batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - NEEDED_BITS)] = True
        for i, x in enumerate(np.packbits(mark).reshape(-1, 1 << (NEEDED_CHUNK_BITS - 3))):
            if x.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["chunk", "bits"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total[i] = total.get(i, np.zeros(len(raw), np.uint8)) | np.frombuffer(raw, np.uint8)
        for i, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["chunk", "bits"])

    kind, out = "chunk int, bits binary", np.zeros(1 << (NEEDED_BITS - 3), np.uint8)
    for x in arrow_map(arrow_map(sids, run, kind).repartition(parts, "chunk"), unite, kind).collect():
        raw = np.frombuffer(x["bits"], np.uint8)
        out[x["chunk"] * len(raw) : (x["chunk"] + 1) * len(raw)] = raw
    return out


def needed_sets(docs: DataFrame, width: int, sids: DataFrame, parts: int) -> DataFrame:
    """The whole sets (sid, keys as sorted uint64 bytes) of the classes that have candidates."""
    bits = _marks(sids, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, seen = np.unpackbits(bits).astype(bool), set()
        for batch in batches:
            names, sets, held = [], [], 0
            for s in shingle_sets(texts_of(batch, "text"), width):
                if not len(s) or (sid := set_id(s)) in seen or not mark[(sid & 0xFFFFFFFFFFFFFFFF) >> (64 - NEEDED_BITS)]:
                    continue
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(sid)
                names.append(sid)
                sets.append(s.tobytes())
                held += s.nbytes
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.binary())], ["sid", "keys"])
                    names, sets, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.binary())], ["sid", "keys"])

    found = arrow_map(docs.select("text"), run, "sid long, keys binary").join(sids.select("sid").distinct(), "sid", "left_semi")
    return bucketed(found.groupBy("sid").agg(F.first("keys").alias("keys")), "sid", parts, "sets")


def parity_bits(sets: DataFrame, parts: int) -> DataFrame:
    """For every set of a table (sid, keys) the BITS of how many of its shingles fall to each of as many places, odd or even.
    A shingle that only one of two sets has turns one bit, so sets differ in at least as many shingles as bits."""
    places = 64 * len(BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odd = np.zeros((len(batch), places), np.uint8)
            for i, x in enumerate(batch.column("keys")):
                s = mix64(np.frombuffer(x.as_buffer(), np.uint64))
                odd[i] = np.bincount((s & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
            bits = np.packbits(odd, axis=1).view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column("sid"), *(pa.array(bits[:, i]) for i in range(len(BITS)))], ["sid", *BITS])

    return bucketed(arrow_map(sets.select("sid", "keys"), run, "sid long, " + ", ".join(f"{m} long" for m in BITS)), "sid", parts, "bits")


def may_overlap(x: np.ndarray, y: np.ndarray, least: int, depth: int = 3) -> bool:
    """Suffix filter: split both sorted sets at the middle key of one; sizes on either side bound what they can share."""

    def bound(x: np.ndarray, y: np.ndarray, depth: int) -> int:
        if not depth or not len(x) or not len(y):
            return min(len(x), len(y))
        pivot = y[len(y) // 2]
        i, j = int(np.searchsorted(x, pivot)), len(y) // 2
        return bound(x[:i], y[:j], depth - 1) + bound(x[i:], y[j:], depth - 1)

    return bound(x, y, depth) >= least


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links; each comes once and is compared once, whole set against whole set."""
    both = pairs.join(sets.select(F.col("sid").alias("a"), F.col("keys").alias("x")), "a").join(sets.select(F.col("sid").alias("b"), F.col("keys").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for i, j, x, y in zip(*(batch.column(c) for c in ("a", "b", "x", "y")), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                least = least_overlap(len(x), len(y), percent)
                if may_overlap(x, y, least) and len(np.intersect1d(x, y, assume_unique=True)) >= least:
                    a.append(i.as_py())
                    b.append(j.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return arrow_map(both.select("a", "b", "x", "y"), run, "a long, b long")


def most_apart(percent: int) -> str:
    """SQL of how many shingles at most are in one of two linked sets only: what the least overlap leaves of both."""
    return f"l.n + r.n - 2 * ceil({percent} * (l.n + r.n) / {100 + percent})"


def join_rules(percent: int) -> Rules:
    """The filters in SQL. Of two different sets of sizes n and m, 100 * intersection >= percent * union asks for
    ceil(percent * (n + m) / (100 + percent)) common shingles: fewer than either has if the sizes are equal. If the d-th
    shared key stands at pos, d - 1 come before it and at most n - pos from it on; but keys beyond the first SHARED lie
    outside the prefixes. Up to four shingles, sets of three and four are all that can share fewer than four."""

    def pair(d: int) -> str:
        passed = SHARED - 1 if d == 1 else d - 1  # at first any of the first SHARED may have brought them together
        return (
            f"least(l.n, r.n) * 100 >= {percent} * greatest(l.n, r.n) and {percent} * (l.n + r.n) <= {100 + percent} * (least(l.n, r.n) - if(l.n = r.n, 1, 0)) "
            f"and (least(l.n - l.pos, r.n - r.pos) + {passed}) * {100 + percent} >= {percent} * (l.n + r.n)"
        )

    def member(d: int) -> str:
        return f"(n - pos + {SHARED - 1 if d == 1 else d - 1}) * 100 >= {percent} * n"

    def short(d: int) -> str:
        return f"(n - pos + {SHARED - 1 if d == 1 else d - 1}) * {100 + percent} >= {2 * percent} * n"

    overlap = f"ceil({percent} * (l.n + r.n) / {100 + percent})"
    return Rules(pair, member, short, f"least({SHARED}, {overlap})", SHARED, most_apart(percent), f"n < {SHARED}")


def _in_enough_lists(members: DataFrame, percent: int) -> DataFrame:
    """Members of sets that are in as many lists as a link takes, in lists that still have two; done twice over."""
    hot = hot_lists(members)
    for _ in range(2):
        n = members.groupBy("sid").agg(F.count("*").alias("lists"), F.expr("shiftright(min(np), 32)").alias("n")).where(f"lists >= {least_lists('n', percent)}")
        members = members.join(n.select("sid"), "sid", "left_semi")
        several = members.groupBy("key").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("lo <> hi")
        members = written(on_lists(members, several.select("key"), hot, "left_semi"), "members")
    return members


def _classes(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, sid) of every row, and (node, root) of the classes that have links; `docs` has doc_id and text."""
    parts = shuffle_partitions(docs.sparkSession)
    about = written(describe(docs, width), "sets")
    rarity = rarity_classes(_table(about.where("chunk is not null"), SKETCH_BITS, CHUNK_BITS, parts))
    members = written(meetings(prefixes(docs, width, percent, rarity), percent, parts), "members")
    members = _in_enough_lists(members, percent)
    sets = needed_sets(docs, width, members.select("sid"), parts)
    links, _ = linked(members, parity_bits(sets, parts), join_rules(percent), lambda pairs: verified(pairs, sets, percent))
    return about.where("chunk is null").select("doc_id", "n", "sid"), components(links)


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """Near-duplicate groups: documents are linked when 100 * shared shingles >= percent * all their shingles.

    Returns per row of `docs`: doc_id, n_shingles (set size), component_id (the smallest doc_id reachable by links,
    itself included) and component_size (rows in it). A-Z are lower-cased, words are runs of anything but space and
    tab to carriage return, and a text of fewer than `width` words has the whole sequence as its only shingle.

    Null texts and texts without words have an empty set, n_shingles 0, and are linked with nothing; rows with the same
    id are compared as separate texts; a null id is kept and never names a component while another id is in it; an
    empty table gives no rows; other columns are not read. Sets are compared by 64-bit hashes of their shingles.
    """
    mine, root = _classes(docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text"), width, percent)
    named = mine.join(root, mine.sid == root.node, "left").select("doc_id", "n", F.coalesce("root", "sid").alias("root"))
    group = named.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("component_size"))
    return named.join(group, "root", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("component_size", F.lit(1)).alias("component_size")
    )


def one_of_each_group(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """The rows of `docs`, with all their columns as they are, of which one of each group of near duplicates stays: the
    row of the least doc_id (a null id only if the group has no other; of equal ids, one). Rows without words all stay.
    """
    mine, root = _classes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width, percent)
    named = mine.where("sid is not null").join(root, mine.sid == root.node, "left").select("doc_id", "sid", F.coalesce("root", "sid").alias("root"))
    first = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sid")).alias("x"))
    first = first.select(F.col("x.doc_id").alias("doc_id"), F.col("x.sid").alias("sid")).withColumn("k", F.xxhash64("doc_id", "sid")).alias("first")
    names = [f"c{i}" for i in range(len(docs.columns))]  # whatever the columns are called, none clashes with those below
    own = arrow_map(docs.toDF(*names), _with_set_id(width, docs.columns.index("text")), T.StructType([*docs.toDF(*names).schema.fields, T.StructField("sid", T.LongType())]))
    own = own.withColumn("doc_id", F.col(names[docs.columns.index("doc_id")]).cast("long"))
    own = own.withColumn("k", F.when(F.col("sid").isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64("doc_id", "sid"))).alias("own")
    met = own.join(first, (F.col("own.k") == F.col("first.k")) & F.col("own.doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("own.sid") == F.col("first.sid")), "left")
    stays = met.where("own.sid is null or first.sid is not null").select("own.*").dropDuplicates(["k", "doc_id", "sid"])
    return stays.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))


#: The groups by brute force: every pair of texts that share a shingle is counted. Rows are told apart by number.
ORACLE = r"""
with recursive w as (
  select row_number() over () as k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents
), s as (
  select k, doc_id, case when len(ws) >= 5 then list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end as sh from w
), p as (select k, unnest(sh) as x from s),
j as (select a.k as a, b.k as b, count(*) as c from p a join p b on a.x = b.x and a.k < b.k group by 1, 2),
l as (select a, b from j join s x on x.k = j.a join s y on y.k = j.b where 100 * c >= 75 * (len(x.sh) + len(y.sh) - c)),
e as (select a, b from l union all select b, a from l),
reach as (select k, k as root from s union select e.b, r.root from reach r join e on e.a = r.k),
g as (select r.k, min(s.doc_id) as component_id, count(*) as component_size from reach r join s on s.k = r.root group by 1)
select s.doc_id, cast(len(sh) as bigint) as n_shingles, g.component_id, g.component_size from s join g using (k)
"""
