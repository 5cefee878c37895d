"""Token-id shards under a Re-Pair grammar: frequent id pairs become nonterminals, again and again.

A shard file holds whole documents in ascending order of their ids. Little-endian layout:

    magic "RPG1" | counts: rules, documents, symbols, ids, first nonterminal, bytes a symbol (6 x uint64)
    rules: left uint32[], right uint32[], expansion length uint32[]
    documents: id int64[], id present uint8[], first symbol uint64[documents + 1], first id uint64[documents + 1]
    symbols uint16[] or uint32[]

No rule reaches past a document's end id, so a document is a run of symbols and is decoded alone; the expansion lengths
find an id inside it without expanding what stands before.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, new_path, open_file, shuffle_partitions, texts_of, word_tokenizer, written

MAGIC = b"RPG1"
MANIFEST = "part long, shard long, path string, n_docs long, n_ids long, n_symbols long, n_rules long"
_BUCKETS = 17


def _bucket(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)) >> np.uint32(32 - _BUCKETS)


def grammar(ids: np.ndarray, first: int, end_id: int, per_round: int = 2048, min_count: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and rules (left, right) of a Re-Pair grammar over ids below `first`.

    Each round replaces the most frequent pairs, at most `per_round`, from left to right without overlaps, until no pair
    is found `min_count` times. Pairs are counted in hashed buckets first, and only those in the fullest buckets exactly,
    or in all that may hold a frequent pair where the fullest have too few. Nothing is joined behind an end id.
    """
    seq, rules = ids.astype(np.uint32), [np.empty((0, 2), np.uint32)]
    closed = np.zeros(first + len(ids), bool)  # every rule makes the sequence shorter
    closed[end_id] = True
    base = first
    while len(seq) > 1:
        a, b = seq[:-1], seq[1:]
        bucket, free = _bucket(a, b), ~closed[a]
        count = np.bincount(bucket[free], minlength=1 << _BUCKETS)
        for least in sorted({max(min_count, int(np.partition(count, -per_round)[-per_round])), min_count}, reverse=True):
            at = np.flatnonzero((count >= least)[bucket] & free)
            pairs = (a[at].astype(np.uint64) << np.uint64(32)) | b[at]
            kinds, n = np.unique(pairs, return_counts=True)
            top = np.argsort(-n, kind="stable")[:per_round]
            kinds = kinds[top[n[top] >= min_count]]
            if len(kinds) == per_round:
                break
        if not len(kinds):
            break
        new = np.column_stack((kinds >> np.uint64(32), kinds & np.uint64(0xFFFFFFFF))).astype(np.uint32)
        slot = _bucket(new[:, 0], new[:, 1])
        rule_at = np.full(1 << _BUCKETS, -1, np.int32)
        rule_at[slot[::-1]] = np.arange(len(kinds))[::-1]  # of kinds in one bucket the most frequent; the others wait a round
        rule = rule_at[bucket[at]]
        hit = (rule >= 0) & (kinds[rule] == pairs)
        at, rule = at[hit], rule[hit]
        fresh = np.concatenate(([True], np.diff(at) > 1))  # in a run of neighbours every other pair is taken
        start = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        even = (np.arange(len(at)) - start) % 2 == 0
        at, rule = at[even], rule[even]
        used = np.bincount(rule, minlength=len(kinds)) > 0  # not those whose places all went to their neighbours
        new, rule = new[used], (np.cumsum(used) - 1)[rule]
        closed[base : base + len(new)] = closed[new[:, 1]]
        seq[at] = base + rule
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, base = seq[keep], base + len(new)
        rules.append(new)
    return seq, np.concatenate(rules)


def expansions(rules: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every symbol the place and length of its ids in one flat array."""
    parts = [np.arange(first, dtype=np.uint32)]
    full: list[np.ndarray] = []
    for left, right in rules.tolist():
        x = [np.array([s], np.uint32) if s < first else full[s - first] for s in (left, right)]
        full.append(np.concatenate(x))
    parts += full
    size = np.array([1] * first + [len(x) for x in full], np.int64)
    return np.concatenate(parts), np.concatenate(([0], np.cumsum(size)[:-1])), size


def expand(symbols: np.ndarray, flat: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
    n = size[symbols]
    ends = np.cumsum(n)
    return flat[np.repeat(place[symbols] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


def shard_bytes(doc_ids: list, raws: list[bytes], first: int, end_id: int, **how) -> tuple[bytes, int, int, int]:
    """A shard file of whole documents; also its ids, symbols and rules."""
    ids = np.frombuffer(b"".join(raws), "<u4")
    id_at = np.concatenate(([0], np.cumsum([len(x) // 4 for x in raws]))).astype("<u8")
    seq, rules = grammar(ids, first, end_id, **how)
    size = np.ones(first + len(rules), np.int64)
    for i, (left, right) in enumerate(rules.tolist()):
        size[first + i] = size[left] + size[right]
    reach = np.concatenate(([0], np.cumsum(size[seq])))
    symbol_at = np.searchsorted(reach, id_at).astype("<u8")
    kind = "<u2" if first + len(rules) <= 1 << 16 else "<u4"
    head = np.array([len(rules), len(doc_ids), len(seq), len(ids), first, int(kind[-1])], "<u8")
    parts = [head, rules[:, 0].astype("<u4"), rules[:, 1].astype("<u4"), size[first:].astype("<u4")]
    parts += [np.array([x or 0 for x in doc_ids], "<i8"), np.array([x is not None for x in doc_ids], "u1"), symbol_at, id_at, seq.astype(kind)]
    return MAGIC + b"".join(x.tobytes() for x in parts), len(ids), len(seq), len(rules)


class Shard:
    """A shard file opened for decoding: `ids(i)` expands one document alone, `token(i, place)` gives one id of it."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a grammar shard")
        rules, docs, symbols, self.n_ids, self.first, width = np.frombuffer(data, "<u8", 6, 4).tolist()
        at = 52

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.rules = np.column_stack((take("<u4", rules), take("<u4", rules)))
        self.size = take("<u4", rules)
        ids, there = take("<i8", docs), take("u1", docs)
        self.doc_ids = [x if ok else None for x, ok in zip(ids.tolist(), there.tolist(), strict=True)]
        self.symbol_at, self.id_at = take("<u8", docs + 1), take("<u8", docs + 1)
        self.symbols = take(f"<u{width}", symbols)
        self._table = None

    def _own(self, i: int) -> np.ndarray:
        return self.symbols[int(self.symbol_at[i]) : int(self.symbol_at[i + 1])]

    def ids(self, i: int) -> np.ndarray:
        if self._table is None:
            self._table = expansions(self.rules, self.first)
        return expand(self._own(i), *self._table)

    def token(self, i: int, place: int) -> int:
        """The id at a place of a document, from 0: whole symbols are passed by their expansion lengths, and then one is
        followed down its rules, so nothing is expanded. A place outside the document is an IndexError."""
        own = self._own(i)
        reach = np.cumsum(np.where(own < self.first, 1, self.size[np.maximum(own, self.first) - self.first] if len(self.size) else 1))
        if not 0 <= place < (reach[-1] if len(reach) else 0):
            raise IndexError(place)
        k = int(np.searchsorted(reach, place, side="right"))
        symbol, place = int(own[k]), place - (int(reach[k - 1]) if k else 0)
        while symbol >= self.first:
            left, right = self.rules[symbol - self.first].tolist()
            n = int(self.size[left - self.first]) if left >= self.first else 1
            symbol, place = (left, place) if place < n else (right, place - n)
        return symbol


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = 1 << 20) -> DataFrame:
    """Encodes whole texts, orders documents by id over the cluster and writes grammar shards of about `shard_ids` ids.

    Returns the manifest, already written to the shared folder: a file that a lost task left behind is not in it.
    Null ids come first; equal ids follow the hash of their texts; null texts are the end id alone; an empty table
    gives an empty manifest.
    """
    rows = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text")
    ordered = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    names = [x.split()[0] for x in MANIFEST.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, part = word_tokenizer(tokenizer), TaskContext.get().partitionId()
        first, shard, ids, raws, held = t.size, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            data, n_ids, n_symbols, n_rules = shard_bytes(ids, raws, first, end_id)
            path = f"{folder}/{part:06d}-{shard:06d}-{uuid.uuid4().hex}.rpg"
            with open_file(path, "w") as f:
                f.write(data)
            row = dict(zip(names, (part, shard, path, len(ids), n_ids, n_symbols, n_rules), strict=True))
            ids.clear()
            raws.clear()
            return pa.RecordBatch.from_pylist([row], pa.schema([(n, pa.string() if n == "path" else pa.int64()) for n in names]))

        for batch in batches:
            docs = iter(batch.column(0).to_pylist())
            for made, ends in t.batches(texts_of(batch, "text"), end_id):
                raw, at = made.astype("<u4").tobytes(), 0
                for end in ends.tolist():
                    ids.append(next(docs))
                    raws.append(raw[4 * at : 4 * end])
                    held, at = held + end - at, end
                    if held >= shard_ids:
                        yield flush()
                        shard, held = shard + 1, 0
        if ids:
            yield flush()

    return written(arrow_map(ordered, run, MANIFEST), "shard-manifest")


def read_shards(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Decodes every document of the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Starts are running sums of the manifest's counts: first over parts, then over the shards of a part.
    """
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    in_part = Window.partitionBy("part").orderBy("shard")
    files = manifest.join(parts.select("part", "before"), "part").select("path", (F.col("before") + F.sum("n_ids").over(in_part) - F.col("n_ids")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open_file(path, "r") as f:
                    shard = Shard(f.read())
                sums = [zlib.crc32(shard.ids(i).astype("<u4").tobytes()) for i in range(len(shard.doc_ids))]
                at = shard.id_at.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(first + at[:-1]), pa.array(np.diff(at)), pa.array(sums, pa.int64())], schema=schema)

    return arrow_map(files.repartition(shuffle_partitions(spark)), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Writes grammar shards of all documents and reads them back."""
    spark = docs.sparkSession
    return read_shards(spark, write_shards(docs, new_path(spark, "repair"), tokenizer, end_id))
