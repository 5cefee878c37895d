"""Harmonic packing of token sequences into training sequences of a fixed capacity.

Lengths fall into reciprocal-capacity classes: class k holds the pieces of at most capacity / k ids (and more than
capacity / (k + 1)), and a bin of class k is full with k of them. A document is cut so that its pieces meet the upper
end of their class: powers of two first, which fill their bins to the last id, then one rest below `tail` ids. Every
task fills the bins of all classes on its own, holding only the open ones, so nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import arrow_map, texts_of, word_tokenizer

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, class_k int"
TASK_BITS = 36


def cut_lengths(n: int, capacity: int, tail: int) -> list[int]:
    """Whole capacities, then falling powers of two, then what is left below `tail`, so that only that rest can waste room."""
    out = [capacity] * (n // capacity)
    rest, size = n % capacity, capacity // 2
    while rest >= tail:
        if rest >= size:
            out.append(size)
            rest -= size
        size //= 2
    return out + [rest] * (rest > 0)


class HarmonicBins:
    """The open bins of one task. `add` gives a piece its place; `close` opens no more and is called once at the end.

    A piece is a tuple with its length at LENGTH; where it is placed, its sequence, its offset there and its class follow.
    """

    LENGTH = 2

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id, self.open = capacity, first_id, {}

    def add(self, piece: tuple) -> Iterator[tuple]:
        """The pieces of a bin, once it is full with the fixed count of its class."""
        k = self.capacity // piece[self.LENGTH]
        held = self.open.setdefault(k, [])
        held.append(piece)
        if len(held) == k:
            yield from self._place(held)
            self.open[k] = []

    def _place(self, pieces: list[tuple]) -> Iterator[tuple]:
        at, sequence = 0, self.next_id
        self.next_id += 1
        for x in pieces:
            yield (*x, sequence, at, self.capacity // x[self.LENGTH])
            at += x[self.LENGTH]

    def close(self) -> Iterator[tuple]:
        """Bins left open: equal powers of two make sequences of a power of two, without padding; the others share bins, longest first."""
        rest = []
        for k, held in sorted(self.open.items()):
            size = held[0][self.LENGTH] if held else 0
            if held and size * k == self.capacity and all(x[self.LENGTH] == size for x in held):
                while held:
                    n = 1 << (len(held).bit_length() - 1)
                    yield from self._place(held[:n])
                    held = held[n:]
            else:
                rest += held
        bins: list[list] = []
        for x in sorted(rest, key=lambda x: -x[self.LENGTH]):
            fit = next((b for b in bins if b[0] + x[self.LENGTH] <= self.capacity), None)
            if fit is None:
                bins.append(fit := [0, []])
            fit[0] += x[self.LENGTH]
            fit[1].append(x)
        for _, pieces in bins:
            yield from self._place(pieces)
        self.open = {}


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 2, tail: int = 128) -> DataFrame:
    """Packs the token ids of every whole text, each with `end_id` after it, into sequences of at most `capacity` ids.

    One row per piece: doc_id, start (ids of its document before it), length, ids_crc32 (unsigned, of the ids as
    little-endian uint32), doc_tokens (with the end id), sequence_id, offset (in the sequence, gapless from 0) and
    class_k. Sequence ids are unique and depend on how the input is partitioned.

    Null or empty texts give one piece with the end id alone; a null id stays null; rows with the same id are separate
    documents; a text of any length is cut into pieces; an empty table gives no rows; other columns are not read.
    """
    assert capacity & (capacity - 1) == 0 and 1 <= tail <= capacity, "the capacity is a power of two"
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int32() if n == "class_k" else pa.int64() for n in names]

    def table(pieces: list[tuple]) -> pa.RecordBatch:
        columns = zip(*pieces, strict=True) if pieces else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, bins, out = word_tokenizer(tokenizer), HarmonicBins(capacity, TaskContext.get().partitionId() << TASK_BITS), []
        for batch in batches:
            docs = iter(batch.column(0).to_pylist())
            for ids, ends in t.batches(texts_of(batch, batch.schema.names[1]), end_id):
                raw, first = memoryview(ids.astype("<u4").tobytes()), 0
                for end in ends.tolist():
                    doc, n, at = next(docs), end - first, 0
                    for size in cut_lengths(n, capacity, tail):
                        out.extend(bins.add((doc, at, size, zlib.crc32(raw[4 * (first + at) : 4 * (first + at + size)]), n)))
                        at += size
                    first = end
                if len(out) >= 10_000:
                    yield table(out)
                    out = []
        out.extend(bins.close())
        yield table(out)

    return arrow_map(docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text"), run, SCHEMA)
