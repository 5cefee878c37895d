"""What the operators of this subpackage share: the shared folder, written tables, words and token ids."""

from __future__ import annotations

import contextlib
import ctypes
import itertools
import json
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are runs of anything but these characters: space and the controls from tab to carriage return.
WORD_GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset on a local master (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = have.get() if have.isDefined() else None
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lociforge-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes a Parquet table to the shared folder and reads it back, so that a lost executor costs no rerun."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, parts: int, name: str) -> DataFrame:
    """As `written`, as a table bucketed by the key: joins on it read the table where it is and don't deal it out again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    table = f"lociforge_{name}_{path.rsplit('-', 1)[1]}"
    df.write.format("parquet").bucketBy(parts, key).sortBy(key).option("path", path).saveAsTable(table)
    return spark.table(table)


#: Rows to an Arrow batch, at most: rows here are whole texts and whole sets.
BATCH_ROWS = 1000


def _release() -> None:
    """Gives memory that the task has freed back to the system, which allocators else keep while the worker waits for its next task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """`mapInArrow` for rows that hold whole texts: batches of few rows (a setting of the session, which is lowered where it
    is above BATCH_ROWS and stays so), and no memory held between tasks."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= BATCH_ROWS:
        df.sparkSession.conf.set(name, BATCH_ROWS)

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _release()

    return df.mapInArrow(lean, schema)


def bounded(rows: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """Labelled rows, of which there are at most `most` keys: where keys repeat so that there are more rows than that, one
    row of each key stays, with its largest text."""
    if rows.count() <= most:
        return rows
    rest = [c for c in rows.columns if c not in (key, text)]
    return rows.groupBy(key, *rest).agg(F.max(text).alias(text)).select(*rows.columns)


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(GAP_CHARS))
    return F.when(inner != "", F.split(inner, WORD_GAP)).otherwise(F.array().cast("array<string>"))


def texts_of(batch: pa.RecordBatch, column: str) -> Iterator[bytes]:
    """A column of strings as UTF-8, null as empty, without a list of the whole batch."""
    for x in batch.column(column).cast(pa.binary()):
        yield x.as_py() or b""


# --- hashes of words and shingles, vectorised over blocks of documents --------------------------------------------

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_IS_GAP = np.zeros(256, bool)
_IS_GAP[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64, up to n."""
    if not _powers or len(_powers["up"]) < n:
        n = max(n, 1 << 20)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            out = np.ones(n, np.uint64)
            have = 1
            while have < n:
                step = np.uint64(pow(base, have, 1 << 64))
                take = min(have, n - have)
                out[have : have + take] = out[:take] * step
                have += take
            _powers[name] = out
    return _powers["up"], _powers["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes and start offsets of the words of lower-cased UTF-8 text, made in blocks that end at a gap."""
    buf = np.frombuffer(data, np.uint8)
    hashes, offsets, at = [], [], 0
    while at < len(buf):
        end = min(at + block, len(buf))
        while end < len(buf) and not _IS_GAP[buf[end]]:
            more = np.flatnonzero(_IS_GAP[buf[end : end + block]])
            end = end + int(more[0]) if len(more) else min(end + block, len(buf))
        part = buf[at:end]
        gap = _IS_GAP[part]
        starts = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
        if len(starts):
            up, down = _power_tables(len(part))
            terms = (part.astype(np.uint64) + np.uint64(1)) * up[: len(part)]
            terms[gap] = 0
            hashes.append(mix64(np.add.reduceat(terms, starts) * down[starts]))
            offsets.append(starts + at)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(offsets)


def shingle_sets(texts: Iterator[bytes], width: int = 5, block: int = 1 << 20) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its word shingles, A-Z lower-cased. Fewer words than width: one for the whole sequence; no words: none."""

    def of(group: list[bytes]) -> Iterator[np.ndarray]:
        data = b"\n".join(group).lower()
        h, at = word_hashes(data)
        ends = np.cumsum([len(x) + 1 for x in group])
        cuts = np.concatenate(([0], np.searchsorted(at, ends)))
        if len(h) >= width:
            s = h[: len(h) - width + 1].copy()
            for i in range(1, width):
                s = s * np.uint64(_BASE) + h[i : len(h) - width + 1 + i]
            s = mix64(s)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(s[a : b - width + 1])
            elif b > a:
                one = b - a
                for x in h[a:b].tolist():
                    one = (one * 0xD6E8FEB86659FD93 + x) & _MASK
                yield mix64(np.array([one], np.uint64))
            else:
                yield np.empty(0, np.uint64)

    group, size = [], 0
    for x in texts:
        group.append(x)
        size += len(x)
        if size >= block:
            yield from of(group)
            group, size = [], 0
    if group:
        yield from of(group)


# --- token ids ----------------------------------------------------------------------------------------------------


def tokenizer_path() -> str:
    """The vocabulary that the queries use; every operator takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# The normalizer and pre-tokenizer of the tokenizer files whose texts can be encoded word by word.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PIECES = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": _PIECES}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Words of these characters are cut into the pre-tokenizer's pieces by the expression behind; all others by the library.
_COMMON = re.compile(r"[\x21-\x7eà-öø-ÿ]+")
_COMMON_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿ]+|[0-9]|\n|[^\na-z0-9à-öø-ÿ]+")
_LANES = 3
_LANE_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def _byte_letters() -> np.ndarray:
    """The code points by which a byte-level vocabulary writes bytes: printable ones of Latin-1 as they are, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = np.zeros(256, "<u4")
    out[shown] = shown
    out[out == 0] = 256 + np.arange(256 - len(shown))
    return out


class WordTokenizer:
    """Token ids of whole texts from a tokenizers file, for blocks of texts at once.

    Where the file's pre-tokenizer never joins characters across white space, a text's ids are those of its words, one
    after the other. Words are looked up as arrays, in a table that is sorted by a hash and compared on up to 24 bytes, so
    that only new words reach the model; longer words are kept by themselves. The table starts anew beyond `room` words or
    sixteen times as many ids. Texts with special tokens are encoded as a whole, and so are all texts for any other kind
    of file.
    """

    def __init__(self, path: str, room: int = 1_000_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.t, self.room = Tokenizer.from_file(path), room
        self.size = self.t.get_vocab_size(with_added_tokens=True)
        state = lambda x: json.loads(x.__getstate__()) if x is not None else None
        m = self.t.model
        self.by_word = state(self.t.normalizer) == _NORMALIZER and state(self.t.pre_tokenizer) == _PRE_TOKENIZER
        self.by_word = self.by_word and type(m).__name__ == "BPE" and not m.dropout and not m.unk_token and self.t.truncation is None and self.t.padding is None
        added = [x.content.encode() for x in self.t.get_added_tokens_decoder().values()]
        self.special, self.mark = re.compile(rb"|".join(map(re.escape, added)) or rb"(?!)", re.I), os.path.commonprefix(added).partition(b"|")[0]
        # Spaces part the pieces of words, and line breaks, which are no pieces, the words.
        self.bare, self.letters = Tokenizer(m), _byte_letters()
        self.letters[[10, 32]] = 32
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.ends = np.array([(self.t.id_to_token(i) or "").endswith("</w>") for i in range(self.size)])
        self.by_word = self.by_word and m.end_of_word_suffix == "</w>"
        self._clear()

    def _clear(self) -> None:
        self.hash, self.slot = np.empty(0, np.uint64), np.empty(0, np.int32)  # sorted by hash
        self.lanes = [np.empty(0, np.uint64)] * _LANES  # these by slot
        self.n, self.at = np.empty(0, np.int32), np.empty(0, np.int64)
        self.flat, self.long = np.empty(0, np.uint32), {}

    def _learn(self, words: list[bytes], lanes: list[np.ndarray]) -> np.ndarray:
        """Slots of new words. Those of common letters go to the model all in one text, a piece to a word of it."""
        text = b"\n".join(words).decode().lower().split("\n")
        odd = [i for i, w in enumerate(text) if w and not _COMMON.fullmatch(w)]
        alone = [x.ids for x in self.t.encode_batch_fast([words[i].decode() for i in odd], add_special_tokens=False)]
        for i in odd:
            text[i] = ""
        pieces = _COMMON_PIECES.findall("\n".join(text))
        spaced = self.letters[np.frombuffer(" ".join(pieces).encode(), np.uint8)].tobytes().decode("utf-32-le")
        ids = np.array(self.bare.encode_batch_fast([spaced], add_special_tokens=False)[0].ids, np.uint32)
        breaks = np.flatnonzero(np.fromiter((p == "\n" for p in pieces), bool, len(pieces)))
        per_piece = np.concatenate(([0], np.flatnonzero(self.ends[ids]) + 1))  # ids before each piece, line breaks left out
        before = per_piece[np.concatenate(([0], breaks - np.arange(len(breaks)), [len(pieces) - len(breaks)]))]
        n = np.diff(before)
        if odd:
            ids = np.insert(ids, np.repeat(before[odd], [len(x) for x in alone]), np.fromiter(itertools.chain.from_iterable(alone), np.uint32))
            n[odd] = [len(x) for x in alone]
        old = len(self.n)
        self.at = np.concatenate((self.at, len(self.flat) + np.cumsum(n) - n))
        self.n = np.concatenate((self.n, n.astype(np.int32)))
        self.flat = np.concatenate((self.flat, ids))
        self.lanes = [np.concatenate(x) for x in zip(self.lanes, lanes, strict=True)]
        return np.arange(old, old + len(words), dtype=np.int32)

    def _slots(self, data: bytes, buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The slot of every word; `buf` is `data` with some bytes more behind its end."""
        wide = np.ndarray(len(buf) - 7, "<u8", buf, 0, (1,))
        lanes = [wide[starts + 8 * i] & _LANE_MASKS[np.clip(sizes - 8 * i, 0, 8)] for i in range(_LANES)]
        lanes[-1][sizes > 8 * _LANES] = ~np.uint64(0)  # no text has these bytes: a long word never passes for its first 24
        h = mix64(lanes[0] + lanes[1] * np.uint64(_BASE) + lanes[2] * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(h)
        kind = np.concatenate(([True], np.diff(h[order]) != 0))
        first, of = order[kind], np.empty(len(h), np.int64)
        of[order] = np.cumsum(kind) - 1
        u = h[first]
        place = np.searchsorted(self.hash, u)
        new = np.ones(len(u), bool)
        inside = place < len(self.hash)
        new[inside] = self.hash[place[inside]] != u[inside]
        slot = np.empty(len(u), np.int32)
        slot[~new] = self.slot[place[~new]]
        if new.any():
            at = first[new]
            ends = (starts[at] + np.minimum(sizes[at], 8 * _LANES)).tolist()
            slot[new] = self._learn([data[a:b] if n <= 8 * _LANES else b"" for a, b, n in zip(starts[at].tolist(), ends, sizes[at].tolist(), strict=True)], [x[at] for x in lanes])
            self.hash, self.slot = np.insert(self.hash, place[new], u[new]), np.insert(self.slot, place[new], slot[new])
        out = slot[of]
        same = sizes <= 8 * _LANES
        for mine, theirs in zip(lanes, self.lanes, strict=True):
            same &= mine == theirs[out]
        odd = {i: data[starts[i] : starts[i] + sizes[i]] for i in np.flatnonzero(~same).tolist()}  # long words, and any whose hash another one has
        if odd:
            if new := list({w for w in odd.values() if w not in self.long}):
                self.long |= zip(new, self._learn(new, [np.zeros(len(new), np.uint64)] * _LANES).tolist(), strict=True)
            out[list(odd)] = [self.long[w] for w in odd.values()]
        return out

    def _words(self, data: bytes, ends: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lower-cased texts joined by a gap each, and how many each has; `ends` are the places behind the gaps."""
        buf = np.frombuffer(data + bytes(8 * _LANES + 8), np.uint8)
        parts, count, at, n = [], np.zeros(len(ends), np.int64), 0, len(data)
        while at < n:
            end = min(at + block, n)
            while end < n and not _IS_GAP[buf[end]]:
                more = np.flatnonzero(_IS_GAP[buf[end : min(end + block, n)]])
                end = end + int(more[0]) if len(more) else min(end + block, n)
            gap = _IS_GAP[buf[at:end]]
            edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True]))))
            starts, sizes = edge[::2] + at, edge[1::2] - edge[::2]
            if len(starts):
                if len(self.n) > self.room or len(self.flat) > 16 * self.room:
                    self._clear()
                slot = self._slots(data, buf, starts, sizes)
                k = self.n[slot].astype(np.int64)
                stop = np.cumsum(k)
                parts.append(self.flat[np.repeat(self.at[slot] - (stop - k), k) + np.arange(stop[-1])])
                count += np.bincount(np.searchsorted(ends, starts, side="right"), weights=k, minlength=len(ends)).astype(np.int64)
            at = end
        return np.concatenate(parts) if parts else np.empty(0, np.uint32), count

    def encode(self, texts: list[bytes], end_id: int | None = None, block: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of all texts one after the other, each with `end_id` behind it if there is one, and where each text ends."""
        # Marks from U+0300 on may join an upper-case letter otherwise than a lower-case one, so those texts aren't lower-cased here.
        whole = [i for i, x in enumerate(texts) if not self.by_word or b"\xcc" in x or b"\xcd" in x or (self.mark in x and self.special.search(x))]
        rest = texts
        if whole:
            rest = list(texts)
            for i in whole:
                rest[i] = b""
        ids, count = self._words(b"\n".join(rest).lower() + b"\n", np.cumsum([len(x) + 1 for x in rest]), block)
        if whole:
            made = [np.array(x.ids, np.uint32) for x in self.t.encode_batch_fast([texts[i].decode() for i in whole], add_special_tokens=False)]
            ids = np.insert(ids, np.repeat((np.cumsum(count) - count)[whole], [len(x) for x in made]), np.concatenate(made))
            count[whole] = [len(x) for x in made]
        ends = np.cumsum(count)
        if end_id is None:
            return ids, ends
        return np.insert(ids, ends, np.uint32(end_id)), ends + np.arange(1, len(ends) + 1)

    def batches(self, texts: Iterator[bytes], end_id: int, size: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """`encode` for texts in turn, about `size` bytes together."""
        held, n = [], 0
        for x in texts:
            held.append(x)
            n += len(x)
            if n >= size:
                yield self.encode(held, end_id)
                held, n = [], 0
        if held:
            yield self.encode(held, end_id)


_tokenizers: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One per Python worker, kept between tasks."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


# --- files on the shared storage ----------------------------------------------------------------------------------


def open_file(uri: str, mode: str):
    """A stream on any storage that pyarrow knows by URI (file, hdfs, s3, gs): 'r' seekable, 'w' new, folders made as needed."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")
    if mode == "r":
        return store.open_input_file(path)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(path, compression=None)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
