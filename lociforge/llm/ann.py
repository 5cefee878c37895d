"""Approximate nearest neighbours by stable projections and kd-trees.

Vectors get one more coordinate, which makes the largest inner product the smallest Euclidean distance, and are
projected to a few dimensions with Gaussian entries. The square of a projected distance over that of the true one then
follows a chi-square distribution. A kd-tree over the projections yields a query's projected neighbours by distance; each
is verified on the original vectors, and the search stops once a still nearer one would, by the chi-square test, have
come up before with the wanted probability.

The upper levels of the tree are fitted on a bounded sample and deal the rows to blocks; every block has a tree of its
own. A query is first searched in the nearest block; the distance found there tells by the same test which other blocks it
must visit, and bounds the search in them. Blocks are dealt out once for each million queries; a task holds one block and
its queries stream by.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, shuffle_partitions, written

#: Rows that the upper tree is fitted on, at most; rows a block should have; blocks of the upper tree and queries of a batch, at most.
SAMPLE, BLOCK_ROWS, MAX_LEAVES, QUERY_ROWS = 20_000, 8192, 4096, 1 << 20
LEAF = 256


def chi2_quantile(p: float, m: int) -> float:
    """The p-quantile of the chi-square distribution with an even number m of degrees of freedom."""
    tail = lambda x: math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
    lo, hi = 0.0, 10.0 * m + 200
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - tail(mid) < p else (lo, mid)
    return (lo + hi) / 2


def projection(dims: int, m: int, seed: int) -> np.ndarray:
    """Gaussian entries for the augmented vectors."""
    return np.random.default_rng(seed).standard_normal((dims + 1, m))


def matrix(column) -> np.ndarray:
    """A column of equally long lists as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def inner(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed alike for equal rows wherever they stand."""
    return (x * q).sum(axis=1)


def projected(x: np.ndarray, r: np.ndarray, norm2: float | None) -> np.ndarray:
    """Projections; data rows get the coordinate that brings all to the largest norm, queries (None) get 0."""
    extra = np.zeros(len(x)) if norm2 is None else np.sqrt(np.maximum(0.0, norm2 - (x * x).sum(axis=1)))
    return x @ r[:-1] + extra[:, None] * r[-1]


def top_splits(y: np.ndarray, levels: int) -> list[tuple[int, float]]:
    """A complete kd-tree in heap order: (coordinate, value) of the widest coordinate's median at each node."""
    parts, out = [y], []
    for _ in range(levels):
        below = []
        for p in parts:
            c = int(np.argmax(p.max(0) - p.min(0))) if len(p) else 0
            v = float(np.median(p[:, c])) if len(p) else 0.0
            out.append((c, v))
            below += [p[p[:, c] < v], p[p[:, c] >= v]]
        parts = below
    return out


def leaf_of(y: np.ndarray, splits: list[tuple[int, float]], levels: int) -> np.ndarray:
    node = np.zeros(len(y), np.int64)
    c, v = (np.array([s[i] for s in splits] or [0]) for i in (0, 1))
    for _ in range(levels):
        node = 2 * node + 1 + (y[np.arange(len(y)), c[node].astype(int)] >= v[node])
    return node - (2**levels - 1)


def box_distance2(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Squared distances from a point to boxes."""
    d = np.maximum(0, np.maximum(lo - q, q - hi))
    return (d * d).sum(axis=1)


class KdTree:
    """A kd-tree with bounding boxes: nodes are split at the median of their widest coordinate down to about LEAF points."""

    def __init__(self, y: np.ndarray):
        self.order = np.arange(len(y))
        lo, hi, self.span, self.children = [], [], [], []
        todo = [(0, len(y), None)]
        while todo:
            a, b, parent = todo.pop()
            mine = y[self.order[a:b]]
            lo.append(mine.min(0) if b > a else np.zeros(y.shape[1]))
            hi.append(mine.max(0) if b > a else np.zeros(y.shape[1]))
            self.span.append((a, b))
            self.children.append([])
            if parent is not None:
                self.children[parent].append(len(lo) - 1)
            if b - a > LEAF:
                half = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(mine[:, int(np.argmax(hi[-1] - lo[-1]))], half)]
                todo += [(a + half, b, len(lo) - 1), (a, a + half, len(lo) - 1)]
        self.lo, self.hi = np.array(lo), np.array(hi)
        self.y = y[self.order]  # a node's points are neighbours
        self.size2 = (self.y * self.y).sum(axis=1)

    def nearest(self, q: np.ndarray, within: float = np.inf) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All points by rising distance from q, up to the squared distance `within`, in runs of (rows, squared distances):
        nodes are opened nearest first, and a point is given out once no closed node is nearer."""
        near, q2 = box_distance2(q, self.lo, self.hi), float(q @ q)
        heap, rows, d2, burst = [(float(near[0]), 0)], np.empty(0, np.int64), np.empty(0), 1
        while heap:
            new_rows, new_d2 = [rows], [d2]
            while heap and len(new_rows) <= burst:
                _, node = heapq.heappop(heap)
                for child in self.children[node]:
                    if near[child] <= within:
                        heapq.heappush(heap, (float(near[child]), child))
                if not self.children[node]:
                    a, b = self.span[node]
                    d = self.size2[a:b] - 2 * (self.y[a:b] @ q) + q2
                    keep = d <= within
                    new_rows.append(self.order[a:b][keep])
                    new_d2.append(d[keep])
            rows, d2, burst = np.concatenate(new_rows), np.concatenate(new_d2), burst * 2
            out = d2 <= heap[0][0] if heap else np.ones(len(d2), bool)
            if out.any():
                by = np.argsort(d2[out])
                yield rows[out][by], d2[out][by]
                rows, d2 = rows[~out], d2[~out]


class Block:
    """The rows of a block with their tree; `search` is the incremental one."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, r: np.ndarray, norm2: float):
        self.ids, self.x, self.tree, self.verified = ids, x, KdTree(projected(x, r, norm2)), 0

    def search(self, own: int, q: np.ndarray, yq: np.ndarray, k: int, norm2: float, stop: float, bound: float) -> list[tuple[int, float]]:
        """The k best of score and then id, at least `bound`; `stop` is the chi-square quantile of the test, which is made
        before every quarter more of what has been verified (64 rows at least)."""
        q2, done, kth = float(q @ q) + norm2, 0, bound
        rows_kept, kept, top = [], [], np.empty(0)
        reach = lambda: stop * max(0.0, q2 - 2 * kth) * (1 + 1e-9) if kth > -np.inf else np.inf
        for rows, d2 in self.tree.nearest(yq, reach()):
            at, ended = 0, False
            while at < len(rows):
                limit = reach()
                if d2[at] > limit:
                    ended = True
                    break
                end = min(len(rows), at + max(64, done // 4), int(np.searchsorted(d2, limit, side="right")))
                go = rows[at:end]
                done, at = done + len(go), end
                if kth > -np.inf:  # what is worse by more than the last digits needs no exact sum
                    go = go[self.x[go] @ q >= kth - 1e-9 * q2]
                go = go[self.ids[go] != own]
                scores = inner(self.x[go], q)
                good = scores >= kth
                if not good.any():
                    continue
                rows_kept.append(go[good])
                kept.append(scores[good])
                top = np.concatenate((top, scores[good]))
                if len(top) >= k:
                    top = np.partition(top, -k)[-k:]
                    kth = max(kth, float(top.min()))
            if ended:
                break
        self.verified += done
        if not kept:
            return []
        ids, scores = self.ids[np.concatenate(rows_kept)], np.concatenate(kept)
        best = np.lexsort((ids, -scores))[:k]
        return list(zip(ids[best].tolist(), scores[best].tolist(), strict=True))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, x (doubles): rows with an id and a vector that isn't zero and has only finite components, of the commonest length."""
    x = F.col(f"`{vec_col}`").cast("array<double>")
    v = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null and x is not null")
    finite = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    v = v.where(finite & F.exists("x", lambda e: e != 0))
    common = v.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return v.where(F.size("x") == (common["d"] if common else 0))


def search(vectors: DataFrame, k: int = 20, every: int = 20, m: int = 16, p: float = 0.9, seed: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """For the rows whose id is divisible by `every`: query_id, rank (from 1), vec_id and score of the k nearest that the
    search finds among all rows but those with the query's own id, by the largest inner product, ties to the smaller id.

    A true neighbour is missed with a probability of about 1 - p at most. Vectors that are null, zero, hold null or
    non-finite components or have another length than most take no part; with fewer than k candidates all are returned;
    rows that repeat an id are candidates each and queries each, so an id may be answered more than once; an empty table
    gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    v = usable(vectors, id_col, vec_col)
    facts = v.agg(F.count("*").alias("n"), F.max(F.aggregate("x", F.lit(0.0), lambda s, e: s + e * e)).alias("norm2"), F.max(F.size("x")).alias("d")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not facts["n"]:
        return spark.createDataFrame([], schema)
    norm2, stop = float(facts["norm2"]), chi2_quantile(p, m)
    r = projection(facts["d"], m, seed)
    levels = min(max(0, math.ceil(math.log2(facts["n"] / BLOCK_ROWS))), int(math.log2(MAX_LEAVES)))
    splits: list = []
    if levels:
        some = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()  # bounded by `sample`
        splits = top_splits(projected(matrix(some.column("x")), r, norm2), levels)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                leaf = leaf_of(projected(matrix(b.column("x")), r, norm2), splits, levels)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("x"), pa.array(leaf.astype(np.int32))], ["vec_id", "x", "leaf"])

    dealt = written(arrow_map(v, deal, "vec_id long, x array<double>, leaf int"), "vectors")

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for b in batches:
            if not b.num_rows:
                continue
            y, leaf = projected(matrix(b.column("x")), r, norm2), b.column("leaf").to_numpy()
            for i in np.unique(leaf).tolist():
                lo, hi, n = found.get(i, (np.inf, -np.inf, 0))
                mine = y[leaf == i]
                found[i] = [np.minimum(lo, mine.min(0)), np.maximum(hi, mine.max(0)), n + len(mine)]
        cols = [pa.array(list(found), pa.int32()), pa.array([x[2] for x in found.values()], pa.int64()), *(pa.array([x[j].tolist() for x in found.values()], pa.list_(pa.float64())) for j in (0, 1))]
        yield pa.RecordBatch.from_arrays(cols, ["leaf", "n", "lo", "hi"])

    ends = [F.array(*(f(F.get(c, j)) for j in range(m))).alias(c) for c, f in (("lo", F.min), ("hi", F.max))]
    leaves = arrow_map(dealt.select("leaf", "x"), boxes, "leaf int, n long, lo array<double>, hi array<double>").groupBy("leaf").agg(F.sum("n").alias("n"), *ends).collect()  # MAX_LEAVES rows at most
    leaves.sort(key=lambda x: x["leaf"])
    number = {x["leaf"]: -(-x["n"] // (2 * BLOCK_ROWS)) for x in leaves}  # blocks that a leaf is cut into: common vectors make it large
    lo, hi = (np.array([x[c] for x in leaves]) for c in ("lo", "hi"))
    names = np.array([x["leaf"] for x in leaves])
    cut = F.element_at(F.create_map(*(F.lit(x) for kv in number.items() for x in kv)), F.col("leaf"))
    blocks = dealt.select("vec_id", "x", "leaf", F.pmod(F.xxhash64("vec_id", "x"), cut).cast("int").alias("sub"))
    queries = dealt.where(F.col("vec_id") % every == 0).select(F.monotonically_increasing_id().alias("query"), F.col("vec_id").alias("query_id"), F.col("x").alias("q"))
    batches_ = max(1, -(-facts["n"] // every // QUERY_ROWS))
    queries = written(queries.withColumn("batch", F.pmod(F.xxhash64("query"), F.lit(batches_)).cast("int")), "queries")
    kind = "vec_id long, x array<double>, batch int, leaf int, sub int, query long, bound double"
    names_ = [c.split()[0] for c in kind.split(", ")]

    def visit(first: bool):
        """Queries once for each block that they go to: first the nearest leaf's first block, then all others that the test leaves."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                q, bound = matrix(b.column("q")), b.column("bound").to_numpy()
                y, q2 = projected(q, r, None), (q**2).sum(axis=1) + norm2
                row, leaf, sub = [], [], []
                for i in range(len(y)):
                    near = box_distance2(y[i], lo, hi)
                    one = int(names[near.argmin()])
                    go = [(one, 0)]
                    if not first:
                        limit = stop * max(0.0, q2[i] - 2 * bound[i]) * (1 + 1e-9) if bound[i] > -np.inf else np.inf
                        go = [(x, s) for x in names[near <= limit].tolist() for s in range(number[x]) if (x, s) != (one, 0)]
                    row += [i] * len(go)
                    leaf += [x for x, _ in go]
                    sub += [s for _, s in go]
                t = b.take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([t.column("query_id"), t.column("q"), t.column("batch"), pa.array(leaf, pa.int32()), pa.array(sub, pa.int32()), t.column("query"), t.column("bound")], names_)

        return run

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by block, its vectors (without a query number) before its queries: a block is held, queries stream by."""
        now, ids, xs, block = None, [], [], None
        for b in batches:
            keys = np.column_stack([b.column(c).to_numpy() for c in ("batch", "leaf", "sub")])
            asks = b.column("query").is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1) | (asks[1:] != asks[:-1])))) if len(keys) else []
            found: tuple[list, list, list, list] = ([], [], [], [])
            for a, z in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                part, key = b.slice(a, z - a), tuple(keys[a].tolist())
                if key != now:
                    now, ids, xs, block = key, [], [], None
                x, own = matrix(part.column("x")), part.column("vec_id").to_numpy()
                if not asks[a]:
                    ids.append(own)
                    xs.append(x)
                    continue
                if block is None and ids:
                    block = Block(np.concatenate(ids), np.concatenate(xs), r, norm2)
                if block is not None:
                    y = projected(x, r, None)
                    for i, (number_, bound) in enumerate(zip(part.column("query").to_pylist(), part.column("bound").to_pylist(), strict=True)):
                        for vec, score in block.search(int(own[i]), x[i], y[i], k, norm2, stop, bound):
                            for c, value in zip(found, (number_, int(own[i]), vec, score), strict=True):
                                c.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query", "query_id", "vec_id", "score"])

    keys = ["batch", "leaf", "sub"]
    spread = blocks.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches_ - 1)))).select("vec_id", "x", "batch", "leaf", "sub", F.lit(None).cast("long").alias("query"), F.lit(None).cast("double").alias("bound"))

    def round_of(q: DataFrame, first: bool) -> DataFrame:
        sent = arrow_map(q.select("query", "query_id", "q", "batch", "bound"), visit(first), kind)
        met = spread.union(sent.select(*names_)).repartition(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys, F.col("query").asc_nulls_first())
        return arrow_map(met, within, "query long, query_id long, vec_id long, score double")

    none = F.lit(float("-inf"))
    one = written(round_of(queries.withColumn("bound", none), True), "nearest")
    kth = one.groupBy("query").agg(F.count("*").alias("c"), F.min("score").alias("s")).select("query", F.when(F.col("c") >= k, F.col("s")).otherwise(none).alias("bound"))
    two = round_of(queries.join(kth, "query", "left").withColumn("bound", F.coalesce("bound", none)), False)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return one.union(two).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
