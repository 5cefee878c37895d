"""Random walks with restart over blocks of a graph: the vectors of busy nodes travel, those of quiet ones stay in their block."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bucketed, checkpointed

#: Edges to a block, and numbers of its nodes' vectors, at most about.
BLOCK_EDGES, BLOCK_CELLS = 1 << 18, 1 << 23
#: Busy nodes whose links may lie in one task as a matrix, and numbers of each of their vectors there.
CORE_NODES, CORE_PLACES = 1024, 256


def _sums(at: np.ndarray, of: np.ndarray, x: np.ndarray, size: int) -> np.ndarray:
    """Row i: the sum of those rows of x that `of` names where `at` is i. Dense links are a matrix product."""
    out = np.zeros((size, x.shape[1]))
    if not len(at):
        return out
    rows, r = np.unique(at, return_inverse=True)
    cols, c = np.unique(of, return_inverse=True)
    if len(rows) * len(cols) <= 16 * len(at):
        out[rows] = np.bincount(r * len(cols) + c, minlength=len(rows) * len(cols)).reshape(len(rows), -1).astype(float) @ x[cols]
        return out
    order = np.argsort(r, kind="stable")
    starts, of = np.searchsorted(r[order], np.arange(len(rows))), of[order]
    width = max(1, (1 << 22) // len(of))
    for j in range(0, x.shape[1], width):
        out[rows, j : j + width] = np.add.reduceat(x[of, j : j + width], starts, axis=0)
    return out


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], np.ascontiguousarray(x).ravel())


class _Block:
    """A block's nodes and links, with what came for its nodes: vectors and, as the last column, whether there is one."""

    def __init__(self, t: pa.Table, vectors: pa.Table | None = None) -> None:
        t = t.take(pa.array(np.argsort(t["at"].to_numpy())))
        self.genes, self.deg, busy = t["gene"].combine_chunks(), t["deg"].to_numpy().astype(float)[:, None], t["busy"].to_numpy()
        near = t["near"].combine_chunks()
        lo = np.repeat(np.arange(len(t)), pc.list_value_length(near).to_numpy())
        hi = near.flatten().to_numpy()
        q = ~busy[lo]
        self.quiet, self.loud, self.is_quiet = (lo[q], hi[q]), (lo[~q], hi[~q]), ~busy
        if vectors is None:
            return
        v = _matrix(vectors["vec"], len(vectors))
        self.x = np.zeros((len(t), v.shape[1] + 1))
        self.x[vectors["place"].to_numpy()] = np.column_stack((v, np.ones(len(v))))

    def rows(self, x: np.ndarray, keep: np.ndarray) -> pa.Table:
        return pa.table([self.genes.filter(pa.array(keep)), _lists(x[keep])], ["gene", "vec"])

    def links(self) -> pa.Table:
        """P between busy nodes (near) and P P by way of the block's quiet ones (far), where they aren't 0."""
        ends = np.flatnonzero(~self.is_quiet)
        near, far = np.zeros((2, len(ends), len(ends)))
        lo, hi = (np.searchsorted(ends, e) for e in self.loud)
        np.add.at(near, (lo, hi), 1.0)
        np.add.at(near, (hi, lo), 1.0)
        order = np.argsort(self.quiet[0], kind="stable")
        lo, hi = self.quiet[0][order], np.searchsorted(ends, self.quiet[1][order])
        for i in range(0, len(self.deg), 4096):
            at = slice(*np.searchsorted(lo, (i, i + 4096)))
            if at.start < at.stop:
                rows, r = np.unique(lo[at], return_inverse=True)
                m = np.zeros((len(rows), len(ends)))
                np.add.at(m, (r, hi[at]), 1.0)
                far += m.T @ (m / self.deg[rows])
        u, v = np.nonzero(near + far)
        genes, deg = self.genes.take(pa.array(ends)), self.deg[ends[u], 0]
        return pa.table([genes.take(pa.array(u)), genes.take(pa.array(v)), pa.array(near[u, v] / deg), pa.array(far[u, v] / deg)], ["u", "v", "near", "far"])


def _blocks(edges: DataFrame, columns: int) -> tuple[DataFrame, DataFrame, int]:
    """The graph as blocks (block, at, gene, deg, busy, near), the degrees, and how many blocks there are.

    An edge lies in the block of its end of lower degree, so even the neighbours that a hub brings there are at most the
    root of twice the edges. Nodes that are the lower end of all their edges are quiet: no two of them are linked.
    """
    e = checkpointed(edges.select("u", "v"))
    degree = checkpointed(e.select(F.explode(F.array("u", "v")).alias("gene")).groupBy("gene").agg(F.count("*").alias("deg")))
    size = degree.agg(F.count("*").alias("n"), (F.coalesce(F.sum("deg"), F.lit(0)) / 2).alias("e")).first()
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = math.ceil(max(size["e"] / BLOCK_EDGES, size["n"] * columns / BLOCK_CELLS, min(parts, size["e"] / 8192), 1))
    end = lambda c: degree.select(F.col("gene").alias(c), F.struct("deg", F.col("gene")).alias(f"{c}s"))
    e = e.join(end("u"), "u").join(end("v"), "v").select(F.least("us", "vs").alias("low"), F.greatest("us", "vs").alias("high"))
    e = checkpointed(e.groupBy(F.col("low.gene").alias("gene")).agg(F.first("low.deg").alias("deg"), F.collect_list("high").alias("near")))
    busy = e.select(F.explode("near.gene").alias("gene")).distinct().withColumn("busy", F.lit(True))
    e = e.join(busy, "gene", "left").na.fill(False, ["busy"]).withColumn("block", F.pmod(F.xxhash64("gene"), F.lit(n)).cast("int"))

    def number(t: pa.Table) -> pa.Table:
        own, near = len(t), t["near"].combine_chunks()
        ends = near.flatten()
        coded = pa.concat_arrays([t["gene"].combine_chunks(), ends.field("gene")]).dictionary_encode()  # the block's own come first
        at, k = coded.indices.to_numpy(), len(coded.dictionary)
        deg = np.empty(k, np.int64)
        deg[at] = np.concatenate((t["deg"].to_numpy(), ends.field("deg").to_numpy()))
        flags = np.concatenate((t["busy"].to_numpy(), np.ones(k - own, bool)))
        offsets = np.concatenate(([0], np.cumsum(pc.list_value_length(near).to_numpy()), np.full(k - own, len(ends)))).astype(np.int32)
        names = ["block", "at", "gene", "deg", "busy", "near"]
        return pa.table([pa.array(np.full(k, t["block"][0].as_py(), np.int32)), pa.array(np.arange(k, dtype=np.int32)), coded.dictionary, pa.array(deg), pa.array(flags), pa.ListArray.from_arrays(offsets, at[own:].astype(np.int32))], names)

    e = e.groupBy("block").applyInArrow(number, "block int, at int, gene string, deg long, busy boolean, near array<int>")
    return bucketed(e, "block"), degree, n


def _orders(c: np.ndarray, tol: float, max_iter: int) -> list[tuple[np.ndarray, np.ndarray | float]] | None:
    """(omega, kappa) of each Chebyshev step of (1 - M) x = b, whose eigenvalues lie within c of 1, until the error is below
    tol; None if plain steps would not get there within max_iter, since their last iterate is asked for then."""
    worst = float(c.max(initial=0.0))
    if worst > 0 and max_iter < math.log(tol) / math.log(worst):
        return None
    q = worst / (1 + math.sqrt(1 - worst**2))
    steps = 1 + math.ceil(math.log(tol * (1 - worst) / (2 * (1 + worst))) / math.log(q)) if q > 0 else 1
    omega, out = np.ones_like(c), []
    for i in range(steps):
        out.append((omega, 1 - omega))
        omega = 1 / (1 - c**2 / 2) if i == 0 else 1 / (1 - c**2 * omega / 4)
    return out


def _core_walk(blocks: DataFrame, state: DataFrame, c: np.ndarray, steps: list, lagged: bool) -> DataFrame:
    """All steps of `packed_walk` at once, for at most CORE_NODES busy nodes: their links are summed over the blocks to a
    matrix, which meets CORE_PLACES numbers of each of their vectors (gene, b, x, old) in a task."""
    width = len(c)
    links = blocks.groupBy("block").applyInArrow(lambda t: _Block(t).links(), "u string, v string, near double, far double")
    links = checkpointed(links.groupBy("u", "v").agg(F.sum("near").alias("near"), F.sum("far").alias("far")))
    parts = F.explode(F.sequence(F.lit(0), F.lit((width - 1) // CORE_PLACES))).alias("part")
    cut = (F.slice(F.col(f), F.col("part") * CORE_PLACES + 1, F.lit(CORE_PLACES)).alias(f) for f in ("b", "x", "old"))
    cut = state.select("*", parts).select("part", "gene", *cut)

    def run(t: pa.Table, e: pa.Table) -> pa.Table:
        genes = pa.concat_arrays([k.combine_chunks() for k in (t["gene"], e["u"], e["v"])]).dictionary_encode()
        at, size = genes.indices.to_numpy(), len(genes.dictionary)
        own, u, v = np.split(at, [len(t), len(t) + len(e)])
        near, far = np.zeros((2, size, size))
        near[u, v], far[u, v] = e["near"].to_numpy(), e["far"].to_numpy()
        first = (t["part"][0].as_py() if len(t) else 0) * CORE_PLACES
        mine = slice(first, first + CORE_PLACES)
        b, x, old = np.zeros((3, size, len(c[mine])))
        for m, name in ((b, "b"), (x, "x"), (old, "old")):
            if len(t):
                m[own] = _matrix(t[name], len(t))
        met, linked, d = np.zeros(size, bool), near + far > 0, c[mine]
        met[own] = True
        for i, (omega, kappa) in enumerate(steps):
            total = d * (near @ x)
            if i or not lagged:
                total += d**2 * (far @ (old if lagged else x))
            x, old = omega[mine] * (b + total) + (kappa[mine] if np.ndim(kappa) else kappa) * old, x
            met |= linked @ met
        return pa.table([pa.array(np.full(met.sum(), first // CORE_PLACES, np.int32)), genes.dictionary.filter(pa.array(met)), _lists(x[met]), _lists(old[met])], ["part", "gene", "x", "old"])

    every = links.select("*", parts)
    done = cut.groupBy("part").cogroup(every.groupBy("part")).applyInArrow(run, "part int, gene string, x array<double>, old array<double>")
    done = done.groupBy("gene").agg(F.sort_array(F.collect_list(F.struct("part", "x", "old"))).alias("r"))  # a row a part
    return checkpointed(done.select("gene", F.flatten("r.x").alias("x"), F.flatten("r.old").alias("old")))


def packed_walk(edges: DataFrame, seeds: DataFrame, alphas: list[float], tol: float = 1e-8, max_iter: int = 500, by_gene: bool = False) -> DataFrame:
    """(gene, vec) of every node reached by f <- alpha s + (1 - alpha) D^-1 A f, from seeds (gene, vec) of one row a gene, with an
    alpha for each place of vec.

    Quiet nodes (see `_blocks`) are eliminated: f of a quiet node follows from its busy neighbours, so a step sends the
    vectors of busy nodes to the blocks that link to them, and back sums of what they get from there. If max_iter plain steps
    reach tol, what they tend to is found to within tol by Chebyshev steps, else the iterate after max_iter steps is returned.
    Where few nodes are busy, their links are a small matrix and all steps are made in one pass (`_core_walk`).
    The rows are bucketed by gene if asked for.
    """
    alpha = np.array(alphas, float)
    c, width = 1 - alpha, len(alpha)
    blocks, degree, n = _blocks(edges, width)
    seats = blocks.select("gene", "block", "at", "busy")
    slot = F.pmod(F.xxhash64("gene"), F.lit(n)).cast("int").alias("slot")
    seeds = checkpointed(seeds.select("gene", "vec"))
    at_home = seeds.join(seats.where("not busy"), "gene").select(F.col("block").alias("to"), F.col("at").alias("place"), "vec")
    vectors = "gene string, vec array<double>"
    none = pa.table([pa.array([], pa.string()), pa.array([], pa.list_(pa.float64()))], ["gene", "vec"])

    def over_blocks(rows: DataFrame, f) -> DataFrame:
        run = lambda t, v: f(_Block(t, v)) if len(t) and len(v) else none
        return blocks.groupBy("block").cogroup(rows.groupBy("to")).applyInArrow(run, vectors)

    def shares(b: _Block) -> pa.Table:
        """What busy nodes get from their quiet neighbours' seeds."""
        up = _sums(b.quiet[1], b.quiet[0], b.x, len(b.x))
        return b.rows(up[:, :-1] / b.deg, up[:, -1] > 0)

    def step(b: _Block) -> pa.Table:
        """c P a from busy nodes to busy ones, and c^2 P P b by way of quiet ones; a vector without b has a for it."""
        two = b.x.shape[1] > width + 1
        first, second = b.x[:, [*range(width), -1]] if two else b.x, b.x[:, width:] if two else b.x
        (lo, hi), size = b.quiet, len(b.x)
        mid = _sums(lo, hi, second, size) / b.deg
        out = _sums(hi, lo, mid, size) * [*c**2, 1.0]
        lo, hi = b.loud
        out += (_sums(lo, hi, first, size) + _sums(hi, lo, first, size)) * [*c, 1.0]
        return b.rows(out[:, :-1] / b.deg, out[:, -1] > 0)

    def ends(b: _Block) -> pa.Table:
        got = _sums(*b.quiet, b.x, len(b.x)) / b.deg
        return b.rows(alpha * b.x[:, :-1] + c * got[:, :-1], b.is_quiet & (b.x[:, -1] + got[:, -1] > 0))

    def combined(names: list[str], f):
        """Sums of the parts of each node, met by its row of the other side; absent ones are 0."""

        def run(parts: pa.Table, state: pa.Table) -> pa.Table:
            coded = pa.concat_arrays([t["gene"].combine_chunks().cast(pa.string()) for t in (parts, state)]).dictionary_encode()
            at, size = coded.indices.to_numpy(), len(coded.dictionary)
            total = _sums(at[: len(parts)], np.arange(len(parts)), _matrix(parts["vec"], len(parts)), size) if len(parts) else np.zeros((size, width))
            have = []
            for name in names:
                m = np.zeros((size, width))
                if len(state):
                    m[at[len(parts) :]] = _matrix(state[name], len(state))
                have.append(m)
            return pa.table([coded.dictionary, *map(_lists, f(total, *have))], ["gene", "b", "x", "old"])

        return lambda parts, state: checkpointed(parts.select(slot, "*").groupBy("slot").cogroup(state.select(slot, "*").groupBy("slot")).applyInArrow(run, "gene string, b array<double>, x array<double>, old array<double>"))

    orders = _orders(c, tol, max_iter)

    def begun(total: np.ndarray, s: np.ndarray) -> tuple:
        b = alpha * (s + c * total)
        return (b, b, b) if orders else (b, s, c**2 * total)

    own = seeds.join(seats.where("busy").select("gene").distinct(), "gene", "left_semi")
    state = combined(["vec"], begun)(over_blocks(at_home, shares), own)
    one = np.ones(width)
    steps = orders or [(one, one), *[(one, 0.0)] * (max_iter - 1)]
    if seats.where("busy").select("gene").distinct().limit(CORE_NODES + 1).count() <= CORE_NODES:
        state, steps = _core_walk(blocks, state, c, steps, not orders), []
    for i, (omega, kappa) in enumerate(steps):
        second = [] if orders else ["old"] if i else [F.transform("x", lambda v: F.lit(0.0))]
        sent = state.join(seats.where("busy"), "gene").select(F.col("block").alias("to"), F.col("at").alias("place"), F.concat("x", *second).alias("vec"))
        state = combined(["b", "x", "old"], lambda total, b, x, old, omega=omega, kappa=kappa: (b, omega * (b + total) + kappa * old, x))(over_blocks(sent, step), state)
    last = state.join(seats.where("busy"), "gene").select(F.col("block").alias("to"), F.col("at").alias("place"), F.col("x" if orders else "old").alias("vec"))
    apart = seeds.join(degree, "gene", "left_anti").select("gene", F.zip_with("vec", F.lit(alpha.tolist()), lambda s, a: s * a).alias("vec"))
    every = over_blocks(at_home.unionByName(last), ends).unionByName(state.select("gene", F.col("x").alias("vec"))).unionByName(apart)
    return bucketed(every, "gene") if by_gene else checkpointed(every)
