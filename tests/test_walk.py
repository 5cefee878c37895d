"""Walks over blocks (F4, F5, F18, F21 of round 3): one vector a node, quiet nodes stay, the same iterates and limits as on whole arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociforge.operators import graph, walk


def _network(n=40, seed=4):
    """A few hubs, a path, a repeated edge and a loop; genes, edges and D^-1 A."""
    r = np.random.default_rng(seed)
    pairs = [(i, int(h)) for i in range(3, n - 4) for h in r.choice(3, 2, replace=False)] + [(n - 4, n - 3), (n - 3, n - 2), (n - 2, n - 4), (0, 1), (0, 1), (n - 2, n - 2), (5, 6)]
    a = np.zeros((n, n))
    for u, v in pairs:
        a[u, v] += 1
        a[v, u] += 1
    return [f"G{i:02}" for i in range(n)], [(f"G{u:02}", f"G{v:02}") for u, v in pairs], a / np.maximum(a.sum(1, keepdims=True), 1)


@pytest.mark.parametrize("steps", [1, 2, 5, 500])
def test_packed_walk_as_whole_arrays(spark, monkeypatch, steps):
    monkeypatch.setattr(walk, "BLOCK_EDGES", 20)
    genes, pairs, p = _network()
    seen = []
    monkeypatch.setattr(graph, "packed_walk", lambda e, s, *a: seen.append(s.count()) or walk.packed_walk(e, s, *a))
    seeds = [(k, g, float((i * 7 + k) % 5 - 2), 1.0) for k in range(2) for i, g in enumerate(genes) if i % 3 == k or i == 7]
    got = graph.rwr(spark.createDataFrame(pairs, "u string, v string"), spark.createDataFrame(seeds, "k int, gene string, s double, m double"), [0.2, 0.6], ["s", "m"], ["k"], tol=1e-10, max_iter=steps).collect()
    assert seen == [len({x[1] for x in seeds})]  # a row a gene, whatever folds and alphas
    at = {(x["k"], x["alpha"], x["gene"]): (x["s"], x["m"]) for x in got}
    assert len(at) == len(got)
    for k in range(2):
        s = np.zeros((len(genes), 2))
        for key, g, *v in seeds:
            if key == k:
                s[genes.index(g)] += v
        for alpha in (0.2, 0.6):
            f = s
            for _ in range(steps):
                f = alpha * s + (1 - alpha) * p @ f
            assert all(np.allclose(at.pop((k, alpha, g), (0.0, 0.0)), v, atol=1e-8) for g, v in zip(genes, f, strict=True))
    assert not at


def test_quiet_nodes_are_not_linked(spark):
    _, pairs, _ = _network()
    blocks, degree, n = walk._blocks(spark.createDataFrame(pairs, "u string, v string"), 1)
    quiet = {x["gene"] for x in blocks.where("not busy").collect()}
    assert len(quiet) > 25 and not any(u in quiet and v in quiet for u, v in pairs) and blocks.where("not busy").count() == len(quiet)
    assert blocks.select(F.sum(F.size("near"))).first()[0] == len(pairs)


@pytest.mark.parametrize(("steps", "places"), [(1, 256), (4, 2), (500, 2)])
def test_few_busy_nodes_walk_in_one_pass(spark, monkeypatch, steps, places):
    """their steps are no Spark jobs, and give the rows of steps that are."""
    monkeypatch.setattr(walk, "BLOCK_EDGES", 20)
    monkeypatch.setattr(walk, "CORE_PLACES", places)
    genes, pairs, _ = _network()
    edges = spark.createDataFrame(pairs, "u string, v string")
    seeds = spark.createDataFrame([(g, [float(i % 5 - 2), float(i % 3), 1.0]) for i, g in enumerate(genes) if i % 4 == 1], "gene string, vec array<double>")
    written, plain = [], walk.checkpointed
    monkeypatch.setattr(walk, "checkpointed", lambda df: written.append(1) or plain(df))
    rows = lambda: {x["gene"]: x["vec"] for x in walk.packed_walk(edges, seeds, [0.1, 0.3, 0.3], max_iter=steps).collect()}
    few = rows()
    assert len(written) < 10
    monkeypatch.setattr(walk, "CORE_NODES", 0)
    if steps > 5:  # plain arrays have those
        return
    many = rows()
    assert few.keys() == many.keys() and all(np.allclose(few[g], many[g], atol=1e-12) for g in few)
