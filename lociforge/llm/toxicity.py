"""Toxicity by a classifier chain: linear models for the categories in turn, each also fed the earlier probabilities.

Features are the words of a text and the first four and five bytes of its words, A-Z lower-cased, present or not. The
features that tell a category apart are chosen by Spark over the training rows; a logistic model per category is then
fitted on them. Later models learn from earlier probabilities made out of fold, as a text will see them at scoring time:
neither the choice of features nor the weights behind them have seen the text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bounded, texts_of, written

#: Categories of the labels table, in chain order: name and condition.
CATEGORIES = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"), ("toxic_low_quality", "toxic = 1 and quality = 0"))
#: Labelled rows that training reads at most; all of them where there are fewer.
MAX_TRAIN_ROWS = 12_000
#: Features chosen for each category.
FEATURES_PER_CATEGORY = 400
STRIP = b".,;:!?()[]\"'|#*$%&<>"


def features(text: bytes) -> set[bytes]:
    """Kinds are told apart by their first byte: w a word without punctuation at its ends, 4 and 5 the word starts."""
    ws = {w.strip(STRIP) for w in set(text.lower().split())}
    return {b"w" + w for w in ws} | {b"4" + w[:4] for w in ws} | {b"5" + w[:5] for w in ws}


def training_rows(docs: DataFrame, labels: DataFrame, categories, max_rows: int) -> DataFrame:
    """(text, y0, y1, ...) of at most `max_rows` labelled documents, those with the least hash of their id (rows that repeat
    an id count too; beyond the bound each id keeps its largest text)."""
    ys = [F.expr(f"cast({cond} as int)").alias(f"y{i}") for i, (_, cond) in enumerate(categories)]
    chosen = labels.select(F.col("doc_id").alias("__id"), *ys).where("__id is not null and " + " and ".join(f"y{i} is not null" for i in range(len(ys))))
    chosen = chosen.dropDuplicates(["__id"]).orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    rows = docs.select(F.col("doc_id").alias("__id"), "text")
    return bounded(rows.join(F.broadcast(chosen), "__id").select("__id", "text", *(f"y{i}" for i in range(len(ys)))), "__id", "text", max_rows)  # the broadcast too is bounded by max_rows


def feature_counts(rows: DataFrame, n_categories: int, folds: int) -> DataFrame:
    """(fold, feature, n, n0, n1, ...): rows of the fold that have the feature, and those of each category; summed per task
    first. The empty feature counts all rows."""
    names = ["n", *(f"n{i}" for i in range(n_categories))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [[Counter() for _ in names] for _ in range(folds)]
        for batch in batches:
            ys = list(zip(*(batch.column(f"y{i}").to_pylist() for i in range(n_categories)), strict=True))
            for i, text, y in zip(batch.column("__id").to_pylist(), texts_of(batch, "text"), ys, strict=True):
                found, mine = features(text) | {b""}, seen[hash_fold(i, folds)]
                mine[0].update(found)
                for c, on in zip(mine[1:], y, strict=True):
                    if on:
                        c.update(found)
        for fold, mine in enumerate(seen):
            kinds = list(mine[0])
            cols = [pa.array([fold] * len(kinds), pa.int32()), pa.array(kinds, pa.binary()), *(pa.array([c[k] for k in kinds], pa.int64()) for c in mine)]
            yield pa.RecordBatch.from_arrays(cols, ["fold", "feature", *names])

    made = arrow_map(rows, run, "fold int, feature binary, " + ", ".join(f"{x} long" for x in names))
    return written(made.groupBy("fold", "feature").agg(*(F.sum(x).alias(x) for x in names)), "features")


def chosen_without(counts: DataFrame, fold: int | None, n_categories: int, per_category: int) -> list[bytes]:
    """`choose_features` over all folds but one."""
    names = ["n", *(f"n{i}" for i in range(n_categories))]
    rest = (counts if fold is None else counts.where(F.col("fold") != fold)).groupBy("feature").agg(*(F.sum(x).alias(x) for x in names))
    totals = rest.where(F.col("feature") == F.lit(b"")).first()
    return choose_features(rest.where(F.col("feature") != F.lit(b"")), [totals[x] for x in names], per_category) if totals else []


def choose_features(counts: DataFrame, totals: list[int], per_category: int, min_rows: int = 5, least: float = 20.0) -> list[bytes]:
    """The features of the largest chi-square statistics for each category, `least` or more, which few of very many
    features without any bearing reach: at most `per_category` times the categories."""
    n = float(max(1, totals[0]))
    chosen: set[bytes] = set()
    for i, pos in enumerate(totals[1:]):
        if not 0 < pos < totals[0]:
            continue
        cross = F.col(f"n{i}") * n - F.col("n") * float(pos)
        score = n * (cross / (float(pos) * (n - pos))) * (cross / (F.col("n") * (n - F.col("n") + 0.5)))
        top = counts.where(f"n >= {min_rows}").withColumn("score", score).where(f"score >= {least}").orderBy(F.desc("score"), "feature").limit(per_category)
        chosen |= {bytes(x["feature"]) for x in top.select("feature").collect()}
    return sorted(chosen)


class Logistic:
    """Ridge logistic regression on rows of few present features plus dense columns, by Nesterov steps scaled by column."""

    def __init__(self, n_sparse: int, n_dense: int, ridge: float = 1e-3, steps: int = 300):
        self.w, self.v, self.b, self.ridge, self.steps = np.zeros(n_sparse), np.zeros(n_dense), 0.0, ridge, steps

    def margin(self, row: np.ndarray, col: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return np.bincount(row, self.w[col], minlength=len(dense)) + dense @ self.v + self.b

    def fit(self, row: np.ndarray, col: np.ndarray, dense: np.ndarray, y: np.ndarray) -> Logistic:
        n, k = len(y), len(self.w)
        if not n:
            self.b = -20.0  # nothing was learned: nothing is rejected
            return self
        most = 1 + np.bincount(row, minlength=n).max(initial=0) + dense.shape[1]
        scale_w = 1 / (most * 0.25 * (np.bincount(col, minlength=k) / n) + self.ridge)
        scale_v = 1 / (most * 0.25 * (dense**2).mean(0) + self.ridge)
        prior = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.b = float(np.log(prior / (1 - prior)))
        old = theta = np.concatenate((self.w, self.v, [self.b]))
        scale = np.concatenate((scale_w, scale_v, [4 / most]))
        for t in range(self.steps):
            look = theta + t / (t + 3) * (theta - old)
            self.w, self.v, self.b = look[:k], look[k:-1], look[-1]
            err = (probability(self.margin(row, col, dense)) - y) / n
            slope = np.concatenate((np.bincount(col, err[row], minlength=k), dense.T @ err, [err.sum()]))
            slope[:-1] += self.ridge * look[:-1] / n
            old, theta = theta, look - scale * slope
        self.w, self.v, self.b = theta[:k], theta[k:-1], float(theta[-1])
        return self


def probability(margin):
    return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


@dataclass
class Chain:
    names: list[str]
    words: dict[bytes, int]
    models: list[Logistic]

    def score(self, text: bytes) -> list[float]:
        """Probabilities of the categories in chain order."""
        col = [self.words[f] for f in self.found(text)]
        out: list[float] = []
        for m in self.models:
            out.append(float(probability(m.w[col].sum() + np.dot(m.v, out) + m.b)))
        return out

    def found(self, text: bytes) -> set[bytes]:
        return features(text).intersection(self.words)


def fit_chain(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, max_rows: int = MAX_TRAIN_ROWS, per_category: int = FEATURES_PER_CATEGORY, folds: int = 3) -> Chain:
    """Fits the chain on at most `max_rows` labelled documents; what comes to the driver is bounded by that and the chosen features."""
    rows = training_rows(docs, labels, categories, max_rows).cache()
    n_cat = len(categories)
    counts = feature_counts(rows, n_cat, folds)
    # What a fold's model may read is chosen without the fold, like all that it learns.
    chosen = [set(chosen_without(counts, f, n_cat, per_category)) for f in (*range(folds), None)]
    words = sorted(set().union(*chosen))
    index = {w: i for i, w in enumerate(words)}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [sorted(index[f] for f in features(t).intersection(index)) for t in texts_of(batch, "text")]
            rest = [batch.column(c) for c in ("__id", *(f"y{i}" for i in range(n_cat)))]
            yield pa.RecordBatch.from_arrays([rest[0], pa.array(cols, pa.list_(pa.int32())), *rest[1:]], ["__id", "cols", *(f"y{i}" for i in range(n_cat))])

    got = arrow_map(rows, encode, "__id long, cols array<int>, " + ", ".join(f"y{i} int" for i in range(n_cat))).collect()
    rows.unpersist()
    got.sort(key=lambda x: (x["__id"], x["cols"]))
    row = np.repeat(np.arange(len(got)), [len(x["cols"]) for x in got])
    col = np.array([c for x in got for c in x["cols"]], np.int64)
    y = np.array([[x[f"y{i}"] for i in range(n_cat)] for x in got], float).reshape(len(got), n_cat)
    fold = np.array([hash_fold(x["__id"], folds) for x in got], int)
    cells = []  # those that each fold's models read, and the final ones, with their columns
    for mine in chosen:
        own = np.cumsum([w in mine for w in words]) - 1
        go = np.array([w in mine for w in words], bool)[col] if len(words) else np.zeros(len(col), bool)
        cells.append((row[go], own[col[go]] if len(words) else col[go], len(mine)))
    oof, models = np.zeros((len(got), n_cat)), []
    for i in range(n_cat):
        dense = oof[:, :i]
        for f in range(folds):
            a, b = fold != f, fold == f
            new, (r, c, k) = np.cumsum(a) - 1, cells[f]
            part = Logistic(k, i).fit(new[r[a[r]]], c[a[r]], dense[a], y[a, i])
            oof[b, i] = probability(part.margin(r, c, dense))[b]
        r, c, k = cells[-1]
        models.append(Logistic(k, i).fit(r, c, dense, y[:, i]))
    return Chain([n for n, _ in categories], {w: i for i, w in enumerate(sorted(chosen[-1]))}, models)


def hash_fold(i: int, folds: int) -> int:
    return ((i * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 40) % folds


def score_chain(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", judged: str = "toxic", threshold: float = 0.5) -> DataFrame:
    """doc_id, p_<category> for every category, and toxic (the judged category's probability is at least the threshold).

    Null and empty texts are scored as texts without features; null ids stay null; rows with the same id are scored one
    by one; texts of any length are read whole; an empty table gives no rows; other columns are not read. Without any
    usable label all probabilities are near 0 and nothing is rejected.
    """
    at = chain.names.index(judged)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.array([chain.score(t) for t in texts_of(batch, "text")], float).reshape(batch.num_rows, len(chain.names))
            cols = [batch.column(0), *(pa.array(p[:, i]) for i in range(p.shape[1])), pa.array(p[:, at] >= threshold)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", *(f"p_{n}" for n in chain.names), "toxic"])

    schema = "doc_id long, " + ", ".join(f"p_{n} double" for n in chain.names) + ", toxic boolean"
    return arrow_map(docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text"), run, schema)


def reject_toxic(docs: DataFrame, chain: Chain, judged: str = "toxic", threshold: float = 0.5) -> DataFrame:
    """The rows of `docs`, with all their columns as they are, whose text isn't toxic by the chain. Null and empty texts have
    no features, rows that repeat are judged alike, texts are read whole, an empty table gives no rows."""
    at = chain.names.index(judged)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [chain.score(t)[at] < threshold for t in texts_of(batch, "text")]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return arrow_map(docs, run, docs.schema)
