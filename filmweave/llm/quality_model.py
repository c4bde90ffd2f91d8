"""Quality as a generalised additive model with pairwise interactions.

Features of a text are cut into bins at quantiles; cyclic boosting grows shallow
trees on one feature after another, each adding a little to that feature's
lookup table, and then on the pairs of features that explain most of what is
left. A score is a sum of table entries, looked up for all rows at once.

Training takes a bounded, repeatable sample of labelled texts (``PER_CLASS`` of
each class at most), counted on the executors; only their counts reach the
driver. Every text is scored whole.

Defined results: a null, empty or blank text has all counts 0 and gets the score
of those bins; without labels of both classes the score is the share of the one
class there is, or 0.5; repeated rows score alike; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from filmweave.llm.common import documents, fold, sample_labels, text_rows
from filmweave.llm.textstats import FIELDS, text_stats
from filmweave.session import prepare

#: Labelled texts of a class; bins of a feature and of a pair's side; rounds; pairs; step of boosting.
PER_CLASS, BINS, PAIR_BINS, ROUNDS, PAIRS, STEP = 6000, 48, 12, 150, 6, 0.15

FEATURES = ("words", "word length", "symbols", "duplicate lines", "repeats", "capitals", "digits", "marks", "distinct", "line length", "stops", "top word", "single", "duplicate characters", "letters")


def features(counts: np.ndarray) -> np.ndarray:
    """Rows of FEATURES from rows of textstats.FIELDS."""
    c = {f: counts[:, i].astype(float) for i, f in enumerate(FIELDS)}
    words, lines, chars = np.maximum(c["n_words"], 1), np.maximum(c["n_lines"], 1), np.maximum(c["word_chars"], 1)
    letters = c["n_upper"] + c["n_lower"]
    return np.stack(
        [
            np.log1p(c["n_words"]),
            c["word_chars"] / words,
            c["n_symbols"] / words,
            c["n_dup_lines"] / lines,
            c["n_repeat_words"] / words,
            c["n_upper"] / np.maximum(letters, 1),
            c["n_digits"] / chars,
            c["n_marks"] / words,
            c["n_distinct"] / words,
            words / lines,
            c["n_stops"] / words,
            c["top_word"] / words,
            c["n_single"] / words,
            c["dup_line_chars"] / chars,
            letters / chars,
        ],
        axis=1,
    )


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _stump_gain(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Best split of ordered bins: (gain, first bin of the right side)."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl * gl / (hl + 1) + gr * gr / (hr + 1)
    k = int(np.argmax(gain)) if len(gain) else -1
    return (float(gain[k]), k + 1) if k >= 0 else (0.0, 1)


def _tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Values by bin of a tree of ``depth`` levels on summed gradients and curvatures."""
    out = np.full(len(g), g.sum() / (h.sum() + 1))
    if depth and len(g) > 1:
        gain, k = _stump_gain(g, h)
        if gain > g.sum() ** 2 / (h.sum() + 1) + 1e-9:
            out[:k], out[k:] = _tree(g[:k], h[:k], depth - 1), _tree(g[k:], h[k:], depth - 1)
    return out


def _tree2(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree that splits each side of a grid once: values and gain."""
    best, found = -1.0, np.zeros_like(g)
    for axis in (0, 1):
        a, b = (g, h) if axis == 0 else (g.T, h.T)
        _, k = _stump_gain(a.sum(1), b.sum(1))
        value, total = np.zeros_like(a), 0.0
        for rows in (slice(0, k), slice(k, None)):
            gain, j = _stump_gain(a[rows].sum(0), b[rows].sum(0))
            total += gain
            for columns in (slice(0, j), slice(j, None)):
                value[rows, columns] = a[rows, columns].sum() / (b[rows, columns].sum() + 1)
        if total > best:
            best, found = total, value if axis == 0 else value.T
    return found, best


class AdditiveModel:
    """bias + sum of tables over features + sum of tables over pairs, through a logistic link."""

    def __init__(self, bias: float):
        self.bias, self.edges, self.tables, self.coarse, self.pairs = bias, [], [], [], {}

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS) -> AdditiveModel:
        if not len(y) or y.min() == y.max():
            share = float(y.mean()) if len(y) else 0.5
            return cls(float(np.log((share + 1e-3) / (1 - share + 1e-3))))
        model = cls(float(np.log(y.mean() / (1 - y.mean()))))
        model.edges = [_edges(c, BINS) for c in x.T]
        model.coarse = [_edges(c, PAIR_BINS) for c in x.T]
        model.tables = [np.zeros(len(e) + 1) for e in model.edges]
        at, grid = model._bins(x, model.edges), model._bins(x, model.coarse)
        z = np.full(len(y), model.bias)
        for _ in range(rounds):
            for f, table in enumerate(model.tables):
                p = 1 / (1 + np.exp(-z))
                step = STEP * _tree(*(np.bincount(at[f], weights=w, minlength=len(table)) for w in (y - p, p * (1 - p))), 2)
                table += step
                z += step[at[f]]

        def grids(i: int, j: int, p: np.ndarray):
            wide, high = len(model.coarse[i]) + 1, len(model.coarse[j]) + 1
            return (np.bincount(grid[i] * high + grid[j], weights=w, minlength=wide * high).reshape(wide, high) for w in (y - p, p * (1 - p)))

        p = 1 / (1 + np.exp(-z))
        gains = {(i, j): _tree2(*grids(i, j, p))[1] for i in range(x.shape[1]) for j in range(i)}
        chosen = sorted(gains, key=gains.get, reverse=True)[:pairs]
        model.pairs = {ij: np.zeros((len(model.coarse[ij[0]]) + 1, len(model.coarse[ij[1]]) + 1)) for ij in chosen}
        for _ in range(rounds // 3):
            for (i, j), table in model.pairs.items():
                p = 1 / (1 + np.exp(-z))
                step = STEP * _tree2(*grids(i, j, p))[0]
                table += step
                z += step[grid[i], grid[j]]
        return model

    @staticmethod
    def _bins(x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, c, side="right") for e, c in zip(edges, x.T, strict=True)]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        if self.tables:
            at, grid = self._bins(x, self.edges), self._bins(x, self.coarse)
            for b, table in zip(at, self.tables, strict=True):
                z += table[b]
            for (i, j), table in self.pairs.items():
                z += table[grid[i], grid[j]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def count_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, counts) with the counts of a text as one array."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([text_stats(t.as_py()) for t in b.column(1)], pa.list_(pa.int64()))], names=["doc_id", "counts"])

    return text_rows(docs.select("doc_id", "text")).mapInArrow(work, "doc_id long, counts array<long>")


def train(docs: DataFrame, picked: list[tuple[int, int]]) -> AdditiveModel:
    """Fit on the sampled labels (doc_id, y); their number is bounded, so they may be broadcast."""
    if not picked:
        return AdditiveModel.fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    ids = F.broadcast(docs.sparkSession.createDataFrame(picked, "doc_id long, y int"))
    rows = count_rows(docs.join(ids, "doc_id", "left_semi")).toArrow().sort_by("doc_id")
    y = dict(picked)
    counts = np.array(rows.column("counts").to_pylist(), dtype=float).reshape(-1, len(FIELDS))
    return AdditiveModel.fit(features(counts), np.array([y[i] for i in rows.column("doc_id").to_pylist()], dtype=float))


def score(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """(doc_id, score) of every row of ``docs``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                counts = np.array([text_stats(t.as_py()) for t in b.column(1)], dtype=float)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(features(counts)))], names=["doc_id", "score"])

    return text_rows(docs.select("doc_id", "text")).mapInArrow(work, "doc_id long, score double")


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = prepare(spark).read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, sample_labels(labels, "quality", 5, 0, PER_CLASS))
    return score(docs, model).select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
