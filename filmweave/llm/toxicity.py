"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its character n-grams (hashed into
buckets), a text the mean of its words, and two output vectors give the softmax.
Vectors and outputs are trained jointly in numpy with Adam. Words never seen in
training, misspellings among them, share the n-grams of those that were.

Since text vector and output are linear, each bucket's pull towards the toxic
class is one number once training ends; a word's pull is the mean of its buckets',
taken once per distinct word of a batch, and a text's score is the softmax of the
mean over its words.

Training takes a bounded, repeatable sample of labelled texts (``PER_CLASS`` of
each class at most). Every text is scored whole.

Defined results: a null, empty or blank text has a zero vector and scores by the
output's bias alone; without labels of both classes the score is the share of
the one class there is, or 0.5; null and repeated ids, and repeated rows, score
each by their text alone (a null id is in no fold, so never held out nor learned
from); very long texts count whole; other columns, whatever their names, are not
read; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from filmweave.llm.common import documents, fold, sample_labels, text_rows
from filmweave.llm.words import gram_hashes, in_parts, spell, words_of
from filmweave.session import prepare

#: Labelled texts of a class; hash buckets (a power of two); vector size; n-gram lengths; passes; texts in a step; learning rate.
PER_CLASS, BUCKETS, DIM, GRAMS, EPOCHS, BATCH, RATE = 2000, 1 << 18, 6, (3, 4, 5), 20, 64, 0.05
#: Training texts that a bucket must occur in, as a share and at least (rarer ones would only learn texts by heart); pull of all vectors towards 0;
#: damping of steps, so that buckets that say little move little.
RARE, RARE_LEAST, SHRINK, DAMP = 0.005, 4, 1e-3, 1e-3
#: Factor on a text's mean vector before the softmax, since a few words among hundreds carry the class.
SCALE = 30.0


def gram_means(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, word, weight) of the n-grams of words, their ends marked; a word's weights add up to 1."""
    points, sizes = spell(distinct, "<", ">")
    parts = [gram_hashes(points, sizes, n) for n in GRAMS]
    bucket = np.concatenate([h for h, _ in parts]) & np.uint64(BUCKETS - 1)
    owner = np.concatenate([o for _, o in parts])
    return bucket.astype(np.int64), owner, 1.0 / np.bincount(owner, minlength=len(sizes))[owner]


def bags(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text, buckets and their weights in its vector."""
    return [bag for part in in_parts(texts) for bag in _bags(part)]


def _bags(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    words = words_of(texts, ascii_only=False)
    bucket, owner, weight = gram_means(words.distinct)
    order = np.argsort(owner, kind="stable")
    bucket, weight, ends = bucket[order], weight[order], np.cumsum(np.bincount(owner, minlength=len(words.distinct)))
    out = []
    for a, b in zip(words.starts.tolist(), words.ends.tolist(), strict=True):
        word, n = np.unique(words.at[a:b], return_counts=True)
        sizes = np.diff(ends, prepend=0)[word] if len(word) else np.empty(0, np.int64)
        at = np.arange(sizes.sum()) + np.repeat(ends[word] - np.cumsum(sizes), sizes)
        one, where = np.unique(bucket[at], return_inverse=True)
        out.append((one.astype(np.int32), np.bincount(where, weights=weight[at] * np.repeat(n, sizes) / max(b - a, 1), minlength=len(one)).astype(np.float32)))
    return out


class SubwordModel:
    """``pull``: each bucket's contribution to the log odds; ``bias``."""

    def __init__(self, pull: np.ndarray, bias: float):
        self.pull, self.bias = pull, bias

    @classmethod
    def fit(cls, bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> SubwordModel:
        if not len(y) or y.min() == y.max():
            share = float(y.mean()) if len(y) else 0.5
            return cls(np.zeros(BUCKETS, np.float32), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
        rng = np.random.default_rng(seed)
        seen = np.bincount(np.concatenate([i for i, _ in bags]), minlength=BUCKETS)
        used = np.flatnonzero(seen >= max(RARE_LEAST, RARE * len(y)))
        row = np.full(BUCKETS, -1)
        row[used] = np.arange(len(used))
        kept = [(row[i][row[i] >= 0], w[row[i] >= 0] * SCALE) for i, w in bags]
        vectors = (rng.normal(size=(len(used), DIM)) * 0.05).astype(np.float32)
        out = (rng.normal(size=(2, DIM)) * 0.5).astype(np.float32)
        bias = np.log(np.array([1 - y.mean(), y.mean()], dtype=np.float32))
        params = (vectors, out, bias)
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), BATCH):
                texts = order[at : at + BATCH]
                ids = np.concatenate([kept[r][0] for r in texts])
                weights = np.concatenate([kept[r][1] for r in texts])
                owner = np.repeat(np.arange(len(texts)), [len(kept[r][0]) for r in texts])
                parts = vectors[ids] * weights[:, None]
                text = np.stack([np.bincount(owner, weights=parts[:, d], minlength=len(texts)) for d in range(DIM)], 1).astype(np.float32)
                logits = text @ out.T + bias
                p = np.exp(logits - logits.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(texts)), y[texts].astype(int)] -= 1
                error = p / len(texts)
                flow = (error @ out)[owner] * weights[:, None]
                grad = np.stack([np.bincount(ids, weights=flow[:, d], minlength=len(used)) for d in range(DIM)], 1).astype(np.float32)
                t += 1
                vectors *= 1 - SHRINK
                for param, (m, v), g in zip(params, moments, (grad, error.T @ text, error.sum(0)), strict=True):
                    m *= 0.9
                    m += 0.1 * g
                    v *= 0.999
                    v += 0.001 * g * g
                    param -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + DAMP)
        pull = np.zeros(BUCKETS, np.float32)
        pull[used] = SCALE * (vectors @ (out[1] - out[0]))
        return cls(pull, float(bias[1] - bias[0]))

    def pulls(self, distinct: pa.Array) -> np.ndarray:
        """Pull of every word: the mean of its n-grams'."""
        bucket, owner, weight = gram_means(distinct)
        return np.bincount(owner, weights=self.pull[bucket] * weight, minlength=len(distinct))

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probability of the toxic class for every text."""
        means = [np.zeros(0)]
        for part in in_parts(texts):
            words = words_of(part, ascii_only=False)
            means.append(words.sums(self.pulls(words.distinct)) / np.maximum(words.sizes, 1))
        return 1 / (1 + np.exp(-np.clip(self.bias + np.concatenate(means), -30, 30)))


def train(docs: DataFrame, picked: list[tuple[int, int]], share: float | None = None) -> SubwordModel:
    """Fit on the sampled labels (doc_id, y); bags are made on the executors, their number is bounded.

    ``share``: of class 1 among all usable labels; scores are moved from the sample's odds to these.
    """
    if not picked:
        return SubwordModel.fit([], np.zeros(0))
    ids = F.broadcast(docs.sparkSession.createDataFrame(picked, "doc_id long, y int"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = bags(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x, _ in found], pa.binary()), pa.array([w.tobytes() for _, w in found], pa.binary())], names=["doc_id", "ids", "weights"])

    rows = text_rows(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")).mapInArrow(work, "doc_id long, ids binary, weights binary").toArrow().sort_by("doc_id")
    held = [(np.frombuffer(i.as_py(), np.int32), np.frombuffer(w.as_py(), np.float32)) for i, w in zip(rows.column("ids"), rows.column("weights"), strict=True)]
    y = dict(picked)
    truth = np.array([y[i] for i in rows.column("doc_id").to_pylist()])
    model = SubwordModel.fit(held, truth)
    if share and 0 < share < 1 and 0 < truth.mean() < 1:
        model.bias += float(np.log(share / (1 - share)) - np.log(truth.mean() / (1 - truth.mean())))
    return model


def score(docs: DataFrame, model: SubwordModel) -> DataFrame:
    """(doc_id, score) of every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value.score(b.column(1)))], names=["doc_id", "score"])

    return text_rows(docs.select("doc_id", "text")).mapInArrow(work, "doc_id long, score double")


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = prepare(spark).read.parquet(f"{sf_dir}/labels.parquet")
    share = labels.where((fold("doc_id", 4) != 2) & F.col("toxic").isin(0, 1)).agg(F.avg("toxic")).first()[0]
    model = train(docs, sample_labels(labels, "toxic", 4, 2, PER_CLASS), share)
    return score(docs, model).select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
