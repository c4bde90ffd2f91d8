"""Quality rules under weak supervision.

Each rule votes that a text is good, that it is bad, or abstains. Votes are
counted by pattern over all documents (there are at most ``3 ** rules`` patterns,
whatever the corpus holds), and expectation-maximisation on those counts gives
every rule's behaviour without any label. A text's posterior probability of being
good then decides, so one failed rule among many passed ones need not reject.

Junk comes in kinds, and a kind trips its own rules: with one class of bad texts
the rules that pass it would outvote the one that sees it. So the latent classes
are kinds of texts; each has its own odds of every vote, and rules are
independent within a kind. The number of kinds isn't set: starting from one, a
kind is added at the pattern that the others explain worst (three such starts, the
likeliest wins) as long as the Bayesian information criterion gains. Rules are
better than a coin, so a kind on which some rule's commonest vote is "bad" is junk.

Defined results: a null, empty or blank text has no words, abstains throughout
and fails the base rules; a posterior of exactly the threshold keeps; null and
repeated ids, and repeated rows, are judged each alike by their text; very long
texts count whole; other columns, whatever their names, are not read; an empty
table stays empty. With a few hundred documents the criterion may find no junk
kind yet; then all that pass the base rules are kept.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from filmweave.llm.common import documents
from filmweave.llm.textstats import with_stats

GOOD, BAD, ABSTAIN = 1, 0, 2

#: (name, measure, bad at or beyond, good within); measures in SQL over the counts, larger is worse.
RULES: tuple[tuple[str, str, float, float], ...] = (
    ("symbols", "n_symbols / greatest(n_words, 1)", 0.15, 0.02),
    ("repeats", "n_repeat_words / greatest(n_words, 1)", 0.40, 0.10),
    ("duplicate lines", "n_dup_lines / greatest(n_lines, 1)", 0.40, 0.05),
    ("capitals", "n_upper / greatest(n_upper + n_lower, 1)", 0.40, 0.15),
    ("shouting", "n_marks / greatest(n_words, 1)", 0.30, 0.05),
    ("word length", "abs(word_chars / greatest(n_words, 1) - 5.5)", 4.5, 2.0),
    ("top word", "top_word / greatest(n_words, 1)", 0.30, 0.12),
    ("digits", "n_digits / greatest(word_chars, 1)", 0.25, 0.05),
    ("single characters", "n_single / greatest(n_words, 1)", 0.30, 0.10),
)


def votes(stats: DataFrame) -> DataFrame:
    """Add ``votes``: one digit per rule (1 good, 0 bad, 2 abstains); a text without words abstains throughout."""
    digits = [f"case when n_words = 0 then '2' when {m} >= {bad} then '0' when {m} <= {good} then '1' else '2' end" for _, m, bad, good in RULES]
    return stats.withColumn("votes", F.expr(f"concat({', '.join(digits)})"))


#: Kinds at most, pseudo-counts of a vote in a kind, rounds of a climb, starts of a new kind.
KINDS, COUNT, ROUNDS, STARTS = 16, 0.5, 300, 3


def _outcomes(v: np.ndarray) -> np.ndarray:
    return (v[:, :, None] == np.arange(3)).reshape(len(v), -1).astype(float)


@dataclass
class Kinds:
    """``table[kind, rule, vote]`` and each kind's ``share`` of the texts, with the log likelihood of what they were fitted on."""

    table: np.ndarray
    share: np.ndarray
    likelihood: float = 0.0

    @property
    def junk(self) -> np.ndarray:
        return (self.table.argmax(2) == BAD).any(1)

    @property
    def good_share(self) -> float:
        return float(self.share[~self.junk].sum())

    def behaviour(self, junk: bool) -> np.ndarray:
        """[rule, vote]: odds of the votes on all junk texts, or on all good ones."""
        of = self.junk == junk
        return (self.share[of, None, None] * self.table[of]).sum(0) / max(self.share[of].sum(), 1e-300)

    def explain(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability of each kind, log probability) of vote rows."""
        joint = _outcomes(v) @ np.log(self.table).reshape(len(self.share), -1).T + np.log(self.share)
        total = np.logaddexp.reduce(joint, axis=1)
        return np.exp(joint - total[:, None]), total

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Probability of good for vote rows."""
        return self.explain(v)[0][:, ~self.junk].sum(1)


def climb(v: np.ndarray, weight: np.ndarray, kind: np.ndarray) -> Kinds:
    """Expectation-maximisation from the odds ``kind[pattern, kind]``."""
    x, last, found = _outcomes(v), -np.inf, None
    for _ in range(ROUNDS):
        mass = weight[:, None] * kind
        seen = (mass.T @ x).reshape(kind.shape[1], v.shape[1], 3) + COUNT
        found = Kinds(seen / seen.sum(2, keepdims=True), (mass.sum(0) + 1) / (weight.sum() + kind.shape[1]))
        kind, each = found.explain(v)
        found.likelihood = float(weight @ each)
        if found.likelihood - last < 1e-8 * abs(last):
            break
        last = found.likelihood
    return found


def fit(patterns: dict[str, int]) -> Kinds | None:
    """Kinds of texts from counted vote patterns; None without any text."""
    if not patterns:
        return None
    keys = sorted(patterns)
    v = np.array([[int(c) for c in p] for p in keys], dtype=int).reshape(len(keys), -1)
    weight = np.array([patterns[p] for p in keys], dtype=float)
    price = 0.5 * np.log(weight.sum()) * (2 * v.shape[1] + 1)
    best = climb(v, weight, np.ones((len(v), 1)))
    while len(best.share) < KINDS:
        kind, each = best.explain(v)
        tried = []
        for at in np.argsort(-weight * (np.log(weight / weight.sum()) - each), kind="stable")[:STARTS]:
            near = 0.9 * np.exp(-2.0 * (v != v[at]).sum(1))[:, None]
            tried.append(climb(v, weight, np.concatenate([kind * (1 - near), near], 1)))
        more = max(tried, key=lambda k: k.likelihood)
        if more.likelihood - best.likelihood <= price:
            break
        best = more
    return best


def judge(docs: DataFrame, threshold: float = 0.5, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Counts, votes, posterior, base_failed and kept for every row of ``docs``, beside the columns to ``carry``.

    What is carried lies beside the counts, so a verdict needs no join to meet its row.
    """
    stats = votes(with_stats(docs, carry))
    patterns = {r["votes"]: r["count"] for r in stats.groupBy("votes").count().orderBy("votes").collect()}
    kinds, keys = fit(patterns), list(patterns)
    good = kinds.posterior(np.array([[int(c) for c in p] for p in keys], dtype=int)) if kinds else []
    known = F.broadcast(docs.sparkSession.createDataFrame(list(zip(keys, map(float, good), strict=True)) or [("", 0.5)], "votes string, posterior double"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.join(known, "votes").withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("posterior") >= threshold))


def op5_weak_rules(spark, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior", "votes"
    )
