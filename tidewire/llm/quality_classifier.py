"""Quality classifier by Bradley-Terry pairwise ranking.

A preference pair is a document labelled good and one labelled bad. Under Bradley and Terry's model the good one is
preferred with probability ``sigmoid(w . (x_good - x_bad))``; the weights minimise the logistic loss on these feature
differences with a ridge term, by Newton's method. ``w . x`` is a document's score. The threshold is a quantile of the
training scores: the one that separates the classes best, each class weighing alike, in the middle of where it does so.
Scores are mapped to 0..1 so that the threshold comes to ``CUT``.

The model is fitted on a bounded sample of labelled rows (``TRAIN_ROWS`` a class, those of the least id hashes), with
``PAIRS_A_ROW`` pairs for each document of the larger class. It is a dozen weights; scoring all documents is one
projection without a shuffle.

Defined cases: null and empty texts are scored by zero statistics; documents without a label are scored alike; without
labels of both classes every score is ``CUT``; several labels of a document count as good if one is; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import lines, words
from tidewire.llm.text_stats import SYMBOLS, count_chars, windows

#: Labelled rows of each class that the model is fitted on at most.
TRAIN_ROWS = 5000
#: Opponents of a document in the preference pairs.
PAIRS_A_ROW = 8
#: Score at and above which a document is predicted good.
CUT = 0.7


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with features, an array of doubles, of its whole texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumns({"_words": words(F.col(text_col)), "_lines": lines(F.col(text_col))})
    n, n_lines, chars = F.greatest(F.size("_words"), F.lit(1)), F.size("_lines"), F.greatest(F.length(text), F.lit(1))
    grams = F.greatest(F.size("_words") - 2, F.lit(1))
    shares = {
        "_log_words": F.log(n.cast("double")),
        "_word_length": F.length(F.array_join("_words", "")) / n,
        "_symbols": F.log1p(count_chars(text, SYMBOLS) / n),
        "_marks": F.log1p(count_chars(text, "[!?]") / n),
        "_lines_again": 1 - F.size(F.array_distinct("_lines")) / n_lines,
        "_words_again": 1 - F.greatest(F.size(F.array_distinct("_words")), F.lit(1)) / n,
        "_windows_again": 1 - F.greatest(F.size(F.array_distinct(windows(F.col("_words"), 3))), F.lit(1)) / grams,
        "_words_a_line": F.log(n / n_lines),
        "_capitals": count_chars(text, r"\p{Lu}") / chars,
        "_digits": count_chars(text, "[0-9]") / chars,
    }
    out = out.withColumns(shares)
    return out.withColumn("features", F.array(*(F.col(c).cast("double") for c in shares))).drop(*shares, "_words", "_lines")


@dataclass(frozen=True)
class Ranking:
    """Weights of the standardised features, and the line that maps scores to the logit of 0..1."""

    mean: tuple[float, ...]
    spread: tuple[float, ...]
    weights: tuple[float, ...]
    threshold: float
    slope: float

    def score(self, x: Column) -> Column:
        """0 to 1, ``CUT`` at the threshold."""
        total = F.lit(-self.threshold)
        for k, w in enumerate(self.weights):
            total = total + (F.get(x, F.lit(k)) - self.mean[k]) * (w / self.spread[k])
        logit = F.least(F.lit(30.0), F.greatest(F.lit(-30.0), total * self.slope)) + float(np.log(CUT / (1 - CUT)))
        return F.round(1 / (1 + F.exp(-logit)), 12)


def pairs(n_good: int, n_bad: int, each: int = PAIRS_A_ROW) -> tuple[np.ndarray, np.ndarray]:
    """Indices of preference pairs: every document of the larger class with ``each`` opponents, dealt evenly."""
    n = max(n_good, n_bad)
    i = np.tile(np.arange(n), each)
    k = np.repeat(np.arange(each), n)
    other = (i + 1 + k * max(1, min(n_good, n_bad) // each) + i // max(1, min(n_good, n_bad))) % max(1, min(n_good, n_bad))
    return (i, other) if n_good >= n_bad else (other, i)


def bradley_terry(good: np.ndarray, bad: np.ndarray, ridge: float = 1e-3, steps: int = 30) -> np.ndarray:
    """Weights that minimise the mean logistic loss on the differences of preference pairs."""
    i, j = pairs(len(good), len(bad))
    x = good[i] - bad[j]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - 1) / len(x) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step * min(1.0, 5 / max(1e-9, float(np.linalg.norm(step))))
        if np.linalg.norm(step) < 1e-8:
            break
    return w


def best_quantile(good: np.ndarray, bad: np.ndarray) -> float:
    """The score quantile that separates best, each class weighing alike; the middle where several do."""
    cuts = np.quantile(np.r_[good, bad], np.linspace(0, 1, 2001))
    middles = (cuts[1:] + cuts[:-1]) / 2
    right = np.array([(good >= c).mean() + (bad < c).mean() for c in middles])
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return float((middles[best[0]] + middles[best[-1]]) / 2)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> Ranking:
    """Fits on the documents that ``labels`` (doc_id, quality 0 or 1) names."""
    labels = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = None
    for q in (0, 1):
        rows = labels.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
        chosen = rows if chosen is None else chosen.unionByName(rows)
    chosen = chosen.select(F.col("doc_id").alias("_id"), "quality")
    # at most two times train_rows rows of two numbers: a broadcast and a result of a proven size
    train = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
    rows = features(train).select("quality", "features", "_doc").orderBy("_doc", "features").limit(4 * train_rows).collect()
    good = np.array([r["features"] for r in rows if r["quality"] == 1])
    bad = np.array([r["features"] for r in rows if r["quality"] == 0])
    if not len(good) or not len(bad):
        return Ranking((), (), (), 0.0, 1.0)
    both = np.r_[good, bad]
    mean, spread = both.mean(0), both.std(0) + 1e-6
    good, bad = (good - mean) / spread, (bad - mean) / spread
    w = bradley_terry(good, bad)
    scores = np.r_[good @ w, bad @ w]
    slope = 4 / max(1e-6, float(np.quantile(scores, 0.95) - np.quantile(scores, 0.05)))
    return Ranking(tuple(map(float, mean)), tuple(map(float, spread)), tuple(map(float, w)), best_quantile(good @ w, bad @ w), min(1.0, slope * 2))


def held_out(doc_id: Column) -> Column:
    """Rows that aren't learned from: every fourth, by the CRC of the id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def rank(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    model = fit(docs, labels.filter(~held_out(F.col("doc_id"))), id_col, text_col, train_rows)
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scored = features(plain).withColumn("score", model.score(F.col("features")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that are predicted good, with their own columns."""
    model = fit(docs, labels.filter(~held_out(F.col("doc_id"))), id_col, text_col, train_rows)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    scored = features(docs.select(row, F.col(text_col).alias("_text")), "_text")
    # a filter would be pushed below the features and make them again for each weight
    return scored.select(F.inline(F.when(model.score(F.col("features")) >= CUT, F.array("_row"))))
