"""Document quality by Bradley-Terry ranking.

Of a pair of documents the better one wins with a probability of the logistic function of their scores'
difference, and a document's score is a weighted sum of what its text looks like: shares of each kind of
character, how much words and lines repeat, how long words are. The weights are learned from preference
pairs (a document labelled good, one labelled bad) by logistic loss on the differences of their features.

Scores are then cut at the quantile of the training scores above which the share of good labels lies, and
mapped to 0..1 with that cut at 0.5. Training takes a bounded sample of labels (MOST_LABELS); scoring
goes over every text where it lies, in Arrow batches.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, set_aside, whole_text
from tidemark.llm.labelled import fold, labels_of, sample, with_texts

#: The sample of labelled rows from which weights are learned.
MOST_LABELS = 12_000
PAIRS = 60_000
STEPS = 300
BINS = 6
FOLDS, HELD_OUT = 3, 1

_ASCII = [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]


def features(text: str) -> np.ndarray:
    """Shares of characters, and of repeats among words and lines; zeros for an empty text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    if not len(raw):
        return np.zeros(len(_ASCII) + 13)
    counts = np.bincount(raw, minlength=256)
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    times = Counter(words)
    most = max(times.values(), default=0)
    shares = counts[_ASCII] / len(raw)
    ends = sum(map(str.isalnum, times))
    own = [
        counts[65:91].sum() / len(raw), counts[97:123].sum() / len(raw), counts[48:58].sum() / len(raw), counts[128:].sum() / len(raw), (counts[:32].sum() - counts[10]) / len(raw), counts[10] / len(raw),
        len(raw) / n / 32, len(times) / n, most / n, sum(map(str.__eq__, words, words[1:])) / n, ends / max(1, len(times)), 1 - len(set(lines)) / len(lines), np.log1p(len(words)) / 12,
    ]
    return np.concatenate([shares, own])


@dataclass
class Ranker:
    edges: np.ndarray  # per feature, the inner edges of its bins
    weights: np.ndarray
    cut: float
    scale: float

    def expanded(self, x: np.ndarray) -> np.ndarray:
        """Each feature as the bins at or below it."""
        return (x[:, :, None] >= self.edges[None]).reshape(len(x), -1).astype(np.float64)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """0..1, the cut at 0.5; only the order counts, so scaling changes no decision."""
        return 1 / (1 + np.exp(-np.clip((self.expanded(x) @ self.weights - self.cut) / self.scale, -30, 30)))


def loss_and_slope(w: np.ndarray, d: np.ndarray) -> tuple[float, np.ndarray]:
    """The mean logistic loss of pairs whose features differ by d (winner less loser), weights held small; its slope by w."""
    margin = np.clip(d @ w, -30, 30)
    loss = float(np.log1p(np.exp(-margin)).mean() + 0.5e-4 * (w @ w))
    return loss, -(d * (1 / (1 + np.exp(margin)))[:, None]).mean(axis=0) + 1e-4 * w


def fit(x: np.ndarray, good: np.ndarray, seed: int = 6) -> Ranker:
    """Weights from pairs (good, bad). Without both kinds all scores are alike, on the side of the only label."""
    grid = np.linspace(0, 1, BINS + 2)[1:-1]
    low = np.nextafter(x.min(axis=0, initial=0, keepdims=True), np.inf) if len(x) else np.zeros((1, x.shape[1]))
    present = [np.quantile(c[c > 0], grid) if (c > 0).any() else np.full(BINS, np.inf) for c in x.T]
    edges = np.concatenate([low.T, np.array(present).reshape(-1, BINS)], axis=1)
    model = Ranker(edges, np.zeros(edges.size), 0.0, 1.0)
    win, lose = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    if not len(win) or not len(lose):
        model.cut = -1.0 if len(win) else 1.0
        return model
    z, rng = model.expanded(x), np.random.default_rng(seed)
    a, b = rng.choice(win, PAIRS), rng.choice(lose, PAIRS)
    w, m, v = model.weights, np.zeros(z.shape[1]), np.zeros(z.shape[1])
    for step in range(1, STEPS + 1):
        at = rng.integers(0, PAIRS, 4096)
        slope = loss_and_slope(w, z[a[at]] - z[b[at]])[1]
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    s = z @ w
    model.cut = _quantile_cut(s, len(lose) / (len(win) + len(lose)))
    model.scale = max(float(np.std(s)), 1e-6) / 2
    return model


def _quantile_cut(scores: np.ndarray, share: float) -> float:
    """The quantile of scores at `share`, moved into the widest gap near it (within a fiftieth of the rows)."""
    s = np.sort(scores)
    at, reach = int(round(share * len(s))), max(1, len(s) // 50)
    lo, hi = max(1, at - reach), min(len(s) - 1, at + reach)
    i = lo + int(np.argmax(s[lo : hi + 1] - s[lo - 1 : hi])) if hi >= lo else min(at, len(s) - 1)
    return float((s[i] + s[i - 1]) / 2)


def learned(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELS) -> Ranker:
    """A ranker from at most `most` labels whose fold isn't held out. Null labels are left out; of an id's
    labels or texts that disagree the smallest counts, so that reruns agree."""

    @F.pandas_udf("array<double>")
    def featured(texts: pd.Series) -> pd.Series:
        return texts.map(features)

    chosen = sample(labels_of(labels, "quality").filter(fold(FOLDS) != HELD_OUT), most, 6)
    rows = with_texts(chosen, docs, whole_text()).select("doc_id", "quality", featured("text").alias("x")).orderBy("doc_id").toPandas()
    x = np.array(rows.x.tolist()) if len(rows) else np.zeros((0, len(_ASCII) + 13))
    return fit(x, rows.quality.to_numpy())


def scored(docs: DataFrame, model: Ranker) -> DataFrame:
    """docs with `score` and `predicted` (1 from a score of 0.5); columns of these names are replaced.

    A null text counts as empty and gets the score of an empty text. Rows are scored one by one: equal
    texts get equal scores, an empty table gives an empty one; a text of any length is read whole.
    """

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([features(t) for t in texts])
            yield pd.Series(model.scores(x) if len(x) else [], index=texts.index, dtype=float)

    return docs.drop("score", "predicted").withColumn("score", score(whole_text())).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't rejected, with their columns, also those named like a score's."""
    aside, back = set_aside(docs, ("score", "predicted"))
    kept = scored(aside, learned(docs, labels)).filter("predicted = 1").drop("score", "predicted")
    return kept.withColumnsRenamed(back).select(*docs.columns)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select("doc_id", (fold(FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")
