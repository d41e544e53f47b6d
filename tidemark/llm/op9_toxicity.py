"""Toxicity by non-negative positive-unlabelled learning.

The classifier is linear in which words a text holds; a word is told by its hash among BUCKETS, and every bucket that a
text of the samples holds has a weight. How far it can move hangs on its evidence: a bucket's value is the squared log
of how often toxic texts hold it over how often they would if it told nothing, both with KAPPA added, so buckets
that a few texts hold or all texts alike hold have small values. It learns from confirmed toxic texts and from a sample of all texts, whose labels aren't looked
at and of which a part `prior` is toxic as well. The risk of calling an unlabelled text clean is the mean loss over
unlabelled texts less prior times that over toxic ones; where a step makes this estimate negative, the model
has begun to learn the sample by heart, and the step goes the other way for that part. Labels of clean texts are
used only to estimate the prior.

Both samples are bounded (MOST_TOXIC, MOST_UNLABELLED) and reach the driver as buckets. Scoring goes over every text
where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, documents, whole_text
from tidemark.llm.labelled import fold, labels_of, sample, with_texts

#: The samples from which the classifier is learned.
MOST_TOXIC, MOST_UNLABELLED = 5_000, 12_000
BUCKETS = 1 << 20
STEPS = 200
#: Texts that count as seen for every bucket before any is.
KAPPA = 5.0
FOLDS, HELD_OUT = 5, 0
_AROUND = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def words(text: str) -> set[str]:
    """The lower-cased words of a text, without ASCII punctuation around them."""
    return {w.strip(_AROUND) for w in set(text.lower().split())} - {""}


def buckets(text: str) -> set[int]:
    """The buckets of a text's words."""
    return {xxhash.xxh3_64_intdigest(w) % BUCKETS for w in words(text)}


@dataclass
class Classifier:
    weights: dict[int, float]  # by bucket; others weigh nothing
    bias: float

    def score(self, text: str) -> float:
        get = self.weights.get
        z = self.bias + sum(get(i, 0.0) for i in buckets(text))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Risk:
    """The non-negative risk over texts that are rows of word places: (text, place) pairs and the number of texts."""

    toxic: tuple[np.ndarray, np.ndarray, int]
    unlabelled: tuple[np.ndarray, np.ndarray, int]
    k: int
    prior: float

    def at(self, w: np.ndarray, b: float) -> tuple[float, float, np.ndarray]:
        """(prior times the loss of toxic texts as toxic, the risk of calling clean, slope of the step to take by w and b)."""
        (rp, cp, n), (ru, cu, m) = self.toxic, self.unlabelled
        zp, zu = b + np.bincount(rp, w[cp], n), b + np.bincount(ru, w[cu], m)
        clean_risk = np.mean(np.logaddexp(0, zu)) - self.prior * np.mean(np.logaddexp(0, zp))
        # slopes of the logistic loss: as toxic -(1 - s), as clean s
        as_toxic, as_clean_p, as_clean_u = -self.prior * (1 - _sigmoid(zp)) / n, -self.prior * _sigmoid(zp) / n, _sigmoid(zu) / m
        gp, gu = (as_toxic + as_clean_p, as_clean_u) if clean_risk >= 0 else (-as_clean_p, -as_clean_u)
        slope = np.append(np.bincount(cp, gp[rp], self.k) + np.bincount(cu, gu[ru], self.k), gp.sum() + gu.sum())
        return self.prior * float(np.mean(np.logaddexp(0, -zp))), float(clean_risk), slope


def evidence(risk: Risk) -> np.ndarray:
    """Each bucket's value: 0 where it tells nothing, whatever its sign."""
    (_, cp, n), (_, cu, m) = risk.toxic, risk.unlabelled
    seen, expected = np.bincount(cp, minlength=risk.k), np.bincount(cu, minlength=risk.k) * (n / m)
    return np.log((seen + KAPPA) / (expected + KAPPA)) ** 2


def fit(toxic: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Classifier:
    """Full-batch Adam on the non-negative risk with logistic loss; a text is the buckets of its words, and every bucket of any text has a weight.

    Without toxic texts nothing is toxic.
    """
    if not len(toxic) or not len(unlabelled):
        return Classifier({}, 5.0 if len(toxic) else -5.0)
    # weights of buckets that no text holds would stay 0
    place = np.zeros(BUCKETS, np.int64)
    for r in (*toxic, *unlabelled):
        place[np.asarray(r, np.int32)] = 1
    present = np.flatnonzero(place)
    place[present] = np.arange(len(present))
    k = len(present)
    entries = lambda rows: (np.repeat(np.arange(len(rows)), [len(r) for r in rows]), place[np.concatenate([np.asarray(r, np.int32) for r in rows])], len(rows))
    prior = min(max(prior, 1e-4), 0.9)
    risk = Risk(entries(toxic), entries(unlabelled), k, prior)
    value = evidence(risk)
    w, b = np.zeros(k), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, STEPS + 1):
        slope = risk.at(w * value, b)[2] * np.append(value, 1.0) + np.append(1e-4 * w, 0.0)
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Classifier(dict(zip(present.tolist(), (w * value).tolist(), strict=True)), float(b))


def learned(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_unlabelled: int = MOST_UNLABELLED) -> Classifier:
    """A classifier from labels whose fold isn't held out, and from texts of rows that aren't either.

    Of an id's labels or texts that disagree the smallest counts, so that reruns agree.
    """

    @F.pandas_udf("array<int>")
    def hashed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(buckets(t)))

    usable = labels_of(labels, "toxic").filter(fold(FOLDS) != HELD_OUT)
    prior = usable.agg(F.avg("toxic")).first()[0] or 0.0
    toxic = sample(usable.filter("toxic = 1").select("doc_id"), most_toxic, 9)
    others = docs.select("doc_id").filter("doc_id is not null").filter(fold(FOLDS) != HELD_OUT).distinct()
    unlabelled = sample(others, most_unlabelled, 10)
    chosen = toxic.withColumn("positive", F.lit(1)).union(unlabelled.withColumn("positive", F.lit(0)))
    with Scratch(docs.sparkSession) as scratch:
        texts = scratch.stored(with_texts(chosen, docs, whole_text()).select("doc_id", "positive", hashed("text").alias("words")), "toxic")
        rows = texts.orderBy("positive", "doc_id").toPandas()
    return fit(rows.words[rows.positive == 1].tolist(), rows.words[rows.positive == 0].tolist(), float(prior))


def scored(docs: DataFrame, model: Classifier) -> DataFrame:
    """docs with `score` and `predicted` (1 from a score of 0.5); columns of these names are replaced.

    A null text counts as empty: it holds no word and gets the bias's score. Rows are scored one by one;
    equal texts get equal scores, an empty table gives an empty one; a text of any length is read whole.
    """

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model.score(t) for t in texts], index=texts.index, dtype=float)

    return docs.drop("score", "predicted").withColumn("score", score(whole_text())).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select("doc_id", (fold(FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")
