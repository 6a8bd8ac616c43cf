"""Toxicity by a classifier chain of linear models over hashed word features.

Categories are predicted in order. The model of each category sees the text's features and the
log-odds of all earlier categories; in training these come from out-of-fold models, so a later
model learns from probabilities as unsure as those it meets on new texts. Features are words,
their first and last bytes, hashed; a model keeps the ``SELECTED`` that tell its category best
among the rows it is fitted on: an out-of-fold model's choice never sees its own fold.

The models are fitted on at most ``MAX_TRAIN`` labelled documents, those with the smallest hash
of doc_id; everything is predicted for all documents.

Defined cases: null or empty text has no features and gets the models' base rate; a doc_id with
several label rows takes the worst of them (null labels are left out); a category with no
labelled rows, or only one class, is predicted as its smoothed rate; repeated rows get equal
results; of several texts with one labelled doc_id the one with the smallest feature array is
learned from; features that tell a category alike go by their number; an empty table gives an
empty result; extra columns pass through. Texts of any length are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import discard, materialize, small_batches
from .words import word_features

#: Labelled documents used for fitting, features of each model, folds, cut for rejection, rows multiplied at once.
MAX_TRAIN, SELECTED, FOLDS, REJECT, ROWS = 10_000, 1_000, 4, 0.2, 1_000
BITS = 20
#: Category -> SQL over the columns of labels, in the order of the chain.
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}


@dataclass
class Linear:
    bias: float
    chosen: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    earlier: np.ndarray = field(default_factory=lambda: np.empty(0))

    def logit(self, feats: np.ndarray, before: np.ndarray) -> float:
        z = self.bias + float(before[:len(self.earlier)] @ self.earlier)
        if len(self.chosen) and len(feats):
            at = np.minimum(np.searchsorted(self.chosen, feats), len(self.chosen) - 1)
            z += float(self.weights[at[self.chosen[at] == feats]].sum())
        return z


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def indicators(feats: list[np.ndarray], chosen: np.ndarray) -> np.ndarray:
    """Rows by chosen features, 1 where a row has the feature: MAX_TRAIN x SELECTED at most."""
    x = np.zeros((len(feats), len(chosen)), np.uint8)
    for i, f in enumerate(feats):
        x[i, np.searchsorted(chosen, np.intersect1d(f, chosen, assume_unique=True))] = 1
    return x


def fit_linear(x: np.ndarray, before: np.ndarray, y: np.ndarray, chosen: np.ndarray, rounds: int = 200, l2: float = 1e-4) -> Linear:
    """Logistic regression by accelerated gradient descent; x has indicators, before the earlier
    log-odds. x stays as it is, in bytes; some ROWS of it at once are made floats."""
    n, pos = len(y), float(y.sum())
    if pos == 0 or pos == n:
        return Linear(float(np.log((pos + 0.5) / (n - pos + 0.5))), earlier=np.zeros(before.shape[1]))
    k, e = x.shape[1], before.shape[1]
    rest = np.concatenate((before.astype(np.float32), np.ones((n, 1), np.float32)), 1)
    w, prev = np.zeros(k + e + 1, np.float32), np.zeros(k + e + 1, np.float32)
    w[-1] = prev[-1] = np.log(pos / (n - pos))
    # Steps by each weight's share of the curvature.
    width = max(1.0, float(np.percentile(x.sum(1, dtype=np.float64) + e + 1, 90)) ** 0.5)
    share = np.concatenate((x.mean(0, dtype=np.float64), (rest * rest).mean(0)))  # an indicator is its own square
    step = (0.3 / (0.25 * share * width + l2 + 1e-6)).astype(np.float32)
    decay = np.full(len(w), l2, np.float32)
    decay[-1] = 0
    for t in range(rounds):
        v = w + np.float32(t / (t + 3)) * (w - prev)
        slope = np.zeros(len(w), np.float32)
        for s in range(0, n, ROWS):
            few, more = x[s:s + ROWS].astype(np.float32, copy=False), rest[s:s + ROWS]
            r = ((_sigmoid(few @ v[:k] + more @ v[k:]) - y[s:s + ROWS]) / n).astype(np.float32)
            slope += np.concatenate((r @ few, r @ more))
        prev, w = w, v - step * (slope + decay * v)
    w = w.astype(np.float64)
    return Linear(float(w[-1]), chosen, w[:k], w[k:k + e])


def fit_chain(feats: list[np.ndarray], ys: list[np.ndarray], chosen: dict[tuple[int, int], np.ndarray], folds: np.ndarray) -> list[Linear]:
    """One model a category; earlier categories enter as out-of-fold log-odds. chosen has the
    features of (category, fold left out), fold -1 for the model of all rows."""
    before = np.zeros((len(feats), 0))
    chain: list[Linear] = []
    for i, y in enumerate(ys):
        pick = np.flatnonzero(np.isfinite(y))
        x = indicators([feats[k] for k in pick], chosen[i, -1])
        chain.append(fit_linear(x, before[pick], y[pick], chosen[i, -1]))
        if i + 1 < len(ys):
            oof = np.zeros(len(feats))
            for f in range(FOLDS):
                inside = pick[folds[pick] != f]
                x = indicators([feats[k] for k in inside], chosen[i, f])
                m = fit_linear(x, before[inside], y[inside], chosen[i, f])
                for j in np.flatnonzero(folds == f):
                    oof[j] = m.logit(feats[j], before[j])
            before = np.column_stack((before, np.clip(oof, -8, 8)))
    return chain


def learn(docs: DataFrame, labels: DataFrame, categories: dict[str, str] | None = None) -> list[Linear]:
    """The chain, fitted on the driver; it gets MAX_TRAIN rows of selected features at most."""
    categories = categories or CATEGORIES
    spark = docs.sparkSession
    small_batches(spark)
    marks = [f"__rc_y{i}" for i in range(len(categories))]
    worst = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.max(F.expr(sql).cast("double")).alias(m) for m, sql in zip(marks, categories.values(), strict=True)])
    sample = worst.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN).collect()

    @F.pandas_udf("array<int>")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series(list(word_features(texts.tolist(), BITS)))

    # The sample has at most MAX_TRAIN rows, so it can be broadcast.
    few = spark.createDataFrame(sample, worst.schema)
    rows = materialize(docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("doc_id", *marks, features("text").alias("f"))
                       .groupBy("doc_id", *marks).agg(F.min("f").alias("f")), "features")
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int"))
    # Labelled rows and those of the category, of all folds but each, and of all (fold -1).
    kinds = [(i, f) for i in range(len(marks)) for f in ([-1, *range(FOLDS)] if i + 1 < len(marks) else [-1])]
    sums = [s for i, f in kinds for m in [F.when(F.col("fold") != f, F.col(marks[i]))] for s in (F.count(m).alias(f"n{i}_{f}"), F.coalesce(F.sum(m), F.lit(0.0)).alias(f"p{i}_{f}"))]
    counts = materialize(rows.select("fold", *marks, F.explode("f").alias("feature")).groupBy("feature").agg(*sums), "counts")
    size = rows.agg(*sums).first()
    chosen = {}
    for i, f in kinds:
        n, pos, of, told = size[f"n{i}_{f}"], size[f"p{i}_{f}"], F.col(f"n{i}_{f}"), F.col(f"p{i}_{f}")
        chosen[i, f] = np.empty(0, np.int32)
        if not n or pos in (0, n):
            continue
        want = of * (pos / n)
        chi = (told - want) * (told - want) / (want * (1 - pos / n))
        top = counts.filter(of >= 3).orderBy(chi.desc(), "feature").limit(SELECTED).select("feature").collect()
        chosen[i, f] = np.sort(np.array([r["feature"] for r in top], np.int32))
    discard(counts)
    wanted = np.unique(np.concatenate(list(chosen.values())))

    @F.pandas_udf("binary")
    def only(fs: pd.Series) -> pd.Series:
        # Places among the wanted features, which are under 65,536, as bytes: lists of numbers would fill the driver.
        return pd.Series([np.searchsorted(wanted, np.intersect1d(f, wanted, assume_unique=True)).astype("<u2").tobytes() for f in fs])

    got = sorted(rows.select("doc_id", "fold", *marks, only("f").alias("f")).collect(), key=lambda r: r["doc_id"])
    if not got:
        return [Linear(-30.0, earlier=np.zeros(i)) for i in range(len(marks))]
    ys = [np.array([np.nan if r[m] is None else r[m] for r in got], float) for m in marks]
    folds = np.array([r["fold"] for r in got])
    return fit_chain([wanted[np.frombuffer(r["f"], "<u2")] for r in got], ys, chosen, folds)


def predict(text: Column, chain: list[Linear], names: list[str]) -> Column:
    """struct of one probability a category."""
    @F.pandas_udf(T.StructType([T.StructField(f"p_{n}", T.DoubleType()) for n in names]))
    def tell(texts: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(texts), len(chain)))
        for i, f in enumerate(word_features(texts.tolist(), BITS)):
            before = np.zeros(len(chain))
            for k, m in enumerate(chain):
                before[k] = np.clip(m.logit(f, before), -8, 8)
            out[i] = _sigmoid(before)
        return pd.DataFrame(out, columns=[f"p_{n}" for n in names])

    return tell(text)


def score(docs: DataFrame, labels: DataFrame, categories: dict[str, str] | None = None) -> DataFrame:
    """Per document: doc_id, a probability for each category, toxic (the last one at REJECT or more)."""
    categories = categories or CATEGORIES
    names = list(categories)
    p = predict(F.col("text"), learn(docs, labels, categories), names)
    return docs.select("doc_id", p.alias("p")).select("doc_id", "p.*").withColumn("toxic", F.col(f"p_{names[-1]}") >= REJECT)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pipeline stage: documents whose last category is predicted go; all columns come back."""
    names = list(CATEGORIES)
    p = predict(F.col("text"), learn(docs, labels), names)
    return docs.withColumn("__rc_tox", p).filter(F.col(f"__rc_tox.p_{names[-1]}") < REJECT).select(*[F.col(f"`{c}`") for c in docs.columns])
