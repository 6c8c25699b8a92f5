"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are positives; texts drawn from all documents are unlabelled, whatever is known of them. A linear
classifier is trained in numpy on the risk estimate prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)):
where the second term turns negative, the step goes the other way, so that it can't be driven below zero.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import settle, text_batches

#: Buckets of hashed features.
BUCKETS = 1 << 20
#: Largest number of positive and of unlabelled texts that a model is fitted on.
POSITIVES, UNLABELLED = 4_000, 12_000
#: Bounds of the class prior in the fit.
PRIORS = (1e-3, 0.9)
#: Likelihood ratio that a feature must reach to count as more frequent in positives; about one in 10^4 by chance.
SURPRISE = 17.0
#: Length of the word beginnings that are features beside the words.
STEM = 5
#: Numbers of different words of one beginning that are features, too.
SEVERAL = (2, 4)

_words = re.compile(r"[^\W\d_]+").findall


def features(text: str | None) -> np.ndarray:
    """Distinct hashed features of a whole text: its words, their beginnings, and beginnings of several of its words."""
    found = set(_words(text.lower())) if text else set()
    stems = Counter(w[:STEM] for w in found if len(w) > STEM)
    found.update([s + "*" for s in stems])
    for least in SEVERAL:
        found.update([f"{s}*{least}" for s, n in stems.items() if n >= least])
    return np.unique(np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in found), np.uint32, len(found)) & np.uint32(BUCKETS - 1)).astype(np.int32)


@dataclass
class Model:
    """Score of a text: the logistic function of bias plus the weights of its features."""

    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        x = float(self.bias + self.weights[features(text)].sum())
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def risk(z: np.ndarray, is_p: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of scores ``z`` and the direction (by score) of the next step.

    Logistic losses: of label +1 log(1 + e^-z), of label -1 log(1 + e^z). While the part for negatives is not below zero
    the direction is the gradient of the unclipped risk, else that of minus this part.
    """
    p, n_p, n_u = _logistic(z), is_p.sum(), (~is_p).sum()
    plus, minus = np.logaddexp(0, -z), np.logaddexp(0, z)
    rest = minus[~is_p].mean() - prior * minus[is_p].mean()
    g = np.zeros(len(z))
    if rest >= 0:
        g[is_p] = prior * (p[is_p] - 1) / n_p - prior * p[is_p] / n_p
        g[~is_p] = p[~is_p] / n_u
    else:
        g[is_p] = prior * p[is_p] / n_p
        g[~is_p] = -p[~is_p] / n_u
    return float(prior * plus[is_p].mean() + max(0.0, rest)), g


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = 300, rate: float = 0.1, ridge: float = 1e-4) -> Model:
    """Fit the classifier on features of texts by full-batch steps (Adam) on the non-negative risk.

    Only features that are markedly more frequent in positives than in unlabelled texts are weighted; without positives or
    unlabelled texts every score is the prior. A prior outside PRIORS is taken as the nearer end: below it a handful of
    unlabelled texts would hold all toxic ones, so the risk can't be told from noise.
    """
    prior = float(np.clip(prior, *PRIORS))
    base = Model(np.zeros(BUCKETS, np.float32), float(np.log(prior / (1 - prior))))
    if not positive or not unlabelled:
        return base
    count = [np.bincount(np.concatenate(x), minlength=BUCKETS).astype(float) for x in (positive, unlabelled)]
    share = [(c + 0.5) / (len(x) + 1) for c, x in zip(count, (positive, unlabelled), strict=True)]
    usual = (count[1] + 1) / (len(unlabelled) + 1) * len(positive)  # positives that would have it by chance
    surprise = 2 * (count[0] * np.log(np.maximum(count[0], 1) / usual) - (count[0] - usual))  # likelihood ratio of two Poisson rates
    telling = (count[0] > 1) & (share[0] > 2 * share[1]) & (surprise > SURPRISE)
    chosen = np.flatnonzero(telling)
    if not len(chosen):
        return base
    place = np.full(BUCKETS, -1, np.int64)
    place[chosen] = np.arange(len(chosen))
    rows, cols = [], []
    for i, x in enumerate([*positive, *unlabelled]):
        c = place[x]
        c = c[c >= 0]
        rows.append(np.full(len(c), i))
        cols.append(c)
    rows, cols = np.concatenate(rows), np.concatenate(cols)
    n = len(positive) + len(unlabelled)
    is_p = np.arange(n) < len(positive)
    w, b = np.zeros(len(chosen)), -1.0
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, epochs + 1):
        z = b + np.bincount(rows, w[cols], n)
        _, g = risk(z, is_p, prior)
        grad = np.append(np.bincount(cols, g[rows], len(chosen)) + ridge * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    base.weights[chosen] = w
    base.bias = float(b)
    return base


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(t).tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["toxic", "found"])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model:
    """Fit on at most POSITIVES confirmed toxic texts and UNLABELLED of all ``docs``, taken in the order of a hash.

    ``labels``: doc_id, toxic (1: confirmed). The class prior is the share of toxic
    rows among ``labels`` with a value. Repeated or contradicting labels of a document count as toxic if any is; of a
    repeated doc_id one text is taken. Rows without doc_id take no part. Texts are read whole.
    """
    text_batches(docs.sparkSession)
    marks = labels.where(f"{doc_id} IS NOT NULL AND {toxic} IS NOT NULL").groupBy(F.col(doc_id).alias("id")).agg(F.max(F.col(toxic).cast("int")).alias("toxic"))
    prior = marks.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    ids = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id")).distinct().join(marks, "id", "left").select("id", (F.coalesce("toxic", F.lit(0)) == 1).alias("toxic"))
    order = F.xxhash64("id", F.lit(7)), "id"
    # unlabelled texts are drawn from all documents, so that they hold toxic ones at the class prior
    picked = ids.where("toxic").orderBy(*order).limit(POSITIVES).unionByName(ids.orderBy(*order).limit(UNLABELLED).withColumn("toxic", F.lit(False)))
    picked = F.broadcast(settle(picked))  # at most POSITIVES + UNLABELLED rows
    # one text of a doc_id that is repeated, so that the bounds hold
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(picked, "id").groupBy("id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    found = texts.select("toxic", "text").mapInArrow(_featured, "toxic boolean, found binary").collect()
    side = lambda t: [np.frombuffer(r.found, np.int32) for r in found if r.toxic == t]
    return train(side(True), side(False), prior or 0.0)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` with ``out``: the score of each whole text; null counts as empty.

    Rows are scored one by one, so repeated rows get equal scores; an empty table gives no rows.
    """
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    docs = docs.drop(out)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            yield batch.append_column(out, pa.array([own.score(t) for t in batch.column(at).to_pylist()], pa.float64()))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))
