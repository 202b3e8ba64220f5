"""Toxicity by non-negative positive-unlabelled learning.

Positives are documents that labels mark toxic; unlabelled are other documents, whose toxic share is the class
prior, estimated from the labels. The risk of a linear classifier over the words a text has is
prior * R(positive, +) + max(0, R(unlabelled, -) - prior * R(positive, -)); where the second term turns negative, its
gradient is reversed, as the non-negative estimator asks. Only rows of the training fold give labels or unlabelled
texts; at most POSITIVES and UNLABELLED rows are used, the first by a hash of their id.

Defined cases: null and empty texts get the score of a text without words; null labels are no labels; a document
labelled twice counts as toxic if any label says so; without positives every score is 0, without unlabelled
texts it is the class prior; repeated rows give
repeated rows; extra columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import ALNUM, WordHashes, table
from .linear import Adam, crc_mod, first_by_hash, sigmoid

FOLDS = 5
POSITIVES = 3000
UNLABELLED = 6000
FEATURES = 400
LEAST_DOCS = 8


def held_out():
    return crc_mod(FOLDS) == 0


def words_of(text: str | None) -> set[bytes]:
    return set(text.lower().encode("utf-8", "surrogatepass").translate(ALNUM).split()) if isinstance(text, str) else set()


def hashed(batches):
    seen = WordHashes()
    for pdf in batches:
        out = [np.unique(seen.of(list(words_of(t)))).tobytes() for t in pdf["text"]]
        yield pdf[["doc_id", "toxic"]].assign(words=out)


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, features: int = FEATURES, epochs: int = 400):
    """Weights by word hash, and the bias."""
    train = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    seen, toxic = train.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("toxic") == 1, 1)), F.lit(0))).first()
    if not toxic:
        return {}, -20.0
    prior = toxic / seen
    pos = first_by_hash(train.where("toxic = 1"), positives).withColumn("toxic", F.lit(1))
    # unlabelled texts: documents of the training fold without a toxic label
    other = docs.where(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id").distinct()
    other = first_by_hash(other, unlabelled + positives).join(F.broadcast(pos), "doc_id", "left_anti")
    ids = pos.unionByName(first_by_hash(other, unlabelled).withColumn("toxic", F.lit(0)))
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    sample = rows.mapInPandas(hashed, "doc_id long, toxic int, words binary").toPandas().sort_values("doc_id", kind="stable")
    sets = [np.frombuffer(b, np.uint64) for b in sample["words"]]
    y = sample["toxic"].to_numpy() == 1
    if not y.any() or y.all():  # nothing to tell apart
        return {}, (float(np.log(prior / (1 - prior))) if 0 < prior < 1 else 20.0) if y.any() else -20.0
    n_pos, n_un = y.sum(), (~y).sum()
    vocab, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    in_pos = np.bincount(at[y[row]], minlength=len(vocab))
    in_un = np.bincount(at[~y[row]], minlength=len(vocab))
    odds = np.log((in_pos + 0.5) / (n_pos + 1)) - np.log((in_un + 0.5) / (n_un + 1))
    odds[in_pos + in_un < LEAST_DOCS] = 0
    # evidence of a word: its odds by the root of the documents that have it
    chosen = np.argsort(-np.abs(odds) * np.sqrt(in_pos + in_un), kind="stable")[:features]
    column = np.full(len(vocab), -1)
    column[chosen] = np.arange(len(chosen))
    x = np.zeros((len(sets), len(chosen) + 1))
    x[:, -1] = 1
    ok = column[at] >= 0
    x[row[ok], column[at[ok]]] = 1
    w = nn_pu(x[y], x[~y], prior, epochs)
    return {int(vocab[c]): float(v) for c, v in zip(chosen, w[:-1], strict=True)}, float(w[-1])


def nn_pu(p: np.ndarray, u: np.ndarray, prior: float, epochs: int, rate: float = 0.05, ridge: float = 2e-4) -> np.ndarray:
    """Minimises the non-negative risk with the logistic loss; the last column is the bias."""
    fit = Adam(p.shape[1], rate)
    fit.w[-1] = np.log(prior / (1 - prior)) if 0 < prior < 1 else 0.0
    for _ in range(epochs):
        sp, su = sigmoid(p @ fit.w), sigmoid(u @ fit.w)
        negative = np.mean(-np.log(1 - su + 1e-12)) - prior * np.mean(-np.log(1 - sp + 1e-12))
        g_neg = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        g = prior * (p.T @ (sp - 1)) / len(p) + g_neg if negative >= 0 else -g_neg
        g[:-1] += ridge * fit.w[:-1]
        fit.step(g)
    return fit.w


class Weights(dict):
    """Weights of the words met last."""

    def __init__(self, by_hash: dict[int, float]):
        super().__init__()
        self.by_hash, self.hashes = by_hash, WordHashes()

    def __missing__(self, word: bytes) -> float:
        if len(self) >= WordHashes.LIMIT:
            self.clear()
        w = self[word] = self.by_hash.get(self.hashes.of([word])[0].item(), 0.0)
        return w


def scored(batches, model):
    by_hash, bias = model.value
    weights = Weights(by_hash)
    for batch in batches:
        s = sigmoid(np.array([sum(map(weights.__getitem__, sorted(words_of(t)))) + bias for t in batch.column("text").to_pylist()], float))
        own = [batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))]
        yield pa.RecordBatch.from_arrays(own, ["doc_id", "held_out", "score", "predicted"])


def score(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **how))
    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(
        partial(scored, model=model), "doc_id long, held_out boolean, score double, predicted int"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
