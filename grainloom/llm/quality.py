"""Quality by co-training two views.

The text view sees what a text is made of: marks, capitals, repetition, words. The metadata view sees what a
crawler would know: length, lines, language, source. Each view is a logistic regression over binned values, fitted on
labelled rows. In each round a view gives its most confident labels on unlabelled documents to the other. The
views' logits are then calibrated on labelled rows kept apart, and added, less the prior, to score every document.

At most LABELLED labelled and POOL unlabelled rows are used to fit, the first by a hash of their id; all documents
are scored, from their whole texts.

Defined cases: null text counts as empty; null lang or source is a value of its own; null labels are no labels; a
document labelled twice takes the lower label; without labels of both kinds everything is accepted with the share
of good labels (1 if there are none) as score; repeated rows give repeated rows; extra columns are ignored, and of
columns to keep those that have a result's name.
"""

from __future__ import annotations

import zlib
from functools import partial
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table
from .linear import calibration, first_by_hash, logistic, sigmoid

LABELLED = 6000
POOL = 6000
ROUNDS = 3
#: Pseudo-labels a view gives in a round, and how sure it has to be.
GIVEN, SURE = 300, 0.95
BINS = 10
BUCKETS = 32
#: A document is rejected if its score is lower.
ACCEPT = 0.5
MARKS = b"*$&%#|!<>{}[]\\^~=+_@"
CAPITALS = bytes(range(65, 91))
DIGITS = b"0123456789"
TEXT = ("marks", "capitals", "digits", "distinct", "same_next", "word_length", "line_distinct", "longest_word", "ends")
META = ("chars", "lines", "line_length", "lang", "source")


def text_values(text: str) -> list[float]:
    b = text.encode("utf-8", "surrogatepass")
    n = max(1, len(b))
    words, lines = b.split(), b.split(b"\n")
    w = max(1, len(words))
    return [
        (len(b) - len(b.translate(None, MARKS))) / n,
        (len(b) - len(b.translate(None, CAPITALS))) / n,
        (len(b) - len(b.translate(None, DIGITS))) / n,
        # of 200 words' worth: a long text repeats its short words
        len(set(words)) / w**0.9,
        sum(map(eq, words, words[1:])) / w,
        len(b.translate(None, b" \n")) / w,
        len(set(lines)) / len(lines),
        max(map(len, words), default=0),
        (b.count(b". ") + b.count(b".\n")) / w,
    ]


def meta_values(text: str, lang: str | None, source: str | None) -> list[float]:
    lines = text.count("\n") + 1
    code = lambda x: zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS if isinstance(x, str) else BUCKETS
    return [np.log1p(len(text)), np.log1p(lines), np.log1p(len(text) / lines), code(lang), code(source)]


def values(pdf) -> np.ndarray:
    texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
    return np.array([text_values(t) + meta_values(t, a, b) for t, a, b in zip(texts, pdf["lang"], pdf["source"], strict=True)], float).reshape(len(pdf), len(TEXT) + len(META))


def described(batches):
    for pdf in batches:
        yield pdf[["doc_id", "quality"]].assign(v=list(values(pdf)))


class View:
    """A logistic regression over values cut into bins; code columns have a bin for each code."""

    def __init__(self, columns: range, codes: set[int]):
        self.columns, self.codes = columns, codes

    def bins(self, v: np.ndarray) -> None:
        self.edges = {c: np.unique(np.quantile(v[:, c], np.linspace(0, 1, BINS + 1)[1:-1])) for c in self.columns if c not in self.codes}

    def one_hot(self, v: np.ndarray) -> np.ndarray:
        out = []
        for c in self.columns:
            n = BUCKETS + 1 if c in self.codes else len(self.edges[c]) + 1
            at = v[:, c].astype(int) if c in self.codes else np.searchsorted(self.edges[c], v[:, c], side="right")
            out.append(np.eye(n)[at])
        return np.hstack(out)

    def fit(self, v: np.ndarray, y: np.ndarray) -> None:
        # junk is rare: both kinds weigh alike up to a factor of 4
        share = max(y.mean(), 1e-3)
        bad = min(4.0, share / max(1 - share, 1e-3))
        self.w = logistic(self.one_hot(v), y, np.where(y == 1, 1.0, bad))

    def logit(self, v: np.ndarray) -> np.ndarray:
        return self.one_hot(v) @ self.w[:-1] + self.w[-1]


class CoTrained:
    """Both views with their calibration; score() is the probability that a document is good."""

    def __init__(self, v: np.ndarray, y: np.ndarray, pool: np.ndarray, rounds: int = ROUNDS):
        self.prior = float(y.mean()) if len(y) else 1.0
        self.views = []
        if len(y) < 20 or y.min() == y.max():
            return
        k = len(TEXT)
        views = [View(range(k), set()), View(range(k, k + len(META)), {k + 3, k + 4})]
        apart = np.arange(len(y)) % 4 == 3  # for the calibration
        own = [(v[~apart], y[~apart]) for _ in views]
        left = np.ones(len(pool), bool)
        for view in views:
            view.bins(np.vstack([v, pool]))
        for r in range(rounds + 1):
            for view, (x, t) in zip(views, own, strict=True):
                view.fit(x, t)
            if r == rounds or not left.any():
                break
            new = []
            for view in views:
                p = sigmoid(view.logit(pool))
                good = np.flatnonzero(left & (p >= SURE))
                bad = np.flatnonzero(left & (p <= 1 - SURE))
                good = good[np.argsort(-p[good], kind="stable")][: int(GIVEN * self.prior)]
                bad = bad[np.argsort(p[bad], kind="stable")][: GIVEN - int(GIVEN * self.prior)]
                new.append((np.concatenate([good, bad]), np.concatenate([np.ones(len(good)), np.zeros(len(bad))])))
            for i, (at, label) in enumerate(new):  # to the other view
                x, t = own[1 - i]
                own[1 - i] = np.vstack([x, pool[at]]), np.concatenate([t, label])
                left[at] = False
        self.views = [(view, *calibration(view.logit(v[apart]), y[apart])) for view in views]

    def score(self, v: np.ndarray) -> np.ndarray:
        if not self.views or not len(v):
            return np.full(len(v), self.prior)
        prior = np.log(self.prior / (1 - self.prior))
        return sigmoid(sum(slope * view.logit(v) + offset for view, slope, offset in self.views) - (len(self.views) - 1) * prior)


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL, rounds: int = ROUNDS) -> CoTrained:
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = first_by_hash(known, labelled, "quality")
    others = first_by_hash(docs.where("doc_id is not null").select("doc_id").distinct(), pool + labelled)
    others = first_by_hash(others.join(F.broadcast(some), "doc_id", "left_anti"), pool).withColumn("quality", F.lit(-1))
    ids = some.unionByName(others)
    sample = docs.select("doc_id", "text", "lang", "source").join(F.broadcast(ids), "doc_id").mapInPandas(described, "doc_id long, quality int, v array<double>").toPandas()
    sample = sample.sort_values("doc_id", kind="stable")
    v = np.array(sample["v"].tolist(), float).reshape(len(sample), len(TEXT) + len(META))
    q = sample["quality"].to_numpy()
    return CoTrained(v[q >= 0], (q[q >= 0] > 0).astype(float), v[q < 0], rounds)


def judged(batches, model, names):
    for batch in batches:
        score = np.clip(model.value.score(values(batch.select(["__op_text", "__op_lang", "__op_source"]).rename_columns(["text", "lang", "source"]).to_pandas())), 0, 1)
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(score, pa.float64())], [*names, "quality_score"])


def score(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), accept: float = ACCEPT, **how) -> DataFrame:
    """The columns to keep with quality_score (0 to 1) and accepted, for each document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **how))
    keep = tuple(c for c in keep if c.lower() not in ("quality_score", "accepted"))
    rows = docs.select(*keep, *(F.col(c).alias(f"__op_{c}") for c in ("text", "lang", "source")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)]) + ", quality_score double"
    out = rows.mapInArrow(partial(judged, model=model, names=list(keep)), schema)
    return out.withColumn("accepted", F.col("quality_score") >= accept)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
