"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a word between two blanks from both sides and gives every position a distribution
over languages; a document's distribution is the mean over the positions of all its words, so every byte of the
whole text counts. Words longer than LONGEST bytes are read in pieces. A word that is met again in a batch isn't
read again. It is trained here, in numpy, by backpropagation through time, on words of at most TRAIN_DOCS labelled
documents a language (the first by a hash of their id).

Defined cases: a text that is null or has no letter is `und` with score 0; without labelled documents every text
is `und`; null doc_id is scored like others; repeated rows give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import table

HIDDEN = 8
LONGEST = 24
TRAIN_DOCS = 250
TRAIN_WORDS = 50
#: Documents whose words are read together.
ROWS = 2000
LETTER = re.compile(r"[^\W\d_]")
STEPS = (6, 9, 12, 16, LONGEST + 2)


def held_out(doc_id: str | Column) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string")) if isinstance(doc_id, str) else F.crc32(doc_id.cast("string")), F.lit(4)) == 2


def pieces(word: bytes) -> list[bytes]:
    return [word[i : i + LONGEST] for i in range(0, len(word), LONGEST)]


def words_of(text: str) -> list[bytes]:
    out = text.lower().encode("utf-8", "surrogatepass").split()
    if any(len(w) > LONGEST for w in out):
        out = [p for w in out for p in pieces(w)]
    return out


def padded(words: list[bytes], steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes as (steps, words) with a blank before and blanks after; where a step is one of the word's bytes."""
    flat = b"".join(b" " + w.ljust(steps - 1) for w in words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    at = np.arange(steps)[:, None]
    return np.ascontiguousarray(np.frombuffer(flat, np.uint8).reshape(-1, steps).T), (at >= 1) & (at <= length)


class Net:
    """Weights of one network; r and z are sigmoids, n is a tanh, columns are words."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 5):
        g = np.random.default_rng(seed)
        self.hidden, self.classes = hidden, classes
        self.p = {}
        for d in "fb":
            self.p["X" + d] = (g.standard_normal((3 * hidden, 256)) * 0.3).astype(np.float32)
            self.p["U" + d] = (g.standard_normal((3 * hidden, hidden)) * 0.3).astype(np.float32)
            self.p["c" + d] = np.zeros((3 * hidden, 1), np.float32)
        self.p["V"] = (g.standard_normal((classes, 2 * hidden)) * 0.1).astype(np.float32)
        self.p["v"] = np.zeros((classes, 1), np.float32)

    def states(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (steps, hidden, words) of one direction."""
        k, (steps, n) = self.hidden, x.shape
        table, u, c = np.ascontiguousarray(self.p["X" + d].T), self.p["U" + d], self.p["c" + d]
        out = np.empty((steps, k, n), np.float32)
        h = np.zeros((k, n), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = np.take(table, x[t], axis=0).T + c
            b = u @ h
            rz = np.tanh(0.5 * (a[: 2 * k] + b[: 2 * k]))
            rz += 1
            rz *= 0.5
            r, z = rz[:k], rz[k:]
            m = np.tanh(a[2 * k :] + r * b[2 * k :])
            new = m + z * (h - m)
            if keep is not None:
                keep.append((t, h, r, z, m, b[2 * k :]))
            h = out[t] = new
        return out

    def positions(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Probabilities (steps, classes, words)."""
        kf, kb = ([], []) if keep is not None else (None, None)
        h = np.concatenate([self.states(x, "f", kf), self.states(x, "b", kb)], axis=1)
        s = self.p["V"] @ h + self.p["v"]
        s = np.exp(s - s.max(axis=1, keepdims=True))
        s /= s.sum(axis=1, keepdims=True)
        if keep is not None:
            keep.update(f=kf, b=kb, h=h)
        return s

    def gradients(self, x: np.ndarray, real: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the real positions, and its gradients through time."""
        keep: dict = {}
        k = self.hidden
        p = self.positions(x, keep)
        weight = (real / real.sum()).astype(np.float32)
        loss = float(-(np.log(p[:, y, np.arange(len(y))] + 1e-9) * weight).sum())
        p[:, y, np.arange(len(y))] -= 1
        ds = p * weight[:, None, :]
        g = {"V": np.einsum("tcn,thn->ch", ds, keep["h"]), "v": ds.sum(axis=(0, 2))[:, None]}
        dh_all = self.p["V"].T @ ds
        for i, d in enumerate("fb"):
            u = self.p["U" + d]
            dx, du, dc = np.zeros((256, 3 * k), np.float32), np.zeros_like(u), np.zeros((3 * k, 1), np.float32)
            back = np.zeros((k, x.shape[1]), np.float32)
            for t, h, r, z, m, bn in reversed(keep[d]):
                dh = dh_all[t, i * k : (i + 1) * k] + back
                dm = dh * (1 - z) * (1 - m * m)
                dz = dh * (h - m) * z * (1 - z)
                dr = dm * bn * r * (1 - r)
                da = np.concatenate([dr, dz, dm])
                db = np.concatenate([dr, dz, dm * r])
                np.add.at(dx, x[t], da.T)
                dc += da.sum(axis=1, keepdims=True)
                du += db @ h.T
                back = dh * z + u.T @ db
            g["X" + d], g["U" + d], g["c" + d] = dx.T, du, dc
        return loss, g

    def train(self, words: list[bytes], labels: np.ndarray, steps: int = 500, batch: int = 512, rate: float = 0.02, seed: int = 7) -> float:
        """Adam over shuffled batches, as many steps for few words as for many; the last epoch's mean loss."""
        epochs = max(3, -(-steps * batch // max(1, len(words))))
        order = np.random.default_rng(seed)
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, mean = 0, 0.0
        for e in range(epochs):
            losses = []
            at = order.permutation(len(words))
            for i in range(0, len(at), batch):
                b = at[i : i + batch]
                own = [words[j] for j in b]
                x, real = padded(own, max(map(len, own)) + 2)
                loss, g = self.gradients(x, real, labels[b])
                losses.append(loss)
                step += 1
                lr = rate * 0.06 ** (e / epochs)
                for k, v in g.items():
                    np.clip(v, -1, 1, out=v)
                    m1[k] += 0.1 * (v - m1[k])
                    m2[k] += 0.001 * (v * v - m2[k])
                    self.p[k] -= lr * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
            mean = float(np.mean(losses))
        return mean

    def pooled(self, words: list[bytes], chunk: int = 4096) -> np.ndarray:
        """Sums of the positions' probabilities (words, classes) of each word."""
        out = np.zeros((len(words), self.classes), np.float32)
        length = np.fromiter(map(len, words), np.int64, len(words))
        low = 0
        for steps in STEPS:
            at = np.flatnonzero((length > low) & (length <= steps - 2))
            low = steps - 2
            for i in range(0, len(at), chunk):
                b = at[i : i + chunk]
                x, real = padded([words[j] for j in b], steps)
                out[b] = np.einsum("tcn,tn->nc", self.positions(x), real.astype(np.float32))
        return out


def training_words(docs: DataFrame, train_docs: int, train_words: int) -> pd.DataFrame:
    """doc_id, lang and words of the documents to learn from: a bounded number of each language."""
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    key = F.xxhash64("doc_id")
    # cut by hash range first, so that the window below sees few rows of a frequent language
    rows = own.select("doc_id", "lang", key.alias("k"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.least(F.lit(1.0), F.lit(2.0 * train_docs + 50) / F.col("n"))
    near = rows.join(F.broadcast(counts), "lang").where((F.pmod("k", F.lit(1 << 30)) / float(1 << 30)) < share)
    ids = near.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("k", "doc_id"))).where(F.col("r") <= train_docs)
    ids = ids.select("doc_id").distinct()  # train_docs rows a language at most
    sample = docs.join(F.broadcast(ids), "doc_id", "left_semi").where("lang is not null and text is not null")
    return sample.select("doc_id", "lang", "text").mapInPandas(partial(some_words, n=train_words), "doc_id long, lang string, words array<binary>").toPandas()


def some_words(batches, n: int):
    """n words with a letter of each text, drawn from all of it."""
    for pdf in batches:
        out = []
        for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
            own = [w for w in words_of(text) if LETTER.search(w.decode("utf-8", "ignore"))]
            out.append([own[i] for i in np.random.default_rng(doc_id % (1 << 32)).permutation(len(own))[:n]])
        yield pdf[["doc_id", "lang"]].assign(words=out)


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_words: int = TRAIN_WORDS):
    """Languages and the trained network; None without labelled documents."""
    sample = training_words(docs, train_docs, train_words).sort_values(["lang", "doc_id"])
    langs = sorted(sample["lang"].unique())
    if not langs:
        return langs, None
    words = [bytes(w) for own in sample["words"] for w in own]
    labels = [langs.index(lang) for lang, own in zip(sample["lang"], sample["words"], strict=True) for _ in own]
    net = Net(len(langs))
    if words:
        net.train(words, np.array(labels))
    return langs, net


def identify(batches, shared):
    langs, net = shared.value
    for batch in (b.slice(i, ROWS) for b in batches for i in range(0, max(1, b.num_rows), ROWS)):
        lang, score = [], []
        seen: dict[bytes, int] = {}
        rows = []
        for text in batch.column("text"):
            text = text.as_py()
            ok = net is not None and text is not None and LETTER.search(text)
            own = words_of(text) if ok else []
            rows.append(np.fromiter((seen.setdefault(w, len(seen)) for w in own), np.int64, len(own)) if ok else None)
        table = net.pooled(list(seen)) if net is not None else None
        for own in rows:
            if own is None:
                lang.append("und")
                score.append(0.0)
                continue
            p = table[own].sum(axis=0, dtype=np.float64)
            p /= p.sum()
            lang.append(langs[int(p.argmax())])
            score.append(min(1.0, float(p.max())))
        own = [batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())]
        yield pa.RecordBatch.from_arrays(own, ["doc_id", "held_out", "lang_pred", "score"])


def predict(docs: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, **how))
    rows = docs.select("doc_id", "text", held_out("doc_id").alias("held_out"))
    return rows.mapInArrow(partial(identify, shared=shared), "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(table(spark, sf_dir, "documents"))
