"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ..state import shared_dir

#: ASCII lower-casing, and the separators of the two word patterns.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, so that later steps don't depend on lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class WordHashes(dict):
    """64-bit hashes of words, kept for the words met last."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k values of h, in order of position."""
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = mixed(out * np.uint64(0xC2B2AE3D27D4EB4F) + h[j : j + n])
    return out


#: Bytes by the two word patterns: lower case, and a blank for what separates words.
BLANKS = np.frombuffer(bytes(32 if c == 32 or 9 <= c <= 13 else LOWER[c] for c in range(256)), np.uint8)
LINES = np.where(np.arange(256) == 10, 10, BLANKS).astype(np.uint8)
BASE = 0xA24BAED4963EE407
SLICE, ROWS = 1_000_000, 1024


class Powers:
    """Powers of BASE and of its inverse modulo 2^64."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, SLICE)
            for name, x in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                own = np.full(n, x, np.uint64)
                own[0] = 1
                setattr(cls, name, np.multiply.accumulate(own))
        return cls.up, cls.down


def word_slices(column: pa.Array, lookup: np.ndarray = BLANKS, most: int = SLICE):
    """The words of a column of texts, some rows at a time: first and end row, row and hash of each word, bytes, begins, row offsets.

    If lookup keeps line ends, they separate words too. A slice has `most` bytes or one row. A word's hash is its polynomial in BASE, whatever its place is.
    """
    for at in range(0, len(column), ROWS):  # so that little is copied at a time
        for r, to, *own in _slices(column.slice(at, ROWS).fill_null("").cast(pa.large_string()), lookup, most):
            yield at + r, at + to, *own


def _slices(column: pa.LargeStringArray, lookup: np.ndarray, most: int):
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    own_lookup = lookup.tobytes()
    r = 0
    while r < len(column):
        to = max(r + 1, int(np.searchsorted(offsets, offsets[r] + most, side="right")) - 1)
        own = offsets[r : to + 1] - offsets[r]
        b = np.frombuffer(data[offsets[r] : offsets[to]].tobytes().translate(own_lookup), np.uint8)
        n = len(b)
        word = b != 32
        if lookup[10] == 10:
            word &= b != 10
        begin, end = word.copy(), word.copy()
        begin[1:] &= ~word[:-1]
        end[:-1] &= ~word[1:]
        edge = own[1:-1]
        edge = edge[(edge > 0) & (edge < n)]
        begin[edge] = word[edge]
        end[edge - 1] = word[edge - 1]
        begins, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        up, down = Powers.to(n + 1)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.add(b, np.uint64(1), out=sums[1:], dtype=np.uint64)
        sums[1:] *= up[:n]
        np.cumsum(sums[1:], out=sums[1:])
        h = (sums[ends] - sums[begins]) * down[begins]
        h = mixed(h + (ends - begins).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        rows = np.repeat(np.arange(to - r), np.diff(np.searchsorted(begins, own)))
        yield r, to, rows, h, b, begins, own
        r = to


def spans(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes of the sequences of values of h that begin at starts, each as long as to the next."""
    up, down = Powers.to(len(h) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)])])
    ends = np.append(starts[1:], len(h))
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


#: Odd factors of a shingle's words.
FACTORS = [pow(0xC2B2AE3D27D4EB4F, j + 1, 1 << 64) | 1 for j in range(64)]


def combined(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k word hashes, in order of position."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out += h[j : j + n] * np.uint64(FACTORS[j])
    return mixed(out)


def shingle_sets(column: pa.Array, k: int = 5):
    """Of each text the sorted distinct hashes of its k-word shingles; one of all words if it has fewer than k."""
    for r, to, rows, h, *_ in word_slices(column):
        count = np.bincount(rows, minlength=to - r)
        first = np.cumsum(count) - count
        all_ = combined(h, k)
        for f, n in zip(first.tolist(), count.tolist(), strict=True):
            if n >= k:
                s = np.sort(all_[f : f + n - k + 1])
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                yield s[keep]
            else:
                yield combined(h[f : f + n], n) if n else h[:0]
