"""Benchmark decontamination as a prefix-filtered containment join.

A window is WINDOW consecutive words of a benchmark item, or all words of a shorter one. A document contains a
window only if it contains all of the window's shingles, so the necessary prefix is the window's rarest shingle:
shingles are ordered by how often they occur in the whole corpus, document positions are joined with the rarest
shingles only, positional and length bounds place the window around the match, and all its words are compared.

The distinct windows of the benchmark go to every task. A block of items holds BLOCK_CHARS characters at most (or one
item) and is the only one that the driver holds; a larger benchmark is cut into blocks by item id, and the blocks
follow each other in one pass over the documents, after a pass each for the counts.

Defined cases: null or empty text has no words and no hits; items without an id or without words are left out;
items repeated with their id count once; repeated documents give repeated rows; empty tables work; extra columns
are ignored. A document is contaminated if it has hits and they are a twentieth of its words or more.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import ALNUM, mixed, runs, table

WINDOW = 13
SHINGLE = 4
BLOCK_CHARS = 16_000_000
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
STATE = "_spans binary, _items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(ALNUM).split() if text else []


class Windows:
    """The windows of some items: words are numbered from 1, a word that no item has is 0."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW, shingle: int = SHINGLE):
        self.ids: dict[bytes, int] = {}
        self.items: list[str] = []
        rows: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for item, text in items:
            own = words_of(text)
            if not own:
                continue
            w = np.fromiter((self.ids.setdefault(x, len(self.ids) + 1) for x in own), np.int32, len(own))
            k = min(window, len(w))
            rows.setdefault(k, []).append((w, np.int32(len(self.items))))
            self.items.append(item)
        #: by window length: words of each distinct window, where its items begin, the items
        self.words, self.first, self.item = {}, {}, {}
        for k, own in rows.items():
            all_ = np.concatenate([np.lib.stride_tricks.sliding_window_view(w, k) for w, _ in own])
            of = np.repeat(np.array([i for _, i in own], np.int32), [len(w) - k + 1 for w, _ in own])
            by = np.lexsort(all_.T[::-1])
            all_, of = all_[by], of[by]
            starts = np.flatnonzero(np.append(True, (all_[1:] != all_[:-1]).any(axis=1)))
            self.words[k], self.first[k], self.item[k] = all_[starts], np.append(starts, len(of)), of
        self.shingle = shingle
        #: by shingle length: the distinct shingles of all windows
        codes: dict[int, list[np.ndarray]] = {}
        for k, w in self.words.items():
            codes.setdefault(min(shingle, k), []).append(np.unique(self.codes_in(w, min(shingle, k))))
        self.codes = {s: np.unique(np.concatenate(v)) for s, v in codes.items()}

    @staticmethod
    def codes_in(windows: np.ndarray, s: int) -> np.ndarray:
        """Hashes of the shingles of windows, a row for each window."""
        w = mixed(windows.astype(np.uint64))
        n = w.shape[1] - s + 1
        out = np.full((len(w), n), s, np.uint64)
        for j in range(s):
            out = mixed(out * np.uint64(0xC2B2AE3D27D4EB4F) + w[:, j : j + n])
        return out

    def numbers(self, text: str | None) -> np.ndarray:
        w = words_of(text)
        return np.fromiter(map(self.ids.get, w, repeat(0)), np.int64, len(w))

    def found(self, numbers: np.ndarray, s: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of a document's shingles that are in codes, and where in codes."""
        if len(numbers) < s or not len(codes):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        known = numbers > 0
        at = np.flatnonzero(known[: len(numbers) - s + 1])
        for j in range(1, s):
            at = at[known[at + j]]
        code = runs(mixed(numbers.astype(np.uint64)), s)[at] if 4 * len(at) > len(numbers) else self.at(numbers, at, s)
        to = np.searchsorted(codes, code)
        to[to == len(codes)] = 0
        ok = codes[to] == code
        return at[ok], to[ok]

    @staticmethod
    def at(numbers: np.ndarray, at: np.ndarray, s: int) -> np.ndarray:
        """Codes of the shingles that begin at the given positions."""
        if not len(at):
            return np.empty(0, np.uint64)
        around = mixed(numbers[at[:, None] + np.arange(s)].astype(np.uint64))
        out = np.full(len(at), s, np.uint64)
        for j in range(s):
            out = mixed(out * np.uint64(0xC2B2AE3D27D4EB4F) + around[:, j])
        return out

    def order(self, counts: dict[int, np.ndarray]) -> None:
        """Chooses each window's rarest shingle, the first of equals; counts: of the corpus, by shingle length."""
        self.prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for k, w in self.words.items():
            s = min(self.shingle, k)
            to = np.searchsorted(self.codes[s], self.codes_in(w, s))
            offset = np.argmin(counts[s][to], axis=1)
            code = self.codes[s][to[np.arange(len(w)), offset]]
            by = np.argsort(code, kind="stable")
            distinct, first = np.unique(code[by], return_index=True)
            self.prefix[k] = distinct, np.append(first, len(by)), by, offset

    def hits(self, numbers: np.ndarray) -> tuple[np.ndarray, set[int]]:
        """Spans (start, end) of the windows that occur in a document, and their items."""
        spans, items = [], set()
        for k, (distinct, first, by, offset) in self.prefix.items():
            at, to = self.found(numbers, min(self.shingle, k), distinct) if len(numbers) >= k else ((), ())
            if not len(at):
                continue
            many = first[to + 1] - first[to]
            window = by[np.repeat(first[to], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
            start = np.repeat(at, many) - offset[window]
            ok = (start >= 0) & (start + k <= len(numbers))
            start, window = start[ok], window[ok]
            same = np.ones(len(start), bool)
            for j in range(k):
                same[same] = numbers[start[same] + j] == self.words[k][window[same], j]
            start = start[same]
            spans.append(np.stack([start, start + k], axis=1))
            for x in np.unique(window[same]).tolist():
                items.update(self.item[k][self.first[k][x] : self.first[k][x + 1]].tolist())
        return np.concatenate(spans) if spans else np.empty((0, 2), np.int64), items


def digest(doc_ids, n_words, spans, items) -> pa.RecordBatch:
    hit, count, sha = [], [], []
    for n, s, own in zip(n_words, spans, items, strict=True):
        edge = np.bincount(s[:, 0], minlength=n + 1) - np.bincount(s[:, 1], minlength=n + 1)
        hit.append(int((np.cumsum(edge) > 0).sum()))
        count.append(len(own))
        sha.append(hashlib.sha256(",".join(sorted(own)).encode()).hexdigest())
    bad = [h > 0 and 20 * h >= n for h, n in zip(hit, n_words, strict=True)]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((doc_ids, n_words, hit, count, sha, bad), kinds, strict=True)], names)


def corpus_counts(docs: DataFrame, shared) -> dict[int, np.ndarray]:
    """How often each shingle of the windows occurs in all documents."""

    def count(batches):
        w: Windows = shared.value
        totals = {s: np.zeros(len(c), np.int64) for s, c in w.codes.items()}
        for batch in batches:
            for text in batch.column(0):
                numbers = w.numbers(text.as_py())
                for s, codes in w.codes.items():
                    totals[s] += np.bincount(w.found(numbers, s, codes)[1], minlength=len(codes))
        for s, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), s)), pa.array(at), pa.array(total[at])], ["s", "at", "n"])

    rows = docs.select("text").mapInArrow(count, "s long, at long, n long").groupBy("s", "at").agg(F.sum("n").alias("n"))
    out = {s: np.zeros(len(c), np.int64) for s, c in shared.value.codes.items()}
    for r in rows.toLocalIterator():  # as many rows as the block has shingles at most
        out[r["s"]][r["at"]] = r["n"]
    return out


def blocks(benchmark: DataFrame, block_chars: int):
    """How many blocks of items there are, and a function that fetches one of them."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("id"), "text")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars // block_chars))
    return n, lambda b: [(r["id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("id"), F.lit(n)) == b).distinct().collect()]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_chars: int = BLOCK_CHARS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each document, and the columns to keep."""
    spark = docs.sparkSession
    n_blocks, block = blocks(benchmark, block_chars)
    rows = docs.select("doc_id", "text", *(F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep) if c not in ("doc_id", "text")))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    with_text = "text" in keep
    for b in range(n_blocks):
        windows = Windows(block(b), window, shingle)
        counts = corpus_counts(docs, spark.sparkContext.broadcast(windows)) if windows.codes else {}
        windows.order(counts)
        last = b == n_blocks - 1
        own = [f for f in rows.schema.fields if f.name.startswith("_keep_") or f.name == "text" and with_text]
        more = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in own)
        rows = rows.mapInArrow(scan(spark.sparkContext.broadcast(windows), b == 0, last, [f.name for f in own]), SCHEMA + more if last else f"{kept}, {STATE}")
    return rows.withColumnsRenamed({f"_keep_{i}": c for i, c in enumerate(keep)})


def scan(shared, first: bool, last: bool, keep: list[str]):
    def run(batches):
        w: Windows = shared.value
        for batch in batches:
            ids = batch.column(0)
            texts = batch.column(1).to_pylist()
            n_words, spans, items = [], [], []
            for row, text in enumerate(texts):
                numbers = w.numbers(text)
                s, own = w.hits(numbers)
                own = {w.items[i] for i in own}
                if not first:
                    s = np.concatenate([np.frombuffer(batch.column("_spans")[row].as_py(), np.int64).reshape(-1, 2), s])
                    own |= set(batch.column("_items")[row].as_py())
                n_words.append(len(numbers))
                spans.append(s)
                items.append(own)
            if last:
                out = digest(ids, n_words, spans, items)
                yield pa.RecordBatch.from_arrays([*out.columns, *(batch.column(n) for n in keep)], [*out.schema.names, *keep])
            else:
                state = [pa.array([np.unique(s, axis=0).tobytes() for s in spans], pa.binary()), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
                names = [n for n in batch.schema.names if n not in ("_spans", "_items")]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *state], [*names, "_spans", "_items"])

    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: By words in DuckDB: each position of a document whose next k words are those of a window.
ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bk AS (SELECT DISTINCT item_id, w, least(13, len(w)) AS k FROM bw WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS t
         FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM bk)),
ks AS (SELECT DISTINCT k FROM bk),
pos AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS t
        FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k)),
hit AS (SELECT p.doc_id, p.k, p.i, w.item_id FROM pos p JOIN wins w ON p.k = w.k AND p.t = w.t),
per AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256,
       coalesce(p.n_hit, 0) > 0 AND 20 * coalesce(p.n_hit, 0) >= len(d.w) AS contaminated
FROM dw d LEFT JOIN per p USING (doc_id) LEFT JOIN its t USING (doc_id)
"""
