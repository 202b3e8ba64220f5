"""The vectors nearest to some queries by their products, all rows against all queries."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

#: Vectors and queries of a group, and of those what is multiplied at once.
BLOCK, ASKED, COLUMNS, ROWS = 32_768, 8_192, 4_096, 128
#: What stands for a product that isn't known, below all others: one has no vector, a null in it or another length.
UNKNOWN = -np.finfo(float).max


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = BLOCK, asked: int = ASKED) -> DataFrame:
    """query_id, vec_id, place, similarity: of each query (query_id, q) the k vectors (vec_id, v) with the largest products, its own id left out.

    Products are compared by 9 decimals, then by vec_id; unknown ones come last. Work is quadratic, memory isn't: vectors and queries are dealt
    into blocks, each pair of blocks is a group that a task multiplies in pieces, and k rows for a query leave it. No vector is left out.
    """
    vectors, queries = vectors.where("vec_id is not null"), queries.where("query_id is not null")
    n, m = (max(1, -(-df.count() // size)) for df, size in ((vectors, block), (queries, asked)))
    dealt = lambda c, parts: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    x = vectors.select("vec_id", "v", dealt("vec_id", n).alias("part")).withColumn("deal", every(m))
    y = queries.select("query_id", "q", dealt("query_id", m).alias("deal")).withColumn("part", every(n))
    pairs = y.groupBy("part", "deal").cogroup(x.groupBy("part", "deal"))
    best = pairs.applyInArrow(partial(first, k=k), "query_id long, vec_id long, similarity double")
    w = W.partitionBy("query_id").orderBy(F.round("similarity", 9).desc(), "vec_id")
    return best.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("query_id", "vec_id", "place", "similarity")


def matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A row for each list, with zeros after its end, and the lengths; -1 for a null or a list with one."""
    own = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(own), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    n, flat = np.maximum(lengths, 0), own.flatten()
    rows = np.repeat(np.arange(len(n)), n)
    lengths[rows[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
    out = np.zeros((len(n), int(n.max(initial=0))))
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)] = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False)
    return out, lengths


def first(queries: pa.Table, vectors: pa.Table, k: int) -> pa.Table:
    """Of each query of a group the k vectors of the group that come first."""
    ids, asked = vectors["vec_id"].to_numpy(), queries["query_id"].to_numpy()
    order = np.argsort(ids, kind="stable")  # of equal products the first is the one with the smallest id
    ids, (v, n), (q, m) = ids[order], matrix(vectors["v"].take(pa.array(order))), matrix(queries["q"])
    width = max(v.shape[1], q.shape[1])
    v, q = (np.pad(a, ((0, 0), (0, width - a.shape[1]))) for a in (v, q))
    v = np.ascontiguousarray(v.T)
    own_ids = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    own_products = [np.empty(0)]
    for i in range(0, len(asked), ROWS):
        own, lengths = asked[i : i + ROWS], m[i : i + ROWS, None]
        rows = np.arange(len(own))[:, None]
        # what comes first so far: by 9 decimals, product, id
        best = np.full((len(own), k), -np.inf), np.zeros((len(own), k)), np.zeros((len(own), k), np.int64)
        for j in range(0, len(ids), COLUMNS):
            some = ids[j : j + COLUMNS]
            s = q[i : i + ROWS] @ v[:, j : j + COLUMNS]
            by = np.rint(np.multiply(s, 1e9))
            if lengths.min() < 0 or np.any(n[j : j + COLUMNS] != lengths):
                odd = (n[j : j + COLUMNS] != lengths) | (lengths < 0)
                s[odd] = by[odd] = UNKNOWN
            lo, hi = np.searchsorted(some, own), np.searchsorted(some, own, side="right")
            for r in np.flatnonzero(lo < hi):
                by[r, lo[r] : hi[r]] = -np.inf
            at = np.empty((len(own), k), np.int64)
            top = np.empty((len(own), k))
            for p in range(k):
                at[:, p] = by.argmax(1)
                top[:, p] = by[rows[:, 0], at[:, p]]
                by[rows[:, 0], at[:, p]] = -np.inf
            both = [np.concatenate(x, axis=1) for x in zip(best, (top, s[rows, at], some[at]), strict=True)]
            use = np.empty((len(own), k), np.int64)
            left = both[0].copy()
            for p in range(k):
                use[:, p] = left.argmax(1)
                left[rows[:, 0], use[:, p]] = -np.inf
            best = tuple(x[rows, use] for x in both)
        r, p = np.nonzero(best[0] != -np.inf)
        own_ids[0].append(own[r])
        own_ids[1].append(best[2][r, p])
        own_products.append(best[1][r, p])
    products = np.concatenate(own_products)
    columns = [*map(np.concatenate, own_ids), pa.array(products, pa.float64(), mask=products == UNKNOWN)]
    return pa.table(columns, names=["query_id", "vec_id", "similarity"])
