"""Connected components of a graph of links: union-find in bounded chunks, then alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import written

#: Links that one task contracts.
CHUNK = 250_000


def components(links: DataFrame, name: str = "links", chunk: int = CHUNK) -> DataFrame:
    """id and component, the smallest id reachable, of every id that links (a, b) name. Ids of links aren't null.

    Each task contracts a chunk of links to stars around the smallest id it sees. If there is more than one chunk,
    their stars are joined: in a large star every id tells its larger neighbours its smallest one, in a small star its
    smaller ones. Both only take minima by key, so an id with very many links is aggregated before it is shuffled.
    Each round is written to the shared folder; rounds end when all links go from a member to its component's smallest id.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), name)
    n = -(-edges.count() // chunk)
    edges = written(edges.coalesce(max(1, n)).mapInArrow(contracted, "u long, v long"), name)
    while n > 1 and not stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = written(small.distinct(), name)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def contracted(batches):
    """The links of a task as stars: each id with the smallest one it is connected to in them."""
    up: dict[int, int] = {}

    def top(i: int) -> int:
        root = i
        while up.setdefault(root, root) != root:
            root = up[root]
        while up[i] != root:
            up[i], i = root, up[i]
        return root

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(u), top(v)
            if a != b:
                up[max(a, b)] = min(a, b)
    out = [(i, top(i)) for i in list(up)]
    own = np.array([(u, v) for u, v in out if u != v], np.int64).reshape(-1, 2)
    yield pa.RecordBatch.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1])], ["u", "v"])


def stars(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u."""
    twice = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("u")
    inner = edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi")
    return not twice.union(inner).head(1)
