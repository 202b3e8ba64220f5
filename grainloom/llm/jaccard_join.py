"""Documents whose sets of word shingles have a Jaccard similarity of 3/4 or more, by T-occurrence search.

Two sets of n and m shingles link if they share T = ceil(3 (n + m) / 7) or more. As in DivideSkip, a document's
lists are divided: the long lists are those of its L most frequent shingles, L = ceil(3 n / 4) - 1, the short ones are
the rest. Inverted lists are stored in blocks of about BLOCK documents of similar size. A task merges a document's short
lists by a heap, counts how often each other document occurs, and retains those that can still reach T with what comes
after their last occurrence in both (T - L occurrences or more, by position). For these, all shingles, the long lists'
included, are probed by binary search.

What the corpus may hold much of is kept out of the pairs, and no link is lost:
- documents with equal sets are one document, the one with the smallest id;
- shingles in very many documents (counted over the whole corpus) come last in the common order, so they are long
  lists; the order decides what is merged and what is probed, never the result;
- since a component is asked for, documents that are known to be in one component need no link between them: in a
  few rounds each document is compared with a leader of a list it shares, the one whose lists are longest at first,
  and then the rest, of different components, are searched as above.

Defined cases: null or blank text has no shingles and links with nothing; a text of fewer than five words has one
shingle; equal sets link; a row without an id has no component; rows that repeat an id and its text are one document,
rows that repeat only the id are taken by their texts; an empty table gives an empty result; extra columns are ignored.
Shingles are compared by 64-bit hashes, sets by 128-bit hashes.
"""

from __future__ import annotations

import heapq
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import mixed, shingle_sets, table, written
from .components import components

SHINGLE = 5
#: Shingles with more documents than HOT are put last, MOST_HOT of them at most (3 MB to each task).
HOT, MOST_HOT = 24, 200_000
#: Shingles counted together in a task; what occurs less than twice in such a chunk isn't a candidate for HOT.
CHUNK = 1_500_000
#: Rounds in which documents are compared with one member of a list.
ROUNDS = 2
#: Documents in a block of an inverted list, about.
BLOCK = 256
#: Buckets of ids by which texts are filtered before they are shuffled.
BUCKETS = 1 << 20


def threshold(n: int) -> int:
    """Least overlap of a set of n with any set it links with."""
    return (3 * n + 3) // 4


def frequent(batches, k: int):
    """Shingles with 3 documents or more in a chunk of a task's rows, with their numbers."""
    sets, seen, total = [], set(), 0

    def counted():
        t, n = np.unique(np.concatenate(sets), return_counts=True)
        ok = n > 2
        return pa.RecordBatch.from_arrays([pa.array(t[ok].view(np.int64)), pa.array(n[ok])], ["t", "n"])

    for batch in batches:
        for s in shingle_sets(batch.column(0), k):
            sign = xxhash.xxh3_64_intdigest(s.tobytes())
            if not len(s) or sign in seen:
                continue
            seen.add(sign)
            sets.append(s)
            total += len(s)
            if total >= CHUNK:
                yield counted()
                sets, total = [], 0
                seen.clear()
    if sets:
        yield counted()


def hot_shingles(docs: DataFrame, k: int, hot: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    rows = docs.select("text").mapInArrow(partial(frequent, k=k), "t long, n long").groupBy("t").agg(F.sum("n").alias("n"))
    rows = rows.where(F.col("n") > hot).orderBy(F.desc("n"), "t").limit(most).toPandas()
    t, n = rows["t"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    order = np.argsort(t)
    return t[order], n[order]


def sketch(s: np.ndarray) -> bytes:
    """Parities of the numbers of shingles by buckets, a power of two and 2 n or more."""
    n = max(256, 1 << (2 * len(s) - 1).bit_length())
    at = mixed(s ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(n - 1)
    return np.packbits(np.bincount(at.view(np.int64), minlength=n) & 1).tobytes()


def differing(x: bytes, y: bytes) -> int:
    """Bits that differ; the longer sketch is folded to the other's buckets."""
    p, q = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    while len(q) > len(p):
        q = q[: len(q) // 2] ^ q[len(q) // 2 :]
    return int(np.bitwise_count(p ^ q).sum())


def possible(batches):
    """The pairs (a, b, na, nb, sketches) whose sketches don't rule out a link."""
    for batch in batches:
        n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
        bits = np.fromiter((differing(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)), np.int64, len(n))
        keep = pa.array(7 * bits <= n)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])


def indexed(batches, k: int, hot):
    """Of each document: n, the hash of its set (s1, s2), its sketch, and its short lists: shingles in order, less the long lists.

    In a batch, copies of a set have their short lists once, with the first row that has an id.
    """
    tokens, counts = hot.value
    for batch in batches:
        n, s1, s2, short, sketches, seen = [], [], [], [], [], set()
        for s, known in zip(shingle_sets(batch.column(1), k), batch.column(0).is_valid().to_pylist(), strict=True):
            d = xxhash.xxh3_128_digest(s.tobytes())
            own = s[:0]
            if known and len(s) and d not in seen:
                seen.add(d)
                own = s
                if len(tokens):
                    at = np.searchsorted(tokens, s)
                    at[at == len(tokens)] = 0
                    common = np.where(tokens[at] == s, counts[at], 0)
                    if common.any():
                        own = s[np.lexsort((s, common))]
                own = own[: len(s) - threshold(len(s)) + 1]
            n.append(len(s))
            s1.append(int.from_bytes(d[:8], "little", signed=True))
            s2.append(int.from_bytes(d[8:], "little", signed=True))
            short.append(own.view(np.int64))
            sketches.append(sketch(s) if known and len(s) else None)
        kinds = [pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64())]
        lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, short)], dtype=np.int32), np.concatenate([*short, np.empty(0, np.int64)]))
        yield pa.RecordBatch.from_arrays([batch.column(0), *kinds, lists, pa.array(sketches, pa.binary())], ["doc_id", "n", "s1", "s2", "short", "sketch"])


def probed(batches, k: int):
    """The pairs (a, b) that link: the smaller set's shingles are searched in the larger one, by halves."""
    for batch in batches:
        ok = []
        for p, q in zip(shingle_sets(batch.column(2), k), shingle_sets(batch.column(3), k), strict=True):
            if len(p) > len(q):
                p, q = q, p
            at = np.searchsorted(q, p)
            at[at == len(q)] = 0
            both = int((q[at] == p).sum()) if len(p) else 0
            ok.append(both > 0 and 100 * both >= 75 * (len(p) + len(q) - both))
        keep = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])


def compared(pairs: DataFrame, docs: DataFrame, own: DataFrame, k: int) -> DataFrame:
    """The pairs (a, b) that link. Only texts of pairs that the sketches don't rule out are shuffled, by buckets of ids."""
    x, y = (own.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab")
    pairs = pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(possible, "a long, b long")
    pairs = written(pairs.distinct(), "shingle-possible")
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int").alias("bucket")
    used = pairs.select(bucket("a")).union(pairs.select(bucket("b"))).distinct()  # BUCKETS rows at most
    texts = docs.select("doc_id", "text", bucket("doc_id")).join(F.broadcast(used), "bucket", "left_semi")
    one = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(partial(probed, k=k), "a long, b long")


def alike_sizes(n: Column, m: Column) -> Column:
    return (4 * n >= 3 * m) & (4 * m >= 3 * n)


def jaccard_components(docs: DataFrame, k: int = SHINGLE, hot: int = HOT, most_hot: int = MOST_HOT, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_shingles and component_id of each document."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(hot_shingles(docs, k, hot, most_hot))
    index = docs.select("doc_id", "text").mapInArrow(partial(indexed, k=k, hot=shared), "doc_id long, n long, s1 long, s2 long, short array<long>, sketch binary")
    index = written(index, "shingle-index")
    own = index.where("n > 0 and doc_id is not null")
    first = own.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"))
    # lists with two sets or more
    tokens = own.where(F.size("short") > 0).select("s1", "s2", "n", F.posexplode("short").alias("i", "t"))
    by_t = W.partitionBy("t")
    tokens = tokens.withColumns({"lo": F.min("s1").over(by_t), "hi": F.max("s1").over(by_t), "k": F.count(F.lit(1)).over(by_t)}).where("lo != hi")
    lists = written(tokens.join(first, ["s1", "s2"]).groupBy("t", "rep", "n", "i").agg(F.max("k").alias("k")), "shingle-lists")
    weight = lists.groupBy("rep").agg(F.sum("k").alias("weight"))
    links = comp = None
    for r in range(rounds + 1):
        entries = lists.select("t", "rep", "n", "i", "k")
        if comp is None:
            entries = entries.withColumn("c", F.col("rep"))
        else:
            # of what is left, only lists that still have two components
            entries = entries.join(comp, entries["rep"] == comp["id"], "left").select("t", "rep", "n", "i", "k", F.coalesce("component", "rep").alias("c"))
            entries = entries.withColumns({"lo": F.min("c").over(by_t), "hi": F.max("c").over(by_t)}).where("lo != hi").drop("lo", "hi")
            entries = written(entries, "shingle-lists")
            lists = entries
        if r < rounds:
            order = F.col("weight") if r == 0 else F.xxhash64(F.lit(r), "rep", "t")
            pairs = one_each(entries.join(weight, "rep") if r == 0 else entries, order, r)
        else:
            pairs = remaining(entries)
        pairs = written(pairs, "shingle-pairs")
        if not pairs.head(1):
            continue
        new = written(compared(pairs, docs, own, k), "shingle-links")
        links = new if links is None else links.unionByName(new)
        comp = components(links, "shingle-components")
    groups = own.select("doc_id", "s1", "s2").join(first, ["s1", "s2"])
    if comp is not None:
        groups = groups.join(comp, groups["rep"] == comp["id"], "left").select("doc_id", "s1", "s2", F.coalesce("component", "rep").alias("component_id"))
    else:
        groups = groups.select("doc_id", "s1", "s2", F.col("rep").alias("component_id"))
    empty = index.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).alias("component_id"))
    sized = own.groupBy("s1", "s2").agg(F.first("n").alias("n_shingles"))
    return groups.join(sized, ["s1", "s2"]).select("doc_id", "n_shingles", "component_id").union(empty)


def one_each(entries: DataFrame, order: Column, r: int) -> DataFrame:
    """For each document one other of about its size, of another component, that leads most of the lists they share."""
    leader = entries.groupBy("t").agg(F.max_by(F.struct("rep", "n", "c"), F.struct(order, "rep")).alias("lead"))
    pairs = entries.join(leader, "t").where((F.col("c") != F.col("lead.c")) & alike_sizes(F.col("n"), F.col("lead.n")))
    pairs = pairs.groupBy(F.col("rep").alias("a"), F.col("lead.rep").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    best = pairs.groupBy("a").agg(F.max(F.struct("shared", F.xxhash64(F.lit(r), "b").alias("h"), "b")).alias("best"))
    return best.select("a", F.col("best.b").alias("b"))


def reaches(n, m, i):
    """Whether sets of n and m can share T if the first one they share is at i of the n."""
    return 7 * (n - i) >= 3 * (n + m)


def blocks(entries: DataFrame) -> DataFrame:
    """Inverted lists in blocks: t, least and greatest size, and the documents (rep, n, c, i), for those found by t."""
    size = F.floor(F.log("n") * 8)  # sizes that differ by an eighth at most
    part = F.pmod(F.xxhash64("rep"), F.ceil(F.col("k") / BLOCK))
    found = entries.where(reaches(F.col("n"), F.col("n"), F.col("i")))
    found = found.groupBy("t", size.alias("size"), part.alias("part")).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.collect_list(F.struct("rep", "n", "c", "i")).alias("docs"))
    return found.select("t", "low", "high", "docs")


def remaining(entries: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components, b the smaller set, whose merged short lists don't rule out that they share T."""
    search = entries.select("t", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca"), F.col("i").alias("ia"))
    n, c, i = F.col("na"), F.col("ca"), F.col("ia")

    def found(d: Column) -> Column:
        smaller = (d["n"] < n) | ((d["n"] == n) & (d["rep"] < F.col("a")))
        return smaller & (d["c"] != c) & (4 * d["n"] >= 3 * n) & reaches(n, d["n"], i) & (7 * (d["n"] - d["i"]) >= 3 * (n + d["n"]))

    rows = search.join(blocks(entries), "t").where((F.col("low") <= n) & (4 * F.col("high") >= 3 * n) & reaches(n, F.col("low"), i))
    docs = F.array_sort(F.transform(F.filter("docs", found), lambda d: F.struct(d["rep"].alias("b"), d["n"].alias("nb"), d["i"].alias("ib"))))
    rows = rows.select("a", "na", "ia", docs.alias("docs")).where(F.size("docs") > 0)
    return rows.repartition("a").sortWithinPartitions("a").mapInArrow(merged, "a long, b long")


def merged(batches):
    """Rows (a, na, ia, docs) in order of a, docs in order of b: pairs that can share T by the occurrences of b in a's lists.

    Only the lists of one document are held at a time.
    """
    a, lists, out = None, [], []
    for batch in batches:
        docs = batch.column(3)
        ends = docs.offsets.to_numpy()
        b, nb, ib = (docs.values.field(j).to_numpy() for j in range(3))
        for r, (own, na, ia) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True)):
            if own != a:
                out += occurring(a, lists)
                a, lists = own, []
            at = slice(ends[r], ends[r + 1])
            lists.append([(x, na, y, ia, z) for x, y, z in zip(b[at].tolist(), nb[at].tolist(), ib[at].tolist(), strict=True)])
        if len(out) >= 10_000:
            yield links(out)
            out = []
    yield links(out + occurring(a, lists))


def occurring(a: int | None, lists: list) -> list:
    out, last, times, end, sizes = [], None, 0, (0, 0), (0, 0)

    def kept() -> bool:
        return last is not None and 7 * (times + min(sizes[0] - end[0], sizes[1] - end[1]) - 1) >= 3 * sum(sizes)

    for b, na, nb, ia, ib in heapq.merge(*lists):
        if b != last:
            if kept():
                out.append((a, last))
            last, times, end, sizes = b, 0, (0, 0), (na, nb)
        times += 1
        end = max(end, (ia, ib))
    if kept():
        out.append((a, last))
    return out


def links(pairs: list) -> pa.RecordBatch:
    own = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1])], ["a", "b"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


#: Shingles as words joined by blanks; pairs with a shared shingle, then reachability.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS t
      FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
r AS (SELECT doc_id AS a, doc_id AS c FROM d UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(c) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""
