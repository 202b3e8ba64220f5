"""Fuzzy deduplication of lines across documents.

A line is normalised (A-Z in lower case, one blank between words), and two lines are alike if their edit similarity,
1 - (word edits / words of the longer line), is SIMILAR or more. Of each connected group of lines the occurrence with
the smallest (doc_id, position) stays.

Candidates come from SimHash fingerprints joined on blocks. With equal weights, lines at 0.75 differ in about 15 of 64
bits, which no blocks of use find (recall 0.05 was measured). So a line has PRINTS fingerprints in which words have
random weights that fall steeply, frequent words' more so: the heaviest word of a block outweighs all others and alone
decides the block's bits, as in weighted min-wise hashing, and BLOCKS blocks are joined together. Lines that are alike
meet in one of the fingerprints with probabilities that README.md states; lines of few different words, and lines that
share frequent words only, are found less often. That is the operator's recall; what meets is never cut. Candidates whose numbers of words differ too
much, or whose sketches (parities of words by 1024 buckets) differ in more than 2 bits for each edit that is allowed,
can't be alike; all others are verified by their words.

Equal lines, by 128-bit hashes, are one line before anything is joined. Lists of few lines give all their pairs at once. In longer
ones, lines known to be in one group need no further link, so each line is first compared with one leader of a list it is in, for as
many rounds as the lists are long and links are found, and then all remaining pairs of different groups are verified. No list is cut and no line is left out.

Defined cases: lines end at \\n; blank lines always stay; a null text stays null; a document without an id stays as
it is and its lines aren't compared; rows that repeat an id are one document; an empty table gives an empty result;
other columns pass through, but for those named n_lines or n_dropped, which the results replace.
"""

from __future__ import annotations

from functools import partial, reduce
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import LINES as LINE_BYTES, mixed, partitions, spans, table, word_slices, written
from .components import components

SIMILAR = 0.75
#: Rounds in which lines are compared with leaders, at most; after the first, as long as all pairs would be over DENSE times the entries of lists.
ROUNDS, DENSE = 8, 2
#: A round of leaders is followed by another one if one of so many comparisons found a link.
LEAST_FOUND = 8
#: Fingerprints of a line, and blocks of each that are joined together.
PRINTS, BLOCKS = 14, 3
#: A word's weight is (its share of all words / COMMON) to the power -STEEP, 1 at most, and 1 if it is met fewer than RARE times; no more than 1 / COMMON words can weigh less (8 MB to each task).
COMMON, RARE, STEEP = 2e-6, 50, 0.75
#: Words that a task counts together.
CHUNK = 1_500_000
#: Lines of a task that are remembered, a power of two, so that their copies have no keys again.
SEEN = 1 << 20
#: One document of so many is looked at for keys that very many lines have; a key is hot if that many of these lines have it, and the HOT_MOST hottest are known to each task.
HOT_SAMPLE, HOT_LINES, HOT_MOST = 64, 500, 10_000
#: Parts into which the lines of a hot key are dealt.
SALTS = 256
#: Numbers of 64 bits in a line's sketch.
SKETCH = 16
#: Buckets of hashes by which lines are filtered before they are shuffled: half a megabyte of bits.
BUCKETS = 1 << 22
#: Lists of so many lines at most give all their pairs at once; longer ones are compared with leaders first.
FEW = 8
#: Rows of numbers that a task collects before it deals them out in blocks.
PACK = 1 << 20
#: Bytes of text whose words are found together.
SLICE = 1 << 17
BLOCK = "part int, rows binary"
LINES = "h1 long, h2 long, doc_id long, pos int, gone boolean"


def packed(part: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """Rows of 64-bit numbers as one block of bytes for each part, so that Spark shuffles blocks in place of rows."""
    order = np.argsort(part.astype(np.int32), kind="stable")
    part, rows = part[order].astype(np.int32), np.stack([np.asarray(c).view(np.int64) for c in columns], 1)[order]
    starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.empty(0, np.int64)
    offsets = (np.append(starts, len(part)) * 8 * len(columns)).astype(np.int32)
    blocks = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])
    return pa.RecordBatch.from_arrays([pa.array(part[starts]), blocks], ["part", "rows"])


def unpacked(batches):
    """The numbers of each part, from blocks in the order of their parts."""
    last, own = None, []
    for batch in batches:
        for part, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if part != last and own:
                yield last, np.concatenate(own)
                own = []
            last = part
            own.append(np.frombuffer(rows.as_buffer(), np.int64).copy())
    if own:
        yield last, np.concatenate(own)


def dealt(blocks: DataFrame) -> DataFrame:
    """Each part's blocks in one partition, together."""
    n = partitions(blocks.sparkSession)
    return blocks.repartitionById(n, F.col("part") % n).sortWithinPartitions("part")


def sketches(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each line SKETCH numbers: whether the number of its words in a bucket is odd, by bits."""
    ends = np.append(starts[1:], len(h))
    at = mixed(h ^ np.uint64(0x94D049BB133111EB)) & np.uint64(64 * SKETCH - 1)
    line = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(h))))
    out = np.zeros(len(starts) * SKETCH, np.uint64)
    np.bitwise_xor.at(out, line * SKETCH + (at >> np.uint64(6)).view(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out.view(np.int64).reshape(-1, SKETCH)


def line_starts(b: np.ndarray, begins: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words that lines begin with, and the positions of these lines in their texts."""
    ends = np.flatnonzero(b == 10)
    starts = np.unique(np.searchsorted(begins, np.concatenate([offsets[:-1], ends])))
    if len(starts) and starts[-1] == len(begins):
        starts = starts[:-1]
    at = begins[starts]
    return starts, np.searchsorted(ends, at) - np.searchsorted(ends, offsets)[np.searchsorted(offsets, at, side="right") - 1]


def located(batches, parts: int):
    """Blocks of h1, h2, doc_id, pos, gone of lines that aren't blank, and of all words with their numbers, as word 0 the number of all, in the parts that follow.

    Of equal lines that a task has together all but the first are gone and needn't be compared again; the rest are dealt by h1.
    """
    lines: list = []
    words: list = []

    def line_blocks():
        h1, h2, doc, pos = (np.concatenate(x) for x in zip(*lines, strict=True))
        lines.clear()
        gone = later(h1, h2, doc, pos)
        part = np.where(gone, mixed(doc.view(np.uint64)), h1.view(np.uint64)) >> np.uint64(20)
        return packed(part % np.uint64(parts), h1, h2, doc, pos, gone.astype(np.int64))

    def word_blocks():
        own = pc.value_counts(pa.array(np.concatenate(words).view(np.int64)))
        words.clear()
        t, n = (np.append(own.field(i).to_numpy(), x) for i, x in enumerate((0, n_words)))
        return packed((t.view(np.uint64) >> np.uint64(20)) % np.uint64(parts) + np.uint64(parts), t, n)

    n_lines = n_words = 0
    for batch in batches:
        for r, _, rows, h, b, begins, offsets in word_slices(batch.column(1), LINE_BYTES, SLICE):
            if not len(h):
                continue
            starts, pos = line_starts(b, begins, offsets)
            doc = batch.column(0).take(pa.array(r + rows[starts])).to_numpy().astype(np.int64)
            lines.append((spans(h, starts).view(np.int64), spans(mixed(h ^ np.uint64(0x5851F42D4C957F2D)), starts).view(np.int64), doc, pos.astype(np.int64)))
            words.append(h)
            n_lines, n_words = n_lines + len(starts), n_words + len(h)
            if n_lines >= PACK // 4:
                yield line_blocks()
                n_lines = 0
            if n_words >= CHUNK:
                yield word_blocks()
                n_words = 0
    if lines:
        yield line_blocks()
    if words:
        yield word_blocks()


def later(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Which lines have an equal one at a smaller doc and pos."""
    order = np.lexsort((pos, doc, h2, h1))
    new = np.append(True, (h1[order[1:]] != h1[order[:-1]]) | (h2[order[1:]] != h2[order[:-1]]))
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    out = np.empty(len(h1), bool)
    out[order] = (doc[order] != doc[first]) | (pos[order] != pos[first])
    return out


def known(batches, parts: int):
    """Lines by where they are: gone, or the first of their text. Without a place, as h1 and h2, words met more than RARE times, as word 0 all, and their numbers."""
    for part, own in unpacked(batches):
        if part < parts:
            h1, h2, doc, pos, gone = own.reshape(-1, 5).T.copy()
            gone = gone.astype(bool)
            left = np.flatnonzero(~gone)
            if len(left):
                gone[left] = later(h1[left], h2[left], doc[left], pos[left])
            own = [pa.array(doc), pa.array(pos, pa.int32()), pa.array(gone)]
        else:
            t, n = own.reshape(-1, 2).T.copy()
            order = np.argsort(t)
            t, n = t[order], n[order]
            starts = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            h1, h2 = t[starts], np.add.reduceat(n, starts)
            use = (h1 == 0) | (h2 > RARE)
            h1, h2 = h1[use], h2[use]
            own = [pa.nulls(len(h1), kind) for kind in (pa.int64(), pa.int32(), pa.bool_())]
        yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), *own], ["h1", "h2", "doc_id", "pos", "gone"])


def read(rows: DataFrame) -> DataFrame:
    """What known() says of the lines and words of rows, which have doc_id and text."""
    parts = partitions(rows.sparkSession)
    blocks = rows.select("doc_id", "text").mapInArrow(partial(located, parts=parts), BLOCK)
    return written(dealt(blocks).mapInArrow(partial(known, parts=parts), LINES), "lines")


def memory() -> np.ndarray:
    """What a task remembers of lines: the hash of the last one in each slot, at first of none."""
    return ~np.arange(SEEN, dtype=np.uint64)


def unseen(h1: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Which lines are the first of their text in what a task remembers."""
    at = (h1 & np.uint64(len(seen) - 1)).astype(np.int64)
    new = np.flatnonzero(seen[at] != h1)
    new = new[np.unique(h1[new], return_index=True)[1]]
    seen[at[new]] = h1[new]
    out = np.zeros(len(h1), bool)
    out[new] = True
    return out


def weights(rows: DataFrame, lines: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The words that weigh less than 1 by their numbers in all texts of rows, in order of hash, and the logarithm of 1 / weight of each in the units of STEPS."""
    words = (read(rows) if lines is None else lines).where("gone is null").select(F.col("h1").alias("t"), F.col("h2").alias("n"))
    common = max(COMMON * (words.where("t = 0").agg(F.sum("n")).first()[0] or 0), RARE)
    own = words.where((F.col("t") != 0) & (F.col("n") > common)).toArrow()  # 1 / COMMON rows at most
    t, n = own["t"].to_numpy().view(np.uint64), own["n"].to_numpy().astype(np.float64)
    order = np.argsort(t)
    light = np.rint(STEEP * np.log(n[order] / common) * (1 << 24)).astype(np.uint64) << np.uint64(32)
    return t[order], light


#: Logarithms of exponential variates by 16 bits, from 0 on, in units of 2^-24 and in the upper half of 64 bits.
STEPS = np.rint((np.log(-np.log((np.arange(1 << 16) + 0.5) / (1 << 16))) + 12) * (1 << 24)).astype(np.uint64) << np.uint64(32)
#: Words that are weighed together.
WORDS = 1 << 17


def fingerprints(h: np.ndarray, starts: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """PRINTS keys of each line: in each of a key's blocks the bits of the word that is heaviest there."""
    out = np.empty((PRINTS, len(starts)), np.uint64)
    # words that aren't in the table are mostly seen to by a look at some of their bits
    maybe = np.zeros(1 << 20, bool)
    maybe[(table[0] & np.uint64(len(maybe) - 1)).view(np.int64)] = True
    table = (*table, maybe)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + WORDS, side="right")) - 1) if starts[-1] > starts[i] + WORDS else len(starts)
        end = starts[j] if j < len(starts) else len(h)
        _fingerprints(h[starts[i] : end], starts[i:j] - starts[i], table, out[:, i:j])
        i = j
    return out


def _fingerprints(h: np.ndarray, starts: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray], out: np.ndarray) -> None:
    words, lightness, maybe = table
    # what a word weighs is worked out once, however often it is met
    own = pa.array(h.view(np.int64)).dictionary_encode()
    h, at = own.dictionary.to_numpy().view(np.uint64), own.indices.to_numpy().astype(np.intp)
    # the logarithm of a word's time is that of the variate and that of its lightness; the earliest word is the heaviest
    base = h >> np.uint64(32)
    if len(words):
        at_base = np.flatnonzero(maybe.take((h & np.uint64(len(maybe) - 1)).view(np.int64)))
        i = np.searchsorted(words, h[at_base])
        i[i == len(words)] = 0
        base[at_base] += np.where(words[i] == h[at_base], lightness[i], np.uint64(0))
    times = np.empty(len(at), np.uint64)
    for r in range(PRINTS):
        g = mixed(h * np.uint64(2 * r + 3) + np.uint64(0x9E3779B97F4A7C15 * (r + 1) & 0xFFFFFFFFFFFFFFFF))
        key = np.full(len(starts), r + 1, np.uint64)
        for j in range(BLOCKS):
            time = STEPS.take(((g >> np.uint64(16 * j)) & np.uint64(0xFFFF)).view(np.int64))
            time += base
            first = np.minimum.reduceat(time.take(at, out=times, mode="clip"), starts)
            key = mixed(key * np.uint64(0xC2B2AE3D27D4EB4F) + (first & np.uint64(0xFFFFFFFF)))
        out[r] = key


def keyed(batches, least: float, table, hot=None):
    """The fingerprints t of lines that others can be alike to, once for a line in what a task remembers, and a salt of those that are hot."""
    shortest = int(np.ceil(1 / (1 - least) - 1e-9))
    seen = memory()
    own: list = []

    def keys():
        h, h1, n = (np.concatenate(x) for x in zip(*own, strict=True))
        own.clear()
        t, h1 = fingerprints(h, np.cumsum(n) - n, table.value).ravel().view(np.int64), np.tile(h1, PRINTS)
        salt = np.zeros(len(t), np.int32)
        if hot is not None and len(hot.value[0]):
            _, is_hot = leaders(t, hot.value)
            salt[is_hot] = (h1[is_hot] % np.uint64(SALTS)).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(t), pa.array(salt), pa.array(h1.view(np.int64))], ["t", "salt", "h1"])

    total = 0
    for batch in batches:
        for _, _, rows, h, b, begins, offsets in word_slices(batch.column(0), LINE_BYTES, SLICE):
            if not len(h):
                continue
            starts, _ = line_starts(b, begins, offsets)
            h1, n = spans(h, starts), np.diff(np.append(starts, len(h)))
            # a line one shorter than the shortest that may be edited can have a partner of that length
            use = unseen(h1, seen) & (n >= shortest - 1)
            if not use.any():
                continue
            own.append((h[np.repeat(use, n)], h1[use], n[use]))
            total += len(own[-1][0])
            if total >= 4 * WORDS:
                yield keys()
                total = 0
    if own:
        yield keys()


def key_blocks(batches, keyed, hot, parts: int):
    """Blocks of t and h1, some keys at a time."""
    own: list = []

    def chunk():
        t, salt, h1 = (np.concatenate(x) for x in zip(*own, strict=True))
        own.clear()
        part = t.view(np.uint64) >> np.uint64(20)
        salted = np.flatnonzero(salt)
        part[salted] = mixed(part[salted] + salt[salted].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return packed(part % np.uint64(parts), t, h1)

    for batch in keyed(batches, hot=hot):
        own.append([c.to_numpy() for c in batch.columns])
        if sum(len(x[0]) for x in own) >= PACK:
            yield chunk()
    if own:
        yield chunk()


def leaders(t: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The leaders that hot keys have, and which keys are hot."""
    at = np.minimum(np.searchsorted(hot[0], t), len(hot[0]) - 1)
    return hot[1][at], hot[0][at] == t


def listed(batches, hot):
    """t, h1, lead of lines that have a key in common, from keys in the order of t; the leader is the first one, or what is known of a hot key.

    Copies of an entry are left out within a batch; a list that goes on in the next batch may have a line again.
    """
    first = None
    for batch in batches:
        t, h1 = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        if not len(t):
            continue
        if first is not None:  # how the last group of the batch before began
            t, h1 = (np.append(x, y) for x, y in zip(first, (t, h1), strict=True))
        new = np.append(True, t[1:] != t[:-1])
        starts, group = np.flatnonzero(new), np.cumsum(new) - 1
        lead = h1[starts]
        several = np.logical_or.reduceat(h1 != lead[group], starts)
        if first is not None:
            several[0] |= told
        begin = lead[-1]
        if len(hot.value[0]):
            own, known = leaders(t[starts], hot.value)
            lead, several = np.where(known, own, lead), several | known
        use = np.flatnonzero(several[group])
        if first is not None and told:
            use = use[use > 0]
        first, told = (t[-1:], np.array([begin])), bool(several[-1])
        use = use[np.lexsort((h1[use], group[use]))]
        if len(use):
            use = use[np.append(True, (group[use[1:]] != group[use[:-1]]) | (h1[use[1:]] != h1[use[:-1]]))]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (t[use], h1[use], lead[group[use]])], ["t", "h1", "lead"])


def paired(batches, hot):
    """As t, h1, lead the entries of long and of hot lists; without t, as h1 and lead, all pairs of lines in the others."""
    for _, own in unpacked(batches):
        t, h1 = own.reshape(-1, 2).T.copy()
        order = np.argsort(t)
        t, h1 = t[order], h1[order]
        for batch in listed([pa.RecordBatch.from_arrays([pa.array(t), pa.nulls(len(t), pa.int32()), pa.array(h1)], ["t", "salt", "h1"])], hot):
            t, h1, lead = (c.to_numpy() for c in batch.columns)
            if not len(t):
                continue
            starts = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            m = np.diff(np.append(starts, len(t)))
            few = m <= FEW
            if len(hot.value[0]):
                few &= ~leaders(t[starts], hot.value)[1]
            a, b = [h1[:0]], [h1[:0]]
            for n in range(2, FEW + 1):
                at = starts[few & (m == n)]
                for i in range(n):
                    for j in range(i):  # in the order of h1
                        a.append(h1[at + j])
                        b.append(h1[at + i])
            a, b = np.concatenate(a), np.concatenate(b)
            long = np.repeat(~few, m)
            t = pa.concat_arrays([pa.array(t[long]), pa.nulls(len(a), pa.int64())])
            yield pa.RecordBatch.from_arrays([t, pa.array(np.append(h1[long], a)), pa.array(np.append(lead[long], b))], ["t", "h1", "lead"])


def asked(shared, h1: np.ndarray) -> np.ndarray:
    """Which lines are in a bucket of hashes that is asked for."""
    at = h1 & np.uint64(BUCKETS - 1)
    return np.flatnonzero((shared.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)


def buckets(spark: SparkSession, *columns: DataFrame):
    """A bit for each bucket of the columns' hashes, for every task. Tasks set the bits, 64 to a number: the driver gets BUCKETS / 64 numbers at most."""
    used = reduce(DataFrame.union, [c.select(F.pmod(F.col(c.columns[0]), F.lit(BUCKETS)).cast("int").alias("bucket")) for c in columns])
    own = used.groupBy(F.shiftright("bucket", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, bucket & 63)")).alias("bits")).toArrow()
    bits = np.zeros(BUCKETS // 64, np.int64)
    bits[own["at"].to_numpy()] = own["bits"].to_numpy()
    return spark.sparkContext.broadcast(bits.astype("<i8").view(np.uint8))


def edits(a: list, b: list, most: int) -> int:
    """Least word edits from a to b, or more than most."""
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    i = 0
    while i < min(len(a), len(b)) and a[-1 - i] == b[-1 - i]:
        i += 1
    a, b = a[: len(a) - i], b[: len(b) - i]
    if not a or not b:
        return max(len(a), len(b))
    if abs(len(a) - len(b)) > most:
        return most + 1
    # a column of the table of edits as bits: where it grows and where it falls (Hyyro)
    at: dict = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full, high = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, n = full, 0, len(a)
    for k, w in enumerate(b, 1):
        eq = at.get(w, 0)
        same = (((eq & up) + up) ^ up) | eq
        more, less = down | (full & ~(same | up)), up & same
        n += 1 if more & high else -1 if less & high else 0
        if n - (len(b) - k) > most:
            return most + 1
        more, less = (more << 1 | 1) & full, (less << 1) & full
        eq |= down
        up, down = less | (full & ~(eq | more)), more & eq
    return n


def similar(a: list, b: list, least: float) -> bool:
    n = max(len(a), len(b))
    most = int((1 - least) * n + 1e-9)
    # each place that differs is one edit, and so is each word that one has more
    if n - sum(map(eq, a, b)) <= most:
        return True
    return edits(a, b, most) <= most


def verified(batches, least: float):
    for batch in batches:
        a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        keep = pa.array(np.flatnonzero([similar(x.split(), y.split(), least) for x, y in zip(a, b, strict=True)]))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])


def wanted(batches, shared):
    """h1, number of words, sketch and normalised text of lines whose h1 is in one of the buckets asked for, once in what a task remembers."""
    seen = memory()
    for batch in batches:
        for _, _, rows, h, b, begins, offsets in word_slices(batch.column(0), LINE_BYTES, SLICE):
            if not len(h):
                continue
            starts, _ = line_starts(b, begins, offsets)
            h1, n = spans(h, starts), np.diff(np.append(starts, len(h)))
            line = asked(shared, h1)
            line = line[unseen(h1[line], seen)]
            if not len(line):
                continue
            use = np.zeros(len(n), bool)
            use[line] = True
            begin, end = begins[starts[line]], offsets[rows[starts[line]] + 1]
            breaks = np.append(np.flatnonzero(b == 10), len(b))
            end = np.minimum(end, breaks[np.searchsorted(breaks, begin)])
            text = [b" ".join(b[i:j].tobytes().split()) for i, j in zip(begin.tolist(), end.tolist(), strict=True)]
            s = sketches(h[np.repeat(use, n)], np.cumsum(n[line]) - n[line])
            s = pa.ListArray.from_arrays(np.arange(len(line) + 1, dtype=np.int32) * SKETCH, s.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(h1[line].view(np.int64)), pa.array(n[line], pa.int32()), s, pa.array(text, pa.binary())], ["h1", "n", "s", "line"])


def near(x: str, y: str, least: float):
    """Lines that may be alike by their numbers of words and their sketches."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    bits = F.aggregate(F.zip_with(f"{x}.s", f"{y}.s", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda p, q: p + q)
    return (n >= least * m) & (m >= least * n) & (bits <= 2 * F.floor((1 - least) * F.greatest(n, m) + 1e-9))


def linked(pairs: DataFrame, lines: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of lines, by h1, that are similar."""
    x, y = (lines.select(F.col("h1").alias(c), F.struct("n", "s", "line").alias(s)) for c, s in ("ax", "by"))
    rows = pairs.join(x, "a").join(y, "b").where(near("x", "y", least)).select("a", "b", "x.line", F.col("y.line").alias("other"))
    return rows.mapInArrow(partial(verified, least=least), "a long, b long").distinct()


def lists_of(rows: DataFrame, keyed) -> DataFrame:
    """t, h1, lead: the lists of lines with a fingerprint t in common, two or more, each with a leader; in place of a list of few lines its pairs, as h1 and lead without t.

    Keys are shuffled once, in blocks, sorted by t in tasks, and compared with their neighbours. A key that very many lines have is found in a sample of
    documents beforehand, and so is a leader of its list: its lines are dealt out by salts and needn't meet to know it.
    """
    schema = "t long, salt int, h1 long"
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(HOT_SAMPLE)) == 1).select("text").mapInArrow(keyed, schema).distinct()
    hot = sample.groupBy("t").agg(F.count(F.lit(1)).alias("m"), F.min("h1").alias("lead")).where(F.col("m") >= HOT_LINES)
    hot = hot.orderBy(F.desc("m"), "t").limit(HOT_MOST).toPandas().sort_values("t")
    hot = rows.sparkSession.sparkContext.broadcast((hot["t"].to_numpy(np.int64), hot["lead"].to_numpy(np.int64)))
    blocks = rows.select("text").mapInArrow(partial(key_blocks, keyed=keyed, hot=hot, parts=partitions(rows.sparkSession)), BLOCK)
    return dealt(blocks).mapInArrow(partial(paired, hot=hot), "t long, h1 long, lead long")


def groups(rows: DataFrame, lines: DataFrame, least: float, rounds: int) -> DataFrame | None:
    """id, component: lines, by h1, that are alike to others, and their groups; None if there are none."""
    spark = rows.sparkSession
    table = spark.sparkContext.broadcast(weights(rows, lines))
    lists = written(lists_of(rows, partial(keyed, least=least, table=table)), "line-lists")
    few = lists.where("t is null").select(F.col("h1").alias("a"), F.col("lead").alias("b")).distinct()
    few, lists = written(few, "line-few"), lists.where("t is not null")
    met = few.select(F.explode(F.array("a", "b")).alias("h1"), F.lit(False).alias("long")).union(lists.select("h1", F.lit(True)))
    met = written(met.groupBy("h1").agg(F.max("long").alias("long")), "line-met")
    own = rows.select("text").mapInArrow(partial(wanted, shared=buckets(spark, met)), "h1 long, n int, s array<long>, line binary")
    # buckets also hold lines without a list
    own = own.groupBy("h1").agg(*(F.first(c).alias(c) for c in ("n", "s", "line"))).join(met, "h1")
    own = written(own, "line-texts")
    links = comp = None
    found, r, last = True, 0, rounds == 0
    while True:
        if r == 0 and not last:
            pairs = lists.where("h1 != lead").groupBy(F.col("h1").alias("a"), F.col("lead").alias("b")).count()
            pairs = pairs.groupBy("a").agg(F.max(F.struct("count", "b")).alias("y")).select("a", "y.b")
        else:
            c = F.col("h1") if comp is None else F.coalesce("component", "h1")
            entries = lists.select("t", "h1")
            entries = (entries if comp is None else entries.join(comp, entries["h1"] == comp["id"], "left")).select("t", "h1", c.alias("c"))
            # only lists that still have two components
            several = entries.groupBy("t").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo != hi")
            entries = written(entries.join(several.select("t", "m"), "t"), "line-entries")
            made, n = entries.agg(F.sum((F.col("m") - 1) / 2), F.count(F.lit(1))).first()
            last = last or r >= rounds or not found or (made or 0) <= DENSE * n
            if last:
                entries = entries.join(own.select("h1", "n", "s"), "h1")
                x, y = (entries.select("t", F.struct("h1", "c", "n", "s").alias(s)) for s in "xy")
                pairs = x.join(y, "t").where((F.col("x.h1") < F.col("y.h1")) & (F.col("x.c") != F.col("y.c")) & near("x", "y", least))
                pairs = pairs.select(F.col("x.h1").alias("a"), F.col("y.h1").alias("b")).distinct()
            else:
                leader = entries.groupBy("t").agg(F.min_by(F.struct("h1", "c"), F.xxhash64(F.lit(r), "h1", "t")).alias("y"))
                pairs = entries.join(leader, "t").where(F.col("c") != F.col("y.c")).groupBy(F.col("h1").alias("a"), F.col("y.h1").alias("b")).count()
                pairs = pairs.groupBy("a").agg(F.max(F.struct("count", F.xxhash64(F.lit(r), "b").alias("h"), "b")).alias("y")).select("a", "y.b")
        pairs = written(pairs if r else pairs.unionByName(few), "line-pairs")
        found = bool(pairs.head(1))
        if found:
            new = written(linked(pairs, own, least), "line-links")
            own = own.where("long") if not r else own  # the other pairs are done
            if found := bool(new.head(1)):
                links = new if links is None else links.unionByName(new)
                comp = components(links, "line-components")
                found = LEAST_FOUND * new.count() > pairs.count()
        if last or not r and not lists.head(1):
            return comp
        r += 1


def without(batches, names: list[str]):
    """Texts less the lines whose positions are to be dropped; how many lines there were and are dropped."""
    for batch in batches:
        text, drop = (batch.column(batch.schema.get_field_index(n)) for n in ("text", "__op_drop"))
        lines = pc.fill_null(pc.add(pc.count_substring(text, "\n"), 1), 0).to_numpy().astype(np.int64)
        dropped = np.zeros(len(text), np.int64)
        some = np.flatnonzero(pc.and_(text.is_valid(), pc.fill_null(pc.greater(pc.list_value_length(drop), 0), False)).to_numpy(zero_copy_only=False))
        if len(some):
            new = []
            for i, x, at in zip(some.tolist(), text.take(pa.array(some)).to_pylist(), drop.take(pa.array(some)).to_pylist(), strict=True):
                own, at = x.split("\n"), set(at)
                left = [x for p, x in enumerate(own) if p not in at]
                dropped[i] = len(own) - len(left)
                new.append("\n".join(left))
            mask = np.zeros(len(text), bool)
            mask[some] = True
            text = pc.replace_with_mask(text, pa.array(mask), pa.array(new, text.type))
        own = [text if n == "text" else batch.column(batch.schema.get_field_index(n)) for n in names]
        yield pa.RecordBatch.from_arrays([*own, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], [*names, "n_lines", "n_dropped"])


def line_dedup(docs: DataFrame, distance: int | None = None, blocks: int | None = None, least: float = SIMILAR, rounds: int = ROUNDS) -> DataFrame:
    """The columns of docs, text without repeated lines, and n_lines, n_dropped. distance and blocks are of former candidates and change nothing."""
    docs = docs.drop("n_lines", "n_dropped")
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    lines = read(rows)
    drop, comp = lines.where("gone").select("doc_id", "pos"), groups(rows, lines, least, rounds)
    if comp is not None:
        # of the lines of a group the one that occurs first stays
        own = lines.where("not gone").select("h1", "doc_id", "pos")
        own = written(own.join(comp, own["h1"] == comp["id"]).select("component", "doc_id", "pos"), "line-members")
        least_at = own.groupBy("component").agg(F.min(F.struct("doc_id", "pos")).alias("at"))
        drop = drop.union(own.join(least_at, "component").where("doc_id != at.doc_id or pos != at.pos").select("doc_id", "pos"))
    drop = drop.groupBy(F.col("doc_id").alias("__op_id")).agg(F.collect_set("pos").alias("__op_drop"))
    joined = docs.join(drop.hint("shuffle_hash"), docs["doc_id"] == drop["__op_id"], "left").select(*docs.columns, "__op_drop")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", n_lines long, n_dropped long"
    return joined.mapInArrow(partial(without, names=docs.columns), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
