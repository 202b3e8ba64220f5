"""Each operator on a table with nulls, empty, long and repeated texts, ties and columns with clashing names, against brute force."""

import hashlib
import math
import re
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F, types as T

from grainloom.llm import decontaminate, exact_dedup, html_text, jaccard_join, language, licenses, line_dedup, linear, mixing, quality, queries, toxicity
from grainloom.llm.common import shingle_sets, table
from grainloom.llm.components import components

from ..oracle import assert_same

BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
LONG = " ".join(f"w{i % 997}x{i % 89}" for i in range(30_000))
ROWS = [
    (1, BASE, "en", "b"),
    (2, BASE, "en", "b"),
    (3, BASE.replace("two", "2"), "en", "a"),
    (4, BASE.upper() + "\t\x0b", None, "a"),
    (5, None, "de", "a"),
    (6, "", None, None),
    (7, "   \n\t ", "de", None),
    (8, "short one", "fr", "c"),
    (9, "short   one", "fr", "c"),
    (10, LONG, "en", "c"),
    (11, LONG.replace("w5x", "v5x"), "en", "c"),
    (12, "1234 !!! 5678", "es", "d"),
    (13, BASE + "\n" + "all of this is one long line that stands in two documents and is the same\nend", "en", "d"),
    (14, "before\nall of this is one long line that stands in two documents and is the same\nBefore", "en", "d"),
    (14, "before\nall of this is one long line that stands in two documents and is the same\nBefore", "en", "d"),
    (None, BASE, None, "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, taken string, t int, h1 long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, None, 1, "x", 2, 3) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(1, 13)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def as_rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def sets_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_exact_dedup(docs, empty):
    groups = {}
    for i, text, *_ in ROWS:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(i)
    got = exact_dedup.exact_dedup(docs, salts=3).collect()
    assert len(got) == len(ROWS)
    for r in got:
        own = next(v for k, v in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r["text_sha256"])
        assert r["group_size"] == len(own) and r["keep_id"] == min(x for x in own if x is not None)
    kept = [r["doc_id"] for r in got if r["kept"]]
    assert sorted(kept) == sorted(min(x for x in v if x is not None) for v in groups.values())
    assert exact_dedup.exact_dedup(empty).count() == 0


def brute_components(rows):
    sets = {i: sets_of(t) for i, t, *_ in rows if i is not None}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("hot", [0, 24])
def test_jaccard_join(docs, empty, hot):
    want = brute_components(ROWS)
    got = jaccard_join.jaccard_components(docs, hot=hot).collect()
    assert len(got) == len(ROWS)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["n_shingles"] == 16
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_jaccard_join_with_a_copy_without_id_first(spark):
    rows = [(None, BASE), (2, BASE), (1, BASE.replace("twenty", "20"))]
    got = as_rows(jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)), "doc_id", "component_id")
    assert got == [(1, 1), (2, 1), (None, None)]


def test_jaccard_join_of_a_large_near_group(spark):
    g = np.random.default_rng(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        own = list(base)
        for p in g.choice(60, int(g.integers(0, 4)), replace=False):
            own[p] = f"x{g.integers(1000)}"
        rows.append((i, " ".join(own)))
    want = brute_components(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_shingles_are_exact():
    import pyarrow as pa

    texts = [r[1] for r in ROWS]
    assert [len(s) for s in shingle_sets(pa.array(texts))] == [len(sets_of(t)) for t in texts]
    a, b = shingle_sets(pa.array([BASE, "y " + BASE]))
    assert len(np.intersect1d(a, b)) == 16


@pytest.mark.parametrize("chunk", [5, 100_000])
def test_components(spark, chunk):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7), (200, 201), (201, 202), (202, 200)]
    got = dict(components(spark.createDataFrame(links, "a long, b long").repartition(6), chunk=chunk).collect())
    assert got == {**{i: 1 for i in range(1, 41)}, 7: 1, 90: 90, 95: 90, 100: 90, 200: 200, 201: 200, 202: 200}


def test_line_dedup(docs, empty, spark):
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(docs).collect()}
    assert line_dedup.line_dedup(docs).columns == [*docs.columns, "n_lines", "n_dropped"]
    assert got[1]["n_dropped"] == 0 and got[2]["text"] == "" and got[4]["text"] == ""
    assert got[5]["text"] is None and got[6]["text"] == "" and got[7]["text"] == "   \n\t "
    assert got[None]["text"] == BASE and got[8]["n_dropped"] == 0 and got[9]["n_dropped"] == 1
    assert got[13]["n_dropped"] == 1 and got[14]["text"] == "before"
    assert line_dedup.line_dedup(empty).count() == 0
    near = spark.createDataFrame([(1, BASE + " " + BASE + " " + BASE), (2, (BASE + " " + BASE + " " + BASE).replace("twenty", "20", 1)), (3, "another line of words")], "doc_id long, text string")
    assert as_rows(line_dedup.line_dedup(near, distance=16, blocks=17), "doc_id", "n_dropped") == [(1, 0), (2, 1), (3, 0)]


def test_line_dedup_finds_lines_that_are_alike(spark):
    """Against all pairs of lines with few different words, the hardest for fingerprints: nothing is dropped that has no line alike, and 0.75 or more are found in each band."""
    g = np.random.default_rng(6)
    texts = []
    for n in (4, 8, 12, 20, 40, 80, 200):
        for share in (0.0, 0.1, 0.15, 0.2, 0.25, 0.3):
            for _ in range(10):
                line = [f"w{int(x)}" for x in g.zipf(1.3, n) % 5000]
                other = list(line)
                for p in g.choice(n, max(1, int(share * n)), replace=False)[::-1]:
                    kind = g.integers(3)
                    other[p : p + 1] = [[f"x{g.integers(10**6)}"], [], [other[p], "y"]][kind] if p < len(other) else []
                texts += [" ".join(line), " ".join(other)]
    words = [t.split() for t in texts]
    up = list(range(len(texts)))

    def find(i):
        return i if up[i] == i else find(up[i])

    bands = {0.75: [], 0.8: [], 0.9: []}
    for j in range(len(texts)):
        for i in range(j):
            n = max(len(words[i]), len(words[j]))
            if 4 * abs(len(words[i]) - len(words[j])) <= n and words[i] and words[j] and 4 * (d := line_dedup.edits(words[i], words[j], n)) <= n:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
                if j == i + 1 and i % 2 == 0:
                    bands[max(x for x in bands if x <= 1 - d / n + 1e-9)].append(j)
    want = {i: bool(words[i]) and find(i) != i for i in range(len(texts))}
    got = dict(as_rows(line_dedup.line_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "doc_id", "n_dropped"))
    assert all(want[i] for i in got if got[i]) and sum(want.values()) > 200
    for found in bands.values():
        assert len(found) > 20 and np.mean([got[j] for j in found]) >= 0.75


def test_lists_of_lines_by_neighbours():
    """Lists against grouping by hand, over all sizes of batches, with copies of entries and with hot keys."""
    g = np.random.default_rng(5)
    for size in (1, 2, 3, 7, 1000):
        for hot in ({}, {3: 99, 8: 77}):
            rows = [(int(t), int(h)) for t, h in zip(g.integers(0, 12, 60), g.integers(0, 5, 60), strict=True)] + [(50, 1), (51, 2), (51, 2)]
            keys = sorted(((t, h % 2 if t in hot else 0, h) for t, h in rows), key=lambda k: k[0])
            batches = [pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys[a : a + size]], x) for i, x in enumerate((pa.int64(), pa.int32(), pa.int64()))], ["t", "salt", "h1"]) for a in range(0, len(keys), size)]
            known = type("Known", (), {"value": (np.array(sorted(hot), np.int64), np.array([hot[t] for t in sorted(hot)], np.int64))})
            got = [tuple(r.values()) for b in line_dedup.listed(iter(batches), known) for r in b.to_pylist()]
            if size < 1000:  # a list that goes on in the next batch may have a line again
                got = set(got)
            want = {}
            for t, h in rows:
                want.setdefault(t, set()).add(h)
            leads = {t: hot.get(t, next(h for x, h in rows if x == t)) for t in want}
            assert sorted(got) == sorted((t, h, leads[t]) for t, own in want.items() if t in hot or len(own) > 1 for h in own)


def test_line_dedup_deals_out_hot_keys(spark, monkeypatch):
    """Lines that nearly all share a key: the same result whether the key is known to be hot or not."""
    docs = spark.createDataFrame([(i, BASE + f" {i % 40} tail") for i in range(120)], "doc_id long, text string")
    plain = as_rows(line_dedup.line_dedup(docs), "doc_id", "n_dropped")
    monkeypatch.setattr(line_dedup, "HOT_SAMPLE", 2)
    monkeypatch.setattr(line_dedup, "HOT_LINES", 3)
    assert as_rows(line_dedup.line_dedup(docs), "doc_id", "n_dropped") == plain


def test_weights_count_every_word(spark):
    """Weights against numbers of all words of all documents, whatever parts the table has."""
    rare = line_dedup.RARE
    texts = ["often " * 100] * 4 + [f"own{i}\nonce" for i in range(rare + 1)] + [f"own{i} seldom" for i in range(rare)]
    number = Counter(w for t in texts for w in t.split())
    rows = [(i * 7919, t) for i, t in enumerate(texts)]
    hashes = {w: int(next(line_dedup.word_slices(pa.array([w]), line_dedup.LINE_BYTES))[3][0]) for w in number}
    for parts in (1, 9):
        t, light = line_dedup.weights(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts))
        got = dict(zip(t.tolist(), (light >> np.uint64(32)).tolist(), strict=True))
        assert got == {hashes[w]: pytest.approx(line_dedup.STEEP * math.log(n / rare) * (1 << 24), abs=1) for w, n in number.items() if n > rare}
    assert len(got) == 2 and got[hashes["often"]] > got[hashes["once"]] > 0


def test_lines_remembered_by_slots(monkeypatch):
    """A text is new once in a slice at most, and always if it wasn't met before."""
    monkeypatch.setattr(line_dedup, "SEEN", 8)
    seen, met = line_dedup.memory(), set()
    for part in np.split(np.random.default_rng(9).integers(0, 40, 600).astype(np.uint64), 30):
        new = part[line_dedup.unseen(part, seen)].tolist()
        assert len(new) == len(set(new)) and set(part.tolist()) - met <= set(new)
        met |= set(part.tolist())
    assert line_dedup.unseen(np.arange(8, dtype=np.uint64), line_dedup.memory()).all()


def test_buckets_reach_the_driver_as_bits(spark, monkeypatch):
    """Bits against those set by hand; the driver gets one row for 64 buckets at most, however many hashes there are."""
    monkeypatch.setattr(line_dedup, "BUCKETS", 1 << 12)
    frames = [spark.range(n).select(F.xxhash64(F.col("id") + n).alias("h1")) for n in (9_000, 50)]
    hashes = np.array([r["h1"] for f in frames for r in f.collect()], np.int64).view(np.uint64)
    sizes, kind = [], type(frames[0])
    for name in ("collect", "toPandas", "toArrow"):
        monkeypatch.setattr(kind, name, lambda self, f=getattr(kind, name): (sizes.append(len(own := f(self))), own)[1])
    got = line_dedup.asked(line_dedup.buckets(spark, *frames), np.arange(1 << 12, dtype=np.uint64))
    assert got.tolist() == sorted({int(h) & (1 << 12) - 1 for h in hashes})
    assert max(sizes) <= (1 << 12) // 64


def test_line_dedup_shuffles_blocks_of_keys(spark, sf_dir, monkeypatch):
    """What tasks give to the shuffle of keys is a row for each part, not one for each of a line's keys."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").where("doc_id is not null and text is not null").coalesce(1)
    weights = spark.sparkContext.broadcast(line_dedup.weights(rows))
    made, kind = [], type(rows)
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, f=kind.mapInArrow: (made.append(f(self, *a)), made[-1])[1])
    lists = line_dedup.lists_of(rows, partial(line_dedup.keyed, least=line_dedup.SIMILAR, table=weights))
    assert made[1].count() <= 4 and lists.count() > 0  # after the sample


def in_order(blocks):
    """Blocks as a sorted partition has them, one to a batch."""
    rows = sorted(((r["part"], r["rows"]) for b in blocks for r in b.to_pylist()), key=lambda r: r[0])
    return [pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([x], pa.binary())], ["part", "rows"]) for p, x in rows]


def test_lines_and_words_known_from_blocks(monkeypatch):
    """Which lines are gone, and numbers of words, against counting by hand, with repeated ids and whatever a task holds at once."""
    g = np.random.default_rng(3)
    docs = [(int(g.integers(0, 60)), "\n".join(" ".join(f"w{x}" for x in g.integers(0, 3, g.integers(0, 3))) for _ in range(g.integers(0, 6)))) for _ in range(200)]
    docs += [docs[0], docs[1]]
    monkeypatch.setattr(line_dedup, "RARE", 5)
    where, words = {}, Counter()
    for i, t in docs:
        words.update(t.split())
        for p, x in enumerate(t.split("\n")):
            if x.split():
                where.setdefault(" ".join(x.split()), set()).add((i, p))
    want = {at for own in where.values() for at in own if at != min(own)}
    for pack, chunk in ((4, 3), (200, 100), (1 << 20, 1 << 20)):
        monkeypatch.setattr(line_dedup, "PACK", pack)
        monkeypatch.setattr(line_dedup, "CHUNK", chunk)
        blocks = []
        for a in range(0, len(docs), 50):  # a task each
            own = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*docs[b : min(b + 7, a + 50)], strict=True)], ["doc_id", "text"]) for b in range(a, min(a + 50, len(docs)), 7)]
            blocks += line_dedup.located(iter(own), 3)
        rows = [r for b in line_dedup.known(iter(in_order(blocks)), 3) for r in b.to_pylist()]
        assert {(r["doc_id"], r["pos"]) for r in rows if r["gone"]} == want
        assert {(r["doc_id"], r["pos"]) for r in rows if r["gone"] is False} >= {min(own) for own in where.values()}
        got = {r["h1"]: r["h2"] for r in rows if r["gone"] is None}
        assert got.pop(0) == sum(words.values()) and sorted(got.values()) == sorted(n for n in words.values() if n > 5)


def test_few_lines_give_their_pairs():
    """Lists against grouping by hand: all pairs of few lines, entries of many or of a hot key."""
    g = np.random.default_rng(8)
    keys = {(t, int(h)) for t in range(40) for h in g.integers(0, 1000, t % 20)}
    rows = np.array([*keys, *list(keys)[:50]], np.int64)
    hot = type("Known", (), {"value": (np.array([5, 16], np.int64), np.array([77, 88], np.int64))})
    blocks = [line_dedup.packed(x[:, 0] % 3, *x.T) for x in np.array_split(rows, 4)]
    got = [tuple(r.values()) for b in line_dedup.paired(iter(in_order(blocks)), hot) for r in b.to_pylist()]
    lists = {t: sorted(h for x, h in keys if x == t) for t in range(40)}
    few = {t: own for t, own in lists.items() if len(own) <= line_dedup.FEW and t not in (5, 16)}
    assert Counter((a, b) for t, a, b in got if t is None) == Counter((a, b) for own in few.values() for i, b in enumerate(own) for a in own[:i])
    assert sorted((t, h) for t, h, _ in got if t is not None) == sorted((t, h) for t, own in lists.items() if t not in few for h in own)


def test_line_dedup_recall_on_the_corpus(spark, sf_dir):
    """All pairs of the corpus's lines against the links that the query's own parameters find, by band of similarity."""
    texts = [r["text"] for r in table(spark, sf_dir, "documents").select("text").collect()]
    low = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    lines = sorted({" ".join(re.findall(r"[^\x20\x09-\x0D]+", x.encode().translate(low).decode())) for t in texts if t for x in t.split("\n")} - {""}, key=lambda x: (len(x.split()), x))
    words = [x.split() for x in lines]
    bags = [Counter(w) for w in words]
    bands = {0.75: [], 0.8: [], 0.9: []}
    for j in range(len(lines)):
        m = len(words[j])
        for i in range(j - 1, -1, -1):
            if 4 * len(words[i]) < 3 * m:
                break
            if 4 * sum((bags[i] & bags[j]).values()) >= 3 * m and 4 * (d := line_dedup.edits(words[i], words[j], m)) <= m:
                bands[max(x for x in bands if x <= 1 - d / m + 1e-9)].append((i, j))
    # each pair is a table of its own part of ids: two documents, a line each
    pairs = [p for own in bands.values() for p in own]
    rows = [(k, lines[i]) for k, i in enumerate(sorted({x for p in pairs for x in p}))]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    dropped = dict(as_rows(got, "doc_id", "n_dropped"))
    at = {i: k for k, i in enumerate(sorted({x for p in pairs for x in p}))}
    for own in bands.values():
        # of a pair that is found, the later line goes
        assert not own or np.mean([dropped[max(at[i], at[j])] for i, j in own]) >= 0.9


def test_word_edits():
    g = np.random.default_rng(1)
    for _ in range(60):
        a, b = (list(g.choice(list("abc"), g.integers(0, 9))) for _ in range(2))
        d = np.zeros((len(a) + 1, len(b) + 1), int)
        d[:, 0], d[0] = range(len(a) + 1), range(len(b) + 1)
        for i in range(len(a)):
            for j in range(len(b)):
                d[i + 1, j + 1] = min(d[i, j + 1] + 1, d[i + 1, j] + 1, d[i, j] + (a[i] != b[j]))
        assert line_dedup.edits(a, b, 99) == d[-1, -1]


@pytest.mark.parametrize("block_chars", [32_000_000, 60])
def test_decontamination(docs, empty, spark, block_chars):
    items = [(1, BASE), (2, "short one"), (3, None), (4, "!!"), (None, BASE), (5, "twelve thirteen"), (5, "twelve thirteen"), (6, "zero " + BASE), (7, "a a " * 20 + BASE)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    want = []
    for i, text, *_ in ROWS:
        w = re.findall(pattern, low(text))
        hit, own = set(), set()
        for item, t in items:
            b = re.findall(pattern, low(t))
            k = min(13, len(b))
            wins = {tuple(b[j : j + k]) for j in range(len(b) - k + 1)} if k and item is not None else set()
            for j in range(len(w) - k + 1):
                if tuple(w[j : j + k]) in wins:
                    hit |= set(range(j, j + k))
                    own.add(str(item))
        sha = hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()
        want.append((i, len(w), len(hit), len(own), sha, bool(hit) and 20 * len(hit) >= len(w)))
    df = decontaminate.decontaminate(docs, bench, block_chars=block_chars)
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0
    kept = decontaminate.decontaminate(docs, bench, block_chars=block_chars, keep=tuple(docs.columns))
    assert as_rows(kept.select(*docs.columns), *docs.columns) == as_rows(docs, *docs.columns)


def test_mixing(docs, empty, spark):
    got = mixing.mix(docs, range_rows=2).collect()
    assert len(got) == len(ROWS)
    sizes = {}
    for _, text, _, source in ROWS:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    names = sorted(x for x in sizes if x is not None) + [None]
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, full = {}, set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        share = left / max(1, sum(weight[s] for s in names if s not in full))
        target = {s: 3.0 * sizes[s] if s in full else share * weight[s] for s in names}
        over = {s for s in names if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    taken = {}
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert as_rows(mixing.mix(docs), "doc_id", "taken") == as_rows(mixing.mix(docs, range_rows=3), "doc_id", "taken")
    assert mixing.mix(empty).count() == 0


@pytest.mark.parametrize("range_rows", [3, 1000])
def test_mixing_takes_what_brute_force_takes(spark, range_rows):
    words = F.array_join(F.array_repeat(F.lit("w"), (1 + F.col("id") % 7).cast("int")), " ")
    own = spark.range(600).select(F.when(F.col("id") < 580, F.col("id")).alias("doc_id"), F.concat(words, F.lit(" x"), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 3 > 0, "hot").alias("source"))
    # most of the source is junk, whose keys are far out
    weight = F.when(F.coalesce("doc_id", F.lit(0)) % 10 > 0, 0.05).otherwise(1.0)
    got = {r["text"]: r for r in mixing.mix(own, weight=weight, range_rows=range_rows).join(own.select("doc_id", "text"), "doc_id").collect()}
    drawn = own.select("doc_id", "text", "source", weight.alias("q"), F.xxhash64(F.lit(mixing.SEED), "doc_id").alias("h"), F.xxhash64(F.lit(mixing.SEED), "text").alias("g")).collect()
    keyed = [(-math.log(((r["h"] if r["doc_id"] is not None else r["g"]) % (1 << 52) + 0.5) / (1 << 52)) / r["q"], r) for r in drawn]
    for source in ("hot", None):
        rows = sorted(((k, r) for k, r in keyed if r["source"] == source), key=lambda x: x[0])
        size = sum(len(r["text"].split()) for _, r in rows)
        target = next(x["target"] for x in got.values() if x["source"] == source)
        left, epochs = round(target % size), int(target // size)
        for _, r in rows:
            n = len(r["text"].split())
            part = min(n, max(0, left))
            left -= n
            if r["text"] in got:
                assert got[r["text"]]["taken"] == min(3 * n, epochs * n + part)


def test_better_documents_come_earlier(spark):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.lit("s").alias("source"))
    more = rows.union(rows.select(F.col("doc_id") + 5000, "text", F.lit("t")).limit(500))
    w = F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0)
    got = mixing.mix(more, weight=w).where("source = 's'").groupBy(F.col("doc_id") % 2).agg(F.avg("taken")).collect()
    share = dict(got)
    assert share[0] > 1.3 * share[1]


def test_language(spark, sf_dir, docs, empty):
    d = table(spark, sf_dir, "documents")
    p = language.predict(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (p["lang_pred"] == p["lang"]).mean() > 0.95 and p["score"].between(0, 1).all()
    got = {r["doc_id"]: r for r in language.predict(docs).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (5, 6, 7, 12))
    assert got[1]["lang_pred"] in ("en", "de", "fr", "es")
    assert language.predict(empty).count() == 0
    assert language.predict(docs.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred != 'und'").count() == 0


def test_every_language_is_learned(spark):
    rows = [(20 * i + j, f"word{i} other", f"l{i:02}") for i in range(70) for j in range(20)]
    langs, net = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), train_docs=1, train_words=1)
    assert langs == [f"l{i:02}" for i in range(70)] and net.classes == 70


def test_gradients_of_the_gated_network():
    net = language.Net(3, hidden=3, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words = [b"abc", b"de", b"f"]
    x, real = language.padded(words, 5)
    y = np.array([0, 1, 2])
    _, g = net.gradients(x, real, y)
    for name, at in (("Ub", (4, 1)), ("Uf", (8, 2)), ("cb", (2, 0)), ("V", (1, 4)), ("Xf", (7, ord("b")))):
        old, e = net.p[name][at], 1e-2
        net.p[name][at] = old + e
        up = net.gradients(x, real, y)[0]
        net.p[name][at] = old - e
        down = net.gradients(x, real, y)[0]
        net.p[name][at] = old
        assert (up - down) / (2 * e) == pytest.approx(float(g[name][at]), rel=0.03, abs=3e-4)


def test_toxicity(spark, sf_dir, docs, labels, empty):
    d, own = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    p = toxicity.score(d, own).join(own, "doc_id").toPandas()
    assert p[p.toxic == 1].score.mean() > 3 * p[p.toxic == 0].score.mean()
    got = toxicity.score(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert toxicity.score(docs, labels.limit(0)).where("score > 0.001").count() == 0
    assert toxicity.score(empty, labels).count() == 0


def test_non_negative_risk_finds_the_words():
    g = np.random.default_rng(2)
    y = g.random(4000) < 0.2
    x = np.column_stack([np.where(y, g.random(4000) < 0.9, g.random(4000) < 0.02), g.random((4000, 3)) < 0.5, np.ones(4000)]).astype(float)
    seen = y & (g.random(4000) < 0.3)
    w = toxicity.nn_pu(x[seen], x[~seen], 0.2, 400)
    score = linear.sigmoid(x @ w)
    assert score[y].mean() > 0.6 and score[~y].mean() < 0.2


def test_quality(spark, sf_dir, docs, labels, empty):
    d, own = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    p = quality.score(d, own).join(own, "doc_id").toPandas()
    assert p[p.quality == 1].accepted.mean() > 0.95 and p[p.quality == 0].accepted.mean() < 0.5
    got = quality.score(docs, labels, keep=tuple(docs.columns))
    assert as_rows(got.select(*docs.columns), *docs.columns) == as_rows(docs, *docs.columns)
    assert quality.score(docs, labels.limit(0)).where("not accepted").count() == 0
    assert quality.score(empty, labels).count() == 0


def test_views_teach_each_other():
    g = np.random.default_rng(5)
    n = 2000
    y = (g.random(n) < 0.7).astype(float)
    v = g.random((n, len(quality.TEXT) + len(quality.META)))
    v[:, -2:] = 1
    v[:, 0] = np.where(y == 1, g.normal(0, 1, n), g.normal(3, 1, n))
    v[:, len(quality.TEXT)] = np.where(y == 1, g.normal(0, 1, n), g.normal(2, 1, n))
    m = quality.CoTrained(v[:400], y[:400], v[400:])
    assert (((m.score(v[400:]) >= 0.5) == (y[400:] == 1)).mean()) > 0.93


def test_pages(spark):
    page = "<html><head><title>No</title><script>var a='</p><p>no</p>';</script></head><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/x'>News</a></li></ul></nav><article><h1>A &amp; B</h1><p>One  <b>bold</b>\n word&nbsp;here.<p>Two<br>lines &lt;x&gt;</article><div class='comments'><p>I like it</p></div><footer>&copy; us</footer></body></html>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (1, "u", page), (None, "v", "<p"), (4, "w", "<article>" + "<p>word and word</p>" * 3000 + "</article>")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    got = html_text.extract(df).collect()
    text = {(r["page_id"], r["url"]): r["text"] for r in got}
    assert len(got) == 6 and text[1, "u"] == "A & B\n\nOne bold word here.\n\nTwo lines <x>"
    assert text[2, None] == text[3, "u"] == "" and text[None, "v"] == ""
    assert text[4, "w"] == "\n\n".join(["word and word"] * 3000)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("tag", ['svg class="icon"', "math", 'object data="a/b>"', "iframe src='x' ", "canvas"])
def test_pages_with_self_closed_elements(tag):
    own = [b.text for b in html_text.blocks(f"<p>one <{tag}/>two</p><p>three</p><{tag}>no<b>no</b></{tag.split()[0]}><p>four</p><script src='x'/>no</script><p>five</p>")]
    assert own == ["one two", "three", "four", "five"]


@pytest.mark.parametrize("tag", ["svg", "noscript", "iframe src=x", "object", "canvas", "math", "template"])
def test_pages_with_elements_left_open(tag):
    own = [b.text for b in html_text.blocks(f"<article><p>one<{tag}>two</p><p>three</p><svg>no</svg>{'<' + tag + '>' if tag != 'svg' else ''}<p>four</p></article>")]
    assert own == ["one" + "two", "three", "four"] if tag != "svg" else own[0] == "one"
    assert [b.text for b in html_text.blocks("<p>one</p><script>no<p>no</p>")] == ["one"]
    assert len(html_text.blocks(f"<{tag}><p>x</p>" * 20_000)) == 20_000


def test_pages_held_out():
    draw, f, net = html_text.Pages(77), html_text.Features(), html_text.trained()
    ok = n = 0
    for _ in range(60):
        x, y = html_text.labelled_page(f, draw.page())
        if len(y):
            p = net.predict(*html_text.padded([x]))[:, 0]
            ok, n = ok + int(((p >= 0.5) == (y > 0.5)).sum()), n + len(y)
    assert ok / n > 0.98


def test_licenses(spark, docs, empty):
    rows = [
        (1, "words before\nReleased under the MIT License.\nmore"),
        (2, "This work is licensed under the GNU General Public License, version 3."),
        (3, "All rights reserved.\nLicensed under the Apache License, Version 2.0."),
        (4, "He lost his driving license and his rights."),
        (5, "SPDX-License-Identifier: BSD-3-Clause"),
        (6, None),
    ]
    df = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id long, text string, probability double, families string")
    got = {r["doc_id"]: (r["license"], r["families"]) for r in licenses.licenses(df).collect()}
    assert got[1] == ("mit", "mit") and got[2] == ("gpl", "gpl") and got[3][1] == "apache,proprietary"
    assert got[5][0] == "bsd" and got[6] == ("none", "") and got[4][0] == "none"
    others = [(None, "Released under the MIT License."), (None, None), (8, "SPDX-License-Identifier: EPL-2.0"), (9, "Released under the zlib License."), (10, "Licensed under the Fair Source License, version 9.")]
    got = as_rows(licenses.licenses(spark.createDataFrame(others, "doc_id long, text string")), "doc_id", "license")
    assert {(None, "mit"), (None, "none"), (8, "unknown"), (9, "unknown")} <= set(got) and len(got) == 5
    assert dict(got)[10] in ("unknown", "none")  # a family that was never seen
    assert licenses.licenses(docs).where("license = 'none' and probability = 0").count() == len(ROWS)
    assert licenses.licenses(empty).count() == 0


def test_no_python_on_the_native_paths(spark, sf_dir):
    for name in ("op7_exact_dedup", "op10_licenses"):
        plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    assert_same(queries.QUERIES[name](spark, sf_dir), queries.ORACLE[name], sf_dir)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = corpus_pipeline.run(spark, sf_dir)
    assert isinstance(docs.schema["taken"].dataType, T.LongType)
    got = docs.toPandas()
    whole = table(spark, sf_dir, "documents").toPandas()
    assert 0.6 * len(whole) < len(got) <= len(whole) and got["doc_id"].is_unique
    assert set(got["doc_id"]) <= set(whole["doc_id"]) and (got["taken"] <= 3 * got["size"]).all()
    assert math.isclose(got["taken"].sum(), got["size"].sum(), rel_tol=0.01)


def test_stages_with_nulls_ties_and_clashing_names(spark, tmp_path, labels):
    import corpus_pipeline

    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("x", BASE.replace("one", "1"))], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clashing = ["quality_score", "accepted", "n_lines", "n_dropped", "component_id", "_other", "_text", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "taken", "size", "key", "t", "h1", "a.b"]
    rows = [(i, text, lang, source, len(text or ""), *range(len(clashing))) for i, text, lang, source in ROWS]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in clashing))
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, df, str(tmp_path))
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
        if name != "mixing":
            assert got.schema.names == df.schema.names
            got = got.collect()
            assert all(tuple(r)[5:] == tuple(range(len(clashing))) for r in got)
            left[name] = [(r["doc_id"], r["text"]) for r in got]
        else:
            assert got.count() == len(rows)
    # brute force: links of texts, windows of 13 words
    sets = {i: sets_of(t) for i, t, *_ in ROWS if i is not None}
    linked = lambda a, b: a and b and 100 * len(a & b) >= 75 * len(a | b)
    group = {i: i for i in sets}
    for _ in sets:
        group = {i: min(group[j] for j in sets if j == i or linked(sets[i], sets[j])) for i in sets}
    want = {(i, t) for i, t, *_ in ROWS if i is None or group[i] == i}
    assert sorted(left["jaccard join"], key=repr) == sorted(want, key=repr)
    wins = [" ".join(BASE.split()[i : i + 13]) for i in range(1, 8)]
    hit = {i for i, t, *_ in ROWS if t and any(w in " ".join(t.lower().split()) for w in wins)}
    assert sorted(left["decontamination"], key=repr) == sorted(((i, t) for i, t, *_ in ROWS if i not in hit), key=repr)
    # of equal lines only the first of all is left
    lines = Counter(x.lower() for i, t in set(left["line dedup"]) if i is not None for x in set((t or "").split("\n")) if x.strip())
    assert max(lines.values()) == 1 and lines["all of this is one long line that stands in two documents and is the same"] == 1
    assert (None, BASE) in left["line dedup"] and (5, None) in left["line dedup"] and (6, "") in left["line dedup"]
