"""k-mers as numbers, windows in tiles, and the search by sorted windows, with bounds small enough to matter."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandweave.functions import codes as C
from strandweave.functions import seqexpr as X
from strandweave.functions.letters import letters
from strandweave.operators import anchoring as N
from strandweave.operators import graph as G
from strandweave.operators import search, sketch
from strandweave.operators.skew import join_counted, join_to_unique

TURN = str.maketrans("ACGT", "TGCA")


def word(r, n, letters="ACGT"):
    return "".join(r.choice(letters) for _ in range(n))


@pytest.mark.parametrize("k", [1, 4, 11, 31])
def test_codes_are_those_of_the_words(spark, monkeypatch, k):
    monkeypatch.setattr(C, "PART", 64)
    r = random.Random(k)
    texts = [(i, word(r, r.randrange(90), "ACGTacgtN")) for i in range(30)] + [(90, None), (91, ""), (92, "漢字ACGTACGTACGTACGTACGTACGTACGTACGTACGTACGT"), (93, "A" * 200)]
    df = spark.createDataFrame(texts, "i int, s string")
    got = Counter((x.i, x.pos, x.w, x.rev) for x in C.kmer_codes(df, "s", k, ["i"]).withColumn("w", X.decode(F.col("kmer"), k)).collect())
    want = Counter((x.i, x.pos, x.kmer, x.rev) for x in X.kmers(df, "s", k, ["i"]).collect())
    assert got == want and C.kmer_codes(df.where("false"), "s", k, ["i"]).count() == 0


def test_the_hash_of_other_tools(spark):
    xxhash = pytest.importorskip("xxhash")
    values = [0, 1, 2**62 - 1, *(random.Random(1).randrange(2**62) for _ in range(50))]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v long")
    got = [r[0] for r in df.select(X.xxh64_of_long("v")).collect()]
    assert got[-1] is None and [g + 2**63 for g in got[:-1]] == [xxhash.xxh64(v.to_bytes(8, "little"), seed=0).intdigest() for v in values]
    kept = df.where(X.sampled_code(F.col("v"), 0.5)).count()
    assert kept == sum(xxhash.xxh64(v.to_bytes(8, "little"), seed=0).intdigest() <= 2**63 for v in values)


def test_windows_and_common_letters():
    r = random.Random(3)
    texts = [word(r, r.randrange(1, 70), "ACGTN") for _ in range(40)]
    flat, offsets = letters(pa.array(texts))
    a, b = C.symbols(flat, False), C.symbols(flat, True)
    import numpy as np

    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    at = np.arange(len(flat))
    one = C.window_words(a, offsets[row + 1], at, 3, C.READ_END)
    two = C.window_words(b, offsets[row + 1], at, 3, C.PANEL_END)
    for _ in range(400):
        i, j = r.randrange(len(flat)), r.randrange(len(flat))
        x, y = "".join(texts)[i : offsets[row[i] + 1]], "".join(texts)[j : offsets[row[j] + 1]]
        n = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q or p == "N"), min(len(x), len(y)))
        assert C.common_letters([w[i : i + 1] for w in one], [w[j : j + 1] for w in two])[0] == min(n, 63)


@pytest.mark.parametrize("tile", [7, 1 << 16])
def test_longest_matches_against_a_loop(spark, monkeypatch, tile):
    monkeypatch.setattr(search, "TILE", tile)
    r = random.Random(4)
    panel = [word(r, n) for n in (1, 30, 150, 90)] + ["ACGTN" * 12, None, ""]
    reads = [(str(i), word(r, r.randrange(1, 25))) for i in range(15)] + [("x", panel[2][5:140] + "N" + panel[3][:60]), ("y", panel[2][::-1].translate(TURN)), ("z", "N"), ("e", ""), ("n", None)] + [(f"same{i}", panel[1]) for i in range(8)]
    both = [s for p in panel if p for s in (p, p[::-1].translate(TURN))]
    a = spark.createDataFrame(reads, "id string, seq string").repartition(5)
    found = search.longest_matches(a, spark.createDataFrame([(p,) for p in panel], "seq string"), "id", "seq")
    got = {(x.id, x.s): (x.n, x.m) for x in found.collect()}
    want = {}
    for i, t in reads:
        for s in range(len(t or "")):
            n = 0
            while s + n < len(t) and t[s + n] != "N" and any(t[s : s + n + 1] in p for p in both):
                n += 1
            want[i, s] = (len(t) - s, n)
    assert got == want


def test_an_empty_panel_holds_nothing(spark):
    reads = spark.createDataFrame([(1, "ACG"), (2, "")], "id long, seq string")
    got = {(x.id, x.s, x.l) for x in search.minimal_absent_whole(reads, spark.createDataFrame([], "seq string"), "id", "seq").collect()}
    assert got == {(1, 0, 1), (1, 1, 1), (1, 2, 1)}
    assert search.minimal_absent_whole(reads.where("false"), spark.createDataFrame([("ACGT",)], "seq string"), "id", "seq").count() == 0


@pytest.mark.parametrize("tile", [3, 1 << 16])
@pytest.mark.parametrize("open_end", [False, True])
def test_uncovered_in_tiles(spark, tile, open_end):
    r = random.Random(5)
    rows = [(k, p, r.random() < 0.6) for k in range(12) for p in sorted(r.sample(range(60), r.randrange(1, 40)))]
    want = set()
    for k in range(12):
        own = [(p, h) for x, p, h in rows if x == k]
        start = None
        for p, h in own:
            if h and start is not None:
                want.add((k, start, p))
                start = None
            elif not h and start is None:
                start = p
        if start is not None and open_end:
            want.add((k, start, own[-1][0] + 1))
    df = spark.createDataFrame(rows, "k int, pos int, hit boolean")
    assert {tuple(x) for x in sketch.uncovered(df, "k", open_end, tile).collect()} == want


@pytest.mark.parametrize("tile", [5, 1 << 16])
def test_nearest_anchors_against_a_sort(spark, tile):
    r = random.Random(6)
    k, most = 4, 3
    usable = [(i, p, p * 10) for i in range(6) for p in r.sample(range(120), r.randrange(30))]
    strings = [(i, s, s + r.randrange(1, 30)) for i in range(8) for s in r.sample(range(100), 5)]
    want = set()
    for i, s, e in strings:
        left = sorted((p for x, p, _ in usable if x == i and p + k <= s), reverse=True)[:most]
        right = sorted(p for x, p, _ in usable if x == i and p >= e)[:most]
        want |= {(i, s, e, "left", n, p, p * 10) for n, p in enumerate(left, 1)} | {(i, s, e, "right", n, p, p * 10) for n, p in enumerate(right, 1)}
    a, b = spark.createDataFrame(strings, "i int, s int, e int"), spark.createDataFrame(usable, "i int, pos int, kmer long")
    assert {tuple(x) for x in N.nearest_anchors(a, b, "i", k, most, tile).collect()} == want


@pytest.mark.parametrize("stretch", [5, 1 << 14])
def test_path_kmers_by_stretches(spark, stretch):
    r = random.Random(7)
    k = 4
    segs = {v: word(r, r.choice((1, 2, 3, 9, 30)), "ACGTN") for v in range(1, 9)}
    paths = {p: [(r.randrange(1, 9), r.random() < 0.5) for _ in range(r.randrange(1, 9))] for p in range(12)}
    rows = [(p, i, v, rev, p == 3, 2 * v + rev) for p, own in paths.items() for i, (v, rev) in enumerate(own)]
    want = Counter()
    for p, own in paths.items():
        text, at = "", []
        for v, rev in own:
            x = segs[v][::-1].translate(TURN) if rev else segs[v]
            at += [(2 * v + rev, i) for i in range(len(x))]
            text += x
        for i in range(len(text) - k + 1):
            w = text[i : i + k]
            if "N" not in w:
                c = w[::-1].translate(TURN)
                want[min(w, c), c < w, p == 3, *at[i], *at[i + k - 1]] += 1
    steps = spark.createDataFrame(rows, "path int, step int, vid long, rev boolean, is_ref boolean, h long")
    found = sketch.path_kmers(steps, spark.createDataFrame(list(segs.items()), "vid long, seq string"), k, stretch)
    got = Counter(tuple(x) for x in found.select(X.decode(F.col("kmer"), k), "rev", "is_ref", "v1", "pos1", "v2", "pos2").collect())
    assert got == want
    # a location and its mirror image are one
    turned = steps.groupBy("path").agg(F.max("step").alias("n")).join(steps, "path").select("path", (F.col("n") - F.col("step")).alias("step"), "vid", (~F.col("rev")).alias("rev"), "is_ref", F.col("h").bitwiseXOR(F.lit(1).cast("bigint")).alias("h"))
    lens = spark.createDataFrame(list(segs.items()), "vid long, seq string")
    places = lambda s: {tuple(x) for x in sketch.undirected(sketch.path_kmers(s, lens, k), lens).select("kmer", "v1", "pos1", "v2", "pos2").collect()}
    assert places(steps) == places(turned)


@pytest.mark.parametrize("crowded", [0, 3, 1 << 20])
def test_a_shared_key_is_joined_all_the_same(spark, crowded):
    rows = [(i, None if i == 7 else 1 if i % 3 else i) for i in range(40)]
    df, right = spark.createDataFrame(rows, "i int, k int"), spark.createDataFrame([(k, f"v{k}") for k in range(0, 40, 2)] + [(1, "v1")], "k int, v string")
    for how in ("inner", "left"):
        a = sorted(join_to_unique(df, right, "k", how, crowded).select("i", "v").collect(), key=str)
        assert a == sorted(df.join(right, "k", how).select("i", "v").collect(), key=str)


@pytest.mark.parametrize("crowded", [1, 4, 1 << 20])
def test_counted_keys_are_joined_all_the_same(spark, crowded):
    rows = [(i, i % 3 and 1, None if i == 5 else i % 2) for i in range(30)]
    df = spark.createDataFrame(rows, "i int, a int, b int")
    right = df.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("low")).where("n > 5")
    for how in ("inner", "left_semi"):
        got = join_counted(df, right, ["a", "b"], how, crowded=crowded)
        want = df.join(right.drop("n"), ["a", "b"], how)
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("crowded", [1, 1 << 20])
def test_components_with_shared_labels(spark, crowded):
    edges = [(i, i + 1) for i in range(30)] + [(50, 51), (60, 60)]
    v = spark.createDataFrame([(i,) for i in [*range(31), 50, 51, 60, 70]], "vid long")
    got = {x.vid: x.component for x in G.components(v, spark.createDataFrame(edges, "a long, b long"), crowded).collect()}
    assert got == {**{i: 0 for i in range(31)}, 50: 50, 51: 50, 60: 60, 70: 70}


def test_dead_branches_dont_push_out_walks(spark):
    # 2 -> 4, 6, 8 spell the same; only 8 comes to the sink
    segs = [(1, "A"), (2, "C"), (3, "C"), (4, "C"), (5, "G"), (6, "T")]
    edges = [(2, 4), (2, 6), (2, 8), (4, 12), (8, 10)]
    targets = spark.createDataFrame([("x", 2, 10, "ACG"), ("none", 2, 10, "ATG"), ("short", 2, 2, "A")], "key string, source long, sink long, seq string")
    e, s = spark.createDataFrame(edges, "h1 long, h2 long"), spark.createDataFrame(segs, "vid long, seq string")
    assert {(r.key, tuple(r.walk)) for r in G.spellings(targets, e, s, most=1).collect()} == {("x", (2, 8, 10)), ("short", (2,))}


def test_walks_beyond_the_limit_are_the_highest(spark):
    # two ways at each of four places
    segs = [(v, "A") for v in range(1, 20)]
    edges = [(2 * a, 2 * b) for i in range(4) for a in (3 * i + 1, 3 * i + 2) for b in (3 * i + 4, 3 * i + 5) if i or a == 1]
    e, s = spark.createDataFrame(edges, "h1 long, h2 long"), spark.createDataFrame(segs, "vid long, seq string")
    targets = spark.createDataFrame([("k", 2, 26, "AAAAA")], "key string, source long, sink long, seq string")
    every = sorted(tuple(r.walk) for r in G.spellings(targets, e, s).collect())
    assert len(every) == 8 and [tuple(r.walk) for r in G.spellings(targets, e, s, most=3).orderBy("walk").collect()] == every[:3]


def test_both_ways_of_common_paths(spark):
    left = spark.createDataFrame([(1, 5, 0), (1, 6, 1), (1, 7, 0), (1, 7, 1)], "k int, path int, bit int")
    right = spark.createDataFrame([(1, 5, 1), (1, 6, 1), (1, 6, 0), (1, 7, 0), (2, 5, 0)], "k int, path int, bit int")
    assert {tuple(x) for x in N.common_paths(left, right, "k").collect()} == {(1, 5, 0, 1), (1, 6, 1, 1), (1, 7, 0, 0), (1, 7, 1, 0)}


def test_ends_by_strand(spark):
    ends = spark.createDataFrame([(1, 3, 4, 2, 5, 70, 80, False, False, True), (2, 3, 4, 2, 5, 70, 80, True, False, True)], "id int, sv long, ev long, soff int, eoff int, skmer long, ekmer long, back boolean, inv1 boolean, inv2 boolean")
    lens = spark.createDataFrame([(3, 10), (4, 20)], "vid long, len long")
    assert {tuple(x) for x in N.ends_by_strand(ends, lens, "id").collect()} == {(1, 6, 9, 2, 14, 70, 80, False), (2, 8, 7, 5, 7, 80, 70, True)}
