import random

from pyspark.sql import functions as F

from strandweave.operators import augment as U
from strandweave.operators import graph as G
from strandweave.operators.ranks import dense_index

SEG = [(1, "ACGTA"), (2, "C"), (3, "G"), (4, "TTGCA")]


def graph(spark, walks, consensus=()):
    segs = spark.createDataFrame(SEG, "vid long, seq string").withColumn("len", F.length("seq").cast("long"))
    rows = [(p, s, abs(v), v < 0, p == 0, p in consensus, 2 * abs(v) + (v < 0)) for p, w in walks.items() for s, v in enumerate(w)]
    return segs, spark.createDataFrame(rows, "path int, step int, vid long, rev boolean, is_ref boolean, consensus boolean, h long")


def test_bubble(spark):
    segs, steps = graph(spark, {0: [1, 2, 4], 1: [1, 3, 4], 2: [-4, -3, -1]})
    assert {(r.path, r.seq) for r in G.spell_paths(steps, segs).collect()} == {(0, "ACGTACTTGCA"), (1, "ACGTAGTTGCA"), (2, "TGCAACTACGT")}
    assert {(r.h1, r.h2) for r in G.distinct_edges(steps).collect()} == {(2, 4), (4, 8), (2, 6), (6, 8), (9, 7), (7, 3)}
    assert G.path_edges(steps).select(*G.canonical_edge()).distinct().count() == 4
    assert sorted((r.path, r.step, r.off) for r in G.bp_offsets(steps, segs).collect())[:3] == [(0, 0, 0), (0, 1, 5), (0, 2, 6)]
    pairs = spark.createDataFrame([(2, 8)], "h1 long, h2 long")
    found = G.distances(G.subpaths(pairs, steps), G.bp_offsets(steps, segs))
    assert {(r.path, r.dist) for r in found.collect()} == {(0, 1), (1, 1)} and G.subpaths(pairs, steps, 1).count() == 1


def test_support_counts_reads_once_and_strands_apart(spark):
    segs, steps = graph(spark, {0: [1, 2, 4], 5: [1, 3, 4], 6: [1, 3], 7: [-3, -1]}, (5, 6, 7))
    one = spark.createDataFrame([(5, "a"), (6, "a")], "path int, read string")
    assert G.supported_vertices(steps, one, 2).count() == 0 and {r.vid for r in G.removable_vertices(steps, one).collect()} == {3}
    strands = spark.createDataFrame([(5, "a"), (7, "b")], "path int, read string")
    assert {r.vid for r in G.removable_vertices(steps, strands).collect()} == {3}
    two = spark.createDataFrame([(5, "a"), (6, "b")], "path int, read string")
    assert {(r.h, r.supp) for r in G.supported_vertices(steps, two, 2).collect()} == {(6, 2)} and G.removable_vertices(steps, two).count() == 0


def test_spellings_and_parsimony(spark):
    segs, steps = graph(spark, {0: [1, 2, 4], 1: [1, 3, 4]})
    segs = segs.unionByName(spark.createDataFrame([(5, "CTT", 3), (6, "GCA", 3), (7, "", 0)], "vid long, seq string, len long"))
    edges = G.distinct_edges(steps).unionByName(spark.createDataFrame([(2, 10), (10, 12), (12, 8), (14, 14)], "h1 long, h2 long"))
    targets = spark.createDataFrame([("x", 2, 8, "ACGTACTTGCA"), ("y", 2, 12, "ACGTACTTGCA"), ("z", 2, 8, "AAAA")], "key string, source long, sink long, seq string")
    assert {(r.key, tuple(r.walk)) for r in G.spellings(targets, edges, segs).collect()} == {("x", (2, 4, 8)), ("y", (2, 10, 12))}
    known = spark.createDataFrame([(2,), (4,), (8,)], "h long")
    rows = [("g", 1, 2), ("g", 1, 10), ("h", 1, 2), ("h", 1, 6), ("h", 2, 2), ("h", 2, 4)]
    cands = spark.createDataFrame(rows, "grp string, path int, h long")
    assert [tuple(r) for r in G.fewest_novel(cands, known, "grp", "path").collect()] == [("g", 1, 1)]


def test_components_and_chains_against_loops(spark):
    r = random.Random(3)
    vertices = list(range(60))
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 140)] + [(200, 201), (201, 202), (202, 200)]
    vertices += list(range(100, 141)) + [200, 201, 202]
    label = {v: v for v in vertices}
    for _ in vertices:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    v, e = spark.createDataFrame([(x,) for x in vertices], "vid long"), spark.createDataFrame(edges, "a long, b long").distinct()
    assert {x.vid: x.component for x in G.components(v, e).collect()} == label
    chains = {x.vid: (x.head, x.place) for x in G.unary_chains(v, e).collect()}
    assert all(chains[100 + i] == (100, i) for i in range(41)) and all(chains[i] == (i, 0) for i in (200, 201, 202)) and set(chains) == set(vertices)


def test_breadth_first(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 4), (4, 9), (3, 8), (5, 5)], "a long, b long")
    src = spark.createDataFrame([(1,), (5,), (8,)], "vid long")
    aim = spark.createDataFrame([(8,), (9,)], "vid long")
    assert {tuple(r) for r in G.first_reached(src, e, aim, 5).collect()} == {(1, 2, 9), (8, 0, 8)}


def test_dense_numbers(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "v int")
    assert sorted((r.v, r.n) for r in dense_index(df, ["v"]).collect()) == [(i, i + 1) for i in range(101)]
    walks = G.rewritten_walks(graph(spark, {0: [4, -1]})[1], spark.createDataFrame([(1, 10), (4, 40)], "vid long, new long"))
    assert walks.first().walk == ">40<10"


def test_embedding_keeps_what_paths_spell(spark):
    segs = spark.createDataFrame([("1", "ACGTACGT"), ("2", "GGGG"), ("3", "TTTTCCCC")], "id string, seq string")
    steps = spark.createDataFrame([("ref", 0, "1", False), ("ref", 1, "2", False), ("ref", 2, "3", False), ("back", 0, "3", True), ("back", 1, "1", True)], "path string, step int, id string, rev boolean")
    # the walk >1>2>3 from offset 2 on: 4=, 1X (A for G), 1=, 4D, 3=, 2I, 3=
    alns = spark.createDataFrame([("cns-0", "4=1X1=4D3=2I3=", 2, "GTAC" + "A" + "T" + "TTT" + "GA" + "TCC"), ("cns-1", "3=", 1, "GCC")], "name string, cigar string, ps long, seq string")
    walks = spark.createDataFrame([("cns-0", 0, "1", False), ("cns-0", 1, "2", False), ("cns-0", 2, "3", False), ("cns-1", 0, "2", True)], "name string, step int, id string, rev boolean")
    alns = alns.where("name = 'cns-0'").unionByName(spark.createDataFrame([("cns-1", "3=", 1, "CCC")], alns.schema))
    before = {r.path: r.seq for r in U.spelled(segs, steps).collect()}
    s, p = U.embed(segs, steps, alns, walks)
    after = {r.path: r.seq for r in U.spelled(s, p).collect()}
    assert after == before | {"cns-0": "GTACATTTTGATCC", "cns-1": "CCC"}
    s2, p2 = U.unchopped(s, p)
    assert {r.path: r.seq for r in U.spelled(s2, p2).collect()} == after and s2.count() <= s.count()
    s3, p3 = U.numbered(s2, p2)
    assert {r.path: r.seq for r in U.spelled(s3, p3).collect()} == after and {r.id for r in s3.collect()} == {str(i + 1) for i in range(s3.count())}
    weak = spark.createDataFrame([("cns-0", "a"), ("cns-1", "a")], "path string, read string")
    kept = {r.path for r in U.supported(s, p, weak, "cns-", 2)[1].select("path").distinct().collect()}
    assert kept == {"ref", "back", "cns-1"}  # cns-1 walks known letters only
