"""Queries over small tables of their own, where a cut of the job would show."""

import random
from collections import Counter

from strandweave.plans import graph_queries as Q
from strandweave.plans import kmer_queries as M
from strandweave.plans import report_queries as R


def tables(spark, folder, **rows):
    """The folder with a table for each (schema, rows)."""
    for name, (schema, values) in rows.items():
        spark.createDataFrame(values, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


SEGMENTS, PATHS = "id string, vid long, seq string", "cp_id long, cluster_id long, vertices array<long>"


def test_siblings_spell_the_same_to_the_end(spark, tmp_path):
    segs = [("a", 1, "TT"), ("b", 2, "ACGTA"), ("c", 3, "ACGTC"), ("d", 4, "ACGTA"), ("e", 5, "TACGT")]
    d = tables(spark, tmp_path, segments=(SEGMENTS, segs), cand_paths=(PATHS, [(i, 1, [2, h]) for i, h in enumerate((4, 6, 8, 11))]))
    # 11 is segment 5 the other way round, ACGTA as well; 6 has only its first letters in common
    assert {tuple(r) for r in Q.redundant_siblings(spark, d).collect()} == {(2, v, w) for v in (4, 8, 11) for w in (4, 8, 11) if v != w}


def test_reference_is_found_however_far(spark, tmp_path):
    # path 10 is the reference; of the others one comes to it after 9 steps, one earlier by a branch, one never
    walks = [(10, [100, 101]), (1, [*range(1, 10), 101]), (2, [20, 8]), (3, [30, 31, 30])]
    d = tables(spark, tmp_path, segments=(SEGMENTS, []), cand_paths=(PATHS, [(p, 1, [2 * v for v in w]) for p, w in walks]))
    want = {(i, 10 - i, 101) for i in range(1, 10)} | {(20, 3, 101)}
    assert {tuple(r) for r in Q.bfs_first_reference(spark, d).collect()} == want


def test_walks_of_any_length_are_spelled(spark, tmp_path):
    n = 70
    d = tables(spark, tmp_path, segments=(SEGMENTS, [(str(i), i, "ACGT"[i % 4]) for i in range(n)]), cand_paths=(PATHS, [(3, 1, [2 * i for i in range(n)])]))
    assert [tuple(r) for r in Q.dp_spell_paths(spark, d).collect()] == [(3, ",".join(str(2 * i) for i in range(n)))]


def test_region_between_reference_vertices(spark, tmp_path):
    walks = [(10, [100, 101, 102]), (1, [100, *range(1, 8), 102]), (2, [8, 102])]
    segs = [(str(v), v, "ACGTA") for v in (100, 101, 102)]
    d = tables(spark, tmp_path, segments=(SEGMENTS, segs), cand_paths=(PATHS, [(p, 1, [2 * v for v in w]) for p, w in walks]))
    assert {tuple(r) for r in Q.bfs_reference_region(spark, d).collect()} == {(i, 100, 102, 10, 0, 10) for i in range(1, 8)}


def test_subpaths_of_all_pairs_against_a_loop(spark, tmp_path):
    r = random.Random(5)
    paths = {i: [2 * r.randrange(1, 12) + r.randrange(2) for _ in range(r.randrange(1, 9))] for i in range(1, 40)}
    size = {v: r.choice((1, 150, 9_000, 21_000)) for v in range(1, 12)}
    d = tables(spark, tmp_path, segments=(SEGMENTS, [(str(v), v, "A" * n) for v, n in size.items()]), cand_paths=(PATHS, [(i, 1, w) for i, w in paths.items()]))
    near, first = set(), set()
    for h1, h2 in {(w[0], w[-1]) for w in paths.values() if len(w) > 1}:
        found = [(p, a, min(b for b in range(a, len(w)) if w[b] == h2)) for p, w in sorted(paths.items()) for a in range(len(w)) if w[a] == h1 and h2 in w[a:]]
        first |= {(h1, h2, *x) for x in found[:10]}
        near |= {(h1, h2, p, a, n) for p, a, b in found if (n := sum(size[h >> 1] for h in paths[p][a + 1 : b])) <= 20_000}
    assert {tuple(x) for x in Q.subpaths_between(spark, d).collect()} == first
    assert {tuple(x) for x in Q.path_distance_guard(spark, d).collect()} == near


def test_twenty_anchors_a_side_vote_and_both_sides_chain(spark, tmp_path):
    # around a stretch that the sketch lacks lie seven anchors a side on paths of their own, then 20 a side on a common one
    r = random.Random(8)
    word = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    far1, near1, gap, near2, far2 = (word(n) for n in (30, 27, 15, 17, 30))
    segs = [(str(i), i, s) for i, s in enumerate((far1, near1, near2, far2), 1)]
    d = tables(spark, tmp_path, segments=(SEGMENTS, segs), cand_paths=(PATHS, [(1, 1, [2, 8]), (2, 1, [4]), (3, 1, [6])]), sfs=("sfs_id long, plain_seq string", [(1, far1 + near1 + gap + near2 + far2)]))
    at = f"s = {len(far1 + near1) - 10}"
    for q in (R.anchors_topn_left, R.anchors_topn_right):
        assert {x.r for x in q(spark, d).where(at).collect()} == set(range(1, 21))
    assert [(x.path, x.nl, x.nr) for x in R.anchor_best_path(spark, d).where(at).collect()] == [(1, 13, 13)]
    assert {(x.side, x.anchors, x.chained) for x in R.chain_greedy(spark, d).where(at).collect()} == {("left", 13, 13), ("right", 13, 13)}


def test_whole_segments_take_part(spark, tmp_path):
    r = random.Random(2)
    texts = ["ACGTTTTTTTTTTGGGGA", "A", "".join(r.choice("ACGT") for _ in range(57)), "".join(r.choice("ACCCCN") for _ in range(40))]
    d = tables(spark, tmp_path, segments=(SEGMENTS, [(str(i), i, t) for i, t in enumerate(texts)]))
    runs = {(i, a, len(t[a:]) - len(t[a:].lstrip(t[a]))) for i, t in enumerate(texts) for a in range(len(t))}
    assert sorted(tuple(x) for x in M.homopolymer_runs(spark, d).collect()) == sorted(runs)
    words = {(i, a, t[a : a + 21]) for i, t in enumerate(texts) for a in range(len(t) - 20) if "N" not in t[a : a + 21]}
    got = M.kmer_encode_decode(spark, d).collect()
    assert {(x.vid, x.pos, x.word) for x in got} == words and all(int("".join(str("ACGT".index(c)) for c in x.word), 4) == x.code for x in got)
    slices = M.revcomp_slices(spark, d).orderBy("vid", "at").collect()
    assert ["".join(x.slice for x in slices if x.vid == i) for i in range(len(texts))] == texts
    assert all(x.rc == x.slice[::-1].translate(str.maketrans("ACGT", "TGCA")) and x.canonical == min(x.slice, x.rc) for x in slices)


def test_absent_strings_of_any_length(spark, tmp_path):
    from .test_sequences import absent

    r = random.Random(4)
    word = lambda n, of="ACGT": "".join(r.choice(of) for _ in range(n))
    panel = [word(r.randrange(1, 120)) for _ in range(6)] + [word(60, "AC"), word(50) + "NN" + word(50)]
    inner = [word(n) for n in (9, 11, 17, 18, 19, 38, 70)]
    panel += [x for u in inner for x in ("A" + u, u + "C")]  # so that A + u + C is absent, and nothing in it
    rc = lambda t: t[::-1].translate(str.maketrans("ACGT", "TGCA"))
    reads = [p[r.randrange(5) :] + word(3) for p in panel] + [rc(p) for p in panel] + [word(40), word(40, "AC"), panel[0] + "N" + panel[1], "A", panel[5] + panel[4]]
    reads += ["A" + u + "C" for u in inner] + [rc("A" + u + "C") for u in inner]
    d = tables(spark, tmp_path, segments=(SEGMENTS, [(str(i), i, t) for i, t in enumerate(panel)]), sfs=("sfs_id long, plain_seq string", list(enumerate(reads))))
    want = absent(enumerate(reads), panel, 1000)
    assert {11, 13, 19, 20, 21, 40, 72} <= {n for _, _, n in want}
    got = {x.l: (x.n, x.places) for x in M.sfs_bounded(spark, d).collect()}
    assert got == {n: (sum(x[2] == n for x in want), sum(i * (s + 1) for i, s, m in want if m == n)) for n in {x[2] for x in want}}
    assert {x.l: x.n for x in M.sfs_full(spark, d).collect()} == Counter(x[2] for x in want)
    joined = set()
    for i in {x[0] for x in want}:
        own = []
        for s, n in sorted(x[1:] for x in want if x[0] == i):
            if own and s < own[-1][1]:
                own[-1][1] = max(own[-1][1], s + n)
            else:
                own.append([s, s + n])
        joined |= {(i, s, e - s) for s, e in own}
    assert {tuple(x) for x in M.sfs_assembled(spark, d).collect()} == joined
