import random

import pytest
from pyspark.sql import functions as F

from strandweave.operators import align as A
from strandweave.operators import anchoring as N
from strandweave.operators import reports as R


def gap(n):
    return min(o + e * n for o, e in A.GAPS)


def score_of(q, t, cigar):
    total = i = j = size = 0
    for c in cigar:
        if c.isdigit():
            size = size * 10 + int(c)
            continue
        if c == "M":
            total += sum(0 if "N" in (a, b) else 1 if a == b else -9 for a, b in zip(q[i : i + size], t[j : j + size]))
            i, j = i + size, j + size
        else:
            total -= gap(size)
            i, j = (i + size, j) if c == "I" else (i, j + size)
        size = 0
    assert (i, j) == (len(q), len(t))
    return total


def best_score(q, t):
    n, m = len(q), len(t)
    far = -(10**9)
    s = [[far] * (m + 1) for _ in range(n + 1)]
    s[0][0] = 0
    for i in range(n + 1):
        for j in range(m + 1):
            if i and j:
                s[i][j] = s[i - 1][j - 1] + (0 if "N" in (q[i - 1], t[j - 1]) else 1 if q[i - 1] == t[j - 1] else -9)
            s[i][j] = max([s[i][j], *(s[k][j] - gap(i - k) for k in range(i)), *(s[i][k] - gap(j - k) for k in range(j))])
    return s[n][m]


def test_alignment_is_optimal():
    r = random.Random(1)
    for _ in range(150):
        t = "".join(r.choice("ACGTN") for _ in range(r.randrange(0, 25)))
        q = list(t)
        for _ in range(r.randrange(5)):
            p = r.randrange(len(q) + 1)
            q[p : p + r.randrange(4)] = "".join(r.choice("ACGT") for _ in range(r.randrange(4)))
        q = "".join(q)
        score, cigar = A.align_pair(q, t)
        assert score == score_of(q, t, cigar) == best_score(q, t), (q, t, cigar)


def test_long_gaps_take_the_second_cost():
    score, cigar = A.align_pair("ACGT" * 10, "ACGT" * 5 + "G" * 60 + "ACGT" * 5)
    assert score == 40 - (41 + 60) and cigar.count("D") == 1


def test_difference_strings(spark):
    assert A.difference_string("ACGTT", "ACCTGT", "4M1D1M") == (":2*cg:1-g:1".replace("cg", "CG").replace("-g", "-G"), 4, 2)
    df = spark.createDataFrame([(":2*CG:1-GG+A:3",)], "cs string")
    assert df.select(A.cs_to_cigar(F.col("cs"))).first()[0] == "2=1X1=2D1I3="


def test_consensus():
    r = random.Random(2)
    word = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    a, b = word(80), word(80)
    noisy = lambda s: s[:20] + r.choice("ACGT") + s[21:50] + s[51:]
    assert A.consensus([a]) == [a] and A.consensus([a, a, noisy(a)]) == [a]
    assert sorted(A.consensus([a] * 3 + [noisy(a)] + [b] * 2)) == sorted([a, b])
    assert A.consensus([a] * 7 + [b]) == [a]


def test_canberra_and_nearest(spark):
    df = spark.createDataFrame([([1, 0, 2], [1, 0, 1])], "a array<int>, b array<int>")
    assert abs(df.select(A.canberra(F.col("a"), F.col("b"))).first()[0] - 1 / 3) < 1e-12


def test_best_path_ties(spark):
    rows = [("r", 0, 1, side, v) for side in ("left", "right") for v in (9, 1, 4) for _ in range(1)]
    counts = {9: (3, 3), 1: (2, 6), 4: (3, 3)}
    rows, loc, vid = [], [], 0
    for path, (nl, nr) in counts.items():
        for side, n in (("left", nl), ("right", nr)):
            for _ in range(n):
                vid += 1
                rows.append(("r", 0, 1, side, vid))
                loc.append((vid, path))
    got = N.best_paths(spark.createDataFrame(rows, "k string, s int, e int, side string, vid int"), spark.createDataFrame(loc, "vid int, path int"), "k").first()
    assert (got.path, got.nl, got.nr) == (1, 2, 6)


def walked(rows):
    """Walks along each read and compares with the last string kept."""
    out = set()
    for key in {r[0] for r in rows}:
        last = None
        for _, i, s, l in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[3], r[1])):
            if last is None:
                last = (i, s, l)
            elif s == last[1]:
                if l >= last[2]:
                    last = (i, s, l)
                continue
            elif s + l == last[1] + last[2]:
                continue
            else:
                out.add(last[0])
                last = (i, s, l)
        out.add(last[0])
    return out


def test_contained_strings_against_a_walk(spark):
    r = random.Random(5)
    for n in (40, 400):
        rows = [(r.choice("ab"), i, s := r.randrange(60), r.choice((3, 5, 60 - s, 61 - s))) for i in range(n)]
        df = spark.createDataFrame(rows + [(None, 999, 1, 1)], "k string, i int, s int, l int")
        assert {x.i for x in N.without_contained(df, "k", "i", tile=8).collect()} == walked(rows)


def test_chain():
    assert N.chain([0, 10, 20, 30], [0, 10, 200, 30], 4) == [0, 1, 3]
    assert N.chain([0, 10], [10, 0], 2) == [0] and N.chain([], [], 0) == []
    assert N.chain([0, 5, 10], [0, 100, 10], 9) == [0, 2]


def test_six_rules(spark):
    rows = [("q", 1, 0.95, 3, 90, 100), ("q", 2, 1.0, 5, 80, 100), ("q", 3, 1.0, 4, 70, 100), ("q", 4, 1.0, 4, 90, 100), ("q", 5, 0.92, 3, 90, 100), ("z", 6, 0.1, 0, 1, 1), ("n", 7, None, 0, 1, 1)]
    df = spark.createDataFrame(rows, "query string, aln_id int, cov double, nm int, matches int, cigar_len int")
    got = {rule: {r.query: (r.aln_id, r.nm) for r in R.best_alignment(df, rule).collect()} for rule in "abcdef"}
    assert got["a"] == {"q": (3, 4), "z": (6, 0)} and got["b"] == {"q": (3, 4)} and got["c"]["q"] == (3, 4)
    assert got["d"]["q"] == (5, 3) and got["e"] == {"q": (2, 5), "z": (6, 0)} and got["f"]["q"] == (1, 3)


def test_endpoint_categories(spark):
    cases = {("a", "b", "b", "a"): "GOOD", ("a", "b", "a", "c"): "HALF_BAD", ("a", "b", "c", "d"): "BAD", ("a", "b", "~", "~"): "FULL_CLIP", ("a", "b", "~", "b"): "HALF_CLIP", ("a", "b", "~", "c"): "BAD_CLIP"}
    df = spark.createDataFrame(list(cases), "a string, b string, c string, d string")
    assert [r[0] for r in df.select(R.endpoint_category(*(F.col(c) for c in "abcd"))).collect()] == list(cases.values())


def test_homopolymer_indels(spark):
    alns = spark.createDataFrame([("a", "4=2I6=", 0), ("b", "4=4I6=", 0), ("c", "4=1D5=", 0)], "name string, cigar string, ps long")
    refs = spark.createDataFrame([(n, "ACGT" + "A" * 8 + "C") for n in "abc"], "name string, ref string")
    out = A.homopolymer_indels(A.operations(alns, "name", "cigar", F.col("ps")), refs, "name").where("drop").collect()
    assert sorted((r.name, r.op) for r in out) == [("a", "I"), ("c", "D")]


def test_reference_records(spark):
    df = spark.createDataFrame([("w", "c", 10, 40, True, "ACGTTTTTTTGGCA"), ("o", "c", 10, 16, False, "ACGTTTGGCA"), ("x", "c", 30, 20, True, "ACGTTTGGCA")], "name string, contig string, start long, end long, strand boolean, seq string")
    got = {r.qname: (r.flag, r.pos, r.cigar, r.seq) for r in A.reference_records(df, 4).collect()}
    assert got == {"w": (0, 11, "4M22N4M", "ACGTGGCA"), "o": (16, 11, "6M", "ACGGCA"[:2] + "GGCA"), "x.a1": (0, 28, "4M", "ACGT"), "x.a2": (0, 20, "4M", "GGCA")}


@pytest.mark.parametrize("seed", range(4))
def test_a_narrow_band_gives_the_whole_tables_result(seed):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("ACGTN" if seed == 3 else "ACGT") for _ in range(n))
    for _ in range(25):
        a = word(r.randrange(1, 90))
        cut_ = r.randrange(len(a))
        b = a[:cut_] + word(r.choice((0, 1, 30))) + a[cut_ + r.choice((0, 2, 25)) :] if r.random() < 0.7 else word(r.randrange(1, 90))
        b = b or "A"
        for costs in ((1, -9, ((16, 2), (41, 1))), (2, -3, ((4, 2),))):
            assert A.align_pair(a, b, *costs, band=1) == A.align_pair(a, b, *costs, band=1000)


def test_long_similar_strings_take_little_room():
    r = random.Random(9)
    a = "".join(r.choice("ACGT") for _ in range(20_000))
    b = a[:7_000] + "ACGTACGT" + a[7_000:15_000] + a[15_020:]
    score, cigar = A.align_pair(b, a)
    assert X_sum(cigar, "MI") == len(b) and X_sum(cigar, "MD") == len(a) and cigar.count("I") == 1 and cigar.count("D") == 1


def X_sum(cigar, ops):
    import re

    return sum(int(n) for n, o in re.findall("([0-9]+)([MID])", cigar) if o in ops)


@pytest.mark.parametrize("costs", [(1, -9, ((16, 2), (41, 1))), (2, -3, ((4, 2),)), (200, -300, ((16, 2), (41, 1)))])
def test_pairs_together_align_as_each_alone(costs):
    r = random.Random(11)
    word = lambda n, letters: "".join(r.choice(letters) for _ in range(n))
    pairs = [("", ""), ("", "ACG"), ("ACG", ""), ("ACGN", "ACGN"), ("CG", "ACG"), ("É", "A")]
    for _ in range(60):
        letters = r.choice(("ACGT", "ACGTN", "AC", "ACGTX"))
        a = word(r.randrange(70), letters)
        at = r.randrange(len(a) + 1)
        other = a[:at] + word(r.choice((0, 1, 30)), letters) + a[at + r.choice((0, 2, 25)) :]
        pairs.append((a, other if r.random() < 0.7 else word(r.randrange(70), letters)))
    want = [A.align_pair(*p, *costs) for p in pairs]
    for band in (1, 12):
        assert A.align_pairs(pairs, *costs, band=band) == want


def test_long_pairs_need_wider_numbers():
    r = random.Random(12)
    a = "".join(r.choice("ACGT") for _ in range(3_000))
    pairs = [(a[:900] + "ACGTAC" + a[900:2_000] + a[2_015:] + "C", a + "G"), (a, a[:1_500] + "N" + a[1_501:])]
    assert A.align_pairs(pairs) == [A.align_pair(*p) for p in pairs]


def test_pairs_of_a_query_are_aligned_once(spark):
    from strandweave.plans import report_queries as Q

    plan = Q.affine_align(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == plan.split("Initial Plan")[0].count("ArrowEvalPython") == 1
