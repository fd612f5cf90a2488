import random

import pytest

from strandweave.operators import intervals as I
from strandweave.operators.ordered import depth, running_sum, with_previous


def merged(rows, touching=False):
    out = {}
    for key, s, e in sorted(rows):
        own = out.setdefault(key, [])
        if own and (s <= own[-1][1] if touching else s < own[-1][1]):
            own[-1][1] = max(own[-1][1], e)
        else:
            own.append([s, e])
    return out


def some(seed, n=400, span=300):
    r = random.Random(seed)
    return [(r.choice("aaab"), s, s + r.choice((1, 3, 20, 90))) for s in (r.randrange(span) for _ in range(n // 8))] + [("hot", s, s + r.randrange(1, 6)) for s in (r.randrange(4000) for _ in range(n))]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("tile", [7, 64, 1 << 16])
@pytest.mark.parametrize("touching", [False, True])
def test_islands_against_a_loop(spark, seed, tile, touching):
    rows = some(seed)
    df = spark.createDataFrame(rows + rows[:5], "key string, s long, e long")
    want = {(k, s, e, own[i + 1][0] if i + 1 < len(own) else None) for k, own in merged(rows, touching).items() for i, (s, e) in enumerate(own)}
    got = [tuple(r) for r in I.islands(df, touching, tile).select("key", "s", "e", "next_s").collect()]
    assert set(got) == want and len(got) == len(want)


def test_touching_stay_apart(spark):
    df = spark.createDataFrame([("x", 0, 5), ("x", 5, 8), ("x", 7, 9)], "key string, s long, e long")
    assert {(r.s, r.e) for r in I.islands(df).collect()} == {(0, 5), (5, 9)}


def test_one_interval_over_many_tiles(spark):
    df = spark.createDataFrame([("x", 0, 1000), ("x", 500, 510), ("x", 999, 1001), ("x", 1500, 1501)], "key string, s long, e long")
    assert {(r.s, r.e, r.next_s) for r in I.islands(df, tile=10).collect()} == {(0, 1001, 1500), (1500, 1501, None)}


def test_spans_with_nulls_and_nonsense(spark):
    rows = [("a", 1, 2, None), ("a", None, 2, 10), ("a", 20, None, 25), ("a", None, None, 5), ("a", -1, 5, 4), ("a", 30, 0, 30), (None, 1, 2, 3), ("a", 40, 5, 99)]
    df = spark.createDataFrame(rows, "k string, s int, l int, e int")
    assert {(r.s, r.e) for r in I.complete_spans(df, "k").collect()} == {(1, 3), (8, 10), (20, 25), (40, 45)}


def test_gaps_within_limits_and_empty(spark):
    df = spark.createDataFrame([("x", 0, 5), ("x", 6, 8), ("x", 100, 110), ("x", 110, 111)], "key string, s long, e long")
    got = {(r.kind, r.s, r.e) for r in I.periods_and_gaps(df, 1, 50).collect()}
    assert got == {("period", 0, 5), ("period", 6, 8), ("period", 100, 110), ("period", 110, 111), ("gap", 5, 6)}
    assert I.periods_and_gaps(df.where("false")).count() == 0


def test_bin_join_gives_each_pair_once(spark):
    r = random.Random(1)
    a = [(i, r.choice("xy"), s, s + r.randrange(1, 50)) for i, s in enumerate(r.randrange(300) for _ in range(60))]
    b = [(i, r.choice("xy"), s, s + r.randrange(1, 50)) for i, s in enumerate(r.randrange(300) for _ in range(60))]
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < y[3] and y[2] < x[3])
    dfs = [spark.createDataFrame(t, "i int, chrom string, s int, e int") for t in (a, b)]
    assert sorted((p.i, p.b_i) for p in I.bin_join(*dfs, 16).collect()) == want


def test_previous_and_running_sum_over_tiles(spark):
    r = random.Random(2)
    rows = [("k", p, i) for i, p in enumerate(r.randrange(200) for _ in range(150))] + [("other", 3, 0)]
    df = spark.createDataFrame(rows, "k string, p int, v int")
    got = {(x.k, x.p, x.v): x.prev and x.prev.v for x in with_previous(df, "k", ["p", "v"], ["v"], 10).collect()}
    own = sorted((p, v) for k, p, v in rows if k == "k")
    assert all(got["k", p, v] == (own[i - 1][1] if i else None) for i, (p, v) in enumerate(own)) and got["other", 3, 0] is None
    sums = {x.p: x.sum for x in running_sum(df.where("k = 'k'"), "k", "p", "v", 10).collect()}
    assert all(n == sum(v for q, v in own if q <= p) for p, n in sums.items())


def test_depth_against_a_loop(spark):
    rows = [("a", 0, 5), ("a", 3, 9), ("a", 3, 4), ("a", 20, 21)]
    got = {(r.s, r.e, r.depth) for r in depth(spark.createDataFrame(rows, "key string, s long, e long"), 4).collect()}
    assert {p: d for s, e, d in got for p in range(s, e)} == {p: n for p in range(30) if (n := sum(s <= p < e for _, s, e in rows))}
