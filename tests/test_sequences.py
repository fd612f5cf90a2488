import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandweave.functions import seqexpr as X
from strandweave.functions.letters import chunks, letters, ranges
from strandweave.operators import search, sketch


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expr.alias("x")).first().x


def test_codes_and_strands(spark):
    c = F.col("w")
    assert one(spark, X.reverse_complement(c), w="AACGn") == "nCGTT"
    assert one(spark, X.canonical(c), w="CGTT") == "AACG"
    assert one(spark, X.encode(c, 4), w="AACG") == 6 and one(spark, X.encode(c, 4), w="AANG") is None
    assert one(spark, X.encode(c, 31), w="T" * 31) == 4**31 - 1
    assert one(spark, X.decode(c, 31), w=4**31 - 1) == "T" * 31 and one(spark, X.decode(c, 3), w=64) is None
    with pytest.raises(ValueError):
        X.encode(c, 32)


def test_alignment_strings(spark):
    c = F.col("c")
    assert [tuple(o) for o in one(spark, X.cigar(c), c="12=1X3D")] == [(12, "="), (1, "X"), (3, "D")]
    assert one(spark, X.cigar_text(X.merge_operations(X.cigar(c))), c="2=3=1X1X4=") == "5=2X4="
    assert one(spark, X.cigar_sum(c, "=I"), c="2=3I4D") == 5 and one(spark, X.cigar_expand(c), c="2=1D") == "==D"
    assert one(spark, X.walk_text(X.walk(c)), c=">a<b.1>c") == ">a<b.1>c"
    assert one(spark, X.run_length(c, F.lit(2)), c="ACGGGGT") == 4


def test_windows(spark):
    n = F.col("n")
    assert [w.start for w in one(spark, X.overlapping_windows(n, 4), n=10)] == [0, 2, 4, 6, 8]
    assert [tuple(w) for w in one(spark, X.overlapping_windows(n, 4), n=3)] == [(0, 3)]
    assert one(spark, X.overlapping_windows(n, 4), n=0) is None


def test_kmers_skip_other_letters_and_short_texts(spark):
    df = spark.createDataFrame([(1, "ACGNACGTT"), (2, "AC"), (3, None), (4, "")], "i int, seq string")
    got = {(r.i, r.pos, r.kmer, r.rev) for r in X.kmers(df, "seq", 4, ["i"]).collect()}
    assert got == {(1, 4, "ACGT", False), (1, 5, "AACG", True)}


def test_sampling_is_a_share_and_always_the_same(spark):
    df = spark.range(4000).select(F.col("id").cast("string").alias("w"))
    n = df.where(X.sampled(F.col("w"), 0.25)).count()
    assert 850 < n < 1150 and n == df.where(X.sampled(F.col("w"), 0.25)).count() and df.where(X.sampled(F.col("w"), 1)).count() == 4000


def test_unique_kmers_and_flags(spark):
    rows = [("AAA", False, False, 1, 5), ("AAA", True, True, 1, 5), ("CCC", False, False, 1, 1), ("CCC", False, False, 2, 1)]
    df = spark.createDataFrame(rows, "kmer string, rev boolean, is_ref boolean, vid int, pos int")
    assert [(r.kmer, r.vid, r.is_ref, r.has_both) for r in sketch.unique_kmers(df, ["vid", "pos"]).collect()] == [("AAA", 1, True, True)]


def test_uncovered_runs_end_at_a_hit(spark):
    df = spark.createDataFrame([("r", i, h) for i, h in enumerate((True, False, False, True, False))], "k string, pos int, hit boolean")
    assert [(r.s, r.e) for r in sketch.uncovered(df, "k").collect()] == [(1, 3)]
    assert sorted((r.s, r.e) for r in sketch.uncovered(df, "k", open_end=True).collect()) == [(1, 3), (4, 5)]


def absent(reads, panel, longest):
    both = panel + [p[::-1].translate(str.maketrans("ACGT", "TGCA")) for p in panel]
    has = lambda w: any(w in p for p in both) and set(w) <= set("ACGT")
    out = set()
    for i, t in reads:
        for s in range(len(t)):
            for n in range(1, min(longest, len(t) - s) + 1):
                w = t[s : s + n]
                if not has(w):
                    if n == 1 or has(w[1:]):
                        out.add((i, s, n))
                    break
    return out


@pytest.mark.parametrize("seed", range(2))
def test_minimal_absent_against_a_loop(spark, seed):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    panel = [word(r.randrange(1, 60)) for _ in range(5)]
    reads = [(i, word(r.randrange(1, 40)) if i % 2 else r.choice(panel)[:30] + "N" + word(5)) for i in range(12)] + [(50, panel[0]), (51, "ACGGAC")]
    a, b = spark.createDataFrame(reads, "i int, seq string"), spark.createDataFrame([(p,) for p in panel] + [(None,)], "seq string")
    got = {(x.i, x.s, x.l) for x in search.minimal_absent(a, b, "i", "seq", 6).collect()}
    # a bound on the length also bounds what the next start is known to reach
    assert {x for x in got if x[2] < 6} == {x for x in absent(reads, panel, 6) if x[2] < 6}
    assert {(x.i, x.s, x.l) for x in search.minimal_absent_any(a, b, "i", "seq").collect()} == absent(reads, panel, 100)
    with pytest.raises(ValueError):
        search.minimal_absent_any(a, b, "i", "seq", most_letters=1)


def test_letters_of_batches():
    col = pa.array(["ab", None, "", "漢x"]).slice(1)
    codes, offsets = letters(col)
    assert offsets.tolist() == [0, 0, 0, 2] and codes.tolist() == [ord("漢"), ord("x")]
    assert letters(pa.array([], pa.string()))[1].tolist() == [0] and letters(pa.array([None], pa.string()))[0].size == 0
    assert ranges(*map(__import__("numpy").array, ([5, 0, 9], [2, 0, 3]))).tolist() == [5, 6, 9, 10, 11]


def test_chunks_never_cut_a_key():
    r = random.Random(1)
    keys = sorted(r.randrange(8) for _ in range(200))
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 7])], names=["k"]) for i in range(0, 200, 7)]
    parts = [t.column("k").to_pylist() for t in chunks(iter(batches), "k", 20)]
    assert sum(parts, []) == keys and all(a[-1] != b[0] for a, b in zip(parts, parts[1:]))
