import random
from collections import Counter

import pytest

from strandweave.llm.runs import LEAST, collapse_units
from strandweave.llm.terms import reverse_complement_code, term_counts, term_pairs, vector_terms


def test_terms_against_counters(spark):
    r = random.Random(1)
    rows = [(r.choice((7, 7, 7, r.randrange(50), None)), r.choice((1, 2, 3, r.randrange(40), None))) for _ in range(4000)]
    df = spark.createDataFrame(rows, "t long, r int").repartition(6)
    got = {(x.term): (x.total, x.n_records) for x in term_counts(term_pairs(df, "a", "t", "r")).collect()}
    known = [(t, x) for t, x in rows if t is not None and x is not None]
    records = Counter(t for t, _ in set(known))
    assert got == {t: (n, records[t]) for t, n in Counter(t for t, _ in known).items()}


def test_vectors_and_empty(spark):
    rows = [([0, 2, 1],), ([],), (None,), ([3, None, 0, 5],), ([0, 0, 0],)]
    df = spark.createDataFrame(rows, "v array<int>")
    got = {(x.src, x.term, x.total, x.n_records) for x in term_counts(vector_terms(df, "k", "v")).collect()}
    assert got == {("k", 0, 3, 1), ("k", 1, 2, 1), ("k", 2, 1, 1), ("k", 3, 5, 1)}
    assert term_counts(vector_terms(df.where("false"), "k", "v")).count() == 0


@pytest.mark.parametrize("k", [1, 5, 21, 31])
def test_reverse_complement_of_codes(spark, k):
    from pyspark.sql import functions as F

    r = random.Random(k)
    codes = [r.randrange(4**k) for _ in range(50)]

    def rc(x):
        out = 0
        for _ in range(k):
            out, x = out << 2 | 3 - (x & 3), x >> 2
        return out

    df = spark.createDataFrame([(c,) for c in codes], "c long")
    assert [x[0] for x in df.select(reverse_complement_code(F.col("c"), k)).collect()] == [rc(c) for c in codes]


def runs(text):
    out = set()
    t = text.upper()
    for unit, least in LEAST.items():
        u = list(t)
        if unit == 1:
            for i in range(1, len(t) - 1):
                if t[i] == "N" and t[i - 1] == t[i + 1] and t[i - 1] in "ACGT":
                    u[i] = t[i - 1]
        a = 0
        while a < len(u):
            if u[a] not in "ACGT":
                a += 1
                continue
            b = a + 1
            while b < len(u) and u[b] in "ACGT" and (b - a < unit or u[b] == u[b - unit]):
                b += 1
            maximal = a == 0 or u[a - 1] not in "ACGT" or a + unit - 1 >= len(u) or u[a - 1] != u[a + unit - 1]
            if b - a >= least and maximal and (unit == 1 or len(set(u[a:b])) > 1):
                out.add((unit, a, b - a))
            a += 1
    return out


def test_runs_against_a_loop(spark):
    r = random.Random(2)
    texts = []
    for _ in range(150):
        parts = []
        for _ in range(r.randrange(6)):
            unit = "".join(r.choice("ACGTN") for _ in range(r.randrange(1, 4)))
            parts.append((unit * 20)[: r.randrange(1, 30)] + "".join(r.choice("ACGTNacn") for _ in range(r.randrange(3))))
        texts.append("".join(parts))
    texts += ["", "A" * 8, "A" * 7, "AAAANAAA", "AAAANNAAAA", "NAAAAAAAN", "漢AAAAAAAAA漢", "ACACACACACAC", "AAAAAAAAAAAAC", None]
    df = spark.createDataFrame(list(enumerate(texts)), "rid long, text string")
    got = [(x.rid, x.unit, x.start_pos, x.run_len) for x in collapse_units(df).collect()]
    want = {(i, *run) for i, t in enumerate(texts) if t for run in runs(t)}
    assert set(got) == want and len(got) == len(want)
