import random

import pytest

from strandweave.llm import neardup
from strandweave.llm.neardup import kmer_sets, near_classes, near_duplicates

K = 7


def kmers(t):
    t = t.upper()
    out = set()
    for i in range(len(t) - K + 1):
        w = t[i : i + K]
        if set(w) <= set("ACGT"):
            out.add(min(w, w[::-1].translate(str.maketrans("ACGT", "TGCA"))))
    return out


def brute(rows):
    sets = {i: kmers(t) for i, _, _, t in rows if i is not None and t is not None}
    at = {i: {a, b} - {None} for i, a, b, t in rows}
    out = set()
    ids = sorted(i for i in sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and at[i] & at[j] and 2 * both >= len(sets[i] | sets[j]):
                out.add((i, j))
    return out


def some(seed, n=260):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    base = [word(r.choice((30, 60, 90, 400))) for _ in range(12)]
    rows = []
    for i in range(n):
        t = list(r.choice(base))
        for _ in range(r.randrange(4)):
            p = r.randrange(len(t))
            t[p : p + r.randrange(3)] = word(r.randrange(3)) + r.choice(("", "N"))
        t = "".join(t)
        if r.random() < 0.2:
            t = t[::-1].translate(str.maketrans("ACGT", "TGCA"))
        anchor = lambda: r.choice((1, 1, 1, 2, 3, None))
        rows.append((i, anchor(), anchor(), t.lower() if i % 9 == 0 else t))
    rows += [(1000, 1, 1, "A" * 40), (1001, 1, None, "T" * 30), (1002, 1, 2, ""), (1003, 1, 2, None), (None, 1, 1, base[0]), (1004, None, None, base[0]), (1005, 2, 1, "NNNN" * 9), (1006, 2, 1, "ACG")]
    return rows


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("crowded", [10**9, 60, 8])
def test_against_all_pairs(spark, seed, crowded):
    rows = some(seed)
    df = spark.createDataFrame(rows, "id long, v1 long, v2 long, text string")
    got = [(r.id_a, r.id_b) for r in near_duplicates(df, K, crowded=crowded).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_kmer_sets_against_strings():
    import pyarrow as pa

    from strandweave.functions.letters import letters

    texts = [r[3] or "" for r in some(5)] + ["", "漢字ACGTACGTACGT"]
    row, kmer = kmer_sets(*letters(pa.array(texts)), K)
    code = lambda w: sum("ACGT".index(c) << 2 * (K - 1 - i) for i, c in enumerate(w))
    for i, t in enumerate(texts):
        assert set(kmer[row == i].tolist()) == {code(w) for w in kmers(t)}


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "id long, v1 long, v2 long, text string")).count() == 0
    assert near_classes(spark.createDataFrame([], "id long, v1 long, v2 long, text string")).count() == 0


def with_copies():
    rows = some(3, 120)
    return rows + [(2000 + i, b, a, t.lower() if t else t) for i, a, b, t in rows if i is not None and i % 3 == 0] + [(5000 + i, 1, 1, "N" * 30) for i in range(5)]


@pytest.mark.parametrize("crowded", [10**9, 20])
def test_copies_are_pairs_too(spark, crowded):
    rows = with_copies()
    got = [(r.id_a, r.id_b) for r in near_duplicates(spark.createDataFrame(rows, "id long, v1 long, v2 long, text string"), K, crowded=crowded).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_classes_links_and_groups(spark):
    rows = with_copies()
    got = {r["id"]: (r["class"], r["n_links"], r["group"]) for r in near_classes(spark.createDataFrame(rows, "id long, v1 long, v2 long, text string"), K).collect()}
    known = [(i, frozenset({a, b} - {None}), t.upper()) for i, a, b, t in rows if i is not None and t is not None and (a, b) != (None, None)]
    first = {}
    for i, v, t in sorted(known, key=lambda x: x[0]):
        first.setdefault((v, t), i)
    of = {i: first[v, t] for i, v, t in known}
    links = {(of[a], of[b]) for a, b in brute(rows) if of[a] != of[b]}
    links |= {(b, a) for a, b in links}
    group = {c: c for c in of.values()}
    for _ in group:
        for a, b in links:
            group[a] = min(group[a], group[b])
    assert got == {i: (c, sum(a == c for a, _ in links), group[c]) for i, c in of.items()}


def test_no_key_is_crowded_by_size_alone(spark, monkeypatch):
    """Beyond CELLS * crowded rows the limit grows with the table, so evenly spread keys stay whole."""
    monkeypatch.setattr(neardup, "CELLS", 4)
    df = spark.createDataFrame([(i % 40,) for i in range(4000)] + [(99,)] * 1500, "anchor long")
    found = neardup._crowds(df, ["anchor"], 10).collect()
    assert [(r.anchor, r.parts) for r in found] == [(99, 2)] and neardup._crowds(df, ["anchor"], 2000) is None


def test_a_class_of_many_copies_stays_out_of_shuffles(spark):
    rows = with_copies() + [(9000 + i, 1, 2, "ACGTACGTACGGT") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, v1 long, v2 long, text string")
    a, b = ({tuple(x) for x in neardup.further_copies(df, n).collect()} for n in (2, 1 << 20))
    assert a == b and {(9000 + i, 9000) for i in range(1, 40)} <= a
