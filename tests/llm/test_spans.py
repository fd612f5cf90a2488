import random
from collections import Counter

import pytest

from strandweave.llm import spans
from strandweave.llm.spans import repeated_letters, shared_letters


def brute(rows, span):
    where = {}
    for rid, t in rows:
        if rid is not None and t is not None:
            for i in range(len(t) - span + 1):
                where.setdefault(t[i : i + span], set()).add(rid)
    out = {}
    for rid, t in rows:
        if rid is None or t is None:
            continue
        covered = set()
        for i in range(len(t) - span + 1):
            if len(where[t[i : i + span]]) > 1:
                covered |= set(range(i, i + span))
        if covered:
            out[rid] = len(covered)
    return out


def some(seed, letters="ACGT"):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice(letters) for _ in range(n))
    shared = [word(40) for _ in range(4)]
    rows = []
    for i in range(120):
        parts = [word(r.randrange(30))]
        for _ in range(r.randrange(3)):
            s = r.choice(shared)
            a = r.randrange(20)
            parts += [s[a : a + r.randrange(5, 40)], word(r.randrange(20))]
        rows.append((i, "".join(parts)))
    rows += [(200 + i, shared[0]) for i in range(30)] + [(300, rows[5][1]), (301, rows[5][1].lower()), (302, ""), (303, None), (None, shared[0]), (304, "A" * 100), (305, "AC" * 60)]
    return rows


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("crowded", [10**9, 3, 0])
def test_against_all_runs(spark, seed, crowded):
    rows = some(seed)
    got = {r.rid: r.n_shared for r in shared_letters(spark.createDataFrame(rows, "rid long, text string"), 15, crowded).collect()}
    assert got == brute(rows, 15)


@pytest.mark.parametrize("letters", ["ACGTacgtN", "AГ漢😀"])
def test_other_letters_count_as_stored(spark, letters):
    rows = some(9, letters)
    got = {r.rid: r.n_shared for r in shared_letters(spark.createDataFrame(rows, "rid long, text string"), 15).collect()}
    assert got == brute(rows, 15)


def brute_later(rows, span):
    seen, out = set(), {}
    for rid, t in sorted(r for r in rows if None not in r):
        covered = set()
        for i in range(len(t) - span + 1):
            if t[i : i + span] in seen:
                covered |= set(range(i, i + span))
            seen.add(t[i : i + span])
        if covered:
            out[rid] = len(covered)
    return out


@pytest.mark.parametrize("letters", ["ACGT", "ACGTacgtN", "AГ漢😀"])
@pytest.mark.parametrize("crowded", [10**9, 3, 0])
def test_later_occurrences(spark, letters, crowded):
    rows = some(4, letters)
    got = {r.rid: r.n_shared for r in repeated_letters(spark.createDataFrame(rows, "rid long, text string"), 15, crowded).collect()}
    assert got == brute_later(rows, 15)
    assert repeated_letters(spark.createDataFrame([], "rid long, text string"), 15).count() == 0


def test_equal_hashes_are_told_apart(monkeypatch):
    """With a hash of two values nearly all runs collide; the letters decide."""
    import numpy as np

    r = random.Random(2)
    codes = np.frombuffer("".join(r.choice("ACGT") for _ in range(900)).encode() * 2, np.uint8)
    run = np.arange(len(codes) - 15 + 1)
    rid = (run >= 900).astype(np.int64)
    true = [codes[i : i + 15].tobytes() for i in run]
    both = {x for x, i in zip(true, rid) if not i} & {x for x, i in zip(true, rid) if i}
    whole = spans.run_hashes
    monkeypatch.setattr(spans, "run_hashes", lambda c, *sizes: [h & np.uint64(1) for h in whole(c, *sizes)])
    assert spans._shared_starts(codes, run, rid, 15).tolist() == [x in both for x in true]


def test_crowded_routes_are_exact_and_few(spark):
    rows = some(6)
    df = spark.createDataFrame([r for r in rows if None not in r], "rid long, text string")
    counts = Counter()
    import pyarrow as pa

    from strandweave.functions.letters import letters

    counts.update(spans._bundles(*letters(pa.array([t for _, t in rows if t])), 15)[3].tolist())
    assert spans._crowded_routes(df, 15, 3).tolist() == sorted(v for v, n in counts.items() if n > 3)
    assert len(spans._crowded_routes(df, 15, 10**9)) == 0


def test_a_third_with_one_span(spark):
    r = random.Random(3)
    word = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    hot = word(60)
    rows = [(i, word(20) + hot + word(20) if i % 3 == 0 else word(100)) for i in range(600)]
    got = shared_letters(spark.createDataFrame(rows, "rid long, text string"), 50, 50).collect()
    assert Counter(x.n_shared >= 60 for x in got) == {True: 200}


def test_empty_and_a_long_text(spark):
    df = spark.createDataFrame([], "rid long, text string")
    assert shared_letters(df, 50).count() == 0
    r = random.Random(1)
    big = "".join(r.choice("ACGT") for _ in range(300_000))
    got = shared_letters(spark.createDataFrame([(1, big), (2, big[1000:2000]), (3, big[::-1])], "rid long, text string"), 50).collect()
    assert {(r.rid, r.n_shared) for r in got} == {(1, 1000), (2, 1000)}
