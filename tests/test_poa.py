import random

import numpy as np
import pytest

from strandweave.operators.poa import EQUAL, GAP, OTHER, LetterGraph, consensus


def global_score(a, b):
    row = [GAP * j for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], GAP * i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], max(before + (EQUAL if x == y else OTHER), row[j] + GAP, row[j - 1] + GAP)
    return row[-1]


def codes(s):
    return np.frombuffer(s.encode(), np.uint8)


@pytest.mark.parametrize("seed", range(30))
def test_walks_spell_their_strings_and_alignments_are_best(seed):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("ACG") for _ in range(n))
    base = word(r.randrange(1, 25))
    strings = [base] + [base[: r.randrange(len(base))] + word(r.randrange(4)) + base[r.randrange(len(base)) :] or "A" for _ in range(5)]
    graph = LetterGraph()
    graph.add(codes(strings[0]))
    for n, s in enumerate(strings[1:], 1):
        pairs = graph._aligned(codes(s))
        score = sum(GAP if v is None or j is None else EQUAL if graph.letter[v] == ord(s[j]) else OTHER for v, j in pairs)
        if n == 1:
            assert score == global_score(strings[0], s)
        assert score >= max(global_score(t, s) for t in strings[:n])
        graph.add(codes(s))
    assert ["".join(chr(graph.letter[v]) for v in w) for w in graph.walks] == strings
    table = graph.table()
    assert ["".join(chr(x) for x in row if x) for row in table.tolist()] == strings


def test_noise_is_voted_out():
    r = random.Random(1)
    true = "".join(r.choice("ACGT") for _ in range(120))
    reads = []
    for _ in range(15):
        t = list(true)
        for _ in range(2):
            p = r.randrange(5, 115)
            t[p : p + r.randrange(2)] = r.choice("ACGT")
        reads.append("".join(t))
    assert consensus(reads) == [true]


def test_two_groups_by_a_few_letters():
    r = random.Random(2)
    a = "".join(r.choice("ACGT") for _ in range(90))
    b = a[:30] + {"A": "C"}.get(a[30], "A") + a[31:60] + "TTGTT" + a[60:]
    assert consensus([a] * 5 + [b] * 3) == [a, b] and consensus([a] * 9 + [b] * 2) == [a]
    assert consensus([]) == [] and consensus(["", ""]) == [""] and consensus(["ACXT"]) == ["ACNT"]
