import json
import random
from collections import Counter

import pytest

from strandweave.llm import split as S
from strandweave.llm.bpe import FOLDER, certain_cuts, encoder, joined, vocabulary
from strandweave.llm.encode import encode_batch, encode_texts
from strandweave.llm.pack import best_fit, pack

PATH = vocabulary()
ODD = [
    "", " ", "\n\n\n", "a", "'s", "!'s", "x\t\ta", "x \t a", "it's  'tis  l'l", "<|endoftext|> <|startoftext|>", "漢字かな交じり文。次の文！", "🙂🙃" * 9, "é   x　　y", "\x00\x1c\x1d a\x85b",
    "ab" * 3000, "0123456789" * 200, "ACGT" * 4000, "-=" * 50 + "''" * 9, "\r\n\r\n a\r\n", "don't'll've'", "  x", "a�b��", "ſ's K'S",
]


def mixed(seed, n=200):
    r = random.Random(seed)
    parts = ODD + ["the ", "word", " ", "  ", "\t", "'", "'re", " ", " ", "É", "漢", ".", "?!", "\n", "12", "_", "<", "🙂", "Ω", "́"]
    return ["".join(r.choice(parts) if r.random() < 0.05 else r.choice(parts[len(ODD) :]) for _ in range(r.randrange(60))) for _ in range(n)]


@pytest.fixture(scope="module")
def other():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize("least", [1, 16, 256])
def test_fragments_give_the_ids_of_the_whole(other, least):
    import pyarrow as pa

    texts = ODD + mixed(least)
    ids, offsets = encode_batch(pa.array(texts), PATH, least)
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == other(t), repr(t)


def test_cuts_are_made_at_all():
    import numpy as np

    data = np.frombuffer(json.dumps({"a": [1, 2], "text": "Some words, and more. 漢字"}, ensure_ascii=False).encode(), np.uint8)
    assert certain_cuts(data, PATH).sum() >= 8 and not joined(PATH).all()


def test_rows_with_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "ab c"), (3, "ab c"), (None, "x")], "id long, text string")
    got = sorted(((r.id, r.ids) for r in encode_texts(df).collect()), key=str)
    want = encoder(PATH).encode_ordinary("ab c")
    assert got == sorted([(1, []), (2, []), (3, want), (3, want), (None, encoder(PATH).encode_ordinary("x"))], key=str)
    assert encode_texts(df.where("false")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_fills_without_overflow(seed):
    r = random.Random(seed)
    capacity = r.choice((10, 64, 500))
    counts = Counter(r.randrange(1, capacity + 1) for _ in range(r.randrange(1, 3000)))
    if seed == 1:
        counts[3] = 5000
    plan = best_fit(counts, capacity)
    load, seen = Counter(), Counter()
    rows = sorted(zip(plan.length.tolist(), plan.rank.tolist(), plan.first.tolist(), plan.each.tolist()))
    for length, n in counts.items():
        own = [x for x in rows if x[0] == length]
        for (_, rank, first, each), end in zip(own, [x[1] for x in own[1:]] + [n]):
            for k in range(rank, end):
                load[first + (k - rank) // each] += length
                seen[length] += 1
    assert seen == counts and max(load.values()) <= capacity and len(load) == plan.containers
    assert plan.containers <= sum(k * n for k, n in counts.items()) / capacity * 1.25 + 1


@pytest.mark.parametrize("bucket", [10, 50_000])
def test_pack(spark, bucket):
    r = random.Random(5)
    rows = [(i, r.choice((0, None, 7, 7, 7, r.randrange(40), 250))) for i in range(900)]
    got = pack(spark.createDataFrame(rows, "id long, n long"), 100, bucket).collect()
    load, per = Counter(), Counter()
    for x in got:
        load[x.container] += x.n
        per[x.id] += x.n
    assert max(load.values()) <= 100 and all(per[i] == (n or 0) for i, n in rows) and set(per) == {i for i, _ in rows}
    assert {x.part for x in got if dict(rows)[x.id] == 250} == {0, 1, 2} and all(sum(x.id == i for x in got) == 1 for i, n in rows[:60] if (n or 0) <= 100)
    assert len(load) <= sum(per.values()) / 100 * 1.02 + 1
    assert pack(spark.createDataFrame([], "id long, n long"), 100).count() == 0


def verify(texts, rows, budgets):
    by = {}
    for r in rows:
        by.setdefault((r.budget_id, r.id), []).append(r)
    encode = encoder(PATH).encode_ordinary
    for b in budgets:
        for i, t in texts:
            own = sorted(by.pop((b.budget_id, i), []), key=lambda r: r.piece)
            size = len(encode(t)) if t else 0
            if i is None or size <= b.most:
                assert not own
                continue
            raw = t.encode()
            assert [r.piece for r in own] == list(range(len(own))) and own[0].start == 0 and own[-1].end == len(raw)
            for r in own:
                assert raw[r.start : r.end].decode() == r.text and len(encode(r.text)) == r.n_tokens <= b.most
            for x, y in zip(own, own[1:]):
                assert x.start < y.start <= x.end < y.end
    assert not by


@pytest.mark.parametrize("size, halo", [(1 << 14, 1 << 10), (300, 60)])
def test_split(spark, size, halo):
    r = random.Random(6)
    words = "The gap opened again. It was small,\nbut it stayed! Nobody\n\nknew why? 漢字かな。 été 0123 x".split(" ")
    texts = [(i, " ".join(r.choice(words) for _ in range(r.randrange(400)))) for i in range(30)]
    texts += [(100, None), (101, ""), (102, "ACGT" * 2000), (103, "漢字" * 900), (104, "🙂" * 700), (105, "x" * 5000), (106, "a\n" * 1500), (107, " " * 3000), (108, "é" * 2000), (109, ODD[12] * 60)]
    budgets = [S.Budget(1, 64, 8), S.Budget(2, 40, 0)]
    df = spark.createDataFrame(texts + [(None, "x " * 500)], "id long, text string")
    verify(texts, S.split_texts(df, budgets, size=size, halo=halo).collect(), budgets)
    assert S.split_texts(df.where("false"), budgets).count() == 0


@pytest.mark.parametrize("grid, halo, sizes", [(300, 60, (300, 900, 1 << 20)), (S.GRID, S.HALO, (1 << 14, 1 << 20))])
def test_pieces_dont_depend_on_the_ranges(spark, grid, halo, sizes):
    r = random.Random(8)
    words = "The gap opened again. It was small,\nbut it stayed! Nobody\n\nknew why? 漢字かな。 été 0123 ''store it's  \t x".split(" ")
    texts = [(i, " ".join(r.choice(words) for _ in range(r.randrange(6000)))) for i in range(8)]
    texts += [(100, None), (101, ""), (102, "ACGT" * 6000), (103, "漢字" * 6000), (104, "🙂" * 5000), (105, "0123456789" * 2000), (106, "a\n" * 9000), (107, " " * 20000), (108, "'" * 17000), (109, ODD[12] * 200)]
    budgets = [S.Budget(1, 256, 32), S.Budget(2, 40, 0)]
    df = spark.createDataFrame(texts, "id long, text string")
    found = [sorted(map(tuple, S.split_texts(df, budgets, size=n, halo=halo, grid=grid).collect())) for n in sizes]
    assert all(x == found[0] for x in found)
    verify(texts, S.split_texts(df, budgets, size=sizes[0], halo=halo, grid=grid).collect(), budgets)


def test_overlaps_are_whole(spark):
    text = " ".join(random.Random(3).choice(("one", "two.", "three\n", "fourteen")) for _ in range(5000))
    rows = sorted(S.split_texts(spark.createDataFrame([(1, text)], "id long, text string"), [S.Budget(1, 128, 16)]).collect(), key=lambda r: r.piece)
    encode = encoder(PATH).encode_ordinary
    raw = text.encode()
    assert all(abs(len(encode(raw[y.start : x.end].decode())) - 16) <= 3 for x, y in zip(rows, rows[1:]))


def test_cuts_prefer_natural_ends(spark):
    text = "One two three four five six. " * 3 + "\n\n" + "Seven eight nine ten. " * 8
    got = sorted(S.split_texts(spark.createDataFrame([(1, text)], "id long, text string"), [S.Budget(1, 40, 4)]).collect(), key=lambda r: r.piece)
    assert got[0].text.endswith("\n\n") and all(r.text.rstrip().endswith(".") for r in got)


def test_a_budget_needs_room():
    with pytest.raises(ValueError):
        S.Budget(1, 16, 12)
