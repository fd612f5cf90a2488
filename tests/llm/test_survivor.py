import datetime
import random

from pyspark.sql import functions as F

from strandweave.llm.survivor import best_spans, consensus_value, plain_name

T = datetime.datetime(2025, 1, 1)


def brute(rows, trust):
    groups = {}
    for r in rows:
        if r[1] is not None:
            name = r[1].strip(" \t")
            cut = min((name.find(c) for c in " \t" if c in name), default=len(name))
            groups.setdefault(name[:cut].lower(), []).append(r)
    out = set()
    for name, own in groups.items():
        ok = lambda r: None not in (r[2], r[3], r[4]) and 0 <= r[3] < r[4] <= r[2]
        known = lambda r: r[5] is not None and r[5] >= 0
        tail = lambda r: (trust.get(r[6], 1 << 40), r[7] is None, -(r[7] - T).total_seconds() if r[7] else 0, r[0])
        best = sorted((r for r in own if ok(r)), key=lambda r: (r[3] - r[4], not known(r), r[5] if known(r) else 0, tail(r)))
        if len(own) < 2 or not best:
            continue
        nms = sorted((r for r in own if known(r)), key=tail)
        out.add((name, best[0][0], best[0][3], best[0][4], best[0][5] if known(best[0]) else nms[0][5] if nms else -1))
    return out


def test_best_spans_against_sorting(spark):
    r = random.Random(1)
    trust = {"a": 1, "b": 2, "c": 2}
    rows = []
    for i in range(1500):
        name = r.choice(["x", "X ", "\tx y", "n%d" % r.randrange(300), None, "", " "])
        rows.append((i, name, r.choice((100, 100, None)), r.choice((0, 5, -1, None)), r.choice((50, 60, 101, 3, None)), r.choice((-1, 0, 3, None)), r.choice("abcd") if r.random() < 0.9 else None, r.choice((T, T + datetime.timedelta(days=1), None))))
    df = spark.createDataFrame(rows, "aln_id long, name string, qlen long, qs long, qe long, nm int, aligner string, loaded_at timestamp_ntz").withColumn("trust_rank", F.lit(9))
    names = spark.createDataFrame(list(trust.items()) + [(None, 1)], "aligner string, trust_rank int").withColumn("nm", F.lit(1))
    got = [tuple(x) for x in best_spans(df, names).drop("n").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, trust)
    assert best_spans(df.where("false"), names).count() == 0


def test_names(spark):
    df = spark.createDataFrame([(" \tAb c",), ("",), (None,), ("x\ty",)], "n string")
    assert [x[0] for x in df.select(plain_name(F.col("n"))).collect()] == ["ab", "", None, "x"]


def test_consensus_takes_the_value_nearest_to_the_vote(spark):
    rows = [("k", ">a>b>c>d", 1.0), ("k", ">a>b>c>d", 1.0), ("k", ">a>c>d", 1.0), ("k", ">a>b>x>d", 1.5), ("one", ">z", 1.0), ("tie", ">b", 1.0), ("tie", ">a", 1.0), (None, ">q", 1.0), ("k", None, 9.0)]
    df = spark.createDataFrame(rows, "k string, v string, w double")
    got = {x.key: (x.value, x.n_values) for x in consensus_value(df, "k", "v", F.col("w"), ">[^>]+").collect()}
    assert got == {"k": (">a>b>c>d", 3), "one": (">z", 1), "tie": (">a", 2)}


def test_consensus_of_a_large_group_in_rounds(spark):
    r = random.Random(3)
    true = [f">t{i}" for i in range(12)]
    rows = []
    for i in range(400):
        own = list(true)
        for _ in range(r.randrange(1, 3)):
            own[r.randrange(12)] = f">e{r.randrange(1000)}"
        rows.append(("k", "".join(own), 1.0))
    rows.append(("k", "".join(true), 1.0))
    df = spark.createDataFrame(rows, "k string, v string, w double")
    got = consensus_value(df, "k", "v", F.col("w"), ">[^>]+", block=8).collect()
    assert [x.value for x in got] == ["".join(true)]
