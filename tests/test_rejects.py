import random

from strandweave.operators.rejects import FIELDS, parse_lines, read_alignments

GOOD = ["q1", "100", "10", "60", "+", ">a<b", "200", "5", "55", "48", "52", "60", "NM:i:4", "AS:f:1", "dv:f:0", "id:f:1", "cg:Z:40M2D8=2X"]


def line(**changes):
    row = list(GOOD)
    for name, value in changes.items():
        row[FIELDS.index(name)] = value
    return "\t".join(row)


CASES = {
    line(): None,
    line() + "\r": None,
    line() + "\r\r": "cigar",
    line(name='"a\tb ""x"""'): None,
    line(name='"a'): "quoting",
    line(name='"a"b'): "quoting",
    line(name='a"b'): "quoting",
    line(cg='cg:"Z:50M"'): "quoting",
    "\t".join(GOOD[:-1]): "columns",
    line() + "\t": "columns",
    line(qs="x"): "number",
    line(qs="60"): "number",
    line(qe="101"): "number",
    line(strand="*"): "number",
    line(mapq="256"): "number",
    line(qlen="1000000000"): "number",
    line(qlen="١٢"): "number",
    line(matches=""): "number",
    line(nm="NM:i:-1"): "nm",
    line(nm="NM:i:2147483648"): "nm",
    line(nm="NM:i:" + "0" * 40 + "7"): None,
    line(nm="nm:i:1"): "nm",
    line(cg="cg:Z:"): "cigar",
    line(cg="cg:Z:49M"): "cigar",
    line(cg="cg:Z:50M0D"): "cigar",
    line(cg="cg:Z:50N"): "cigar",
    line(cg="cg:Z:50M" + "9" * 30 + "D"): None,
    line(cg="cg:Z:" + "9" * 30 + "M"): "cigar",
    line(cg="cg:Z:" + "1M1D" * 50): None,
    line(cg="cg:Z:" + "1M" * 20_000, qe="20010", qlen="30000"): None,
    line(name='"a'): "quoting",
}


def test_reasons(spark):
    rows = [(i, text) for i, text in enumerate(CASES)]
    got = {r.i: r.reason for r in read_alignments(spark.createDataFrame(rows, "i int, line string")).collect()}
    assert got == {i: CASES[text] for i, text in rows}


def test_what_is_no_alignment_line(spark):
    rows = [(None,), ("",), (" \t ",), ("#x",), ("@HD",), (" \t\r",), (line(),), (line(),)]
    out = read_alignments(spark.createDataFrame(rows, "line string")).collect()
    assert len(out) == 2 and out[0].rec.nm == 4 and out[0].rec.cigar == "40M2D8=2X" and out[0].rec.qe == 60


def test_other_columns_stay_and_clashing_ones_give_way(spark):
    df = spark.createDataFrame([(1, "old", line())], "i int, reason string, line string")
    assert read_alignments(df).columns == ["i", "reason", "edits", "rec"]
    assert read_alignments(df.where("false")).count() == 0


def sound(text):
    """Reads a line letter by letter."""
    fields, at = 1, 0
    while True:
        if text[at : at + 1] == '"':
            at += 1
            while True:
                if at >= len(text):
                    return None
                if text[at] == '"':
                    if text[at + 1 : at + 2] == '"':
                        at += 2
                        continue
                    at += 1
                    break
                at += 1
            if at < len(text) and text[at] != "\t":
                return None
        else:
            while at < len(text) and text[at] != "\t":
                if text[at] == '"':
                    return None
                at += 1
        if at >= len(text):
            return fields
        at, fields = at + 1, fields + 1


def distance(text, fields):
    """Fewest inserted or deleted quotes and tabs that make a line sound, breadth first."""
    seen, layer, n = {text}, [text], 0
    while True:
        if any(sound(t) == fields for t in layer):
            return n
        n += 1
        grown = set()
        for t in layer:
            grown |= {t[:i] + c + t[i:] for i in range(len(t) + 1) for c in '"\t'} | {t[:i] + t[i + 1 :] for i in range(len(t)) if t[i] in '"\t'}
        layer = list(grown - seen)
        seen |= grown


def test_costs_against_breadth_first_search():
    import pyarrow as pa

    r = random.Random(4)
    lines = ["".join(r.choice('ab"\t"\t') for _ in range(r.randrange(1, 8))) for _ in range(120)]
    for text, got in zip(lines, parse_lines(pa.array(lines), 3).to_pylist()):
        n = sound(text)
        assert (got["quote_edits"] == 0) == (n is not None), text
        edits = sum(int(part.split()[1]) for part in got["edits"].split(", ")) if got["edits"] else 0
        if n is not None:
            assert len(got["fields"]) == n and edits == abs(n - 3), text
        else:
            assert edits == distance(text, 3), (text, got)


def test_many_edits_and_many_tabs(spark):
    import pyarrow as pa

    texts = ["\t" * 1100, '"' * 4001, "x" + '"' * 3000, "\t" * 9_000, line() + "\tx" * 5, line(name='"a\t') + "\tx" * 3]
    got = parse_lines(pa.array(texts)).to_pylist()
    assert [x["edits"] for x in got[:5]] == ["delete 1084 tab", "delete 1 quote, insert 16 tab", "insert 16 tab", "delete 8984 tab", "delete 5 tab"]
    assert got[5]["quote_edits"] == 1 and sum(int(p.split()[1]) for p in got[5]["edits"].split(", ")) <= 4


def test_costs_of_any_size():
    """The same edits where 64 bits don't do."""
    import numpy as np

    from strandweave.operators import rejects

    r = random.Random(7)
    lines = ["".join(r.choice('ab"\t') for _ in range(r.randrange(1, 20))) for _ in range(40)]
    symbols = rejects._symbols([rejects._symbol_row(x) for x in lines])
    small, large = rejects.Cost(symbols.shape[1]), rejects.Cost(1 << 20)
    assert small.kind is np.int64 and large.kind is object
    a, b = (rejects._least(symbols, 4, c) for c in (small, large))
    assert [small.counts(x) for x in a] == [large.counts(x) for x in b]


def test_edits_of_lines_without_quotes(spark):
    rows = [(1, line() + "\tx\ty"), (2, "\t".join(GOOD[:-2])), (3, line()), (4, line(qs="x")), (5, line(name='"a'))]
    got = {r.i: (r.reason, r.edits) for r in read_alignments(spark.createDataFrame(rows, "i int, line string")).collect()}
    assert got == {1: ("columns", "delete 2 tab"), 2: ("columns", "insert 2 tab"), 3: (None, None), 4: ("number", None), 5: ("quoting", got[5][1])} and "quote" in got[5][1]
