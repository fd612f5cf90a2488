"""Further sources and sinks: BAM, tables of earlier runs, intervals of very different lengths, refined stretches."""

import gzip
import random
import struct

import pytest

from strandweave.functions.lineage import kept
from strandweave.operators import intervals as I
from strandweave.operators.refine import refined
from strandweave.sources import readers as R


def bam(records, refs):
    out = b"BAM\1" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", len(refs))
    for name, n in refs:
        out += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", n)
    for name, flag, ref, pos, mapq, cigar, seq, qual, tags in records:
        ops = b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for n, o in cigar)
        codes = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0] * (len(seq) % 2)
        packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, len(cigar), flag, len(seq), -1, -1, 0)
        body += name.encode() + b"\0" + ops + packed + (bytes(ord(q) - 33 for q in qual) if qual else b"\xff" * len(seq)) + tags
        out += struct.pack("<i", len(body)) + body
    return out


def test_bam(spark, tmp_path):
    tags = b"NMC\x05" + b"MDZ3A1\0" + b"XAAq" + b"XBBs" + struct.pack("<ihh", 2, -3, 7) + b"XFf" + struct.pack("<f", 0.5) + b"XIi" + struct.pack("<i", -9)
    data = bam([("r1", 0, 0, 9, 60, [(3, "M"), (1, "I"), (2, "=")], "ACGTN" + "A", "IIII!I", tags), ("r2", 4, -1, -1, 0, [], "", "", b""), ("r3", 256, 1, 0, 1, [(1, "M")], "A", None, b"")], [("c1", 100), ("c2", 50)])
    for i, part in enumerate((data,)):
        with gzip.open(tmp_path / f"{i}.bam", "wb") as f:
            f.write(part)
    got = {r.qname: r for r in R.read_bam(spark, str(tmp_path / "*.bam")).collect()}
    a = got["r1"]
    assert (a.flag, a.rname, a.pos, a.mapq, a.cigar, a.seq, a.qual, a.rnext) == (0, "c1", 10, 60, "3M1I2=", "ACGTNA", "IIII!I", None)
    assert a.tags == {"NM": "5", "MD": "3A1", "XA": "q", "XB": "s,-3,7", "XF": "0.5", "XI": "-9"}
    assert (got["r2"].rname, got["r2"].cigar, got["r2"].seq, got["r3"].qual, got["r3"].rname) == (None, None, None, None, "c2")
    assert [r.qname for r in R.read_bam(spark, str(tmp_path / "0.bam"), primary_only=True).collect()] == ["r1"]
    with pytest.raises(ValueError):
        import io

        list(R.parse_bam(io.BytesIO(data[:-3])))


def test_tables_of_earlier_runs_are_kept(spark, tmp_path):
    made = []

    def make(n):
        made.append(n)
        return spark.range(n)

    path = str(tmp_path / "t")
    assert kept(spark, path, lambda: make(3)).count() == 3 and kept(spark, path, lambda: make(4)).count() == 3
    assert kept(spark, path, lambda: make(5), force=True).count() == 5 and made == [3, 5]
    (tmp_path / "t" / "_SUCCESS").unlink()
    assert kept(spark, path, lambda: make(6)).count() == 6


@pytest.mark.parametrize("width", [1, 10, 5000])
def test_overlaps_of_long_and_short_intervals(spark, width):
    r = random.Random(width)
    some = lambda n: [(i, r.choice("xy"), s, s + r.choice((0, 1, 3, 40, 700, 20_000))) for i in range(n) for s in [r.randrange(30_000)]]
    a, b = some(120), some(100)
    want = {(i, j) for i, c, s, e in a for j, d, x, y in b if c == d and s < y and x < e and s < e and x < y}
    kind = "i int, chrom string, s long, e long"
    rows = I.bin_join(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), width).select("i", "b_i").collect()
    assert len(rows) == len(want) and {tuple(x) for x in rows} == want
    none = spark.createDataFrame([], kind)
    assert I.bin_join(none, none, width).count() == 0


def test_refined_stretches(spark):
    r = random.Random(1)
    word = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    left, right = word(30), word(30)
    target = "GG" + left + "ACGTACGT" + right + "CC"
    seq = "TT" + left + "ACGACGT" + right
    # the alignment at hand is poorer than need be: three replaced letters and a gap
    alns = spark.createDataFrame([("q", seq, "30=4X1D3=30=".replace("3=30=", "33="), 2, 2, ">1>2"), ("none", None, "5=", 0, 0, ">1")], "name string, seq string, cigar string, qs long, ps long, walk string")
    spans = spark.createDataFrame([("q", 33, 36)], "name string, s long, e long")
    paths = spark.createDataFrame([("q", target), ("none", target)], "name string, target string")
    (x,) = refined(alns, spans, paths).collect()
    assert (x.qs, x.qe, x.ps, x.pe) == (25, 43, 25, 44) and x.nm == 1 and x.cigar in ("10=1D8=", "10=1D8=") and x.matches == 18 and x.cigar_len == 19
    assert refined(alns, spans, paths, least=40).count() == 0
