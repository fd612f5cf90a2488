import gzip
import random

import pytest
from pyspark.sql import functions as F

from strandweave.operators import augment as U
from strandweave.plans import pipeline as P
from strandweave.sources import readers as I
from strandweave.sources import writers as O
from strandweave.streaming import reads as S


def lines(path):
    return sorted(x for p in path.glob("part-*") for x in p.read_text().splitlines())


def test_fasta_and_fastq(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">r1 some words\nACG\nTT\n>r2\r\nGG\r\n\n>r3\n")
    got = sorted((r.name, r.comment, r.seq) for r in I.read_fasta(spark, str(tmp_path / "a.fa")).collect())
    assert got == [("r1", "some words", "ACGTT"), ("r2", None, "GG"), ("r3", None, "")]
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write("@q1 x\nAC\nGT\n+\n@I\nII\n@q2\nA\n+q2\n>\n")
    got = sorted((r.name, r.comment, r.seq, r.qual) for r in I.read_fastx(spark, str(tmp_path / "b.fq.gz")).collect())
    assert got == [("q1", "x", "ACGT", "@III"), ("q2", None, "A", ">")]
    with pytest.raises(ValueError):
        list(I.parse_fastx(["@q", "ACG", "+", "II"]))
    df = spark.createDataFrame([("n", "ACN", None), ("m", "AC", "II")], "name string, seq string, qual string")
    O.write_lines(O.fasta_lines(O.without_n(df)), str(tmp_path / "out"))
    assert lines(tmp_path / "out") == [">m", "AC"]
    assert {r.value for r in O.fastq_lines(df).collect()} == {"@n\nACN\n+\n!!!", "@m\nAC\n+\nII"}


GFA = "H\tVN:Z:1.1\nS\ts1\tACGT\tLN:i:4\nS\ts2\t*\nS\ts3\tGG\nL\ts1\t+\ts3\t-\t0M\nW\tref\t0\tchr1\t0\t6\t>s1<s3\nP\tcns-1\ts1+,s3-\t*\nX\tother\n"


def test_gfa_both_ways(spark, tmp_path):
    (tmp_path / "g.gfa").write_text(GFA)
    g = I.read_gfa(spark, str(tmp_path / "g.gfa"))
    assert {r.id: (r.seq, r.tags) for r in g["segments"].collect()} == {"s1": ("ACGT", {"LN": "4"}), "s2": (None, {}), "s3": ("GG", {})}
    assert [tuple(r) for r in g["links"].collect()] == [("s1", "+", "s3", "-", "0M")]
    steps = I.gfa_steps(g, "ref", "cns-").collect()
    assert {(r.path, r.step, r.id, r.rev, r.is_ref, r.consensus) for r in steps} == {("ref#0#chr1#0", 0, "s1", False, True, False), ("ref#0#chr1#0", 1, "s3", True, True, False), ("cns-1", 0, "s1", False, False, True), ("cns-1", 1, "s3", True, False, True)}
    O.write_gfa(str(tmp_path / "out"), g["segments"], g["links"], g["walks"], g["paths"])
    want = {x for x in GFA.splitlines() if x[0] != "X"} - {"S\ts1\tACGT\tLN:i:4"} | {"S\ts1\tACGT\tLN:Z:4"}
    assert set(lines(tmp_path / "out")) == want


def test_sfs_both_ways(spark, tmp_path):
    rows = ["0\tr1\t5\t9\t14\t1\t2\t3\t4\ts1\ts2\t77\t88\t5,6\tACGT", "1\tr1\t1\t2\t3" + "\t." * 10]
    (tmp_path / "x.sfs").write_text("\n".join(rows) + "\n")
    df = I.read_sfs(spark, str(tmp_path / "x.sfs"), anchored_only=False)
    assert {r.value for r in O.sfs_lines(df).collect()} == set(rows)
    got = I.read_sfs(spark, str(tmp_path / "x.sfs")).collect()
    assert len(got) == 1 and got[0].paths == [5, 6] and got[0].skmer == 77 and got[0].seq == "ACGT"


def test_gaf_tags_by_name(spark, tmp_path):
    a = "q\t10\t0\t9\t+\t>s1\t20\t1\t10\t9\t9\t60\tNM:i:0\tcg:Z:9=\trs:Z:r1|r2|r1"
    b = "q2\t10\t0\t9\t+\t>s1\t20\t1\t10\t9\t9\t60\tdv:f:0.1\tcg:Z:9M\tNM:i:2\tNM:i:3\tbad"
    (tmp_path / "x.gaf").write_text(a + "\n" + b + "\n")
    df = I.read_gaf(spark, str(tmp_path / "x.gaf"))
    by = {r.qname: r.tags for r in df.collect()}
    assert by["q"]["NM"] == "0" and by["q2"]["NM"] == "2" and by["q2"]["cg"] == "9M"
    assert {(r.qname, r.read) for r in I.gaf_support(df).collect()} == {("q", "r1"), ("q", "r2")}
    assert a in {r.value for r in O.gaf_lines(df).collect()}
    uses = spark.createDataFrame([("q", ["9"], ["9>10"])], "qname string, vertices array<string>, edges array<string>")
    assert O.gaf_lines(O.retained_gaf(df, uses)).first().value == a + "\tNV:Z:9\tNE:Z:9>10"


def test_small_formats(spark, tmp_path):
    (tmp_path / "a.bed").write_text("c1\t5\t9\tx\n#no\nc1\t1\t2\n")
    assert {(r.s, r.e, r.info) for r in I.read_bed(spark, str(tmp_path / "a.bed"), 3).collect()} == {(2, 12, "x"), (0, 5, None)}
    (tmp_path / "a.fai").write_text("c1\t100\t1\t2\t3\n")
    assert tuple(I.read_fai(spark, str(tmp_path / "a.fai")).first()) == ("c1", 100)
    (tmp_path / "a.vcf").write_text("##x\n#CHROM\nc\t5\tid\tA\tT\t.\tPASS\tX\n")
    assert I.read_vcf(spark, str(tmp_path / "a.vcf")).first().alt == "T"
    (tmp_path / "a.sam").write_text("@SQ\tSN:c\nr\t0\tc\t1\t60\t4M\t*\t0\t0\tACGT\t*\tNM:i:3\nr\t256\tc\t1\t60\t4M\t*\t0\t0\tACGT\t*\n")
    assert [r.tags["NM"] for r in I.read_sam(spark, str(tmp_path / "a.sam"), True).collect()] == ["3"]
    (tmp_path / "l.txt").write_text("a\n\nb\na\n")
    assert {r.name for r in I.read_list(spark, str(tmp_path / "l.txt")).collect()} == {"a", "b"}
    (tmp_path / "n.txt").write_text("chr1 NC_1\nchr2\tNC_2\n")
    assert {tuple(r) for r in I.read_name_map(spark, str(tmp_path / "n.txt")).collect()} == {("chr1", "NC_1"), ("chr2", "NC_2")}
    for n in (8, 32):
        O.write_report(spark.createDataFrame([(n, "x")], "n int, t string"), str(tmp_path / f"d_n{n}"))
    both = I.with_file_fields(I.read_report(spark, str(tmp_path / "d_n*"), "n int, t string"), "d_n([0-9]+)/", ["k"])
    assert {(r.n, r.k) for r in both.collect()} == {(8, "8"), (32, "32")}
    assert {r.value for r in O.sam_lines(spark.createDataFrame([("q", 0, "c", 5, "4M", "ACGT")], "qname string, flag int, contig string, pos long, cigar string, seq string"), spark.createDataFrame([("c", 9)], "contig string, length long")).collect()} == {"@HD\tVN:1.6", "@SQ\tSN:c\tLN:9", "q\t0\tc\t5\t60\t4M\t*\t0\t0\tACGT\t*"}


def test_binary_sketch_both_ways(spark, tmp_path):
    r = random.Random(1)
    rows = sorted((r.randrange(4**12), r.randrange(1000), r.random() < 0.5, r.randrange(1000), False, r.randrange(30000), r.randrange(30000), True, r.random() < 0.5) for _ in range(300))
    df = spark.createDataFrame(rows, "kmer long, v1 long, rev1 boolean, v2 long, rev2 boolean, pos1 int, pos2 int, has_both boolean, is_ref boolean")
    O.write_sketch_binary(df, str(tmp_path / "s.skt"), 12, 3)
    assert sorted(tuple(x) for x in I.read_sketch_binary(spark, str(tmp_path / "s.skt"), 70).collect()) == rows


def test_stream_of_reads(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.fa").write_text(">r1\nAACGTT\n>r2\nGGGGGG\n")
    sketch = spark.createDataFrame([("AACG",), ("ACGT",)], "kmer string")
    rows = S.stream_missed(S.stream_fasta(spark, str(tmp_path / "in")), sketch, 4)
    S.write_batches(rows, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    (tmp_path / "in/b.fa").write_text(">r3\nAACG\n")
    S.write_batches(rows, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("name").agg(F.count_if(~F.col("hit")).alias("m"), F.count("*").alias("n")).collect()
    assert {tuple(r) for r in got} == {("r1", 0, 3), ("r2", 3, 3), ("r3", 0, 1)}


def test_from_graph_and_reads_to_a_larger_graph(spark, tmp_path):
    r = random.Random(8)
    word = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    parts = [word(120) for _ in range(4)]
    text = "".join(f"S\t{i + 1}\t{p}\n" for i, p in enumerate(parts))
    text += "W\tref\t0\tc\t0\t480\t>1>2>3>4\nW\thap\t1\tc\t0\t360\t>1>2>4\n"
    (tmp_path / "g.gfa").write_text(text)
    segments, steps = P.graph_tables(I.read_gfa(spark, str(tmp_path / "g.gfa")), "ref")
    table = P.build_sketch(segments, steps, 15)
    whole = "".join(parts)
    new = whole[:200] + word(12) + whole[200:330] + ("A" if whole[330] != "A" else "C") + whole[331:]
    rc = new[::-1].translate(str.maketrans("ACGT", "TGCA"))
    reads = spark.createDataFrame([("a", new), ("b", new[40:]), ("c", rc), ("d", whole), ("e", rc[30:])], "rname string, seq string")
    strings = P.specific_strings(reads, segments, steps, table, 15)
    found = strings.collect()
    assert {x.rname for x in found} == {"a", "b", "c", "e"} and all(x.flag == 0 for x in found)
    alns, walks = P.align_strings(strings, segments, steps)
    assert alns.count() == 2 and {len(x.reads) for x in alns.collect()} == {4}
    segs, out = P.augment_graph(segments, steps, alns, walks)
    texts = {x.path: x.seq for x in U.spelled(segs, out).collect()}
    assert texts["ref#0#c#0"] == whole and texts["hap#1#c#0"] == parts[0] + parts[1] + parts[3]
    cns = [t for p, t in texts.items() if p.startswith("cns-")]
    assert len(cns) == 2 and all(c in new or c in rc for c in cns)
    assert U.links(out).count() >= 7
    none = P.augment_graph(segments, steps, alns, walks, least=5)[1]
    assert {x.path for x in none.select("path").distinct().collect()} == {"ref#0#c#0", "hap#1#c#0"}
