"""Readers of sequence, graph, alignment and interval files.

Line formats are read as text and parsed by column expressions, so files are split among tasks
and unused columns are never parsed. Compressed files are read by their extension. A field that
can't be converted becomes null (``read_alignments`` of operators.rejects gives reasons instead).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.seqexpr import walk
from . import schemas


def _lines(spark: SparkSession, path) -> DataFrame:
    text = spark.read.text(path)
    return text.select(F.regexp_replace("value", "\\r\\z", "").alias("value"))


def _fields(lines: DataFrame) -> DataFrame:
    return lines.select(F.split("value", "\t", -1).alias("f"))


def _get(i: int) -> Column:
    return F.try_element_at("f", F.lit(i + 1))


def _given(i: int) -> Column:
    """A field, null where it is absent, empty or a point."""
    return F.when(~_get(i).isin("", "."), _get(i))


def _typed(names_types: str, at: int = 0) -> list[Column]:
    out = []
    for i, item in enumerate(names_types.split(", ")):
        name, kind = item.split(" ")
        value = _given(at + i)
        out.append((value if kind == "string" else value.try_cast(kind)).alias(name))
    return out


def tags(fields: Column) -> Column:
    """``AB:t:value`` fields as a map by name; the first wins where one is repeated, malformed ones fall out."""
    pairs = F.transform(F.filter(fields, lambda x: x.rlike("^[A-Za-z][A-Za-z0-9]:[A-Za-z]:")), lambda x: F.struct(F.left(x, F.lit(2)).alias("k"), F.substring(x, F.lit(6), F.length(x)).alias("v")))
    first = F.filter(pairs, lambda x, i: F.array_position(F.transform(pairs, lambda y: y["k"]), x["k"]) == i + 1)
    return F.map_from_entries(first)


# --- FASTA, FASTQ ---------------------------------------------------------------------------------


def read_fasta(spark: SparkSession, path) -> DataFrame:
    """(name, comment, seq, qual): records of any number of lines, in plain or compressed files.

    Files are split at ``>`` at the start of a record; qual is null."""
    text = spark.read.option("lineSep", "\n>").text(path)
    record = F.regexp_replace(F.regexp_replace("value", "^\\s*>", ""), "\\r", "")
    head, body = F.substring_index(record, "\n", 1), F.when(F.instr(record, "\n") > 0, F.substr(record, F.instr(record, "\n") + 1))
    rows = text.where("trim(value) <> ''").select(head.alias("h"), F.regexp_replace(F.coalesce(body, F.lit("")), "\\s", "").alias("seq"))
    return rows.select(F.regexp_extract("h", "^(\\S*)", 1).alias("name"), F.nullif(F.regexp_extract("h", "^\\S*\\s+(.*)$", 1), F.lit("")).alias("comment"), "seq", F.lit(None).cast("string").alias("qual"))


class _Whole(InputPartition):
    def __init__(self, path: str):
        self.path = path


class FastqReader(DataSourceReader):
    """One partition a file: records of FASTQ have no mark that a split could look for."""

    def __init__(self, options):
        self.options = options

    def partitions(self):
        from glob import glob

        found = sorted(p for x in self.options["path"].split(",") for p in (glob(x.removeprefix("file:")) or [x]))
        return [_Whole(p) for p in found]

    def read(self, partition: _Whole) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for row in parse_fastx(_open(partition.path)):
            rows.append(row)
            if len(rows) == 10_000:
                yield _fastx_batch(rows)
                rows = []
        if rows:
            yield _fastx_batch(rows)


def _open(path: str):
    if path.endswith(".gz"):
        import gzip

        return gzip.open(path, "rt")
    if path.endswith(".zst"):
        import io

        import zstandard

        return io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(open(path, "rb")))
    return open(path)


def _fastx_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["name", "comment", "seq", "qual"])


def parse_fastx(lines) -> Iterator[tuple]:
    """(name, comment, seq, qual) of FASTA and FASTQ records, sequences and qualities of any number of lines.

    A quality of another length than its sequence raises, as the rest of the file can't be trusted then."""
    head, seq, qual, letters, marks, state = None, [], [], 0, 0, "seq"

    def record():
        name, _, comment = head.partition(" ")
        if state == "qual" and marks != letters:
            raise ValueError(f"record {name}: {letters} letters and {marks} qualities")
        return name, comment.strip() or None, "".join(seq), "".join(qual) if state == "qual" else None

    for raw in lines:
        line = raw.rstrip("\r\n")
        if line[:1] in (">", "@") and (state == "seq" or marks >= letters):
            if head is not None:
                yield record()
            head, seq, qual, letters, marks, state = line[1:].replace("\t", " "), [], [], 0, 0, "seq"
        elif line[:1] == "+" and state == "seq" and head is not None:
            state = "qual"
        elif head is not None:
            part = line.strip()
            if state == "qual":
                qual.append(part)
                marks += len(part)
            else:
                seq.append(part)
                letters += len(part)
    if head is not None:
        yield record()


class Fastx(DataSource):
    """``spark.read.format("fastx").load(path)``: FASTA and FASTQ, plain, gz or zst."""

    @classmethod
    def name(cls):
        return "fastx"

    def schema(self):
        return schemas.FASTX

    def reader(self, schema):
        return FastqReader(self.options)


def read_fastx(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(Fastx)
    return spark.read.format("fastx").load(path)


# --- graphs ---------------------------------------------------------------------------------------


def _steps(text: Column) -> Column:
    """``1+,2-`` as an array of (id, rev)."""
    return F.transform(F.filter(F.split(text, ","), lambda x: x != ""), lambda x: F.struct(F.regexp_replace(x, "[+-]\\z", "").alias("id"), x.endswith("-").alias("rev")))


def read_gfa(spark: SparkSession, path) -> dict[str, DataFrame]:
    """segments, links, walks and paths of a GFA file; each is a projection of its own lines.

    A sequence of ``*`` is null. Lines of other types are left out."""
    rows = _fields(_lines(spark, path).where("value rlike '^[SLWP]\\t'"))
    of = lambda kind: rows.where(_get(0) == kind)
    rest = lambda n: tags(F.slice("f", n, F.greatest(F.size("f") - (n - 1), F.lit(0))))
    segments = of("S").select(_get(1).alias("id"), F.when(_get(2) != "*", _get(2)).alias("seq"), rest(4).alias("tags"))
    links = of("L").select(*(_get(i + 1).alias(c) for i, c in enumerate(("v1", "s1", "v2", "s2", "overlap"))))
    walks = of("W").select(_get(1).alias("sample"), _get(2).try_cast("int").alias("hap"), _get(3).alias("contig"), _get(4).try_cast("bigint").alias("start"), _get(5).try_cast("bigint").alias("end"), walk(_get(6)).alias("walk"))
    paths = of("P").select(_get(1).alias("name"), _steps(_get(2)).alias("steps"), _get(3).alias("overlaps"))
    return {"segments": segments, "links": links, "walks": walks, "paths": paths}


def gfa_steps(graph: dict[str, DataFrame], reference: str | None = None, consensus: str | None = None) -> DataFrame:
    """(path, step, id, rev, is_ref, consensus) of all walks and paths; paths are ``sample#hap#contig#start`` or the name.

    ``reference`` is the sample of the reference, ``consensus`` the prefix of consensus names."""
    w = graph["walks"].select(F.concat_ws("#", "sample", "hap", "contig", "start").alias("path"), "sample", F.posexplode("walk").alias("step", "x"))
    p = graph["paths"].select(F.col("name").alias("path"), F.substring_index("name", "#", 1).alias("sample"), F.posexplode("steps").alias("step", "x"))
    marks = [(F.col("sample") == (reference or "")).alias("is_ref"), (F.col("path").startswith(consensus) if consensus else F.lit(False)).alias("consensus")]
    return w.unionByName(p).select("path", "step", "x.id", "x.rev", *marks)


# --- strings, alignments ------------------------------------------------------------------------


def read_sfs(spark: SparkSession, path, anchored_only: bool = True) -> DataFrame:
    """Specific strings; points become nulls. By default only lines that begin with 0, as the rest has no anchors."""
    lines = _lines(spark, path).where("value <> ''")
    if anchored_only:
        lines = lines.where("value like '0%'")
    kinds = "flag int, rname string, s int, l int, e int, sv bigint, ev bigint, soff int, eoff int, gfa_sv string, gfa_ev string, skmer bigint, ekmer bigint"
    paths = F.transform(F.split(_given(13), ","), lambda x: x.try_cast("bigint"))
    return _fields(lines).select(*_typed(kinds), paths.alias("paths"), _given(14).alias("seq"))


def read_gaf(spark: SparkSession, path) -> DataFrame:
    """Alignments with their optional fields as a map by name, wherever they stand."""
    kinds = "qname string, qlen bigint, qs bigint, qe bigint, strand string, path string, plen bigint, ps bigint, pe bigint, matches bigint, cigar_len bigint, mapq int"
    rows = _fields(_lines(spark, path).where("value <> '' and not value rlike '^[#@]'"))
    return rows.select(*_typed(kinds), tags(F.slice("f", 13, F.greatest(F.size("f") - 12, F.lit(0)))).alias("tags"))


def gaf_support(gaf: DataFrame) -> DataFrame:
    """(qname, read): the reads that stand behind each consensus."""
    return gaf.select("qname", F.explode(F.split(F.col("tags")["rs"], "[|]")).alias("read")).where("read <> ''").distinct()


def read_sam(spark: SparkSession, path, primary_only: bool = False) -> DataFrame:
    """Records of SAM text; with ``primary_only`` without unmapped, secondary and supplementary ones."""
    kinds = "qname string, flag int, rname string, pos bigint, mapq int, cigar string, rnext string, pnext bigint, tlen bigint, seq string, qual string"
    rows = _fields(_lines(spark, path).where("value <> '' and not value like '@__\\t%'"))
    out = rows.select(*_typed(kinds), tags(F.slice("f", 12, F.greatest(F.size("f") - 11, F.lit(0)))).alias("tags"))
    return out.where(F.col("flag").bitwiseAND(F.lit(0x904)) == 0) if primary_only else out


_BASES = np.frombuffer(b"=ACMGRSVTWYHKDBN", np.uint8)


def parse_bam(stream) -> Iterator[tuple]:
    """The records of a BAM stream (already inflated) as rows of schemas.SAM."""

    def take(n: int) -> bytes:
        data = stream.read(n)
        if len(data) != n:
            raise ValueError("the file ends inside a record")
        return data

    if take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    take(struct.unpack("<i", take(4))[0])
    names = []
    for _ in range(struct.unpack("<i", take(4))[0]):
        names.append(take(struct.unpack("<i", take(4))[0])[:-1].decode())
        take(4)
    while size := stream.read(4):
        body = take(struct.unpack("<i", size)[0])
        ref, pos, n_name, mapq, _, n_ops, flag, n_seq, next_ref, next_pos, tlen = struct.unpack("<iiBBHHHiiii", body[:32])
        at = 32 + n_name
        ops = np.frombuffer(body, "<u4", n_ops, at)
        cigar = "".join(f"{x >> 4}{'MIDNSHP=X'[x & 15]}" for x in ops.tolist()) or None
        at += 4 * n_ops
        packed = np.frombuffer(body, np.uint8, (n_seq + 1) // 2, at)
        seq = _BASES[np.stack([packed >> 4, packed & 15], axis=1).ravel()[:n_seq]].tobytes().decode() or None
        at += len(packed)
        raw = body[at : at + n_seq]
        qual = None if not raw or raw[0] == 255 else bytes(x + 33 for x in raw).decode()
        name = body[32 : 32 + n_name - 1].decode()
        of = lambda i: names[i] if i >= 0 else None
        yield None if name == "*" else name, flag, of(ref), pos + 1, mapq, cigar, of(next_ref), next_pos + 1, tlen, seq, qual, dict(_bam_tags(body, at + n_seq))


def _bam_tags(body: bytes, at: int) -> Iterator[tuple[str, str]]:
    sizes = {"A": "c", "c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
    while at < len(body):
        tag, kind, at = body[at : at + 2].decode(), chr(body[at + 2]), at + 3
        if kind in "ZH":
            end = body.index(b"\0", at)
            yield tag, body[at:end].decode()
            at = end + 1
        elif kind == "B":
            own, n = chr(body[at]), struct.unpack_from("<i", body, at + 1)[0]
            values = struct.unpack_from(f"<{n}{sizes[own]}", body, at + 5)
            yield tag, ",".join([own, *map(str, values)])
            at += 5 + n * struct.calcsize(sizes[own])
        else:
            value = struct.unpack_from(f"<{sizes[kind]}", body, at)[0]
            yield tag, value.decode() if kind == "A" else str(value)
            at += struct.calcsize(sizes[kind])


class BamReader(FastqReader):
    """One partition a file; its blocks are inflated one after another."""

    def read(self, partition: _Whole) -> Iterator[tuple]:
        import gzip

        with gzip.open(partition.path, "rb") as stream:
            yield from parse_bam(stream)


class Bam(DataSource):
    """``spark.read.format("bam").load(path)``."""

    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return schemas.SAM

    def reader(self, schema):
        return BamReader(self.options)


def read_bam(spark: SparkSession, path: str, primary_only: bool = False) -> DataFrame:
    """As ``read_sam``, from BAM files."""
    spark.dataSource.register(Bam)
    out = spark.read.format("bam").load(path)
    return out.where(F.col("flag").bitwiseAND(F.lit(0x904)) == 0) if primary_only else out


# --- intervals, tables ----------------------------------------------------------------------------


def read_bed(spark: SparkSession, path, flank: int = 0) -> DataFrame:
    """(chrom, s, e, info), each interval wider by ``flank`` on both sides, but not below 0."""
    rows = _fields(_lines(spark, path).where("value <> '' and not value rlike '^(#|track|browser)'"))
    return rows.select(*_typed(schemas.BED)).select("chrom", F.greatest(F.col("s") - flank, F.lit(0)).alias("s"), (F.col("e") + flank).alias("e"), "info")


def read_fai(spark: SparkSession, path) -> DataFrame:
    return _fields(_lines(spark, path).where("value <> ''")).select(*_typed(schemas.FAI))


def read_vcf(spark: SparkSession, path) -> DataFrame:
    return _fields(_lines(spark, path).where("value <> '' and not value like '#%'")).select(*_typed(schemas.VCF))


def read_name_map(spark: SparkSession, path, names: tuple[str, str] = ("short", "accession")) -> DataFrame:
    rows = _lines(spark, path).where("trim(value) <> ''").select(F.split(F.trim("value"), "\\s+").alias("f"))
    return rows.select(_get(0).alias(names[0]), _get(1).alias(names[1]))


def read_list(spark: SparkSession, path, name: str = "name") -> DataFrame:
    """One name a line; blank lines are left out and repeated ones count once."""
    return _lines(spark, path).select(F.trim("value").alias(name)).where(F.col(name) != "").distinct()


def read_table(spark: SparkSession, path, schema: str) -> DataFrame:
    """Fields by tab without a header, as ``name type, ...``; points and what can't be converted become nulls."""
    return _fields(_lines(spark, path)).select(*_typed(schema))


def read_report(spark: SparkSession, path, schema: str, header: bool = True) -> DataFrame:
    """A report table as CSV; several files with a header each are one table."""
    return spark.read.schema(schema).option("header", header).csv(path)


def with_file_fields(df: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """Adds the groups of ``pattern`` in the path of the file each row was read from; call it on what a Spark reader gave."""
    path = F.col("_metadata.file_path")
    return df.select("*", *(F.regexp_extract(path, pattern, i + 1).alias(n) for i, n in enumerate(names)))


# --- binary sketch ----------------------------------------------------------------------------------


def unpack_sketch(df: DataFrame) -> DataFrame:
    """(kmer, vertices, info) packed words as columns: v1 and v2 in 32 bits each, pos1, pos2 in 15, has_both and is_ref in one."""
    v, i = F.col("vertices"), F.col("info")
    h1, h2 = F.shiftrightunsigned(v, 32), v.bitwiseAND(F.lit(0xFFFFFFFF))
    bit = lambda x, n: F.shiftrightunsigned(x, n).bitwiseAND(F.lit(1)) == 1
    return df.select(
        "kmer", F.shiftright(h1, 1).alias("v1"), bit(h1, 0).alias("rev1"), F.shiftright(h2, 1).alias("v2"), bit(h2, 0).alias("rev2"),
        F.shiftright(i, 17).bitwiseAND(F.lit(0x7FFF)).cast("int").alias("pos1"), F.shiftright(i, 2).bitwiseAND(F.lit(0x7FFF)).cast("int").alias("pos2"), bit(i, 1).alias("has_both"), bit(i, 0).alias("is_ref"),
    )


def read_sketch_binary(spark: SparkSession, path: str, rows: int = 1 << 20) -> DataFrame:
    """The binary layout: k, prefix length m, number n, 4^m offsets, then n k-mers, n vertex words, n flags.

    The arrays are read by offset, ``rows`` entries a task."""
    with open(path, "rb") as f:
        _, m, n = struct.unpack("<iiq", f.read(16))
    base = 16 + 8 * 4**m

    def work(batches):
        for b in batches:
            for at in b.column("at").to_pylist():
                size = min(rows, n - at)
                part = lambda offset, kind: np.fromfile(path, kind, size, offset=offset)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part(base + 8 * at, "<i8")), pa.array(part(base + 8 * n + 8 * at, "<i8")), pa.array(part(base + 16 * n + 4 * at, "<u4").astype("<i8"))], names=["kmer", "vertices", "info"]
                )

    parts = spark.range(0, max(n, 1), rows).select(F.col("id").alias("at")).where(F.col("at") < n)
    return unpack_sketch(parts.repartition("at").mapInArrow(work, "kmer bigint, vertices bigint, info bigint"))
