"""Writers of the same formats: one text column, written in parallel."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.seqexpr import pack_handle, walk_text

_TAB = "\t"


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("."))


def _row(*values: Column) -> Column:
    return F.concat_ws(_TAB, *values).alias("value")


def write_lines(lines: DataFrame, path: str, **options) -> None:
    """Writes a DataFrame of one string column; ``compression`` may be given."""
    lines.write.mode("overwrite").options(**options).text(path)


def fasta_lines(df: DataFrame, name: str = "name", seq: str = "seq") -> DataFrame:
    return df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.coalesce(seq, F.lit(""))).alias("value"))


def fastq_lines(df: DataFrame) -> DataFrame:
    """Reads with qualities; those without get the lowest one for each letter."""
    qual = F.coalesce("qual", F.repeat(F.lit("!"), F.length("seq")))
    return df.select(F.concat_ws("\n", F.concat(F.lit("@"), F.col("name")), "seq", F.lit("+"), qual).alias("value"))


def without_n(reads: DataFrame, seq: str = "seq") -> DataFrame:
    """Reads without unknown letters; null sequences fall out."""
    return reads.where(~F.upper(seq).contains("N"))


def sfs_lines(df: DataFrame) -> DataFrame:
    """15 fields; strings that aren't anchored have points from the anchors on."""
    own = lambda c: F.when(F.col("flag") == 0, F.col(c))
    paths = F.when((F.col("flag") == 0) & (F.size("paths") > 0), F.concat_ws(",", F.transform("paths", lambda x: x.cast("string"))))
    cols = ["sv", "ev", "soff", "eoff", "gfa_sv", "gfa_ev", "skmer", "ekmer"]
    return df.select(_row(*(_text(F.col(c)) for c in ("flag", "rname", "s", "l", "e")), *(_text(own(c)) for c in cols), _text(paths), _text(own("seq"))))


def tag_fields(tags: Column, kinds: dict[str, str]) -> Column:
    """The given tags as ``AB:t:value`` in this order, absent ones left out."""
    one = lambda k, t: F.when(tags[k].isNotNull(), F.concat(F.lit(f"{k}:{t}:"), tags[k]))
    return F.concat_ws(_TAB, *(one(k, t) for k, t in kinds.items()))


#: Optional fields of an alignment and their types.
GAF_TAGS = {"NM": "i", "AS": "i", "cg": "Z", "cs": "Z", "rs": "Z", "qs": "Z", "ps": "Z", "NV": "Z", "NE": "Z"}


def gaf_lines(df: DataFrame) -> DataFrame:
    cols = ("qname", "qlen", "qs", "qe", "strand", "path", "plen", "ps", "pe", "matches", "cigar_len", "mapq")
    fields = tag_fields(F.col("tags"), GAF_TAGS)
    return df.select(F.concat_ws(_TAB, *(_text(F.col(c)) for c in cols), F.nullif(fields, F.lit(""))).alias("value"))


def retained_gaf(gaf: DataFrame, uses: DataFrame) -> DataFrame:
    """Alignments of the consensus still used, with the novel vertices (NV) and edges (NE) they carry.

    uses: (qname, vertices array<string>, edges array<string>)."""
    joined = gaf.join(uses, "qname")
    extra = F.map_from_arrays(F.array(F.lit("NV"), F.lit("NE")), F.array(F.concat_ws(",", "vertices"), F.concat_ws(",", "edges")))
    kept = F.map_filter("tags", lambda k, v: ~k.isin("NV", "NE"))
    return joined.withColumn("tags", F.map_concat(kept, extra)).drop("vertices", "edges")


def gfa_lines(segments: DataFrame, links: DataFrame, walks: DataFrame | None = None, paths: DataFrame | None = None) -> DataFrame:
    """Header, S, L, W and P lines in this order of kinds. Tags of segments are written as strings."""
    spark = segments.sparkSession
    tags = F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat(e["key"], F.lit(":Z:"), e["value"]))
    rank = lambda n: F.lit(n).alias("rank")
    out = spark.range(1).select(rank(0), F.lit("H\tVN:Z:1.1").alias("value"))
    out = out.unionByName(segments.select(rank(1), _row(F.lit("S"), F.col("id"), F.coalesce("seq", F.lit("*")), F.when(F.size("tags") > 0, F.concat_ws(_TAB, tags)))))
    out = out.unionByName(links.select(rank(2), _row(F.lit("L"), F.col("v1"), F.col("s1"), F.col("v2"), F.col("s2"), F.coalesce("overlap", F.lit("0M")))))
    if walks is not None:
        text = [F.col(c).cast("string") for c in ("hap", "contig", "start", "end")]
        out = out.unionByName(walks.select(rank(3), _row(F.lit("W"), F.col("sample"), *text, walk_text(F.col("walk")))))
    if paths is not None:
        steps = F.concat_ws(",", F.transform("steps", lambda s: F.concat(s["id"], F.when(s["rev"], "-").otherwise("+"))))
        out = out.unionByName(paths.select(rank(4), _row(F.lit("P"), F.col("name"), steps, F.coalesce("overlaps", F.lit("*")))))
    return out


def write_gfa(path: str, *parts) -> None:
    """Lines in order of their kinds, over as many files as the order needs; their names keep it."""
    gfa_lines(*parts).repartitionByRange("rank").sortWithinPartitions("rank").select("value").write.mode("overwrite").text(path)


def mapping_lines(elements: DataFrame, prefix: str, order: list[str]) -> DataFrame:
    """P lines ``prefix{i}`` over the steps of each element with its supporting consensus as ``CS:Z:``."""
    from ..operators.ranks import dense_index

    steps = F.concat_ws(",", F.transform("steps", lambda s: F.concat(s["id"], F.when(s["rev"], "-").otherwise("+"))))
    rows = dense_index(elements, order, "i", 0)
    return rows.select(_row(F.lit("P"), F.concat(F.lit(prefix), F.col("i").cast("string")), steps, F.lit("*"), F.concat(F.lit("CS:Z:"), F.concat_ws(",", F.array_sort("names")))))


def sam_lines(records: DataFrame, contigs: DataFrame) -> DataFrame:
    """Header lines for (contig, length) and a line for each record of ``align.reference_records``."""
    spark = records.sparkSession
    head = spark.range(1).select(F.lit(0).alias("rank"), F.lit("@HD\tVN:1.6").alias("value"))
    head = head.unionByName(contigs.select(F.lit(1).alias("rank"), F.concat_ws(_TAB, F.lit("@SQ"), F.concat(F.lit("SN:"), F.col("contig").cast("string")), F.concat(F.lit("LN:"), F.col("length").cast("string"))).alias("value")))
    row = F.concat_ws(_TAB, "qname", F.col("flag").cast("string"), F.col("contig").cast("string"), F.col("pos").cast("string"), F.lit("60"), "cigar", F.lit("*"), F.lit("0"), F.lit("0"), "seq", F.lit("*"))
    return head.unionByName(records.select(F.lit(2).alias("rank"), row.alias("value")))


def write_sam(path: str, records: DataFrame, contigs: DataFrame) -> None:
    """Header and records, over as many files as their order needs."""
    sam_lines(records, contigs).repartitionByRange("rank").sortWithinPartitions("rank").select("value").write.mode("overwrite").text(path)


def bed_lines(df: DataFrame, cols: tuple[str, ...] = ("chrom", "s", "e")) -> DataFrame:
    return df.select(_row(*(F.col(c).cast("string") for c in cols)))


def table_lines(df: DataFrame) -> DataFrame:
    """All columns by tab, nulls as points."""
    return df.select(_row(*(_text(F.col(c)) for c in df.columns)))


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_sketch(sketch: DataFrame, path: str) -> None:
    """The sketch sorted by k-mer, so that readers skip row groups by its range."""
    sketch.repartitionByRange("kmer").sortWithinPartitions("kmer").write.mode("overwrite").parquet(path)


def pack_sketch(sketch: DataFrame) -> DataFrame:
    """(kmer, vertices, info) as in the binary layout; positions above 15 bits raise."""
    wide = F.assert_true(F.greatest("pos1", "pos2") < 1 << 15, F.lit("positions of over 15 bits don't fit"))
    h1, h2 = pack_handle(F.col("v1"), F.col("rev1")), pack_handle(F.col("v2"), F.col("rev2"))
    bit = lambda c, n: F.shiftleft(F.col(c).cast("bigint"), n)
    info = F.shiftleft(F.col("pos1").cast("bigint"), 17).bitwiseOR(F.shiftleft(F.col("pos2").cast("bigint"), 2)).bitwiseOR(bit("has_both", 1)).bitwiseOR(bit("is_ref", 0))
    return sketch.select("kmer", F.shiftleft(h1, 32).bitwiseOR(h2).alias("vertices"), info.alias("info"), wide.alias("ok")).drop("ok")


def write_sketch_binary(sketch: DataFrame, path: str, k: int, m: int = 9) -> None:
    """One file in the binary layout, for exchange with other tools, on a file system that all tasks share.

    Rows are numbered in k-mer order, and each task writes its own at their offsets; a task that is
    run again writes the same bytes. The driver writes the head, whose size is given by ``m``."""
    from ..operators.ranks import dense_index

    rows = cut(dense_index(pack_sketch(sketch), ["kmer"], "__at", 0))
    shift = max(0, 2 * (k - m))
    counts = rows.groupBy(F.shiftright("kmer", shift).cast("int").alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()  # 4^m rows at most
    prefix = np.zeros(4**m + 1, np.int64)
    for r in counts:
        prefix[r.p + 1] = r.n
    n, base = int(prefix.sum()), 16 + 8 * 4**m
    with open(path, "wb") as f:
        f.write(struct.pack("<iiq", k, m, n))
        f.write(np.cumsum(prefix)[:-1].astype("<i8").tobytes())
        f.truncate(base + 20 * n)

    def work(batches):
        for b in batches:
            at = b.column("__at").to_numpy()
            order = np.argsort(at)
            new = np.flatnonzero(np.diff(at[order]) != 1) + 1
            with open(path, "r+b") as f:
                for own in np.split(order, new):
                    if not len(own):
                        continue
                    for offset, width, name in ((base, 8, "kmer"), (base + 8 * n, 8, "vertices"), (base + 16 * n, 4, "info")):
                        f.seek(offset + width * int(at[own[0]]))
                        f.write(b.column(name).to_numpy()[own].astype("<u4" if width == 4 else "<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    written = rows.mapInArrow(work, "n bigint").agg(F.sum("n")).first()[0] or 0
    if written != n:
        raise ValueError(f"{written} of {n} rows were written")
