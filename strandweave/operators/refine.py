"""Alignments of stretches of reads anew, between letters that surely fit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.seqexpr import cigar_sum
from .align import aligned, cs_to_cigar, operations, widened_to_anchors


def refined(alns: DataFrame, spans: DataFrame, paths: DataFrame, least: int = 7) -> DataFrame:
    """(name, qlen, qs, qe, strand, path, plen, ps, pe, matches, cigar_len, mapq, nm, cigar): each span aligned anew.

    alns: (name, seq, cigar, qs, ps, walk), the whole sequence and an alignment with =, X, I, D from qs
    on the sequence and ps on the path; spans: (name, s, e) on the sequence, one a name; paths:
    (name, target), the letters of the path. A span is widened on both sides to the nearest ``least`` equal letters in
    a row, lifted to the path, and both stretches are aligned globally. Spans that can't be
    widened, and null sequences, have no row."""
    known = alns.where("seq is not null and cigar is not null")
    ops = operations(known, "name", "cigar", F.col("ps"))
    local = spans.join(known.select("name", "qs"), "name").select("name", (F.col("s") - F.col("qs")).alias("s"), (F.col("e") - F.col("qs")).alias("e"))
    wide = widened_to_anchors(local, ops, "name", least)
    met = wide.join(known.select("name", "seq", "qs", "walk"), "name").join(paths.select("name", "target"), "name")
    met = met.select("name", "seq", "walk", "target", (F.col("q1") + F.col("qs")).alias("qs"), (F.col("q2") + F.col("qs")).alias("qe"), F.col("p1").alias("ps"), F.col("p2").alias("pe"))
    piece = lambda text, a, b: F.substr(F.col(text), (F.col(a) + 1).cast("int"), (F.col(b) - F.col(a)).cast("int"))
    met = met.withColumn("a", aligned(piece("seq", "qs", "qe"), piece("target", "ps", "pe"))).withColumn("cigar", cs_to_cigar(F.col("a.cs")))
    return met.select(
        "name", F.length("seq").cast("bigint").alias("qlen"), "qs", "qe", F.lit("+").alias("strand"), F.col("walk").alias("path"), F.length("target").cast("bigint").alias("plen"), "ps", "pe",
        F.col("a.matches").cast("bigint").alias("matches"), cigar_sum(F.col("cigar"), "=XID").alias("cigar_len"), F.lit(60).alias("mapq"), F.col("a.nm").alias("nm"), "cigar",
    )
