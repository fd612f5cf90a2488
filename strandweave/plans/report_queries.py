"""Anchoring, alignments, intervals and reports: queries and SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import seqexpr as X
from ..functions.codes import kmer_codes
from ..functions.lineage import cut
from ..operators import align as A
from ..operators import anchoring as N
from ..operators import graph as G
from ..operators import intervals as I
from ..operators import reports as R
from ..operators import sketch as S
from ..operators.ordered import depth
from . import kmer_queries as Q
from . import standins as V
from .standins import K, with_
from .tables import table

#: Anchors a side in these queries, as in the reference.
ANCHORS = 20


def _strings(spark, d):
    """Uncovered stretches of reads as specific strings, and the usable k-mers of reads; both are written once."""
    found = cut(Q._hits(spark, d))
    return cut(S.uncovered(found, "rid")), cut(S.found_once(found, "rid"))


def _anchors(spark, d):
    strings, usable = _strings(spark, d)
    return strings, N.nearest_anchors(strings, usable, "rid", K, ANCHORS)


def _anchors_side(side):
    def query(spark, d):
        return N.nearest_anchors(*_strings(spark, d), "rid", K, ANCHORS, sides=(side,)).select("rid", "s", "e", F.col("r").cast("bigint").alias("r"), "pos")

    query.__name__ = f"anchors_topn_{side}"
    return query


anchors_topn_left, anchors_topn_right = _anchors_side("left"), _anchors_side("right")


def anchors_apart(spark, d):
    """Anchors that don't overlap each other."""
    return N.apart_anchors(*_strings(spark, d), "rid", K, ANCHORS).groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("places"))


def _chosen(spark, d):
    strings, anchors = _anchors(spark, d)
    anchors = cut(anchors)
    located = anchors.join(Q._sketch(spark, d).select("kmer", "vid"), "kmer")
    return strings, anchors, N.best_paths(located, V.steps(spark, d).select("vid", "path").distinct(), "rid")


def anchor_best_path(spark, d):
    return _chosen(spark, d)[2]


def anchor_path_ranks(spark, d):
    """The three paths that most anchors of a string lie on, on either side."""
    anchors = cut(_anchors(spark, d)[1])
    located = anchors.join(Q._sketch(spark, d).select("kmer", "vid"), "kmer")
    ranked = N.ranked_paths(located, V.steps(spark, d).select("vid", "path").distinct(), "rid", 3)
    return ranked.select("rid", "s", "e", "path", "n", F.col("r").cast("bigint").alias("r"))


def anchor_path_inversion(spark, d):
    """Paths that both chosen anchors of a string lie on, whichever way it walks either, with both ways as bits."""
    ends = _turned_ends(spark, d)
    at = V.steps(spark, d).select("path", "vid", F.col("rev").cast("int").alias("bit")).distinct()
    left = ends.select("sfs_id", F.col("sv").alias("vid")).join(at, "vid")
    right = ends.select("sfs_id", F.col("ev").alias("vid")).join(at, "vid")
    return N.common_paths(left, right, "sfs_id")


def _turned_ends(spark, d):
    """Anchored strings with the anchors in the order of their read, and whether each k-mer is turned."""
    rows = table(spark, d, "sfs").where("flag = 0 and sv is not null and ev is not null and soff is not null and eoff is not null")
    return rows.select("sfs_id", "sv", "ev", "soff", "eoff", "skmer", "ekmer", (F.col("sv") > F.col("ev")).alias("back"), (F.col("soff") % 2 == 1).alias("inv1"), (F.col("eoff") % 2 == 1).alias("inv2"))


def anchors_by_strand(spark, d):
    """Start and end of anchored strings as the strand of their path and the turned k-mers demand."""
    lens = V.segments(spark, d).select("vid", "len")
    return N.ends_by_strand(_turned_ends(spark, d), lens, "sfs_id")


def reverse_read_positions(spark, d):
    """Positions of the usable k-mers of each read, counted from its other end."""
    usable = _strings(spark, d)[1].join(V.reads(spark, d).select("rid", F.length("seq").alias("n")), "rid")
    return usable.groupBy("rid").agg(F.count(F.lit(1)).alias("n_kmers"), F.sum(N.reverse_position(F.col("n"), F.col("pos"), K)).alias("places"))


def sfs_flag_summary(spark, d):
    strings, anchors, chosen = _chosen(spark, d)
    return N.flags(strings, anchors, chosen, "rid").groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def sfs_dedup(spark, d):
    """Anchored strings that stay when those with a common start or end are dropped."""
    rows = table(spark, d, "sfs").where("flag = 0 and s >= 0 and l > 0")
    return N.without_contained(rows.select("rname", "sfs_id", "s", "l"), "rname", "sfs_id")


def chain_greedy(spark, d):
    """Chains of the anchors of each side along the chosen path."""
    strings, anchors, chosen = _chosen(spark, d)
    on = Q._sketch(spark, d).select("kmer", "vid", F.col("pos").alias("vpos"))
    offs = G.bp_offsets(V.steps(spark, d), V.segments(spark, d)).groupBy("path", "vid").agg(F.max("off").alias("off"))
    rows = anchors.join(on, "kmer").join(chosen, ["rid", "s", "e"]).join(offs, ["path", "vid"])
    lists = rows.groupBy("rid", "s", "e", "side").agg(F.array_sort(F.collect_list(F.struct("pos", (F.col("off") + F.col("vpos")).alias("at")))).alias("x"))
    return lists.select("rid", "s", "e", "side", F.size("x").alias("anchors"), F.size(N.greedy_chain(F.col("x.pos"), F.col("x.at"), F.size("x"))).alias("chained"))


def cluster_by_anchor(spark, d):
    return A.clusters(table(spark, d, "sfs").where("flag = 0"))


def cluster_consensus(spark, d):
    """One or two consensus strings of each cluster of anchored strings."""
    rows = table(spark, d, "sfs").where("flag = 0 and skmer is not null and ekmer is not null and plain_seq is not null and plain_seq not in ('', '.')")
    small = rows.groupBy("skmer", "ekmer").agg(F.count(F.lit(1)).alias("n")).where("n <= 64")
    lists = rows.join(small, ["skmer", "ekmer"]).groupBy("skmer", "ekmer").agg(F.sort_array(F.collect_list(F.upper("plain_seq"))).alias("x"))
    return lists.select("skmer", "ekmer", F.size("x").alias("n"), F.posexplode(A.cluster_consensus("x")).alias("i", "seq"))


def consensus_invariants(spark, d):
    """Clusters of one string only have it as their consensus; no cluster has more than two or an empty one."""
    rows = table(spark, d, "sfs").where("flag = 0 and skmer is not null and ekmer is not null and plain_seq is not null and plain_seq not in ('', '.')").select("skmer", "ekmer", F.upper("plain_seq").alias("u"))
    same = rows.groupBy("skmer", "ekmer").agg(F.min("u").alias("lo"), F.max("u").alias("hi"), F.count(F.lit(1)).alias("n")).where("n <= 64 and not lo rlike '[^ACGT]'")
    found = cluster_consensus(spark, d).groupBy("skmer", "ekmer").agg(F.max("seq").alias("seq"), F.count(F.lit(1)).alias("k"), F.min(F.length("seq")).alias("least"))
    met = same.join(found, ["skmer", "ekmer"])
    return met.select("skmer", "ekmer", ((F.col("lo") != F.col("hi")) | ((F.col("seq") == F.col("lo")) & (F.col("k") == 1))).alias("kept"), (F.col("k") <= 2).alias("two_at_most"), (F.col("least") > 0).alias("given"))


def kmer5_profile_canberra(spark, d):
    """For each cluster the other candidate whose 5-mer profile is nearest to that of the first."""
    rows = table(spark, d, "cand_paths").where("size(kcounts) = 1024 and cluster_id is not null").select("cluster_id", "cp_id", F.col("kcounts").alias("counts"))
    first = rows.groupBy("cluster_id").agg(F.min("cp_id").alias("cp_id"))
    targets = rows.join(first, ["cluster_id", "cp_id"]).select("cluster_id", F.col("counts").alias("profile"))
    found = A.nearest_profile(targets, rows.join(first, ["cluster_id", "cp_id"], "left_anti"), "cluster_id", "cp_id")
    return found.withColumn("dist", F.round("dist", 6))


def kmer5_profiles(spark, d):
    """5-mers of candidate sequences, counted anew."""
    rows = kmer_codes(table(spark, d, "cand_paths").where("sequence is not null"), "sequence", 5, ["cp_id"])
    counted = rows.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cp_id").alias("records"))
    return counted.withColumn("kmer", X.decode(F.col("kmer"), 5))


def affine_align(spark, d):
    """Candidate sequences aligned to the first one of their cluster, kept if both ends are aligned."""
    rows = table(spark, d, "cand_paths").where("sequence is not null and sequence not in ('', '.') and cluster_id is not null").select("cluster_id", "cp_id", F.upper("sequence").alias("seq"))
    first = rows.groupBy("cluster_id").agg(F.min(F.struct("cp_id", "seq")).alias("x"))
    # a filter on the alignment would be pushed below it, and each pair aligned twice
    kept = F.filter(F.array(A.aligned("seq", "x.seq")), lambda a: A.anchored_ends(a["cigar"]))
    met = rows.join(first, "cluster_id").where("cp_id <> x.cp_id").select("cp_id", F.explode(kept).alias("a"))
    return met.select("cp_id", "a.score", "a.cigar", "a.matches", "a.nm", A.cs_to_cigar(F.col("a.cs")).alias("extended"))


def _aligned_to_first(spark, d):
    """Every candidate sequence aligned to the first one of its cluster."""
    rows = table(spark, d, "cand_paths").where("sequence is not null and sequence not in ('', '.') and cluster_id is not null").select("cluster_id", "cp_id", F.upper("sequence").alias("seq"))
    first = rows.groupBy("cluster_id").agg(F.min(F.struct("cp_id", "seq"))["seq"].alias("other"))
    return rows.join(first, "cluster_id").withColumn("a", A.aligned("seq", "other"))


def affine_invariants(spark, d):
    """What must hold of alignments: both strings are spelled, letters and edits are counted right, equal strings need no edit."""
    size = lambda ops: X.cigar_sum(F.col("a.cigar"), ops)
    whole = A.cs_to_cigar(F.col("a.cs"))
    return _aligned_to_first(spark, d).select(
        "cp_id",
        (size("MI") == F.length("seq")).alias("spells_query"), (size("MD") == F.length("other")).alias("spells_target"),
        (X.cigar_sum(whole, "=") == F.col("a.matches")).alias("matches_right"), (X.cigar_sum(whole, "XID") == F.col("a.nm")).alias("nm_right"),
        ((F.col("seq") != F.col("other")) | (F.col("a.nm") == 0)).alias("equal_without_edits"),
    )


def gapped_strings(spark, d):
    """Alignments of candidate sequences told by their gapped strings: CIGAR, matches and edits anew from these."""
    met = _aligned_to_first(spark, d).withColumn("g", A.gapped("seq", "other", "a.cigar")).withColumn("b", A.from_gapped("g.query", "g.target"))
    same = lambda c: (F.col(f"b.{c}") == F.col(f"a.{c}")).alias(f"same_{c}")
    return met.select("cp_id", *map(same, ("cigar", "cs", "matches", "nm")))


def _equal_ops(spark, d):
    g = table(spark, d, "gaf").where("cigar is not null and ps >= 0 and qs >= 0 and qs < qe and qe <= qlen").select("aln_id", "cigar", "ps", "qs", "qe")
    return g, A.operations(g, "aln_id", "cigar", F.col("ps"))


def refined_intervals(spark, d):
    """The middle third of each alignment's span, widened on both sides to the nearest seven equal letters in a row, on query and path."""
    g, ops = _equal_ops(spark, d)
    third = ((F.col("qe") - F.col("qs")) / 3).cast("bigint")
    spans = g.select("aln_id", third.alias("s"), (F.col("qe") - F.col("qs") - third).alias("e"))
    return A.widened_to_anchors(spans, ops, "aln_id", 7)


def sam_projection(spark, d):
    """Anchored strings on the lowest reference path that holds both anchors."""
    k = 11
    rows = table(spark, d, "sfs").where(f"flag = 0 and sv is not null and ev is not null and soff is not null and eoff is not null and length(plain_seq) >= {2 * k}")
    offs = G.bp_offsets(V.steps(spark, d).where("is_ref"), V.segments(spark, d)).groupBy("path", "vid").agg(F.max("off").alias("off"))
    a = offs.select("path", F.col("vid").alias("sv"), F.col("off").alias("o1"))
    b = offs.select("path", F.col("vid").alias("ev"), F.col("off").alias("o2"))
    met = rows.join(a, "sv").join(b, ["path", "ev"])
    low = met.groupBy("sfs_id").agg(F.min(F.struct("path", "o1", "o2", "soff", "eoff", "plain_seq")).alias("x"))
    flat = low.select("sfs_id", "x.*")
    strings = flat.select(F.col("sfs_id").cast("string").alias("name"), F.col("path").alias("contig"), (F.col("o1") + F.col("soff")).alias("start"), (F.col("o2") + F.col("eoff") + 1).alias("end"), F.lit(True).alias("strand"), F.col("plain_seq").alias("seq"))
    return A.reference_records(strings, k).select("contig", "qname", "flag", "pos", "cigar", "seq")


def sam_projection_stranded(spark, d):
    """Anchored strings on the lowest reference path, on the strand that the order of their anchors on it tells."""
    k = 11
    rows = table(spark, d, "sfs").where(f"flag = 0 and sv is not null and ev is not null and soff is not null and eoff is not null and length(plain_seq) >= {2 * k}")
    offs = G.bp_offsets(V.steps(spark, d).where("is_ref"), V.segments(spark, d)).groupBy("path", "vid").agg(F.max("off").alias("off"))
    a = offs.select("path", F.col("vid").alias("sv"), F.col("off").alias("o1"))
    b = offs.select("path", F.col("vid").alias("ev"), F.col("off").alias("o2"))
    met = rows.join(a, "sv").join(b, ["path", "ev"])
    flat = met.groupBy("sfs_id").agg(F.min(F.struct("path", "o1", "o2", "soff", "eoff", "plain_seq")).alias("x")).select("sfs_id", "x.*")
    placed = flat.select(F.col("sfs_id").cast("string").alias("name"), F.col("path").alias("contig"), (F.col("o1") + F.col("soff")).alias("p1"), (F.col("o2") + F.col("eoff")).alias("p2"), F.col("plain_seq").alias("seq"))
    return A.reference_records(A.on_strand(placed, k), k).select("contig", "qname", "flag", "pos", "cigar", "seq")


def _best(rule):
    def query(spark, d):
        out = R.best_alignment(V.alns(spark, d), rule)
        return out.select("query", "cov", "nm") if rule in "ab" else out

    query.__name__ = f"best_alignment_{rule}"
    return query


BEST = [_best(rule) for rule in "abcdef"]


def aln_gain_classes(spark, d):
    """Queries by how the second aligner compares with the first."""
    a = V.alns(spark, d)
    found = R.gain_classes(R.best_alignment(a.where("tool = 'graphwalk'"), "c"), R.best_alignment(a.where("tool = 'seedchain'"), "c"))
    return found.groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def only_in_augmented(spark, d):
    a = V.alns(spark, d)
    return a.where("tool = 'seedchain'").select("query").distinct().join(a.where("tool = 'graphwalk'").select("query"), "query", "left_anti")


def in_both(spark, d):
    a = V.alns(spark, d)
    return a.where("tool = 'seedchain'").select("query").intersect(a.where("tool = 'graphwalk'").select("query"))


def identity_filter(spark, d):
    return V.alns(spark, d).where("cigar_len > 0").where(F.col("matches") / F.col("cigar_len") >= 0.95).select("aln_id", F.round(F.col("matches") / F.col("cigar_len"), 6).alias("identity"))


def all_tools_by_query(spark, d):
    """Best nm of four tools side by side; queries with two of them at least."""
    tools = ["graphwalk", "seedchain", "polish", "sketchmap"]
    out = R.wide(V.alns(spark, d), "query", "tool", "nm", tools)
    known = sum((F.col(t).isNotNull().cast("int") for t in tools), F.lit(0))
    return out.where(known >= 2)


def _regions(spark, d):
    b = V.bed(spark, d)
    return b.where("event_id % 2 = 1"), b.where("event_id % 2 = 0")


def interval_overlap_label(spark, d):
    a, b = _regions(spark, d)
    met = I.bin_join(a, b.select("chrom", "s", "e", "event_id"), 7200).groupBy("event_id").agg(F.count(F.lit(1)).alias("overlaps"))
    return a.join(met, "event_id", "left").select("event_id", F.coalesce("overlaps", F.lit(0)).alias("overlaps"))


def interval_overlap_fraction(spark, d):
    """Intervals a third of which one region covers."""
    a, b = _regions(spark, d)
    met = I.bin_join(a, b.select("chrom", "s", "e"), 7200)
    shared = F.least("e", "b_e") - F.greatest("s", "b_s")
    return met.where(shared * 100 >= (F.col("e") - F.col("s")) * 33).select("event_id").distinct()


def _spans(spark, d):
    return V.bed(spark, d).select(F.col("chrom").alias("key"), "s", "e", "event_id")


def interval_merge_union(spark, d):
    """Intervals of over 1000 seconds merged, touching ones too."""
    return I.islands(_spans(spark, d).where("e - s > 1000").select("key", "s", "e"), touching=True).select(F.col("key").alias("chrom"), "s", "e")


def interval_depth(spark, d):
    return depth(_spans(spark, d)).select(F.col("key").alias("chrom"), "s", "e", "depth")


def gap_statistics(spark, d):
    return R.gap_statistics(_spans(spark, d), ["s", "event_id"], 600, 86_400)


def covered_share(spark, d):
    """Covered seconds of each chromosome and their share of its extent."""
    spans = _spans(spark, d)
    merged = I.islands(spans.select("key", "s", "e")).groupBy("key").agg(F.sum(F.col("e") - F.col("s")).alias("covered"))
    size = spans.groupBy("key").agg((F.max("e") - F.min("s")).alias("size"))
    return size.join(merged, "key", "left").select("key", "covered", F.round(F.col("covered") / F.col("size"), 6).alias("share"))


def anchoring_categories(spark, d):
    """Anchored ends of strings against the ends of the alignment of the same number, by aligner."""
    s = table(spark, d, "sfs").where("flag = 0 and gfa_sv is not null and gfa_ev is not null").select(F.col("sfs_id").alias("aln_id"), "gfa_sv", "gfa_ev")
    g = table(spark, d, "gaf").where("path is not null and qs is not null and qe is not null and qlen is not null").select("aln_id", "aligner", X.walk(F.col("path")).alias("w"), "qs", "qe", "qlen")
    g = g.where("size(w) > 0").select("aln_id", "aligner", F.when(F.col("qs") > 0, "~").otherwise(F.col("w")[0]["id"]).alias("t1"), F.when(F.col("qe") < F.col("qlen"), "~").otherwise(F.element_at("w", -1)["id"]).alias("t2"))
    rows = s.join(g, "aln_id").withColumn("category", R.endpoint_category(F.col("gfa_sv"), F.col("gfa_ev"), F.col("t1"), F.col("t2")))
    kinds = ["GOOD", "HALF_BAD", "BAD", "FULL_CLIP", "HALF_CLIP", "BAD_CLIP"]
    return rows.groupBy("aligner").pivot("category", kinds).count().na.fill(0, kinds).withColumn("total", sum((F.col(c) for c in kinds), F.lit(0).cast("bigint")))


def anchoring_positions(spark, d):
    """Anchored ends of strings against the vertices that the alignment of their read passes at both positions, by category."""
    s = table(spark, d, "sfs").where("flag = 0 and gfa_sv is not null and gfa_ev is not null and rname is not null and s >= 0 and l >= 1").select("sfs_id", "rname", F.col("s").cast("bigint").alias("s"), (F.col("s") + F.col("l")).cast("bigint").alias("e"), F.col("gfa_sv").alias("v1"), F.col("gfa_ev").alias("v2"))
    g, ops = _equal_ops(spark, d)
    reads = table(spark, d, "gaf").where("cigar is not null and ps >= 0 and qs >= 0 and qs < qe and qe <= qlen").select("aln_id", "qs", "qe", "qlen", F.explode(F.split(F.col("tags")["rs"], "[|]")).alias("rname"))
    # of the alignments a read stands behind, the first one tells where it lies
    own = reads.where("rname <> ''").groupBy("rname").agg(F.min(F.struct("aln_id", "qs", "qe", "qlen")).alias("x")).select("rname", "x.*")
    met = s.join(own, "rname").withColumns({"s": F.col("s") % F.col("qlen"), "e": (F.col("e") - 1) % F.col("qlen")})
    segs = table(spark, d, "segments").where("seq is not null and seq not in ('', '*', '.')").select("vid", "id")
    at = R.vertices_at(met.select("sfs_id", "aln_id", "qs", "qe", F.explode(F.array("s", "e")).alias("q")), ops, _vertices_of(spark, d).join(segs, "vid").select("aln_id", "id", "off", "len"), "sfs_id", "aln_id")
    t1 = at.select("sfs_id", F.col("q").alias("s"), F.col("id").alias("t1"))
    t2 = at.select("sfs_id", F.col("q").alias("e"), F.col("id").alias("t2"))
    rows = met.join(t1, ["sfs_id", "s"]).join(t2, ["sfs_id", "e"]).withColumn("category", R.endpoint_category(F.col("v1"), F.col("v2"), F.col("t1"), F.col("t2")))
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def occurrence_index(spark, d):
    """Alignments of each query numbered from 0."""
    return R.occurrences(V.alns(spark, d).select("query", "aln_id"), "query", "aln_id").select("aln_id", "query", "i")


def plain_contigs(spark, d):
    """Names of reads without an underscore, with their number of strings."""
    return table(spark, d, "sfs").where("rname is not null").where(~F.col("rname").contains("_")).groupBy("rname").agg(F.count(F.lit(1)).alias("n"))


def candidate_filter(spark, d):
    """Candidate sequences of known letters only, of 100,000 at most."""
    return table(spark, d, "cand_paths").where("sequence is not null and sequence not in ('', '.')").where(~F.upper("sequence").contains("N") & (F.length("sequence") <= 100_000)).select("cp_id", F.length("sequence").cast("bigint").alias("l"))


def paths_with_unique_kmers(spark, d):
    """How many k-mers of the sketch each candidate sequence holds, and whether it holds one at its very start."""
    found = kmer_codes(table(spark, d, "cand_paths").where("sequence is not null"), "sequence", K, ["cp_id"]).join(Q._sketch(spark, d).select("kmer"), "kmer")
    return found.groupBy("cp_id").agg(F.count_distinct("kmer").alias("held"), F.bool_or(F.col("pos") == 0).alias("at_start"))


def nm_without_peak(spark, d):
    """Edit distances of both tools below the cut at 10; what lies at it or above is left out."""
    rows = V.alns(spark, d).where("tool in ('graphwalk', 'seedchain')").withColumn("nm", F.least("nm", F.lit(10)))
    return rows.where("nm < 10").groupBy("tool", "nm").agg(F.count(F.lit(1)).alias("n"))


def _vertices_of(spark, d):
    """Vertices along alignment paths, with offsets."""
    segs = table(spark, d, "segments").where("seq is not null and seq not in ('', '*', '.')").select("id", "vid", F.length("seq").cast("bigint").alias("len"))
    rows = V.walks(spark, d).join(segs, "id").select(F.col("aln_id").alias("path"), F.col("step"), "vid")
    return G.bp_offsets(rows, segs.select("vid", "len")).select(F.col("path").alias("aln_id"), "vid", "off", "len")


def _vertex_support(spark, d):
    g = table(spark, d, "gaf").where("cigar is not null and ps >= 0").select("aln_id", "cigar", "ps")
    errors = A.vertex_errors(A.operations(g, "aln_id", "cigar", F.col("ps")), _vertices_of(spark, d), "aln_id")
    used = errors.groupBy("vid").agg(F.count(F.lit(1)).alias("supp"), F.avg(F.col("ok") / (F.col("ok") + F.col("err"))).alias("qual"))
    return V.segments(spark, d).select("vid", F.col("len").alias("l")).join(used, "vid", "left").select("vid", "l", F.coalesce("supp", F.lit(0)).alias("supp"), F.coalesce("qual", F.lit(-1.0)).alias("qual"))


def vertex_support_quality(spark, d):
    """Alignments on each vertex and the mean share of right letters, -1 for none."""
    return _vertex_support(spark, d).withColumn("qual", F.round("qual", 6))


def precision_table(spark, d):
    return R.precision(_vertex_support(spark, d).withColumn("part", F.col("vid") % 3), ["part"])


def recall_table(spark, d):
    return R.share_table(V.alns(spark, d), ["tool"], F.col("nm") == 0, ("perfect", "alignments", "recall"))


def support_histogram(spark, d):
    return _vertex_support(spark, d).groupBy("supp").agg(F.count(F.lit(1)).alias("n"))


def cigar_expand_counts(spark, d):
    """Letters of each kind of operation by alignment, and the length of the expanded string."""
    g = table(spark, d, "gaf").where("cigar is not null")
    c = F.col("cigar")
    return g.select("aln_id", *(X.cigar_sum(c, o).alias(n) for o, n in (("M", "m"), ("=", "eq"), ("X", "x"), ("I", "i"), ("D", "d"))), F.length(X.cigar_expand(c)).cast("bigint").alias("expanded"))


def errors_added_ratio(spark, d):
    """Wrong letters for each letter aligned, by aligner."""
    g = table(spark, d, "gaf").where("cigar is not null and aligner is not null")
    sums = g.groupBy("aligner").agg(F.sum(X.cigar_sum(F.col("cigar"), "XID")).alias("errors"), F.sum(X.cigar_sum(F.col("cigar"), "M=XI")).alias("added"))
    return sums.withColumn("ratio", F.round(F.col("errors") / F.col("added"), 6))


def homopolymer_indels(spark, d):
    """Short indels before long runs, which are taken for errors of reading."""
    segs = table(spark, d, "segments").where("seq is not null and seq not in ('', '*', '.')").select(F.col("id"), F.upper("seq").alias("seq"))
    part = V.walks(spark, d).join(segs, "id").select("aln_id", "step", F.when(F.col("rev"), X.reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("x"))
    refs = part.groupBy("aln_id").agg(F.array_sort(F.collect_list(F.struct("step", "x"))).alias("p")).select("aln_id", F.concat_ws("", "p.x").alias("ref"))
    g = table(spark, d, "gaf").where("cigar is not null and ps >= 0").select("aln_id", "cigar", "ps")
    ops = A.homopolymer_indels(A.operations(g, "aln_id", "cigar", F.col("ps")), refs, "aln_id", 3, 3)
    return ops.where("drop").select("aln_id", F.col("i").cast("bigint").alias("i"), "op", "len")


def nm_pivot_improved(spark, d):
    """Edit distances of two tools side by side, cut at 10, in long form again."""
    names = ["graphwalk", "seedchain"]
    out = R.wide(V.alns(spark, d).withColumn("nm", F.least("nm", F.lit(10))), "query", "tool", "nm", names).dropna()
    return R.long_form(out, "query", names, "tool", "nm")


def nm_delta_histogram(spark, d):
    out = R.wide(V.alns(spark, d), "query", "tool", "nm", ["graphwalk", "seedchain"])
    return R.delta_histogram(out, "graphwalk", "seedchain", 8)


def percentile_summary(spark, d):
    return R.percentiles(V.alns(spark, d), "tool", "nm", [0.1, 0.25, 0.5, 0.75, 0.9, 0.99], 5)


def cumulative_nm(spark, d):
    return R.cumulative(V.alns(spark, d), "tool", "nm")


def dedup_records(spark, d):
    """Strings delivered again: the lowest id of each, with the number of copies."""
    s = table(spark, d, "sfs").where("plain_seq is not null").select("sfs_id", "rname", "s", F.upper("plain_seq").alias("u"))
    return R.first_of_each(s, ["rname", "s", "u"], "sfs_id").where("copies > 1").select("sfs_id", "rname", "s", "copies")


def name_translate(spark, d):
    """Alignments with the rank of their aligner; unknown ones drop out."""
    names = table(spark, d, "aligners").select("aligner", "trust_rank")
    return table(spark, d, "gaf").select("aln_id", "aligner").join(names, "aligner").select("aln_id", "trust_rank")


def name_filter(spark, d):
    """Strings on reads of a list, and the rest marked."""
    wanted = table(spark, d, "sfs").where("batch_id = 0 and rname is not null").select("rname").distinct().withColumn("listed", F.lit(True))
    s = table(spark, d, "sfs").select("sfs_id", "rname").join(wanted, "rname", "left")
    return s.select("sfs_id", F.col("listed").isNotNull().alias("listed"))


def union_tables(spark, d):
    """Both tables of sequences under one header."""
    a = table(spark, d, "sfs").where("plain_seq is not null").select(F.lit("sfs").alias("src"), F.col("sfs_id").alias("id"), F.length("plain_seq").cast("bigint").alias("l"))
    b = table(spark, d, "cand_paths").where("sequence is not null").select(F.lit("cand_paths").alias("src"), F.col("cp_id").alias("id"), F.length("sequence").cast("bigint").alias("l"))
    return a.unionByName(b)


def read_sample(spark, d):
    """A tenth of the reads by a seeded hash, the same ones on every run."""
    return V.reads(spark, d).where(R.seeded("rid", 42) < "1999999a").select("rid", F.length("seq").cast("bigint").alias("l"))


def sample_choice(spark, d):
    """Eight clusters in a seeded random order."""
    c = table(spark, d, "cand_paths").where("cluster_id is not null").select("cluster_id").distinct()
    return c.orderBy(R.seeded("cluster_id", 23), "cluster_id").limit(8)


QUERIES = {q.__name__: q for q in (
    anchors_topn_left, anchors_topn_right, anchors_apart, anchor_path_ranks, anchor_path_inversion, anchors_by_strand, reverse_read_positions, affine_invariants, gapped_strings, refined_intervals,
    sam_projection_stranded, anchoring_positions, occurrence_index, plain_contigs, candidate_filter, paths_with_unique_kmers, nm_without_peak, anchor_best_path, sfs_flag_summary, sfs_dedup, chain_greedy, cluster_by_anchor, cluster_consensus, consensus_invariants, kmer5_profile_canberra, kmer5_profiles,
    affine_align, sam_projection, *BEST, aln_gain_classes, only_in_augmented, in_both, identity_filter, all_tools_by_query, interval_overlap_label, interval_overlap_fraction, interval_merge_union,
    interval_depth, gap_statistics, covered_share, anchoring_categories, vertex_support_quality, precision_table, recall_table, support_histogram, cigar_expand_counts, errors_added_ratio, homopolymer_indels,
    nm_pivot_improved, nm_delta_histogram, percentile_summary, cumulative_nm, dedup_records, name_translate, name_filter, union_tables, read_sample, sample_choice,
)}

_HIT = with_("reads", "panel", "rk", "pk", "hit") + "," + Q._RUNS
_ANCHOR = f"""{_HIT},
st as (select rid, s, e from c where s is not null and e is not null),
us as (select rid, pos, kmer from (select *, count(*) over (partition by rid, kmer) as n from hit) where hit and n = 1),
an0 as (select st.*, us.pos, us.kmer, case when us.pos + {K} <= s then 'left' when us.pos >= e then 'right' end as side from st join us on st.rid = us.rid),
an as (select * from (select *, row_number() over (partition by rid, s, e, side order by case when pos < s then s - pos else pos - e end) as r from an0 where side is not null) where r <= {ANCHORS})
"""
_CHOSEN = _ANCHOR + ", " + V.SQL["steps"] + """,
lp as (select distinct vid, path from steps),
ct as (select rid, s, e, path, count(*) filter (where side = 'left') as nl, count(*) filter (where side = 'right') as nr from an join uk on an.kmer = uk.kmer join lp on lp.vid = uk.vid group by 1, 2, 3, 4),
ch as (select rid, s, e, path, nl, nr from (select *, row_number() over (partition by rid, s, e order by 2.0 * nl * nr / (nl + nr) desc, nl + nr desc, path) as r from ct where nl > 0 and nr > 0) where r = 1)
"""
_REG = with_("bed") + ", a as (select * from bed where event_id % 2 = 1), b as (select * from bed where event_id % 2 = 0), j as (select a.event_id, a.s, a.e, b.s as bs, b.e as be from a join b on a.chrom = b.chrom and a.s < b.e and b.s < a.e)"


def _merge(src: str, op: str) -> str:
    return f"""m as (select *, max(e) over (partition by chrom order by s, e, event_id rows between unbounded preceding and 1 preceding) as b from {src}),
    g as (select *, sum(case when b is null or s {op} b then 1 else 0 end) over (partition by chrom order by s, e, event_id rows unbounded preceding) as g from m), u as (select chrom, min(s) as s, max(e) as e from g group by chrom, g)"""


def _rule(order: str, where: str, cols: str) -> str:
    return with_("alns") + f", r as (select *, row_number() over (partition by query order by {order}) as r from alns where {where}) select {cols} from r where r = 1"


_ALL = "query, aln_id, cov, nm"
_SUPP = with_("panel", "walks") + """,
sg as (select id, vid, length(seq) as len from segments where seq is not null and seq not in ('', '*', '.')),
vx as (select aln_id, vid, len, sum(len) over (partition by aln_id order by step) - len as off from walks join sg using (id)),
op0 as (select aln_id, ps, unnest(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]')) as x, generate_subscripts(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]'), 1) - 1 as i from gaf where cigar is not null and ps >= 0),
op1 as (select aln_id, ps, i, right(x, 1) as op, left(x, length(x) - 1)::int as l from op0),
op as (select *, ps + sum(case when op in ('M', '=', 'X', 'D') then l else 0 end) over w - case when op in ('M', '=', 'X', 'D') then l else 0 end as p from op1 window w as (partition by aln_id order by i)),
pt as (select op.aln_id, vid, op, case when op = 'I' then case when p >= off and p < off + len then l else 0 end else greatest(least(p + l, off + len) - greatest(p, off), 0) end as n from op join vx using (aln_id)),
er as (select aln_id, vid, sum(case when op in ('M', '=') then n else 0 end) as ok, sum(case when op in ('X', 'D', 'I') then n else 0 end) as err from pt where n > 0 group by 1, 2),
vs as (select panel.vid, any_value(len) as l, count(aln_id) as supp, coalesce(avg(ok / (ok + err)), -1) as qual from panel left join er using (vid) group by panel.vid)
"""
_CIG = "c0 as (select *, unnest(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]')) as x from gaf where cigar is not null), ci as (select *, right(x, 1) as op, left(x, length(x) - 1)::bigint as n from c0)"

_OPS = _SUPP[: _SUPP.index("pt as")].rstrip().rstrip(",").replace("case when op in ('M', '=', 'X', 'D') then l else 0 end as p from", "case when op in ('M', '=', 'X', 'D') then l else 0 end as p, sum(case when op in ('M', '=', 'X', 'I') then l else 0 end) over w - case when op in ('M', '=', 'X', 'I') then l else 0 end as q from")
_SPAN = "cigar is not null and ps >= 0 and qs >= 0 and qs < qe and qe <= qlen"

SQL = {
    "anchors_apart": _ANCHOR[: _ANCHOR.index("an as (select * from")].rstrip().rstrip(",") + f""",
        od as (select rid, s, e, side, list([pos] order by case side when 'left' then -pos else pos end) as x from an0 where side is not null group by all),
        pk2 as (select side, list_reduce(x, lambda a, b: case when len(a) < {ANCHORS} and abs(b[1] - a[-1]) >= {K} then list_concat(a, b) else a end) as a from od)
        select side, sum(len(a))::bigint as n, sum(list_sum(a))::bigint as places from pk2 group by side""",
    "chain_greedy": _CHOSEN.rstrip() + """, of0 as (select path, vid, max(off) as off from (select path, vid, sum(len) over (partition by path order by step) - len as off from steps join panel using (vid)) group by 1, 2),
        ro as (select an.rid, an.s, an.e, side, an.pos, off + uk.pos as at_ from an join uk on uk.kmer = an.kmer join ch on ch.rid = an.rid and ch.s = an.s and ch.e = an.e join of0 on of0.path = ch.path and of0.vid = uk.vid),
        li as (select rid, s, e, side, list([[pos, at_]::bigint[]] order by pos, at_) as x from ro group by 1, 2, 3, 4),
        st2 as (select rid, s, e, side, len(x) as n, i, len(list_reduce(x[i:], lambda a, b: case when b[1][2] > a[-1][2] and b[1][1] > a[-1][1] and least(b[1][2] - a[-1][2], b[1][1] - a[-1][1]) / greatest(b[1][2] - a[-1][2], b[1][1] - a[-1][1]) > 0.9 then list_concat(a, b) else a end)) as c
            from (select *, unnest(range(1, len(x) + 1)) as i from li))
        select rid, s, e, side, any_value(n)::int as anchors, coalesce(arg_min(c, i) filter (where 2 * c > n), max(c))::int as chained from st2 group by rid, s, e, side""",
    "anchor_path_ranks": _CHOSEN[: _CHOSEN.index("ct as")].rstrip().rstrip(",") + """, pc as (select rid, s, e, path, count(*) as n from an join uk on an.kmer = uk.kmer join lp on lp.vid = uk.vid group by 1, 2, 3, 4)
        select rid, s, e, path, n, r from (select *, row_number() over (partition by rid, s, e order by n desc, path) as r from pc) where r <= 3""",
    "anchor_path_inversion": with_("steps") + """, ed as (select sfs_id, sv, ev from sfs where flag = 0 and sv is not null and ev is not null and soff is not null and eoff is not null),
        st as (select distinct path, vid, rev::int as bit from steps), j as (select sfs_id, a.path, a.bit as bit1, b.bit as bit2 from ed join st a on a.vid = sv join st b on b.vid = ev and b.path = a.path)
        select sfs_id, path, bit1, bit2 from (select *, row_number() over (partition by sfs_id, path, bit1 order by (bit1 <> bit2)::int) as r from j) where r = 1""",
    "anchors_by_strand": with_("panel") + """, ed as (select sfs_id, sv > ev as back, soff % 2 = 1 as inv1, eoff % 2 = 1 as inv2, sv, ev, soff, eoff, skmer, ekmer from sfs where flag = 0 and sv is not null and ev is not null and soff is not null and eoff is not null),
        t as (select sfs_id, back, inv1, inv2, case when back then ev else sv end as v1, case when back then sv else ev end as v2, case when back then eoff else soff end as o1, case when back then soff else eoff end as o2, case when back then ekmer else skmer end as k1, case when back then skmer else ekmer end as k2 from ed)
        select sfs_id, v1 * 2 + inv1::int as h1, v2 * 2 + inv2::int as h2, cast(case when inv1 then a.len - o1 - 1 else o1 end as bigint) as off1, cast(case when inv2 then b.len - o2 - 1 else o2 end as bigint) as off2, k1 as skmer, k2 as ekmer, back as reverse
        from t join panel a on a.vid = v1 join panel b on b.vid = v2""",
    "reverse_read_positions": with_("reads", "panel", "rk", "pk", "hit") + f""", o as (select *, count(*) over (partition by rid, kmer) as c from hit)
        select rid, count(*) as n_kmers, cast(sum(length(seq) - pos - {K}) as bigint) as places from o join reads using (rid) where hit and c = 1 group by rid""",
    "affine_invariants": "select cp_id, true as spells_query, true as spells_target, true as matches_right, true as nm_right, true as equal_without_edits from cand_paths where sequence is not null and sequence not in ('', '.') and cluster_id is not null",
    "gapped_strings": "select cp_id, true as same_cigar, true as same_cs, true as same_matches, true as same_nm from cand_paths where sequence is not null and sequence not in ('', '.') and cluster_id is not null",
    "consensus_invariants": """with r as (select skmer, ekmer, min(upper(plain_seq)) as lo, count(*) as n from sfs where flag = 0 and skmer is not null and ekmer is not null and plain_seq not in ('', '.') group by 1, 2)
        select skmer, ekmer, true as kept, true as two_at_most, true as given from r where n <= 64 and not regexp_matches(lo, '[^ACGT]')""",
    "refined_intervals": _OPS + f""", sp as (select aln_id, trunc((qe - qs) / 3)::bigint as s, qe - qs - trunc((qe - qs) / 3)::bigint as e from gaf where {_SPAN}),
        eq as (select aln_id, p, q, l from op where op = '=' and l >= 7),
        lf as (select sp.aln_id, max(least(q + l, s)) as a from sp join eq using (aln_id) where least(q + l, s) >= q + 7 group by 1),
        rt as (select sp.aln_id, min(greatest(q, e)) as b from sp join eq using (aln_id) where greatest(q, e) <= q + l - 7 group by 1)
        select sp.aln_id, cast(a - 7 as bigint) as q1, cast(b + 7 as bigint) as q2, cast(x.p + a - 7 - x.q as bigint) as p1, cast(y.p + b + 7 - y.q as bigint) as p2 from sp join lf using (aln_id) join rt using (aln_id)
        join eq x on x.aln_id = sp.aln_id and a >= x.q + 7 and a <= x.q + x.l join eq y on y.aln_id = sp.aln_id and b >= y.q and b <= y.q + y.l - 7""",
    "sam_projection_stranded": with_("panel", "steps") + """, o as (select path, vid, max(off) as off from (select path, vid, sum(len) over (partition by path order by step) - len as off from steps join panel using (vid) where steps.is_ref) group by 1, 2),
        m as (select sfs_id, plain_seq as q0, a.path, a.off + soff as p1, b.off + eoff as p2, row_number() over (partition by sfs_id order by a.path, a.off, b.off, soff, eoff, plain_seq) as r from sfs join o a on a.vid = sv join o b on b.vid = ev and b.path = a.path
              where flag = 0 and soff is not null and eoff is not null and length(plain_seq) >= 22),
        t as (select sfs_id, path, p1 > p2 as back, case when p1 > p2 then reverse(translate(q0, 'ACGTacgt', 'TGCAtgca')) else q0 end as q, case when p1 > p2 then p2 - 10 else p1 end as st, case when p1 > p2 then p1 + 10 else p2 end + 1 as en from m where r = 1),
        x as (select *, en - st - 22 as gap from t)
        select path as contig, sfs_id || '.a1' as qname, 0 as flag, cast(st - 9 as bigint) as pos, '11M' as cigar, left(q, 11) as seq from x where st > en
        union all select path, sfs_id || '.a2', 0, cast(en as bigint), '11M', right(q, 11) from x where st > en
        union all select path, sfs_id::varchar, case when back then 16 else 0 end, cast(st + 1 as bigint), case when gap > 0 then '11M' || gap || 'N11M' else (gap + 22) || 'M' end, case when gap > 0 then left(q, 11) else left(q, greatest(11 + gap, 0)::bigint) end || right(q, 11) from x where st <= en""",
    "anchoring_positions": _OPS + f""", s0 as (select sfs_id, rname, s::bigint as s, (s + l)::bigint as e, gfa_sv as v1, gfa_ev as v2 from sfs where flag = 0 and gfa_sv is not null and gfa_ev is not null and rname is not null and s >= 0 and l >= 1),
        rd as (select aln_id, qs, qe, qlen, unnest(string_split(tags['rs'], '|')) as rname from gaf where {_SPAN}), ow as (select rname, arg_min((aln_id, qs, qe, qlen), aln_id) as x from rd where rname <> '' group by rname),
        mt as (select sfs_id, v1, v2, x[1] as aln_id, x[2] as qs, x[3] as qe, s % x[4] as s, (e - 1) % x[4] as e from s0 join ow using (rname)),
        qq as (select distinct sfs_id, aln_id, qs, qe, unnest([s, e]) as q from mt),
        hit as (select qq.sfs_id, qq.q, min(vx.id) as id from qq join op on op.aln_id = qq.aln_id and op.op in ('M', '=', 'X', 'I') and qq.q - qs >= op.q and qq.q - qs < op.q + op.l
            join (select v.aln_id, off, v.len, sg.id from vx v join sg on sg.vid = v.vid) vx on vx.aln_id = qq.aln_id and op.p + case when op.op = 'I' then 0 else qq.q - qs - op.q end >= vx.off and op.p + case when op.op = 'I' then 0 else qq.q - qs - op.q end < vx.off + vx.len where qq.q >= qs and qq.q < qe group by 1, 2),
        ap as (select qq.sfs_id, qq.q, coalesce(hit.id, '~') as id from qq left join hit on hit.sfs_id = qq.sfs_id and hit.q = qq.q where hit.id is not null or qq.q < qs or qq.q >= qe),
        t as (select v1, v2, a.id as t1, b.id as t2 from mt join ap a on a.sfs_id = mt.sfs_id and a.q = mt.s join ap b on b.sfs_id = mt.sfs_id and b.q = mt.e),
        k as (select *, len(list_intersect([v1, v2], [t1, t2])) as n from t)
        select case when (v1 = t1 and v2 = t2) or (v1 = t2 and v2 = t1) then 'GOOD' when t1 = '~' or t2 = '~' then case when t1 = t2 then 'FULL_CLIP' when n = 1 then 'HALF_CLIP' else 'BAD_CLIP' end when n = 1 then 'HALF_BAD' else 'BAD' end as category, count(*) as n from k group by 1""",
    "occurrence_index": with_("alns") + "select aln_id, query, row_number() over (partition by query order by aln_id) - 1 as i from alns",
    "plain_contigs": "select rname, count(*) as n from sfs where rname is not null and not contains(rname, '_') group by 1",
    "candidate_filter": "select cp_id, length(sequence) as l from cand_paths where sequence not in ('', '.') and not contains(upper(sequence), 'N') and length(sequence) <= 100000",
    "paths_with_unique_kmers": with_("panel", "pk") + f""", cw as (select cp_id, i, substr(t, i, {K}) as w from (select cp_id, upper(sequence) as t, unnest(range(1, length(sequence) - {K - 2})) as i from cand_paths where length(sequence) >= {K})),
        ck as (select cp_id, i, least(w, reverse(translate(w, 'ACGT', 'TGCA'))) as kmer from cw where regexp_full_match(w, '[ACGT]+')) select cp_id, count(distinct kmer) as held, bool_or(i = 1) as at_start from ck join uk using (kmer) group by cp_id""",
    "nm_without_peak": with_("alns") + "select tool, nm, count(*) as n from alns where tool in ('graphwalk', 'seedchain') and nm < 10 group by 1, 2",
    "anchors_topn_left": _ANCHOR + "select rid, s, e, r, pos from an where side = 'left'",
    "anchors_topn_right": _ANCHOR + "select rid, s, e, r, pos from an where side = 'right'",
    "anchor_best_path": _CHOSEN + "select rid, s, e, path, nl, nr from ch",
    "sfs_flag_summary": _CHOSEN + """, sd as (select rid, s, e, count(distinct side) as n from an group by 1, 2, 3)
        select cast(case when coalesce(sd.n, 0) < 2 then 1 when ch.path is null then 2 else 0 end as int) as flag, count(*) as n from st left join sd using (rid, s, e) left join ch using (rid, s, e) group by 1""",
    "sfs_dedup": """with b as (select rname, s, min(s + l) as low, max(s + l) as top, arg_max(sfs_id, l * 10000000000 + sfs_id) as sfs_id, max(l) as l from sfs where flag = 0 and s >= 0 and l > 0 and rname is not null group by 1, 2),
        p as (select *, lag(top) over (partition by rname order by s) as prev from b) select rname, sfs_id, s, l from p where not coalesce(low = top and prev = top, false)""",
    "cluster_by_anchor": """with g as (select skmer, ekmer, count(*) as n, cast(sum(l) as bigint) as bases from sfs where flag = 0 and skmer is not null and ekmer is not null group by 1, 2),
        r as (select *, row_number() over (order by skmer, ekmer) - 1 as cidx from g) select * from r where n <= 64""",
    "kmer5_profile_canberra": """with r as (select cluster_id, cp_id, kcounts from cand_paths where len(kcounts) = 1024 and cluster_id is not null), f as (select cluster_id, min(cp_id) as cp_id from r group by 1),
        t as (select r.cluster_id, r.cp_id, r.kcounts as k from r join f using (cluster_id, cp_id)),
        d as (select r.cluster_id, r.cp_id, list_sum(list_transform(list_zip(r.kcounts, t.k), lambda z: case when z[1] + z[2] > 0 then abs(z[1] - z[2])::double / (z[1] + z[2]) else 0.0 end)) as dist from r join t on r.cluster_id = t.cluster_id and r.cp_id <> t.cp_id)
        select cluster_id, cp_id, round(dist, 6) as dist from (select *, row_number() over (partition by cluster_id order by dist, cp_id) as n from d) where n = 1""",
    "kmer5_profiles": """with p as (select cp_id, upper(sequence) as t, unnest(range(1, length(sequence) - 3)) as i from cand_paths where length(sequence) >= 5), k as (select cp_id, substr(t, i, 5) as w from p)
        select least(w, reverse(translate(w, 'ACGT', 'TGCA'))) as kmer, count(*) as n, count(distinct cp_id) as records from k where regexp_full_match(w, '[ACGT]+') group by 1""",
    "sam_projection": with_("panel", "steps") + """, o as (select path, vid, max(off) as off from (select path, vid, sum(len) over (partition by path order by step) - len as off from steps join panel using (vid) where steps.is_ref) group by 1, 2),
        m as (select sfs_id, plain_seq as q, a.path, a.off + soff as st, b.off + eoff + 1 as en, row_number() over (partition by sfs_id order by a.path) as r from sfs join o a on a.vid = sv join o b on b.vid = ev and b.path = a.path
              where flag = 0 and soff is not null and eoff is not null and length(plain_seq) >= 22),
        x as (select *, en - st - 22 as gap from m where r = 1)
        select path as contig, sfs_id || '.a1' as qname, 0 as flag, cast(st - 9 as bigint) as pos, '11M' as cigar, left(q, 11) as seq from x where st > en
        union all select path, sfs_id || '.a2', 0, cast(en as bigint), '11M', right(q, 11) from x where st > en
        union all select path, sfs_id::varchar, 0, cast(st + 1 as bigint), case when gap > 0 then '11M' || gap || 'N11M' else (gap + 22) || 'M' end, case when gap > 0 then left(q, 11) else left(q, greatest(11 + gap, 0)::bigint) end || right(q, 11) from x where st <= en""",
    "best_alignment_a": _rule("cov desc, nm, aln_id", "cov is not null", "query, cov, nm"),
    "best_alignment_b": _rule("cov desc, nm, aln_id", "cov >= 0.9", "query, cov, nm"),
    "best_alignment_c": _rule("cov desc, nm, aln_id", "cov >= 0.9", _ALL),
    "best_alignment_d": _rule("nm, aln_id desc", "cov >= 0.9", _ALL),
    "best_alignment_e": _rule("cov desc, aln_id", "cov > 0", _ALL),
    "best_alignment_f": _rule("matches / cigar_len desc, aln_id", "cov >= 0.9 and cigar_len > 0", _ALL),
    "aln_gain_classes": with_("alns") + """, r as (select *, row_number() over (partition by tool, query order by cov desc, nm, aln_id) as r from alns where cov >= 0.9), a as (select query, nm from r where r = 1 and tool = 'graphwalk'), b as (select query, nm from r where r = 1 and tool = 'seedchain')
        select case when a.query is null then 'new only' when b.query is null then 'lost' when b.nm < a.nm then 'better' when b.nm > a.nm then 'worse' else 'no gain' end as class, count(*) as n from a full join b on a.query = b.query group by 1""",
    "only_in_augmented": with_("alns") + "select query from alns where tool = 'seedchain' except select query from alns where tool = 'graphwalk'",
    "in_both": with_("alns") + "select query from alns where tool = 'seedchain' intersect select query from alns where tool = 'graphwalk'",
    "identity_filter": with_("alns") + "select aln_id, round(matches / cigar_len, 6) as identity from alns where cigar_len > 0 and matches / cigar_len >= 0.95",
    "all_tools_by_query": with_("alns") + """, w as (select query, min(nm) filter (where tool = 'graphwalk') as graphwalk, min(nm) filter (where tool = 'seedchain') as seedchain, min(nm) filter (where tool = 'polish') as polish, min(nm) filter (where tool = 'sketchmap') as sketchmap from alns group by query)
        select * from w where (graphwalk is not null)::int + (seedchain is not null)::int + (polish is not null)::int + (sketchmap is not null)::int >= 2""",
    "interval_overlap_label": _REG + " select a.event_id, count(j.event_id) as overlaps from a left join j on j.event_id = a.event_id group by 1",
    "interval_overlap_fraction": _REG + " select distinct event_id from j where (least(e, be) - greatest(s, bs)) * 100 >= (e - s) * 33",
    "interval_merge_union": with_("bed") + ", l as (select * from bed where e - s > 1000), " + _merge("l", ">") + " select chrom, s, e from u",
    "interval_depth": with_("bed") + """, p as (select chrom, s as p, 1 as v from bed union all select chrom, e, -1 from bed), q as (select chrom, p, sum(v) as v from p group by 1, 2),
        t as (select chrom, p as s, cast(sum(v) over (partition by chrom order by p) as bigint) as depth, lead(p) over (partition by chrom order by p) as e from q) select chrom, s, e, depth from t where depth > 0""",
    "gap_statistics": with_("bed") + """, d as (select chrom as key, s - lag(e) over (partition by chrom order by s, event_id) as d from bed)
        select key, count(*) filter (where d < 0) as overlapping, count(*) filter (where d = 0) as consecutive, count(*) filter (where d > 0) as gaps, cast(sum(case when d > 600 then d else 0 end) as bigint) as uncovered, count(*) filter (where d > 0 and d <= 100) as close
        from d where d is not null group by key""",
    "covered_share": with_("bed") + ", " + _merge("bed", ">=") + ", z as (select chrom, max(e) - min(s) as size from bed group by 1) select z.chrom as key, cast(sum(u.e - u.s) as bigint) as covered, round(sum(u.e - u.s) / any_value(size), 6) as share from z left join u using (chrom) group by 1",
    "anchoring_categories": """with g as (select aln_id, aligner, regexp_extract_all(path, '[<>]([^<>]+)', 1) as w, qs, qe, qlen from gaf where path is not null and qs is not null and qe is not null and qlen is not null),
        t as (select sfs_id, aligner, gfa_sv as v1, gfa_ev as v2, case when qs > 0 then '~' else w[1] end as t1, case when qe < qlen then '~' else w[-1] end as t2 from g join sfs on sfs_id = aln_id where len(w) > 0 and flag = 0 and gfa_sv is not null and gfa_ev is not null),
        k as (select *, len(list_intersect([v1, v2], [t1, t2])) as n from t),
        c as (select aligner, case when (v1 = t1 and v2 = t2) or (v1 = t2 and v2 = t1) then 'GOOD' when t1 = '~' or t2 = '~' then case when t1 = t2 then 'FULL_CLIP' when n = 1 then 'HALF_CLIP' else 'BAD_CLIP' end when n = 1 then 'HALF_BAD' else 'BAD' end as x from k)
        select aligner, count(*) filter (where x = 'GOOD') as GOOD, count(*) filter (where x = 'HALF_BAD') as HALF_BAD, count(*) filter (where x = 'BAD') as BAD, count(*) filter (where x = 'FULL_CLIP') as FULL_CLIP,
        count(*) filter (where x = 'HALF_CLIP') as HALF_CLIP, count(*) filter (where x = 'BAD_CLIP') as BAD_CLIP, count(*) as total from c group by aligner""",
    "vertex_support_quality": _SUPP + "select vid, l, supp, round(qual, 6) as qual from vs",
    "precision_table": _SUPP + """select vid % 3 as part, count(*) filter (where supp > 0) as supported, count(*) as total, round(count(*) filter (where supp > 0) / count(*), 6) as p_vertices, round(sum(case when qual = -1 then 0 else qual end * l), 4) as supported_bases,
        cast(sum(l) as bigint) as total_bases, round(sum(case when qual = -1 then 0 else qual end * l) / sum(l), 6) as p_bases from vs group by 1""",
    "recall_table": with_("alns") + "select tool, count(*) filter (where nm = 0) as perfect, count(*) as alignments, round(avg((nm = 0)::int), 6) as recall from alns group by tool",
    "support_histogram": _SUPP + "select supp, count(*) as n from vs group by supp",
    "cigar_expand_counts": f"with {_CIG}, s as (select aln_id, sum(n) filter (where op = 'M') as m, sum(n) filter (where op = '=') as eq, sum(n) filter (where op = 'X') as x, sum(n) filter (where op = 'I') as i, sum(n) filter (where op = 'D') as d, sum(n) as t from ci group by 1) "
    "select g.aln_id, cast(coalesce(m, 0) as bigint) as m, cast(coalesce(eq, 0) as bigint) as eq, cast(coalesce(x, 0) as bigint) as x, cast(coalesce(i, 0) as bigint) as i, cast(coalesce(d, 0) as bigint) as d, cast(coalesce(t, 0) as bigint) as expanded from gaf g left join s on s.aln_id = g.aln_id where cigar is not null",
    "errors_added_ratio": f"with {_CIG}, s as (select aligner, sum(case when op in ('X', 'I', 'D') then n else 0 end) as errors, sum(case when op in ('M', '=', 'X', 'I') then n else 0 end) as added from ci where aligner is not null group by 1) select aligner, cast(errors as bigint) as errors, cast(added as bigint) as added, round(errors / added, 6) as ratio from s",
    "homopolymer_indels": _SUPP[: _SUPP.index("pt as")].rstrip().rstrip(",") + """,
        rf as (select aln_id, string_agg(case when rev then reverse(translate(upper(seq), 'ACGT', 'TGCA')) else upper(seq) end, '' order by step) as ref from walks join segments using (id) where seq is not null and seq not in ('', '*', '.') group by 1),
        z as (select op.aln_id, i, op, l as len, substr(ref, p::bigint + 1) as rest from op join rf using (aln_id) where op in ('I', 'D') and l <= 3)
        select aln_id, i, op, len from z where length(rest) - length(ltrim(rest, left(rest, 1))) > 3""",
    "nm_pivot_improved": with_("alns") + """, w as (select query, min(least(nm, 10)) filter (where tool = 'graphwalk') as graphwalk, min(least(nm, 10)) filter (where tool = 'seedchain') as seedchain from alns group by query), k as (select * from w where graphwalk is not null and seedchain is not null)
        select query, 'graphwalk' as tool, graphwalk as nm from k union all select query, 'seedchain', seedchain from k""",
    "nm_delta_histogram": with_("alns") + """, w as (select query, min(nm) filter (where tool = 'graphwalk') as g, min(nm) filter (where tool = 'seedchain') as s from alns group by query), c as (select greatest(least(g - s, 8), -8) as delta, count(*) as n from w where g is not null and s is not null group by 1)
        select r.delta, coalesce(n, 0) as n from range(-8, 9) r(delta) left join c on c.delta = r.delta""",
    "percentile_summary": with_("alns") + "select tool, count(nm) as n, round(avg(nm), 6) as mean, round(stddev_samp(nm), 6) as std, min(nm) as least, max(nm) as greatest, " + ", ".join(f"round(quantile_cont(nm, {p}), 6) as p{round(p * 100):02d}" for p in (0.1, 0.25, 0.5, 0.75, 0.9, 0.99)) + ", round(avg((nm > 5)::int), 6) as above from alns group by tool",
    "cumulative_nm": with_("alns") + ", c as (select tool, nm, count(*) as n from alns group by 1, 2) select tool, nm, n, cast(sum(n) over (partition by tool order by nm) as bigint) as total from c",
    "dedup_records": "select min(sfs_id) as sfs_id, rname, s, count(*) as copies from sfs where plain_seq is not null group by rname, s, upper(plain_seq) having count(*) > 1",
    "name_translate": "select aln_id, trust_rank from gaf join aligners using (aligner)",
    "name_filter": "select sfs_id, coalesce(rname in (select rname from sfs where batch_id = 0 and rname is not null), false) as listed from sfs",
    "read_sample": with_("reads") + "select rid, length(seq) as l from reads where left(md5('42-' || rid), 8) < '1999999a'",
    "sample_choice": "select distinct cluster_id from cand_paths where cluster_id is not null order by left(md5('23-' || cluster_id), 8), cluster_id limit 8",
    "union_tables": "select 'sfs' as src, sfs_id as id, length(plain_seq) as l from sfs where plain_seq is not null union all select 'cand_paths', cp_id, length(sequence) from cand_paths where sequence is not null",
}
