"""The whole way from a graph and reads to an augmented graph, as functions on DataFrames.

graph: segments (vid, id, seq) and steps (path, step, vid, rev, is_ref, consensus, h); reads (rname, seq).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.seqexpr import handle_id, pack_handle, reverse_complement
from ..operators import align as A
from ..operators import anchoring as N
from ..operators import augment as U
from ..operators import graph as G
from ..operators import search, sketch
from ..operators.ranks import dense_index


def graph_tables(parts: dict[str, DataFrame], reference: str, consensus: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Segments and steps with numeric vertices from what ``read_gfa`` gives."""
    from ..sources.readers import gfa_steps

    named = dense_index(parts["segments"].select("id", "seq"), ["id"], "vid")
    segments = cut(named.select("vid", "id", F.upper("seq").alias("seq"), F.length("seq").cast("bigint").alias("len")))
    steps = gfa_steps(parts, reference, consensus).join(segments.select("id", "vid"), "id")
    return segments, cut(steps.select("path", "step", "vid", "rev", "is_ref", "consensus", pack_handle(F.col("vid"), F.col("rev")).alias("h")))


def build_sketch(segments: DataFrame, steps: DataFrame, k: int, density: float = 1.0, edges: bool = True, reference_only: bool = False) -> DataFrame:
    """(kmer, vid, pos, rev, is_ref, has_both, spans_edge): k-mers at one place of the graph.

    Those within vertices have their place on the forward strand; with ``edges`` the ones across
    an edge count for uniqueness, and come out with the vertex they begin on."""
    ref = steps.where("is_ref").select("vid").distinct().withColumn("ref", F.lit(True))
    inside = sketch.location_kmers(segments.join(ref, "vid", "left").select("vid", "seq", F.coalesce("ref", F.lit(False)).alias("is_ref")), k, density)
    occ = inside.select("kmer", "rev", "is_ref", "vid", "pos", F.lit(False).alias("spans_edge"))
    if edges:
        along = sketch.path_kmers(steps, segments, k).where(handle_id(F.col("v1")) != handle_id(F.col("v2")))
        # the lower end gives the place, so both strands have one
        low = handle_id(F.col("v1")) <= handle_id(F.col("v2"))
        occ = occ.unionByName(
            along.select("kmer", "rev", "is_ref", F.when(low, handle_id(F.col("v1"))).otherwise(handle_id(F.col("v2"))).alias("vid"), F.when(low, F.col("pos1")).otherwise(F.col("pos2")).cast("int").alias("pos"), F.lit(True).alias("spans_edge"))
        )
    found = sketch.unique_kmers(occ, ["vid", "pos", "spans_edge"])
    return found.where("is_ref") if reference_only else found


def specific_strings(reads: DataFrame, segments: DataFrame, steps: DataFrame, table: DataFrame, k: int, anchors: int = 20, longest: int | None = None, guard: int = 20_000) -> DataFrame:
    """SFS rows: strings of reads that no path spells, widened to the nearest anchors on the best path.

    ``longest`` bounds the absent substrings, which then are found by joins with all words of the panel; without it nothing is bounded.
    Flags: 0 anchored, 1 no anchors on a side, 2 no common path, 3 no path within ``guard`` bases."""
    panel = U.spelled(segments.select(F.col("vid").cast("string").alias("id"), "seq"), steps.select("path", "step", F.col("vid").cast("string").alias("id"), "rev"))
    absent = search.minimal_absent(reads, panel, "rname", "seq", longest) if longest else search.minimal_absent_whole(reads, panel, "rname", "seq")
    strings = cut(search.assemble(absent, "rname").select("rname", "s", (F.col("s") + F.col("l")).alias("e")))
    inner = table.where("not spans_edge")
    hits = sketch.hits(reads, inner, "rname", "seq", k)
    once = hits.where("hit").join(hits.groupBy("rname", "kmer").agg(F.count(F.lit(1)).alias("c")).where("c = 1").select("rname", "kmer"), ["rname", "kmer"], "left_semi")
    usable = once.join(inner.select("kmer", "vid", F.col("pos").alias("vpos")), "kmer").select("rname", "pos", "kmer", "vid", "vpos")
    near = cut(N.nearest_anchors(strings, usable, "rname", k, anchors))
    chosen = cut(N.best_paths(near, steps.select("vid", "path").distinct(), "rname"))
    on = ["rname", "s", "e"]
    placed = near.join(chosen.select(*on, "path"), on).join(steps.select("path", "vid").distinct(), ["path", "vid"])
    first = lambda side: placed.where(F.col("side") == side).groupBy(*on, "path").agg(F.min(F.struct("r", "pos", "kmer", "vid", "vpos")).alias(side))
    ends = first("left").join(first("right"), [*on, "path"])
    offs = G.bp_offsets(steps, segments).groupBy("path", "vid").agg(F.min("off").alias("off"))
    a, b = (offs.select("path", F.col("vid").alias(f"{x}_vid"), F.col("off").alias(f"{x}_off")) for x in "lr")
    ends = ends.withColumns({"l_vid": F.col("left.vid"), "r_vid": F.col("right.vid")}).join(a, ["path", "l_vid"]).join(b, ["path", "r_vid"])
    apart = F.abs((F.col("r_off") + F.col("right.vpos")) - (F.col("l_off") + F.col("left.vpos")))
    ends = ends.withColumn("far", apart > guard)
    state = N.flags(strings, near, chosen, "rname").join(ends, on, "left")
    flag = F.when((F.col("flag") == 0) & (F.col("far").isNull() | F.col("far")), 3).otherwise(F.col("flag"))
    good = flag == 0
    s, e = F.when(good, F.col("left.pos")).otherwise(F.col("s")), F.when(good, F.col("right.pos") + k).otherwise(F.col("e"))
    rows = state.select(
        flag.alias("flag"), "rname", s.cast("int").alias("s"), (e - s).cast("int").alias("l"), e.cast("int").alias("e"), F.when(good, F.col("l_vid")).alias("sv"), F.when(good, F.col("r_vid")).alias("ev"),
        F.when(good, F.col("left.vpos")).alias("soff"), F.when(good, F.col("right.vpos") + k - 1).alias("eoff"), F.when(good, F.col("left.kmer")).alias("skmer"), F.when(good, F.col("right.kmer")).alias("ekmer"), F.when(good, F.col("path")).alias("path"),
    )
    whole = reads.select("rname", F.col("seq").alias("whole"))
    return rows.join(whole, "rname").withColumn("seq", F.substr(F.col("whole"), F.col("s") + 1, F.col("l"))).drop("whole")


def align_strings(strings: DataFrame, segments: DataFrame, steps: DataFrame, most: int = 64, longest: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(alignments, walks): consensus of each cluster of anchored strings against the stretch of path between its anchors.

    alignments: (name, cigar, ps, seq, walk, reads...), with =, X, I, D operations."""
    good = strings.where("flag = 0")
    # one strand for all strings of a pair of anchors
    turned = good.where("skmer > ekmer")
    same = good.where("skmer <= ekmer").select("rname", "skmer", "ekmer", "sv", "ev", "path", "seq").unionByName(
        turned.select("rname", F.col("ekmer").alias("skmer"), F.col("skmer").alias("ekmer"), F.col("ev").alias("sv"), F.col("sv").alias("ev"), "path", reverse_complement(F.col("seq")).alias("seq"))
    )
    small = same.groupBy("skmer", "ekmer").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("path", "sv", "ev")).alias("low")).where(F.col("n") <= most)
    lists = same.join(small.select("skmer", "ekmer"), ["skmer", "ekmer"]).groupBy("skmer", "ekmer").agg(F.array_sort(F.collect_list("seq")).alias("seqs"), F.array_sort(F.collect_set("rname")).alias("reads"))
    voted = lists.select("skmer", "ekmer", "reads", F.posexplode(A.cluster_consensus("seqs")).alias("i", "cons")).join(small.select("skmer", "ekmer", "low.*"), ["skmer", "ekmer"])
    named = cut(dense_index(voted, ["skmer", "ekmer", "i"], "no", 0).withColumn("name", F.concat(F.lit("cns-"), F.col("no").cast("string"))))
    # the stretch of the path from one anchor vertex to the other, in the order of the path
    at = steps.groupBy("path", "vid").agg(F.min("step").alias("at"))
    ends = named.join(at.select("path", F.col("vid").alias("sv"), F.col("at").alias("s1")), ["path", "sv"]).join(at.select("path", F.col("vid").alias("ev"), F.col("at").alias("s2")), ["path", "ev"])
    ends = ends.select("name", "path", "cons", "reads", F.least("s1", "s2").alias("lo"), F.greatest("s1", "s2").alias("hi"))
    walks = ends.join(steps.select("path", "step", "vid", "rev"), "path").where("step between lo and hi").select("name", (F.col("step") - F.col("lo")).alias("step"), F.col("vid").cast("string").alias("id"), "rev")
    walks = cut(walks)
    stretch = U.spelled(segments.select(F.col("vid").cast("string").alias("id"), "seq"), walks.withColumnRenamed("name", "path")).select(F.col("path").alias("name"), F.col("seq").alias("target"))
    met = ends.join(stretch, "name").where(F.length("target") <= longest)
    # a consensus may run against its path; the better score tells
    both = met.withColumn("f", A.aligned("cons", "target")).withColumn("rc", reverse_complement(F.col("cons"))).withColumn("b", A.aligned("rc", "target"))
    forward = F.col("f.score") >= F.col("b.score")
    best = both.select("name", "reads", F.when(forward, F.col("cons")).otherwise(F.col("rc")).alias("seq"), F.when(forward, F.col("f")).otherwise(F.col("b")).alias("a"))
    whole = A.cs_to_cigar(F.col("a.cs"))
    # deletions at the ends are what lies outside the anchors on their vertices
    lead = F.coalesce(F.regexp_extract(whole, "^([0-9]+)D", 1).try_cast("bigint"), F.lit(0))
    trimmed = F.regexp_replace(F.regexp_replace(whole, "^[0-9]+D", ""), "(?<![0-9])[0-9]+D\\z", "")
    out = best.select("name", "reads", "seq", trimmed.alias("cigar"), lead.alias("ps"), F.col("a.score").alias("score"), F.col("a.matches").alias("matches"), F.col("a.nm").alias("nm"))
    return out.where(A.anchored_ends(F.regexp_replace("cigar", "X", "M"))), walks


def augment_graph(segments: DataFrame, steps: DataFrame, alignments: DataFrame, walks: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """(segments, steps) of the augmented graph, with numbers as ids: embedded, filtered by support, put together, numbered."""
    own = steps.select("path", "step", F.col("vid").cast("string").alias("id"), "rev")
    segs, all_steps = U.embed(segments.select(F.col("vid").cast("string").alias("id"), "seq"), own, alignments.select("name", "cigar", "ps", "seq"), walks)
    segs, all_steps = cut(segs), cut(all_steps)
    support = alignments.select(F.col("name").alias("path"), F.explode("reads").alias("read"))
    segs, all_steps = U.supported(segs, all_steps, support, "cns-", least)
    segs, all_steps = U.unchopped(cut(segs), cut(all_steps))
    return U.numbered(cut(segs), cut(all_steps))
