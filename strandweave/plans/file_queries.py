"""Files of each format, written from the test tables and read back: queries and SQL.

Files lie in the shared folder, in one of their own for each query."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import place
from ..functions.seqexpr import handle_id, handle_rev
from ..operators import augment as U
from ..operators import graph as G
from ..sources import readers as I
from ..sources import writers as O
from . import standins as V
from .standins import with_
from .tables import table


def _segments(spark, d):
    """Segments with their tags, absent sequences as nulls."""
    seq = F.when(~F.col("seq").isin("", "*", "."), F.col("seq"))
    return table(spark, d, "segments").select("id", seq.alias("seq"), F.coalesce("tags", F.map_from_arrays(F.array(), F.array()).cast("map<string,string>")).alias("tags"))


def file_fasta(spark, d):
    """Panel sequences through a FASTA file."""
    path = place(spark)
    O.write_lines(O.fasta_lines(V.panel(spark, d).select(F.col("vid").cast("string").alias("name"), "seq")), path)
    return I.read_fasta(spark, path).select("name", "seq")


def file_fastq(spark, d):
    """Reads without unknown letters through a compressed FASTQ file, with the lowest quality for each letter."""
    path = place(spark)
    rows = V.reads(spark, d).select(F.col("rid").cast("string").alias("name"), "seq", F.lit(None).cast("string").alias("qual"))
    O.write_lines(O.fastq_lines(O.without_n(rows)), path, compression="gzip")
    return I.read_fastx(spark, f"{path}/part-*").select("name", "seq", "qual")


def _graph(spark, d):
    path = place(spark)
    s = V.steps(spark, d)
    names = table(spark, d, "segments").select("vid", "id")
    named = s.join(names, "vid").select("path", "step", "id", "rev", "consensus")
    walk = named.groupBy("path", "consensus").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "id", "rev"))), lambda x: F.struct(x["id"].alias("id"), x["rev"].alias("rev"))).alias("w"))
    walks = walk.where("not consensus").select(F.concat(F.lit("h"), F.col("path").cast("string")).alias("sample"), F.lit(0).alias("hap"), F.lit("c").alias("contig"), F.lit(0).cast("bigint").alias("start"), F.size("w").cast("bigint").alias("end"), F.col("w").alias("walk"))
    paths = walk.where("consensus").select(F.concat(F.lit("cns-"), F.col("path").cast("string")).alias("name"), F.col("w").alias("steps"), F.lit(None).cast("string").alias("overlaps"))
    O.write_gfa(path, _segments(spark, d), U.links(named), walks, paths)
    return I.read_gfa(spark, path)


def file_gfa_segments(spark, d):
    """Segments through a GFA file, with their number of tags."""
    return _graph(spark, d)["segments"].select("id", "seq", F.size("tags").alias("n_tags"))


def file_gfa_links(spark, d):
    return _graph(spark, d)["links"]


def file_gfa_steps(spark, d):
    """Walks and paths through a GFA file."""
    return I.gfa_steps(_graph(spark, d), "h10", "cns-").select("path", F.col("step").cast("bigint").alias("step"), "id", "rev", "is_ref", "consensus")


def file_gfa_to_fasta(spark, d):
    """Segments of a GFA file as FASTA; absent sequences are left out."""
    path = place(spark)
    O.write_lines(O.fasta_lines(_graph(spark, d)["segments"].where("seq is not null"), "id"), path)
    return I.read_fasta(spark, path).select("name", F.length("seq").cast("bigint").alias("l"))


def file_gfa_lines(spark, d):
    """Lines of a GFA file by kind, segments without tags."""
    g = _graph(spark, d)
    bare = g["segments"].withColumn("tags", F.map_filter("tags", lambda k, v: F.lit(False)))
    rows = O.gfa_lines(bare, g["links"], g["walks"], g["paths"]).select(F.left("value", F.lit(1)).alias("kind"), F.size(F.split("value", "\t")).alias("fields"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max("fields").alias("fields"))


def file_sfs(spark, d):
    """Anchored specific strings through their table format."""
    path = place(spark)
    rows = table(spark, d, "sfs").withColumn("seq", F.col("plain_seq"))
    O.write_lines(O.sfs_lines(rows), path)
    return I.read_sfs(spark, path).select("flag", "rname", "s", "l", "e", "sv", "ev", "soff", "eoff", "gfa_sv", "gfa_ev", "skmer", "ekmer", F.concat_ws(",", F.transform("paths", lambda x: x.cast("string"))).alias("paths"), "seq")


def _gaf(spark, d):
    path = place(spark)
    rows = table(spark, d, "gaf").withColumn("qname", F.concat(F.lit("q"), F.col("aln_id").cast("string")))
    tags = F.map_concat(F.coalesce("tags", F.map_from_arrays(F.array(), F.array()).cast("map<string,string>")), F.map_from_arrays(F.array(F.lit("cg")), F.array(F.coalesce("cigar", F.lit("")))))
    O.write_lines(O.gaf_lines(rows.withColumn("tags", tags)), path)
    return I.read_gaf(spark, path)


def file_gaf(spark, d):
    """Alignments through a GAF file."""
    return _gaf(spark, d).select("qname", "qlen", "qs", "qe", "strand", "path", "plen", "ps", "pe", "matches", "cigar_len", "mapq", F.nullif(F.col("tags")["cg"], F.lit("")).alias("cigar"))


def file_gaf_support(spark, d):
    """Reads behind each alignment, from the GAF file."""
    return I.gaf_support(_gaf(spark, d)).groupBy("qname").agg(F.count(F.lit(1)).alias("reads"))


def file_gaf_retained(spark, d):
    """Alignments that walk a novel vertex, with these vertices, through a GAF file."""
    path = place(spark)
    names = table(spark, d, "segments").select("id", "vid")
    novel = G.novel_vertices(V.steps(spark, d)).select(handle_id(F.col("h")).alias("vid")).distinct().join(names, "vid").select("id")
    used = V.walks(spark, d).join(novel, "id").groupBy("aln_id").agg(F.array_sort(F.collect_set("id")).alias("vertices"))
    uses = used.select(F.concat(F.lit("q"), F.col("aln_id").cast("string")).alias("qname"), "vertices", F.array().cast("array<string>").alias("edges"))
    O.write_lines(O.gaf_lines(O.retained_gaf(_gaf(spark, d), uses)), path)
    return I.read_gaf(spark, path).select("qname", F.col("tags")["NV"].alias("vertices"))


def file_sam(spark, d):
    """Anchored strings on their reference paths through a SAM file, primary records only."""
    from .report_queries import sam_projection

    path = place(spark)
    contigs = G.path_lengths(V.steps(spark, d).where("is_ref"), V.segments(spark, d)).select(F.col("path").alias("contig"), F.col("bases").alias("length"))
    O.write_sam(path, sam_projection(spark, d), contigs)
    return I.read_sam(spark, path, primary_only=True).select("qname", "flag", F.col("rname").cast("bigint").alias("contig"), "pos", "cigar", "seq")


def file_bed(spark, d):
    """Intervals through a BED file, wider by 10 on both sides."""
    path = place(spark)
    O.write_lines(O.bed_lines(V.bed(spark, d).select("chrom", "s", "e", "event_id"), ("chrom", "s", "e", "event_id")), path)
    return I.read_bed(spark, path, 10).select("chrom", "s", "e", F.col("info").cast("bigint").alias("event_id"))


def file_fai(spark, d):
    """Lengths of segments through a sequence index."""
    path = place(spark)
    O.write_lines(O.table_lines(V.segments(spark, d).select(F.col("vid").cast("string"), "len")), path)
    return I.read_fai(spark, path)


def file_vcf(spark, d):
    """Replaced letters of two candidate sequences as records of a VCF file."""
    path = place(spark)
    rows = table(spark, d, "cand_paths").where("sequence is not null and cluster_id is not null").select(F.col("cluster_id").cast("string").alias("chrom"), F.col("cp_id").alias("pos"), F.lit(".").alias("id"), F.upper(F.left("sequence", F.lit(1))).alias("ref"), F.upper(F.right("sequence", F.lit(1))).alias("alt"))
    rows = rows.where("ref in ('A', 'C', 'G', 'T') and alt in ('A', 'C', 'G', 'T') and ref <> alt").select("*", *(F.lit(".").alias(c) for c in ("qual", "filter", "info")))
    O.write_lines(O.table_lines(rows), path)
    return I.read_vcf(spark, path).select("chrom", "pos", "ref", "alt")


def file_names(spark, d):
    """Names of segments and their numbers through a map of names."""
    path = place(spark)
    O.write_lines(table(spark, d, "segments").select(F.concat_ws(" ", "id", F.col("vid").cast("string")).alias("value")), path)
    return I.read_name_map(spark, path)


def file_list(spark, d):
    """Names of reads through a list."""
    path = place(spark)
    O.write_lines(table(spark, d, "sfs").where("rname is not null and trim(rname) <> ''").select(F.trim("rname").alias("value")), path)
    return I.read_list(spark, path)


def file_reports(spark, d):
    """A report of each aligner in a folder of its own, read together with the aligner's name from the path."""
    path = place(spark)
    counts = table(spark, d, "gaf").where("aligner is not null").groupBy("aligner", "mapq").agg(F.count(F.lit(1)).alias("n"))
    counts.write.option("header", True).partitionBy("aligner").csv(path)
    read = spark.read.schema("mapq int, n bigint").option("header", True).option("recursiveFileLookup", True).csv(path)
    return I.with_file_fields(read, "aligner=([^/]+)/", ["aligner"]).select("aligner", "mapq", "n")


def file_report(spark, d):
    """A table of a report with a header."""
    path = place(spark)
    O.write_report(table(spark, d, "aligners"), path)
    return I.read_report(spark, path, "aligner string, trust_rank int, version string")


def file_kan(spark, d):
    """Uncovered stretches of reads and missed k-mers of each read, through both tables of the coverage tool."""
    from .kmer_queries import kan_missed_per_read, kan_uncovered_intervals

    a, b = place(spark), place(spark)
    O.write_lines(O.bed_lines(kan_uncovered_intervals(spark, d).withColumnRenamed("rid", "chrom")), a)
    O.write_lines(O.table_lines(kan_missed_per_read(spark, d)), b)
    bed = I.read_bed(spark, a).groupBy("chrom").agg(F.count(F.lit(1)).alias("stretches"), F.sum(F.col("e") - F.col("s")).alias("bases"))
    missed = I.read_table(spark, b, "chrom string, missed bigint, n_kmers bigint")
    return missed.join(bed, "chrom", "left").select(F.col("chrom").cast("bigint").alias("rid"), "missed", "n_kmers", F.coalesce("stretches", F.lit(0)).alias("stretches"), F.coalesce("bases", F.lit(0)).alias("bases"))


def _stored(spark, d):
    s = table(spark, d, "sketch").where("sxs >= 0 and v1 is not null and v2 is not null and pos1 between 0 and 32767 and pos2 between 0 and 32767 and rev1 is not null and rev2 is not null and has_both is not null and is_ref is not null")
    return s.groupBy(F.col("sxs").alias("kmer")).agg(F.min(F.struct("row_id", "v1", "rev1", "v2", "rev2", "pos1", "pos2", "has_both", "is_ref")).alias("x")).select("kmer", "x.*").drop("row_id")


def file_sketch(spark, d):
    """The sketch through a table sorted by k-mer."""
    path = place(spark)
    O.write_sketch(_stored(spark, d), path)
    return spark.read.parquet(path)


def file_sketch_binary(spark, d):
    """The sketch through its binary layout."""
    path = place(spark)
    O.write_sketch_binary(_stored(spark, d), path, 21)
    return I.read_sketch_binary(spark, path)


def file_mapping_lines(spark, d):
    """Novel vertices as P lines with the consensus paths that walk them."""
    path = place(spark)
    s = V.steps(spark, d)
    walked = s.where("consensus").join(G.novel_vertices(s), "h").groupBy("h").agg(F.transform(F.array_sort(F.collect_set("path")), lambda x: x.cast("string")).alias("names"))
    steps = F.array(F.struct(handle_id(F.col("h")).cast("string").alias("id"), handle_rev(F.col("h")).alias("rev")))
    O.write_lines(O.mapping_lines(walked.select("h", "names", steps.alias("steps")), "nv-", ["h"]), path)
    rows = I.read_table(spark, path, "kind string, name string, steps string, overlaps string, names string")
    return rows.select("name", "steps", F.size(F.split("names", ",")).alias("n_names"))


QUERIES = {q.__name__: q for q in (
    file_fasta, file_fastq, file_gfa_segments, file_gfa_links, file_gfa_steps, file_gfa_to_fasta, file_gfa_lines, file_sfs, file_gaf, file_gaf_support, file_gaf_retained, file_sam, file_bed,
    file_fai, file_vcf, file_names, file_list, file_reports, file_report, file_kan, file_sketch, file_sketch_binary, file_mapping_lines,
)}

_LINKS = "lk as (select distinct a.id as v1, case when a.rev then '-' else '+' end as s1, b.id as v2, case when b.rev then '-' else '+' end as s2 from nm a join nm b on a.path = b.path and a.step + 1 = b.step)"
_NAMED = with_("steps") + ", nm as (select path, step, id, rev, consensus from steps join segments using (vid))"
_SEG = "case when seq not in ('', '*', '.') then seq end"
_OWN = "anchored as (select *, 0 as z from sfs where flag = 0)"
_POINT = lambda c: f"case when {c} not in ('', '.') then {c} end"
_STORED = """st as (select sxs as kmer, arg_min((v1, rev1, v2, rev2, pos1, pos2, has_both, is_ref), row_id) as x from sketch where sxs >= 0 and v1 is not null and v2 is not null and pos1 between 0 and 32767
    and pos2 between 0 and 32767 and rev1 is not null and rev2 is not null and has_both is not null and is_ref is not null group by sxs)
    select kmer, x[1] as v1, x[2] as rev1, x[3] as v2, x[4] as rev2, x[5] as pos1, x[6] as pos2, x[7] as has_both, x[8] as is_ref from st"""

SQL = {
    "file_fasta": with_("panel") + "select vid::varchar as name, seq from panel",
    "file_fastq": with_("reads") + "select rid::varchar as name, seq, repeat('!', length(seq)) as qual from reads where not contains(seq, 'N')",
    "file_gfa_segments": f"select id, {_SEG} as seq, coalesce(cardinality(tags), 0)::int as n_tags from segments",
    "file_gfa_links": _NAMED + f", {_LINKS} select v1, s1, v2, s2, '0M' as overlap from lk",
    "file_gfa_steps": _NAMED + """, n as (select *, row_number() over (partition by path order by step) - 1 as i from nm)
        select case when consensus then 'cns-' || path else 'h' || path || '#0#c#0' end as path, i as step, id, rev, not consensus and path = 10 as is_ref, consensus from n""",
    "file_gfa_to_fasta": "select id as name, length(seq) as l from segments where seq not in ('', '*', '.')",
    "file_gfa_lines": _NAMED + f""", {_LINKS} select 'H' as kind, 1 as n, 2 as fields union all select 'S', count(*), 3 from segments union all select 'L', count(*), 6 from lk
        union all select 'W', count(distinct path), 7 from nm where not consensus union all select 'P', count(distinct path), 4 from nm where consensus""",
    "file_sfs": f"select flag, {_POINT('rname')} as rname, s, l, e, sv, ev, soff, eoff, {_POINT('gfa_sv')} as gfa_sv, {_POINT('gfa_ev')} as gfa_ev, skmer, ekmer, coalesce(array_to_string(paths, ','), '') as paths, {_POINT('plain_seq')} as seq from sfs where flag = 0",
    "file_gaf": f"select 'q' || aln_id as qname, qlen, qs, qe, {_POINT('strand')} as strand, {_POINT('path')} as path, plen, ps, pe, matches, cigar_len, mapq, nullif(cigar, '') as cigar from gaf",
    "file_gaf_support": "with r as (select distinct aln_id, unnest(string_split(tags['rs'], '|')) as read from gaf) select 'q' || aln_id as qname, count(*) as reads from r where read <> '' group by aln_id",
    "file_gaf_retained": with_("steps", "walks") + """, nv as (select distinct h >> 1 as vid from (select h from steps where consensus except select h from steps where not consensus)),
        u as (select distinct aln_id, id from walks join segments using (id) join nv using (vid)) select 'q' || aln_id as qname, string_agg(id, ',' order by id) as vertices from u group by aln_id""",
    "file_bed": with_("bed") + "select chrom, greatest(s - 10, 0) as s, e + 10 as e, event_id from bed",
    "file_fai": with_("panel") + "select vid::varchar as chrom, len as length from panel",
    "file_vcf": """with v as (select cluster_id::varchar as chrom, cp_id as pos, upper(left(sequence, 1)) as ref, upper(right(sequence, 1)) as alt from cand_paths where sequence is not null and cluster_id is not null)
        select * from v where ref in ('A', 'C', 'G', 'T') and alt in ('A', 'C', 'G', 'T') and ref <> alt""",
    "file_names": "select id as short, vid::varchar as accession from segments",
    "file_list": "select distinct trim(rname) as name from sfs where rname is not null and trim(rname) <> ''",
    "file_reports": "select aligner, mapq, count(*) as n from gaf where aligner is not null group by 1, 2",
    "file_report": "select aligner, trust_rank, version from aligners",
    "file_sketch": "with " + _STORED,
    "file_sketch_binary": "with " + _STORED,
    "file_mapping_lines": with_("steps") + """, nv as (select h from steps where consensus except select h from steps where not consensus), w as (select h, count(distinct path) as n from steps join nv using (h) where consensus group by h),
        i as (select *, row_number() over (order by h) - 1 as i from w) select 'nv-' || i as name, (h >> 1) || case when h % 2 = 1 then '-' else '+' end as steps, cast(n as int) as n_names from i""",
}


def _later() -> dict[str, str]:
    """SQL that is made of other queries' SQL."""
    from . import kmer_queries as Q
    from . import report_queries as R

    missed, gaps = Q.SQL["kan_missed_per_read"], Q.SQL["kan_uncovered_intervals"]
    return {
        "file_sam": f"select qname, flag, contig, pos, cigar, seq from ({R.SQL['sam_projection']})",
        "file_kan": f"select m.rid, missed, n_kmers, count(g.rid) as stretches, cast(coalesce(sum(g.e - g.s), 0) as bigint) as bases from ({missed}) m left join ({gaps}) g on g.rid = m.rid group by 1, 2, 3",
    }


SQL |= _later()
