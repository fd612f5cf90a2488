"""The test tables seen as reads, panel, graph, alignments and intervals; the same views as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.seqexpr import handle_id, handle_rev, walk
from .tables import table

#: Letters of a k-mer in these queries.
K = 11


def reads(spark, d):
    return table(spark, d, "sfs").where("plain_seq is not null and plain_seq not in ('', '.')").select(F.col("sfs_id").alias("rid"), F.upper("plain_seq").alias("seq"))


def panel(spark, d):
    seqs = table(spark, d, "segments").where("seq is not null and seq not in ('', '*', '.')")
    return seqs.select("vid", F.upper("seq").alias("seq"), (F.col("vid") % 5 == 0).alias("is_ref"))


def segments(spark, d):
    return panel(spark, d).select("vid", "seq", F.length("seq").cast("bigint").alias("len"))


def paths(spark, d):
    rows = table(spark, d, "cand_paths").where("vertices is not null")
    return rows.select(F.col("cp_id").alias("path"), F.col("cluster_id").alias("sample"), (F.col("cp_id") % 10 == 0).alias("is_ref"), (F.col("cp_id") % 3 == 0).alias("consensus"))


def steps(spark, d):
    rows = table(spark, d, "cand_paths").where("vertices is not null").select(F.col("cp_id").alias("path"), (F.col("cp_id") % 10 == 0).alias("is_ref"), (F.col("cp_id") % 3 == 0).alias("consensus"), F.posexplode("vertices").alias("step", "h"))
    return rows.where("h is not null").select("path", "is_ref", "consensus", "step", "h", handle_id(F.col("h")).alias("vid"), handle_rev(F.col("h")).alias("rev"))


def support(spark, d):
    """Consensus path and the reads it was made from."""
    gaf = table(spark, d, "gaf").select("aln_id", F.explode(F.split(F.col("tags")["rs"], "[|]")).alias("read"))
    return gaf.select((F.col("aln_id") % 500 + 1).alias("path"), "read").where("read <> ''").distinct()


def alns(spark, d):
    rows = table(spark, d, "gaf").where("name is not null and qlen > 0 and nm >= 0 and aligner is not null")
    q = F.lower(F.regexp_extract("name", "^[ \\t]*([^ \\t]*)", 1))
    return rows.select("aln_id", q.alias("query"), "path", F.round((F.col("qe") - F.col("qs")) / F.col("qlen"), 3).alias("cov"), F.col("nm").cast("bigint").alias("nm"), F.col("aligner").alias("tool"), "matches", "cigar_len", "plen", "cigar")


def walks(spark, d):
    return table(spark, d, "gaf").where("path is not null").select("aln_id", F.posexplode(walk(F.col("path"))).alias("step", "x")).select("aln_id", "step", F.col("x.id").alias("id"), F.col("x.rev").alias("rev"))


def bed(spark, d):
    rows = table(spark, d, "events").where("value is not null")
    start = F.unix_seconds(F.col("ts").cast("timestamp"))
    return rows.select("event_id", F.col("event_type").alias("chrom"), start.alias("s"), (start + F.col("value").cast("bigint") * 60 + 1).alias("e"))


SQL = {
    "reads": "reads as (select sfs_id as rid, upper(plain_seq) as seq from sfs where plain_seq is not null and plain_seq not in ('', '.'))",
    "panel": "panel as (select vid, upper(seq) as seq, vid % 5 = 0 as is_ref, length(seq) as len from segments where seq is not null and seq not in ('', '*', '.'))",
    "paths": "paths as (select cp_id as path, cluster_id as sample, cp_id % 10 = 0 as is_ref, cp_id % 3 = 0 as consensus from cand_paths where vertices is not null)",
    "steps": """steps as (select path, is_ref, consensus, step, h, h >> 1 as vid, h % 2 = 1 as rev from (select cp_id as path, cp_id % 10 = 0 as is_ref, cp_id % 3 = 0 as consensus,
        unnest(vertices) as h, generate_subscripts(vertices, 1) - 1 as step from cand_paths where vertices is not null) where h is not null)""",
    "support": "support as (select distinct path, read from (select aln_id % 500 + 1 as path, unnest(string_split(tags['rs'], '|')) as read from gaf) where read <> '')",
    "alns": """alns as (select aln_id, lower(regexp_extract(name, '^[ \\t]*([^ \\t]*)', 1)) as query, path, round((qe - qs) / qlen, 3) as cov, cast(nm as bigint) as nm, aligner as tool,
        matches, cigar_len, plen, cigar from gaf where name is not null and qlen > 0 and nm >= 0 and aligner is not null)""",
    "walks": """walks as (select aln_id, step, substr(x, 2) as id, x like '<%' as rev from (select aln_id, unnest(regexp_extract_all(path, '[<>][^<>]+')) as x,
        generate_subscripts(regexp_extract_all(path, '[<>][^<>]+'), 1) - 1 as step from gaf where path is not null))""",
    "bed": "bed as (select event_id, event_type as chrom, floor(epoch(ts))::bigint as s, floor(epoch(ts))::bigint + trunc(value)::bigint * 60 + 1 as e from events where value is not null)",
    "rk": f"rk0 as (select rid, seq, unnest(range(1, length(seq) - {K - 2})) as i from reads where length(seq) >= {K}), rk1 as (select rid, i - 1 as pos, substr(seq, i, {K}) as w from rk0), rk as (select rid, pos, least(w, reverse(translate(w, 'ACGT', 'TGCA'))) as kmer from rk1 where regexp_full_match(w, '[ACGT]+'))",
    "pk": f"""pk0 as (select vid, is_ref, seq, unnest(range(1, length(seq) - {K - 2})) as i from panel where length(seq) >= {K}), pk1 as (select vid, is_ref, i - 1 as pos, substr(seq, i, {K}) as w from pk0),
        pk as (select vid, is_ref, pos, least(w, reverse(translate(w, 'ACGT', 'TGCA'))) as kmer, reverse(translate(w, 'ACGT', 'TGCA')) < w as rev from pk1 where regexp_full_match(w, '[ACGT]+')),
        uk as (select kmer, min(vid) as vid, min(pos) as pos, bool_or(rev) as rev, bool_or(is_ref) as is_ref from pk group by kmer having count(*) = 1)""",
    "hit": "hit as (select rk.rid, rk.pos, rk.kmer, uk.kmer is not null as hit from rk left join uk on rk.kmer = uk.kmer)",
}


def with_(*names: str) -> str:
    return "with " + ", ".join(SQL[n] for n in names) + " "
