"""k-mers, sketch, coverage and search: queries and SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import seqexpr as X
from ..functions.codes import kmer_codes
from ..operators import search, sketch
from . import standins as V
from .standins import K, with_
from .tables import table

#: Letters up to which the SQL of the search looks all starts up at once; only those that match so far are followed to their ends.
LONGEST = 12


def _named(df):
    """The k-mers as text."""
    return df.withColumn("kmer", X.decode(F.col("kmer"), K))


def kmer_canonical_counts(spark, d):
    """Canonical k-mers of all reads that occur at least twice."""
    return _named(kmer_codes(V.reads(spark, d), "seq", K, ["rid"]).groupBy("kmer").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))


def _sketch(spark, d):
    return sketch.unique_kmers(sketch.location_kmers(V.panel(spark, d), K), ["vid", "pos"])


def sketch_unique_kmers(spark, d):
    """k-mers at exactly one location of the panel."""
    return _named(_sketch(spark, d).select("kmer", "vid", "pos", "rev", "is_ref"))


def _path_sketch(spark, d):
    segs = V.segments(spark, d)
    occ = sketch.undirected(sketch.path_kmers(V.steps(spark, d), segs, K), segs)
    return sketch.unique_kmers(occ, ["v1", "pos1", "v2", "pos2"])


def sketch_path_kmers(spark, d):
    """k-mers at exactly one place along paths, whatever the strand they are walked on; those within a vertex, by vertex."""
    found = sketch.within_vertices(_path_sketch(spark, d))
    return found.groupBy("v1").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_ref").alias("n_ref"), F.count_if("has_both").alias("n_both"))


def sketch_edge_kmers(spark, d):
    """k-mers at exactly one place along paths that span an edge."""
    return _named(_path_sketch(spark, d).where("v1 <> v2").select("kmer", "v1", "pos1", "v2", "pos2", "is_ref", "has_both"))


def sketch_density_sample(spark, d):
    """A quarter of the sketch, by hash."""
    return _named(sketch.unique_kmers(sketch.location_kmers(V.panel(spark, d), K, 0.25), ["vid", "pos"]).select("kmer", "vid", "pos"))


def sketch_first_base_bins(spark, d):
    return sketch.first_base_bins(_sketch(spark, d), K)


def sketch_table_dump(spark, d):
    """The stored sketch as text: k-mer, positions, vertices and flags; the reference share by sketch is in the next query."""
    s = table(spark, d, "sketch").where("sxs is not null and sxs >= 0")
    side = lambda v, r: F.concat(F.when(F.col(r), "<").otherwise(">"), F.col(v).cast("string"))
    return s.select("row_id", X.decode(F.col("sxs"), 21).alias("kmer"), F.concat_ws(">", "pos1", "pos2").alias("pos"), F.concat(side("v1", "rev1"), side("v2", "rev2")).alias("vertices"), F.col("has_both").cast("int").alias("rc"), F.col("is_ref").cast("int").alias("ref"))


def sketch_ref_share(spark, d):
    s = table(spark, d, "sketch").where("sxs >= 0 and sketch_id is not null")
    return s.groupBy("sketch_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("is_ref").cast("double")), 6).alias("ref_share"))


def _hits(spark, d):
    return sketch.hits(V.reads(spark, d), _sketch(spark, d), "rid", "seq", K)


def kan_missed_per_read(spark, d):
    """k-mers of each read that the sketch lacks."""
    return sketch.missed_per_sequence(_hits(spark, d), "rid")


def kan_uncovered_intervals(spark, d):
    return sketch.uncovered(_hits(spark, d), "rid")


def kan_long_gaps(spark, d):
    return sketch.uncovered(_hits(spark, d), "rid").where("e - s > 40")


def sfs_unique_read_kmers(spark, d):
    """k-mers that occur once in their read and are in the sketch."""
    return _named(sketch.found_once(_hits(spark, d), "rid"))


def _absent(spark, d):
    return search.minimal_absent_whole(V.reads(spark, d), V.panel(spark, d), "rid", "seq")


def sfs_bounded(spark, d):
    """Shortest substrings of reads that the panel lacks, of any length: by length, with a checksum of their places."""
    return _absent(spark, d).groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("rid") % 1000) * (F.col("s") + 1)).alias("places"))


def sfs_assembled(spark, d):
    return search.assemble(_absent(spark, d), "rid")


def sfs_full(spark, d):
    """Shortest absent substrings of any length, by length."""
    return _absent(spark, d).groupBy("l").agg(F.count(F.lit(1)).alias("n"))


def revcomp_slices(spark, d):
    """Segments in slices of ten letters, the last one as long as is left, with their reverse complements."""
    at = F.explode(F.sequence(F.lit(0), F.length("seq") - 1, F.lit(10))).alias("at")
    s = V.panel(spark, d).where("length(seq) > 0").select("vid", "seq", at)
    part = F.substring("seq", F.col("at") + 1, F.lit(10))
    return s.select("vid", F.col("at").cast("bigint").alias("at"), part.alias("slice"), X.reverse_complement(part).alias("rc"), X.canonical(part).alias("canonical"))


def kmer_encode_decode(spark, d):
    """Codes of all words of 21 letters of segments, and back."""
    s = V.panel(spark, d).select("vid", F.posexplode(X.words(F.col("seq"), 21)).alias("pos", "w")).withColumn("code", X.encode(F.col("w"), 21))
    return s.where("code is not null").select("vid", F.col("pos").cast("bigint").alias("pos"), "code", X.decode(F.col("code"), 21).alias("word"))


def overlapping_windows(spark, d):
    """Segments cut into windows of 50 at steps of 25."""
    s = V.segments(spark, d).select("vid", "seq", F.inline(X.overlapping_windows(F.col("len"), 50)))
    return s.select("vid", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), F.substr(F.col("seq"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")).alias("piece"))


def homopolymer_runs(spark, d):
    """At every position of a segment, the length of the run from there on."""
    runs = F.regexp_extract_all("seq", F.lit("(.)\\1*"), F.lit(0))
    s = V.segments(spark, d).select("vid", F.flatten(F.transform(runs, lambda x: F.sequence(F.length(x), F.lit(1), F.lit(-1)))).alias("x"))
    return s.select("vid", F.posexplode("x").alias("at", "run")).select("vid", F.col("at").cast("bigint").alias("at"), F.col("run").cast("bigint").alias("run"))


def n_content(spark, d):
    """Unknown letters of each string and their share."""
    s = table(spark, d, "sfs").where("plain_seq is not null and plain_seq not in ('', '.')").withColumn("u", F.upper("plain_seq"))
    n = F.length("u") - F.length(F.replace("u", F.lit("N"), F.lit("")))
    return s.select("sfs_id", n.cast("bigint").alias("n"), F.round(n / F.length("u"), 6).alias("share")).where("n > 0")


QUERIES = {q.__name__: q for q in (
    sketch_unique_kmers, kmer_canonical_counts, sketch_path_kmers, sketch_edge_kmers, sketch_density_sample, sketch_first_base_bins, sketch_table_dump, sketch_ref_share, kan_missed_per_read,
    kan_uncovered_intervals, kan_long_gaps, sfs_unique_read_kmers, sfs_bounded, sfs_assembled, sfs_full, revcomp_slices, kmer_encode_decode, overlapping_windows, homopolymer_runs, n_content,
)}

# the hash of sampled k-mers in numbers of 128 bits; fixed values: its primes
_P = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
_MUL = lambda x, p: f"(({x}) * {p}::uhugeint) % {2**64}::uhugeint"
_ROT = lambda x, n: f"(({x}) * {2**n}::uhugeint) % {2**64}::uhugeint + ({x}) // {2 ** (64 - n)}::uhugeint"
_DECODE = "list_aggregate(list_transform(range(21), lambda j: substr('ACGT', ((sxs >> (40 - 2 * j)::int) & 3)::int + 1, 1)), 'string_agg', '')"
_RUNS = """
g as (select *, sum(hit::int) over (partition by rid order by pos) as g from hit),
u as (select rid, g, min(case when not hit then pos end) as s, min(case when hit then pos end) as hp from g group by rid, g),
c as (select *, lead(hp) over (partition by rid order by g) as e from u)
"""
_ABSENT = f"""
strands as (select distinct s from (select seq as s from panel union all select reverse(translate(seq, 'ACGT', 'TGCA')) from panel)),
words as (select distinct substr(s, i, n) as w from (select s, unnest(range(1, length(s) + 1)) as i from strands), range(1, {LONGEST + 1}) t(n) where i + n - 1 <= length(s)),
held as (select w from words where regexp_full_match(w, '[ACGT]+')),
starts as (select rid, i - 1 as s, length(seq) - i + 1 as rest, substr(seq, i, {LONGEST}) as x from (select rid, seq, unnest(range(1, length(seq) + 1)) as i from reads)),
pre as (select rid, s, n, substr(x, 1, n) as w from starts, range(1, {LONGEST + 1}) t(n) where n <= length(x)),
al as (select rid, s, min(case when held.w is null then n end) as l from pre left join held on pre.w = held.w group by rid, s),
far as (select rid, s, rest, substr(seq, s + 1) as x from al join starts using (rid, s) join reads using (rid) where l is null and rest > {LONGEST}),
heads as (select distinct left(x, {LONGEST}) as h from far),
sufs as (select distinct h, substr(s, i) as y from heads join (select s, unnest(range(1, length(s) - {LONGEST} + 2)) as i from strands where length(s) >= {LONGEST}) on substr(s, i, {LONGEST}) = h),
deep as (select rid, s, rest, max(list_max(list_transform(range(1, least(length(x), length(y)) + 1), lambda n: case when left(x, n) = left(y, n) then n else 0 end))) as m from far join sufs on left(x, {LONGEST}) = h group by rid, s, rest),
every as (select al.rid, al.s, coalesce(al.l, case when m < rest then m + 1 end) as l from al left join deep using (rid, s)),
fo as (select *, lead(l) over (partition by rid order by s) as nx from every),
absent as (select rid, s, l from fo where l is not null and (l = 1 or nx is null or nx >= l))
"""

_PATHS = with_("panel", "steps") + f"""
, s as (select path, step, is_ref, h, case when rev then reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')) else seq end as x from (select steps.*, seq from steps join panel using (vid))),
o as (select *, sum(length(x)) over (partition by path order by step) - length(x) as a from s),
p as (select path, bool_or(is_ref) as is_ref, string_agg(x, '' order by step) as seq from s group by path),
k0 as (select path, is_ref, seq, unnest(range(1, length(seq) - {K - 2})) as i from p where length(seq) >= {K}),
k as (select path, is_ref, i - 1 as pos, substr(seq, i, {K}) as w from k0),
l as (select w, k.is_ref, (f.h, pos - f.a, t.h, pos + {K - 1} - t.a) as way, (xor(t.h, 1), length(t.x) - 1 - (pos + {K - 1} - t.a), xor(f.h, 1), length(f.x) - 1 - (pos - f.a)) as back from k
      join o f on k.path = f.path and pos >= f.a and pos < f.a + length(f.x) join o t on k.path = t.path and pos + {K - 1} >= t.a and pos + {K - 1} < t.a + length(t.x)
      where regexp_full_match(w, '[ACGT]+')),
c as (select least(w, reverse(translate(w, 'ACGT', 'TGCA'))) as kmer, is_ref, case when way <= back then way else back end as loc, way > back as turned from l),
q0 as (select kmer, min(loc) as lo, max(loc) as hi, bool_or(is_ref) as is_ref, bool_or(turned) and bool_or(not turned) as has_both from c group by 1),
q as (select kmer, lo[1] as v1, lo[2] as pos1, lo[3] as v2, lo[4] as pos2, is_ref, has_both from q0 where lo = hi)
"""

SQL = {
    "sketch_unique_kmers": with_("panel", "pk") + "select kmer, vid, pos, rev, is_ref from uk",
    "kmer_canonical_counts": with_("reads", "rk") + "select kmer, count(*) as n from rk group by kmer having count(*) > 1",
    "sketch_path_kmers": _PATHS + "select v1, count(*) as n, count(*) filter (where is_ref) as n_ref, count(*) filter (where has_both) as n_both from q where v1 = v2 group by v1",
    "sketch_edge_kmers": _PATHS + "select kmer, v1, cast(pos1 as bigint) as pos1, v2, cast(pos2 as bigint) as pos2, is_ref, has_both from q where v1 <> v2",
    "sketch_density_sample": with_("panel", "pk") + f""", cd as (select kmer, vid, pos, cast(list_sum(list_transform(range({K}), lambda j: (position(substr(kmer, (j + 1)::int, 1) in 'ACGT') - 1)::bigint << (2 * ({K} - 1 - j))::int)) as uhugeint) as x from uk),
        h1 as (select *, {_MUL("x", _P[1])} as a from cd), h2 as (select *, {_MUL(_ROT("a", 31), _P[0])} as a2 from h1), h3 as (select *, xor({(_P[4] + 8) % 2**64}::uhugeint, a2) as b from h2),
        h4 as (select *, ({_MUL(_ROT("b", 27), _P[0])} + {_P[3]}::uhugeint) % {2**64}::uhugeint as c from h3), h5 as (select *, {_MUL(f"xor(c, c // {2**33}::uhugeint)", _P[1])} as e from h4),
        h6 as (select *, {_MUL(f"xor(e, e // {2**29}::uhugeint)", _P[2])} as f from h5) select kmer, vid, pos from h6 where xor(f, f // {2**32}::uhugeint) <= {2**62}::uhugeint""",
    "sketch_first_base_bins": with_("panel", "pk") + "select left(kmer, 1) as base, count(*) as n, round(avg(is_ref::int), 6) as ref_share from uk group by 1",
    "sketch_table_dump": f"""select row_id, {_DECODE} as kmer, concat_ws('>', pos1, pos2) as pos,
        case when rev1 then '<' else '>' end || v1 || case when rev2 then '<' else '>' end || v2 as vertices, has_both::int as rc, is_ref::int as ref from sketch where sxs >= 0""",
    "sketch_ref_share": "select sketch_id, count(*) as n, round(avg(is_ref::int), 6) as ref_share from sketch where sxs >= 0 and sketch_id is not null group by 1",
    "kan_missed_per_read": with_("reads", "panel", "rk", "pk", "hit") + "select rid, count(*) filter (where not hit) as missed, count(*) as n_kmers from hit group by rid",
    "kan_uncovered_intervals": with_("reads", "panel", "rk", "pk", "hit") + "," + _RUNS + "select rid, s, e from c where s is not null and e is not null",
    "kan_long_gaps": with_("reads", "panel", "rk", "pk", "hit") + "," + _RUNS + "select rid, s, e from c where s is not null and e - s > 40",
    "sfs_unique_read_kmers": with_("reads", "panel", "rk", "pk", "hit") + ", o as (select *, count(*) over (partition by rid, kmer) as c from hit) select rid, pos, kmer from o where hit and c = 1",
    "sfs_bounded": with_("reads", "panel") + "," + _ABSENT + "select l, count(*) as n, cast(sum((rid % 1000) * (s + 1)) as bigint) as places from absent group by l",
    "sfs_full": with_("reads", "panel") + "," + _ABSENT + "select l, count(*) as n from absent group by l",
    "sfs_assembled": with_("reads", "panel") + "," + _ABSENT + """
, m as (select *, max(s + l) over (partition by rid order by s rows between unbounded preceding and 1 preceding) as b from absent),
g as (select *, sum(case when b is null or s >= b then 1 else 0 end) over (partition by rid order by s) as g from m)
select rid, min(s) as s, max(s + l) - min(s) as l from g group by rid, g""",
    "revcomp_slices": with_("panel") + """, p as (select vid, a, substr(seq, a + 1, 10) as slice from (select vid, seq, unnest(range(0, len, 10)) as a from panel))
select vid, a as "at", slice, reverse(translate(slice, 'ACGTacgt', 'TGCAtgca')) as rc, least(slice, reverse(translate(slice, 'ACGTacgt', 'TGCAtgca'))) as canonical from p""",
    "kmer_encode_decode": with_("panel") + """, p as (select vid, i - 1 as pos, substr(seq, i, 21) as w from (select vid, seq, unnest(range(1, len - 19)) as i from panel where len >= 21))
select vid, pos, cast(list_sum(list_transform(range(21), lambda j: (position(substr(w, (j + 1)::int, 1) in 'ACGT') - 1)::bigint << (40 - 2 * j)::int)) as bigint) as code, w as word from p where regexp_full_match(w, '[ACGT]+')""",
    "overlapping_windows": with_("panel") + """, w as (select vid, seq, len, unnest(case when len >= 50 then range(0, len, 25) else [0] end) as a from panel)
select vid, a as start, least(a + 50, len) as end, substr(seq, a + 1, 50) as piece from w""",
    "homopolymer_runs": with_("panel") + """, p as (select vid, seq, unnest(range(0, len)) as a from panel), q as (select vid, a, substr(seq, a + 1) as r from p)
select vid, a as "at", length(r) - length(ltrim(r, left(r, 1))) as run from q""",
    "n_content": """with u as (select sfs_id, upper(plain_seq) as u from sfs where plain_seq is not null and plain_seq not in ('', '.')), n as (select sfs_id, length(u) - length(replace(u, 'N', '')) as n, u from u)
select sfs_id, n, round(n / length(u), 6) as share from n where n > 0""",
}
