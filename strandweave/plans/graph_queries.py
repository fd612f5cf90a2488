"""Paths, edges, support, recursion and renumbering: queries and SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.seqexpr import cigar_sum, handle_id, pack_handle, walk, walk_text
from ..operators import graph as G
from . import standins as V
from .standins import with_
from .tables import table

#: Bases between the ends of a sub-path at most, as in the reference.
FAR = 20_000


def path_edges(spark, d):
    return G.path_edges(V.steps(spark, d)).withColumn("step", F.col("step").cast("bigint"))


def path_bp_offsets(spark, d):
    return G.bp_offsets(V.steps(spark, d), V.segments(spark, d)).select("path", F.col("step").cast("bigint").alias("step"), "vid", "off")


def path_lengths(spark, d):
    return G.path_lengths(V.steps(spark, d), V.segments(spark, d))


def path_spelling(spark, d):
    return G.spell_paths(V.steps(spark, d), V.segments(spark, d))


def _pairs(spark, d):
    s = table(spark, d, "cand_paths").where("size(vertices) > 1")
    pairs = s.select(F.col("vertices")[0].alias("h1"), F.element_at("vertices", -1).alias("h2"))
    return pairs.where("h1 is not null and h2 is not null").distinct()


def subpaths_between(spark, d):
    """Stretches of paths between the ends of candidate paths, ten at most for each pair."""
    return G.subpaths(_pairs(spark, d), V.steps(spark, d), 10).select("h1", "h2", "path", F.col("s1").cast("bigint").alias("s1"), F.col("s2").cast("bigint").alias("s2"))


def path_distance_guard(spark, d):
    found = G.subpaths(_pairs(spark, d), V.steps(spark, d))
    near = G.distances(found, G.bp_offsets(V.steps(spark, d), V.segments(spark, d)), FAR)
    return near.select("h1", "h2", "path", F.col("s1").cast("bigint").alias("s1"), "dist")


def known_novel_vertices(spark, d):
    s = V.steps(spark, d)
    return G.known_vertices(s).withColumn("kind", F.lit("known")).unionByName(G.novel_vertices(s).withColumn("kind", F.lit("novel")))


def known_novel_edges(spark, d):
    s = V.steps(spark, d)
    return G.known_edges(s).withColumn("kind", F.lit("known")).unionByName(G.novel_edges(s).withColumn("kind", F.lit("novel")))


def vertex_support_filter(spark, d):
    return G.supported_vertices(V.steps(spark, d), V.support(spark, d))


def edge_support_filter(spark, d):
    return G.supported_edges(V.steps(spark, d), V.support(spark, d))


def removable_vertices(spark, d):
    return G.removable_vertices(V.steps(spark, d), V.support(spark, d), 40)


def edge_support_both_strands(spark, d):
    """Uses of each edge, both directions taken as one."""
    edges = G.path_edges(V.steps(spark, d)).select("path", *G.canonical_edge())
    return edges.groupBy("a", "b").agg(F.count(F.lit(1)).alias("supp"))


def _mapped(spark, d):
    """Walks of alignments as oriented vertices."""
    names = table(spark, d, "segments").select("id", "vid")
    return V.walks(spark, d).join(names, "id").select(F.col("aln_id").alias("path"), pack_handle(F.col("vid"), F.col("rev")).alias("h"))


def novel_used_share(spark, d):
    """Novel vertices that alignments walk in the same orientation, and their share."""
    used = G.novel_usage(V.steps(spark, d), _mapped(spark, d))
    return used.agg(F.count(F.lit(1)).alias("added"), F.count_if(F.col("uses") > 0).alias("used"), F.round(F.avg((F.col("uses") > 0).cast("double")), 6).alias("share"))


def old_new_ids(spark, d):
    """Old and new vertices that stand at the same step of the path of the same name."""
    segs = V.panel(spark, d).withColumn("chunk", F.col("vid") % 3)
    steps = V.steps(spark, d)
    renamed = G.rewritten_walks(steps, G.renumbered(segs, ["chunk", "vid"]))
    new = renamed.select("path", F.posexplode(walk(F.col("walk"))).alias("i", "x")).select("path", "i", F.col("x.id").cast("bigint").alias("new"))
    kept = steps.join(segs.select("vid"), "vid", "left_semi")
    old = kept.withColumn("i", F.row_number().over(Window.partitionBy("path").orderBy("step")) - 1).select("path", "i", "vid")
    return old.join(new, ["path", "i"]).select("vid", "new").distinct()


def consensus_growth(spark, d):
    """For each consensus path its vertices that no other path has, their bases, and the operations of its alignments."""
    s, segs = V.steps(spark, d), V.segments(spark, d)
    known = s.where("not consensus").select("vid").distinct()
    fresh = s.where("consensus").select("path", "vid").distinct().join(known, "vid", "left_anti").join(segs.select("vid", "len"), "vid")
    grown = fresh.groupBy("path").agg(F.count(F.lit(1)).alias("new_vertices"), F.sum("len").alias("bases_added"))
    gaf = table(spark, d, "gaf").where("cigar is not null").select((F.col("aln_id") % 500 + 1).alias("path"), "cigar")
    ops = gaf.groupBy("path").agg(*(F.sum(cigar_sum(F.col("cigar"), o)).alias(n) for o, n in (("M=", "m"), ("X", "x"), ("I", "i"), ("D", "d"))))
    own = s.where("consensus").select("path").distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return own.join(grown, "path", "left").join(ops, "path", "left").select("path", *(zero(c) for c in ("new_vertices", "bases_added", "m", "x", "i", "d")))


def parsimony_path_choice(spark, d):
    s = V.steps(spark, d)
    own = s.where("consensus").join(V.paths(spark, d).select("path", "sample"), "path")
    return G.fewest_novel(own, G.known_vertices(s), "sample", "path")


def _plain_edges(spark, d):
    return G.distinct_edges(V.steps(spark, d)).select(handle_id(F.col("h1")).alias("a"), handle_id(F.col("h2")).alias("b")).distinct()


def redundant_siblings(spark, d):
    s = V.steps(spark, d)
    return G.redundant_siblings(G.distinct_edges(s), V.segments(spark, d), s.select("h").distinct())


def novel_siblings(spark, d):
    """Novel vertices with another out- or in-neighbour of the same vertex that spells the same."""
    s = V.steps(spark, d)
    known = s.where("not consensus").select("vid").distinct()
    novel = s.where("consensus").select("vid").distinct().join(known, "vid", "left_anti")
    handles = novel.select(F.explode(F.array(F.col("vid") * 2, F.col("vid") * 2 + 1)).alias("h"))
    return G.redundant_siblings(G.mirrored(G.distinct_edges(s)), V.segments(spark, d), handles)


def subpaths_stranded(spark, d):
    """Stretches of reference paths between the ends of candidate paths, on either strand, ten at most for each pair."""
    found = G.stranded_subpaths(_pairs(spark, d), V.steps(spark, d), 3, 10, True)
    return found.select("h1", "h2", "strand", "path", F.col("s1").cast("bigint").alias("s1"), F.col("s2").cast("bigint").alias("s2"))


def dp_spell_paths(spark, d):
    """Walks of the graph that spell the sequence of a consensus path from its first to its last vertex."""
    s, segs = V.steps(spark, d), V.segments(spark, d)
    own = s.where("consensus")
    whole = own.groupBy("path").agg(F.min_by("h", "step").alias("source"), F.max_by("h", "step").alias("sink"), F.count(F.lit(1)).alias("n"))
    targets = G.spell_paths(own, segs).join(whole, "path").select(F.col("path").alias("key"), "source", "sink", "seq")
    found = G.spellings(targets, G.distinct_edges(s), segs)
    return found.select("key", F.concat_ws(",", F.transform("walk", lambda h: h.cast("string"))).alias("walk"))


def _off_reference(spark, d):
    """Vertices off the reference and those on it."""
    s = V.steps(spark, d)
    ref = s.where("is_ref").select("vid").distinct()
    return s.select("vid").distinct().join(ref, "vid", "left_anti"), ref


def bfs_first_reference(spark, d):
    """From each vertex off the reference, the nearest reference vertex downstream, however far."""
    rest, ref = _off_reference(spark, d)
    return G.first_reached(rest, _plain_edges(spark, d), ref)


def bfs_reference_region(spark, d):
    """The nearest reference vertices up- and downstream of each vertex off the reference that has both, and
    their offsets on the lowest reference path that holds both; no path if none does."""
    rest, ref = _off_reference(spark, d)
    edges = _plain_edges(spark, d)
    down = G.first_reached(rest, edges, ref).select("vid", F.col("found").alias("down"))
    up = G.first_reached(rest, edges.select(F.col("b").alias("a"), F.col("a").alias("b")), ref).select("vid", F.col("found").alias("up"))
    ends = up.join(down, "vid")
    offs = G.bp_offsets(V.steps(spark, d).where("is_ref"), V.segments(spark, d)).groupBy("path", "vid").agg(F.max("off").alias("off"))
    a = offs.select("path", F.col("vid").alias("up"), F.col("off").alias("start"))
    b = offs.select("path", F.col("vid").alias("down"), F.col("off").alias("end"))
    on = ends.select("up", "down").distinct().join(a, "up").join(b, ["path", "down"]).groupBy("up", "down").agg(F.min(F.struct("path", "start", "end")).alias("x"))
    return ends.join(on, ["up", "down"], "left").select("vid", "up", "down", "x.path", "x.start", "x.end")


def components(spark, d):
    return G.components(V.steps(spark, d).select("vid"), _plain_edges(spark, d))


def component_alignments(spark, d):
    """Alignments by the component of their first vertex."""
    names = table(spark, d, "segments").select(F.col("id"), "vid")
    comp = components(spark, d)
    first = V.walks(spark, d).where("step = 0").select("aln_id", "id")
    return first.join(names, "id").join(comp, "vid").groupBy("component").agg(F.count(F.lit(1)).alias("n"))


def unchop_chains(spark, d):
    return G.unary_chains(V.steps(spark, d).select("vid"), _plain_edges(spark, d))


def renumber_segments(spark, d):
    segs = V.panel(spark, d).withColumn("chunk", F.col("vid") % 3)
    return G.renumbered(segs, ["chunk", "vid"])


def rewrite_walks(spark, d):
    segs = V.panel(spark, d).withColumn("chunk", F.col("vid") % 3)
    return G.rewritten_walks(V.steps(spark, d), G.renumbered(segs, ["chunk", "vid"]))


def subgraph_by_samples(spark, d):
    p = V.paths(spark, d)
    _, vertices, edges = G.subgraph(V.steps(spark, d), p, p.where("sample % 7 = 0").select("sample"))
    return vertices.select(F.lit("S").alias("kind"), F.col("vid").alias("a"), F.lit(None).cast("bigint").alias("b")).unionByName(edges.select(F.lit("L").alias("kind"), F.col("h1").alias("a"), F.col("h2").alias("b")))


def walk_parse(spark, d):
    """Steps of alignment paths."""
    return V.walks(spark, d).withColumn("step", F.col("step").cast("bigint"))


def walk_reverse(spark, d):
    """Alignment paths walked the other way round."""
    back = lambda p: F.transform(F.reverse(walk(p)), lambda s: F.struct(s["id"].alias("id"), (~s["rev"]).alias("rev")))
    return table(spark, d, "gaf").where("path is not null").select("aln_id", walk_text(back(F.col("path"))).alias("path"))


def handle_packing(spark, d):
    """Handles of the sketch's vertices, packed and taken apart again."""
    from ..functions.seqexpr import handle_rev, pack_handle

    s = table(spark, d, "sketch").where("v1 is not null and rev1 is not null").withColumn("h", pack_handle(F.col("v1"), F.col("rev1")))
    return s.select("row_id", "h", handle_id(F.col("h")).alias("vid"), handle_rev(F.col("h")).alias("rev"), G.flip(F.col("h")).alias("other"))


QUERIES = {q.__name__: q for q in (
    path_edges, path_bp_offsets, path_lengths, path_spelling, subpaths_between, path_distance_guard, known_novel_vertices, known_novel_edges, vertex_support_filter, edge_support_filter,
    removable_vertices, edge_support_both_strands, novel_used_share, parsimony_path_choice, redundant_siblings, novel_siblings, subpaths_stranded, old_new_ids, consensus_growth, dp_spell_paths, bfs_first_reference, bfs_reference_region, components, component_alignments,
    unchop_chains, renumber_segments, rewrite_walks, subgraph_by_samples, walk_parse, walk_reverse, handle_packing,
)}

_EDGES = "e as (select a.path, a.step, a.consensus, a.h as h1, b.h as h2 from steps a join steps b on a.path = b.path and a.step + 1 = b.step)"
_OFF = "o as (select path, step, vid, h, len, sum(len) over (partition by path order by step) - len as off from steps join panel using (vid))"
_PAIRS = "pr as (select distinct vertices[1] as h1, vertices[-1] as h2 from cand_paths where len(vertices) > 1 and vertices[1] is not null and vertices[-1] is not null)"
_SUB = "sp as (select h1, h2, a.path, a.step as s1, min(b.step) as s2 from pr join steps a on a.h = h1 join steps b on b.h = h2 and b.path = a.path and b.step >= a.step group by 1, 2, 3, 4)"
_NOVEL = "kv as (select distinct h from steps where not consensus), nv as (select distinct h from steps where consensus and h not in (select h from kv))"
_NOVEL_E = "ke as (select distinct h1, h2 from e where not consensus), ne as (select distinct h1, h2 from e where consensus and (h1, h2) not in (select (h1, h2) from ke))"
_PLAIN = "pe as (select distinct h1 >> 1 as a, h2 >> 1 as b from e)"
_NEW = "nw as (select vid, row_number() over (order by vid % 3, vid) as new from panel)"
_SEQ = "case when rev then reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')) else seq end"



def _SEARCH(name, a, b):  # noqa: N802
    """From all reference vertices against the edges, each vertex reached once."""
    return f"""{name}(vid, depth, found) using key (vid) as (select vid, 0, vid from ref union
        select pe.{a}, {name}.depth + 1, min({name}.found) from {name} join pe on pe.{b} = {name}.vid where pe.{a} not in (select vid from recurring.{name}) group by pe.{a}, {name}.depth + 1)"""


SQL = {
    "path_edges": with_("steps") + f", {_EDGES} select path, step, h1, h2 from e",
    "path_bp_offsets": with_("panel", "steps") + f", {_OFF} select path, step, vid, cast(off as bigint) as off from o",
    "path_lengths": with_("panel", "steps") + "select path, cast(sum(len) as bigint) as bases, count(*) as n_steps from steps join panel using (vid) group by path",
    "path_spelling": with_("panel", "steps") + f"select path, string_agg({_SEQ}, '' order by step) as seq from steps join panel using (vid) group by path",
    "subpaths_between": with_("steps") + f", {_PAIRS}, {_SUB}, r as (select *, row_number() over (partition by h1, h2 order by path, s1) as r from sp) select h1, h2, path, s1, s2 from r where r <= 10",
    "path_distance_guard": with_("panel", "steps") + f""", {_PAIRS}, {_SUB}, {_OFF}, x as (select h1, h2, sp.path, s1, greatest(b.off - a.off - a.len, 0) as dist from sp join o a on a.path = sp.path and a.step = s1
        join o b on b.path = sp.path and b.step = s2) select h1, h2, path, s1, cast(dist as bigint) as dist from x where dist <= 20000""",
    "known_novel_vertices": with_("steps") + f", {_NOVEL} select h, 'known' as kind from kv union all select h, 'novel' from nv",
    "known_novel_edges": with_("steps") + f", {_EDGES}, {_NOVEL_E} select h1, h2, 'known' as kind from ke union all select h1, h2, 'novel' from ne",
    "vertex_support_filter": with_("steps", "support") + f", {_NOVEL} select h, count(distinct read) as supp from steps join support using (path) where consensus and h in (select h from nv) group by h having count(distinct read) >= 2",
    "edge_support_filter": with_("steps", "support") + f", {_EDGES}, {_NOVEL_E} select h1, h2, count(distinct read) as supp from e join support using (path) where consensus and (h1, h2) in (select (h1, h2) from ne) group by h1, h2 having count(distinct read) >= 2",
    "removable_vertices": with_("steps", "support") + f""", {_NOVEL}, sv as (select h from steps join support using (path) where consensus and h in (select h from nv) group by h having count(distinct read) >= 40)
        select distinct h >> 1 as vid from nv where h >> 1 not in (select h >> 1 from kv) and h >> 1 not in (select h >> 1 from sv)""",
    "edge_support_both_strands": with_("steps") + f", {_EDGES}, c as (select case when (xor(h2, 1), xor(h1, 1)) < (h1, h2) then xor(h2, 1) else h1 end as a, case when (xor(h2, 1), xor(h1, 1)) < (h1, h2) then xor(h1, 1) else h2 end as b from e) select a, b, count(*) as supp from c group by a, b",
    "novel_used_share": with_("steps", "walks") + f""", {_NOVEL}, m as (select distinct aln_id, vid * 2 + rev::int as h from walks join segments using (id)),
        u as (select nv.h, count(m.h) as uses from nv left join m on m.h = nv.h group by nv.h) select count(*) as added, count(*) filter (where uses > 0) as used, round(avg((uses > 0)::int), 6) as share from u""",
    "novel_siblings": with_("panel", "steps") + f""", {_EDGES}, nw as (select distinct vid from steps where consensus except select vid from steps where not consensus),
        ed as (select h1, h2 from e union select xor(h2, 1), xor(h1, 1) from e), o as (select h1, h2, case when h2 % 2 = 1 then reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')) else seq end as s from ed join panel on panel.vid = h2 >> 1)
        select distinct a.h1, a.h2 as v, b.h2 as w from o a join o b on a.h1 = b.h1 and a.s = b.s and a.h2 <> b.h2 where a.h2 >> 1 in (select vid from nw)""",
    "subpaths_stranded": with_("steps") + f""", {_PAIRS}, rs as (select * from steps where is_ref),
        fw as (select h1, h2, '+' as strand, a.path, a.step as s1, min(b.step) as s2 from pr join rs a on a.h = h1 join rs b on b.h = h2 and b.path = a.path and b.step >= a.step group by 1, 2, 3, 4, 5),
        bw as (select h1, h2, '-' as strand, a.path, min(b.step) as s1, a.step as s2 from pr join rs a on a.h = xor(h2, 1) join rs b on b.h = xor(h1, 1) and b.path = a.path and b.step >= a.step group by h1, h2, a.path, a.step),
        r as (select *, row_number() over (partition by h1, h2 order by strand, path, s1) as r from (select * from fw union all select * from bw)) select h1, h2, strand, path, s1, s2 from r where r <= 10""",
    "old_new_ids": with_("panel", "steps") + f", {_NEW} select distinct vid, new from steps join nw using (vid)",
    "consensus_growth": with_("panel", "steps") + """, nw as (select distinct vid from steps where consensus except select vid from steps where not consensus),
        g as (select path, count(*) as n, sum(len) as b from (select distinct path, vid from steps where consensus) join nw using (vid) join panel using (vid) group by path),
        c as (select aln_id % 500 + 1 as path, unnest(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]')) as x from gaf where cigar is not null),
        k as (select path, right(x, 1) as op, left(x, length(x) - 1)::bigint as n from c), q as (select path, sum(n) filter (where op in ('M', '=')) as m, sum(n) filter (where op = 'X') as x, sum(n) filter (where op = 'I') as i, sum(n) filter (where op = 'D') as d from k group by path)
        select p.path, coalesce(g.n, 0) as new_vertices, cast(coalesce(g.b, 0) as bigint) as bases_added, cast(coalesce(m, 0) as bigint) as m, cast(coalesce(x, 0) as bigint) as x, cast(coalesce(i, 0) as bigint) as i, cast(coalesce(d, 0) as bigint) as d
        from (select distinct path from steps where consensus) p left join g on g.path = p.path left join q on q.path = p.path""",
    "parsimony_path_choice": with_("steps", "paths") + f""", {_NOVEL}, c as (select p.sample, s.path, count(*) filter (where h not in (select h from kv)) as n_novel from steps s join paths p on s.path = p.path where s.consensus group by 1, 2),
        b as (select *, row_number() over (partition by sample order by n_novel, path) as r from c) select sample, path, n_novel from b where r = 1 and n_novel > 0""",
    "redundant_siblings": with_("panel", "steps") + f""", {_EDGES}, o as (select distinct h1, h2, case when h2 % 2 = 1 then reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')) else seq end as s from e join panel on panel.vid = h2 >> 1)
        select distinct a.h1, a.h2 as v, b.h2 as w from o a join o b on a.h1 = b.h1 and a.s = b.s and a.h2 <> b.h2""",
    "dp_spell_paths": "with recursive " + with_("panel", "steps")[5:] + f""", {_EDGES}, ed as (select distinct h1, h2 from e),
        sg as (select vid * 2 as h, seq as x from panel union all select vid * 2 + 1, reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')) from panel),
        t as (select path as key, string_agg({_SEQ}, '' order by step) as seq from steps join panel using (vid) where consensus group by path),
        w as (select path as key, arg_min(h, step) as source, arg_max(h, step) as sink from steps where consensus group by path),
        r as (select key, sink, seq, h as here, length(x) as pos, h::varchar as walk from t join w using (key) join sg on sg.h = source where starts_with(seq, x)
              union all select key, sink, seq, h2, pos + length(x), walk || ',' || h2 from r join ed on ed.h1 = here join sg on sg.h = h2 where pos < length(seq) and substr(seq, pos + 1, length(x)) = x)
        select key, walk from r where here = sink and pos = length(seq)""",
    "bfs_first_reference": "with recursive " + with_("steps")[5:] + f""", {_EDGES}, {_PLAIN}, ref as (select distinct vid from steps where is_ref), {_SEARCH("r", "a", "b")}
        select r.vid, cast(depth as int) as depth, found from r where depth > 0""",
    "bfs_reference_region": "with recursive " + with_("panel", "steps")[5:] + f""", {_EDGES}, {_PLAIN}, ref as (select distinct vid from steps where is_ref), {_SEARCH("dn", "a", "b")}, {_SEARCH("up", "b", "a")},
        z as (select up.vid, up.found as up, dn.found as down from up join dn using (vid) where up.depth > 0),
        o as (select path, vid, max(off) as off from (select path, vid, is_ref, sum(len) over (partition by path order by step) - len as off from (select s.*, len from steps s join panel using (vid) where s.is_ref)) group by 1, 2),
        on_ as (select z.up, z.down, min((a.path, a.off, b.off)) as x from (select distinct up, down from z) z join o a on a.vid = z.up join o b on b.vid = z.down and b.path = a.path group by 1, 2)
        select vid, z.up, z.down, x[1] as path, cast(x[2] as bigint) as start, cast(x[3] as bigint) as "end" from z left join on_ on on_.up = z.up and on_.down = z.down""",
    "components": "with recursive " + with_("steps")[5:] + f""", {_EDGES}, {_PLAIN}, ud as (select a, b from pe union select b, a from pe),
        r as (select distinct vid, vid as l from steps union select ud.b, r.l from r join ud on ud.a = r.vid) select vid, min(l) as component from r group by vid""",
    "component_alignments": "with recursive " + with_("steps", "walks")[5:] + f""", {_EDGES}, {_PLAIN}, ud as (select a, b from pe union select b, a from pe),
        r as (select distinct vid, vid as l from steps union select ud.b, r.l from r join ud on ud.a = r.vid), c as (select vid, min(l) as component from r group by vid)
        select component, count(*) as n from walks join segments using (id) join c using (vid) where step = 0 group by component""",
    "unchop_chains": "with recursive " + with_("steps")[5:] + f""", {_EDGES}, {_PLAIN}, j as (select a, b from pe where a in (select a from pe group by a having count(*) = 1) and b in (select b from pe group by b having count(*) = 1) and a <> b),
        r as (select distinct vid, vid as head, 0 as place from steps where vid not in (select b from j) union all select j.b, r.head, place + 1 from r join j on j.a = r.vid)
        select vid, head, cast(place as bigint) as place from r union all select distinct vid, vid, 0 from steps where vid not in (select vid from r)""",
    "renumber_segments": with_("panel") + f", {_NEW} select vid, new from nw",
    "rewrite_walks": with_("panel", "steps") + f", {_NEW} select path, string_agg(case when rev then '<' else '>' end || new, '' order by step) as walk from steps join nw using (vid) group by path",
    "subgraph_by_samples": with_("steps", "paths") + f""", {_EDGES}, k as (select path from paths where sample % 7 = 0)
        select distinct 'S' as kind, vid as a, cast(null as bigint) as b from steps where path in (select path from k) union all select distinct 'L', h1, h2 from e where path in (select path from k)""",
    "walk_parse": with_("walks") + "select aln_id, step, id, rev from walks",
    "walk_reverse": with_("walks") + """, t as (select aln_id, string_agg(case when rev then '>' else '<' end || id, '' order by step desc) as path from walks group by aln_id)
        select g.aln_id, coalesce(t.path, '') as path from gaf g left join t on t.aln_id = g.aln_id where g.path is not null""",
    "handle_packing": "select row_id, v1 * 2 + rev1::int as h, v1 as vid, rev1 as rev, xor(v1 * 2 + rev1::int, 1) as other from sketch where v1 is not null and rev1 is not null",
}
