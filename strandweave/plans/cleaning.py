"""Queries over the general operators for unreadable rows and for intervals, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.intervals import complete_spans, periods_and_gaps
from ..operators.rejects import read_alignments
from .tables import table


def p1_found(spark, sf_dir):
    """raw_id and reason of each alignment line that can't be read."""
    raw = table(spark, sf_dir, "gaf_raw").select("raw_id", "line")
    return read_alignments(raw).where("reason is not null").select("raw_id", "reason")


def p1_loaded(spark, sf_dir):
    """The typed rows of all lines that can be read."""
    raw = table(spark, sf_dir, "gaf_raw").select("raw_id", "file_name", "line_no", "line")
    return read_alignments(raw).where("reason is null").select("raw_id", "file_name", "line_no", F.expr("inline(array(rec))"))


def p1_edits(spark, sf_dir):
    """The edits of the cheapest repair of each line whose quotes or number of fields are at fault."""
    raw = table(spark, sf_dir, "gaf_raw").select("raw_id", "line")
    return read_alignments(raw).where("reason in ('quoting', 'columns')").select("raw_id", "reason", "edits")


def p4_found(spark, sf_dir):
    """Covered periods of each read and the gaps of 1 to 20,000 bases between them."""
    sfs = table(spark, sf_dir, "sfs").select("rname", "s", "l", "e")
    found = periods_and_gaps(complete_spans(sfs, "rname"), 1, 20_000)
    return found.select(F.col("key").alias("rname"), "kind", F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e"))


QUERIES = {"p1_found": p1_found, "p1_loaded": p1_loaded, "p1_edits": p1_edits, "p4_found": p4_found}

_P1 = r"""
with t as (select raw_id, file_name, line_no, case when line like '%' || chr(13) then left(line, length(line) - 1) else line end as x from gaf_raw where line is not null),
a as (select * from t where not regexp_full_match(x, '[ \t]*') and x not like '#%' and x not like '@%'),
b as (select *, regexp_full_match(x, '("([^"]|"")*"|[^"\t]*)(\t("([^"]|"")*"|[^"\t]*))*') as sound,
        list_transform(regexp_extract_all(chr(9) || x, '\t("(?:[^"]|"")*"|[^"\t]*)', 1),
            lambda v: case when v like '"%' then replace(substr(v, 2, length(v) - 2), '""', '"') else v end) as f from a),
c as (select *, list_bool_and(list_transform([f[2], f[3], f[4], f[7], f[8], f[9], f[10], f[11], f[12]], lambda v: coalesce(regexp_full_match(v, '[0-9]{1,9}'), false))) as digits,
        regexp_extract(f[13], '^NM:i:([0-9]+)$', 1) as nm, substr(f[17], 6) as cg from b),
d as (select *, case when digits then f[5] in ('+', '-') and try_cast(f[3] as bigint) < try_cast(f[4] as bigint) and try_cast(f[4] as bigint) <= try_cast(f[2] as bigint)
            and try_cast(f[8] as bigint) < try_cast(f[9] as bigint) and try_cast(f[9] as bigint) <= try_cast(f[7] as bigint) and try_cast(f[12] as bigint) <= 255 else false end as numbers,
        coalesce(regexp_full_match(f[17], 'cg:Z:([0-9]+[MID=X])+'), false) and not regexp_matches(cg, '(^|[^0-9])0+[MID=X]') as tiled,
        cast(list_sum(list_transform(regexp_extract_all(cg, '([0-9]+)[MI=X]', 1), lambda v: try_cast(v as hugeint))) as hugeint) as used from c),
judged as (select *, case when not sound then 'quoting' when len(f) <> 17 then 'columns' when not numbers then 'number'
        when nm = '' or try_cast(nm as hugeint) is null or try_cast(nm as hugeint) > 2147483647 then 'nm'
        when not tiled or coalesce(used, 0) <> try_cast(f[4] as bigint) - try_cast(f[3] as bigint) then 'cigar' end as reason from d)
"""

_P4 = """
with v as (select rname, coalesce(cast(s as bigint), cast(e as bigint) - l) as s, coalesce(cast(l as bigint), cast(e as bigint) - s) as l from sfs where rname is not null),
w as (select rname, s, s + l as e from v where s >= 0 and l >= 1),
m as (select *, max(e) over (partition by rname order by s, e rows between unbounded preceding and 1 preceding) as b from w),
g as (select *, sum(case when b is null or s >= b then 1 else 0 end) over (partition by rname order by s, e rows unbounded preceding) as g from m),
p as (select rname, g, min(s) as s, max(e) as e from g group by rname, g),
n as (select *, lead(s) over (partition by rname order by s) as n from p)
select rname, 'period' as kind, cast(s as int) as s, cast(e as int) as e from n
union all
select rname, 'gap', cast(e as int), cast(n as int) from n where n - e between 1 and 20000
"""

SQL = {
    "p1_found": _P1 + "select raw_id, reason from judged where reason is not null",
    "p1_loaded": _P1
    + """select raw_id, file_name, line_no, f[1] as name, cast(f[2] as bigint) as qlen, cast(f[3] as bigint) as qs, cast(f[4] as bigint) as qe, f[5] as strand, f[6] as path,
    cast(f[7] as bigint) as plen, cast(f[8] as bigint) as ps, cast(f[9] as bigint) as pe, cast(f[10] as bigint) as matches, cast(f[11] as bigint) as cigar_len,
    cast(f[12] as int) as mapq, cast(nm as int) as nm, f[14] as as_tag, f[15] as dv_tag, f[16] as id_tag, cg as cigar from judged where reason is null""",
    "p4_found": _P4,
}
