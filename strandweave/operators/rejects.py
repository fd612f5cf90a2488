"""Alignment lines that can't be read, parted from those that can.

A line is read by a minimum-cost error parse: dynamic programming over its quotes, tabs and runs
of other letters, in which a quote or a tab may be inserted or deleted at a cost of one; quotes
are edited only where the quoting isn't sound as it is. Lines that parse at no cost and whose fields have valid values load as typed rows; for all others the
kind of the edits, or the first field with an invalid value, is the reason.
"""

from __future__ import annotations

from copy import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The fields of an alignment line, in order.
FIELDS = ("name", "qlen", "qs", "qe", "strand", "path", "plen", "ps", "pe", "matches", "cigar_len", "mapq", "nm", "as", "dv", "id", "cg")
NUMBERS = ("qlen", "qs", "qe", "plen", "ps", "pe", "matches", "cigar_len", "mapq")

_PARSE = T.StructType([
    T.StructField("quote_edits", T.IntegerType()),
    T.StructField("edits", T.StringType()),
    T.StructField("fields", T.ArrayType(T.StringType())),
])

# states of the parse: at the start of a field, in a bare field, inside quotes, after a quote inside quotes
_START, _BARE, _IN, _CLOSED = range(4)
_QUOTE, _TAB, _OTHER, _END = 0, 1, 2, 3


class Cost:
    """Costs as one number: edits first, then inserted quotes, deleted quotes and inserted tabs; deleted tabs are the rest.

    Adding costs keeps the counts apart, as each has room for twice the symbols of a line. Where
    64 bits don't do for that, numbers of any size are used."""

    def __init__(self, symbols: int):
        self.bits = (2 * symbols + 64).bit_length()
        self.kind = np.int64 if 4 * self.bits < 62 else object
        one = lambda i: 1 << self.bits * i
        edit = one(3)
        self.qins, self.qdel, self.tins, self.tdel = edit + one(2), edit + one(1), edit + one(0), edit
        self.far = 1 << (4 * self.bits + 1 if self.kind is object else 61)

    def without_quotes(self) -> Cost:
        """The same with quotes that can't be edited."""
        other = copy(self)
        other.qins = other.qdel = self.far
        return other

    def counts(self, packed) -> tuple[int, int, int, int]:
        """Quotes inserted and deleted, tabs inserted and deleted."""
        packed, mask = int(packed), (1 << self.bits) - 1
        edits, qins, qdel, tins = (packed >> self.bits * i & mask for i in (3, 2, 1, 0))
        return qins, qdel, tins, edits - qins - qdel - tins


def _advance(cost: np.ndarray, kind: np.ndarray, allow_tabs: bool, c: Cost) -> np.ndarray:
    """One symbol further for all lines: cost[line, state, fields so far]."""
    # edits before the symbol: insert a quote, insert a tab; twice, so an inserted quote may be followed by another edit
    for _ in range(2):
        base = cost.copy()
        edit = lambda src, dst, add: np.minimum(cost[:, dst], base[:, src] + add, out=cost[:, dst])
        edit(_START, _IN, c.qins)
        edit(_IN, _CLOSED, c.qins)
        edit(_CLOSED, _IN, c.qins)
        if allow_tabs:
            for state in (_START, _BARE, _CLOSED):
                cost[:, _START, 1:] = np.minimum(cost[:, _START, 1:], base[:, state, :-1] + c.tins)
    out = np.full_like(cost, c.far)
    q, t, x = (kind == k for k in (_QUOTE, _TAB, _OTHER))

    def move(rows, src, dst, add=0, shift=0):
        a = cost[rows, src]
        if shift:
            a = np.concatenate([np.full_like(a[:, :1], c.far), a[:, :-1]], axis=1)
        out[rows, dst] = np.minimum(out[rows, dst], a + add)

    move(q, _START, _IN)
    move(q, _IN, _CLOSED)
    move(q, _CLOSED, _IN)
    for state in range(4):
        move(q, state, state, c.qdel)
        if allow_tabs:
            move(t, state, state, c.tdel)
    move(t, _IN, _IN)
    for state in (_START, _BARE, _CLOSED):
        move(t, state, _START, shift=1)
    move(x, _START, _BARE)
    move(x, _BARE, _BARE)
    move(x, _IN, _IN)
    keep = kind == _END
    out[keep] = cost[keep]
    # a sum with what can't be reached stays out of reach
    return np.minimum(out, c.far)


def _least(symbols: np.ndarray, fields: int | None, c: Cost) -> np.ndarray:
    """The least packed cost for each line of ``symbols`` (padded with _END).

    With ``fields`` None only quotes may be edited and any number of fields will do. No edit takes
    back a field once it is closed, so states beyond ``fields`` are dropped: a line costs its
    symbols times ``fields``, whatever tabs it has.
    """
    lines, size = symbols.shape
    width = 1 if fields is None else fields
    cost = np.full((lines, 4, width), c.far, c.kind)
    cost[:, _START, 0] = 0
    flat = fields is None
    for i in range(size):
        if flat:  # the number of fields doesn't matter: tabs stay in the one column
            wide = np.concatenate([cost, np.full_like(cost, c.far)], axis=2)
            cost = _advance(wide, symbols[:, i], False, c).min(axis=2, keepdims=True)
        else:
            cost = _advance(cost, symbols[:, i], True, c)
    # at the end: an open quote may be closed, and missing tabs added, by insertion
    cost[:, _CLOSED] = np.minimum(cost[:, _CLOSED], cost[:, _IN] + c.qins)
    done = np.minimum(np.minimum(cost[:, _START], cost[:, _BARE]), cost[:, _CLOSED])
    if flat:
        return done[:, 0]
    missing = np.array([c.tins * (fields - 1 - i) for i in range(width)], c.kind)
    return (done + missing).min(axis=1)


def _symbol_row(line: str) -> np.ndarray:
    """A line as quotes, tabs and runs of other letters."""
    codes = np.frombuffer(line.encode("utf-8"), np.uint8)
    kind = np.where(codes == 34, _QUOTE, np.where(codes == 9, _TAB, _OTHER)).astype(np.int8)
    keep = np.ones(len(kind), bool)
    keep[1:] = (kind[1:] != _OTHER) | (kind[:-1] != _OTHER)
    return kind[keep]


def _symbols(rows: list[np.ndarray]) -> np.ndarray:
    """The symbols of each line, padded to the longest."""
    out = np.full((len(rows), max(map(len, rows), default=0)), _END, np.int8)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def _split(line: str) -> list[str]:
    """The fields of a line whose quoting costs nothing."""
    if '"' not in line:
        return line.split("\t")
    fields, at = [], 0
    while True:
        if line.startswith('"', at):
            end = at + 1
            while True:
                end = line.index('"', end)
                if line.startswith('""', end):
                    end += 2
                    continue
                break
            fields.append(line[at + 1 : end].replace('""', '"'))
            at = end + 1
        else:
            end = line.find("\t", at)
            end = len(line) if end < 0 else end
            fields.append(line[at:end])
            at = end
        if at >= len(line):
            return fields
        at += 1


def _said(counts: tuple[int, int, int, int]) -> str:
    words = ("insert {} quote", "delete {} quote", "insert {} tab", "delete {} tab")
    return ", ".join(w.format(k) for w, k in zip(words, counts) if k)


def parse_lines(column: pa.Array, fields: int = len(FIELDS), block: int = 1 << 22) -> pa.Array:
    """The parse of each line; null stays null. ``quote_edits`` is the least number of quotes to edit for
    sound quoting, ``edits`` tells the cheapest way to ``fields`` fields (empty if nothing is to be
    done), and ``fields`` are those of a line with sound quoting. Lines are parsed together with
    others of like size, so that a long one doesn't widen the table of all others."""
    lines = column.to_pylist()
    out: list = [None] * len(lines)
    symbols_of = {i: _symbol_row(x) for i, x in enumerate(lines) if x is not None}
    order = sorted(symbols_of, key=lambda i: len(symbols_of[i]))
    at = 0
    while at < len(order):
        part = [order[at]]
        most = max(1, block // (4 * fields * max(1, len(symbols_of[order[min(at + 4095, len(order) - 1)]]))))
        part = order[at : at + min(4096, most)]
        at += len(part)
        symbols = _symbols([symbols_of[i] for i in part])
        cost = Cost(symbols.shape[1])
        quotes = _least(symbols, None, cost)
        tabs = (symbols == _TAB).sum(axis=1)
        said = [""] * len(part)
        for rows, own in ((quotes > 0, cost), ((quotes == 0) & ((symbols == _QUOTE).any(axis=1) | (tabs != fields - 1)), cost.without_quotes())):
            if rows.any():
                for k, packed in zip(np.flatnonzero(rows).tolist(), _least(symbols[rows], fields, own)):
                    said[k] = _said(cost.counts(packed))
        for k, i in enumerate(part):
            qins, qdel, _, _ = cost.counts(quotes[k])
            out[i] = {"quote_edits": qins + qdel, "edits": said[k], "fields": _split(lines[i]) if quotes[k] == 0 else None}
    return pa.array(out, pa.struct([("quote_edits", pa.int32()), ("edits", pa.string()), ("fields", pa.list_(pa.string()))]))


@F.arrow_udf(_PARSE)
def _parse(line: pa.Array) -> pa.Array:
    return parse_lines(line)


def _field(name: str) -> Column:
    return F.try_element_at("f", F.lit(FIELDS.index(name) + 1))


def read_alignments(df: DataFrame, line: str = "line") -> DataFrame:
    """The columns of ``df`` beside ``line``, with ``reason``, ``edits`` and the struct ``rec``.

    Null, blank and header lines (``#``, ``@``) are no alignment lines and don't come out.
    ``reason`` is null for a line that loads: ``rec`` then holds its typed fields. Otherwise it is
    the first of quoting, columns, number, nm and cigar that applies, ``rec`` is null and
    ``edits`` tells the edits of the cheapest repair, where quotes or tabs are at fault: of repairs
    with equally many edits the one that inserts the fewest quotes, then deletes the fewest, then
    inserts the fewest tabs. Repeated lines come out as often as they came in.

    A line of the right number of tabs without a quote parses at a cost of zero, so it needs no
    dynamic programming and doesn't leave the JVM. All other lines are parsed by it.
    """
    text = F.when(F.col(line).endswith("\r"), F.expr("left(__line, length(__line) - 1)")).otherwise(F.col("__line"))
    base = df.withColumn("__line", F.col(line)).withColumn("__text", text)
    base = base.where("__line is not null and not rlike(__text, '^[ \\\\t]*\\\\z') and not rlike(__text, '^[#@]')")
    n = len(FIELDS)
    quoted = F.col("__text").contains('"')
    odd = quoted | (F.length("__text") - F.length(F.replace("__text", F.lit("\t"), F.lit(""))) != n - 1)
    base = base.withColumn("__odd", odd).withColumn("__p", _parse(F.when(F.col("__odd"), F.col("__text"))))
    fields = F.when(F.col("__odd"), F.col("__p.fields")).otherwise(F.split("__text", "\t", -1))
    # what is exploded is worked out once a row, not once for each expression that uses it
    once = F.struct(fields.alias("f"), F.col("__p.quote_edits").alias("q"), F.col("__p.edits").alias("e"))
    base = base.withColumn("__r", F.explode(F.array(once))).withColumn("f", F.col("__r.f"))
    value = {c: F.when(_field(c).rlike("^[0-9]{1,9}\\z"), _field(c)).try_cast("bigint") for c in NUMBERS}
    numbers_ok = F.lit(True)
    for c in NUMBERS:
        numbers_ok = numbers_ok & value[c].isNotNull()
    numbers_ok = (
        numbers_ok
        & _field("strand").isin("+", "-")
        & (value["qs"] < value["qe"]) & (value["qe"] <= value["qlen"])
        & (value["ps"] < value["pe"]) & (value["pe"] <= value["plen"])
        & (value["mapq"] <= 255)
    )
    digits = F.regexp_replace(F.regexp_extract(_field("nm"), "^NM:i:([0-9]+)\\z", 1), "^0+(?=[0-9])", "")
    nm = F.when(F.length(digits).between(1, 10), digits.try_cast("bigint"))
    nm = F.when(nm <= 2147483647, nm.cast("int"))
    cigar = F.when(_field("cg").startswith("cg:Z:"), F.expr(f"substring(try_element_at(f, {n}), 6)"))
    # every operation taken away, nothing may be left; no operation may have a length of 0
    tiled = (F.length(cigar) > 0) & (F.regexp_replace(cigar, "[0-9]+[MID=X]", "") == "") & ~cigar.rlike("(?<![0-9])0+[MID=X]")
    sizes = F.regexp_extract_all(cigar, F.lit("([0-9]+)[MI=X]"), F.lit(1))
    # lengths of over 18 digits can't belong to a span of 9; they count as one that is too long
    as_long = lambda x: F.coalesce(F.when(F.length(F.ltrim(F.lit("0"), x)) <= 10, x.try_cast("bigint")), F.lit(1 << 40))
    used = F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, x: F.least(a + as_long(x), F.lit(1 << 41)))
    cigar_ok = tiled & (used == value["qe"] - value["qs"])
    bad = lambda ok: ~F.coalesce(ok, F.lit(False))
    reason = (
        F.when(F.col("__r.q") > 0, "quoting")
        .when(F.size("f") != n, "columns")
        .when(bad(numbers_ok), "number")
        .when(nm.isNull(), "nm")
        .when(bad(cigar_ok), "cigar")
    )
    edits = F.nullif(F.col("__r.e"), F.lit(""))
    whole = [_field("name").alias("name"), *(value[c].alias(c) for c in ("qlen", "qs", "qe")), _field("strand").alias("strand"), _field("path").alias("path")]
    whole += [value[c].alias(c) for c in ("plen", "ps", "pe", "matches", "cigar_len")] + [value["mapq"].cast("int").alias("mapq"), nm.alias("nm")]
    whole += [_field("as").alias("as_tag"), _field("dv").alias("dv_tag"), _field("id").alias("id_tag"), cigar.alias("cigar")]
    kept = [c for c in df.columns if c != line and c not in ("reason", "edits", "rec")]
    judged = base.withColumn("__reason", F.explode(F.array(reason)))
    return judged.select(*kept, F.col("__reason").alias("reason"), edits.alias("edits"), F.when(F.col("__reason").isNull(), F.struct(*whole)).alias("rec"))
