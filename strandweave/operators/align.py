"""Clusters of strings, their consensus, profiles and alignments."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.seqexpr import reverse_complement, run_length
from .poa import consensus
from .ranks import dense_index

#: Match, mismatch and both gap costs (open, extend) of the consensus alignment.
MATCH, MISMATCH, GAPS = 1, -9, ((16, 2), (41, 1))


def clusters(strings: DataFrame, most: int = 64) -> DataFrame:
    """(cidx, skmer, ekmer, n, bases): anchored strings by their pair of anchors; cidx numbers all clusters
    in k-mer order from 0, those of more than ``most`` strings then fall out."""
    grouped = strings.where("skmer is not null and ekmer is not null").groupBy("skmer", "ekmer").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l").cast("bigint")).alias("bases"))
    return dense_index(grouped, ["skmer", "ekmer"], "cidx", 0).where(F.col("n") <= most)


def canberra(a: Column, b: Column) -> Column:
    """Sum of |x - y| / (x + y) over two count arrays; positions where both are 0 count 0."""
    part = lambda x, y: F.when(x + y > 0, F.abs(x - y).cast("double") / (x + y)).otherwise(F.lit(0.0))
    return F.aggregate(F.zip_with(a, b, part), F.lit(0.0), lambda s, v: s + v)


def nearest_profile(targets: DataFrame, candidates: DataFrame, group: str, key: str) -> DataFrame:
    """(group, key, dist): for each group the candidate (group, key, counts) nearest to the target (group, profile), the lowest key on ties."""
    met = candidates.join(targets, group).withColumn("dist", canberra(F.col("profile"), F.col("counts")))
    best = met.groupBy(group).agg(F.min(F.struct("dist", key)).alias("x"))
    return best.select(group, F.col(f"x.{key}").alias(key), F.col("x.dist").alias("dist"))


# --- alignment ---------------------------------------------------------------------------------


def align_pair(query: str, target: str, match: int = MATCH, mismatch: int = MISMATCH, gaps=GAPS, band: int = 32) -> tuple[int, str]:
    """(score, CIGAR) of the best global alignment with the cheaper of several affine gap costs.

    A gap of n letters costs open + n * extend of the cheapest pair; N scores 0 against anything.
    CIGAR operations are M, I (in the query only) and D. Of equal ways a match is preferred, then a
    deletion, then an insertion.

    Only a band around the diagonals of both ends is worked out. A way that leaves it has more letters in gaps
    than the band is wide; as long as the best score found doesn't beat all that such a way could
    reach, the band is doubled. So the result is that of the whole table, and similar strings take
    room in proportion to their length.
    """
    q, t = (np.frombuffer(x.encode("ascii", "replace"), np.uint8) for x in (query, target))
    n, m = len(q), len(t)
    cost = lambda size: min(o + e * size for o, e in gaps)
    if not n or not m:
        size = n or m
        return (-cost(size) if size else 0), (f"{size}{'I' if n else 'D'}" if size else "")
    w = band
    while True:
        score, cigar = _banded(q, t, w, match, mismatch, gaps)
        out = match * max(0, min(n, m) - w - 1) - cost(w + 1) - cost(w + 1 + abs(n - m))
        if score > out or w >= max(n, m):
            return score, cigar
        w *= 2


def _banded(q: np.ndarray, t: np.ndarray, w: int, match: int, mismatch: int, gaps) -> tuple[int, str]:
    """The best alignment within ``w`` diagonals beside those of both ends.

    Rows are computed at once: gaps along a row come from a running maximum. Column c of row i
    stands for letter i + low + c of the target."""
    n, m = len(q), len(t)
    low, high = min(0, m - n) - w, max(0, m - n) + w
    low, high = max(low, -n), min(high, m)
    size = high - low + 1
    far = np.int64(-1) << 40
    cost = np.array([0, *(min(o + e * k for o, e in gaps) for k in range(1, m + 1))], np.int64)
    at = np.arange(size) + low
    inside = (at >= 0) & (at <= m)
    before = np.where(inside, -cost[np.clip(at, 0, m)], far)
    up = [np.full(size, far) for _ in gaps]
    up_size = [np.zeros(size, np.int32) for _ in gaps]
    kind = np.zeros((n + 1, size), np.int8)  # 0 match, 1 insertion, 2 deletion
    length = np.zeros((n + 1, size), np.int32)  # of the gap that ends here
    kind[0], length[0] = 2, np.clip(at, 0, m)
    shifted = lambda x, fill: np.append(x[1:], fill)
    padded = np.concatenate([[0], t])
    for i in range(1, n + 1):
        at = at + 1
        inside = (at >= 0) & (at <= m)
        above = shifted(before, far)
        ins, ins_size = np.full(size, far), np.zeros(size, np.int32)
        for g, (o, e) in enumerate(gaps):
            opened, grown = above - o - e, shifted(up[g], far) - e
            up_size[g] = np.where(grown > opened, shifted(up_size[g], 0) + 1, 1)
            up[g] = np.maximum(opened, grown)
            better = up[g] > ins
            ins, ins_size = np.where(better, up[g], ins), np.where(better, up_size[g], ins_size)
        letter = padded[np.clip(at, 0, m)]
        same = (letter == q[i - 1]) & (q[i - 1] != 78)
        any_n = (letter == 78) | (q[i - 1] == 78)
        diag = np.where((at >= 1) & inside, before + np.where(any_n, 0, np.where(same, match, mismatch)), far)
        best = np.where(inside, np.maximum(diag, ins), far)
        row, row_kind, row_size = best.copy(), np.where(diag >= ins, 0, 1).astype(np.int8), np.where(diag >= ins, 0, ins_size)
        for o, e in gaps:
            # a deletion ending at j that starts behind k: best[k] - o - e * (j - k)
            base = best + e * at
            top = np.maximum.accumulate(base)
            where = np.maximum.accumulate(np.where(base == top, at, -n - 1))
            dele = np.full(size, far)
            dele[1:] = top[:-1] - e * at[1:] - o
            better = dele > row
            row = np.where(better, dele, row)
            row_kind = np.where(better, 2, row_kind).astype(np.int8)
            row_size[1:] = np.where(better[1:], at[1:] - where[:-1], row_size[1:])
        before = np.maximum(np.where(inside, row, far), far)
        up = [np.maximum(x, far) for x in up]
        kind[i], length[i] = row_kind, row_size
    ops: list[tuple[int, str]] = []
    i, j = n, m
    while i or j:
        k = kind[i, j - i - low]
        step = 1 if k == 0 else int(length[i, j - i - low])
        op = "MID"[k]
        if ops and ops[-1][1] == op:
            ops[-1] = (ops[-1][0] + step, op)
        else:
            ops.append((step, op))
        i, j = i - (step if k != 2 else 0), j - (step if k != 1 else 0)
    return int(before[m - n - low]), "".join(f"{k}{op}" for k, op in reversed(ops))


#: Cells of the tables that are worked out at a time, and pairs.
_CELLS, _PAIRS = 1 << 24, 512


def align_pairs(pairs: list[tuple[str, str]], match: int = MATCH, mismatch: int = MISMATCH, gaps=GAPS, band: int = 32) -> list[tuple[int, str]]:
    """What ``align_pair`` gives for each pair, worked out for many pairs of like sizes at once. All opening costs must be above 0.

    Common ends behind are left out of the tables: equal last letters are always worth aligning, and matches are
    preferred from the end on. The first score of a pair tells how wide a band surely holds all of its
    best ways, so a pair is worked out twice at most."""
    cost = lambda size: min(o + e * size for o, e in gaps)
    found: list = [None] * len(pairs)
    todo = []
    for x, (query, target) in enumerate(pairs):
        q, t = (np.frombuffer(s.encode("ascii", "replace"), np.uint8) for s in (query, target))
        least = min(len(q), len(t))
        differ = np.flatnonzero(q[len(q) - least :] != t[len(t) - least :])
        tail = least - 1 - int(differ[-1]) if len(differ) else least
        rest = q[len(q) - tail :]
        n, m, more = len(q) - tail, len(t) - tail, match * int((rest != 78).sum())
        if not n or not m:
            size = n or m
            found[x] = (more - (cost(size) if size else 0), (f"{size}{'I' if n else 'D'}" if size else "") + (f"{tail}M" if tail else ""))
        else:
            todo.append((x, q[:n], t[:m], tail, more, band))
    while todo:
        again = []
        for part in _alike(todo):
            for (x, q, t, tail, more, w), table in zip(part, _tables(part, match, mismatch, gaps)):
                n, m = len(q), len(t)
                score = table.score(n, m)
                at = np.arange(w, max(w, n, m) + 1)
                gap = lambda size: np.min([o + e * size for o, e in gaps], axis=0)
                out = match * np.maximum(0, min(n, m) - at - 1) - gap(at + 1) - gap(at + 1 + abs(n - m))
                wide = w + min(int((out >= score).sum()), len(at) - 1)  # ways that leave a wider band reach less
                if wide > w:
                    again.append((x, q, t, tail, more, wide))
                else:
                    found[x] = (score + more, table.cigar(q, t, tail))
        todo = again
    return found


def _reach(q: np.ndarray, t: np.ndarray, w: int) -> tuple[int, int]:
    """The lowest and the highest diagonal (place in the target less place in the query) of a band."""
    d = len(t) - len(q)
    return max(min(0, d) - w, -len(q)), min(max(0, d) + w, len(t))


def _alike(todo: list) -> list[list]:
    """Parts of pairs whose bands and lengths are alike, none with more cells than are worked out at a time, but one pair at least."""
    place = lambda x: (*(int(np.sign(d)) * int(abs(d)).bit_length() for d in _reach(x[1], x[2], x[5])), len(x[1]))
    parts: list[list] = []
    low = high = n = m = 0
    for x in sorted(todo, key=place):
        a, b = _reach(x[1], x[2], x[5])
        if parts:
            wider = min(low, a), max(high, b), max(n, len(x[1])), max(m, len(x[2]))
            size = wider[1] - wider[0] + 1
            fits = size <= 2 * (b - a + 1) and wider[2] + wider[3] <= 1.5 * (len(x[1]) + len(x[2])) + 16
            if fits and len(parts[-1]) < _PAIRS and (len(parts[-1]) + 1) * (wider[2] + wider[3] + 1) * (size // 2 + 4) <= _CELLS:
                low, high, n, m = wider
                parts[-1].append(x)
                continue
        parts.append([x])
        low, high, n, m = a, b, len(x[1]), len(x[2])
    return parts


class _Table:
    """One pair's part of the tables: ``lost[d, i - first[d] + 1, pair]`` is what the best way to place i of the
    query and d - i of the target falls short of letters that all match, doubled."""

    def __init__(self, lost: np.ndarray, first: np.ndarray, last: np.ndarray, costs: tuple):
        self.lost, self.first, self.last, (self.match, self.other, self.gaps) = lost, first, last, costs

    def at(self, i, j):
        d = i + j
        slot = i - self.first[d] + 1
        inside = (i >= self.first[d]) & (i <= self.last[d])
        return np.where(inside, self.lost[d, np.where(inside, slot, 0)], np.int64(1) << 40)

    def score(self, n: int, m: int) -> int:
        return (self.match * (n + m) - int(self.at(n, m))) // 2

    def cigar(self, q: np.ndarray, t: np.ndarray, tail: int) -> str:
        """Of equal ways as ``_banded`` prefers: letters aligned, then an insertion, then a deletion; the first cost and the shortest gap."""
        ops: list[tuple[int, str]] = [(tail, "M")] if tail else []
        i, j = len(q), len(t)
        while i or j:
            step, op = 0, "M"
            back = np.arange(min(i, j) + 1)
            if len(back) > 1:
                here = self.at(i - back, j - back)
                a, b = q[i - back[:-1] - 1], t[j - back[:-1] - 1]
                short = np.where((a == 78) | (b == 78), 2 * self.match, np.where(a == b, 0, self.other))
                other = np.flatnonzero(here[:-1] != here[1:] + short)
                step = int(other[0]) if len(other) else len(back) - 1
            if not step:
                here = self.at(i, j)
                for op, most in (("I", i), ("D", j)):
                    size = np.arange(1, most + 1)
                    before = self.at(i - size, j) if op == "I" else self.at(i, j - size)
                    for o, e in self.gaps:
                        fits = np.flatnonzero(before + o + e * size == here)
                        if len(fits):
                            step = int(size[fits[0]])
                            break
                    if step:
                        break
            if ops and ops[-1][1] == op:
                ops[-1] = (ops[-1][0] + step, op)
            else:
                ops.append((step, op))
            i, j = i - (step if op != "D" else 0), j - (step if op != "I" else 0)
        return "".join(f"{k}{op}" for k, op in reversed(ops))


def _tables(part: list, match: int, mismatch: int, gaps) -> list[_Table]:
    """The tables of pairs in one band that holds all of theirs, by anti-diagonals.

    Costs are doubled and less the matches that both letters could have, so a match costs nothing. Cells behind
    a pair's own letters lead to none of its cells, so they may hold anything."""
    reach = [_reach(x[1], x[2], x[5]) for x in part]
    low, high = min(a for a, _ in reach), max(b for _, b in reach)
    n, m = max(len(x[1]) for x in part), max(len(x[2]) for x in part)
    other, any_n, costs = 2 * (match - mismatch), 2 * match, [(2 * o, 2 * e + match) for o, e in gaps]
    # each cell is reached by letters that differ and one gap
    most = other * min(n, m) + min(o + e * max(high, -low) for o, e in costs) + 2 * max(other, *(o + e for o, e in costs))
    small = most < 30_000 and other < 128
    kind, far = (np.int16, 30_000) if small else (np.int32, 1 << 29)
    q, t = np.zeros((n, len(part)), kind), np.zeros((m, len(part)), kind)  # t from its end on
    for b, x in enumerate(part):
        q[: len(x[1]), b], t[m - len(x[2]) :, b] = x[1], x[2][::-1]
    q_n, t_n = q == 78, t == 78
    with_n = bool(q_n.any() or t_n.any())
    if small:
        q, t = q << 7, t << 7
    d = np.arange(n + m + 1)
    first = np.maximum(np.maximum(0, d - m), -((high - d) // 2))
    last = np.minimum(np.minimum(d, n), (d - low) // 2)
    lost = np.empty((n + m + 1, int((last - first).max()) + 3, len(part)), kind)
    lost[0] = far
    lost[0, 1] = 0
    room = lost.shape[1:]
    ends = [[np.full(room, far, kind) for _ in range(2)] for _ in range(2 * len(gaps))]  # of insertions and deletions by cost: before and now
    opened, met = np.empty(room, kind), np.empty(room, kind)
    for s in range(1, n + m + 1):
        a, b = int(first[s]), int(last[s])
        size = b - a + 1
        row = lost[s]
        row[0] = row[size + 1] = far
        now, step = row[1 : size + 1], a - int(first[s - 1])
        left, width = lost[s - 1], int(last[s - 1] - first[s - 1]) + 3
        for g, (o, e) in enumerate(costs):
            free = np.add(left[:width], o + e, out=opened[:width])
            for k, (old, new) in enumerate(ends[2 * g : 2 * g + 2]):
                at = step + k  # an insertion (0) comes from the letter of the query before
                grown = np.add(old[at : at + size], e, out=new[1 : size + 1])
                np.minimum(grown, free[at : at + size], out=grown)
                new[0] = new[size + 1] = far
                if g + k:
                    np.minimum(now, grown, out=now)
                else:
                    now[:] = grown
                ends[2 * g + k].reverse()
        x, y = max(a, 1), min(b, s - 1)  # both letters are there
        if s > 1 and x <= y:
            at = x - 1 - int(first[s - 2]) + 1
            letters, places = slice(x - 1, y), slice(m - s + x, m - s + y + 1)
            short = met[: y - x + 1]
            if small:
                np.bitwise_xor(q[letters], t[places], out=short)
                np.minimum(short, other, out=short)
            else:
                short[:] = np.where(q[letters] == t[places], 0, other)
            if with_n:
                short[q_n[letters] | t_n[places]] = any_n
            short += lost[s - 2, at : at + y - x + 1]
            own = now[x - a : y - a + 1]
            np.minimum(own, short, out=own)
    return [_Table(lost[:, :, b], first, last, (match, other, costs)) for b in range(len(part))]


def difference_string(query: str, target: str, cigar: str) -> tuple[str, int, int]:
    """(cs, matches, edit distance) of an M/I/D/=/X alignment: ``:n`` equal, ``*tq`` replaced, ``+q`` inserted, ``-t`` deleted."""
    out, equal, matches, nm, i, j, size = [], 0, 0, 0, 0, 0, 0

    def flush():
        nonlocal equal
        if equal:
            out.append(f":{equal}")
            equal = 0

    for c in cigar:
        if c.isdigit():
            size = size * 10 + int(c)
            continue
        if c in "M=X":
            for a, b in zip(query[i : i + size], target[j : j + size]):
                if a == b:
                    equal += 1
                    matches += 1
                else:
                    flush()
                    out.append(f"*{b}{a}")
                    nm += 1
            i, j = i + size, j + size
        elif c == "I":
            flush()
            out.append("+" + query[i : i + size])
            i, nm = i + size, nm + size
        else:
            flush()
            out.append("-" + target[j : j + size])
            j, nm = j + size, nm + size
        size = 0
    flush()
    return "".join(out), matches, nm


def cs_to_cigar(cs: Column) -> Column:
    """The =, X, I, D operations of a difference string."""
    parts = F.regexp_extract_all(cs, F.lit(":[0-9]+|\\*[A-Za-z][A-Za-z]|\\+[A-Za-z]+|-[A-Za-z]+"), F.lit(0))
    from ..functions.seqexpr import cigar_text, merge_operations

    size = lambda x: F.when(x.startswith(":"), F.substring(x, F.lit(2), F.length(x)).try_cast("int")).when(x.startswith("*"), 1).otherwise(F.length(x) - 1)
    op = lambda x: F.when(x.startswith(":"), "=").when(x.startswith("*"), "X").when(x.startswith("+"), "I").otherwise("D")
    return cigar_text(merge_operations(F.transform(parts, lambda x: F.struct(size(x).alias("len"), op(x).alias("op")))))


_ALIGNED = T.StructType([T.StructField("score", T.LongType()), T.StructField("cigar", T.StringType()), T.StructField("cs", T.StringType()), T.StructField("matches", T.IntegerType()), T.StructField("nm", T.IntegerType())])


@F.arrow_udf(_ALIGNED)
def aligned(query: pa.Array, target: pa.Array) -> pa.Array:
    """Global alignment of two columns of strings; null if either is. Equal strings need no table."""
    pairs = list(zip(query.to_pylist(), target.to_pylist()))
    found = iter(align_pairs([x for x in pairs if None not in x]))
    out = []
    for q, t in pairs:
        if q is None or t is None:
            out.append(None)
            continue
        score, cigar = next(found)
        cs, matches, nm = difference_string(q, t, cigar)
        out.append({"score": score, "cigar": cigar, "cs": cs, "matches": matches, "nm": nm})
    return pa.array(out, pa.struct([("score", pa.int64()), ("cigar", pa.string()), ("cs", pa.string()), ("matches", pa.int32()), ("nm", pa.int32())]))


def anchored_ends(cigar: Column) -> Column:
    """Whether an alignment begins and ends with aligned letters."""
    return cigar.rlike("^[0-9]+[M=X]") & cigar.rlike("[M=X]\\z")


_GAPPED = T.StructType([T.StructField("query", T.StringType()), T.StructField("target", T.StringType())])
_TOLD = T.StructType([T.StructField("cigar", T.StringType()), T.StructField("cs", T.StringType()), T.StructField("matches", T.IntegerType()), T.StructField("nm", T.IntegerType())])


def gapped_pair(query: str, target: str, cigar: str) -> tuple[str, str]:
    """Both strings with a dash for each letter that the other has alone."""
    a, b, i, j = [], [], 0, 0
    for size, op in re.findall("([0-9]+)([MIDX=])", cigar):
        n = int(size)
        a.append("-" * n if op == "D" else query[i : i + n])
        b.append("-" * n if op == "I" else target[j : j + n])
        i, j = i + (op != "D") * n, j + (op != "I") * n
    return "".join(a), "".join(b)


@F.arrow_udf(_GAPPED)
def gapped(query: pa.Array, target: pa.Array, cigar: pa.Array) -> pa.Array:
    out = [None if None in x else dict(zip(("query", "target"), gapped_pair(*x))) for x in zip(query.to_pylist(), target.to_pylist(), cigar.to_pylist())]
    return pa.array(out, pa.struct([("query", pa.string()), ("target", pa.string())]))


def told_by_gaps(query: str, target: str) -> tuple[str, str, int, int]:
    """(CIGAR with M, I, D, difference string, matches, edit distance) of two gapped strings of one length."""
    a, b = (np.frombuffer(x.encode("ascii", "replace"), np.uint8) for x in (query, target))
    kind = np.where(a == 45, 2, np.where(b == 45, 1, 0))
    head = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]])) if len(kind) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(head, len(kind)))
    cigar = "".join(f"{n}{'MID'[k]}" for n, k in zip(sizes.tolist(), kind[head].tolist()))
    cs, matches, nm = difference_string(query.replace("-", ""), target.replace("-", ""), cigar)
    return cigar, cs, matches, nm


@F.arrow_udf(_TOLD)
def from_gapped(query: pa.Array, target: pa.Array) -> pa.Array:
    """``told_by_gaps`` for columns; null if either is."""
    out = [None if None in x else dict(zip(("cigar", "cs", "matches", "nm"), told_by_gaps(*x))) for x in zip(query.to_pylist(), target.to_pylist())]
    return pa.array(out, pa.struct([("cigar", pa.string()), ("cs", pa.string()), ("matches", pa.int32()), ("nm", pa.int32())]))


def widened_to_anchors(spans: DataFrame, ops: DataFrame, key: str, least: int = 7) -> DataFrame:
    """(key, q1, q2, p1, p2): each span (key, s, e) of a query widened on both sides to the nearest ``least``
    equal letters in a row, these included, with the same stretch of the path. One span a key.

    ops: ``operations`` with =, X, I, D. Spans without such letters on both sides are left out."""
    equal = ops.where((F.col("op") == "=") & (F.col("len") >= least)).select(key, F.col("p"), F.col("q"), F.col("len").cast("bigint").alias("n"))
    met = spans.join(equal, key)
    a, b = F.least(F.col("q") + F.col("n"), F.col("s")), F.greatest("q", "e")
    left = F.when(a >= F.col("q") + least, F.struct((a - least).alias("x"), (F.col("p") + a - least - F.col("q")).alias("p")))
    right = F.when(b <= F.col("q") + F.col("n") - least, F.struct((b + least).alias("x"), (F.col("p") + b + least - F.col("q")).alias("p")))
    ends = met.groupBy(key).agg(F.max(left).alias("l"), F.min(right).alias("r")).where("l is not null and r is not null")
    return ends.select(key, F.col("l.x").alias("q1"), F.col("r.x").alias("q2"), F.col("l.p").alias("p1"), F.col("r.p").alias("p2"))


# --- consensus ---------------------------------------------------------------------------------


@F.arrow_udf(T.ArrayType(T.StringType()))
def cluster_consensus(strings: pa.Array) -> pa.Array:
    """``consensus`` of arrays of strings; clusters are bounded in size before they get here."""
    return pa.array([consensus(x) if x else [] for x in strings.to_pylist()], pa.list_(pa.string()))


# --- alignment operations along the path ---------------------------------------------------------


def operations(alns: DataFrame, key: str, cigar: str, start: Column) -> DataFrame:
    """(key, i, op, len, p, q): operations with their offsets on path (from ``start`` on) and query (from 0 on)."""
    from ..functions import seqexpr as X

    path_size = lambda o: F.when(o["op"].isin("M", "=", "X", "D"), o["len"]).otherwise(0)
    query_size = lambda o: F.when(o["op"].isin("M", "=", "X", "I"), o["len"]).otherwise(0)
    first = F.struct(start.cast("bigint").alias("p"), F.lit(0).cast("bigint").alias("q"), F.filter(F.array(F.struct(F.lit("").alias("op"), F.lit(0).alias("len"), F.lit(0).cast("bigint").alias("p"), F.lit(0).cast("bigint").alias("q"))), lambda x: F.lit(False)).alias("out"))
    add = lambda a, o: F.struct(
        (a["p"] + path_size(o)).cast("bigint").alias("p"), (a["q"] + query_size(o)).cast("bigint").alias("q"), F.concat(a["out"], F.array(F.struct(o["op"].alias("op"), o["len"].alias("len"), a["p"].alias("p"), a["q"].alias("q")))).alias("out")
    )
    placed = alns.select(key, F.aggregate(X.cigar(F.col(cigar)), first, add, lambda a: a["out"]).alias("x"))
    return placed.select(key, F.posexplode("x").alias("i", "o")).select(key, "i", "o.op", "o.len", "o.p", "o.q")


def vertex_errors(ops: DataFrame, vertices: DataFrame, key: str) -> DataFrame:
    """(key, vid, ok, err): aligned and wrong letters of each alignment on each vertex (key, vid, off, len) of its path.

    Deleted and replaced letters count by the part on the vertex, inserted ones at the vertex they stand on."""
    at = F.greatest(F.col("p"), F.col("off"))
    end = F.least(F.col("p") + F.when(F.col("op") == "I", 0).otherwise(F.col("l")), F.col("off") + F.col("len"))
    rows = ops.withColumnRenamed("len", "l").join(vertices, key)
    inside = (F.col("op") == "I") & (F.col("p") >= F.col("off")) & (F.col("p") < F.col("off") + F.col("len"))
    part = F.when(F.col("op") == "I", F.when(inside, F.col("l")).otherwise(0)).otherwise(F.greatest(end - at, F.lit(0)))
    rows = rows.withColumn("n", part).where("n > 0")
    return rows.groupBy(key, "vid").agg(F.sum(F.when(F.col("op").isin("M", "="), F.col("n")).otherwise(0)).alias("ok"), F.sum(F.when(F.col("op").isin("X", "D", "I"), F.col("n")).otherwise(0)).alias("err"))


def homopolymer_indels(ops: DataFrame, refs: DataFrame, key: str, size: int = 3, run: int = 7) -> DataFrame:
    """The operations with drop: whether an indel of at most ``size`` letters stands before a run of more than ``run`` equal letters of the reference (key, ref), in whose letters p counts."""
    rows = ops.join(refs, key)
    indel = F.col("op").isin("I", "D") & (F.col("len") <= size)
    return rows.withColumn("drop", indel & (run_length(F.col("ref"), F.col("p").cast("int")) > run)).drop("ref")


def on_strand(placed: DataFrame, k: int) -> DataFrame:
    """Strings for ``reference_records`` from (name, contig, p1, p2, seq): the offsets of the last letter
    before and the first behind the strings' own letters in reading order.

    Where the first anchor lies behind the second one on the path, the string comes from the reverse
    strand: it is turned, begins with what was its end, and both offsets move to the anchors' other ends."""
    back = F.col("p1") > F.col("p2")
    start = F.when(back, F.col("p2") - (k - 1)).otherwise(F.col("p1"))
    end = F.when(back, F.col("p1") + (k - 1)).otherwise(F.col("p2"))
    return placed.select("name", "contig", start.alias("start"), (end + 1).alias("end"), (~back).alias("strand"), F.when(back, reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"))


def reference_records(strings: DataFrame, k: int) -> DataFrame:
    """SAM records of anchored strings on their reference path.

    strings: (name, contig, start, end, strand, seq), start and end as offsets of the first and
    behind the last anchored letter. Where start lies behind end both anchors come out alone;
    else the letters between them are skipped (N), or both are one block if they overlap."""
    seq, n = F.col("seq"), F.length("seq")
    head, tail = F.left(seq, F.lit(k)), F.right(seq, F.lit(k))
    gap = F.col("end") - F.col("start") - 2 * k
    record = lambda name, flag, pos, cigar, s: F.struct(name.alias("qname"), flag.cast("int").alias("flag"), pos.cast("bigint").alias("pos"), cigar.alias("cigar"), s.alias("seq"))
    block = F.lit(f"{k}M")
    split = F.array(
        record(F.concat("name", F.lit(".a1")), F.lit(0), F.col("start") - k + 2, block, head),
        record(F.concat("name", F.lit(".a2")), F.lit(0), F.col("end"), block, tail),
    )
    flag = F.when(F.col("strand"), 0).otherwise(16)
    whole = F.when(gap > 0, F.concat(block, gap.cast("string"), F.lit("N"), block)).otherwise(F.concat((gap + 2 * k).cast("string"), F.lit("M")))
    text = F.when(gap > 0, F.concat(head, tail)).otherwise(F.concat(F.expr(f"left(seq, cast(greatest({k} + `end` - `start` - {2 * k}, 0) as int))"), tail))
    joined = F.array(record(F.col("name"), flag, F.col("start") + 1, whole, text))
    return strings.where(n >= k).select("contig", F.inline(F.when(F.col("start") > F.col("end"), split).otherwise(joined)))
