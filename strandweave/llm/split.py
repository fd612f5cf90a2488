"""Items above a limit of tokens, cut into overlapping pieces at natural ends of text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .bpe import certain_cuts, encoder, token_bytes, vocabulary
from .encode import encode_batch

#: Bytes of a range of a long text; a performance parameter, pieces don't depend on it.
RANGE = 1 << 20
#: Fixed values of the rule: a text is encoded from line to line of a grid of so many bytes, where the line is moved
#: to the first certain cut behind it; if the halo holds none, the encoding is cut at the next character.
GRID, HALO = 1 << 14, 1 << 10
#: How good a cut is: between characters, at white space, at the end of a sentence, a line, a paragraph.
CHAR, WORD, SENTENCE, LINE, PARAGRAPH = range(5)
#: Tokens kept free in each piece: a token more or less at its ends, where words are cut.
SLACK = 4

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[np.frombuffer(b".!?", np.uint8)] = True


@dataclass(frozen=True)
class Budget:
    budget_id: int
    most: int
    overlap: int

    def __post_init__(self):
        # a window of cuts must hold a whole character, which has four tokens at most, and each piece must get beyond the one before
        if self.overlap < 0 or self.room < 18:
            raise ValueError("a piece must have room for 22 tokens beside its overlap")

    @property
    def room(self) -> int:
        """New tokens of a piece at most."""
        return self.most - self.overlap - SLACK

    @property
    def width(self) -> int:
        """Tokens of a window in which the best cut is taken."""
        return max(4, min(self.room // 3, self.room * 4 // 9 - 4))

    def pieces(self, total: int) -> int:
        """Pieces of a text of so many tokens, 1 for those within the limit."""
        return 1 if total <= self.most else -(-(total - self.overlap) // (self.room - self.width))

    def last(self, j: np.ndarray, total: int) -> np.ndarray:
        """The end of window j: cuts are spread evenly behind the overlap, so the first piece is as long as the others."""
        return self.overlap + j * (total - self.overlap) // self.pieces(total)


def grades(data: np.ndarray, ends: np.ndarray, last: bool) -> np.ndarray:
    """How good a cut at each of ``ends`` is; -1 inside a character. ``last``: the text ends with ``data``."""
    n = len(data)
    at = np.minimum(ends, n - 1)
    nxt = data[at]
    end = ends >= n
    out = np.where(((nxt & 0xC0) == 0x80) & ~end, -1, CHAR).astype(np.int8)
    back = lambda k: np.where(ends >= k, data[np.maximum(ends - k, 0)], 0)
    one, two, three = back(1), back(2), back(3)
    space_after = _SPACE[nxt] & ~end
    free = out >= 0
    out[free & (space_after | _SPACE[one])] = WORD
    wide = ((three == 0xE3) & (two == 0x80) & (one == 0x82)) | ((three == 0xEF) & (two == 0xBC) & ((one == 0x81) | (one == 0x9F)))
    out[free & ((_STOP[one] & (space_after | end)) | wide)] = SENTENCE
    line = (one == 10) & ((nxt != 10) | end)
    out[free & line] = LINE
    out[free & line & ((two == 10) | ((two == 13) & (three == 10)))] = PARAGRAPH
    if last and len(ends):
        out[ends == n] = PARAGRAPH
    return out


def best_cuts(grade: np.ndarray, budget: Budget, before: int, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(j, grade, cut) of each window that the tokens from number ``before`` on touch: the best cut in it, the last one of these.

    A cut is the number of tokens before it. Windows know nothing of each other, so a range of a
    text needs only the tokens before it and in the whole text."""
    n, pieces = len(grade), budget.pieces(total)
    j = np.arange(1, pieces)
    high = budget.last(j, total)
    low = high - budget.width
    touched = (high > before) & (low < before + n)
    j, high, low = j[touched], np.minimum(high[touched], before + n), np.maximum(low[touched], before)
    # the highest key wins: grade first, then the place
    key = grade.astype(np.int64) * (1 << 40) + np.arange(before + 1, before + n + 1)
    best = np.array([key[a:b].max() for a, b in zip((low - before).tolist(), (high - before).tolist())], np.int64)
    level = (best >> 40).astype(np.int32)
    return j, level, best - (level.astype(np.int64) << 40)


class Table:
    """Tokens of a stretch of text from grid line to grid line: where each ends, how good the cut there is, and
    behind which tokens the encoding was cut for want of a certain cut."""

    def __init__(self, body: bytes, first: int, at: int, stop: int, total: int, path: str, grid: int, halo: int, ids: np.ndarray | None = None):
        """``body`` begins at byte ``at`` of the text of ``total`` bytes; the stretch goes from the grid line ``first`` to ``stop``."""
        data = np.frombuffer(body, np.uint8)
        lines = [x for x in range(first, stop, grid)] + [min(stop, total)]
        places, forced = zip(*(self._line(data, x - at, x, total, path, halo) for x in lines))
        self.start, self.end = places[0], places[-1]
        if ids is not None:
            parts = [ids]
        else:
            parts = [encode_batch(pa.array([body[a:b].decode("utf-8", "replace")]), path)[0] for a, b in zip(places, places[1:])]
        self.sizes = token_bytes(path)[np.concatenate(parts)] if parts else np.zeros(0, np.int64)
        ends = self.start + np.cumsum(self.sizes)
        self.grade = grades(data, ends, at + self.end >= total)
        count = np.cumsum([len(p) for p in parts])
        self.forced = np.array([c for c, f in zip(np.concatenate([[0], count]).tolist(), forced) if f], np.int64)

    @staticmethod
    def _line(data: np.ndarray, x: int, line: int, total: int, path: str, halo: int) -> tuple[int, bool]:
        """Where the grid line ``line``, byte ``x`` of ``data``, comes to lie, and whether that is no certain cut."""
        if line == 0 or line >= total:
            return x, False
        low = max(0, x - 4)
        found = np.flatnonzero(certain_cuts(data[low : x + halo], path)[x - low :])
        if len(found):
            return x + int(found[0]), False
        while x < len(data) and data[x] & 0xC0 == 0x80:
            x += 1
        return x, True


def own_tokens(body: bytes, sizes: np.ndarray, forced: bool, path: str, begins: bool, ends: bool) -> int:
    """Tokens of a piece when it is encoded alone, from the lengths of its tokens in the whole text.

    A word that is cut between two of its tokens keeps them: no merge bridged the cut. What can
    change is how words are told apart: white space at the end no longer leaves its last letter to
    the next word, an apostrophe at the start may begin a contraction, and a cut of the encoding
    inside may fall away. Only there is anything encoded again."""
    n, encode = len(sizes), encoder(path).encode_ordinary
    if forced or (not begins and body[:1] == b"'"):
        return len(encode(body.decode("utf-8", "replace")))
    if ends or not body:
        return n
    if body[-1] >= 0x80 and body.decode("utf-8", "replace")[-1:].isspace():
        return len(encode(body.decode("utf-8", "replace")))
    kept = len(body.rstrip(b" \t\n\r\x0b\x0c"))
    if kept == len(body):
        return n
    starts = np.concatenate([[0], np.cumsum(sizes)])
    i = int(np.searchsorted(starts, kept))
    if starts[i] != kept or body[:kept].decode("utf-8", "replace")[-1:].isspace():
        return len(encode(body.decode("utf-8", "replace")))
    return i + len(encode(body[kept:].decode("utf-8", "replace")))


_PIECES = "budget_id int, id bigint, piece int, start bigint, end bigint, n_tokens int, text string"
_NAMES = ["budget_id", "id", "piece", "start", "end", "n_tokens", "text"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string())
    columns = list(zip(*rows)) if rows else [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=_NAMES)


def first_token(grade: np.ndarray, at: int) -> int:
    """The last place from ``at`` backwards that isn't inside a character; place 0 isn't."""
    while at > 0 and grade[at - 1] < 0:
        at -= 1
    return at


def whole_pieces(body: bytes, budget: Budget, path: str, grid: int, halo: int, table: Table | None = None) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of the pieces of a whole text, the first two in bytes; none for a text within the limit."""
    table = table or Table(body, 0, 0, len(body), len(body), path, grid, halo)
    total = len(table.sizes)
    if total <= budget.most:
        return []
    cuts = best_cuts(table.grade, budget, 0, total)[2].tolist()
    starts = np.concatenate([[0], np.cumsum(table.sizes)])
    out: list[tuple[int, int, int]] = []
    for a, b in zip([0, *(first_token(table.grade, c - budget.overlap) for c in cuts)], [*cuts, total]):
        x, y = int(starts[a]), int(starts[b])
        out += checked(body[x:y], x, table.sizes[a:b], bool(((table.forced > a) & (table.forced < b)).any()), budget, path, grid, halo, a == 0, b == total)
    return out


def checked(piece: bytes, x: int, sizes: np.ndarray, forced: bool, budget: Budget, path: str, grid: int, halo: int, begins: bool, ends: bool) -> list[tuple[int, int, int]]:
    """The piece at byte ``x`` with its own number of tokens. Should that be above the limit, it is cut like a text of its own."""
    n = own_tokens(piece, sizes, forced, path, begins, ends)
    if n <= budget.most:
        return [(x, x + len(piece), n)]
    again = whole_pieces(piece, budget, path, grid, halo)
    # encoded from grid line to grid line it may be within the limit: two halves then
    return [(x + a, x + b, k) for a, b, k in again] or halves(piece, x, budget, path, grid, halo)


def halves(piece: bytes, x: int, budget: Budget, path: str, grid: int, halo: int) -> list[tuple[int, int, int]]:
    middle = len(piece) // 2
    while middle < len(piece) and piece[middle] & 0xC0 == 0x80:
        middle += 1
    out = []
    for a, part in ((x, piece[:middle]), (x + middle, piece[middle:])):
        n = len(encoder(path).encode_ordinary(part.decode("utf-8", "replace")))
        out += [(a, a + len(part), n)] if n <= budget.most else halves(part, a, budget, path, grid, halo)
    return out


def split_texts(texts: DataFrame, budgets: list[Budget], path: str | None = None, size: int = RANGE, halo: int = HALO, grid: int = GRID) -> DataFrame:
    """(budget_id, id, piece, start, end, n_tokens, text): the pieces of each text above a budget.

    ``start`` and ``end`` are byte offsets; together the pieces cover the text, and each begins
    ``overlap`` tokens (of the text's own encoding) before the end of the one before, a few more
    where that is inside a character. ``n_tokens`` is the number of tokens that the piece has
    when it is encoded alone, and never above the limit. Texts within the limit, and null and
    empty ones, have no pieces; ids must be unique and not null, other rows are left out.

    One rule holds for every text: it has as many pieces as the evenly spread windows of
    ``Budget`` give, and each window is cut at its best place. A window needs the number of
    tokens before it and in all, and nothing of other windows. So texts of up to ``size`` bytes
    are cut where they are, and longer ones give the same pieces by ranges: each range, with a
    halo, encodes from its first grid line to the next range's and keeps its tokens as bytes
    beside its text; prefix sums over one number a range give the tokens before it; each range
    then names the best cut in each window it touches, cuts of the same window are compared, and
    pieces are emitted by offset from the ranges they lie in. No task but the one that reads a row
    holds a whole long text, or a table of its tokens. ``size`` is rounded up to whole grid lines;
    pieces don't depend on it.
    """
    path = path or vocabulary()
    size = -(-size // grid) * grid
    base = texts.select(F.col("id").cast("bigint").alias("id"), "text").where("id is not null and text is not null")
    least = min(b.most for b in budgets)
    # a token has at least one byte
    base = base.where(F.octet_length("text") > least)

    def whole(batches):
        for batch in batches:
            rows = []
            raw = [x.encode("utf-8") for x in batch.column("text").to_pylist()]
            short = pa.array([x.decode("utf-8") if len(x) <= grid else "" for x in raw], pa.string())
            ids, offsets = encode_batch(short, path)
            for i, body in enumerate(raw):
                own = ids[offsets[i] : offsets[i + 1]] if len(body) <= grid else None
                if own is not None and len(own) <= least:
                    continue
                table = Table(body, 0, 0, len(body), len(body), path, grid, halo, own)
                who = batch.column("id")[i].as_py()
                for b in budgets:
                    found = whole_pieces(body, b, path, grid, halo, table)
                    rows += [(b.budget_id, who, k, x, y, n, body[x:y].decode("utf-8", "replace")) for k, (x, y, n) in enumerate(found)]
            yield _batch(rows)

    short = base.where(F.octet_length("text") <= size).mapInArrow(whole, _PIECES)

    def cut_ranges(batches):
        """Each range with some bytes before it and its halo, as (id, no, at, total, body)."""
        names = ["id", "no", "at", "total", "body"]
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column("text")[i].as_py().encode("utf-8")
                for no, s in enumerate(range(0, len(raw), size)):
                    low = max(0, s - 4)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column("id")[i].as_py()], pa.int64()), pa.array([no], pa.int32()), pa.array([low], pa.int64()), pa.array([len(raw)], pa.int64()), pa.array([raw[low : s + size + halo + 4]], pa.binary())],
                        names=names,
                    )

    long = base.where(F.octet_length("text") > size)
    parts = long.mapInArrow(cut_ranges, "id bigint, no int, at bigint, total bigint, body binary").repartition("id", "no")

    def tables(batches):
        """Each range's own stretch with its tokens."""
        names = ["id", "no", "a", "bytes", "n", "sizes", "grade", "forced", "body"]
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("id", "no", "at", "total", "body")}
                t = Table(row["body"], row["no"] * size, row["at"], min((row["no"] + 1) * size, row["total"]), row["total"], path, grid, halo)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary())
                values = (row["id"], row["no"], row["at"] + t.start, row["total"], len(t.sizes), t.sizes.astype("<u2").tobytes(), t.grade.tobytes(), t.forced.tolist(), row["body"][t.start : t.end])
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

    own = cut(parts.mapInArrow(tables, "id bigint, no int, a bigint, bytes bigint, n bigint, sizes binary, grade binary, forced array<bigint>, body binary"))
    if own.isEmpty():
        return short
    # one row of a few numbers a range; a text has 2 GB at most, so 2048 ranges of the default size
    every = Window.partitionBy("id")
    before = F.coalesce(F.sum("n").over(every.orderBy("no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = cut(own.select("id", "no", "n", before.alias("before"), F.sum("n").over(every).alias("total")))
    placed = own.drop("n").join(sums, ["id", "no"])

    def name_cuts(batches):
        for batch in batches:
            rows: list[tuple] = []
            for who, grade, at, total in zip(*(batch.column(c).to_pylist() for c in ("id", "grade", "before", "total"))):
                for b in budgets:
                    j, level, place = best_cuts(np.frombuffer(grade, np.int8), b, at, total)
                    rows += [(b.budget_id, who, *x) for x in zip(j.tolist(), level.tolist(), place.tolist())]
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))], names=["budget_id", "id", "j", "level", "place"])

    named = placed.select("id", "grade", "before", "total").mapInArrow(name_cuts, "budget_id int, id bigint, j bigint, level int, place bigint")
    cuts = named.groupBy("budget_id", "id", "j").agg(F.max(F.struct("level", "place"))["place"].alias("c"))
    overlap = F.create_map(*(F.lit(x) for b in budgets for x in (b.budget_id, b.overlap)))
    limits = F.explode(F.array(*(F.struct(F.lit(b.budget_id).alias("budget_id"), F.lit(b.most).alias("most"), F.lit(b.overlap).alias("overlap"), F.lit(b.room - b.width).alias("step")) for b in budgets)))
    ends = sums.groupBy("id").agg(F.max("total").alias("total")).select("id", "total", limits.alias("b")).where("total > b.most")
    # each cut ends a piece and begins another; the text's own ends are the first and the last one
    halves_of = cuts.select("budget_id", "id", F.inline(F.array(
        F.struct((F.col("j") - 1).alias("k"), F.lit(None).cast("bigint").alias("s"), F.col("c").alias("e")),
        F.struct(F.col("j").alias("k"), (F.col("c") - overlap[F.col("budget_id")]).alias("s"), F.lit(None).cast("bigint").alias("e")),
    )))
    outer = ends.select("b.budget_id", "id", F.inline(F.array(
        F.struct(F.lit(0).cast("bigint").alias("k"), F.lit(0).cast("bigint").alias("s"), F.lit(None).cast("bigint").alias("e")),
        F.struct((F.ceil((F.col("total") - F.col("b.overlap")) / F.col("b.step")) - 1).alias("k"), F.lit(None).cast("bigint").alias("s"), F.col("total").alias("e")),
    )))
    pieces = cut(halves_of.unionByName(outer).groupBy("budget_id", "id", "k").agg(F.max("s").alias("s"), F.max("e").alias("e")))
    # the ranges of the first token (or the few before it, where it is inside a character) and of the last one
    points = pieces.select("id", "budget_id", "k", "s", "e", F.explode(F.array(F.greatest(F.col("s") - 3, F.lit(0)), F.col("e") - 1)).alias("p"))
    marks = sums.select("id", F.col("before").alias("p"), "no").where("n > 0")
    seen = points.unionByName(marks, allowMissingColumns=True).withColumn("no", F.last("no", True).over(every.orderBy("p", F.col("no").isNull()).rowsBetween(Window.unboundedPreceding, 0)))
    spread = seen.where("k is not null").groupBy("id", "budget_id", "k", "s", "e").agg(F.min("no").alias("first"), F.max("no").alias("last"))
    touched = spread.withColumn("no", F.explode(F.sequence("first", "last"))).groupBy("id", "no").agg(F.collect_list(F.struct("budget_id", "k", "s", "e")).alias("p"))
    kinds = {"budget_id": pa.int32(), "id": pa.int64(), "k": pa.int64(), "no": pa.int32(), "x": pa.int64(), "sizes": pa.binary(), "forced": pa.bool_(), "begins": pa.bool_(), "ends": pa.bool_(), "body": pa.binary()}

    def slices_of(batches):
        """The part of each piece that lies in the range."""
        for batch in batches:
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("id", "no", "a", "before", "total", "sizes", "grade", "forced", "body", "p")}
                sizes, grade, at = np.frombuffer(row["sizes"], "<u2"), np.frombuffer(row["grade"], np.int8), row["before"]
                starts = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
                forced = np.array(row["forced"], np.int64)
                for p in row["p"]:
                    begins_here = p["s"] >= at
                    a, b = first_token(grade, p["s"] - at) if begins_here and p["s"] < at + len(sizes) else 0, min(p["e"] - at, len(sizes))
                    if p["s"] >= at + len(sizes) or b <= a:
                        continue
                    x, y = int(starts[a]), int(starts[b])
                    # a cut at the range's own start is inside the piece if the piece comes from before
                    odd = bool(((forced > a) & (forced < b)).any() or (not begins_here and (forced == 0).any()))
                    rows.append((p["budget_id"], row["id"], p["k"], row["no"], row["a"] + x, sizes[a:b].tobytes(), odd, at + a == 0, at + b == row["total"], row["body"][x:y]))
            columns = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], names=list(kinds))

    sliced = placed.join(touched, ["id", "no"]).mapInArrow(slices_of, "budget_id int, id bigint, k bigint, no int, x bigint, sizes binary, forced boolean, begins boolean, ends boolean, body binary")
    joined = sliced.groupBy("budget_id", "id", "k").agg(F.sort_array(F.collect_list(F.struct("no", "x", "sizes", "forced", "begins", "ends", "body"))).alias("x"))
    by_id = {b.budget_id: b for b in budgets}

    def emit(batches):
        for batch in batches:
            rows = []
            for budget_id, who, k, own_parts in zip(*(batch.column(c).to_pylist() for c in ("budget_id", "id", "k", "x"))):
                body = b"".join(p["body"] for p in own_parts)
                sizes = np.frombuffer(b"".join(p["sizes"] for p in own_parts), "<u2").astype(np.int64)
                x = own_parts[0]["x"]
                found = checked(body, x, sizes, any(p["forced"] for p in own_parts), by_id[budget_id], path, grid, halo, own_parts[0]["begins"], own_parts[-1]["ends"])
                rows += [(budget_id, who, 0, a, b, n, body[a - x : b - x].decode("utf-8", "replace")) for a, b, n in found]
            yield _batch(rows)

    number = F.row_number().over(Window.partitionBy("budget_id", "id").orderBy("start", "end"))
    return short.unionByName(joined.mapInArrow(emit, _PIECES).withColumn("piece", number - 1))
