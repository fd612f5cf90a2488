"""Shortest substrings of reads that a panel lacks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from ..functions.codes import PANEL_END, READ_END, WORD, common_letters, symbols, window_words
from ..functions.letters import letters, ranges
from ..functions.lineage import cut
from ..functions.seqexpr import reverse_complement
from .intervals import islands
from .ordered import with_previous


def panel_words(panel: DataFrame, seq: str, longest: int) -> DataFrame:
    """(w): every distinct word of at most ``longest`` letters of both strands of the panel; A, C, G, T only."""
    strands = panel.select(F.explode(F.array(F.upper(seq), reverse_complement(F.upper(F.col(seq))))).alias("s"))
    starts = strands.where(F.length("s") > 0).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("s")), lambda i: F.substring("s", i, F.lit(longest)))).alias("x")).distinct()
    words = starts.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("x")), lambda n: F.substring("x", F.lit(1), n))).alias("w"))
    return words.where(F.translate("w", "ACGT", "") == "").distinct()


def minimal_absent(reads: DataFrame, panel: DataFrame, key: str, seq: str, longest: int) -> DataFrame:
    """(key, s, l): substrings of at most ``longest`` letters that the panel lacks on both strands while
    it holds both that are one letter shorter.

    The shortest absent length at each start is found by binary search over the lengths: as a
    word that is absent stays absent when it grows, each round is one join of the starts with the
    words of the panel. A start counts if the next start reaches at least as far behind.
    """
    held = panel_words(panel, seq, longest).withColumn("has", F.lit(True))
    text = F.upper(F.col(seq))
    starts = reads.where(F.length(seq) > 0).select(
        key, F.posexplode(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(longest)))).alias("s", "x")
    )
    # lo letters are present, hi letters are absent or too many
    state = starts.withColumn("lo", F.lit(0)).withColumn("hi", F.length("x") + 1)
    for _ in range(longest.bit_length()):
        mid = F.when(F.col("hi") - F.col("lo") > 1, ((F.col("lo") + F.col("hi")) / 2).cast("int"))
        asked = state.withColumn("mid", mid).withColumn("w", F.substring("x", F.lit(1), F.col("mid")))
        met = asked.join(held, "w", "left")
        state = met.select(
            key, "s", "x",
            F.when(F.col("mid").isNotNull() & F.col("has").isNotNull(), F.col("mid")).otherwise(F.col("lo")).alias("lo"),
            F.when(F.col("mid").isNotNull() & F.col("has").isNull(), F.col("mid")).otherwise(F.col("hi")).alias("hi"),
        )
    return _minimal(state.select(key, "s", F.when(F.col("hi") <= F.length("x"), F.col("hi")).alias("l")), key)


def _minimal(least: DataFrame, key: str) -> DataFrame:
    """(key, s, l) of the shortest absent lengths l of all starts, null for none, that no later start reaches within."""
    back = least.withColumn("__back", -F.col("s"))
    follow = with_previous(back, key, ["__back"], ["l"], TILE, "__next").withColumn("n", F.col("__next.l"))
    return follow.where("l is not null and (l = 1 or n is null or n >= l)").select(key, "s", "l")


#: Places of a sequence in one row of a search.
TILE = 1 << 16


def _tiles(df: DataFrame, seq: str, keep: list[str], width: int) -> DataFrame:
    """Long sequences in tiles that overlap by ``width``: (keep..., t, body, rest), rest being the letters from the tile's start on."""
    n = F.length(seq)
    rows = df.where(n > 0).select(*keep, F.col(seq).alias("__s"), n.alias("__n"), F.explode(F.sequence(F.lit(0), F.floor((n - 1) / TILE).cast("int"))).alias("t"))
    body = F.when(F.col("__n") <= TILE + width, F.substr("__s", F.col("t") * TILE + 1)).otherwise(F.substr("__s", F.col("t") * TILE + 1, F.lit(TILE + width)))
    return rows.select(*keep, "t", body.alias("body"), (F.col("__n") - F.col("t") * TILE).alias("rest"))


def _windows(tiles: DataFrame, key: str | None, kind: str, words: int, starts: bool = False) -> DataFrame:
    """Windows of ``words`` words from each place of the tiles on (or from the places in ``at``): (c0..., key, s, n)."""
    names = [*(f"c{w}" for w in range(words)), "key", "s", "n"]

    def work(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                codes, offsets = letters(batch.column("body"))
                own = symbols(codes, key is None)
                size = np.diff(offsets)
                rest = batch.column("rest").to_numpy().astype(np.int64)
                if starts:
                    lists = batch.column("at")
                    row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
                    place = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                else:
                    count = np.minimum(size, TILE)
                    row = np.repeat(np.arange(batch.num_rows), count)
                    place = ranges(np.zeros(len(count), np.int64), count)
                at = offsets[row] + place
                if key is None:  # only true letters begin a match
                    true = own[at] < 5
                    row, place, at = row[true], place[true], at[true]
                ends = offsets[row] + np.minimum(rest[row], size[row])
                for a in range(0, len(at), 1 << 20):
                    z = slice(a, a + (1 << 20))
                    found = window_words(own, ends[z], at[z], words, PANEL_END if key is None else READ_END)
                    who = pa.nulls(len(at[z]), arrow) if key is None else batch.column("key").take(pa.array(row[z]))
                    s = place[z] + batch.column("t").to_numpy().astype(np.int64)[row[z]] * TILE
                    n = rest[row[z]] - place[z]
                    yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in found), who, pa.array(s.astype(np.int32)), pa.array((n if key is not None else n * 0 - 1).astype(np.int32))], names=names)

    arrow = to_arrow_type(_parse_datatype_string(kind))
    return tiles.mapInArrow(work, ", ".join(f"c{w} bigint" for w in range(words)) + f", key {kind}, s int, n int")


def _matches(mixed: DataFrame, kind: str, words: int) -> DataFrame:
    """(key, s, n, m): for each read's window how many letters it has in common with the panel's nearest windows in order.

    All windows are range-partitioned and sorted; equal ones are spread by a hash, so no letters are
    a partition's fate. The longest match of a window is the longer of those with the nearest panel
    windows before and behind it. Partitions tell their first and last panel window, so rows at
    their borders find their neighbours in a table of two rows a partition."""
    spark = mixed.sparkSession
    cols = [f"c{w}" for w in range(words)]
    arrow = to_arrow_type(_parse_datatype_string(kind))
    ordered = mixed.repartitionByRange(*cols, F.xxhash64("key", "s")).sortWithinPartitions(*cols)
    names = ["key", "s", "n", "m", "open", *cols]

    def rows(table, m, open_, at):
        """Results; only rows that still lack a neighbour, and border rows of the panel, keep their window."""
        return pa.RecordBatch.from_arrays([table["key"].take(pa.array(at)), pa.array(table["s"][at]), pa.array(table["n"][at]), pa.array(m.astype(np.int32)), pa.array(open_), *(pa.array(table[c][at], mask=~open_) for c in cols)], names=names)

    def scan(batches):
        held, last, first_seen = [], None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if not (batch.column("n").to_numpy() < 0).any():
                continue
            table, held, last_new = take(held)
            yield from resolve(table, last, True, not first_seen)
            last, first_seen = last_new, True
        if held:
            yield from resolve(load(held), last, False, False)
        if last is not None:
            yield border(last)

    def load(parts):
        t = pa.Table.from_batches(parts).combine_chunks()
        out = {c: t.column(c).to_numpy() for c in [*cols, "s", "n"]}
        out["key"] = t.column("key").combine_chunks() if t.column("key").num_chunks != 1 else t.column("key").chunk(0)
        return out

    def take(parts):
        """The rows up to the last panel row, those behind it, and that row."""
        at = int(np.flatnonzero(parts[-1].column("n").to_numpy() < 0)[-1]) + 1
        head, tail = parts[-1].slice(0, at), parts[-1].slice(at)
        table = load([*parts[:-1], head])
        return table, [tail] if tail.num_rows else [], [table[c][-1:].copy() for c in cols]

    def border(own):
        one = np.ones(1, bool)
        return pa.RecordBatch.from_arrays([pa.nulls(1, arrow), pa.array(np.zeros(1, np.int32)), pa.array(np.full(1, -1, np.int32)), pa.array(np.zeros(1, np.int32)), pa.array(one), *(pa.array(x) for x in own)], names=names)

    def resolve(table, last, closed, first):
        panel = table["n"] < 0
        size = len(panel)
        place = np.arange(size)
        before = np.maximum.accumulate(np.where(panel, place, -1))
        behind = size - 1 - np.maximum.accumulate(np.where(panel[::-1], place, -1))[::-1]
        mine = np.flatnonzero(~panel)
        own = [table[c][mine] for c in cols]
        m = np.zeros(len(mine), np.int64)
        has = before[mine] >= 0
        near = [np.where(has, table[c][before[mine]], last[w] if last is not None else 0) for w, c in enumerate(cols)]
        lacks = ~has & (last is None)
        m = np.where(lacks, m, common_letters(own, near))
        if closed:
            m = np.maximum(m, common_letters(own, [table[c][behind[mine]] for c in cols]))
        else:
            lacks = np.ones(len(mine), bool)
        yield rows(table, m, lacks, mine)
        if first and panel.any():
            at = int(np.flatnonzero(panel)[0])
            yield border([table[c][at : at + 1] for c in cols])

    schema = f"key {kind}, s int, n int, m int, open boolean, " + ", ".join(f"{c} bigint" for c in cols)
    found = cut(ordered.mapInArrow(scan, schema))
    # two rows a partition
    ends = sorted({tuple(r) for r in found.where("n < 0").select(*cols).collect()})
    held = spark.sparkContext.broadcast(ends)
    done = found.where("n >= 0 and not open").select("key", "s", "n", "m")
    if not ends:
        return done.unionByName(found.where("n >= 0 and open").select("key", "s", "n", "m"))

    def close(batches):
        edge = np.array(held.value, np.int64).reshape(-1, words)
        order = np.empty(len(edge), dtype=[(c, np.int64) for c in cols])
        for w, c in enumerate(cols):
            order[c] = edge[:, w]
        for batch in batches:
            own = [batch.column(c).to_numpy() for c in cols]
            if not batch.num_rows:
                continue
            asked = np.empty(batch.num_rows, dtype=order.dtype)
            for w, c in enumerate(cols):
                asked[c] = own[w]
            at = np.searchsorted(order, asked)
            m = batch.column("m").to_numpy().astype(np.int64)
            for near, ok in ((at - 1, at > 0), (np.minimum(at, len(edge) - 1), at < len(edge))):
                m = np.maximum(m, np.where(ok, common_letters(own, [edge[near, w] for w in range(words)]), 0))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("s"), batch.column("n"), pa.array(m.astype(np.int32))], names=["key", "s", "n", "m"])

    rest = found.where("n >= 0 and open").mapInArrow(close, f"key {kind}, s int, n int, m int")
    return done.unionByName(rest)


def longest_matches(reads: DataFrame, panel: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, s, n, m): for each place s of each read, with n letters from there on, how many of these occur in a row in the panel, on either strand.

    Windows of 21 letters settle nearly all places. Those that match as a whole go on with windows
    of twice the length, until none is left. Nothing is bounded but by the texts; each round is
    one sort of the places left and of the panel's windows."""
    kind = reads.schema[key].dataType.simpleString()
    strands = panel.where(F.length(seq) > 0).select(F.explode(F.array(F.col(seq), reverse_complement(F.col(seq)))).alias("x"))
    texts = reads.where(F.col(key).isNotNull() & (F.length(seq) > 0)).select(F.col(key).alias("key"), F.col(seq).alias("x"))
    words, own, done = 1, None, None
    while True:
        width = words * WORD
        pieces = _windows(_tiles(strands, "x", [], width), None, kind, words)
        tiles = _tiles(texts, "x", ["key"], width)
        if own is not None:
            tiles = tiles.join(own, ["key", "t"])
        mixed = _windows(tiles, "key", kind, words, own is not None).unionByName(pieces)
        found = _matches(mixed, kind, words)
        settled = F.col("m") < F.least(F.lit(width), "n")
        over = found.where(settled | (F.col("n") <= width))
        done = over if done is None else done.unionByName(over)
        rest = found.where(~settled & (F.col("n") > width))
        if rest.isEmpty():
            return done.withColumnRenamed("key", key)
        own = rest.select("key", F.floor(F.col("s") / TILE).cast("int").alias("t"), (F.col("s") % TILE).alias("p")).groupBy("key", "t").agg(F.array_sort(F.collect_list("p")).alias("at"))
        words *= 2


def minimal_absent_whole(reads: DataFrame, panel: DataFrame, key: str, seq: str) -> DataFrame:
    """As ``minimal_absent``, with no bound on the length and no bound on the panel.

    The shortest absent string from a place on has one letter more than its longest match; it counts
    if the one from the next place on reaches at least as far."""
    found = longest_matches(reads, panel, key, seq)
    least = found.select(key, "s", F.when(F.col("m") < F.col("n"), F.col("m") + 1).alias("l"))
    return _minimal(least, key)


_CODE = np.zeros(256, np.int64)
for _i, _c in enumerate(b"ACGT"):
    _CODE[_c] = _CODE[_c + 32] = _i + 1
#: Codes of what ends a match, different on both sides.
_PANEL_END, _READ_END = 5, 6


def panel_codes(sequences: list[str]) -> np.ndarray:
    """Both strands of all sequences, one after another, as letter codes with ends between them."""
    parts = []
    for s in sequences:
        own = _CODE[np.frombuffer(s.encode("ascii", "replace"), np.uint8)]
        for strand in (own, np.where(own > 0, 5 - own, 0)[::-1]):
            parts += [np.where(strand > 0, strand, _PANEL_END), [_PANEL_END]]
    return np.concatenate(parts).astype(np.int64) if parts else np.array([_PANEL_END])


def matches_in_memory(panel: np.ndarray, reads: np.ndarray, longest: int) -> np.ndarray:
    """For each position of the reads, how many letters from there on occur in the panel, up to ``longest``.

    Suffixes of both are ranked together by prefix doubling. The longest match of a suffix is the
    longer of those with the nearest panel suffixes before and behind it; its length is read off
    the ranks of all doubling rounds, from the longest prefix to the shortest.
    """
    ranks = [np.concatenate([panel, reads])]
    n = len(ranks[0])
    for j in range(max(1, int(longest).bit_length())):
        r, width = ranks[-1], 1 << j
        after = np.zeros(n, np.int64)
        after[: max(0, n - width)] = r[width:] + 1
        ranks.append(np.unique(r * (n + 8) + after, return_inverse=True)[1].astype(np.int64))
    order = np.argsort(ranks[-1], kind="stable")
    is_panel = order < len(panel)
    place = np.arange(n)
    before = np.maximum.accumulate(np.where(is_panel, place, -1))
    behind = n - 1 - np.maximum.accumulate(np.where(is_panel[::-1], place, -1))[::-1]
    mine = np.flatnonzero(~is_panel)
    own = order[mine]
    out = np.zeros(len(reads), np.int64)
    for near, ok in ((before[mine], before[mine] >= 0), (behind[mine], behind[mine] < n)):
        a, b = own[ok].copy(), order[near[ok]]
        size = np.zeros(len(a), np.int64)
        for j in reversed(range(len(ranks))):
            same = ranks[j][np.minimum(a, n - 1)] == ranks[j][np.minimum(b, n - 1)]
            same &= (a < n) & (b < n)
            step = same * (1 << j)
            size += step
            a, b = a + step, b + step
        to = own[ok] - len(panel)
        out[to] = np.maximum(out[to], size)
    return out


def minimal_absent_any(reads: DataFrame, panel: DataFrame, key: str, seq: str, most_letters: int = 1 << 23) -> DataFrame:
    """As ``minimal_absent``, with no bound on the length; the panel goes to all tasks.

    Its size is checked first; a panel of more than ``most_letters`` raises, and the bounded
    search by joins is the way then. Letters other than A, C, G, T are absent from any panel."""
    size = panel.agg(F.sum(F.length(seq))).first()[0] or 0
    if size > most_letters:
        raise ValueError(f"the panel has {size} letters, {most_letters} are allowed here. Use minimal_absent")
    held = reads.sparkSession.sparkContext.broadcast(panel_codes([r[0] for r in panel.where(F.col(seq).isNotNull()).select(seq).collect()]))

    def work(batches):
        ids, texts, letters = [], [], 0
        for b in batches:
            ids += b.column(key).to_pylist()
            texts += b.column(seq).to_pylist()
            letters = sum(map(len, texts))
            if letters >= 1 << 20:
                yield found(ids, texts)
                ids, texts = [], []
        if ids:
            yield found(ids, texts)

    def found(ids, texts):
        own = [_CODE[np.frombuffer(t.encode("ascii", "replace"), np.uint8)] for t in texts]
        size = np.array([len(t) for t in own])
        flat = np.concatenate([np.append(np.where(t > 0, t, _READ_END), _READ_END) for t in own])
        starts = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
        row = np.repeat(np.arange(len(own)), size + 1)
        place = np.arange(len(flat)) - starts[row]
        n = matches_in_memory(held.value, flat, int(size.max()))
        absent = np.where(place + n < size[row], n + 1, 0)  # 0: all that is left of the read occurs
        follow = np.append(absent[1:], 0)
        hit = np.flatnonzero((absent > 0) & ((absent == 1) | (follow == 0) | (follow >= absent)))
        return pa.RecordBatch.from_arrays([pa.array([ids[i] for i in row[hit].tolist()], kind_of_key), pa.array(place[hit].astype(np.int32)), pa.array(absent[hit].astype(np.int32))], names=[key, "s", "l"])

    kind_of_key = to_arrow_type(reads.schema[key].dataType)
    return reads.where(F.length(seq) > 0).select(key, seq).mapInArrow(work, f"{key} {reads.schema[key].dataType.simpleString()}, s int, l int")


def assemble(found: DataFrame, key: str) -> DataFrame:
    """(key, s, l): strings of a read that share a position, as one; those that only touch stay apart."""
    spans = found.select(F.col(key).alias("key"), F.col("s").cast("bigint").alias("s"), (F.col("s") + F.col("l")).cast("bigint").alias("e"))
    return islands(spans).select(F.col("key").alias(key), F.col("s").cast("int").alias("s"), (F.col("e") - F.col("s")).cast("int").alias("l"))
