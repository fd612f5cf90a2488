"""Near-duplicates among many short texts that hang on a common anchor.

Texts are compared as sets of canonical k-mers. Rows meet in blocks, one for each anchor; the
rows of a crowded anchor meet in blocks of (anchor, k-mer), for the k-mers of each set that come
first in a random order: two sets with a Jaccard index of at least t have their first common
k-mer among the first (1 - t) n + 1 of both, so no pair is lost.

In a block, sets are bitmaps kept vertically: bit plane b holds bit b of 64 rows a word. One row
is compared with 64 others at once by carry-save counters over the planes, and is given up as
soon as all 64 distances exceed the radius. Two bitmaps differ in at most |A u B| - |A n B| bits,
so the radius (a + b)(1 - t) / (1 + t) loses no pair either; what is left is counted exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.letters import chunks, letters, ranges, row_of
from ..functions.lineage import cut
from ..operators.graph import components
from ..operators.skew import CROWDED as SHARED
from ..operators.skew import join_counted, join_to_unique
from .records import slices

#: Bits of the bitmap of a set.
BITS = 512
#: Bits after which rows out of reach are given up.
STEP = 64
#: Crowded keys are fewer than this, as the limit of rows grows with the table beyond CELLS * CROWDED rows; it is the bound on what is broadcast.
CELLS = 1 << 20
#: Rows of one key from which its block is split.
CROWDED = 16_384
#: Bits of the number of a part of a block.
PART = 21
#: Rows worked on at once, at least.
ROWS = 8_192

_CODE = np.full(256, 4, np.uint8)
for _i, _pair in enumerate((b"Aa", b"Cc", b"Gg", b"Tt")):
    _CODE[list(_pair)] = _i
_ALL = ~np.uint64(0)
_ONE = np.uint64(1)


def kmer_sets(codes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, k-mer) of the distinct canonical k-mers (2-bit codes, k at most 31) of each text, sorted.

    k-mers with other letters than A, C, G, T (case ignored) are left out."""
    if len(codes) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    small = _CODE[codes] if codes.dtype == np.uint8 else np.where(codes < 128, _CODE[np.minimum(codes, 127)], 4)
    f1 = small.astype(np.int64)
    r1 = 3 - f1
    powers, n = [(f1, r1)], 1
    while n * 2 <= k:
        f, r = powers[-1]
        powers.append(((f[:-n] << 2 * n) | f[n:], (r[n:] << 2 * n) | r[:-n]))
        n *= 2
    fwd = rev = None
    at = 0
    for p in reversed(range(len(powers))):
        size = 1 << p
        if k & size:
            f, r = (x[at:] for x in powers[p])
            if fwd is None:
                fwd, rev = f, r
            else:
                m = min(len(f), len(fwd))
                fwd, rev = (fwd[:m] << 2 * size) | f[:m], (r[:m] << 2 * at) | rev[:m]
            at += size
    m = len(codes) - k + 1
    odd = np.concatenate([[0], np.cumsum(small == 4)])
    row = row_of(offsets)
    ok = (odd[k:] == odd[:-k]) & (np.arange(m) + k <= offsets[1:][row[:m]])
    key = np.minimum(fwd[:m], rev[:m])[ok]
    row = row[:m][ok]
    if 2 * k + int(row[-1] if len(row) else 0).bit_length() < 63:
        both = np.sort((row << 2 * k) | key)
        both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
        return both >> 2 * k, both & ((1 << 2 * k) - 1)
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return row[new], key[new]


def scramble(kmer: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64 bits, for the random order and for the bits of the bitmap."""
    x = kmer.astype(np.uint64)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def _add(a, b, c):
    """Carry-save addition of three words bit by bit: (sum, carry)."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def candidates(planes: np.ndarray, bits: np.ndarray, size: np.ndarray, block_end: np.ndarray, t: float, part: int = 1 << 14):
    """Pairs (i, j), i < j < block_end[i], whose bitmaps are within the radius; rows are sorted by size within a block.

    planes: [BITS, words] words of 64 rows each; bits: [BITS, rows] 0 or 1; size: of each row's set.
    """
    n = len(size)
    rows = np.flatnonzero((size > 0) & (block_end > np.arange(n) + 1))
    first, last = (rows + 1) >> 6, (block_end[rows] - 1) >> 6
    count = last - first + 1
    word_size = np.zeros((planes.shape[1] * 64,), np.int64)
    word_size[:n] = size
    least_size = np.where(word_size == 0, np.int64(1) << 40, word_size).reshape(-1, 64).min(axis=1)
    top_size = word_size.reshape(-1, 64).max(axis=1)
    step = max(1, (part * 4) // max(1, int(count.max(initial=1))))
    out_i, out_j = [], []
    for lo in range(0, len(rows), step):
        q = np.repeat(rows[lo : lo + step], count[lo : lo + step])
        w = ranges(first[lo : lo + step], count[lo : lo + step])
        # sizes too far apart, whatever the common part is: |A n B| <= min(a, b)
        near = least_size[w] * t <= size[q]
        q, w = q[near], w[near]
        for at in range(0, len(q), part):
            i, j = _within(planes, bits, q[at : at + part], w[at : at + part], size, top_size, block_end, t)
            out_i.append(i)
            out_j.append(j)
    if not out_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_i), np.concatenate(out_j)


def _within(planes, bits, q, w, size, top_size, block_end, t):
    """The pairs among rows q and the 64 rows of words w, by vertical counters."""
    if not len(q):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # rows of the word that come after q and belong to its block
    low = np.clip(q + 1 - (w << 6), 0, 63).astype(np.uint64)
    high = np.clip(block_end[q] - (w << 6), 1, 64)
    alive = (_ALL << low) & (_ALL >> (64 - high).astype(np.uint64))
    radius = np.floor((size[q] + top_size[w]) * ((1 - t) / (1 + t)) + 1e-9).astype(np.int64)
    count: list[np.ndarray] = []  # counter planes, lowest bit first

    def add(plane, level):
        """A carry of weight 2^level ripples up."""
        while level < len(count):
            count[level], plane = count[level] ^ plane, count[level] & plane
            level += 1
        count.append(plane)

    for start in range(0, BITS, STEP):
        held: list[list[np.ndarray]] = [[] for _ in range(12)]
        for b in range(start, start + STEP):
            held[0].append(planes[b][w] ^ (np.uint64(0) - bits[b][q].astype(np.uint64)))
            level = 0
            while len(held[level]) == 3:
                s, c = _add(*held[level])
                held[level] = [s]
                held[level + 1].append(c)
                level += 1
        for level, rest in enumerate(held):
            for plane in rest:
                while len(count) < level:
                    count.append(np.zeros(len(q), np.uint64))
                add(plane, level)
        # counter > radius, from the highest bit down
        more, same = np.zeros(len(q), np.uint64), np.full(len(q), _ALL)
        for level in reversed(range(max(len(count), int(radius.max()).bit_length()))):
            bit = np.uint64(0) - (radius >> level & 1).astype(np.uint64)
            c = count[level] if level < len(count) else np.zeros(len(q), np.uint64)
            more |= same & c & ~bit
            same &= ~(c ^ bit)
        alive &= ~more
        keep = np.flatnonzero(alive)
        if not len(keep):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(keep) < 0.8 * len(q):
            q, w, alive, radius = q[keep], w[keep], alive[keep], radius[keep]
            count = [c[keep] for c in count]
    lanes = np.unpackbits(alive.view(np.uint8).reshape(len(alive), 8), axis=1, bitorder="little")
    task, lane = np.nonzero(lanes)
    return q[task], (w[task] << 6) + lane


def _common(i, j, row_start, size, kmer, row, k, token):
    """For each pair the number of common k-mers, and the least scrambled one (for blocks by k-mer)."""
    keys = (row << 2 * k) | kmer  # sorted: rows ascend, and k-mers within a row
    n = np.zeros(len(i), np.int64)
    least = np.full(len(i), _ALL)
    step = max(1, (1 << 21) // max(1, int(size.max(initial=1))))
    for lo in range(0, len(i), step):
        a, b = i[lo : lo + step], j[lo : lo + step]
        swap = size[a] > size[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        own = np.repeat(np.arange(len(a)), size[a])
        mine = kmer[ranges(row_start[a], size[a])]
        wanted = (b[own] << 2 * k) | mine
        at = np.searchsorted(keys, wanted)
        hit = keys[np.minimum(at, len(keys) - 1)] == wanted
        n[lo : lo + step] = np.bincount(own[hit], minlength=len(a))
        if token:
            np.minimum.at(least, lo + own[hit], scramble(mine[hit]))
    return n, np.where(least == 0, _ALL, least)


def block_pairs(table: pa.Table, k: int, t_num: int, t_den: int):
    """Pairs of ids in a table whose blocks are complete, sorted by block: ids, smaller first."""
    block = table.column("block").to_numpy()
    text = table.column("text").combine_chunks()
    ids = table.column("id").to_numpy()
    codes, offsets = letters(text)
    row, kmer = kmer_sets(codes, offsets, k)
    size = np.bincount(row, minlength=len(ids))
    # blocks in order, rows of one block by size
    order = np.lexsort((ids, size, block))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    row = place[row]
    resort = np.argsort(row, kind="stable")
    row, kmer = row[resort], kmer[resort]
    size, block, ids = size[order], block[order], ids[order]
    take = lambda c: table.column(c).to_numpy(zero_copy_only=False)[order]
    anchor, token, cell, part = take("anchor"), take("token").view(np.uint64), take("cell"), take("part")
    v1, v2 = take("v1"), take("v2")
    n = len(ids)
    end_of = np.append(np.flatnonzero(block[1:] != block[:-1]) + 1, n)
    block_end = end_of[np.searchsorted(end_of, np.arange(n), side="right")]
    words = (n + 63) // 64
    grid = np.zeros((n, BITS), np.uint8)
    grid[row, (scramble(kmer) & np.uint64(BITS - 1)).astype(np.int64)] = 1
    bits = np.ascontiguousarray(grid.T)
    padded = np.zeros((BITS, words * 64), np.uint8)
    padded[:, :n] = bits
    planes = np.packbits(padded, axis=1, bitorder="little").view(np.uint64)
    t = t_num / t_den
    i, j = candidates(planes, bits, size, block_end, t)
    # blocks of hashed keys may hold several true ones
    fine = (anchor[i] == anchor[j]) & (token[i] == token[j]) & (cell[i] == cell[j]) & (ids[i] != ids[j])
    # a split block compares part x with part y only, and x with itself only where the cell is (x, x)
    x, y = cell[i] >> PART, cell[i] & ((1 << PART) - 1)
    pi, pj = part[i], part[j]
    fine &= (np.minimum(pi, pj) == np.minimum(x, y)) & (np.maximum(pi, pj) == np.maximum(x, y))
    i, j = i[fine], j[fine]
    row_start = np.concatenate([[0], np.cumsum(size)])[:-1]
    by_token = bool((token != 0).any())
    common, least = _common(i, j, row_start, size, kmer, row, k, by_token)
    hit = (common * (t_den + t_num) >= t_num * (size[i] + size[j])) & (common > 0)
    # of the anchors that both have, the least one reports the pair; of the common k-mers, the first one
    far = np.int64(np.iinfo(np.int64).max)
    shared = lambda v, other: np.where(other, v, far)
    a1, a2, b1, b2 = v1[i], v2[i], v1[j], v2[j]
    lowest = np.minimum(shared(a1, (a1 == b1) | (a1 == b2)), shared(a2, (a2 == b1) | (a2 == b2)))
    hit &= anchor[i] == lowest
    if by_token:
        hit &= (token[i] == 0) | (token[i] == least)
    a, b = ids[i[hit]], ids[j[hit]]
    return np.minimum(a, b), np.maximum(a, b)


def _base(rows: DataFrame) -> DataFrame:
    base = rows.select("id", "v1", "v2", "text").where("id is not null and text is not null and (v1 is not null or v2 is not null)")
    return base.select("id", F.coalesce("v1", "v2").alias("v1"), F.coalesce("v2", "v1").alias("v2"), "text")


def further_copies(rows: DataFrame, shared: int = SHARED) -> DataFrame:
    """(id, rep): rows whose text (case ignored) and pair of anchors another row of a lower id has too, with the lowest of these.

    Hashes find the few rows that may have a copy, the texts themselves decide. A class of copies is
    never gathered, and one of over ``shared`` rows isn't shuffled by its text."""
    base = _base(rows).select("id", F.least("v1", "v2").alias("low"), F.greatest("v1", "v2").alias("high"), F.upper("text").alias("u"))
    key, whole = ["low", "high", "h"], ["low", "high", "u"]
    hashed = base.withColumn("h", F.xxhash64("u"))
    likely = cut(hashed.select(*key).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    met = cut(join_counted(hashed, likely, key, "left_semi", crowded=shared).select("id", *whole))
    lowest = cut(met.groupBy(*whole).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    return join_counted(met, lowest, whole, crowded=shared).where("id <> rep").select("id", "rep")


def _crowds(df: DataFrame, key: list[str], crowded: int) -> DataFrame | None:
    """(key..., parts): the keys of more rows than the limit and the parts they are split into; None if there are none.

    The limit is ``crowded``, or one CELLS-th of all rows where that is more, so there are fewer than CELLS such keys."""
    counts = cut(df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")))
    limit = max(crowded, (counts.agg(F.sum("n")).first()[0] or 0) // CELLS)
    found = counts.where(F.col("n") > limit).select(*key, F.ceil(F.col("n") / limit).cast("int").alias("parts"))
    return None if found.isEmpty() else F.broadcast(found)


def representative_pairs(rows: DataFrame, copies: DataFrame, k: int = 15, t_num: int = 1, t_den: int = 2, crowded: int = CROWDED) -> DataFrame:
    """(id_a, id_b), id_a < id_b: the near-duplicates among the rows without the further copies; see ``near_duplicates``."""
    base = _base(rows).join(copies.select("id"), "id", "left_anti")
    anchors = base.withColumn("anchor", F.explode(F.array_distinct(F.array("v1", "v2"))))

    def pairs(df):
        def work(batches):
            for table in chunks(batches, "block", ROWS):
                a, b = block_pairs(table, k, t_num, t_den)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["id_a", "id_b"])

        return df.repartition("block").sortWithinPartitions("block").mapInArrow(work, "id_a bigint, id_b bigint")

    fixed = [F.lit(0).cast("bigint").alias("token"), F.lit(0).cast("bigint").alias("cell"), F.lit(0).alias("part")]
    cols = ["id", "v1", "v2", "text"]
    hot = _crowds(_base(rows).select(F.explode(F.array_distinct(F.array("v1", "v2"))).alias("anchor")), ["anchor"], crowded)
    if hot is None:
        return pairs(anchors.select(F.col("anchor").alias("block"), "anchor", *fixed, *cols))
    cold = pairs(anchors.join(hot, "anchor", "left_anti").select(F.col("anchor").alias("block"), "anchor", *fixed, *cols))

    def by_token(batches):
        """A row for each k-mer in the prefix of the set, in scrambled order."""
        for b, codes, offsets in slices(batches):
            row, kmer = kmer_sets(codes, offsets, k)
            token = scramble(kmer)
            order = np.lexsort((token, row))
            row, token = row[order], token[order]
            size = np.bincount(row, minlength=b.num_rows)
            start = np.concatenate([[0], np.cumsum(size)])[:-1]
            # a partner needs ceil(t n) of the n, so one of the first n - ceil(t n) + 1
            length = np.where(size > 0, size - -(-size * t_num // t_den) + 1, 0)
            at = ranges(start, length)
            who = pa.array(np.repeat(np.arange(b.num_rows), length))
            key = token[at]
            # 0 means no token; it stands for the last value too, which only puts two into one block
            key = np.where(key == 0, _ALL, key).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(who) for c in ("anchor", *cols)), pa.array(key)], names=["anchor", *cols, "token"])

    tokens = anchors.join(hot, "anchor", "left_semi").select("anchor", *cols).mapInArrow(by_token, "anchor bigint, id bigint, v1 bigint, v2 bigint, text string, token bigint")
    dense = _crowds(tokens.select("anchor", "token"), ["anchor", "token"], crowded)
    if dense is None:
        return cold.unionByName(pairs(tokens.select(F.xxhash64("anchor", "token").alias("block"), "anchor", "token", *fixed[1:], *cols)))
    # all pairs of parts (x, y), x <= y: a row of part p goes to (p, y) and (x, p); keys that aren't crowded have one part
    split = tokens.join(dense, ["anchor", "token"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    split = split.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    to = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.least(o, "part").cast("bigint") * (1 << PART) + F.greatest(o, "part"))
    split = split.withColumn("cell", F.explode(to))
    return cold.unionByName(pairs(split.select(F.xxhash64("anchor", "token", "cell").alias("block"), "anchor", "token", "cell", "part", *cols)))


def near_duplicates(rows: DataFrame, k: int = 15, t_num: int = 1, t_den: int = 2, crowded: int = CROWDED) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of rows (id, v1, v2, text) that have an anchor in
    common and sets of canonical k-mers with a Jaccard index of t_num / t_den or more.

    Rows with a null id or text, or without anchor, take no part, nor do texts with an empty set;
    an anchor given twice counts once. No pair is lost: blocks are split by k-mers, and crowded
    ones of these into parts that all meet, but never capped. Copies (same text, case ignored, on
    the same anchors) are compared once and put in for each other at the end, as this result
    names every pair; ``near_classes`` doesn't.
    """
    copies = cut(further_copies(rows))
    found = representative_pairs(rows, copies, k, t_num, t_den, crowded)
    if copies.isEmpty():
        return found
    found = cut(found)
    of = lambda name: copies.select(F.col("rep").alias("r"), F.col("id").alias(name))
    pair = found.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    # texts with no k-mer at all are near nothing, not even their copies
    some = _base(rows).where(F.col("text").rlike(f"[ACGTacgt]{{{k}}}")).select(F.col("id").alias("rep"))
    same = copies.join(some, "rep", "left_semi").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    within = same.join(of("c"), F.col("a") == F.col("r")).where("b < c").select(F.col("b").alias("a"), F.col("c").alias("b"))
    every = pair.unionByName(pair.join(of("c"), F.col("a") == F.col("r")).select(F.col("c").alias("a"), "b"))
    every = every.unionByName(every.join(of("c"), F.col("b") == F.col("r")).select("a", F.col("c").alias("b")))
    every = every.unionByName(same).unionByName(within)
    return every.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))


def near_classes(rows: DataFrame, k: int = 15, t_num: int = 1, t_den: int = 2, crowded: int = CROWDED) -> DataFrame:
    """(id, class, n_links, group): each row that has an id, a text and an anchor, with its class of copies
    (named by the lowest id), the number of other classes near it, and its group, the lowest id
    that can be reached over near pairs. Nothing is expanded into pairs of copies."""
    copies = cut(further_copies(rows))
    found = cut(representative_pairs(rows, copies, k, t_num, t_den, crowded))
    own = _base(rows).select("id").join(copies, "id", "left").select("id", F.coalesce("rep", "id").alias("class"))
    ends = found.select(F.explode(F.array("id_a", "id_b")).alias("class"))
    links = ends.groupBy("class").agg(F.count(F.lit(1)).alias("n_links"))
    linked = ends.distinct().select(F.col("class").alias("vid"))
    group = components(linked, found.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))).select(F.col("vid").alias("class"), F.col("component").alias("group"))
    # all copies of a class have its one row of each
    out = join_to_unique(join_to_unique(own, links, "class", "left", SHARED), group, "class", "left", SHARED)
    return out.select("id", "class", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("group", "class").alias("group"))
