"""Long exact spans shared between records.

Every run of ``span`` consecutive letters is hashed; a run found in two records or more is
repeated, and the letters that any repeated run covers are shared.

So that not each run has to be shuffled, runs travel in bundles: each run has a routing value, the
least hash of the shorter words in it, and neighbouring runs mostly have the same one. A maximal
stretch of runs with one routing value is one row. Equal runs have equal routing values, so they
meet in one partition, where runs are hashed, sorted and, where hashes agree, compared letter by letter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.letters import chunks, ranges, row_of
from ..functions.lineage import cut
from ..operators.skew import join_counted
from .records import slices

#: Letters in the words that route a run.
WORD = 14
#: Cells of the histogram of routing values; its size is the bound on what is broadcast.
CELLS = 1 << 20
#: Bundles of one routing value from which its runs travel one by one instead.
CROWDED = 20_000

_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_PACKED, _BYTES, _POINTS = 0, 1, 2
_LETTERS = np.frombuffer(b"ACGT", np.uint8)
_CODE = np.full(256, 4, np.uint8)
_CODE[_LETTERS] = np.arange(4)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * _C1
    h += b
    h ^= h >> np.uint64(29)
    h *= _C2
    h ^= h >> np.uint64(32)
    return h


def run_hashes(codes: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """For each size, the hash of the run of so many letters that starts at each position."""
    one = codes.astype(np.uint64)
    powers = [_mix(one, one)]
    while 2 << (len(powers) - 1) <= max(sizes):
        h, n = powers[-1], 1 << (len(powers) - 1)
        powers.append(_mix(h[:-n], h[n:]) if len(h) > n else h[:0])
    out = []
    for size in sizes:
        h, at = None, 0
        for k in reversed(range(len(powers))):
            if size >> k & 1:
                part = powers[k][at:]
                h = part if h is None else _mix(h[: len(part)], part[: len(h)])
                at += 1 << k
        out.append(h[: max(0, len(codes) - size + 1)])
    return out


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def _cell(route: np.ndarray) -> np.ndarray:
    return (route >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def _bundles(codes: np.ndarray, offsets: np.ndarray, span: int, hashes: bool = False):
    """(row, first start, starts, routing value) of each bundle of runs; and the runs' hashes, if wanted."""
    word = min(WORD, span)
    empty = np.zeros(0, np.int64)
    if len(codes) < span:
        return empty, empty, empty, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    words, runs = (run_hashes(codes, word, span) if hashes else (run_hashes(codes, word)[0], np.zeros(0, np.uint64)))
    route = _sliding_least(words, span - word + 1)
    row = row_of(offsets)
    ends = offsets[1:][row]
    ok = np.flatnonzero(np.arange(len(route)) + span <= ends[: len(route)])
    if not len(ok):
        return empty, empty, empty, np.zeros(0, np.uint64), runs
    r, v = row[ok], route[ok]
    head = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (v[1:] != v[:-1])]))
    size = np.diff(np.append(head, len(ok)))
    return r[head], ok[head], size, v[head], runs


def _pack(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of letters as (kind, offsets, bytes): four A, C, G, T a byte, or as they are if there are others."""
    if codes.dtype != np.uint8:
        offsets = np.concatenate([[0], np.cumsum(sizes * 4)])
        body = codes[ranges(starts, sizes)].astype("<u4").tobytes()
        return np.full(len(starts), _POINTS, np.int8), offsets, np.frombuffer(body, np.uint8)
    small = _CODE[codes]
    odd = np.concatenate([[0], np.cumsum(small == 4)])
    plain = odd[starts + sizes] == odd[starts]
    quads = (sizes + 3) // 4
    lengths = np.where(plain, quads, sizes)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    body = np.zeros(offsets[-1], np.uint8)
    p = np.flatnonzero(plain)
    padded = np.concatenate([small, np.zeros(4, np.uint8)])
    at = np.repeat(starts[p], quads[p]) + 4 * ranges(np.zeros(len(p), np.int64), quads[p])
    bits = np.zeros(len(at), np.uint8)
    for k in range(4):
        bits = bits << 2 | (padded[np.minimum(at + k, len(padded) - 1)] & 3)
    body[ranges(offsets[p], quads[p])] = bits
    o = np.flatnonzero(~plain)
    body[ranges(offsets[o], sizes[o])] = codes[ranges(starts[o], sizes[o])]
    return np.where(plain, _PACKED, _BYTES).astype(np.int8), offsets, body


def _unpack(kind: np.ndarray, sizes: np.ndarray, body: pa.Array) -> np.ndarray:
    """The letters of all stretches, one after another."""
    body = body.combine_chunks() if isinstance(body, pa.ChunkedArray) else body
    offsets = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1].astype(np.int64)
    data = np.frombuffer(body.buffers()[2], np.uint8)
    points = bool((kind == _POINTS).any())
    out = np.zeros(int(sizes.sum()), np.uint32 if points else np.uint8)
    to = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    p = np.flatnonzero(kind == _PACKED)
    if len(p):
        at = ranges(np.zeros(len(p), np.int64), sizes[p])
        byte = data[np.repeat(offsets[:-1][p], sizes[p]) + (at >> 2)]
        out[np.repeat(to[p], sizes[p]) + at] = _LETTERS[byte >> (6 - 2 * (at & 3)).astype(np.uint8) & 3]
    b = np.flatnonzero(kind == _BYTES)
    if len(b):
        out[ranges(to[b], sizes[b])] = data[ranges(offsets[:-1][b], sizes[b])]
    for i in np.flatnonzero(kind == _POINTS):
        out[to[i] : to[i] + sizes[i]] = np.frombuffer(data[offsets[i] : offsets[i + 1]].tobytes(), "<u4")
    return out


def _same_letters(codes: np.ndarray, a: np.ndarray, b: np.ndarray, span: int) -> np.ndarray:
    """Whether the runs of ``span`` letters at places a and b are equal, eight bytes at a time."""
    wide = 8 // codes.dtype.itemsize
    if span < wide:
        return np.all([codes[a + k] == codes[b + k] for k in range(span)], axis=0)
    raw = codes.tobytes() + bytes(8)
    words = np.ndarray((len(codes),), "<u8", raw, strides=(codes.dtype.itemsize,))
    same = np.ones(len(a), bool)
    for k in [*range(0, span - wide, wide), span - wide]:
        same &= words[a + k] == words[b + k]
    return same


def _equal_runs(codes: np.ndarray, run: np.ndarray, span: int, *order_by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, heads): the runs that start at ``run`` in an order that puts equal ones together (then by
    ``order_by``), and where a new one begins in it. Runs are told apart by their hash, and those of
    one hash are compared letter by letter."""
    key = run_hashes(codes, span)[0][run]
    order = np.lexsort((*reversed(order_by), key)) if order_by else np.argsort(key)
    k = key[order]
    same = k[1:] == k[:-1]
    at = np.flatnonzero(same)
    equal = _same_letters(codes, run[order[at]], run[order[at + 1]], span)
    if not equal.all():  # one hash, several texts: these few are told apart as they are
        text = np.zeros(len(key), np.int64)
        known: dict[bytes, int] = {}
        for i in np.flatnonzero(np.isin(key, k[at[~equal]])):
            text[i] = known.setdefault(codes[run[i] : run[i] + span].tobytes(), len(known))
        order = np.lexsort((*reversed(order_by), text, key))
        k, x = key[order], text[order]
        same = (k[1:] == k[:-1]) & (x[1:] == x[:-1])
    return order, np.flatnonzero(np.concatenate([[True], ~same]))


def _shared_starts(codes: np.ndarray, run: np.ndarray, rid: np.ndarray, span: int) -> np.ndarray:
    """For each run, whether another record has it too."""
    if not len(run):
        return np.zeros(0, bool)
    order, head = _equal_runs(codes, run, span)
    r = rid[order]
    size = np.diff(np.append(head, len(r)))
    many = np.minimum.reduceat(r, head) != np.maximum.reduceat(r, head)
    out = np.zeros(len(r), bool)
    out[order] = np.repeat(many, size)
    return out


def _later_starts(codes: np.ndarray, run: np.ndarray, rid: np.ndarray, place: np.ndarray, span: int) -> np.ndarray:
    """For each run, whether an earlier place (of a lower record, or before it in its own) has it too."""
    if not len(run):
        return np.zeros(0, bool)
    order, head = _equal_runs(codes, run, span, rid, place)
    out = np.ones(len(run), bool)
    out[order[head]] = False
    return out


def shared_letters(texts: DataFrame, span: int, cells: int = CROWDED) -> DataFrame:
    """(rid, n_shared) for each record of (rid, text) that has letters in a repeated run of ``span`` letters.

    ``rid`` is a unique bigint; rows with a null id or text take no part. Two records with equal
    texts share all of them, if these have ``span`` letters at least. Records with no shared
    letter are left out; no record is ever cut or dropped, whatever its length.

    Equal texts are taken together first, so that many copies cost no more than one text. Routing
    values that more than ``cells`` bundles have send their runs by the letters of each run,
    pre-aggregated, instead of in bundles: a span that a third of all records hold then never
    gathers in one task.
    """
    return _covered(texts, span, cells, later=False)


def repeated_letters(texts: DataFrame, span: int, cells: int = CROWDED) -> DataFrame:
    """(rid, n_shared): the letters of each record that a run of ``span`` letters covers which has
    occurred before, in a record of a lower ``rid`` or at an earlier place of the same one.

    What is left without these letters holds every run of the collection once: its first
    occurrence. Otherwise as ``shared_letters``."""
    return _covered(texts, span, cells, later=True)


def _crowded_routes(base: DataFrame, span: int, cells: int) -> np.ndarray:
    """The routing values of more than ``cells`` bundles, sorted; fewer than CELLS of them, as the
    limit grows with the number of bundles beyond CELLS * ``cells``.

    A histogram of fixed size tells which values may be crowded; only these are counted one by one."""

    def histogram(batches):
        for _, codes, offsets in slices(batches):
            cell, n = np.unique(_cell(_bundles(codes, offsets, span)[3]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n.astype(np.int64))], names=["cell", "n"])

    counted = base.select("text").mapInArrow(histogram, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    found = counted.where(F.col("n") > cells).collect()  # CELLS rows at most
    if not found:
        return np.zeros(0, np.uint64)
    limit = cells
    if sum(r.n for r in found) > CELLS * cells:
        limit = sum(r.n for r in found) // CELLS
    suspect = base.sparkSession.sparkContext.broadcast(np.array(sorted(r.cell for r in found if r.n > limit), np.int64))

    def exact(batches):
        for _, codes, offsets in slices(batches):
            route = _bundles(codes, offsets, span)[3]
            value, n = np.unique(route[np.isin(_cell(route), suspect.value)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))], names=["route", "n"])

    hot = base.select("text").mapInArrow(exact, "route bigint, n bigint").groupBy("route").agg(F.sum("n").alias("n")).where(F.col("n") > limit)
    return np.sort(np.array([r.route for r in hot.select("route").collect()], np.int64).view(np.uint64))


def _covered(texts: DataFrame, span: int, cells: int, later: bool) -> DataFrame:
    spark = texts.sparkSession
    base = texts.select("rid", "text").where("rid is not null and text is not null")
    long_enough = base.where(F.length("text") >= span)
    finger = [F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(span)).alias("h2"), F.length("text").alias("size")]
    thin = long_enough.select("rid", *finger)
    copied = cut(thin.groupBy("h1", "h2", "size").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("first")).where("n > 1"))
    copies = join_counted(thin, copied, ["h1", "h2", "size"])
    copies = (copies.where("rid <> first") if later else copies).select("rid", F.col("size").cast("int").alias("n_shared"))
    # of copies the first one stands for all; its letters are shared as a whole, or are the first of their kind
    single = long_enough.groupBy("text").agg(F.min("rid").alias("rid"), (F.count(F.lit(1)) > 1).alias("copied"))
    if later:
        single = single.withColumn("copied", F.lit(False))
    hot = _crowded_routes(long_enough, span, cells)
    hot_routes = spark.sparkContext.broadcast(hot)

    def bundle(batches):
        names = ["route", "rid", "copied", "start", "size", "kind", "body"]
        for batch, codes, offsets in slices(batches):
            row, start, size, route, _ = _bundles(codes, offsets, span)
            if len(hot_routes.value):
                cold = ~np.isin(route, hot_routes.value)
                row, start, size, route = row[cold], start[cold], size[cold], route[cold]
            kind, at, body = _pack(codes, start, size + span - 1)
            data = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(body.tobytes())])
            rid = batch.column("rid").to_numpy(zero_copy_only=False)[row]
            dup = batch.column("copied").to_numpy(zero_copy_only=False).astype(bool)[row]
            cols = [pa.array(route.view(np.int64)), pa.array(rid), pa.array(dup), pa.array((start - offsets[row]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(kind), data]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    def compare(batches):
        for table in chunks(batches, "route", 40_000):
            size = table.column("size").to_numpy().astype(np.int64)
            n = size + span - 1
            codes = _unpack(table.column("kind").to_numpy(), n, table.column("body"))
            offsets = np.concatenate([[0], np.cumsum(n)])
            run = ranges(offsets[:-1], size)  # where each run starts
            bundle_of = np.repeat(np.arange(len(size)), size)
            rid, start = table.column("rid").to_numpy(), table.column("start").to_numpy()
            if later:
                shared = _later_starts(codes, run, rid[bundle_of], start[bundle_of] + run - offsets[bundle_of], span)
            else:
                shared = _shared_starts(codes, run, rid[bundle_of], span)
                shared &= ~table.column("copied").to_numpy(zero_copy_only=False).astype(bool)[bundle_of]
            yield _stretches(shared, run - offsets[bundle_of], bundle_of, rid, start)

    def _stretches(shared, position, owner, rid, start):
        """Maximal rows of neighbouring shared starts, as (rid, a, b) with both ends included."""
        at = np.flatnonzero(shared)
        if len(at):
            new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])])
            first, last = at[new], at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
        else:
            first = last = at
        who = owner[first]
        a, b = start[who] + position[first], start[who] + position[last]
        return pa.RecordBatch.from_arrays([pa.array(rid[who]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["rid", "a", "b"])

    schema = "route bigint, rid bigint, copied boolean, start int, size int, kind tinyint, body binary"
    rows = single.mapInArrow(bundle, schema).repartition("route").sortWithinPartitions("route")
    found = rows.mapInArrow(compare, "rid bigint, a int, b int")
    if len(hot):

        def single_runs(batches):
            """A row for each run of a crowded routing value, with its letters."""
            for batch, codes, offsets in slices(batches):
                row, start, size, route, _ = _bundles(codes, offsets, span)
                keep = np.isin(route, hot_routes.value)
                row, start, size = row[keep], start[keep], size[keep]
                at = ranges(start, size)
                who = np.repeat(row, size)
                kind, to, body = _pack(codes, at, np.full(len(at), span))
                packed = kind == _PACKED
                if packed.any():  # what follows the run in its last byte
                    body[to[1:][packed] - 1] &= np.uint8(0xFF << 2 * (-span % 4) & 0xFF)
                data = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(to.astype(np.int32).tobytes()), pa.py_buffer(body.tobytes())])
                rid = batch.column("rid").to_numpy(zero_copy_only=False)[who]
                dup = batch.column("copied").to_numpy(zero_copy_only=False).astype(bool)[who]
                yield pa.RecordBatch.from_arrays([pa.array(kind), data, pa.array(rid), pa.array(dup), pa.array((at - offsets[who]).astype(np.int32))], names=["kind", "run", "rid", "copied", "a"])

        runs = single.mapInArrow(single_runs, "kind tinyint, run binary, rid bigint, copied boolean, a int")
        each = runs.groupBy("kind", "run")
        if later:
            first = each.agg(F.min(F.struct("rid", "a")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
            more = runs.join(first, ["kind", "run"]).where("rid <> f.rid or a <> f.a")
        else:
            repeated = each.agg(F.min("rid").alias("x"), F.max("rid").alias("y")).where("x <> y").select("kind", "run")
            more = runs.where("not copied").join(repeated, ["kind", "run"], "left_semi")
        found = found.unionByName(more.select("rid", "a", F.col("a").alias("b")))
    # starts a..b cover b - a letters and span more, less what the next stretch covers again
    step = lambda acc, x: F.struct(
        (acc["n"] + F.when(acc["b"] < 0, 0).otherwise(F.least(F.lit(span), x["a"] - acc["b"])) + x["b"] - x["a"]).alias("n"), x["b"].alias("b")
    )
    merged = found.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("p"))
    first = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("b"))
    covered = merged.select("rid", F.aggregate("p", first, step, lambda acc: acc["n"] + span).alias("n_shared"))
    return covered.unionByName(copies)
