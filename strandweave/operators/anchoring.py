"""Anchors on both sides of specific strings, the path they agree on, chains, and what is dropped."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage import cut
from ..functions.seqexpr import harmonic_mean, pack_handle
from .ordered import running_sum, with_previous


def nearest_anchors(strings: DataFrame, usable: DataFrame, key: str, k: int, most: int | None = 20, tile: int = 1 << 16, sides: tuple[str, ...] = ("left", "right")) -> DataFrame:
    """(key, s, e, side, r, anchor columns): the nearest ``most`` usable k-mers on each of ``sides`` of each string (key, s, e), or all of them for None.

    usable: (key, pos, ...) k-mers that occur once in their read and are in the sketch. Anchors
    don't overlap the string; r counts them from it outwards. Positions are unique on a read, so
    there are no ties.

    Usable k-mers are numbered along their read, by running sums in tiles, and each string learns
    how many of them end before it and begin before its end. Its anchors are the numbers next to
    these two, so they come by an equal join and no string ever meets all k-mers of its read.
    """
    own = usable.select(key, F.col("pos").cast("bigint").alias("p"), F.lit(1).alias("v"))
    ends = strings.select(key, F.explode(F.array(F.col("s").cast("bigint") - k, F.col("e").cast("bigint") - 1)).alias("p"), F.lit(0).alias("v"))
    sums = cut(running_sum(own.unionByName(ends), key, "p", "v", tile, "c"))
    at = lambda name, p: sums.select(key, F.col("p").alias(p), F.col("c").alias(name))
    numbered = usable.withColumn("__p", F.col("pos").cast("bigint")).join(at("__c", "__p"), [key, "__p"]).drop("__p")
    wide = strings.select(key, "s", "e", (F.col("s").cast("bigint") - k).alias("__a"), (F.col("e").cast("bigint") - 1).alias("__b"))
    wide = wide.join(at("__l", "__a"), [key, "__a"]).join(at("__r", "__b"), [key, "__b"])
    if most is None:
        total = usable.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
        wide = wide.join(total, key)
        low, high = F.lit(1).cast("bigint"), F.col("__n")
    else:
        low, high = F.greatest(F.col("__l") - (most - 1), F.lit(1)), F.col("__r") + most
    side = lambda name, a, b: F.when(a <= b, F.transform(F.sequence(a, b), lambda c: F.struct(F.lit(name).alias("side"), c.alias("__c"))))
    none = F.filter(F.array(F.struct(F.lit("").alias("side"), F.lit(0).cast("bigint").alias("__c"))), lambda x: F.lit(False))
    both = {"left": side("left", low, F.col("__l")), "right": side("right", F.col("__r") + 1, high)}
    picked = F.concat(*(F.coalesce(both[x], none) for x in sides))
    rows = wide.select(key, "s", "e", "__l", "__r", F.inline(picked)).join(numbered, [key, "__c"])
    r = F.when(F.col("side") == "left", F.col("__l") - F.col("__c") + 1).otherwise(F.col("__c") - F.col("__r"))
    return rows.select(key, "s", "e", "side", r.cast("int").alias("r"), *(c for c in usable.columns if c != key))


def apart_anchors(strings: DataFrame, usable: DataFrame, key: str, k: int, most: int = 20) -> DataFrame:
    """As ``nearest_anchors``, but of anchors that don't overlap each other: from the string outwards,
    the next one is the first at least k letters further. The list of a side is bounded by its read."""
    near = nearest_anchors(strings, usable, key, k, None)
    lists = near.groupBy(key, "s", "e", "side").agg(F.array_sort(F.collect_list(F.struct("r", "pos"))).alias("x"))
    start = F.filter("x", lambda v: F.lit(False))
    far = lambda acc, v: F.abs(F.try_element_at(acc, F.lit(-1))["pos"] - v["pos"])
    pick = F.aggregate("x", start, lambda acc, v: F.when((F.size(acc) == 0) | (far(acc, v) >= k), F.concat(acc, F.array(v))).otherwise(acc))
    picked = lists.select(key, "s", "e", "side", F.posexplode(F.slice(pick, 1, most)).alias("i", "v"))
    return picked.select(key, "s", "e", "side", (F.col("i") + 1).alias("r"), F.col("v.pos").alias("pos"))


def best_paths(anchors: DataFrame, locations: DataFrame, key: str) -> DataFrame:
    """(key, s, e, path, nl, nr): the path with anchors on both sides whose counts have the highest
    harmonic mean, then the highest sum, then the lowest id.

    anchors: with vid; locations: (vid, path), distinct. Anchors on one vertex are counted before they
    meet the paths through it. The order is one aggregated struct."""
    counted = anchors.groupBy(key, "s", "e", "vid").agg(F.count_if(F.col("side") == "left").alias("nl"), F.count_if(F.col("side") == "right").alias("nr"))
    on = counted.join(locations, "vid").groupBy(key, "s", "e", "path").agg(F.sum("nl").alias("nl"), F.sum("nr").alias("nr"))
    both = on.where("nl > 0 and nr > 0")
    order = F.struct((-harmonic_mean(F.col("nl"), F.col("nr"))).alias("h"), (-F.col("nl") - F.col("nr")).alias("n"), "path", "nl", "nr")
    best = both.groupBy(key, "s", "e").agg(F.min(order).alias("x"))
    return best.select(key, "s", "e", "x.path", "x.nl", "x.nr")


def ranked_paths(anchors: DataFrame, locations: DataFrame, key: str, most: int) -> DataFrame:
    """(key, s, e, path, n, r): the ``most`` paths on which most anchors of a string lie, the lowest id first on ties.

    The list of a string is bounded by the paths through its at most 2 * NA anchors."""
    counted = anchors.groupBy(key, "s", "e", "vid").agg(F.count(F.lit(1)).alias("n"))
    on = counted.join(locations, "vid").groupBy(key, "s", "e", "path").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(key, "s", "e").orderBy(F.desc("n"), "path")
    return on.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)


def common_paths(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, path, bit1, bit2): the paths that both anchors of a string lie on, from (key, path, bit) of each.

    The bit tells which way a path walks an anchor. Each way of the left anchor is kept, with the
    right anchor's same way where the path has it, else with the other one."""
    met = left.select(key, "path", F.col("bit").alias("bit1")).distinct().join(right.select(key, "path", F.col("bit").alias("b")).distinct(), [key, "path"])
    # the least of (differs, bit) is the same way if there is one
    best = met.groupBy(key, "path", "bit1").agg(F.min(F.struct((F.col("b") != F.col("bit1")).alias("other"), F.col("b"))).alias("x"))
    return best.select(key, "path", "bit1", F.col("x.b").alias("bit2"))


def reverse_position(length: Column, pos: Column, k: int) -> Column:
    """Where a k-mer at ``pos`` begins when its read is read on the other strand."""
    return length - (pos + k)


def ends_by_strand(ends: DataFrame, lengths: DataFrame, key: str) -> DataFrame:
    """(key, h1, h2, off1, off2, skmer, ekmer, reverse): both ends of anchored strings as their path sees them.

    ends: (key, sv, ev, soff, eoff, skmer, ekmer, back, inv1, inv2). A string whose path runs on the
    reverse strand (``back``) begins with its second anchor. An inverted anchor's vertex is turned and its
    offset counted from the vertex's other end."""
    pick = lambda a, b: F.when(F.col("back"), F.col(b)).otherwise(F.col(a))
    rows = ends.select(key, "back", "inv1", "inv2", pick("sv", "ev").alias("v1"), pick("ev", "sv").alias("v2"), pick("soff", "eoff").alias("o1"), pick("eoff", "soff").alias("o2"), pick("skmer", "ekmer").alias("skmer"), pick("ekmer", "skmer").alias("ekmer"))
    of = lambda n: lengths.select(F.col("vid").alias(f"v{n}"), F.col("len").alias(f"len{n}"))
    rows = rows.join(of(1), "v1").join(of(2), "v2")
    handle = lambda n: pack_handle(F.col(f"v{n}"), F.col(f"inv{n}")).alias(f"h{n}")
    off = lambda n: F.when(F.col(f"inv{n}"), F.col(f"len{n}") - F.col(f"o{n}") - 1).otherwise(F.col(f"o{n}")).cast("bigint").alias(f"off{n}")
    return rows.select(key, handle(1), handle(2), off(1), off(2), "skmer", "ekmer", F.col("back").alias("reverse"))


def flags(strings: DataFrame, anchors: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """Strings with flag: 1 no anchors on a side, 2 no common path, 0 otherwise."""
    sides = anchors.groupBy(key, "s", "e").agg(F.count_distinct("side").alias("sides"))
    on = [key, "s", "e"]
    rows = strings.select(*on).join(sides, on, "left").join(chosen.select(*on, F.lit(True).alias("ok")), on, "left")
    return rows.select(*on, F.when(F.coalesce("sides", F.lit(0)) < 2, 1).when(F.col("ok").isNull(), 2).otherwise(0).alias("flag"))


def without_contained(strings: DataFrame, key: str, ident: str, tile: int = 1 << 14) -> DataFrame:
    """(key, ident, s, l) of the strings that stay: of those with one start the longest (on equal
    length the one with the highest id), and none that ends where the one before it ends.

    Walking along a read and comparing with the last string kept gives the same: a string that is
    dropped for its end leaves that end behind, so what counts is the largest end of the start
    before. That is one aggregate and one neighbour, and no walk.
    """
    rows = strings.where(f"{key} is not null and s is not null and l is not null")
    by_start = rows.groupBy(key, "s").agg(F.min("l").alias("least"), F.max(F.struct("l", ident)).alias("x"))
    by_start = by_start.select(key, "s", (F.col("s") + F.col("least")).alias("low"), (F.col("s") + F.col("x.l")).alias("top"), F.col(f"x.{ident}").alias(ident), F.col("x.l").alias("l"))
    seen = with_previous(by_start, key, ["s"], ["top"], tile)
    dropped = F.coalesce((F.col("low") == F.col("top")) & (F.col("prev.top") == F.col("top")), F.lit(False))
    return seen.where(~dropped).select(key, ident, "s", "l")


_CHAIN = T.ArrayType(T.IntegerType())


def chain(read: list[int], path: list[int], total: int, ratio: float = 0.9) -> list[int]:
    """Indexes of a collinear chain of anchors, from their positions on read and path, in path order.

    From each anchor on, every later one is appended whose distance from the last one is about
    the same on both. A chain of over half of ``total`` anchors ends the search; else the
    longest counts, the first on ties."""
    best: list[int] = []
    for x in range(len(read)):
        own = [x]
        for y in range(x + 1, len(read)):
            rd, qd = path[y] - path[own[-1]], read[y] - read[own[-1]]
            if rd > 0 and qd > 0 and min(rd, qd) / max(rd, qd) > ratio:
                own.append(y)
        if 2 * len(own) > total:
            return own
        if len(own) > len(best):
            best = own
    return best


@F.arrow_udf(_CHAIN)
def greedy_chain(read: pa.Array, path: pa.Array, total: pa.Array) -> pa.Array:
    """``chain`` for arrays of positions; a side has few anchors, so arrays are short."""
    return pa.array([None if r is None else chain(r, p, n) for r, p, n in zip(read.to_pylist(), path.to_pylist(), total.to_pylist())], pa.list_(pa.int32()))
