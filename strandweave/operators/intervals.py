"""Overlapping and gapped intervals, without one task ever holding all rows of an entity.

Positions are cut into tiles. All rows of one entity that start in one tile are reduced to one
row a start position before they meet, so a tile holds at most ``tile`` rows; an entity has at
most 2^32 / tile tiles. Windows see the rows of a tile, or a few numbers for each tile of an
entity, whatever share of the table one entity holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut

#: Positions a tile; the bound on the rows that one (entity, tile) window sees.
TILE = 1 << 16


def complete_spans(df: DataFrame, key: str, start: str = "s", length: str = "l", end: str = "e") -> DataFrame:
    """(key, s, e) of the rows with a key and two known values of start, length and end.

    One missing value follows from end = start + length; when start and length are known, end is
    ignored. Rows with a null key, fewer than two values, a start below 0 or a length below 1 are
    left out. The sums are made in 64 bits, so they can't overflow.
    """
    s, l, e = (F.col(c).cast("bigint") for c in (start, length, end))
    out = df.select(
        F.col(key).alias("key"),
        F.coalesce(s, e - l).alias("s"),
        F.coalesce(l, e - s).alias("l"),
    )
    return out.where("key is not null and s >= 0 and l >= 1").select("key", "s", (F.col("s") + F.col("l")).alias("e"))


def islands(spans: DataFrame, touching: bool = False, tile: int = TILE) -> DataFrame:
    """(key, s, e, next_s): the union of (key, s, e) intervals as periods, with the start of the key's next one.

    Intervals that share a position join; those that only touch stay apart unless ``touching``.
    Rows with a null in any of the three or s >= e take no part; repeated rows count once; an
    empty input gives an empty result.

    Within a tile, in order of the start, a row opens a period if it starts at or after the
    running maximum of the previous ends; the running sum of these flags labels the periods. The
    maximum that earlier tiles carry into a tile comes from one row a tile; rows below it continue
    the last period of an earlier tile.
    """
    apart = (lambda a, b: a > b) if touching else (lambda a, b: a >= b)
    base = (
        spans.where("key is not null and s < e")
        .withColumn("t", F.floor(F.col("s") / F.lit(tile)))
        .groupBy("key", "t", "s")
        .agg(F.max("e").alias("e"))
    )
    rows = Window.partitionBy("key", "t").orderBy("s")
    before = rows.rowsBetween(Window.unboundedPreceding, -1)
    marked = base.withColumn("m", F.max("e").over(before))
    labelled = marked.withColumn(
        "g", F.sum(F.when(F.col("m").isNull() | apart(F.col("s"), F.col("m")), 1).otherwise(0)).over(rows)
    )
    # the local periods of a tile: none overlaps another of the same tile
    local = labelled.groupBy("key", "t", "g").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    by_tile = cut(
        local.groupBy("key", "t").agg(
            F.max("e").alias("top"),
            F.sort_array(F.collect_list(F.struct("s", "e"))).alias("p"),
        )
    )
    # windows along an entity see a few numbers a tile; the periods are joined back by (key, tile)
    on = ["key", "t"]
    tiles = Window.partitionBy("key").orderBy("t")
    carried = by_tile.select(*on, F.max("top").over(tiles.rowsBetween(Window.unboundedPreceding, -1)).alias("c"))
    is_head = lambda x: F.col("c").isNull() | apart(x["s"], F.col("c"))
    heads = cut(
        by_tile.join(carried, on).select(
            *on,
            F.filter("p", is_head).alias("h"),
            F.array_max(F.transform(F.filter("p", lambda x: ~is_head(x)), lambda x: x["e"])).alias("a"),
        )
    )
    marks = heads.select(*on, "a", F.get("h", F.lit(0))["s"].alias("s"))
    has_head = F.col("s").isNotNull()
    grouped = marks.withColumn(
        "run", F.sum(F.when(has_head, 1).otherwise(0)).over(tiles.rowsBetween(Window.unboundedPreceding, 0))
    )
    # rows that continue the last period of a tile lie in the tiles up to the next one with a period of its own
    nearest = Window.partitionBy("key").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, -1)
    known = grouped.withColumn("add", F.max(F.when(~has_head, F.col("a"))).over(Window.partitionBy("key", "run"))).withColumn(
        "nxt", F.last(F.when(has_head, F.struct("a", "s")), ignorenulls=True).over(nearest)
    )
    n = F.size("h")
    ends = lambda x, i: F.struct(
        x["s"].alias("s"),
        F.when(i == n - 1, F.greatest(x["e"], "add", F.col("nxt")["a"])).otherwise(x["e"]).alias("e"),
        F.when(i == n - 1, F.col("nxt")["s"]).otherwise(F.try_element_at("h", (i + 2).cast("int"))["s"]).alias("next_s"),
    )
    whole = heads.where(n > 0).join(known.where(has_head).select(*on, "add", "nxt"), on)
    return whole.select("key", F.inline(F.transform("h", ends)))


def periods_and_gaps(spans: DataFrame, least_gap: int = 1, most_gap: int | None = None, touching: bool = False, tile: int = TILE) -> DataFrame:
    """(key, kind, s, e): each period, and each gap to the key's next period that has from
    ``least_gap`` to ``most_gap`` positions. See ``islands`` for nulls, ties and empty input."""
    found = islands(spans, touching, tile)
    size = F.col("next_s") - F.col("e")
    wanted: Column = size >= least_gap
    if most_gap is not None:
        wanted = wanted & (size <= most_gap)
    piece = lambda kind, s, e: F.struct(F.lit(kind).alias("kind"), F.col(s).alias("s"), F.col(e).alias("e"))
    both = F.when(wanted, F.array(piece("period", "s", "e"), piece("gap", "e", "next_s"))).otherwise(F.array(piece("period", "s", "e")))
    return found.select("key", F.inline(both))


def bin_join(a: DataFrame, b: DataFrame, width: int, a_cols=("chrom", "s", "e"), b_cols=("chrom", "s", "e")) -> DataFrame:
    """Pairs of overlapping half-open intervals: an equi join on (chrom, level, bin) with the overlap test.

    Bins of level n are ``width`` * 16^n wide. An interval belongs to the lowest level whose bins are no
    shorter than it and is put into the one or two bins it touches there and on each higher level
    that occurs; a pair meets on the higher one of both levels, in the bin that holds the larger of the
    two starts, so it comes out once. However long an interval is, it is repeated twice a level at
    most, and ``width`` only tells how fine the lowest level is. The columns of b get the prefix ``b_``.
    """
    ac, as_, ae = a_cols
    bc, bs, be = b_cols
    b = b.select(*(F.col(c).alias(f"b_{c}") for c in b.columns))
    a = a.where(F.col(as_) < F.col(ae))
    b = b.where(F.col(f"b_{bs}") < F.col(f"b_{be}"))
    most = max(df.agg(F.max(F.col(e) - F.col(s))).first()[0] or 0 for df, s, e in ((a, as_, ae), (b, f"b_{bs}", f"b_{be}")))
    top = 0
    while width * 16**top < most:
        top += 1
    size = lambda n: F.element_at(F.array(*(F.lit(width * 16**i).cast("bigint") for i in range(top + 1))), n + 1)

    def binned(df, s, e, own, bin_):
        level = sum(((F.col(e) - F.col(s)) > width * 16**n).cast("int") for n in range(top)) if top else F.lit(0)
        one = lambda n: F.transform(F.sequence(F.floor(F.col(s) / (width * 16**n)), F.floor((F.col(e) - 1) / (width * 16**n))), lambda x: F.struct(F.lit(n).alias("n"), x.alias("x")))
        df = df.withColumn(own, level)
        every = F.concat(*(F.when(F.col(own) <= n, one(n)).otherwise(F.filter(F.array(F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("x"))), lambda x: F.lit(False))) for n in range(top + 1)))
        return df.withColumn(bin_, F.explode(every))

    a, b = binned(a, as_, ae, "__own", "__bin"), binned(b, f"b_{bs}", f"b_{be}", "__b_own", "__b_bin")
    met = a.join(
        b,
        (F.col(ac) == F.col(f"b_{bc}"))
        & (F.col("__bin") == F.col("__b_bin"))
        & (F.col(as_) < F.col(f"b_{be}"))
        & (F.col(f"b_{bs}") < F.col(ae))
        & (F.col("__bin.n") == F.greatest("__own", "__b_own"))
        & (F.col("__bin.x") == F.floor(F.greatest(F.col(as_), F.col(f"b_{bs}")) / size(F.col("__bin.n")))),
    )
    return met.drop("__bin", "__b_bin", "__own", "__b_own")
