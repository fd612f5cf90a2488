"""The table of k-mers that occur at exactly one graph location, and how well it covers sequences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import base_codes, kmer_codes, rolling
from ..functions.letters import letters
from ..functions.lineage import cut
from ..functions.seqexpr import decode, handle_id, reverse_complement, sampled_code
from .graph import bp_offsets
from .ordered import with_previous


def location_kmers(paths: DataFrame, k: int, density: float = 1.0) -> DataFrame:
    """k-mers of spelled segments (vid, seq, is_ref) at their locations, sampled before they are joined with anything.

    pos is the place of the k-mer on the forward strand of the segment."""
    rows = kmer_codes(paths, "seq", k, ["vid", "is_ref"])
    return rows if density == 1 else rows.where(sampled_code(F.col("kmer"), density))


#: Bases of a path that are spelled in one row.
STRETCH = 1 << 14


def path_kmers(steps: DataFrame, segments: DataFrame, k: int, stretch: int = STRETCH) -> DataFrame:
    """k-mers along paths, with the first and the last vertex each touches: (kmer, rev, is_ref, v1, pos1, v2, pos2).

    steps: (path, step, vid, rev, is_ref, h), segments: (vid, seq). Offsets count from the start of
    the oriented vertex. A path is never spelled as a whole: each stretch of it, with the k - 1
    letters that follow, is put together from the parts of the steps that lie in it.
    """
    lengths = segments.select("vid", F.length("seq").cast("bigint").alias("len"))
    offs = bp_offsets(steps.select("path", "step", "vid", "rev", "is_ref", "h"), lengths).where("len > 0")
    first = F.greatest(F.floor((F.col("off") - (k - 1)) / stretch), F.lit(0))
    last = F.floor((F.col("off") + F.col("len") - 1) / stretch)
    parts = offs.join(segments.select("vid", "seq"), "vid").withColumn("b", F.explode(F.sequence(first, last)))
    low = F.greatest("off", F.col("b") * stretch)
    high = F.least(F.col("off") + F.col("len"), (F.col("b") + 1) * stretch + (k - 1))
    # on a reversed vertex the part is counted from its end
    at = F.when(F.col("rev"), F.col("off") + F.col("len") - F.col("high")).otherwise(F.col("low") - F.col("off"))
    parts = parts.withColumns({"low": low, "high": high}).where("high > low")
    own = F.substr(F.col("seq"), (at + 1).cast("int"), (F.col("high") - F.col("low")).cast("int"))
    piece = F.struct(F.col("low"), F.col("off"), F.col("h"), F.when(F.col("rev"), reverse_complement(own)).otherwise(own).alias("x"))
    rows = parts.groupBy("path", "b").agg(F.bool_or("is_ref").alias("is_ref"), F.sort_array(F.collect_list(piece)).alias("p"))
    names = ["kmer", "rev", "is_ref", "v1", "pos1", "v2", "pos2"]

    def work(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                pieces = batch.column("p")[i].values
                low, off, h = (pieces.field(c).to_numpy(zero_copy_only=False) for c in ("low", "off", "h"))
                codes, offsets = letters(pieces.field("x"))
                forward, reverse, known = rolling(base_codes(codes), k)
                place = np.flatnonzero(known)
                # what begins behind the stretch belongs to the next one
                place = place[low[0] + place < (batch.column("b")[i].as_py() + 1) * stretch]
                a = np.searchsorted(offsets, place, side="right") - 1
                z = np.searchsorted(offsets, place + k - 1, side="right") - 1
                inner = lambda p, who: low[who] - off[who] + p - offsets[who]  # noqa: E731, B023
                f, r = forward[place], reverse[place]
                ref = pa.array(np.full(len(place), bool(batch.column("is_ref")[i].as_py())))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(f, r)), pa.array(r < f), ref, pa.array(h[a]), pa.array(inner(place, a)), pa.array(h[z]), pa.array(inner(place + k - 1, z))], names=names)

    return rows.mapInArrow(work, "kmer bigint, rev boolean, is_ref boolean, v1 bigint, pos1 bigint, v2 bigint, pos2 bigint")


def undirected(occurrences: DataFrame, segments: DataFrame) -> DataFrame:
    """The occurrences with one location whatever the strand a path walks it on.

    A location read the other way round has both ends swapped, the vertices turned and offsets
    counted from the other end; the lesser of both ways stands for both. ``rev`` then tells whether
    the path walks it the other way."""
    lens = lambda n: segments.select((F.col("vid")).alias(f"__v{n}"), F.length("seq").cast("bigint").alias(f"__l{n}"))
    rows = occurrences.withColumns({"__v1": handle_id(F.col("v1")), "__v2": handle_id(F.col("v2"))}).join(lens(1), "__v1").join(lens(2), "__v2")
    turn = lambda h: h.bitwiseXOR(F.lit(1).cast("bigint"))
    as_is = F.struct("v1", "pos1", "v2", "pos2")
    other = F.struct(turn(F.col("v2")).alias("v1"), (F.col("__l2") - 1 - F.col("pos2")).alias("pos1"), turn(F.col("v1")).alias("v2"), (F.col("__l1") - 1 - F.col("pos1")).alias("pos2"))
    one = rows.withColumn("__o", F.least(as_is, other))
    return one.select("kmer", (F.col("__o") != as_is).alias("rev"), "is_ref", "__o.*")


def unique_kmers(occurrences: DataFrame, location: list[str]) -> DataFrame:
    """(kmer, location..., is_ref, has_both): k-mers all of whose occurrences have one location.

    One aggregation, combined before its shuffle: least and greatest location are equal exactly
    for unique ones. is_ref holds if any occurrence is on the reference, has_both if the k-mer is
    read there on both strands. Filters on locations belong behind this, not before it.
    """
    where = F.struct(*location)
    grouped = occurrences.groupBy("kmer").agg(
        F.min(where).alias("lo"),
        F.max(where).alias("hi"),
        F.bool_or("is_ref").alias("is_ref"),
        (F.bool_or("rev") & F.bool_or(~F.col("rev"))).alias("has_both"),
        F.bool_or("rev").alias("rev"),
    )
    return grouped.where("lo = hi").select("kmer", *(F.col(f"lo.{c}").alias(c) for c in location), "rev", "is_ref", "has_both")


def within_vertices(sketch: DataFrame) -> DataFrame:
    """Without the k-mers that span an edge; to be applied after uniqueness is decided."""
    return sketch.where("v1 = v2")


def first_base_bins(sketch: DataFrame, k: int) -> DataFrame:
    """Number of k-mers and share of reference ones by first letter."""
    base = decode(F.shiftright("kmer", 2 * (k - 1)), 1)
    return sketch.groupBy(base.alias("base")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("is_ref").cast("double")), 6).alias("ref_share"))


def hits(sequences: DataFrame, sketch: DataFrame, key: str, seq: str, k: int) -> DataFrame:
    """Each k-mer of each sequence with whether the sketch holds it: (key, pos, kmer, hit).

    The k-mers of the sketch are written to the shared folder first, so the planner knows their true
    size and sends them to all tasks only if they are below its limit."""
    own = kmer_codes(sequences, seq, k, [key]).drop("rev")
    known = cut(sketch.select("kmer")).withColumn("hit", F.lit(True))
    return own.join(known, "kmer", "left").select(key, "pos", "kmer", F.coalesce("hit", F.lit(False)).alias("hit"))


def missed_per_sequence(found: DataFrame, key: str) -> DataFrame:
    """(key, missed, n_kmers); sequences without any k-mer are left out."""
    return found.groupBy(key).agg(F.count_if(~F.col("hit")).alias("missed"), F.count(F.lit(1)).alias("n_kmers"))


def found_once(found: DataFrame, key: str) -> DataFrame:
    """(key, pos, kmer): k-mers that occur once in their sequence and are in the sketch."""
    once = found.groupBy(key, "kmer").agg(F.count(F.lit(1)).alias("c"), F.min("pos").alias("pos"), F.bool_or("hit").alias("hit"))
    return once.where("hit and c = 1").select(key, "pos", "kmer")


#: Places of a sequence that one window sees.
TILE = 1 << 16


def uncovered(found: DataFrame, key: str, open_end: bool = False, tile: int = TILE) -> DataFrame:
    """(key, s, e): runs of missed k-mers, from the first missed one to the hit that closes it.

    A run that reaches the end of its sequence isn't reported unless ``open_end``; it then ends
    behind its last k-mer. Windows see a tile of a sequence; only places where hits and misses may
    change go on from there."""
    on = [key, "__t"]
    tiled = found.select(key, "pos", "hit", F.floor(F.col("pos") / tile).alias("__t"))
    w = Window.partitionBy(*on).orderBy("pos")
    marked = tiled.withColumn("__p", F.lag("hit").over(w)).withColumn("__last", F.lead("pos").over(w).isNull())
    # in each tile the first place of every run of equals, and its last place for open ends
    some = marked.where("__p is null or __p <> hit or __last").select(key, "pos", "hit")
    seen = with_previous(some, key, ["pos"], ["hit"], tile, "__was")
    changes = seen.where("(__was is null and not hit) or __was.hit <> hit").select(key, "pos", "hit")
    if open_end:
        # behind its last place a sequence ends like at a hit
        behind = found.groupBy(key).agg((F.max("pos") + 1).alias("pos")).withColumn("hit", F.lit(True))
        changes = changes.unionByName(behind)
    pairs = with_previous(changes, key, ["pos"], ["pos", "hit"], tile, "__was")
    return pairs.where("hit and not __was.hit").select(key, F.col("__was.pos").alias("s"), F.col("pos").alias("e"))
