"""Adding consensus strings to a graph, and taking out again what few reads support.

Vertices have string ids here, as in graph files: segments (id, seq), steps (path, step, id, rev).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.seqexpr import reverse_complement
from .align import operations
from .graph import chain_heads


def _placed(walks: DataFrame, segments: DataFrame) -> DataFrame:
    """Walk steps (name, step, id, rev) with len and off, the bases before them on the walk."""
    rows = walks.join(segments.select("id", F.length("seq").cast("bigint").alias("len")), "id")
    before = Window.partitionBy("name").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)  # one alignment's walk
    return rows.withColumn("off", F.coalesce(F.sum("len").over(before), F.lit(0)))


def embed(segments: DataFrame, steps: DataFrame, alns: DataFrame, walks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, steps) with each aligned consensus as a path of its own.

    alns: (name, cigar, ps, seq) with =, X, I, D operations from offset ps of the walk on, and the
    consensus; walks: (name, step, id, rev). Segments are split where an alignment begins, ends or
    departs from them; replaced and inserted letters become new segments, one for all
    alignments that put the same letters in the same place. Old paths walk the parts and spell
    what they spelled before; the new path spells the consensus. Parts are named id.start, whole
    segments keep their id, new segments begin with ``new.``.
    """
    placed = cut(_placed(walks, segments))
    ops = operations(alns, "name", "cigar", F.col("ps")).join(alns.select("name", "seq"), "name")
    ops = cut(ops.withColumn("end", F.col("p") + F.when(F.col("op").isin("=", "M", "X", "D"), F.col("len")).otherwise(0)))
    # where the walk has to be cut, as offsets on the forward strand of segments
    points = ops.select("name", F.explode(F.array("p", "end")).alias("at")).distinct()
    on = points.join(placed, "name").where("at > off and at < off + len")
    inner = F.when(F.col("rev"), F.col("off") + F.col("len") - F.col("at")).otherwise(F.col("at") - F.col("off"))
    breaks = on.select("id", inner.alias("b")).distinct().groupBy("id").agg(F.array_sort(F.collect_list("b")).alias("b"))
    whole = segments.join(breaks, "id", "left").withColumn("n", F.length("seq").cast("bigint"))
    starts = F.concat(F.array(F.lit(0).cast("bigint")), F.coalesce("b", F.array().cast("array<bigint>")))
    pieces = whole.select("id", "seq", "n", "b", F.posexplode(starts).alias("k", "a"))
    pieces = pieces.withColumn("z", F.coalesce(F.try_element_at("b", F.col("k") + 1), "n"))
    name = F.when(F.col("b").isNull(), F.col("id")).otherwise(F.concat("id", F.lit("."), F.col("a").cast("string")))
    pieces = cut(pieces.select("id", name.alias("part"), "k", "a", "z", F.substr(F.col("seq"), (F.col("a") + 1).cast("int"), (F.col("z") - F.col("a")).cast("int")).alias("x")))
    ordered = F.when(F.col("rev"), -F.col("k")).otherwise(F.col("k"))
    # old paths over the parts
    old = steps.join(pieces.select("id", "part", "k"), "id").select("path", F.struct(F.col("step").cast("bigint").alias("step"), ordered.cast("bigint").alias("k")).alias("o"), F.col("part").alias("id"), "rev")
    # the consensus: parts under matches, new segments for the rest
    at = F.when(F.col("rev"), F.col("off") + F.col("len") - F.col("z")).otherwise(F.col("off") + F.col("a"))
    laid = placed.join(pieces.select("id", "part", "k", "a", "z"), "id").select("name", "part", "rev", at.alias("from"), (at + F.col("z") - F.col("a")).alias("to"))
    kept = ops.where("op in ('=', 'M')").join(laid, "name").where("from >= p and to <= end").select(F.col("name").alias("path"), F.struct(F.col("i").cast("bigint").alias("step"), F.col("from").alias("k")).alias("o"), F.col("part").alias("id"), "rev")
    odd = ops.where("op in ('X', 'I')").withColumn("x", F.substr(F.col("seq"), (F.col("q") + 1).cast("int"), F.col("len")))
    # the part before tells the place; at the start of the walk, its first vertex
    near = laid.select("name", F.col("to").alias("p"), F.concat(F.when(F.col("rev"), "<").otherwise(">"), F.col("part")).alias("near"))
    first = placed.where("step = 0").select("name", F.concat(F.lit("^"), F.when(F.col("rev"), "<").otherwise(">"), F.col("id")).alias("begin"))
    odd = odd.join(near, ["name", "p"], "left").join(first, "name")
    odd = odd.withColumn("id", F.concat(F.lit("new."), F.left(F.sha2(F.concat_ws("|", F.coalesce("near", "begin"), "op", "x", "len"), 256), F.lit(16))))
    novel = cut(odd.select("name", "i", "p", "id", "x"))
    news = novel.select(F.col("name").alias("path"), F.struct(F.col("i").cast("bigint").alias("step"), F.col("p").alias("k")).alias("o"), "id", F.lit(False).alias("rev"))
    every = old.unionByName(kept).unionByName(news)
    number = F.row_number().over(Window.partitionBy("path").orderBy("o"))
    out = every.select("path", (number - 1).alias("step"), "id", "rev")
    fresh = pieces.select(F.col("part").alias("id"), F.col("x").alias("seq")).unionByName(novel.select("id", F.col("x").alias("seq")).distinct())
    return fresh, out


def links(steps: DataFrame) -> DataFrame:
    """(v1, s1, v2, s2, overlap): every pair of neighbouring steps."""
    sign = lambda c: F.when(F.col(c), "-").otherwise("+")
    a = steps.select("path", "step", F.col("id").alias("v1"), sign("rev").alias("s1"))
    b = steps.select("path", (F.col("step") - 1).alias("step"), F.col("id").alias("v2"), sign("rev").alias("s2"))
    return a.join(b, ["path", "step"]).select("v1", "s1", "v2", "s2").distinct().withColumn("overlap", F.lit("0M"))


def supported(segments: DataFrame, steps: DataFrame, support: DataFrame, consensus: str, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """The graph without the novel vertices and consensus paths that too few reads stand behind.

    support: (path, read); consensus: the prefix of consensus paths. A vertex that only these
    walk needs ``least`` different reads in one orientation; a consensus with a vertex below
    that falls out, and so do vertices that no path walks any more."""
    mine = F.col("path").startswith(consensus)
    known = steps.where(~mine).select("id").distinct()
    uses = steps.where(mine).join(known, "id", "left_anti").select("path", "id", "rev").distinct()
    reads = uses.join(support, "path").select("id", "rev", "read").distinct().groupBy("id", "rev").agg(F.count(F.lit(1)).alias("n"))
    good = reads.where(F.col("n") >= least).select("id").distinct()
    weak = uses.join(good, "id", "left_anti").select("path").distinct()
    kept = steps.join(weak, "path", "left_anti")
    return segments.join(kept.select("id").distinct(), "id", "left_semi"), kept


def unchopped(segments: DataFrame, steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, steps) with chains of vertices that all paths walk as one put together.

    A link joins two vertices if no path leaves the first or enters the second in another way
    (looking from both strands) and no path begins or ends between them. Chains are named by
    their first vertex."""
    side = lambda df, v, end: df.select(F.col(v).alias("id"), end.alias("end"))
    pairs = steps.select("path", "step", "id", "rev")
    nxt = pairs.select("path", (F.col("step") - 1).alias("step"), F.col("id").alias("id2"), F.col("rev").alias("rev2"))
    ends = pairs.join(nxt, ["path", "step"])
    # a link goes from one end of a vertex (0 left, 1 right, on the forward strand) to an end of another
    one = ends.select(F.col("id").alias("a"), F.when(F.col("rev"), 0).otherwise(1).alias("ea"), F.col("id2").alias("b"), F.when(F.col("rev2"), 1).otherwise(0).alias("eb"))
    both = one.unionByName(one.select(F.col("b").alias("a"), F.col("eb").alias("ea"), F.col("a").alias("b"), F.col("ea").alias("eb"))).distinct()
    borders = steps.groupBy("path").agg(F.min_by(F.struct("id", "rev"), "step").alias("f"), F.max_by(F.struct("id", "rev"), "step").alias("l"))
    stops = borders.select(F.col("f.id").alias("a"), F.when(F.col("f.rev"), 1).otherwise(0).alias("ea")).unionByName(borders.select(F.col("l.id").alias("a"), F.when(F.col("l.rev"), 0).otherwise(1).alias("ea"))).distinct()
    single = both.groupBy("a", "ea").agg(F.count(F.lit(1)).alias("n"), F.first("b").alias("b"), F.first("eb").alias("eb")).where("n = 1").drop("n").join(stops, ["a", "ea"], "left_anti")
    back = single.select(F.col("a").alias("b"), F.col("ea").alias("eb"), F.col("b").alias("a"), F.col("eb").alias("ea"))
    # only links that keep the strand (right end to left end) are joined: others would need one side turned
    joined = single.join(back, ["a", "ea", "b", "eb"]).where("ea = 1 and eb = 0 and a <> b").select("a", "b")
    state = cut(chain_heads(segments, joined, "id"))
    merged = segments.join(state, "id").groupBy("head").agg(F.array_sort(F.collect_list(F.struct("place", "seq"))).alias("x"), F.count(F.lit(1)).alias("n"))
    # a path walks a whole chain, so its first vertex (the last one, in reverse) stands for it
    last = merged.select("head", (F.col("n") - 1).alias("last"))
    walked = steps.join(state, "id").join(last, "head").where((~F.col("rev") & (F.col("place") == 0)) | (F.col("rev") & (F.col("place") == F.col("last"))))
    number = F.row_number().over(Window.partitionBy("path").orderBy("step"))
    return merged.select(F.col("head").alias("id"), F.concat_ws("", "x.seq").alias("seq")), walked.select("path", (number - 1).alias("step"), F.col("head").alias("id"), "rev")


def spelled(segments: DataFrame, steps: DataFrame) -> DataFrame:
    """(path, seq)."""
    seq = F.when(F.col("rev"), reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    rows = steps.join(segments, "id").select("path", "step", seq.alias("s"))
    return rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("step", "s"))).alias("x")).select("path", F.concat_ws("", "x.s").alias("seq"))


def numbered(segments: DataFrame, steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with dense numbers from 1 as ids, in the order of the old ones."""
    from .ranks import dense_index

    ids = dense_index(segments, ["id"], "new").select("id", "seq", F.col("new").cast("string").alias("new"))
    return ids.select(F.col("new").alias("id"), "seq"), steps.join(ids.select("id", "new"), "id").select("path", "step", F.col("new").alias("id"), "rev")
