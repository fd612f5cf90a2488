"""Sequence graphs as tables: segments (vid, seq, len), steps (path, step, h, vid, rev), links (h1, h2).

An oriented vertex is a handle h = 2 * vid + rev.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.seqexpr import handle_id, reverse_complement
from .ranks import dense_index
from .skew import CROWDED, join_to_unique

#: Steps a block; running sums along a path are made within blocks, so a path of any length is no task of its own.
BLOCK = 1 << 16


def flip(h: Column) -> Column:
    return h.bitwiseXOR(F.lit(1).cast("bigint"))


def path_edges(steps: DataFrame) -> DataFrame:
    """(path, step, h1, h2): neighbouring steps, by a join on (path, step), which no long path can skew."""
    a = steps.select("path", "step", F.col("h").alias("h1"))
    b = steps.select("path", (F.col("step") - 1).alias("step"), F.col("h").alias("h2"))
    return a.join(b, ["path", "step"])


def distinct_edges(steps: DataFrame) -> DataFrame:
    return path_edges(steps).select("h1", "h2").distinct()


def canonical_edge() -> list[Column]:
    """(a, b) of (h1, h2), the same for an edge and its mirror image."""
    mirrored = (flip(F.col("h2")) < F.col("h1")) | ((flip(F.col("h2")) == F.col("h1")) & (flip(F.col("h1")) < F.col("h2")))
    return [F.when(mirrored, flip(F.col("h2"))).otherwise(F.col("h1")).alias("a"), F.when(mirrored, flip(F.col("h1"))).otherwise(F.col("h2")).alias("b")]


def bp_offsets(steps: DataFrame, segments: DataFrame) -> DataFrame:
    """The steps with len and off, the bases before each step on its path. Steps of unknown segments are left out."""
    rows = steps.join(segments.select("vid", "len"), "vid").withColumn("blk", F.floor(F.col("step") / BLOCK))
    total = rows.groupBy("path", "blk").agg(F.sum("len").alias("t"))
    base = total.select("path", "blk", F.coalesce(F.sum("t").over(Window.partitionBy("path").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("path", "blk").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("own", F.coalesce(F.sum("len").over(inside), F.lit(0)))
    return local.join(base, ["path", "blk"]).withColumn("off", F.col("base") + F.col("own")).drop("blk", "base", "own")


def path_lengths(steps: DataFrame, segments: DataFrame) -> DataFrame:
    return steps.join(segments.select("vid", "len"), "vid").groupBy("path").agg(F.sum("len").alias("bases"), F.count(F.lit(1)).alias("n_steps"))


def spell_paths(steps: DataFrame, segments: DataFrame) -> DataFrame:
    """(path, seq): segments along each path put together, reversed ones complemented."""
    seq = F.when(F.col("rev"), reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    rows = steps.join(segments.select("vid", "seq"), "vid").select("path", "step", seq.alias("s"))
    return rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("step", "s"))).alias("x")).select("path", F.concat_ws("", "x.s").alias("seq"))


def subpaths(pairs: DataFrame, steps: DataFrame, limit: int | None = None) -> DataFrame:
    """(h1, h2, path, s1, s2): for each pair of handles the stretch of each path from a step on h1 to the first step on h2 at or behind it.

    ``limit`` keeps so many stretches a pair, those of the lowest paths and steps."""
    a = pairs.join(steps.select(F.col("h").alias("h1"), "path", F.col("step").alias("s1")), "h1")
    met = a.join(steps.select(F.col("h").alias("h2"), "path", F.col("step").alias("s2")), ["h2", "path"]).where("s2 >= s1")
    found = met.groupBy("h1", "h2", "path", "s1").agg(F.min("s2").alias("s2"))
    if limit is None:
        return found
    first = Window.partitionBy("h1", "h2").orderBy("path", "s1")
    return found.withColumn("r", F.row_number().over(first)).where(F.col("r") <= limit).drop("r")


def distances(found: DataFrame, offsets: DataFrame, most: int | None = None) -> DataFrame:
    """Sub-paths with dist, the bases strictly between both vertices (0 for one vertex); above ``most`` they fall out."""
    a = offsets.select("path", F.col("step").alias("s1"), (F.col("off") + F.col("len")).alias("end1"))
    b = offsets.select("path", F.col("step").alias("s2"), F.col("off").alias("off2"))
    out = found.join(a, ["path", "s1"]).join(b, ["path", "s2"]).withColumn("dist", F.greatest(F.col("off2") - F.col("end1"), F.lit(0))).drop("off2", "end1")
    return out if most is None else out.where(F.col("dist") <= most)


# --- known and novel elements ------------------------------------------------------------------


def known_vertices(steps: DataFrame) -> DataFrame:
    return steps.where("not consensus").select("h").distinct()


def known_edges(steps: DataFrame) -> DataFrame:
    return distinct_edges(steps.where("not consensus"))


def novel_vertices(steps: DataFrame) -> DataFrame:
    """(h): vertices in their orientation that only consensus paths walk."""
    return steps.where("consensus").select("h").distinct().join(known_vertices(steps), "h", "left_anti")


def novel_edges(steps: DataFrame) -> DataFrame:
    return distinct_edges(steps.where("consensus")).join(known_edges(steps), ["h1", "h2"], "left_anti")


def _supported(elements: DataFrame, support: DataFrame, key: list[str], least: int) -> DataFrame:
    # distinct (element, read) first: both steps combine before they shuffle
    reads = elements.join(support, "path").select(*key, "read").distinct()
    return reads.groupBy(*key).agg(F.count(F.lit(1)).alias("supp")).where(F.col("supp") >= least)


def supported_vertices(steps: DataFrame, support: DataFrame, least: int = 2) -> DataFrame:
    """Novel oriented vertices with the number of different reads behind all consensus paths through them."""
    uses = steps.where("consensus").select("path", "h").distinct()
    return _supported(uses.join(novel_vertices(steps), "h", "left_semi"), support, ["h"], least)


def supported_edges(steps: DataFrame, support: DataFrame, least: int = 2) -> DataFrame:
    uses = path_edges(steps.where("consensus")).select("path", "h1", "h2").distinct()
    return _supported(uses.join(novel_edges(steps), ["h1", "h2"], "left_semi"), support, ["h1", "h2"], least)


def removable_vertices(steps: DataFrame, support: DataFrame, least: int = 2) -> DataFrame:
    """(vid): novel vertices neither orientation of which has the support; either one reaching it keeps both."""
    novel = novel_vertices(steps).select(handle_id(F.col("h")).alias("vid")).distinct()
    known = known_vertices(steps).select(handle_id(F.col("h")).alias("vid")).distinct()
    kept = supported_vertices(steps, support, least).select(handle_id(F.col("h")).alias("vid"))
    return novel.join(known, "vid", "left_anti").join(kept, "vid", "left_anti")


def fewest_novel(candidates: DataFrame, known: DataFrame, group: str, key: str) -> DataFrame:
    """(group, key, n_novel): for each group the candidate walk with the fewest vertices not in ``known``,
    the lowest key on ties; groups with a walk without any novel vertex fall out."""
    marked = candidates.join(known.select("h", F.lit(0).alias("new")), "h", "left")
    counted = marked.groupBy(group, key).agg(F.sum(F.coalesce("new", F.lit(1))).alias("n_novel"))
    best = counted.groupBy(group).agg(F.min(F.struct("n_novel", key)).alias("x"))
    return best.select(group, F.col(f"x.{key}").alias(key), F.col("x.n_novel").alias("n_novel")).where("n_novel > 0")


def novel_usage(steps: DataFrame, mapped: DataFrame) -> DataFrame:
    """(h, uses): how many mapped walks use each novel vertex, 0 included."""
    uses = mapped.select("path", "h").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("uses"))
    return novel_vertices(steps).join(uses, "h", "left").select("h", F.coalesce("uses", F.lit(0)).alias("uses"))


def mirrored(edges: DataFrame) -> DataFrame:
    """The edges and each of them walked the other way round, so that in-neighbours are out-neighbours too."""
    return edges.unionByName(edges.select(flip(F.col("h2")).alias("h1"), flip(F.col("h1")).alias("h2"))).distinct()


def redundant_siblings(edges: DataFrame, segments: DataFrame, novel: DataFrame) -> DataFrame:
    """(h1, v, w): out-neighbours v of one vertex that are novel and spell the same as another one, w.

    Sequences meet by their neighbour, length and hash and are then compared as a whole."""
    seq = segments.select("vid", "seq")
    outs = edges.withColumn("vid", handle_id(F.col("h2"))).join(seq, "vid").select("h1", F.col("h2").alias("v"), F.when(F.col("h2") % 2 == 1, reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"))
    outs = outs.withColumns({"n": F.length("seq"), "x": F.xxhash64("seq")})
    left = outs.join(novel.select(F.col("h").alias("v")), "v", "left_semi")
    right = outs.select("h1", "n", "x", F.col("v").alias("w"), F.col("seq").alias("other"))
    return left.join(right, ["h1", "n", "x"]).where("v <> w and seq = other").select("h1", "v", "w").distinct()


def stranded_subpaths(pairs: DataFrame, steps: DataFrame, strands: int = 3, limit: int | None = None, reference_only: bool = False) -> DataFrame:
    """(h1, h2, strand, path, s1, s2): as ``subpaths``, on the strands of the mask (1 is +, 2 is -, 3 both).

    On the - strand a path goes from the turned h2 to the turned h1; s1 and s2 are its steps on the
    turned h1 and h2, so s1 is the greater one. ``limit`` counts both strands together, the + strand first."""
    own = steps.where("is_ref") if reference_only else steps
    parts = []
    if strands & 1:
        parts.append(subpaths(pairs, own).withColumn("strand", F.lit("+")))
    if strands & 2:
        turned = subpaths(pairs.select(flip(F.col("h2")).alias("h1"), flip(F.col("h1")).alias("h2")), own)
        parts.append(turned.select(flip(F.col("h2")).alias("h1"), flip(F.col("h1")).alias("h2"), "path", F.col("s2").alias("s1"), F.col("s1").alias("s2"), F.lit("-").alias("strand")))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if limit is not None:
        first = Window.partitionBy("h1", "h2").orderBy("strand", "path", "s1")
        found = found.withColumn("r", F.row_number().over(first)).where(F.col("r") <= limit).drop("r")
    return found.select("h1", "h2", "strand", "path", "s1", "s2")


# --- recursion ---------------------------------------------------------------------------------


def spellings(targets: DataFrame, edges: DataFrame, segments: DataFrame, most: int = 1024) -> DataFrame:
    """(key, walk): the walks of the graph from ``source`` to ``sink`` that spell ``seq``, for targets
    (key, source, sink, seq); of over ``most`` walks of a key those of the lowest handles, compared from the source on.

    From the sink backwards, the places at which a vertex can stand so that the rest of the target
    is spelled to its end are found first: one row a (key, vertex, place), however many walks
    lead through it. Walks then grow from the source over these places only, so each of them
    comes to the sink, and those beyond the lowest ``most`` can go. Vertices without letters are
    left out, so each round gets further; the longest target bounds the rounds.
    """
    segs = segments.where("length(seq) > 0").select("vid", "seq")
    both = segs.select((F.col("vid") * 2).alias("h"), F.col("seq").alias("x")).unionByName(segs.select((F.col("vid") * 2 + 1).alias("h"), reverse_complement(F.col("seq")).alias("x")))
    befores = cut(edges.join(both, F.col("h1") == F.col("h")).select("h2", "h1", "x"))
    start = targets.join(both, F.col("sink") == F.col("h")).where(F.col("seq").endswith(F.col("x")))
    state = cut(start.select("key", "h", (F.length("seq") - F.length("x")).alias("pos")))
    live, texts, n = state, cut(targets.select("key", "seq")), 0
    while not state.isEmpty():
        n += 1
        grown = state.where("pos > 0").join(befores, F.col("h") == F.col("h2")).join(texts, "key")
        at = F.col("pos") - F.length("x")
        grown = grown.where((at >= 0) & (F.substr("seq", at + 1, F.length("x")) == F.col("x")))
        state = cut(grown.select("key", F.col("h1").alias("h"), at.alias("pos")).distinct().join(live, ["key", "h", "pos"], "left_anti"))
        live = live.unionByName(state)
        if n % 8 == 0:
            live = cut(live)
    live = cut(live)
    lengths = both.select("h", F.length("x").alias("len"))
    whole = targets.select("key", "source", "sink", F.length("seq").alias("n"))
    state = whole.join(live.where("pos = 0"), "key").where("h = source").join(lengths, "h")
    state = cut(state.select("key", "sink", "n", F.col("h").alias("at"), F.col("len").alias("pos"), F.array("h").alias("walk")))
    done = None
    nexts = cut(edges.join(lengths, F.col("h2") == F.col("h")).select("h1", "h2", "len"))
    first = Window.partitionBy("key").orderBy("walk")
    while True:
        ends = state.where("at = sink and pos = n").select("key", "walk")
        done = ends if done is None else done.unionByName(ends)
        grown = state.where("pos < n").join(nexts, F.col("at") == F.col("h1"))
        held = live.select("key", F.col("h").alias("h2"), "pos")
        grown = grown.join(held, ["key", "h2", "pos"], "left_semi").select("key", "sink", "n", F.col("h2").alias("at"), (F.col("pos") + F.col("len")).alias("pos"), F.concat("walk", F.array("h2")).alias("walk"))
        state = cut(grown.withColumn("r", F.row_number().over(first)).where(F.col("r") <= most).drop("r"))
        if state.isEmpty():
            return done.withColumn("r", F.row_number().over(first)).where(F.col("r") <= most).drop("r")


def first_reached(sources: DataFrame, edges: DataFrame, wanted: DataFrame, rounds: int | None = None) -> DataFrame:
    """(vid, depth, found): for each source the number of steps along the edges to the nearest wanted vertex; the lowest of these at that depth.

    Edges are (a, b) on plain vertices; a source that is wanted itself is found at depth 0. The
    search starts from all wanted vertices at once and goes against the edges: a vertex one step
    before those of a depth takes the lowest of what they have found. So each vertex is settled
    once, and the search ends when none is left, or after ``rounds`` steps.
    """
    back = cut(edges.select("a", "b").distinct())
    frontier = cut(wanted.select("vid").distinct().withColumn("depth", F.lit(0)).withColumn("found", F.col("vid")))
    settled, depth = frontier, 0
    while depth != rounds and not frontier.isEmpty():
        depth += 1
        step = back.join(frontier.select(F.col("vid").alias("b"), "found"), "b").groupBy(F.col("a").alias("vid")).agg(F.min("found").alias("found"))
        frontier = cut(step.join(settled.select("vid"), "vid", "left_anti").select("vid", F.lit(depth).alias("depth"), "found"))
        settled = settled.unionByName(frontier)
        if depth % 8 == 0:
            settled = cut(settled)
    return sources.select("vid").distinct().join(settled, "vid").select("vid", "depth", "found")


def components(vertices: DataFrame, edges: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(vid, component): weakly connected components, each named by its lowest vertex.

    Labels go to the neighbours and then jump to the label of their label, so paths shorten by
    half in each round. Each round is a few combined aggregations, written to the checkpoint
    folder; the rounds end when no label changes. Rows of a label that many vertices share are
    never shuffled by it (``join_to_unique``).
    """
    pairs = edges.select("a", "b").where("a <> b")
    both = cut(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = vertices.select("vid", F.col("vid").alias("l")).distinct()
    while True:
        near = both.join(label, both["b"] == label["vid"]).groupBy("a").agg(F.min("l").alias("m"))
        low = label.join(near, label["vid"] == near["a"], "left").select("vid", "l", F.least("l", "m").alias("n"))
        # the old label's vertex learns the lower one as well
        told = low.groupBy(F.col("l").alias("vid")).agg(F.min("n").alias("t"))
        low = cut(low.join(told, "vid", "left").select("vid", "l", F.least("n", "t").alias("n")))
        up = low.select(F.col("vid").alias("n"), F.col("n").alias("j"))
        jumped = cut(join_to_unique(low, up, "n", "left", crowded).select("vid", F.col("l").alias("old"), F.least("n", "j").alias("l")))
        label = jumped.select("vid", "l")
        if jumped.where("old <> l").isEmpty():
            return label.select("vid", F.col("l").alias("component"))


def chain_heads(vertices: DataFrame, joined: DataFrame, key: str = "vid", crowded: int = CROWDED) -> DataFrame:
    """(key, head, place) of chains given by edges (a, b) with one way out of a and one into b.

    Each vertex jumps to the pointer of its pointer, so the number of rounds is the logarithm of
    the number of edges. Vertices of closed rings never reach a head and stay alone. A head that
    many vertices share isn't shuffled by (``join_to_unique``)."""
    joined = cut(joined.select(F.col("b").alias(key), F.col("a").alias("up")))
    state = cut(vertices.select(key).distinct().join(joined, key, "left").select(key, F.coalesce("up", key).alias("head"), F.col("up").isNotNull().cast("bigint").alias("place")))
    for _ in range(joined.count().bit_length()):
        up = state.select(F.col(key).alias("head"), F.col("head").alias("h2"), F.col("place").alias("p2"))
        state = cut(join_to_unique(state, up, "head", "inner", crowded).select(key, F.col("h2").alias("head"), (F.col("place") + F.col("p2")).alias("place")))
    inner = joined.select(F.col(key).alias("head"), F.lit(True).alias("ring"))
    own = F.coalesce("ring", F.lit(False))
    return join_to_unique(state, inner, "head", "left", crowded).select(key, F.when(own, F.col(key)).otherwise(F.col("head")).alias("head"), F.when(own, 0).otherwise(F.col("place")).cast("bigint").alias("place"))


def unary_chains(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(vid, head, place): vertices on chains without branches, with the first vertex of the chain and their place in it.

    An edge (a, b) joins a chain if a has no other way out and b no other way in."""
    out = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("b")).where("n = 1")
    inn = edges.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("a")).where("n = 1")
    return chain_heads(vertices, out.select("a", "b").join(inn.select("a", "b"), ["a", "b"]).where("a <> b"))


def renumbered(segments: DataFrame, order: list[str]) -> DataFrame:
    """(vid, new): dense numbers from 1 in the given order."""
    return dense_index(segments, order, "new").select("vid", "new")


def rewritten_walks(steps: DataFrame, mapping: DataFrame) -> DataFrame:
    """(path, walk): ``>1<2`` with new numbers; a walk with an unmapped vertex loses that step."""
    text = F.concat(F.when(F.col("rev"), "<").otherwise(">"), F.col("new").cast("string"))
    rows = steps.join(mapping, "vid").select("path", "step", text.alias("x"))
    return rows.groupBy("path").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("step", "x"))), lambda s: s["x"])).alias("walk"))


def subgraph(steps: DataFrame, paths: DataFrame, samples: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Paths of the samples with the vertices and edges they walk: (steps, vertices, edges)."""
    kept = paths.join(samples.select("sample"), "sample", "left_semi")
    own = steps.join(kept.select("path"), "path", "left_semi")
    return own, own.select("vid").distinct(), distinct_edges(own)
