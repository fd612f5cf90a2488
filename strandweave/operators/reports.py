"""Evaluation reports: best alignments, comparisons, precision and recall, gaps, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import with_previous


def best_alignment(alns: DataFrame, rule: str, least_cov: float = 0.9, query: str = "query", order: str = "aln_id") -> DataFrame:
    """(query, aln_id, cov, nm): one alignment a query by one of six rules; ``order`` is the place in the file.

    a: highest cov, then lowest nm; b: as a, from ``least_cov`` on; c: as b, the first on ties;
    d: from ``least_cov`` on lowest nm, the last on ties; e: highest cov above 0, the first on
    ties; f: from ``least_cov`` on highest share of matches, the first on ties. For a and b any
    of the tied ones would do; the first is taken. Each rule is one least struct, combined
    before the shuffle, so a query with most of the rows is no group of its own.
    """
    keys: dict[str, list[Column]] = {
        "a": [-F.col("cov"), F.col("nm"), F.col(order)],
        "b": [-F.col("cov"), F.col("nm"), F.col(order)],
        "c": [-F.col("cov"), F.col("nm"), F.col(order)],
        "d": [F.col("nm"), -F.col(order)],
        "e": [-F.col("cov"), F.col(order)],
        "f": [-(F.col("matches") / F.col("cigar_len")), F.col(order)],
    }
    rows = alns.where("cov is not null")
    if rule in "bcdf":
        rows = rows.where(F.col("cov") >= least_cov)
    if rule == "e":
        rows = rows.where("cov > 0")
    if rule == "f":
        rows = rows.where("cigar_len > 0")
    struct = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys[rule])), F.col(order).alias("o"), "cov", "nm")
    best = rows.groupBy(query).agg(F.min(struct).alias("x"))
    return best.select(query, F.col("x.o").alias(order), F.col("x.cov").alias("cov"), F.col("x.nm").alias("nm"))


def gain_classes(before: DataFrame, after: DataFrame, key: str = "query") -> DataFrame:
    """(key, class): no gain, worse or better by nm where both aligned, and new only or lost."""
    a, b = before.select(key, F.col("nm").alias("x")), after.select(key, F.col("nm").alias("y"))
    kind = F.when(F.col("x").isNull(), "new only").when(F.col("y").isNull(), "lost").when(F.col("y") < F.col("x"), "better").when(F.col("y") > F.col("x"), "worse").otherwise("no gain")
    return a.join(b, key, "full").select(key, kind.alias("class"))


def share_table(df: DataFrame, by: list[str], good: Column, names: tuple[str, str, str]) -> DataFrame:
    """Number of good rows, of all rows and their ratio by group."""
    hit, total, ratio = names
    return df.groupBy(*by).agg(F.count_if(good).alias(hit), F.count(F.lit(1)).alias(total), F.round(F.avg(good.cast("double")), 6).alias(ratio))


def precision(vertices: DataFrame, by: list[str]) -> DataFrame:
    """By group: supported vertices, all, their ratio, bases weighted by quality, all bases, their ratio; an unknown quality (-1) counts 0."""
    qual = F.when(F.col("qual") == -1, 0.0).otherwise(F.col("qual"))
    weighted = F.sum(qual * F.col("l"))
    return vertices.groupBy(*by).agg(
        F.count_if(F.col("supp") > 0).alias("supported"), F.count("supp").alias("total"), F.round(F.count_if(F.col("supp") > 0) / F.count("supp"), 6).alias("p_vertices"),
        F.round(weighted, 4).alias("supported_bases"), F.sum("l").alias("total_bases"), F.round(weighted / F.sum("l"), 6).alias("p_bases"),
    )


def wide(df: DataFrame, key: str, column: str, value: str, names: list[str], agg=F.min) -> DataFrame:
    """One row a key, one column a name, by conditional aggregates (the names are given, so no pass looks for them)."""
    return df.groupBy(key).agg(*(agg(F.when(F.col(column) == n, F.col(value))).alias(n) for n in names))


def long_form(df: DataFrame, key: str, names: list[str], column: str, value: str) -> DataFrame:
    return df.unpivot([key], names, column, value).where(F.col(value).isNotNull())


def delta_histogram(pairs: DataFrame, a: str, b: str, most: int) -> DataFrame:
    """(delta, n) for every delta from -most to most, 0 included; larger ones are folded into the ends. Null pairs are left out."""
    spark = pairs.sparkSession
    delta = F.greatest(F.least(F.col(a) - F.col(b), F.lit(most)), F.lit(-most)).cast("bigint")
    # least and greatest skip nulls, so these go first
    known = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    counted = known.select(delta.alias("delta")).groupBy("delta").agg(F.count(F.lit(1)).alias("n"))
    frame = spark.range(-most, most + 1).select(F.col("id").alias("delta"))
    return frame.join(counted, "delta", "left").select("delta", F.coalesce("n", F.lit(0)).alias("n"))


def cumulative(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, value, n, total): counts and their running sum. Rows are added up to one a value first."""
    from .ordered import running_sum

    counted = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    return counted.join(running_sum(counted, by, value, "n", 1 << 12, "total"), [by, value])


def percentiles(df: DataFrame, by: str, value: str, shares: list[float], limit: float) -> DataFrame:
    """Count, mean, sample deviation, least, greatest, exact percentiles and the share above a limit.

    Percentiles keep one entry a distinct value, so they suit counts and lengths."""
    agg = [F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_samp(value), 6).alias("std"), F.min(value).alias("least"), F.max(value).alias("greatest")]
    agg += [F.round(F.percentile(value, p), 6).alias(f"p{round(p * 100):02d}") for p in shares]
    return df.groupBy(by).agg(*agg, F.round(F.avg((F.col(value) > limit).cast("double")), 6).alias("above"))


def gap_statistics(spans: DataFrame, order: list[str], limit: int, tile: int) -> DataFrame:
    """(key, overlapping, consecutive, gaps, uncovered, close): each interval (key, s, e) against the one before it.

    ``uncovered`` sums the gaps above ``limit``, ``close`` counts those of at most 100."""
    rows = with_previous(spans, "key", order, ["e"], tile)
    d = F.col("s") - F.col("prev.e")
    return rows.where("prev is not null").groupBy("key").agg(
        F.count_if(d < 0).alias("overlapping"), F.count_if(d == 0).alias("consecutive"), F.count_if(d > 0).alias("gaps"),
        F.sum(F.when(d > limit, d).otherwise(0)).alias("uncovered"), F.count_if((d > 0) & (d <= 100)).alias("close"),
    )


def first_of_each(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row of the least ``order`` of each key (nulls are a key of their own); the rest are duplicates."""
    best = df.groupBy(*key).agg(F.min(F.struct(order, *(c for c in df.columns if c not in key and c != order))).alias("x"), F.count(F.lit(1)).alias("copies"))
    return best.select(*key, "x.*", "copies")


def seeded(key: str, seed: int) -> Column:
    """Eight hexadecimal digits that look random, the same for a key and a seed in every run and in other engines."""
    return F.left(F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string"))), F.lit(8))


def endpoint_category(v1: Column, v2: Column, t1: Column, t2: Column) -> Column:
    """How anchored ends compare with the true ones; ~ is a clipped end."""
    same = ((v1 == t1) & (v2 == t2)) | ((v1 == t2) & (v2 == t1))
    common = F.size(F.array_intersect(F.array(v1, v2), F.array(t1, t2)))
    clip = (t1 == "~") | (t2 == "~")
    clipped = F.when(t1 == t2, "FULL_CLIP").when(common == 1, "HALF_CLIP").otherwise("BAD_CLIP")
    return F.when(same, "GOOD").when(clip, clipped).when(common == 1, "HALF_BAD").otherwise("BAD")


def occurrences(df: DataFrame, key: str, order: str, tile: int = 1 << 16) -> DataFrame:
    """The rows with i, their number within their key in the given order, from 0 on. A hot key is numbered in tiles of ``order``."""
    from .ordered import running_sum

    counts = running_sum(df.withColumn("__one", F.lit(1)), key, order, "__one", tile, "__n")
    return df.join(counts, [key, order]).withColumn("i", F.col("__n") - 1).drop("__n")


def vertices_at(points: DataFrame, ops: DataFrame, vertices: DataFrame, key: str, aln: str) -> DataFrame:
    """(key, q, id): the vertex that an alignment passes at position q of its query; ~ where q is clipped.

    points: (key, aln, qs, qe, q); ops of ``align.operations``; vertices: (aln, id, off, len) along
    the path. Inserted letters lie where their operation stands. Points that the alignment can't place are left out."""
    points = points.distinct()
    clipped = points.where("q < qs or q >= qe").select(key, "q", F.lit("~").alias("id"))
    read = ops.where("op in ('M', '=', 'X', 'I')").select(aln, "op", F.col("len").alias("__l"), "p", F.col("q").alias("__q"))
    inside = points.where("q >= qs and q < qe").withColumn("__at", F.col("q") - F.col("qs"))
    met = inside.join(read, aln).where("__at >= __q and __at < __q + __l")
    met = met.withColumn("__p", F.when(F.col("op") == "I", F.col("p")).otherwise(F.col("p") + F.col("__at") - F.col("__q")))
    on = met.join(vertices, aln).where("__p >= off and __p < off + len")
    return clipped.unionByName(on.groupBy(key, "q").agg(F.min("id").alias("id")))
