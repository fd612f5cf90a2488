"""Neighbours and running sums along an entity's positions, in tiles, so a hot entity is no task of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_previous(df: DataFrame, key: str, order: list[str], values: list[str], tile: int, name: str = "prev") -> DataFrame:
    """Each row with ``name``, a struct of ``values`` of the row before it of the same key (null for the first).

    Rows are ordered by ``order``, whose first column is a number; its tiles of ``tile`` are
    windows of their own, and a tile's first row gets the last row of the nearest tile before."""
    rows = df.withColumn("__t", F.floor(F.col(order[0]) / tile))
    own = F.struct(*values)
    local = Window.partitionBy(key, "__t").orderBy(*order)
    rows = rows.withColumn("__l", F.lag(own).over(local))
    last = df.withColumn("__t", F.floor(F.col(order[0]) / tile)).groupBy(key, "__t").agg(F.max(F.struct(F.struct(*order).alias("o"), own.alias("v"))).alias("m"))
    before = last.select(key, "__t", F.lag("m").over(Window.partitionBy(key).orderBy("__t"))["v"].alias("__b"))
    return rows.join(before, [key, "__t"]).withColumn(name, F.coalesce("__l", "__b")).drop("__t", "__l", "__b")


def running_sum(df: DataFrame, key: str, position: str, value: str, tile: int, name: str = "sum") -> DataFrame:
    """(key, position, name): the sum of ``value`` at all positions up to this one, one row a position."""
    rows = df.groupBy(key, position).agg(F.sum(value).alias("__v")).withColumn("__t", F.floor(F.col(position) / tile))
    total = rows.groupBy(key, "__t").agg(F.sum("__v").alias("__s"))
    before = total.select(key, "__t", F.coalesce(F.sum("__s").over(Window.partitionBy(key).orderBy("__t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    local = F.sum("__v").over(Window.partitionBy(key, "__t").orderBy(position))
    return rows.withColumn("__l", local).join(before, [key, "__t"]).select(key, position, (F.col("__l") + F.col("__b")).alias(name))


def depth(spans: DataFrame, tile: int = 1 << 16) -> DataFrame:
    """(key, s, e, depth): stretches of constant depth of (key, s, e) intervals, those of depth 0 left out."""
    steps = spans.where("key is not null and s < e").select("key", F.explode(F.array(F.struct(F.col("s").alias("p"), F.lit(1).alias("v")), F.struct(F.col("e").alias("p"), F.lit(-1).alias("v")))).alias("x"))
    sums = running_sum(steps.select("key", "x.p", "x.v"), "key", "p", "v", tile, "depth")
    pairs = with_previous(sums, "key", ["p"], ["p", "depth"], tile)
    return pairs.where("prev.depth > 0").select("key", F.col("prev.p").alias("s"), F.col("p").alias("e"), F.col("prev.depth").alias("depth"))
