"""Joins on keys that a large part of all rows may share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key from which it is taken out of the shuffle; below 2^40 rows there are fewer than 2^20 such keys.
CROWDED = 1 << 20


def join_to_unique(df: DataFrame, right: DataFrame, key: str, how: str = "inner", crowded: int = CROWDED) -> DataFrame:
    """``df`` joined (inner or left) with ``right``, which has one row a key.

    Rows of crowded keys stay where they are and get their one row of ``right`` sent to all tasks;
    there are at most as many of these as ``crowded`` goes into the rows of ``df``."""
    hot = [r[0] for r in df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > crowded).select(key).collect()]
    if not hot:
        return df.join(right, key, how)
    keys = F.broadcast(df.sparkSession.createDataFrame([(k,) for k in hot], df.select(key).schema))
    few = F.broadcast(right.join(keys, key, "left_semi"))
    return df.join(keys, key, "left_anti").join(right, key, how).unionByName(df.join(keys, key, "left_semi").join(few, key, how))


def join_counted(df: DataFrame, right: DataFrame, on: list[str], how: str = "inner", count: str = "n", crowded: int = CROWDED) -> DataFrame:
    """``df`` joined (inner or left_semi) with ``right``, which has one row a key and in ``count`` how many rows of ``df`` have it.

    As ``join_to_unique``, but what is crowded is read off ``right``, which should be a written table.
    The column ``count`` isn't in the result."""
    big = right.where(F.col(count) > crowded)
    rest = right.where(F.col(count) <= crowded).drop(count)
    if big.isEmpty():
        return df.join(rest, on, how)
    big = F.broadcast(big.drop(count))
    return df.join(F.broadcast(big.select(*on)), on, "left_anti").join(rest, on, how).unionByName(df.join(big, on, how))
