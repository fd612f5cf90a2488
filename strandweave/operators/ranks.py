"""Dense numbers over a whole table in a given order, with no task that holds all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut


def dense_index(df: DataFrame, order: list[str], name: str = "n", start: int = 1) -> DataFrame:
    """Each row with its number in the order of ``order``, from ``start`` on; these columns should be unique.

    Rows are range-partitioned and kept that way in the checkpoint folder; a partition's numbers
    begin behind the rows of those before, which are summed up over one row a partition."""
    ranged = cut(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    sizes = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = sizes.select("__p", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__o"))
    local = ranged.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    return local.join(F.broadcast(offsets), "__p").withColumn(name, F.col("__o") + F.col("__r") + (start - 1)).drop("__p", "__o", "__r")
