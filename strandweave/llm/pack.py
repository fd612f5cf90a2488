"""Filling containers of fixed capacity, planned over a histogram of lengths."""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut

#: Items of one length in one bucket, about; ranks are counted within buckets.
BUCKET = 50_000


@dataclass
class Plan:
    """Slots: items of ``length`` with ranks from ``rank`` on go to containers from ``first`` on, ``each`` to one."""

    length: np.ndarray
    rank: np.ndarray
    first: np.ndarray
    each: np.ndarray
    containers: int


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best fit, longest first, over counts of lengths from 1 to ``capacity``.

    Containers with the same room left are one group, and a group is filled by one row of the
    plan: each length makes at most two new groups for each one it uses up, so the plan grows
    with the number of lengths, not with the number of items.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> ranges of containers
    sizes: list[int] = []  # the rooms that occur, ascending
    rows: list[tuple[int, int, int, int]] = []
    made = 0

    def free(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in room:
                room[left] = []
                bisect.insort(sizes, left)
            room[left].append((first, n))

    for length in sorted(counts, reverse=True):
        need, rank = counts[length], 0
        while need:
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):
                left = sizes[at]
                first, n = room[left].pop()
                if not room[left]:
                    del room[left], sizes[at]
            else:
                left, first = capacity, made
                n = -(-need // (capacity // length))
                made += n
            each = left // length
            full = min(n, need // each)
            if full:
                rows.append((length, rank, first, each))
                free(left - each * length, first, full)
                need -= full * each
                rank += full * each
            if full < n and need:  # fewer than a container takes are left
                rows.append((length, rank, first + full, need))
                free(left - need * length, first + full, 1)
                rank += need
                need = 0
                full += 1
            free(left, first + full, n - full)
    columns = np.array(rows, np.int64).reshape(-1, 4).T
    return Plan(*columns, made)


def _items(sizes: DataFrame, capacity: int) -> DataFrame:
    """(id, part, n): items above the capacity in parts of it and the rest; others as they are."""
    parts = F.greatest(F.ceil(F.col("n") / capacity), F.lit(1)).cast("int")
    rows = sizes.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return rows.select("id", "part", F.least(F.lit(capacity), F.col("n") - F.col("part") * F.lit(capacity)).cast("int").alias("n"))


def pack(sizes: DataFrame, capacity: int, bucket: int = BUCKET) -> DataFrame:
    """(id, part, n, container) for each row of (id, n).

    No container holds more than ``capacity``, and no item is split unless it is larger: then its
    parts of full capacity have a container each and the rest is an item like others. Items of
    size 0 (or null) go to container 0, where they take no room. Ties and repeated rows are items
    of their own. The same rows give the same containers, however they are partitioned, as long
    as (id, n) isn't repeated.

    The histogram has at most ``capacity`` rows, so it and the plan are made on the driver. An
    item finds its slot by its rank among the items of its length: ranks are counted within
    buckets of bounded size and moved on by the sums of the buckets before, so a length that a
    third of all items have is no task of its own.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    items = _items(sizes.select("id", F.greatest(F.coalesce("n", F.lit(0)), F.lit(0)).alias("n")), capacity)
    counts = {r.n: r["count"] for r in items.groupBy("n").count().collect()}
    plan = best_fit({n: c for n, c in counts.items() if n}, capacity)
    buckets = max(1, max(counts.values(), default=0) // bucket)

    placed = items.withColumn("b", F.pmod(F.xxhash64("id", "part"), F.lit(buckets)).cast("int"))
    local = placed.withColumn("r", F.row_number().over(Window.partitionBy("b", "n").orderBy("id", "part")) - 1)
    if buckets > 1:
        before = Window.partitionBy("n").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        offsets = placed.groupBy("n", "b").agg(F.count(F.lit(1)).alias("c")).select("n", "b", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("o"))
        local = local.join(offsets, ["n", "b"])
    else:
        local = local.withColumn("o", F.lit(0))

    @F.arrow_udf("bigint")
    def slot(n: pa.Array, rank: pa.Array) -> pa.Array:
        keys, first, each = slots.value
        n, rank = n.to_numpy(zero_copy_only=False).astype(np.int64), rank.to_numpy(zero_copy_only=False)
        if not len(keys):
            return pa.array(np.zeros(len(n), np.int64))
        at = np.searchsorted(keys, n << 40 | rank, side="right") - 1
        start = keys[at] & ((1 << 40) - 1)
        return pa.array(np.where(n == 0, 0, first[at] + (rank - start) // each[at]))

    # rows of the plan are found by (length, rank)
    order = np.argsort(plan.length << 40 | plan.rank)
    slots = items.sparkSession.sparkContext.broadcast(((plan.length << 40 | plan.rank)[order], plan.first[order], plan.each[order]))
    return local.select("id", "part", "n", slot("n", (F.col("r") + F.col("o")).cast("bigint")).alias("container"))


def packed(sizes: DataFrame, budgets: dict[int, int]) -> DataFrame:
    """(budget_id, id, part, n, container): the same items packed for each capacity; sizes are made once."""
    kept = cut(sizes)
    out = None
    for budget, capacity in sorted(budgets.items()):
        one = pack(kept, capacity).select(F.lit(budget).alias("budget_id"), "*")
        out = one if out is None else out.unionByName(one)
    return out
