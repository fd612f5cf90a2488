"""Texts of several tables as records under one bigint."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.letters import letters
from ..plans.tables import table

#: The tables with sequences, their ids and texts; the place is the low bit of ``rid``.
SOURCES = (("sfs", "sfs_id", "plain_seq"), ("cand_paths", "cp_id", "sequence"))


def usable(column: str):
    return f"{column} is not null and {column} <> '' and {column} <> '.'"


def sequence_records(spark, sf_dir: str) -> DataFrame:
    """(rid, text) of both tables, usable texts only."""
    parts = [
        table(spark, sf_dir, name).where(usable(text)).select((F.col(key) * 2 + i).alias("rid"), F.col(text).alias("text"))
        for i, (name, key, text) in enumerate(SOURCES)
    ]
    return reduce(DataFrame.unionByName, parts)


def named(rid: str = "rid"):
    """The columns src and rec_id of a ``rid``."""
    src = F.when(F.pmod(rid, F.lit(2)) == 0, SOURCES[0][0]).otherwise(SOURCES[1][0])
    return src.alias("src"), F.shiftright(rid, 1).alias("rec_id")


def slices(batches, column: str = "text", block: int = 1 << 21):
    """(batch, codes, offsets) of Arrow batches in parts of about ``block`` bytes of text, never cutting a text."""
    for batch in batches:
        at, n = 0, batch.num_rows
        total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        while at < n:
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + block)))
            part = batch.slice(at, end - at)
            yield (part, *letters(part.column(column)))
            at = end
