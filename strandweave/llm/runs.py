"""Runs of one short unit along texts, each as one event with its place, unit and length."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.letters import ascii_upper, row_of
from .records import slices

#: The least length of a run, for each size of the unit.
LEAST = {1: 8, 2: 12, 3: 15}

_BASE = np.zeros(256, bool)
_BASE[np.frombuffer(b"ACGT", np.uint8)] = True
_N = ord("N")


def unit_runs(codes: np.ndarray, offsets: np.ndarray, least: dict[int, int]):
    """(row, unit, start, length) of the runs in many texts at once.

    Each letter is compared with the one ``unit`` places before; the places where the answer
    changes are flagged and summed up into run numbers, and the runs of equal letters are kept.
    """
    c = ascii_upper(codes)
    n = len(c)
    row = row_of(offsets)
    place = np.arange(n) - offsets[:-1][row]
    base = _BASE[c]
    filled = c.copy()
    if n > 2:
        mid = (c[1:-1] == _N) & (c[:-2] == c[2:]) & base[:-2] & (row[:-2] == row[2:])
        filled[1:-1][mid] = c[:-2][mid]

    def equal(x, unit):
        out = np.zeros(n, bool)
        out[unit:] = (x[unit:] == x[:-unit]) & _BASE[x[unit:]] & (place[unit:] >= unit)
        return out

    single = np.concatenate([[0], np.cumsum(equal(c, 1))])
    found = []
    for unit, shortest in sorted(least.items()):
        same = equal(filled if unit == 1 else c, unit)
        if not n or not same.any():
            continue
        change = np.concatenate([[True], (same[1:] != same[:-1]) | (row[1:] != row[:-1])])
        run = np.cumsum(change) - 1
        first = np.flatnonzero(change)
        length = np.bincount(run)
        hit = same[first] & (length + unit >= shortest)
        start, size = first[hit] - unit, length[hit] + unit
        if unit > 1:  # letters of one kind only are runs of unit 1
            mixed = single[start + size] - single[start + 1] < size - 1
            start, size = start[mixed], size[mixed]
        found.append((row[start], np.full(len(start), unit), place[start], size))
    if not found:
        return [np.zeros(0, np.int64)] * 4
    return [np.concatenate(x) for x in zip(*found)]


def collapse_units(texts: DataFrame, least: dict[int, int] | None = None) -> DataFrame:
    """(rid, unit, start_pos, run_len) of each maximal run in the texts of (rid, text).

    A run of a unit of u letters is a stretch of A, C, G, T (case ignored) in which each letter
    from the u + 1st on equals the one u places before, and that can't be made longer; stretches
    of one letter only count for unit 1. For unit 1 a single N between two equal letters is read
    as that letter. Null and empty texts have no runs; repeated rows give repeated runs. One pass
    over the texts, with no shuffle; a text is never cut, however long.
    """
    least = dict(least or LEAST)

    def work(batches):
        for batch, codes, offsets in slices(batches):
            row, unit, start, size = unit_runs(codes, offsets, least)
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid").take(pa.array(row)), pa.array(unit.astype(np.int32)), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32))],
                names=["rid", "unit", "start_pos", "run_len"],
            )

    return texts.select("rid", "text").mapInArrow(work, "rid bigint, unit int, start_pos int, run_len int")
