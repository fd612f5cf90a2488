"""Strings of an Arrow batch as one flat array of letters, and small vector helpers on it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def letters(column) -> tuple[np.ndarray, np.ndarray]:
    """(codes, offsets): the code points of all strings one after another; string i is
    ``codes[offsets[i]:offsets[i + 1]]``. Nulls count as empty. ASCII batches are not copied."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_string_view(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if n == 0 or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if data.size and data.max() >= 0x80:
        sizes = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        return codes, np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
    return data, offsets


def ascii_upper(codes: np.ndarray) -> np.ndarray:
    """Upper case for a-z; one byte a letter, and 0 for every letter outside ASCII."""
    if codes.dtype != np.uint8:
        codes = np.where(codes < 128, codes, 0).astype(np.uint8)
    return np.where((codes >= 97) & (codes <= 122), codes - 32, codes)


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The index of its string, for each letter."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All of starts[i], starts[i] + 1, ..., starts[i] + sizes[i] - 1, one i after another."""
    total = int(sizes.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    keep = sizes > 0
    starts, sizes = starts[keep].astype(np.int64), sizes[keep].astype(np.int64)
    step = np.ones(total, np.int64)
    step[0] = starts[0]
    ends = np.cumsum(sizes)[:-1]
    step[ends] = starts[1:] - (starts[:-1] + sizes[:-1] - 1)
    return np.cumsum(step)


def chunks(batches, key: str, least: int):
    """Regroups sorted Arrow batches: tables of at least ``least`` rows whose last key value is complete."""
    held, rows = [], 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held)
        keys = batch.column(key)
        last = keys[batch.num_rows - 1]
        same = pc.fill_null(pc.equal(keys, last), False)
        # the run of the last key at the end of this batch stays for the next round
        mask = same.to_numpy(zero_copy_only=False)
        tail = batch.num_rows if mask.all() else int(np.argmin(mask[::-1]))
        if tail == batch.num_rows:
            if table.column(key)[0].equals(last):
                continue
            whole = pc.fill_null(pc.equal(table.column(key), last), False).to_numpy()
            tail = int(np.argmin(whole[::-1]))
        cut = table.num_rows - tail
        yield table.slice(0, cut)
        held = table.slice(cut).combine_chunks().to_batches()
        rows = tail
    if rows:
        yield pa.Table.from_batches(held)
