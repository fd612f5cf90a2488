"""Encoding of whole collections with a public tokenizer, by forced boundaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import certain_cuts, encoder, vocabulary

#: Bytes from which a fragment may end at the next certain cut.
LEAST = 256


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = pa.compute.fill_null(column, "") if column.null_count else column
    column = column.cast(pa.string()) if column.type != pa.string() else column
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def fragments(data: np.ndarray, offsets: np.ndarray, path: str, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(starts, rows): where the fragments of all texts begin. In each window of ``least`` bytes
    of a text, counted from its start, the first certain cut is taken."""
    starts, ends = offsets[:-1], offsets[1:]
    full = np.flatnonzero(ends > starts)
    cuts = np.flatnonzero(certain_cuts(data, path))
    row = np.searchsorted(ends, cuts, side="right")
    inside = cuts > starts[row] if len(cuts) else np.zeros(0, bool)
    cuts, row = cuts[inside], row[inside]
    window = (cuts - starts[row]) // least
    first = np.ones(len(cuts), bool)
    first[1:] = (row[1:] != row[:-1]) | (window[1:] != window[:-1])
    at = np.concatenate([starts[full], cuts[first & (window > 0)]])
    who = np.concatenate([full, row[first & (window > 0)]])
    order = np.argsort(at, kind="stable")
    return at[order], who[order]


def encode_batch(column: pa.Array, path: str, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of all texts; null and empty ones have no ids. Equal fragments are encoded once a batch."""
    data, offsets = _bytes(column)
    at, row = fragments(data, offsets, path, least)
    raw = data.tobytes()
    encode = encoder(path).encode_ordinary
    known: dict[bytes, np.ndarray] = {}
    parts = []
    for a, b in zip(at.tolist(), np.append(at[1:], len(data)).tolist()):
        piece = raw[a:b]
        ids = known.get(piece)
        if ids is None:
            ids = known[piece] = np.array(encode(piece.decode("utf-8", "replace")), np.int32)
        parts.append(ids)
    sizes = np.zeros(len(offsets) - 1, np.int64)
    np.add.at(sizes, row, [len(p) for p in parts])
    return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), np.concatenate([[0], np.cumsum(sizes)])


def _parts(batches, block: int = 1 << 22):
    for batch in batches:
        at, n = 0, batch.num_rows
        total = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        while at < n:
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + block)))
            yield batch.slice(at, end - at)
            at = end


def encode_texts(texts: DataFrame, path: str | None = None, least: int = LEAST) -> DataFrame:
    """(id, ids) for each row of (id, text): its token ids, without special tokens.

    Strings that look like special tokens are ordinary text. A null text, like an empty one,
    gives an empty list; rows with a null id and repeated rows are encoded like others.

    Each text is cut at pairs of bytes that no token holds, its fragments are encoded one by one
    and their ids put together. One pass without shuffle; a batch holds some megabytes of text,
    or one text.
    """
    path = path or vocabulary()

    def work(batches):
        for part in _parts(batches):
            ids, offsets = encode_batch(part.column("text"), path, least)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))], names=["id", "ids"])

    return texts.select(F.col("id").cast("bigint").alias("id"), "text").mapInArrow(work, "id bigint, ids array<int>")


def token_counts(texts: DataFrame, path: str | None = None) -> DataFrame:
    """(id, n): the number of tokens of each row of (id, text); 0 for null and empty texts."""
    path = path or vocabulary()

    def work(batches):
        for part in _parts(batches):
            n = np.diff(encode_batch(part.column("text"), path)[1])
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n)], names=["id", "n"])

    return texts.select(F.col("id").cast("bigint").alias("id"), "text").mapInArrow(work, "id bigint, n bigint")
