"""k-mers and windows of letters as numbers, made in batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .letters import letters

#: Letters worked on at once; longer texts are taken in parts that overlap.
PART = 1 << 20
LARGEST_K = 31

_CODE = np.full(128, 4, np.uint8)
for _i, _pair in enumerate((b"Aa", b"Cc", b"Gg", b"Tt")):
    _CODE[list(_pair)] = _i


def base_codes(codes: np.ndarray) -> np.ndarray:
    """A=0, C=1, G=2, T=3 in either case, 4 for any other letter."""
    return _CODE[codes] if codes.dtype == np.uint8 and not (codes.size and codes.max() > 127) else np.where(codes < 128, _CODE[np.minimum(codes, 127)], 4).astype(np.uint8)


def joined(parts: np.ndarray, bits: int, size: int) -> np.ndarray:
    """For each place, the ``size`` numbers of ``bits`` bits from there on as one, the first one highest."""
    powers, n = [parts.astype(np.int64)], 1
    while n * 2 <= size:
        x = powers[-1]
        powers.append((x[:-n] << bits * n) | x[n:] if len(x) > n else x[:0])
        n *= 2
    out, done = None, 0
    for p in reversed(range(len(powers))):
        if size >> p & 1:
            x = powers[p][done:]
            if out is None:
                out = x
            else:
                m = min(len(x), len(out))
                out = (out[:m] << bits * (1 << p)) | x[:m]
            done += 1 << p
    return out[: max(0, len(parts) - size + 1)]


def rolling(small: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(forward, reverse, known) of the k-mers at each place: codes on both strands, and whether all letters are known."""
    if len(small) < k:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(bool)
    forward = joined(small & 3, 2, k)
    reverse = joined(3 - (small[::-1] & 3), 2, k)[::-1]
    odd = np.concatenate([[0], np.cumsum(small > 3)])
    return forward, reverse, odd[k:] == odd[:-k]


def kmer_codes(df: DataFrame, seq: str, k: int, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with pos (0-based), kmer (canonical, as a 2-bit code) and rev (whether the other strand is the canonical one).

    Case is ignored; words with letters other than A, C, G, T are left out, so are null and short
    sequences. One pass in batches: no array of all words of a sequence is made."""
    if not 1 <= k <= LARGEST_K:
        raise ValueError(f"k must be from 1 to {LARGEST_K}")

    def work(batches):
        for batch in batches:
            codes, offsets = letters(batch.column("__s"))
            small = base_codes(codes)
            for a in range(0, max(0, len(small) - k + 1), PART):
                forward, reverse, known = rolling(small[a : a + PART + k - 1], k)
                at = a + np.flatnonzero(known)
                row = np.searchsorted(offsets, at, side="right") - 1
                inside = at + k <= offsets[row + 1]
                at, row = at[inside], row[inside]
                f, r = forward[at - a], reverse[at - a]
                who = pa.array(row)
                columns = [batch.column(c).take(who) for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, pa.array((at - offsets[row]).astype(np.int32)), pa.array(np.minimum(f, r)), pa.array(r < f)], names=[*keep, "pos", "kmer", "rev"])

    rows = df.select(*keep, F.col(seq).alias("__s")).where(F.length("__s") >= k)
    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
    return rows.mapInArrow(work, f"{kinds}pos int, kmer bigint, rev boolean")


# --- windows of letters in the order of texts --------------------------------------------------

#: Letters of a word: 21 of three bits each.
WORD = 21
#: Fixed values of a letter: the panel's ends sort before all letters, other letters and the reads' ends behind
#: them; those of panel and reads differ, so no match goes beyond an end.
_PANEL = np.full(128, 5, np.uint8)
_READ = np.full(128, 6, np.uint8)
for _table in (_PANEL, _READ):
    for _i, _pair in enumerate((b"Aa", b"Cc", b"Gg", b"Tt")):
        _table[list(_pair)] = _i + 1
PANEL_END, READ_END = 0, 7


def symbols(codes: np.ndarray, panel: bool) -> np.ndarray:
    kind = _PANEL if panel else _READ
    return np.where(codes < 128, kind[np.minimum(codes, 127)], kind[0])


def window_words(own: np.ndarray, ends: np.ndarray, at: np.ndarray, words: int, end: int) -> list[np.ndarray]:
    """For each place ``at``, the letters from there on as ``words`` numbers; behind ``ends`` of its text all is ``end``."""
    whole = joined(np.concatenate([own, np.zeros(WORD, np.uint8)]), 3, WORD)
    left = range(WORD + 1)
    keep = np.array([((1 << 63) - 1) ^ ((1 << 3 * (WORD - n)) - 1) for n in left], np.int64)
    fill = np.array([sum(end << 3 * j for j in range(WORD - n)) for n in left], np.int64)
    out = []
    for w in range(words):
        place = at + w * WORD
        n = np.clip(ends - place, 0, WORD)
        out.append((whole[np.minimum(place, len(whole) - 1)] & keep[n]) | fill[n])
    return out


def common_letters(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many letters two windows have in common from their start on."""
    out = np.zeros(len(a[0]), np.int64)
    alive = np.ones(len(a[0]), bool)
    for x, y in zip(a, b):
        d = x ^ y
        high = d >> 32
        # the length of a 32-bit number is exact in a float
        bits = np.where(high > 0, 32 + np.frexp(high.astype(np.float64))[1], np.frexp((d & 0xFFFFFFFF).astype(np.float64))[1])
        out += np.where(alive, np.where(d == 0, WORD, (63 - bits) // 3), 0)
        alive &= d == 0
    return out
