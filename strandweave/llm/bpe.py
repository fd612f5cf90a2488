"""Byte-level BPE with a public vocabulary, and the cuts it never bridges."""

from __future__ import annotations

import base64
from functools import lru_cache
from pathlib import Path

import numpy as np

#: Where the vocabulary files lie; every operator takes the path of one as a parameter.
FOLDER = "/opt/tokenizers"
#: Fixed value: how this vocabulary cuts a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary(name: str = "byte_bpe_50k", folder: str = FOLDER) -> str:
    return str(Path(folder) / f"{name}.tiktoken")


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=4)
def encoder(path: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def token_bytes(path: str) -> np.ndarray:
    """The length in bytes of each token, by id."""
    found = ranks(path)
    out = np.zeros(max(found.values()) + 1, np.int64)
    for token, rank in found.items():
        out[rank] = len(token)
    return out


@lru_cache(maxsize=4)
def joined(path: str) -> np.ndarray:
    """[left, right]: whether any token holds this pair of neighbouring bytes."""
    out = np.zeros((256, 256), bool)
    for token in ranks(path):
        for a, b in zip(token, token[1:]):
            out[a, b] = True
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_WIDE_LEAD = np.zeros(256, bool)
_WIDE_LEAD[[0xE1, 0xE2, 0xE3]] = True
_WIDE_MID = np.zeros(256, bool)
_WIDE_MID[[0x9A, 0x80, 0x81]] = True


def certain_cuts(data: np.ndarray, path: str) -> np.ndarray:
    """For each byte, whether the text may be cut before it and both sides encoded on their own.

    That holds before a character whose first byte never follows the byte before it inside a
    token, as no merge then bridges the cut. Words are cut by a pattern first, so a cut must not
    change its matches either: it looks ahead only after white space (which may not be on the
    left; wide white space is told by its first bytes, which excludes some others too) and tells
    a contraction only from the apostrophe on (which may not be on the right).
    """
    ok = np.zeros(len(data), bool)
    if len(data) < 2:
        return ok
    left, right = data[:-1], data[1:]
    ok[1:] = ~joined(path)[left, right] & ((right & 0xC0) != 0x80) & ~_SPACE[left] & (right != 0x27)
    if left.size and left.max() >= 0x80:
        narrow = (data[:-2] == 0xC2) & ((data[1:-1] == 0x85) | (data[1:-1] == 0xA0))
        ok[2:] &= ~narrow
        wide = _WIDE_LEAD[data[:-3]] & _WIDE_MID[data[1:-2]] & (data[2:-1] >= 0x80)
        ok[3:] &= ~wide
    return ok
