"""Column expressions on DNA-like strings, walks and alignment strings. All stay in the JVM."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters to their complements; all others stay.
_FROM, _TO = "ACGTacgt", "TGCAtgca"
LARGEST_K = 31


def _check(k: int) -> None:
    if not 1 <= k <= LARGEST_K:
        raise ValueError(f"k must be from 1 to {LARGEST_K}")


def reverse_complement(seq: Column) -> Column:
    """Null stays null; letters other than A, C, G, T (either case) are kept where they fall."""
    return F.reverse(F.translate(seq, _FROM, _TO))


def canonical(word: Column) -> Column:
    """The lesser of a word and its reverse complement; at a fixed length, string order is code order."""
    return F.least(word, reverse_complement(word))


def encode(word: Column, k: int) -> Column:
    """2-bit code (A=0, C=1, G=2, T=3, first letter highest) of a word of k letters; null if it has other letters."""
    _check(k)
    ok = (F.length(word) == k) & (F.translate(word, "ACGT", "") == "")
    return F.when(ok, F.conv(F.translate(word, "ACGT", "0123"), 4, 10).cast("bigint"))


def decode(code: Column, k: int) -> Column:
    """The word of a 2-bit code; null for codes out of range."""
    _check(k)
    ok = (code >= 0) & (code < F.lit(1 << (2 * k)).cast("decimal(20,0)"))
    return F.when(ok, F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT"))


def reverse_complement_code(code: Column, k: int) -> Column:
    """Of a 2-bit code of k letters; bit operations only."""
    _check(k)
    x = F.bitwise_not(code)
    for shift, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        m = F.lit(mask).cast("bigint")
        x = F.shiftrightunsigned(x, shift).bitwiseAND(m).bitwiseOR(F.shiftleft(x.bitwiseAND(m), shift))
    return F.shiftrightunsigned(x, 64 - 2 * k)


def words(seq: Column, k: int, step: int = 1) -> Column:
    """Array of all words of k letters; null for shorter sequences."""
    return F.when(F.length(seq) >= k, F.transform(F.sequence(F.lit(1), F.length(seq) - k + 1, F.lit(step)), lambda i: F.substring(seq, i, F.lit(k))))


def kmers(df: DataFrame, seq: str, k: int, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with pos (0-based), kmer (canonical) and rev (whether the other strand is the canonical one).

    Case is ignored; words with letters other than A, C, G, T are left out, so are null and short sequences."""
    _check(k)
    rows = df.select(*keep, F.posexplode(words(F.upper(F.col(seq)), k)).alias("pos", "__w"))
    rows = rows.where(F.translate("__w", "ACGT", "") == "")
    other = reverse_complement(F.col("__w"))
    return rows.select(*keep, "pos", F.least("__w", other).alias("kmer"), (other < F.col("__w")).alias("rev"))


def sampled(kmer: Column, density: float) -> Column:
    """Keeps a share of all k-mers by their hash, the same ones everywhere; 1 keeps all.

    The hash is compared as an unsigned number, by flipping its sign bit."""
    if not 0 < density <= 1:
        raise ValueError("density must be above 0 and at most 1")
    if density == 1:
        return F.lit(True)
    return F.xxhash64(kmer) <= F.lit(int(density * 2**64) - 2**63)


def sampled_code(code: Column, density: float) -> Column:
    """As ``sampled``, by the XXH64 hash with seed 0 of the eight bytes of a k-mer's code, as other tools sample."""
    if not 0 < density <= 1:
        raise ValueError("density must be above 0 and at most 1")
    return F.lit(True) if density == 1 else xxh64_of_long(code) <= F.lit(int(density * 2**64) - 2**63)


@F.arrow_udf(T.LongType())
def xxh64_of_long(value: pa.Array) -> pa.Array:
    """XXH64 with seed 0 of the eight little-endian bytes of each number, its sign bit flipped so that signed order is its order.

    Spark's own xxhash64 has another seed, and wrap-around sums aren't to be had as expressions."""
    given = value.is_valid().to_numpy(zero_copy_only=False)
    x = value.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
    # fixed values: the primes of the hash
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
    turn = lambda v, n: (v << np.uint64(n)) | (v >> np.uint64(64 - n))
    with np.errstate(over="ignore"):
        h = np.full(len(x), p5 + np.uint64(8), np.uint64) ^ (turn(x * p2, 31) * p1)
        h = turn(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        h ^= h >> np.uint64(32)
    return pa.array((h ^ np.uint64(1 << 63)).view(np.int64), pa.int64(), mask=~given)


def overlapping_windows(length: Column, size: int) -> Column:
    """Array of (start, end) windows of ``size`` at steps of half of it; one window for anything shorter than it."""
    step = max(1, size // 2)
    many = F.transform(F.sequence(F.lit(0), length - 1, F.lit(step)), lambda s: F.struct(s.alias("start"), F.least(s + size, length).alias("end")))
    return F.when(length >= size, many).when(length > 0, F.array(F.struct(F.lit(0).alias("start"), length.alias("end"))))


def walk(path: Column) -> Column:
    """``>a<b`` as an array of (id, rev)."""
    parts = F.regexp_extract_all(path, F.lit("[<>][^<>]+"), F.lit(0))
    return F.transform(parts, lambda x: F.struct(F.substring(x, F.lit(2), F.length(x)).alias("id"), x.startswith("<").alias("rev")))


def walk_text(steps: Column) -> Column:
    return F.concat_ws("", F.transform(steps, lambda s: F.concat(F.when(s["rev"], "<").otherwise(">"), s["id"])))


def cigar(text: Column) -> Column:
    """A CIGAR as an array of (len, op)."""
    parts = F.regexp_extract_all(text, F.lit("[0-9]+[MIDNSHP=X]"), F.lit(0))
    return F.transform(parts, lambda x: F.struct(F.regexp_extract(x, "[0-9]+", 0).cast("int").alias("len"), F.right(x, F.lit(1)).alias("op")))


def cigar_text(ops: Column) -> Column:
    return F.concat_ws("", F.transform(ops, lambda o: F.concat(o["len"].cast("string"), o["op"])))


def cigar_sum(text: Column, ops: str) -> Column:
    """Total length of the operations in ``ops``; 0 if there are none."""
    return F.aggregate(cigar(text), F.lit(0).cast("bigint"), lambda a, o: a + F.when(o["op"].isin(*ops), o["len"]).otherwise(0))


def cigar_expand(text: Column) -> Column:
    """One letter an aligned column."""
    return F.concat_ws("", F.transform(cigar(text), lambda o: F.repeat(o["op"], o["len"])))


def merge_operations(ops: Column) -> Column:
    """Neighbouring operations of one kind as one, in an array of (len, op)."""
    start = F.filter(ops, lambda o: F.lit(False))

    def add(acc, o):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct((last["len"] + o["len"]).alias("len"), o["op"].alias("op"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["op"] == o["op"]), joined).otherwise(F.concat(acc, F.array(o)))

    return F.aggregate(ops, start, add)


def run_length(seq: Column, at: Column) -> Column:
    """Length of the run of equal letters that starts at 0-based position ``at``."""
    rest = F.substring(seq, at + 1, F.length(seq))
    return F.length(F.regexp_extract(rest, "^(.)\\1*", 0))


def harmonic_mean(a: Column, b: Column) -> Column:
    return F.lit(2.0) * a * b / (a + b)


def near_ratio(a: Column, b: Column, least: float = 0.9) -> Column:
    """Whether the smaller of two positive numbers is over ``least`` of the larger."""
    return (a > 0) & (b > 0) & (F.least(a, b) / F.greatest(a, b) > least)


def pack_handle(vid: Column, rev: Column) -> Column:
    """An oriented vertex as one number."""
    return F.shiftleft(vid, 1).bitwiseOR(rev.cast("bigint"))


def handle_id(handle: Column) -> Column:
    return F.shiftright(handle, 1)


def handle_rev(handle: Column) -> Column:
    return handle.bitwiseAND(F.lit(1)) == 1
