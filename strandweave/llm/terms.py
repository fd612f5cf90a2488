"""How often each distinct term occurs, and in how many records, over whole collections."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.seqexpr import reverse_complement_code  # noqa: F401

_PAIRS = "src string, term bigint, rec bigint, occ bigint"
_NAMES = ["src", "term", "rec", "occ"]


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of sorted keys begins."""
    change = np.zeros(len(keys[0]), bool)
    change[:1] = True
    for key in keys:
        change[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(change)


def term_pairs(df: DataFrame, src: str, term: str, rec: str) -> DataFrame:
    """(src, term, rec, occ): repeated pairs of a batch added up before any shuffle. Rows with a null in either are left out."""

    def work(batches):
        for b in batches:
            t, r = b.column("term").to_numpy(zero_copy_only=False), b.column("rec").to_numpy(zero_copy_only=False)
            order = np.lexsort((r, t))
            t, r = t[order], r[order]
            head = _runs(t, r)
            size = np.diff(np.append(head, len(t)))
            yield pa.RecordBatch.from_arrays([pa.array([src] * len(head), pa.string()), pa.array(t[head]), pa.array(r[head]), pa.array(size)], names=_NAMES)

    rows = df.select(F.col(term).cast("bigint").alias("term"), F.col(rec).cast("bigint").alias("rec")).where("term is not null and rec is not null")
    return rows.mapInArrow(work, _PAIRS)


def vector_terms(df: DataFrame, src: str, counts: str, rec: str | None = None) -> DataFrame:
    """(src, term, rec, occ) of dense count vectors: the position of each count above 0, with its record ``rec``
    (each row is a record of its own without it). Rows with a null record and null or empty vectors
    are left out, null elements count as 0."""

    def work(batches):
        for b in batches:
            col = b.column("v")
            flat = pc.fill_null(col.flatten(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            lengths = pc.list_value_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(lengths)
            hit = np.flatnonzero(flat > 0)
            row = np.searchsorted(ends, hit, side="right")
            yield pa.RecordBatch.from_arrays([pa.array([src] * len(hit), pa.string()), pa.array(hit - (ends - lengths)[row]), b.column("rec").take(pa.array(row)), pa.array(flat[hit])], names=_NAMES)

    who = F.monotonically_increasing_id() if rec is None else F.col(rec).cast("bigint")
    rows = df.select(F.col(counts).alias("v"), who.alias("rec")).where((F.size("v") > 0) & F.col("rec").isNotNull())
    return rows.mapInArrow(work, _PAIRS)


def term_counts(pairs: DataFrame, src: str | None = None) -> DataFrame:
    """(src, term, total, n_records) of all terms in rows from ``term_pairs`` or ``vector_terms``.

    The pairs are range-partitioned and sorted by (term, src, rec), so a term that a third of all
    rows hold is spread over as many partitions as it needs, while equal pairs stay together. One
    scan counts the runs; the parts of a term that lies on a border between partitions are
    added up at the end. No rows give no terms. Where all pairs are of one source, ``src`` names it
    and only numbers are sorted.
    """
    key = ["term", "rec"] if src else ["term", "src", "rec"]
    ordered = (pairs.drop("src") if src else pairs).repartitionByRange(*key).sortWithinPartitions(*key)

    def scan(batches):
        last = None  # the pair that ended the batch before
        for b in batches:
            if not b.num_rows:
                continue
            names = (pa.array([src], pa.string()).take(pa.array(np.zeros(b.num_rows, np.int32))) if src else b.column("src")).dictionary_encode()
            s = names.indices.to_numpy(zero_copy_only=False)
            t, r, occ = (b.column(c).to_numpy(zero_copy_only=False) for c in _NAMES[1:])
            first = np.zeros(len(t), np.int64)
            first[_runs(t, s, r)] = 1
            if (names.dictionary[s[0]].as_py(), t[0], r[0]) == last:
                first[0] = 0
            head = _runs(t, s)
            yield pa.RecordBatch.from_arrays(
                [names.dictionary.take(pa.array(s[head])), pa.array(t[head]), pa.array(np.add.reduceat(occ, head)), pa.array(np.add.reduceat(first, head))],
                names=["src", "term", "total", "n_records"],
            )
            last = (names.dictionary[s[-1]].as_py(), t[-1], r[-1])

    scanned = ordered.mapInArrow(scan, "src string, term bigint, total bigint, n_records bigint")
    return scanned.groupBy("src", "term").agg(F.sum("total").alias("total"), F.sum("n_records").alias("n_records"))
