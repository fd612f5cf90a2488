"""One surviving record for each group of duplicates."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage import cut

#: Trust of a source that isn't listed: below all others.
UNLISTED = (1 << 31) - 1


def plain_name(name: Column) -> Column:
    """Blanks and tabs around it removed, cut at the first blank or tab, lower case; null stays null."""
    return F.lower(F.regexp_extract(name, "^[ \\t]*([^ \\t]*)", 1))


def best_spans(alignments: DataFrame, aligners: DataFrame) -> DataFrame:
    """(name, aln_id, qs, qe, nm, n): for each group of two or more records of one name that has a
    usable span, the record voted best, and the best known nm.

    The vote on a column is weighted lexicographically: a record weighs more than all that come
    after it in the order of preference together, so the heaviest token of a column is that of
    the first record that has one. That is the maximum of an ordered struct, which is combined
    before the shuffle: no group is ever gathered. Ties end at the lowest aln_id. Null names are
    left out; a group without usable span has no row; nm is -1 where none is known.
    """
    trust = aligners.select("aligner", "trust_rank").where("aligner is not null")
    rows = alignments.select("aln_id", "name", "qlen", "qs", "qe", "nm", "aligner", "loaded_at").where("name is not null").join(trust, "aligner", "left")
    usable = F.coalesce((F.col("qs") >= 0) & (F.col("qs") < F.col("qe")) & (F.col("qe") <= F.col("qlen")), F.lit(False))
    known = F.coalesce(F.col("nm") >= 0, F.lit(False))
    rank = -F.coalesce("trust_rank", F.lit(UNLISTED))
    lesser = F.struct(rank.alias("trust"), F.col("loaded_at"), (-F.col("aln_id")).alias("id"))
    span = F.struct((F.col("qe") - F.col("qs")).alias("span"), known.alias("known"), F.when(known, -F.col("nm")).alias("nm"), lesser.alias("o"), "qs", "qe")
    groups = rows.groupBy(plain_name(F.col("name")).alias("name")).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(usable, span)).alias("a"),
        F.max(F.when(known, F.struct(lesser.alias("o"), F.col("nm")))).alias("b"),
    )
    nm = F.when(F.col("a.known"), -F.col("a.nm")).otherwise(F.coalesce("b.nm", F.lit(-1)))
    return groups.where("n > 1 and a is not null").select(
        "name", (-F.col("a.o.id")).alias("aln_id"), F.col("a.qs").alias("qs"), F.col("a.qe").alias("qe"), nm.cast("int").alias("nm"), "n"
    )


# --- consensus over tokens -------------------------------------------------------------------

_GAP = ""


def _align(profile: list[dict], other: list[dict]) -> list[dict]:
    """Two profiles (for each column the weight of each token) aligned globally into one.

    Two columns score by the weight of the tokens they agree on; a column against nothing scores
    the weight of its gaps. Ties prefer a match, then the left profile's column.
    """
    wa, wb = (sum(p[0].values()) if p else 0.0 for p in (profile, other))
    n, m = len(profile), len(other)
    match = [[sum(min(w / wa, b.get(t, 0.0) / wb) for t, w in a.items() if t != _GAP) * 2 - 1 for b in other] for a in profile]
    score = [[0.0] * (m + 1) for _ in range(n + 1)]
    back = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if not i and not j:
                continue
            best = -math.inf
            for way, di, dj in ((0, 1, 1), (1, 1, 0), (2, 0, 1)):
                if i < di or j < dj:
                    continue
                add = match[i - 1][j - 1] if way == 0 else -0.6
                if (s := score[i - di][j - dj] + add) > best:
                    best, back[i][j] = s, way
            score[i][j] = best
    out: list[dict] = []
    i, j = n, m
    while i or j:
        way = back[i][j]
        a = profile[i - 1] if way != 2 else {_GAP: wa}
        b = other[j - 1] if way != 1 else {_GAP: wb}
        out.append({t: a.get(t, 0.0) + b.get(t, 0.0) for t in {**a, **b}})
        i, j = i - (way != 2), j - (way != 1)
    return out[::-1]


def _vote(profile: list[dict]) -> list[str]:
    """The heaviest token of each column, the first in order on ties; gaps fall out."""
    tokens = [min(col, key=lambda t: (-col[t], t)) for col in profile]
    return [t for t in tokens if t != _GAP]


def _distance(a: list[str], b: list[str]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


_COLUMN = T.ArrayType(T.StructType([T.StructField("t", T.StringType()), T.StructField("w", T.DoubleType())]))
_PROFILE = T.ArrayType(_COLUMN)
_ARROW_PROFILE = pa.list_(pa.list_(pa.struct([("t", pa.string()), ("w", pa.float64())])))


@F.arrow_udf(_PROFILE)
def _merge(profiles: pa.Array) -> pa.Array:
    """Each list of profiles progressively aligned into one, the heaviest first."""
    out = []
    for many in profiles.to_pylist():
        parts = [[{x["t"]: x["w"] for x in col} for col in p] for p in many]
        parts = [p for p in parts if p]
        parts.sort(key=lambda p: (-sum(p[0].values()), _vote(p)))
        whole: list[dict] = parts[0] if parts else []
        for p in parts[1:]:
            whole = _align(whole, p)
        out.append([[{"t": t, "w": w} for t, w in sorted(col.items())] for col in whole])
    return pa.array(out, _ARROW_PROFILE)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _voted(profile: pa.Array) -> pa.Array:
    return pa.array([_vote([{x["t"]: x["w"] for x in col} for col in p]) for p in profile.to_pylist()], pa.list_(pa.string()))


@F.arrow_udf(T.IntegerType())
def _away(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([_distance(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int32())


def consensus_value(df: DataFrame, key: str, value: str, weight: Column, tokens: str, block: int = 32) -> DataFrame:
    """(key, value, consensus, n_values): for each key the existing value closest to the consensus of all.

    Values are cut into tokens by the pattern ``tokens``; equal ones are added up first. Groups
    are aligned in blocks of about ``block`` values, block profiles are aligned with each other
    in further rounds, tokens are voted by weight for each column, and the value with the least
    edit distance (then the heaviest, then the first in order) comes out. Rows with null key or
    value take no part; a value without any token has the empty profile.

    The number of rounds is the logarithm of the largest group, so no task holds a whole one.
    """
    values = cut(
        df.select(F.col(key).alias("key"), F.col(value).alias("value"), weight.cast("double").alias("w"))
        .where("key is not null and value is not null")
        .groupBy("key", "value")
        .agg(F.sum("w").alias("w"))
        .withColumn("tokens", F.regexp_extract_all("value", F.lit(tokens), F.lit(0)))
    )
    sizes = values.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    alone = values.join(sizes.where("n = 1").select("key"), "key", "left_semi")
    many = values.join(sizes.where("n > 1"), "key")
    column = lambda t: F.array(F.struct(t.alias("t"), F.col("w").alias("w")))
    profiles = many.select("key", "n", F.xxhash64("value").alias("h"), F.transform("tokens", column).alias("p"))
    left = most
    while left > 1:
        parts = F.greatest(F.ceil(F.col("n") / block), F.lit(1))
        met = profiles.groupBy("key", F.pmod("h", parts).alias("h")).agg(F.first(parts).alias("n"), F.collect_list("p").alias("p"))
        profiles = met.select("key", "n", F.xxhash64("h").alias("h"), F.when(F.size("p") > 1, _merge("p")).otherwise(F.col("p")[0]).alias("p"))
        left = math.ceil(left / block)
    voted = profiles.select("key", _voted("p").alias("consensus"))
    near = many.join(voted, "key").withColumn("d", _away("tokens", "consensus"))
    best = near.groupBy("key").agg(
        F.min(F.struct("d", (-F.col("w")).alias("w"), "value")).alias("x"), F.first("consensus").alias("consensus"), F.first("n").alias("n_values")
    )
    chosen = best.select("key", F.col("x.value").alias("value"), "consensus", "n_values")
    return chosen.unionByName(alone.select("key", "value", F.col("tokens").alias("consensus"), F.lit(1).cast("bigint").alias("n_values")))
