"""Queries of the subpackage, by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.seqexpr import reverse_complement_code
from ..plans.tables import table
from .bpe import vocabulary
from .encode import encode_texts, token_counts
from .neardup import near_classes, near_duplicates
from .records import named, sequence_records, usable
from .pack import packed
from .runs import collapse_units
from .spans import repeated_letters, shared_letters
from .split import Budget, split_texts
from .survivor import best_spans, consensus_value, plain_name
from .terms import term_counts, term_pairs, vector_terms

#: Fixed value: letters in the k-mers of the table sketch.
SKETCH_K = 21


def p2_found(spark, sf_dir):
    """Letters of each record that lie in stretches of 50 or more found in another record."""
    found = shared_letters(sequence_records(spark, sf_dir), 50)
    return found.select(*named(), F.col("n_shared").cast("int").alias("n_shared"))


def p2_removed(spark, sf_dir):
    """Letters of each record that are to go where each stretch of 50 or more is to stay in its first place only."""
    found = repeated_letters(sequence_records(spark, sf_dir), 50)
    return found.select(*named(), F.col("n_shared").cast("int").alias("n_removed"))


def _terms(spark, sf_dir):
    """Counts of all terms of both tables, with the number of records of each table."""
    code = F.col("sxs")
    sketch = table(spark, sf_dir, "sketch").where("sxs >= 0").select("sketch_id", F.least(code, reverse_complement_code(code, SKETCH_K)).alias("term"))
    vectors = table(spark, sf_dir, "cand_paths").select("cp_id", "kcounts")
    counts = term_counts(term_pairs(sketch, "sketch", "term", "sketch_id"), "sketch").unionByName(term_counts(vector_terms(vectors, "kcounts", "kcounts", "cp_id"), "kcounts"))
    records = (
        sketch.where("sketch_id is not null").select("sketch_id").distinct().agg(F.count(F.lit(1)).alias("records")).withColumn("src", F.lit("sketch"))
    ).unionByName(vectors.where(F.size("kcounts") > 0).agg(F.count(F.lit(1)).alias("records")).withColumn("src", F.lit("kcounts")))
    n, of = F.col("n_records"), F.col("records")
    mark = F.when(F.col("src") == "sketch", F.when(n == 1, "rare").when(n * 5 >= of, "common")).otherwise(F.when(n * 20 <= of, "rare").when(n * 5 >= of * 2, "common"))
    # two rows, whatever the input
    return counts.join(F.broadcast(records), "src").select("src", "term", "total", "n_records", mark.alias("mark"))


def p3_found(spark, sf_dir):
    """The terms that are too rare or too common."""
    return _terms(spark, sf_dir).where("mark is not null").select("src", "term", "mark")


def p3_counts(spark, sf_dir):
    """Every term with its total, its number of records and its mark."""
    return _terms(spark, sf_dir)


def p5_found(spark, sf_dir):
    """Runs of units of one to three letters."""
    found = collapse_units(sequence_records(spark, sf_dir))
    return found.select(*named(), "unit", "start_pos", "run_len")


def p6_found(spark, sf_dir):
    """The best span and the best known nm of each consensus name."""
    return best_spans(table(spark, sf_dir, "gaf"), table(spark, sf_dir, "aligners")).drop("n")


def p6_consensus(spark, sf_dir):
    """For each consensus name the record whose span and nm are closest to the vote of all records, trusted aligners weighing more."""
    aligners = table(spark, sf_dir, "aligners").where("aligner is not null").select("aligner", "trust_rank")
    gaf = table(spark, sf_dir, "gaf").where("qs >= 0 and qs < qe and qe <= qlen").select("name", "qs", "qe", "nm", "aligner").join(aligners, "aligner", "left")
    token = lambda kind, c: F.when(F.col(c) >= 0, F.concat(F.lit(kind), F.col(c).cast("string")))
    rows = gaf.select(plain_name(F.col("name")).alias("key"), F.concat_ws(" ", token("s", "qs"), token("e", "qe"), token("n", "nm")).alias("value"), "trust_rank")
    weight = F.lit(1.0) / F.coalesce("trust_rank", F.lit(100))
    part = lambda kind: F.regexp_extract("value", f"{kind}([0-9]+)", 1).try_cast("bigint")
    found = consensus_value(rows, "key", "value", weight, "[^ ]+")
    return found.select(F.col("key").alias("name"), part("s").alias("qs"), part("e").alias("qe"), F.coalesce(part("n"), F.lit(-1)).cast("int").alias("nm"), "n_values")


def _anchored(spark, sf_dir):
    sfs = table(spark, sf_dir, "sfs").where(usable("plain_seq"))
    return sfs.select(F.col("sfs_id").alias("id"), F.col("sv").alias("v1"), F.col("ev").alias("v2"), F.col("plain_seq").alias("text"))


def p7_found(spark, sf_dir):
    """Pairs of specific strings on a common anchor that differ by small changes only."""
    return near_duplicates(_anchored(spark, sf_dir)).select(F.col("id_a").alias("sfs_id_a"), F.col("id_b").alias("sfs_id_b"))


def p7_groups(spark, sf_dir):
    """Each anchored specific string with its class of copies, its number of links to other classes, and its group."""
    return near_classes(_anchored(spark, sf_dir)).select(F.col("id").alias("sfs_id"), F.col("class").alias("class_id"), "n_links", F.col("group").alias("group_id"))


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def _budgets(spark, sf_dir, purpose: str) -> dict:
    """The budgets of a purpose by tokenizer; the table has a few rows, whatever the scale."""
    rows = table(spark, sf_dir, "token_budgets").where(F.col("purpose") == purpose).orderBy("budget_id").collect()
    return {name: [r for r in rows if r.tokenizer == name] for name in dict.fromkeys(r.tokenizer for r in rows)}


def p8_ids(spark, sf_dir):
    """The token ids of every document."""
    return encode_texts(_documents(spark, sf_dir), vocabulary("byte_bpe_50k")).select(F.col("id").alias("doc_id"), "ids")


def p9_packed(spark, sf_dir):
    """A container for every document, or part of one that is larger than a container, for each budget."""
    out = None
    for name, budgets in _budgets(spark, sf_dir, "pack").items():
        sizes = token_counts(_documents(spark, sf_dir), vocabulary(name))
        one = packed(sizes, {b.budget_id: b.max_tokens for b in budgets})
        out = one if out is None else out.unionByName(one)
    return out.select("budget_id", F.col("id").alias("doc_id"), "part", F.col("n").alias("n_tokens"), "container")


def p9_invariants(spark, sf_dir):
    """What must hold of the containers of each budget: every text once, none overfull, none split without need, well filled."""
    items = cut(p9_packed(spark, sf_dir))
    most = table(spark, sf_dir, "token_budgets").where("purpose = 'pack'").select("budget_id", "max_tokens")
    each = items.groupBy("budget_id", "doc_id").agg(F.count(F.lit(1)).alias("parts"), F.count_distinct("part").alias("kinds"), F.sum("n_tokens").alias("n")).join(F.broadcast(most), "budget_id")
    texts = each.groupBy("budget_id").agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if((F.col("parts") > 1) & (F.col("n") <= F.col("max_tokens"))).alias("split_small"),
        F.count_if((F.col("parts") != F.col("kinds")) | (F.col("parts") != F.greatest(F.ceil(F.col("n") / F.col("max_tokens")), F.lit(1)))).alias("wrong_parts"),
    )
    loads = items.where("n_tokens > 0").groupBy("budget_id", "container").agg(F.sum("n_tokens").alias("n")).join(F.broadcast(most), "budget_id")
    full = loads.groupBy("budget_id").agg(F.count_if(F.col("n") > F.col("max_tokens")).alias("overfull"), (F.sum("n") >= F.lit(0.95) * (F.count(F.lit(1)) - 1) * F.max("max_tokens")).alias("well_filled"))
    return texts.join(full, "budget_id")


def p10_pieces(spark, sf_dir):
    """The pieces of every document above each budget."""
    out = None
    for name, budgets in _budgets(spark, sf_dir, "split").items():
        limits = [Budget(b.budget_id, b.max_tokens, b.overlap_tokens or 0) for b in budgets]
        one = split_texts(_documents(spark, sf_dir), limits, vocabulary(name))
        out = one if out is None else out.unionByName(one)
    return out.withColumnRenamed("id", "doc_id")


def p10_invariants(spark, sf_dir):
    """What must hold of the pieces of each budget: they cover the text, each begins in the one before and beyond its start, none is too large or has another text."""
    pieces = cut(p10_pieces(spark, sf_dir))
    most = table(spark, sf_dir, "token_budgets").where("purpose = 'split'").select("budget_id", "max_tokens")
    texts = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("raw"))
    nxt = pieces.select("budget_id", "doc_id", (F.col("piece") - 1).alias("piece"), F.col("start").alias("next_start"), F.col("end").alias("next_end"))
    rows = pieces.join(nxt, ["budget_id", "doc_id", "piece"], "left").join(texts, "doc_id").join(F.broadcast(most), "budget_id")
    own = F.decode(F.substr("raw", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")), "UTF-8")
    last = F.col("next_start").isNull()
    hole = F.when(last, F.col("end") != F.octet_length("raw")).otherwise((F.col("next_start") > F.col("end")) | (F.col("next_start") <= F.col("start")) | (F.col("next_end") <= F.col("end")))
    return rows.groupBy("budget_id").agg(
        F.count_if(hole | ((F.col("piece") == 0) & (F.col("start") != 0))).alias("holes"), F.count_if(F.col("n_tokens") > F.col("max_tokens")).alias("too_large"), F.count_if(own != F.col("text")).alias("other_text")
    )


QUERIES = {q.__name__: q for q in (p2_found, p2_removed, p3_found, p3_counts, p5_found, p6_found, p6_consensus, p7_found, p7_groups, p8_ids, p9_packed, p9_invariants, p10_pieces, p10_invariants)}
