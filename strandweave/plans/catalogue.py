"""All queries of the core, by name."""

from __future__ import annotations

from . import cleaning, file_queries, graph_queries, kmer_queries, report_queries

MODULES = (cleaning, kmer_queries, graph_queries, report_queries, file_queries)


def queries():
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}


def entry(spark, sf_dir):
    return kmer_queries.kan_missed_per_read(spark, sf_dir)
