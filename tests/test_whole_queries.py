"""Queries whose results leave nothing out."""

from __future__ import annotations

from pyspark.sql import functions as F

from kmerloom.operators import generate
from kmerloom.plans import registry
from kmerloom.plans.common import sequences


def test_counts_of_63_have_all_windows(spark, sf_dir):
    got = registry.queries()["kmer_count_63"](spark, sf_dir).agg(F.sum("count"), F.min("count")).first()
    assert tuple(got) == (generate.kmers(sequences(spark, sf_dir), 63).count(), 1)


def test_position_index_answers_all_prefixes(spark, sf_dir):
    got = registry.queries()["kmer_position_index_query"](spark, sf_dir)
    assert {r.p for r in got.select(F.substring("kmer", 1, 1).alias("p")).distinct().collect()} == set("ACGT")
