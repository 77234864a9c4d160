"""A training corpus from ``documents``: STAGES in order, each a function of
(spark, docs, sf_dir) that works on all its predecessor kept.

Quality rules drop what they reject; of each group of similar documents one
stays; strings of 200 bytes that still occur twice are cut out (a passage of some fifty
words is shorter than the 400 bytes of op3); sources are mixed
to their weights (whole documents, repeated or left out as taken); the result is
packed into windows. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from thermagrid.llm import jaccard_join, mixing, packing, quality, suffix_repeats
from thermagrid.llm.common import materialise, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def jaccard_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


#: Passages of over 50 words have about 300 bytes.
REPEATED = suffix_repeats.Strings(length=200, anchor=100)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_repeats.cut_documents(docs, REPEATED)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join_stage),
    ("suffix_dedup", suffix_dedup),
    ("mix_sources", mix_sources),
    ("pack_windows", pack_windows),
]
#: SQL cannot express the tokens and the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
