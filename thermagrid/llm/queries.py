"""The registered queries of this folder and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (bloom_lm, filter_audit, graph_ann, html_extract, jaccard_join, langid, license_scan, mixing,
               packing, quality, spelling, suffix_repeats, toxicity)
from .common import table
from .oracles import ORACLES  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    out = langid.identify_folds(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "held_out", "lang_pred", "score")


@register
def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.main_text(table(spark, sf_dir, "pages"))


@register
def op3_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to strings of 400 bytes that occur elsewhere."""
    return suffix_repeats.repeat_report(table(spark, sf_dir, "documents"))


@register
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license text or notice in every document, with coverage and span."""
    return license_scan.find_licenses(table(spark, sf_dir, "documents"))


@register
def op5_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    return packing.pack(table(spark, sf_dir, "documents"))


@register
def op6_similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and component of every document."""
    return jaccard_join.link_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@register
def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model log-probability of every whole document."""
    out = bloom_lm.score_folds(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@register
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    out = quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@register
def op9_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows found for every twentieth vector."""
    return graph_ann.nearest(table(spark, sf_dir, "embeddings"))


@register
def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    out = mixing.mix(table(spark, sf_dir, "documents"), carry_text=False)
    return out.select("doc_id", "size", "source_size", "target", "taken", "virtual_finish")


@register
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in every order, by source."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word with its near words, its more frequent form and its root."""
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


@register
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document."""
    return toxicity.score_folds(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
