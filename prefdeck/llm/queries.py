"""One registered query per operator, over whole tables, with the parameters of production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefdeck.llm import (
    decontamination, filter_audit, merkle, mixing, packing, quality_classifier, quality_rules, simhash, suffix_dedup, token_counts, toxicity,
    url_filters, warc,
)
from prefdeck.llm.common import table
from prefdeck.llm.tokenizer import WORD_BPE

Query = Callable[[SparkSession, str], DataFrame]

SEQUENCE_TOKENS = 2048
QUALITY_CUT, TOXIC_CUT = 0.3, 0.7
MIX_WEIGHTS, MIX_EPOCHS, MIX_SEED = (5.0, 2.0, 1.0), 3.0, 0
RULES = (
    url_filters.Rule("allow", "org", "/"),
    url_filters.Rule("block", "example.org", "/es/"),
    url_filters.Rule("block", "example.org", "/en/1"),
    url_filters.Rule("allow", "com", "/fr/"),
    url_filters.Rule("block", "com", "/de/"),
)


def fold_of(doc_id, folds: int):
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacity = packing.Capacity(tokens=SEQUENCE_TOKENS)
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORD_BPE, capacity)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_classifier.quality_scores(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), usable=fold_of(F.col("doc_id"), 5) != 0
    )
    held_out = F.coalesce(fold_of(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), WORD_BPE, SEQUENCE_TOKENS)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(table(spark, sf_dir, "pages"), RULES)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), usable=fold_of(F.col("doc_id"), 3) != 1
    )
    held_out = F.coalesce(fold_of(F.col("doc_id"), 3) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC_CUT).cast("int").alias("predicted"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(
        table(spark, sf_dir, "documents"),
        tampered={"text": merkle.folded_case(F.col("text"))},
        where=fold_of(F.col("doc_id"), 3) == 0,
    )


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_EPOCHS, seed=MIX_SEED)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_quality_classifier, op3_benchmark_decontamination, op4_token_counts,
        op5_suffix_array_dedup, op6_simhash_near_dedup, op7_quality_rules, op8_url_filters, op9_warc, op10_toxicity,
        op11_merkle_manifest, op12_source_mixing, op13_filter_audit,
    )
}
