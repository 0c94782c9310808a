"""From raw documents to packed sequences, in five stages that are each written and read again."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark import cloudpickle  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import prefdeck  # noqa: E402
from prefdeck.llm import decontamination, packing, simhash, suffix_dedup, toxicity  # noqa: E402
from prefdeck.llm.common import stored, table  # noqa: E402
from prefdeck.llm.queries import SEQUENCE_TOKENS, TOXIC_CUT, fold_of  # noqa: E402
from prefdeck.llm.tokenizer import WORD_BPE  # noqa: E402

# Python workers need not have this folder on their path: ship the functions themselves.
cloudpickle.register_pickle_by_value(prefdeck)

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below the cut. NULL and empty texts stay."""
    usable = fold_of(F.col("doc_id"), 3) != 1
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"), usable, TOXIC_CUT)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints over 3-word shingles are linked at 2 or fewer of 64
    bits: that with the smallest id, NULL ids last. All texts without words are one group."""
    return simhash.drop_near_duplicates(docs, shingle=3, distance=2)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that an earlier document (or place) has in a string of 100
    bytes; ``n_chars``, where there is one, counts what is left."""
    cut = suffix_dedup.remove_repeats(docs, carry=docs.columns)
    text = F.when(F.col("carry")["text"].isNotNull(), F.col("kept"))
    columns = [
        text.alias(c) if c == "text"
        else F.length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
        else F.col("carry")[c].alias(c)
        for c in docs.columns
    ]
    return cut.select(columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule leaves. Rows are judged by id and text together."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    return packing.pack_documents(docs, WORD_BPE, packing.Capacity(tokens=SEQUENCE_TOKENS))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("simhash_near_dedup", without_near_copies),
    ("suffix_array_dedup", without_repeats),
    ("benchmark_decontamination", without_benchmark),
    ("best_fit_packing", packed),
]

# Tokenizers, fingerprints and learned lexicons are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
