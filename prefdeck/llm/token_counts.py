"""Token counts through a cache of content digests."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefdeck.llm.common import batch, concat_schema, flat_bytes, map_arrow, shared_folder, text_column, text_slices
from prefdeck.llm.tokenizer import SLICE_BYTES, TokenizerFile

CACHE_SCHEMA = "content binary, version string, n_tokens long"
_COUNTED = concat_schema(content=pa.binary(), n_tokens=pa.int64())


def content_digest(text, words_alone: bool):
    """Digest of the normalised content. Where the tokenizer drops white space, every run of ASCII
    white space counts as one space, which cannot change the ids; else the text counts as it is."""
    same = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")) if words_alone else text
    return F.unhex(F.sha2(same, 256))


def read_cache(spark, path: str) -> DataFrame:
    """One row per stored (content, version); an append that was repeated counts once."""
    rows = spark.read.schema(CACHE_SCHEMA).parquet(path)
    return rows.groupBy("content", "version").agg(F.max("n_tokens").alias("n_tokens"))


def encode_misses(misses: DataFrame, tokenizer: TokenizerFile) -> DataFrame:
    """``content, n_tokens`` of distinct texts ``content, text``."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

    def count(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = tokenizer.encoder()
        for rows in batches:
            data, offsets = flat_bytes(rows.column(1))
            for low, high in text_slices(offsets, SLICE_BYTES):
                counts = encoder.count(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                yield batch(_COUNTED, rows.column(0)[low:high], counts)

    return map_arrow(misses.select("content", "text"), count, "content binary, n_tokens long")


def token_counts(
    docs: DataFrame,
    tokenizer: TokenizerFile,
    limit: int,
    cache_path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` per row of ``docs``.

    Contents are digested, joined to the counts stored under the tokenizer's version at
    ``cache_path``, and only distinct misses are encoded and appended there. ``cache_path`` is
    Parquet in a folder that all executors share; without one a new cache is begun. Copies fold
    into one row before the shuffle, so a text that a third of all rows repeat costs one row per
    task. A NULL text is empty and has no tokens; an empty text likewise. Repeated rows (NULL ids
    too) each give a row. Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    version = tokenizer.version()
    path = cache_path or shared_folder(spark)
    if not cache_path:
        spark.createDataFrame([], CACHE_SCHEMA).write.parquet(path)

    rows = docs.select(
        F.col(id_col).alias("id"), text_column(docs, text_col).alias("text")
    ).withColumn("content", content_digest(F.col("text"), tokenizer.words_alone))
    known = read_cache(spark, path).where(F.col("version") == version)
    misses = (
        rows.select("content", "text")
        .dropDuplicates(["content"])
        .join(known.select("content"), "content", "left_anti")
    )
    encode_misses(misses, tokenizer).select(
        "content", F.lit(version).alias("version"), "n_tokens"
    ).write.mode("append").parquet(path)

    counts = read_cache(spark, path).where(F.col("version") == version)
    return (
        rows.select("id", "content", F.octet_length("text").cast("long").alias("n_bytes"))
        .join(counts.select("content", "n_tokens"), "content", "left")
        .select(
            F.col("id").alias(id_col),
            "n_bytes",
            "n_tokens",
            (F.col("n_tokens") > limit).alias("over_limit"),
        )
    )
