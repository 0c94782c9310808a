"""Writers for metrics and training batches."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def metric_documents(metrics: DataFrame) -> DataFrame:
    """One row per origin holding its flat ``name[-category] -> value`` map.

    The map holds metrics x categories entries; rows of the data never reach it.
    """
    name = F.when(F.col("category").isNull(), F.col("metric")).otherwise(
        F.concat_ws("-", "metric", "category")
    )
    entries = F.sort_array(F.collect_list(F.struct(name.alias("key"), F.col("value"))))
    return metrics.groupBy("origin").agg(F.map_from_entries(entries).alias("metrics"))


def metrics_json(metrics: DataFrame) -> DataFrame:
    """One indented JSON document per origin, non-ASCII text kept as is."""
    text = F.to_json("metrics", {"pretty": "true", "ignoreNullFields": "false"})
    return metric_documents(metrics).select("origin", text.alias("document"))


def write_metrics_json(metrics: DataFrame, path: str, mode: str = "error") -> None:
    """Write the documents as JSON, one folder per origin."""
    metric_documents(metrics).write.mode(mode).partitionBy("origin").json(
        path, ignoreNullFields="false"
    )


def write_metrics_document(metrics: DataFrame, path: str, mode: str = "error") -> None:
    """Write one indented JSON document, origin -> metrics, as a text file in the folder ``path``."""
    entries = F.sort_array(F.collect_list(F.struct("origin", "pairs")))
    pairs = F.sort_array(F.map_entries("metrics")).alias("pairs")
    whole = F.transform(entries, lambda e: F.struct(e["origin"], F.map_from_entries(e["pairs"])))
    text = F.to_json(F.map_from_entries(whole), {"pretty": "true", "ignoreNullFields": "false"})
    document = metric_documents(metrics).select("origin", pairs).agg(text.alias("value"))
    document.coalesce(1).write.mode(mode).text(path)


def export_training_batches(batches: DataFrame, path: str, epoch: int, mode: str = "error", n_files: int | None = None) -> None:
    """Write packed and padded batches to parquet in the folder ``epoch=<epoch>`` below ``path``.

    ``mode`` concerns that folder alone: no epoch can touch another. Files in the order of their
    names hold batches in order, a batch lies in one file, and its rows follow their slots: batches
    are range-partitioned by number, into ``n_files`` or as many as Spark finds fit. A manifest beside the data (``_manifest/epoch=<epoch>``) has a
    row per file: ``file, first_batch, last_batch, n_rows``; :func:`read_training_batches` uses it.
    """
    root, spark = path.rstrip("/"), batches.sparkSession
    order = [c for c in ("batch_id", "slot") if c in batches.columns]
    ranged = batches.repartitionByRange(*([n_files] if n_files else []), "batch_id").sortWithinPartitions(*order)
    ranged.write.mode(mode).parquet(f"{root}/epoch={epoch}")
    written = spark.read.parquet(f"{root}/epoch={epoch}")
    manifest = written.groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.min("batch_id").alias("first_batch"), F.max("batch_id").alias("last_batch"), F.count("*").alias("n_rows")
    )
    manifest.write.mode("overwrite").parquet(f"{root}/_manifest/epoch={epoch}")


def read_training_batches(spark: SparkSession, path: str, epoch: int, from_batch: int = 0) -> DataFrame:
    """The exported batches of an epoch from ``from_batch`` on, as after a stop: only the files that hold
    such batches are opened."""
    root = path.rstrip("/")
    manifest = spark.read.parquet(f"{root}/_manifest/epoch={epoch}")
    files = [r["file"] for r in manifest.where(F.col("last_batch") >= from_batch).orderBy("first_batch").select("file").collect()]
    every = spark.read.parquet(f"{root}/epoch={epoch}")
    if not files:
        return every.limit(0)
    chosen = spark.read.schema(every.schema).parquet(*[f"{root}/epoch={epoch}/{unquote(f)}" for f in files])
    return chosen.where(F.col("batch_id") >= from_batch)
