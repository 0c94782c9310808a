"""Fused data as stored tables: parsed, fused and numbered once, then read by every later job."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefdeck.operators.fuse import Fused
from prefdeck.operators.samples import RESPONSE_KEY, explode_responses, index_labels

SAMPLE_KEY = ["origin", "input_id", "output_id"]
# A bucket is one file; at 128 MB each, 4,096 of them hold half a terabyte. More data wants more.
BUCKETS = 64


@dataclass(frozen=True)
class Stored:
    """Samples as :func:`explode_responses` gives them, and labels ``origin, input_id, chosen_id, rejected_id``."""

    samples: DataFrame
    labels: DataFrame


def _quoted(path: str) -> str:
    return "'" + path.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _folder(path: str) -> str:
    return path.rstrip("/")


def _table_name(path: str) -> str:
    return f"prefdeck_{hashlib.md5(_folder(path).encode()).hexdigest()}"


def write_fused(fused: Fused, path: str, buckets: int = BUCKETS, compat_ranks: bool = False) -> Stored:
    """Write the samples and labels of ``fused`` to the new folder ``path`` and read them from there.

    Samples are bucketed and sorted by their unique key ``(origin, input_id, output_id)``, so a prompt
    with a third of all responses fills all buckets alike, and a join on that key moves the other
    side alone. The prompt's fields stand in each sample (sorted, so repeated prompts compress away): reading
    needs no join at all. Labels are not bucketed, as one answer may hold many of them. ``buckets``
    should make files of about 128 MB. A folder that holds a store already is an error.
    """
    root = _folder(path)
    samples = explode_responses(fused, compat_ranks)
    (
        samples.repartition(buckets, *SAMPLE_KEY)
        .write.format("parquet")
        .bucketBy(buckets, *SAMPLE_KEY)
        .sortBy(*SAMPLE_KEY)
        .option("path", f"{root}/samples")
        .saveAsTable(_table_name(root))
    )
    spark = samples.sparkSession
    ids = spark.table(_table_name(root)).select(*RESPONSE_KEY, "input_id", "output_id")
    labels = index_labels(fused.annotations, ids)
    labels.select("origin", "input_id", "chosen_id", "rejected_id").write.parquet(f"{root}/labels")
    # Written last: a store without it is not whole.
    spark.range(1).select(F.lit(buckets).alias("buckets")).write.json(f"{root}/layout")
    return read_fused(spark, root)


def read_fused(spark: SparkSession, path: str) -> Stored:
    """A store that this or another session has written. No record is parsed, and samples are laid out
    by their key. Buckets are known to Spark through a table, so one is declared over the folder
    if the session's catalog has none; no data is written or moved."""
    root = _folder(path)
    buckets = spark.read.schema("buckets int").json(f"{root}/layout").first()["buckets"]
    name = _table_name(root)
    if not spark.catalog.tableExists(name):
        found = spark.read.parquet(f"{root}/samples").schema
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found)
        keys = ", ".join(SAMPLE_KEY)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
            f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION {_quoted(root + '/samples')}"
        )
    return Stored(spark.table(name), spark.read.parquet(f"{root}/labels"))
