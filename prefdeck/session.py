"""Session settings the operators rely on, and lineage cutting."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings only, so they can be applied to a session somebody else created.
# forceOptimizeSkewedJoin lets AQE split a hot join key even where that costs one more shuffle;
# with allowDuplicateKeys the last of equal keys of a JSON object counts.
# Tasks are dealt by bytes: rows that are narrow in a shuffle or a file take a hundred times their size
# in the sorts and maps of a task, so small tasks keep its memory the same however large the tables are.
SQL_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "400",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.files.maxPartitionBytes": "16m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession, fallback_dir: str | None = None) -> str:
    """The folder that all executors share: the one in ``spark.checkpoint.dir``, else ``fallback_dir``.
    Without either, a local session gets a temporary folder; on a cluster it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or fallback_dir
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="prefdeck-")


def materialize(df: DataFrame, fallback_dir: str | None = None) -> DataFrame:
    """Write ``df`` once to the cluster's shared checkpoint folder and read it back from there.

    Used where something expensive (a model call) feeds several branches of a plan: computed per
    branch, an answer that differs from call to call would go into different metrics. The folder is
    that of :func:`shared_folder`.
    """
    folder = shared_folder(df.sparkSession, fallback_dir)
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint()
