"""Shared folders, Arrow batches and worker state for the operators of this package."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CHECKPOINT_DIR = "spark.checkpoint.dir"
# Arrow batches that Python workers receive: many short rows, or few long ones.
BATCH_ROWS, BATCH_BYTES = 2_000, "8m"
# Row groups of a stored table whose rows have a MB or so each. A reader unpacks up to 4,096 rows of a group
# at once, and a writer looks at the sizes of groups and pages only after each 100 rows if not told otherwise.
LONG_ROWS = {
    "parquet.block.row.count.limit": "8", "parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that the driver and all executors share.

    The folder is the one that ``spark.checkpoint.dir`` names. Only a local session may lack it;
    it then gets a temporary folder, which is set in the session.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="prefdeck-")
        spark.conf.set(CHECKPOINT_DIR, folder)
    return f"{folder.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame, **options: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder, and read back: cuts lineage and lets
    several jobs read what was computed once. Survives the loss of executors. ``options``: the writer's, such
    as LONG_ROWS."""
    path = shared_folder(df.sparkSession)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's limits on Arrow batches, so that texts of any length fit a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


Batches = Iterator[pa.RecordBatch]


def released(function: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``function``, and behind it what it freed goes back to the system. Workers live on from task to task, and
    the allocators would keep their largest need as long."""

    def run(batches: Batches) -> Batches:
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)

    return run


def map_arrow(df: DataFrame, function: Callable[[Batches], Batches], schema: str | StructType) -> DataFrame:
    bounded_batches(df.sparkSession)
    return df.mapInArrow(released(function), schema)


def worker_state(key: str, make: Callable[[], Any]) -> Any:
    """One value of ``make()`` per Python worker and key, kept from task to task."""
    module = sys.modules.setdefault("_prefdeck_worker", types.ModuleType("_prefdeck_worker"))
    held = module.__dict__.setdefault("held", {})
    if key not in held:
        held[key] = make()
    return held[key]


def text_column(df: DataFrame, name: str):
    """The text as a string; NULL counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def unused_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as it takes to be no column of ``df``."""
    while name.lower() in [c.lower() for c in df.columns]:
        name = f"_{name}"
    return name


def row_digest(df: DataFrame) -> Column:
    """128 bits of all columns of a row; NULL and empty differ."""
    return F.unhex(F.md5(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})))


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and where each row starts (one entry more at the end)."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset :][: len(column) + 1]
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def text_slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` bytes together, or one longer row alone."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1
        high = min(max(high, low + 1), n)
        yield low, high
        low = high


def batch(schema: pa.Schema, *columns: Any) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types)],
        schema=schema,
    )


def concat_schema(**fields: pa.DataType) -> pa.Schema:
    return pa.schema(list(fields.items()))
