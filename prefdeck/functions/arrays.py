"""Token and label arrays as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefdeck.schema import IGNORE_ID

LABEL_TYPE = "array<struct<chosen_id:int,rejected_id:int>>"


def left_pad(array: Column | str, length: Column, pad: Column) -> Column:
    array = F.col(array) if isinstance(array, str) else array
    missing = F.greatest(length - F.size(array), F.lit(0))
    return F.concat(F.array_repeat(pad, missing), array)


def pad_batch(
    rows: DataFrame,
    batch: list[str],
    token_columns: list[str],
    other_columns: list[str] = (),
    label_column: str | None = None,
) -> DataFrame:
    """Left-pad ragged arrays to the longest of their batch: 0 for tokens and masks, the ignore id
    for anything else; an empty label list first becomes one ignored pair.

    The window holds one batch, so at most batch-size rows.
    """
    whole = Window.partitionBy(*batch)
    ignored = F.struct(
        F.lit(IGNORE_ID).cast("int").alias("chosen_id"),
        F.lit(IGNORE_ID).cast("int").alias("rejected_id"),
    )
    if label_column is not None:
        filled = F.when(F.size(label_column) == 0, F.array(ignored)).otherwise(F.col(label_column))
        rows = rows.withColumn(label_column, filled)
    pads = {c: F.lit(0).cast("int") for c in token_columns}
    pads.update({c: F.lit(IGNORE_ID).cast("int") for c in other_columns})
    if label_column is not None:
        pads[label_column] = ignored
    widths = {f"_width_{c}": F.max(F.size(c)).over(whole) for c in pads}
    padded = {c: left_pad(c, F.col(f"_width_{c}"), pad) for c, pad in pads.items()}
    return rows.withColumns(widths).withColumns(padded).drop(*widths)


def sanitize_token_ids(ids: Column | str, vocab_size: int, pad_id: int) -> Column:
    """Ids below 0 or not below ``vocab_size`` become ``pad_id``."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    return F.transform(
        ids, lambda x: F.when((x < 0) | (x >= vocab_size), F.lit(pad_id)).otherwise(x)
    )


def count_bad_token_ids(ids: Column | str, vocab_size: int) -> Column:
    ids = F.col(ids) if isinstance(ids, str) else ids
    return F.size(F.filter(ids, lambda x: (x < 0) | (x >= vocab_size)))


def last_attended_index(mask: Column | str) -> Column:
    """Index (from 0) of the last non-zero mask element; NULL if there is none."""
    mask = F.col(mask) if isinstance(mask, str) else mask
    from_end = F.array_position(F.reverse(F.transform(mask, lambda x: x != 0)), True)
    return F.when(from_end > 0, F.size(mask) - from_end)


def expand_label_rows(rows: DataFrame, label_column: str = "labels") -> DataFrame:
    """Row x pair, ignored pads left out, as a set of (origin, input, chosen, rejected)."""
    return (
        rows.select("origin", "input_id", F.explode(label_column).alias("pair"))
        .select("origin", "input_id", "pair.chosen_id", "pair.rejected_id")
        .where((F.col("chosen_id") >= 0) & (F.col("rejected_id") >= 0))
        .distinct()
    )
