"""Records as read: prompt text, annotation forms, validation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefdeck.functions.text import content_id

FORM_TEXTS = "texts"  # {"answer1", "answer2", "preference"}: two answer texts
FORM_IDS = "ids"  # [id, id, preference]: two response ids


def prompt_text() -> Column:
    """``input``, else ``prompt``."""
    return F.coalesce("input", "prompt")


def first_category() -> Column:
    return F.get("category", F.lit(0))


def is_flat_pair() -> Column:
    """A record with all of input, answer1, answer2 and preference (``prompt`` does not count)."""
    return (
        F.col("input").isNotNull()
        & F.col("answer1").isNotNull()
        & F.col("answer2").isNotNull()
        & F.col("preference").isNotNull()
    )


def _item(form: Column | str, first: Column, second: Column, preference: Column) -> Column:
    return F.struct(
        (F.lit(form) if isinstance(form, str) else form).alias("form"),
        first.alias("first"),
        second.alias("second"),
        preference.alias("preference"),
    )


def _parse_annotation(raw: Column) -> Column:
    as_texts = F.from_json(raw, "answer1 STRING, answer2 STRING, preference STRING")
    as_ids = F.from_json(raw, "ARRAY<STRING>")
    is_list = F.ltrim(raw).startswith("[")
    return F.when(
        is_list,
        _item(FORM_IDS, F.get(as_ids, F.lit(0)), F.get(as_ids, F.lit(1)), F.get(as_ids, F.lit(2))),
    ).otherwise(
        _item(FORM_TEXTS, as_texts["answer1"], as_texts["answer2"], as_texts["preference"])
    )


def normalize_records(records: DataFrame) -> DataFrame:
    """Give every record ``input_text``, its 128-bit ``input_key`` and typed ``items``.

    A flat pair becomes one item and replaces any annotations of the record. The key is the md5
    of the prompt, so later shuffles move 32 characters instead of the prompt. A record without a
    prompt (a broken line reads as one) is left out here, once for all that follows, and reported by
    :func:`records_without_prompt`.
    """
    return _normalized(records.where(prompt_text().isNotNull()))


def records_without_prompt(records: DataFrame) -> DataFrame:
    """Records that :func:`normalize_records` leaves out."""
    return records.where(prompt_text().isNull())


def _normalized(records: DataFrame) -> DataFrame:
    flat = is_flat_pair()
    # An origin that is the same literal in all records drops out of join keys but not of grouping keys, and
    # texts grouped by both would be shuffled again for the join. Tied to a column it stays in both.
    origin = F.coalesce(F.when(F.col("input_key").isNotNull(), F.col("origin")), F.col("origin"))
    items = F.when(
        flat, F.array(_item(FORM_TEXTS, F.col("answer1"), F.col("answer2"), F.col("preference")))
    ).otherwise(F.transform("annotations", _parse_annotation))
    return (
        records.withColumn("input_text", prompt_text())
        .withColumn("input_key", content_id("input_text"))
        .withColumn("origin", origin)
        .withColumn("items", F.coalesce(items, F.array().cast(items_type())))
        .withColumn("is_flat", flat)
    )


def items_type() -> str:
    return "array<struct<form:string,first:string,second:string,preference:string>>"


def annotation_rows(normalized: DataFrame) -> DataFrame:
    """One row per annotation: ``form, first, second, preference`` at ``(ord, sub)``."""
    return normalized.select(
        "origin", "input_key", "ord", F.posexplode("items").alias("sub", "item")
    ).select("origin", "input_key", "ord", "sub", "item.*")


def canonical_annotations(normalized: DataFrame) -> DataFrame:
    """Text-form annotations as (winner id, loser id, '1'); '2' swaps, anything else is left out
    (and reported by :func:`invalid_annotations`)."""
    rows = annotation_rows(normalized).where(
        (F.col("form") == FORM_TEXTS) & F.col("preference").isin("1", "2")
    )
    swapped = F.col("preference") == "2"
    first, second = content_id("first"), content_id("second")
    return rows.select(
        "origin",
        "input_key",
        "ord",
        "sub",
        F.when(swapped, second).otherwise(first).alias("id_1"),
        F.when(swapped, first).otherwise(second).alias("id_2"),
        F.lit("1").alias("preference"),
    )


def tuple_annotations(normalized: DataFrame) -> DataFrame:
    """Id-form annotations as given; only preference '1' ever becomes a label."""
    return (
        annotation_rows(normalized)
        .where(F.col("form") == FORM_IDS)
        .select(
            "origin",
            "input_key",
            "ord",
            "sub",
            F.col("first").alias("id_1"),
            F.col("second").alias("id_2"),
            "preference",
        )
    )


def all_annotations(normalized: DataFrame) -> DataFrame:
    """Both forms in one pass over the records."""
    texts = F.col("form") == FORM_TEXTS
    swapped = texts & (F.col("preference") == "2")
    first = F.when(texts, content_id("first")).otherwise(F.col("first"))
    second = F.when(texts, content_id("second")).otherwise(F.col("second"))
    return (
        annotation_rows(normalized)
        .where(~texts | F.col("preference").isin("1", "2"))
        .select(
            "origin",
            "input_key",
            "ord",
            "sub",
            F.when(swapped, second).otherwise(first).alias("id_1"),
            F.when(swapped, first).otherwise(second).alias("id_2"),
            F.when(texts, F.lit("1")).otherwise(F.col("preference")).alias("preference"),
        )
    )


def _is_bad(item: Callable[[str], Column]) -> Column:
    """Text form: no preference of 1 or 2, or an answer is missing. Id form: fewer than three parts."""
    lacking = item("first").isNull() | item("second").isNull()
    texts = lacking | F.coalesce(~item("preference").isin("1", "2"), F.lit(True))
    return F.when(item("form") == FORM_TEXTS, texts).otherwise(lacking | item("preference").isNull())


def invalid_annotations(normalized: DataFrame) -> DataFrame:
    """Text-form annotations whose preference is not 1 or 2, or that lack an answer, and id-form
    annotations of fewer than three parts."""
    return annotation_rows(normalized).where(_is_bad(F.col))


def _rank_number(text: Column) -> Column:
    return F.trim(text).try_cast("int")


def invalid_ranks(normalized: DataFrame) -> DataFrame:
    """Entries of rank maps that are no integer: ``response_id, rank_text``. They count as no rank."""
    entries = normalized.select("origin", "input_key", "ord", F.explode("rank").alias("response_id", "rank_text"))
    return entries.where(_rank_number(F.col("rank_text")).isNull())


def require_valid(records: DataFrame) -> DataFrame:
    """Strict mode: the same normalized records, but running them fails on the first record without
    prompt, annotation or rank that :func:`records_without_prompt`, :func:`invalid_annotations` or
    :func:`invalid_ranks` would report. Read with ``strict=True`` to fail on bad lines too."""
    normalized = _normalized(records)
    bad_item = F.exists("items", lambda item: _is_bad(lambda name: item[name]))
    bad_rank = F.exists(F.map_values("rank"), lambda text: _rank_number(text).isNull())

    def failing(message: str) -> Column:
        return F.raise_error(F.lit(message))

    checked = (
        F.when(F.col("input_text").isNull(), failing("a record has no prompt"))
        .when(bad_item, failing("annotation preference must be 1 or 2, and a tuple has three parts"))
        .when(bad_rank, failing("a rank is not an integer"))
        .otherwise(F.col("items"))
    )
    return normalized.withColumn("items", checked)
