"""Fusing records by prompt text into long tables.

A fused prompt is never collected into one nested row: responses, annotations, ranks and prompt
fields stay long tables keyed by ``(origin, input_key)``, so a prompt that holds a third of all
records spreads over as many tasks as any other data of that size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefdeck.functions.text import content_id
from prefdeck.operators.records import FORM_TEXTS, all_annotations, first_category
from prefdeck.schema import PROMPT_KEY


def response_rows(normalized: DataFrame) -> DataFrame:
    """Every response mention at ``(ord, sub)``: the listed ones first, then the answers of
    text-form annotations in order, each under the md5 of its text."""
    listed = F.coalesce(
        F.transform(
            "responses",
            lambda r: F.struct(r["id"].alias("response_id"), r["content"].alias("output")),
        ),
        F.array().cast("array<struct<response_id:string,output:string>>"),
    )
    inline = F.flatten(
        F.transform(
            F.filter("items", lambda item: item["form"] == FORM_TEXTS),
            lambda item: F.filter(F.array(item["first"], item["second"]), lambda t: t.isNotNull()),
        )
    )
    named = F.transform(
        inline, lambda t: F.struct(content_id(t).alias("response_id"), t.alias("output"))
    )
    return normalized.select(
        *PROMPT_KEY, "ord", F.posexplode(F.concat(listed, named)).alias("sub", "response")
    ).select(*PROMPT_KEY, "ord", "sub", "response.*")


def dedup_responses(rows: DataFrame) -> DataFrame:
    """One row per (prompt, response id): the first position and the last content.

    Both come from partial aggregates, so a response copied millions of times is folded on the map
    side before anything is shuffled.
    """
    place = F.struct("ord", "sub")
    return rows.groupBy(*PROMPT_KEY, "response_id").agg(
        F.min(place).alias("first_ord"),
        F.max_by("output", place).alias("output"),
        F.count("*").alias("n_mentions"),
    )


def _last(column: Column) -> Column:
    """The value of the last record that has one."""
    return F.max_by(column, F.when(column.isNotNull(), F.col("ord")))


def fuse_inputs(normalized: DataFrame) -> DataFrame:
    """One row per prompt: first place, text, and the last value of the scalar fields."""
    return normalized.groupBy(*PROMPT_KEY).agg(
        F.min("ord").alias("first_ord"),
        F.first("input_text").alias("input"),
        _last(first_category()).alias("category"),
        _last(F.col("sys_prompt")).alias("sys_prompt"),
        F.count("*").alias("n_records"),
        F.count("rank").alias("n_rank_maps"),
    )


def passthrough_scalars(normalized: DataFrame, columns: list[str]) -> DataFrame:
    """Any further record fields: the last record of the prompt that has the field wins."""
    return normalized.groupBy(*PROMPT_KEY).agg(*[_last(F.col(c)).alias(c) for c in columns])


def rank_rows(normalized: DataFrame) -> DataFrame:
    """One row per (prompt, response id) of the rank maps, with its place in the map.

    A prompt should carry one map (see :func:`rank_once`); with several the first record wins per
    response. Places then repeat, and :func:`~prefdeck.operators.pairs.judge_pairs` orders equal
    ones by response id.
    """
    rows = normalized.select(
        *PROMPT_KEY, "ord", F.posexplode("rank").alias("rank_pos", "response_id", "rank_text")
    )
    return (
        rows.groupBy(*PROMPT_KEY, "response_id")
        .agg(F.min_by(F.struct("rank_text", "rank_pos"), "ord").alias("first"))
        .select(
            *PROMPT_KEY,
            "response_id",
            F.trim("first.rank_text").try_cast("int").alias("rank"),
            F.col("first.rank_pos").alias("rank_pos"),
        )
    )


def unknown_rank_ids(ranks: DataFrame, responses: DataFrame) -> DataFrame:
    """Ranked ids that name no response of their prompt; they take no part in any comparison."""
    key = [*PROMPT_KEY, "response_id"]
    return ranks.join(responses.select(*key), key, "left_anti")


def rank_once(normalized: DataFrame) -> DataFrame:
    """Prompts that carry more than one rank map (an error in strict use)."""
    return (
        normalized.groupBy(*PROMPT_KEY)
        .agg(F.count("rank").alias("n_rank_maps"))
        .where(F.col("n_rank_maps") > 1)
    )


def prune_common_keys(fused: DataFrame, columns: list[str]) -> DataFrame:
    """Which of ``columns`` every fused prompt has: one aggregate, one row per column."""
    present = F.array(
        *[
            F.struct(
                F.lit(c).alias("field"),
                (F.count(c) == F.count("*")).alias("is_common"),
                F.count(c).alias("n_present"),
            )
            for c in columns
        ]
    )
    return fused.agg(present.alias("fields")).select(F.inline("fields"))


def keep_common_keys(fused: DataFrame, columns: list[str]) -> DataFrame:
    """Drop the fields some prompt lacks. Runs the one-row aggregate, as the schema depends on it."""
    flags = fused.agg(*[(F.count(c) == F.count("*")).alias(c) for c in columns]).first()
    return fused.drop(*[c for c in columns if not flags[c]])


def null_uncommon_keys(inputs: DataFrame, columns: list[str]) -> DataFrame:
    """``inputs`` with each of ``columns`` NULL throughout an origin where some prompt lacks it.

    The names of such origins come as one row of lists, folded on the map side; origins are data sets. The
    schema stays, so nothing runs while the plan is built.
    """
    lacking = inputs.agg(
        F.struct(*[F.collect_set(F.when(F.col(c).isNull(), F.col("origin"))).alias(c) for c in columns])
    ).scalar()
    return inputs.withColumns(
        {c: F.when(~F.array_contains(lacking.getField(c), F.col("origin")), F.col(c)) for c in columns}
    )


@dataclass(frozen=True)
class Fused:
    """The long tables of a fused load."""

    inputs: DataFrame
    responses: DataFrame
    annotations: DataFrame
    ranks: DataFrame


def fuse_by_prompt(normalized: DataFrame) -> Fused:
    return Fused(
        inputs=fuse_inputs(normalized),
        responses=dedup_responses(response_rows(normalized)),
        annotations=all_annotations(normalized),
        ranks=rank_rows(normalized),
    )


def fused_summary(fused: Fused) -> DataFrame:
    """Per prompt: records, distinct responses, concatenated annotations."""
    responses = fused.responses.groupBy(*PROMPT_KEY).agg(F.count("*").alias("n_responses"))
    annotations = fused.annotations.groupBy(*PROMPT_KEY).agg(F.count("*").alias("n_annotations"))
    return (
        fused.inputs.join(responses, PROMPT_KEY, "left")
        .join(annotations, PROMPT_KEY, "left")
        .withColumns(
            {
                "n_responses": F.coalesce("n_responses", F.lit(0).cast("bigint")),
                "n_annotations": F.coalesce("n_annotations", F.lit(0).cast("bigint")),
            }
        )
    )
