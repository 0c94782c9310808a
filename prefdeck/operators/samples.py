"""The flat sample table, its integer ids, and labels over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefdeck.operators.fuse import Fused
from prefdeck.operators.skew import dense_index, keyed
from prefdeck.schema import PROMPT_KEY

RESPONSE_KEY = [*PROMPT_KEY, "response_id"]


def _with_split(df: DataFrame, ordinal: str) -> DataFrame:
    """The file split an ordinal lies in (all of it but the row): a bounded chunk that follows the
    order, one per file at least."""
    parts = [part for part in df.select(f"{ordinal}.*").columns if part != "row"]
    return df.withColumn("_split", F.struct(*[f"{ordinal}.{part}" for part in parts]))


def assign_input_ids(inputs: DataFrame) -> DataFrame:
    """Dense ``input_id`` in first-seen order over the whole load, per origin."""
    slim = _with_split(inputs.select(*PROMPT_KEY, "first_ord"), "first_ord")
    numbered = dense_index(
        slim, "input_id", order=["first_ord"], chunk=["_split"], keys=["origin"]
    )
    return inputs.join(numbered.select(*PROMPT_KEY, "input_id"), PROMPT_KEY)


def number_outputs(responses: DataFrame) -> DataFrame:
    """Keys of the responses with their dense place in the prompt, in first-seen order.

    Numbers the slim (key, place) columns; texts never pass the window.
    """
    slim = _with_split(responses.select(*RESPONSE_KEY, "first_ord"), "first_ord.ord")
    return dense_index(
        slim, "output_id", order=["first_ord"], chunk=["_split"], keys=PROMPT_KEY
    ).select(*RESPONSE_KEY, F.col("output_id").cast("int").alias("output_id"))


def assign_output_ids(responses: DataFrame) -> DataFrame:
    """Responses with their ``output_id``, joined back on the key they are already grouped by."""
    return responses.join(number_outputs(responses), RESPONSE_KEY)


def category_dictionary(inputs: DataFrame) -> DataFrame:
    """category -> dense id in first-seen order, shared by all origins."""
    first = (
        inputs.where(F.col("category").isNotNull())
        .groupBy("category")
        .agg(F.min(F.struct("first_ord", "origin")).alias("seen"))
    )
    numbered = dense_index(
        _with_split(first, "seen.first_ord"), "category_id", order=["seen"], chunk=["_split"]
    )
    return numbered.select("category", F.col("category_id").cast("int").alias("category_id"))


def attach_ranks(responses: DataFrame, ranks: DataFrame, compat: bool = False) -> DataFrame:
    """Rank per response. A response missing from the rank map has NULL; with ``compat`` it gets 0,
    which ranks it best."""
    joined = responses.join(ranks.select(*RESPONSE_KEY, "rank", "rank_pos"), RESPONSE_KEY, "left")
    if compat:
        return joined.withColumn("rank", F.coalesce("rank", F.lit(0)))
    return joined


def index_labels(annotations: DataFrame, numbered: DataFrame) -> DataFrame:
    """Annotations with preference '1' as (chosen_id, rejected_id) output positions.

    Two lookups on the (prompt, response) key. Both sides of each come straight out of a shuffle on
    that key, so AQE splits a response that a large share of all annotations names. An id the
    prompt does not know drops out and is reported by :func:`unknown_label_ids`. An ``input_id`` in
    ``numbered`` is carried over.
    """
    extra = [c for c in ["input_id"] if c in numbered.columns]
    ids = keyed(numbered, RESPONSE_KEY).select(*RESPONSE_KEY, "output_id", *extra)
    chosen = ids.withColumnsRenamed({"response_id": "id_1", "output_id": "chosen_id"})
    rejected = ids.drop(*extra).withColumnsRenamed(
        {"response_id": "id_2", "output_id": "rejected_id"}
    )
    return (
        annotations.where(F.col("preference") == "1")
        .select(*PROMPT_KEY, "id_1", "id_2")
        .join(chosen, [*PROMPT_KEY, "id_1"])
        .join(rejected, [*PROMPT_KEY, "id_2"])
        .select(*PROMPT_KEY, *extra, "chosen_id", "rejected_id")
    )


def unknown_label_ids(annotations: DataFrame, responses: DataFrame) -> DataFrame:
    """Annotation endpoints with preference '1' that name no response of their prompt."""
    ends = annotations.where(F.col("preference") == "1").select(
        *PROMPT_KEY, F.explode(F.array("id_1", "id_2")).alias("response_id")
    )
    return ends.join(responses.select(*RESPONSE_KEY), RESPONSE_KEY, "left_anti")


def sample_ids(fused: Fused, compat_ranks: bool = False) -> DataFrame:
    """Keys, integer ids, ranks and prompt fields of every sample; no answer text.

    The prompt fields are looked up per prompt. The category lookup comes last on the prompt side,
    so both sides are shuffled for the join and AQE can split a prompt with very many responses.
    """
    prompts = (
        assign_input_ids(fused.inputs)
        .join(category_dictionary(fused.inputs), "category", "left")
        .select(*PROMPT_KEY, "input_id", "input", "category", "category_id", "sys_prompt")
    )
    return attach_ranks(number_outputs(fused.responses), fused.ranks, compat_ranks).join(
        prompts, PROMPT_KEY
    )


def explode_responses(fused: Fused, compat_ranks: bool = False) -> DataFrame:
    """One row per (prompt, response) with integer ids, texts, category, rank and system prompt.

    The answer texts join last, on their unique key.
    """
    texts = fused.responses.select(*RESPONSE_KEY, "output")
    return sample_ids(fused, compat_ranks).join(texts, RESPONSE_KEY).select(
        *PROMPT_KEY,
        "input_id",
        "output_id",
        "response_id",
        "input",
        "output",
        "category",
        "category_id",
        "rank",
        "rank_pos",
        "sys_prompt",
    )


def sequential_order(samples: DataFrame) -> DataFrame:
    """Stored order, as evaluation reads it."""
    return samples.orderBy("origin", "input_id", "output_id")


def sequential_positions(samples: DataFrame) -> DataFrame:
    """Samples with their ``position`` (from 0) in the stored order. Chunks are 4,096 prompts of an origin;
    ``input_id`` is a number and the key unique."""
    cut = samples.withColumn("_chunk", F.shiftright("input_id", 12))
    order = ["input_id", "output_id"]
    return dense_index(cut, "position", order=["origin", *order], chunk=["origin", "_chunk"]).drop("_chunk")
