"""From records to metrics: scorer evaluation and judge evaluation."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefdeck.functions.prompts import render_judge_prompts
from prefdeck.functions.verdict import parse_verdict
from prefdeck.operators.fuse import Fused, fuse_by_prompt, null_uncommon_keys
from prefdeck.operators.metrics import judge_metrics, metric_bundle
from prefdeck.operators.pairs import judge_pairs, swap_positions
from prefdeck.operators.records import normalize_records
from prefdeck.operators.samples import explode_responses, index_labels, sample_ids
from prefdeck.operators.scoring import judge_responses, repartition_for_calls, score_responses
from prefdeck.operators.skew import HOT_FLOOR_ROWS
from prefdeck.plans.registry import JUDGE, SCORE, Predictor, Registry, default_registry
from prefdeck.session import materialize


def prepare(
    records: DataFrame, compat_ranks: bool = False, common_only: bool = False
) -> tuple[Fused, DataFrame]:
    """Fused tables and flat samples of a set of records.

    With ``common_only`` the category or system prompt counts in an origin only if all its prompts have one.
    """
    fused = fuse_by_prompt(normalize_records(records))
    if common_only:
        fused = replace(fused, inputs=null_uncommon_keys(fused.inputs, ["category", "sys_prompt"]))
    return fused, explode_responses(fused, compat_ranks)


def sample_labels(fused: Fused) -> DataFrame:
    """Labels over integer ids: ``origin, input_id, chosen_id, rejected_id``."""
    return index_labels(fused.annotations, sample_ids(fused)).select(
        "origin", "input_id", "chosen_id", "rejected_id"
    )


def evaluate_scorer(
    samples: DataFrame, predictor: Predictor, floor_rows: int = HOT_FLOOR_ROWS
) -> DataFrame:
    """Score each sample, then rank metrics per category and macro.

    Python scorers are run once: their output is written to the checkpoint folder before the
    metrics read it in more than one branch.
    """
    kept = ["origin", "category", "input_id", "output_id", "rank"]
    scored = score_responses(
        samples, predictor.implementation, predictor.batch_size, kept, None, predictor.profile, predictor.calls
    )
    if callable(predictor.implementation):
        scored = materialize(scored)
    return metric_bundle(scored, with_categories=True, floor_rows=floor_rows)


# What the metrics of a judge need of a judged pair.
JUDGED = ["origin", "category", "question_key", "id_a", "id_b", "preference"]


def judged_pairs(samples: DataFrame, predictor: Predictor) -> DataFrame:
    """Pairs with positions swapped by coin, judged, and the verdict read: JUDGED, ``judge_text,
    judgment``.

    A Python judge is sent keys, the question, both answers and the prompt; only keys and its answer
    come back, once however many branches of the metrics read them.
    """
    rows = samples.withColumn("question", F.col("input"))
    pairs = swap_positions(
        judge_pairs(rows, ["origin", "input_id"]),
        F.concat_ws(":", "origin", "question", "id_a", "id_b"),
    )
    prompt = render_judge_prompts(
        "question", "answer_a", "answer_b", predictor.style, predictor.template
    )
    asked = pairs.withColumns({"judge_prompt": prompt, "question_key": F.md5("question")})
    judge = predictor.implementation
    if callable(judge):
        asked = repartition_for_calls(asked)
    answered = judge_responses(
        asked, judge, predictor.batch_size or 64, JUDGED, None, predictor.profile, predictor.calls
    )
    if callable(judge):
        answered = materialize(answered)
    return answered.withColumn("judgment", parse_verdict("judge_text", predictor.style))


def evaluate(
    samples: DataFrame,
    name: str,
    registry: Registry | None = None,
    floor_rows: int = HOT_FLOOR_ROWS,
) -> DataFrame:
    """Metrics ``(origin, category, metric, value)`` of the predictor called ``name``."""
    predictor = (registry or default_registry()).get(name)
    if predictor.kind == SCORE:
        return evaluate_scorer(samples, predictor, floor_rows)
    if predictor.kind == JUDGE:
        return judge_metrics(judged_pairs(samples, predictor))
    raise NotImplementedError(f"predictor kind {predictor.kind!r}")
