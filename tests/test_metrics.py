"""Hand-made cases for the semantics that are easy to get wrong."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from prefdeck.operators import metrics, pairs

SCORES = "origin string, category string, input_id bigint, output_id int, rank int, reward double"
LABELS = "origin string, input_id bigint, chosen_id int, rejected_id int"
PAIRS = "origin string, category string, chosen_reward double, rejected_reward double"


def scores(spark, rows):
    return spark.createDataFrame([("o", *row) for row in rows], SCORES)


def bag(df):
    return {(r.category, r.metric): r.value for r in df.collect()}


def test_tie_is_wrong_for_accuracy_and_fine_for_exact_match(spark):
    df = scores(spark, [("c", 1, 0, 1, 0.5), ("c", 1, 1, 2, 0.5)])
    row = metrics.rank_metrics(metrics.rank_counts(df)).first()
    assert row["accuracy-rank"] == 0.0 and row["exact_match-rank"] == 1.0


def test_prompt_without_comparable_pair_counts_as_matched(spark):
    df = scores(spark, [("c", 1, 0, 1, 0.1), ("c", 1, 1, 1, 0.2)])
    row = metrics.rank_metrics(metrics.rank_counts(df)).first()
    assert row["accuracy-rank"] is None and row["exact_match-rank"] == 1.0


def test_judge_path_does_not_see_prompts_without_pairs(spark):
    rows = [("o", "c", "q", "out", 1, "r1", 0), ("o", "c", "q", "out2", 1, "r2", 1)]
    df = spark.createDataFrame(
        rows,
        "origin string, category string, question string, output string, rank int, "
        "response_id string, rank_pos int",
    )
    assert pairs.judge_pairs(df, ["origin", "question"]).count() == 0


def test_accuracy_of_negated_rewards_adds_up_to_one_without_ties(spark):
    rng = random.Random(1)
    rows = [("c", i // 5, i % 5, rng.randint(1, 4), rng.random()) for i in range(100)]
    df = scores(spark, rows)
    one = metrics.rank_metrics(metrics.rank_counts(df)).first()["accuracy-rank"]
    other = metrics.rank_metrics(
        metrics.rank_counts(df.withColumn("reward", -F.col("reward")))
    ).first()["accuracy-rank"]
    assert one + other == pytest.approx(1.0)


def test_single_row_category_has_no_deviation_and_spoils_the_macro_mean(spark):
    df = scores(spark, [("a", 1, 0, 1, 1.0), ("b", 2, 0, 1, 1.0), ("b", 2, 1, 2, 3.0), ("b", 2, 2, 3, 5.0)])
    found = bag(metrics.metric_bundle(df))
    assert found["a", "reward_std"] is None
    assert found["b", "reward_std"] == pytest.approx(2.0)
    assert found[None, "reward_std"] is None
    skipped = bag(metrics.metric_bundle(df, skip_undefined=True))
    assert skipped[None, "reward_std"] == pytest.approx(2.0)


def test_macro_replaces_micro(spark):
    df = scores(spark, [("a", 1, 0, 1, 1.0), ("b", 2, 0, 1, 1.0), ("b", 2, 1, 2, 3.0), ("b", 2, 2, 3, 5.0)])
    assert bag(metrics.metric_bundle(df))[None, "reward_mean"] == pytest.approx((1.0 + 3.0) / 2)
    plain = bag(metrics.metric_bundle(df, with_categories=False))
    assert plain[None, "reward_mean"] == pytest.approx(10 / 4)


def test_repeated_votes_collapse_and_contradictions_stay(spark):
    votes = [("o", 1, 0, 1)] * 3 + [("o", 1, 1, 0)]
    assert pairs.distinct_pairs(spark.createDataFrame(votes, LABELS)).count() == 2


def test_build_pairs_ignores_padding_and_missing_ends(spark):
    df = scores(spark, [("c", 1, 0, 1, 0.9), ("c", 1, 1, 2, 0.4)])
    labels = spark.createDataFrame(
        [("o", 1, 0, 1), ("o", 1, -100, -100), ("o", 1, 0, 7), ("o", 2, 0, 1)], LABELS
    )
    rows = pairs.build_pairs(labels, df).collect()
    assert [(r.chosen_id, r.rejected_id, r.chosen_reward, r.category) for r in rows] == [(0, 1, 0.9, "c")]


def test_require_pairs(spark):
    none = spark.createDataFrame([], LABELS)
    assert pairs.require_pairs(none).first().has_pairs is False
    with pytest.raises(Exception, match="no label has both endpoints"):
        pairs.require_pairs(none, strict=True).collect()


def test_last_score_wins(spark):
    rows = [("o", "c", 1, 0, 1, 0.2, 1), ("o", "c", 1, 0, 1, 0.7, 3), ("o", "c", 1, 0, 1, 0.9, 2)]
    df = spark.createDataFrame(rows, SCORES + ", at int")
    assert [r.reward for r in pairs.dedup_scores(df, F.col("at")).collect()] == [0.7]


def pair_frame(spark, differences):
    return spark.createDataFrame([("o", "c", float(d), 0.0) for d in differences], PAIRS)


def test_calibration_bins_leave_out_the_largest_difference(spark):
    curve = metrics.calibration_curve(pair_frame(spark, [1, 2, 3, 4, 5]))
    assert {r.bin: r.n_pairs for r in curve.collect()} == {1: 1, 2: 1, 3: 1, 4: 1}


def test_calibration_counts_a_tie_as_right_and_takes_a_given_maximum(spark):
    curve = metrics.calibration_curve(pair_frame(spark, [0, -1, 3]), max_diff=4.0, n_bins=2).collect()
    assert {r.bin: (r.accuracy, r.n_pairs) for r in curve} == {0: (0.5, 2), 1: (1.0, 1)}


def test_calibration_error_by_hand_both_ways(spark):
    differences = [1, -2, 3, 4, -4.5, 5]
    total = gap = 0.0
    for low in range(5):
        inside = [d for d in differences if low <= abs(d) < low + 1]
        if inside:
            accuracy = sum(d >= 0 for d in inside) / len(inside)
            mean = sum(map(abs, inside)) / len(inside)
            gap += abs(accuracy - 1 / (1 + math.exp(-mean))) * len(inside)
            total += len(inside)
    frame = pair_frame(spark, differences)
    ece = metrics.expected_calibration_error(metrics.calibration_curve(frame)).first().ece
    assert ece == pytest.approx(gap / total) and 0 <= ece <= 1
    summary = metrics.pair_summary(frame).first()
    assert summary["expectation_calibration_error-labels"] == pytest.approx(ece)


def test_calibration_error_without_any_bin_is_zero(spark):
    summary = metrics.pair_summary(pair_frame(spark, [0, 0])).first()
    assert summary["expectation_calibration_error-labels"] == 0.0
    assert summary["accuracy-labels"] == 0.0


def test_bradley_terry_loss(spark):
    assert metrics.bradley_terry_loss(pair_frame(spark, [0])).first().bt_loss == pytest.approx(math.log(2))
    far = metrics.bradley_terry_loss(pair_frame(spark, [-800])).first().bt_loss
    assert far == pytest.approx(800.0)


def test_penalty_is_off_unless_positive(spark):
    df = scores(spark, [("c", 1, 0, 1, 2.0), ("c", 1, 1, 2, 4.0)])
    assert metrics.reward_l2_penalty(df, -1).first().l2_penalty == 0.0
    assert metrics.reward_l2_penalty(df, 0.1).first().l2_penalty == pytest.approx(1.0)


def test_train_eval_leaves_out_rank_metrics_if_a_rank_is_missing(spark):
    labels = spark.createDataFrame([("o", 1, 0, 1)], LABELS)
    full = scores(spark, [("c", 1, 0, 1, 2.0), ("c", 1, 1, 2, 1.0)])
    assert (None, "accuracy-rank") in bag(metrics.train_eval_metrics(full, labels))
    for missing in (None, -1):
        lacking = scores(spark, [("c", 1, 0, 1, 2.0), ("c", 1, 1, missing, 1.0)])
        found = bag(metrics.train_eval_metrics(lacking, labels))
        assert (None, "accuracy-rank") not in found and found[None, "accuracy-labels"] == 1.0


def test_overall_score_is_the_mean_over_origins(spark):
    rows = [
        ("x", None, "accuracy-rank", 0.5), ("x", None, "exact_match-rank", 0.7),
        ("y", None, "accuracy-rank", 1.0), ("y", None, "exact_match-rank", 0.0),
        ("y", "c", "accuracy-rank", 0.0), ("x", None, "reward_mean", 9.0),
    ]
    df = spark.createDataFrame(rows, "origin string, category string, metric string, value double")
    assert metrics.overall_score(df).first().overall == pytest.approx((0.6 + 0.5) / 2)


def test_judge_metrics_count_errors_as_wrong(spark):
    rows = [
        ("o", "c", "q1", "A", "A"), ("o", "c", "q1", "error", "B"),
        ("o", "c", "q2", "B", "B"), ("o", "d", "q3", "A", "B"),
    ]
    df = spark.createDataFrame(
        rows, "origin string, category string, question string, judgment string, preference string"
    )
    found = bag(metrics.judge_metrics(df))
    assert found["c", "accuracy-rank"] == pytest.approx(2 / 3)
    assert found["c", "exact_match-rank"] == pytest.approx(0.5)
    assert found[None, "accuracy-rank"] == pytest.approx(1 / 3)
    assert found[None, "exact_match-rank"] == pytest.approx(0.25)
