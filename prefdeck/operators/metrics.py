"""Ranking, pair and calibration metrics as aggregates.

Results are long tables ``(origin, category, metric, value)``; a NULL category is the whole origin.
An origin with a row that lacks a category is measured as a whole, without categories.
Undefined values (deviation of one row, mean of nothing) are NULL.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefdeck.operators.pairs import build_pairs
from prefdeck.operators.skew import (
    HOT_FLOOR_ROWS,
    RANGE_ROWS,
    hot_groups,
    in_ranges,
    with_groups,
    without_groups,
)

PROMPT = ["input_id", "origin", "category"]
GROUP = ["origin", "category"]


# ---------------------------------------------------------------------------------------------
# Counting concordant and discordant pairs without forming pairs
#
# Two responses with different ranks differ first at exactly one bit of the rank number. So each
# comparable pair of a prompt lies in exactly one segment (bit, higher bits of the rank), one row
# on the 0 side (better) and one on the 1 side (worse). Inside a segment, running sums in reward
# order give for each row how many rows of the other side lie strictly below it. That is
# n log(ranks) work per prompt where forming pairs is n squared.
# ---------------------------------------------------------------------------------------------


def _by_bit(rows: DataFrame, top: Column) -> DataFrame:
    """Each row once per bit of ``top``, the largest rank number of its prompt."""
    bits = F.sequence(F.lit(0), F.length(F.bin(F.coalesce(top, F.lit(0)))) - 1)
    return rows.withColumn("bit", F.explode(bits)).withColumns(
        {
            "segment": F.expr("shiftright(rank_no, bit + 1)"),
            "worse": F.expr("shiftright(rank_no, bit) & 1L"),
        }
    )


def _sides() -> list[Column]:
    return [
        F.coalesce(F.sum(F.lit(1) - F.col("worse")), F.lit(0)).cast("double").alias("n_better"),
        F.coalesce(F.sum("worse"), F.lit(0)).cast("double").alias("n_worse"),
        F.count_if(F.col("bit") == 0).alias("n_responses"),
    ]


def _below(column: str, segment: Sequence[str], order: str) -> Column:
    earlier = (
        Window.partitionBy(*segment).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return F.coalesce(F.sum(column).over(earlier), F.lit(0.0))


_COUNTS = ["n_responses", "n_pairs", "n_concordant", "n_discordant"]


def _count_in_order(points: DataFrame, segment: Sequence[str], order: str, tied: Column) -> DataFrame:
    """Per point: pairs with the points before it in its segment, split by which side is above."""
    with_below = points.withColumns(
        {
            "_better_below": _below("n_better", segment, order),
            "_worse_below": _below("n_worse", segment, order),
        }
    )
    concordant = F.col("n_better") * F.col("_worse_below")
    discordant = F.col("n_worse") * F.col("_better_below")
    # A NaN reward compares false with everything: its pairs count, but on neither side.
    comparable = ~F.isnan(order) if order == "reward" else F.lit(True)
    return with_below.withColumns(
        {
            "n_pairs": concordant + discordant + tied,
            "n_concordant": F.when(comparable, concordant).otherwise(0.0),
            "n_discordant": F.when(comparable, discordant).otherwise(0.0),
        }
    )


def rank_counts(
    scores: DataFrame, floor_rows: int = HOT_FLOOR_ROWS, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Per prompt: responses, comparable pairs, concordant and discordant pairs.

    Comparable means different ranks (lower is better); concordant means the better-ranked response
    has the strictly greater reward, discordant the strictly smaller. Rows without rank or reward
    form no pair. Counts are DOUBLE: exact up to 2**53.

    A prompt that is not hot is counted inside one shuffle on the prompt. A hot prompt is first cut
    into reward ranges of about ``range_rows`` rows at its own quantiles; each range is counted on its
    own and one row per range then gives the pairs across ranges, so no task sees the whole prompt and
    nothing is left out.
    """
    rows = scores.select(
        *PROMPT,
        F.when(F.col("reward").isNotNull(), F.col("rank")).cast("bigint").alias("rank"),
        F.col("reward").cast("double").alias("reward"),
    )
    pairable = F.col("rank").isNotNull() & F.col("reward").isNotNull()
    hot = hot_groups(rows, PROMPT, counted=pairable, floor_rows=floor_rows)
    return _cold_counts(without_groups(rows, hot, PROMPT)).unionByName(
        _hot_counts(with_groups(rows, hot, PROMPT), range_rows)
    )


def _cold_counts(rows: DataFrame) -> DataFrame:
    prompt = Window.partitionBy(*PROMPT)
    in_rank_order = prompt.orderBy(F.col("rank").asc_nulls_last())
    numbered = rows.withColumn(
        "rank_no",
        F.when(F.col("rank").isNotNull(), F.dense_rank().over(in_rank_order) - 1).cast("bigint"),
    ).withColumn("_top", F.max("rank_no").over(prompt))
    segment = [*PROMPT, "bit", "segment"]
    points = _by_bit(numbered, F.col("_top")).groupBy(*segment, "reward").agg(*_sides())
    tied = F.col("n_better") * F.col("n_worse")
    counted = _count_in_order(points, segment, "reward", tied)
    return counted.groupBy(*PROMPT).agg(*[F.sum(c).alias(c) for c in _COUNTS])


def _hot_counts(rows: DataFrame, range_rows: int) -> DataFrame:
    facts = [F.min("rank").alias("low"), F.max("rank").alias("high")]
    ranked = F.col("rank").isNotNull()
    numbered = in_ranges(rows, PROMPT, "reward", "range", ranked, facts, range_rows).withColumns(
        {"rank_no": F.col("rank") - F.col("low"), "_top": F.col("high") - F.col("low")}
    )
    segment = [*PROMPT, "bit", "segment"]
    points = _by_bit(numbered, F.col("_top")).groupBy(*segment, "range", "reward").agg(*_sides())
    tied = F.col("n_better") * F.col("n_worse")
    within = (
        _count_in_order(points, [*segment, "range"], "reward", tied)
        .groupBy(*segment, "range")
        .agg(*[F.sum(c).alias(c) for c in [*_COUNTS, "n_better", "n_worse"]])
        .withColumnsRenamed({c: f"{c}_within" for c in _COUNTS[1:]})
    )
    # One row per range: rows of different ranges are never tied.
    across = _count_in_order(within, segment, "range", F.lit(0.0))
    return across.groupBy(*PROMPT).agg(
        F.sum("n_responses").alias("n_responses"),
        *[F.sum(F.col(c) + F.col(f"{c}_within")).alias(c) for c in _COUNTS[1:]],
    )


# ---------------------------------------------------------------------------------------------
# Metric rows
# ---------------------------------------------------------------------------------------------


def _long(wide: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., metric, value) from one column per metric."""
    names = [c for c in wide.columns if c not in by]
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").alias("value")) for n in names])
    return wide.select(*by, F.inline(pairs))


def reward_stats(scores: DataFrame, by: Sequence[str] = ("origin",)) -> DataFrame:
    """Mean and sample deviation of the rewards."""
    return scores.groupBy(*by).agg(
        F.avg("reward").alias("reward_mean"), F.stddev_samp("reward").alias("reward_std")
    )


def rank_metrics(counts: DataFrame, by: Sequence[str] = ("origin",)) -> DataFrame:
    """Accuracy over all comparable pairs (a reward tie is wrong) and the share of prompts without
    an inverted pair (a tie is fine; a prompt without comparable pairs counts as matched)."""
    n_pairs = F.sum("n_pairs")
    return counts.groupBy(*by).agg(
        F.when(n_pairs > 0, F.sum("n_concordant") / n_pairs).alias("accuracy-rank"),
        F.avg(F.when(F.col("n_discordant") == 0, 1.0).otherwise(0.0)).alias("exact_match-rank"),
    )


def _pair_aggregates() -> list[Column]:
    c, r = F.col("chosen_reward"), F.col("rejected_reward")
    return [
        F.avg(F.when(c > r, 1.0).otherwise(0.0)).alias("accuracy-labels"),
        F.avg(c).alias("chosen_reward_mean-labels"),
        F.stddev_samp(c).alias("chosen_reward_std-labels"),
        F.avg(r).alias("rejected_reward_mean-labels"),
        F.stddev_samp(r).alias("rejected_reward_std-labels"),
        F.avg(c - r).alias("reward_diverge_mean-labels"),
        F.stddev_samp(c - r).alias("reward_diverge_std-labels"),
    ]


def pair_metrics(pairs: DataFrame, by: Sequence[str] = ("origin",)) -> DataFrame:
    """Strict accuracy, and mean and sample deviation of both sides and of their difference."""
    return pairs.groupBy(*by).agg(*_pair_aggregates())


def _binned(
    pairs: DataFrame, by: list[str], n_bins: int, max_diff: float | None
) -> DataFrame:
    """Pairs with ``diff``, ``right`` and ``bin`` (NULL outside all bins).

    Bin i is [i*step, (i+1)*step) with step = max/n_bins, so the largest difference lies outside
    the last bin; a tie counts as right.
    """
    diffs = pairs.select(
        *by,
        "chosen_reward",
        "rejected_reward",
        F.abs(F.col("chosen_reward") - F.col("rejected_reward")).alias("diff"),
        F.when(F.col("chosen_reward") >= F.col("rejected_reward"), 1.0).otherwise(0.0).alias("right"),
    )
    if max_diff is None:
        # One row per group against all pairs: left unhinted, so AQE broadcasts it if its measured
        # size allows and otherwise splits the hot groups of a sort-merge join.
        maxima = diffs.groupBy(*by).agg(F.max("diff").alias("max_diff"))
        names = {k: f"_max_{k}" for k in by}
        match = reduce(
            lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
        )
        diffs = diffs.join(maxima.withColumnsRenamed(names), match).drop(*names.values())
    else:
        diffs = diffs.withColumn("max_diff", F.lit(float(max_diff)))
    step = F.col("max_diff") / F.lit(n_bins)
    bin_no = F.coalesce(
        *[
            F.when((F.col("diff") >= step * i) & (F.col("diff") < step * (i + 1)), i)
            for i in range(n_bins)
        ]
    )
    return diffs.withColumn("bin", bin_no)


def calibration_curve(
    pairs: DataFrame,
    by: Sequence[str] = ("origin",),
    n_bins: int = 5,
    max_diff: float | None = None,
    outside: bool = False,
) -> DataFrame:
    """Per equal-width bin of ``|chosen - rejected|``: accuracy, mean difference and count.

    Empty bins are left out; pairs are folded to one row per (group, bin) on the map side. With
    ``outside`` a row with a NULL bin holds the pairs outside all bins, so every group has a row.
    """
    by = list(by)
    binned = _binned(pairs, by, n_bins, max_diff)
    return (
        (binned if outside else binned.where(F.col("bin").isNotNull()))
        .groupBy(*by, "bin")
        .agg(
            F.avg("right").alias("accuracy"),
            F.avg("diff").alias("mean_diff"),
            F.count("*").alias("n_pairs"),
        )
    )


def _sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def expected_calibration_error(curve: DataFrame, by: Sequence[str] = ("origin",)) -> DataFrame:
    """Count-weighted mean of |accuracy - sigmoid(mean difference)| over the bins.

    A group whose differences are all 0 has no bins and so no row in a plain curve; in one made with
    ``outside=True`` it has, and its error is 0. Pairs outside all bins have no weight.
    """
    gap = F.abs(F.col("accuracy") - _sigmoid(F.col("mean_diff")))
    inside = F.when(F.col("bin").isNotNull(), F.col("n_pairs"))
    return curve.groupBy(*by).agg(F.coalesce(F.sum(gap * inside) / F.sum(inside), F.lit(0.0)).alias("ece"))


def _for_groups(groups: DataFrame, facts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Every group once, with its row of ``facts`` or NULLs. Both sides have a row per group."""
    own = {k: f"_own_{k}" for k in by}
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in own.items()])
    return groups.join(facts.withColumnsRenamed(own), match, "left").drop(*own.values())


def pair_summary(
    pairs: DataFrame,
    by: Sequence[str] = ("origin",),
    n_bins: int = 5,
    max_diff: float | None = None,
) -> DataFrame:
    """:func:`pair_metrics` and the calibration error in one aggregate over the pairs."""
    by = list(by)
    sums: list[Column] = []
    gap, total = F.lit(0.0), F.lit(0)
    for i in range(n_bins):
        inside = F.col("bin") == i
        sums += [
            F.count_if(inside).alias(f"_n{i}"),
            F.avg(F.when(inside, F.col("right"))).alias(f"_acc{i}"),
            F.avg(F.when(inside, F.col("diff"))).alias(f"_diff{i}"),
        ]
        gap = gap + F.coalesce(
            F.abs(F.col(f"_acc{i}") - _sigmoid(F.col(f"_diff{i}"))) * F.col(f"_n{i}"), F.lit(0.0)
        )
        total = total + F.col(f"_n{i}")
    wide = _binned(pairs, by, n_bins, max_diff).groupBy(*by).agg(*_pair_aggregates(), *sums)
    # Without any bin (all differences 0) the error is 0.
    error = F.when(total > 0, gap / total).otherwise(0.0)
    return wide.withColumn("expectation_calibration_error-labels", error).drop(
        *[f"_{name}{i}" for i in range(n_bins) for name in ("n", "acc", "diff")]
    )


def neg_log_sigmoid(difference: Column) -> Column:
    """-log(sigmoid(d)) without overflow at either end."""
    return F.greatest(-difference, F.lit(0.0)) + F.log1p(F.exp(-F.abs(difference)))


def bradley_terry_loss(pairs: DataFrame, by: Sequence[str] = ("origin",)) -> DataFrame:
    difference = F.col("chosen_reward") - F.col("rejected_reward")
    return pairs.groupBy(*by).agg(F.avg(neg_log_sigmoid(difference)).alias("bt_loss"))


def reward_l2_penalty(
    scores: DataFrame, reg_coef: float, by: Sequence[str] = ("origin",)
) -> DataFrame:
    """reg_coef * mean(reward^2); a coefficient that is not positive switches it off."""
    penalty = F.avg(F.col("reward") * F.col("reward")) * F.lit(float(reg_coef))
    return scores.groupBy(*by).agg(
        (penalty if reg_coef > 0 else F.lit(0.0)).alias("l2_penalty")
    )


def metric_rows(
    scores: DataFrame,
    labels: DataFrame | None = None,
    with_ranks: bool = True,
    by: Sequence[str] = ("origin",),
    n_bins: int = 5,
    floor_rows: int = HOT_FLOOR_ROWS,
    ranked_origins: DataFrame | None = None,
) -> DataFrame:
    """All metrics that apply, long, one set per group of ``by``. A group without usable pairs has
    NULL for the metrics of pairs; with ``ranked_origins`` only these origins have metrics of ranks."""
    by = list(by)
    stats = reward_stats(scores, by)
    parts = [_long(stats, by)]
    if with_ranks:
        ranked = rank_metrics(rank_counts(scores, floor_rows), by)
        if ranked_origins is not None:
            ranked = ranked.join(ranked_origins, "origin", "left_semi")
        parts.append(_long(ranked, by))
    if labels is not None:
        summary = pair_summary(build_pairs(labels, scores), by, n_bins)
        parts.append(_long(_for_groups(stats.select(*by), summary, by), by))
    return reduce(DataFrame.unionByName, parts)


def metrics_by_category(scores: DataFrame, **options) -> DataFrame:
    """(origin, category, metric, value): every metric inside each category."""
    return metric_rows(scores, by=GROUP, **options)


def macro_metrics(category_rows: DataFrame, skip_undefined: bool = False) -> DataFrame:
    """Unweighted mean over the categories of an origin, as rows with NULL category.

    One undefined category makes the mean undefined unless ``skip_undefined``.
    """
    mean = F.avg("value")
    if not skip_undefined:
        mean = F.when(F.count("value") == F.count("*"), mean)
    return category_rows.groupBy("origin", "metric").agg(mean.alias("value")).select(
        "origin", F.lit(None).cast("string").alias("category"), "metric", "value"
    )


def category_mode(rows: DataFrame) -> DataFrame:
    """``rows`` with the category NULL throughout an origin that lacks it in some row.

    The names of these origins come as one value from a scan for rows without category; there are as
    many as data sets at most.
    """
    lacking = (
        rows.where(F.col("category").isNull()).agg(F.collect_set("origin").alias("origins")).scalar()
    )
    return rows.withColumn("category", F.when(~F.array_contains(lacking, F.col("origin")), F.col("category")))


def with_macro(category_rows: DataFrame, skip_undefined: bool = False) -> DataFrame:
    """The category rows and their macro rows in one pass (two grouping sets over a small table).

    A NULL category must be the only one of its origin (see :func:`category_mode`): its row is the
    macro row.
    """
    mean = F.avg("value")
    if not skip_undefined:
        mean = F.when(F.count("value") == F.count("*"), mean)
    return category_rows.groupingSets(
        [["origin", "metric", "category"], ["origin", "metric"]], "origin", "metric", "category"
    ).agg(mean.alias("value"), F.grouping("category").alias("_whole")).where(
        (F.col("_whole") == 1) | F.col("category").isNotNull()
    ).select("origin", "category", "metric", "value")


def metric_bundle(
    scores: DataFrame,
    labels: DataFrame | None = None,
    with_ranks: bool = True,
    with_categories: bool = True,
    skip_undefined: bool = False,
    n_bins: int = 5,
    floor_rows: int = HOT_FLOOR_ROWS,
    ranked_origins: DataFrame | None = None,
) -> DataFrame:
    """The whole bag. With categories the un-suffixed metrics are the category means; origins that
    lack categories have their plain metrics instead."""
    options = dict(
        labels=labels, with_ranks=with_ranks, n_bins=n_bins, floor_rows=floor_rows, ranked_origins=ranked_origins
    )
    if not with_categories:
        return metric_rows(scores, by=["origin"], **options).select(
            "origin", F.lit(None).cast("string").alias("category"), "metric", "value"
        )
    return with_macro(metrics_by_category(category_mode(scores), **options), skip_undefined)


def train_eval_metrics(
    scores: DataFrame,
    labels: DataFrame,
    with_categories: bool = False,
    floor_rows: int = HOT_FLOOR_ROWS,
) -> DataFrame:
    """The bundle for training evaluation: rank metrics only if no row lacks a rank.

    Whether any rank is missing (NULL, or the exported -1) is decided inside the plan: an origin
    with a missing rank has no row in the rank metrics.
    """
    lacking = F.col("rank").isNull() | (F.col("rank") == -1)
    complete = (
        scores.groupBy("origin")
        .agg(F.max(lacking).alias("_lacks"))
        .where(~F.col("_lacks"))
        .select("origin")
    )
    return metric_bundle(
        scores, labels, with_categories=with_categories, floor_rows=floor_rows, ranked_origins=complete
    )


def overall_score(metrics: DataFrame) -> DataFrame:
    """Mean over origins of (accuracy-rank + exact_match-rank) / 2, from the un-suffixed rows."""
    per_origin = (
        metrics.where(
            F.col("category").isNull() & F.col("metric").isin("accuracy-rank", "exact_match-rank")
        )
        .groupBy("origin")
        .agg((F.sum("value") / F.lit(2.0)).alias("score"), F.count("value").alias("n"))
    )
    return per_origin.agg(F.avg(F.when(F.col("n") == 2, F.col("score"))).alias("overall"))


def judge_metrics(judged: DataFrame) -> DataFrame:
    """Judged accuracy and share of questions judged right throughout, per category and macro.

    ``judged`` has ``origin, category, question, judgment, preference``. Questions are told apart
    by the md5 of their text, which may stand in ``question_key`` instead of ``question``. A prompt without pairs has no rows here and is not counted.
    """
    right = F.when(F.col("judgment") == F.col("preference"), 1).otherwise(0)
    key = F.col("question_key") if "question_key" in judged.columns else F.md5("question")
    per_question = category_mode(judged).groupBy("origin", "category", key.alias("question_key")).agg(
        F.sum(right).alias("n_right"), F.count("*").alias("n_judged")
    )
    wide = per_question.groupBy(*GROUP).agg(
        (F.sum("n_right") / F.sum("n_judged")).alias("accuracy-rank"),
        F.avg(F.when(F.col("n_right") == F.col("n_judged"), 1.0).otherwise(0.0)).alias(
            "exact_match-rank"
        ),
    )
    return with_macro(_long(wide, GROUP))
