"""Pairs of responses to one prompt."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefdeck.functions.text import content_id
from prefdeck.operators.skew import keyed

# The most selective column first: sorts compare an 8-byte prefix of the first key column.
PAIR_KEY = ["input_id", "origin"]
# Rows of a prompt that are paired with as many others in one cell of the pair join: at most some
# two million pairs each.
PAIR_BLOCK_ROWS = 2_000
# Pairs that one task of the pair join looks at, on average.
PAIRS_PER_TASK = 10_000_000


def distinct_pairs(labels: DataFrame) -> DataFrame:
    """Repeated votes collapse; (a, b) and (b, a) both stay. Folded on the map side first."""
    return labels.select(*PAIR_KEY, "chosen_id", "rejected_id").distinct()


def dedup_scores(scores: DataFrame, order: Column, carry: Sequence[str] = ()) -> DataFrame:
    """One score per (origin, input, output): the last in ``order`` wins.

    A category belongs to its prompt, so grouping by it as well changes nothing and keeps the
    string out of the aggregation buffer.
    """
    extra = [c for c in ["category"] if c in scores.columns]
    values = ["reward", *carry]
    last = F.max(F.struct(order.alias("_order"), *values)).alias("_last")
    return (
        scores.groupBy(*PAIR_KEY, "output_id", *extra)
        .agg(last)
        .select(*PAIR_KEY, "output_id", *extra, *[F.col(f"_last.{c}").alias(c) for c in values])
    )


def build_pairs(labels: DataFrame, scores: DataFrame) -> DataFrame:
    """Chosen and rejected reward of every distinct label with both endpoints scored.

    Two lookups on the unique (origin, input, output) key; a response named by very many labels is
    a hot key on the label side only, which AQE splits. Scores must be unique, see
    :func:`dedup_scores`. The category, if scored rows have one, is that of the chosen row.
    """
    key = [*PAIR_KEY, "output_id"]
    extra = [c for c in ["category"] if c in scores.columns]
    scored = keyed(scores, key).select(*key, *extra, "reward")
    chosen = scored.withColumnsRenamed({"output_id": "chosen_id", "reward": "chosen_reward"})
    rejected = scored.withColumnsRenamed(
        {"output_id": "rejected_id", "reward": "rejected_reward", "category": "_category"}
    )
    usable = labels.where((F.col("chosen_id") >= 0) & (F.col("rejected_id") >= 0))
    pairs = (
        distinct_pairs(usable)
        .join(chosen, [*PAIR_KEY, "chosen_id"])
        .join(rejected, [*PAIR_KEY, "rejected_id"])
    )
    if not extra:
        return pairs
    # Both lookups read the same columns, so they share one shuffle of the scores.
    return pairs.withColumn("category", F.coalesce("category", "_category")).drop("_category")


def require_pairs(pairs: DataFrame, strict: bool = False) -> DataFrame:
    """One row: number of pairs and whether there are any; in strict mode none is an error."""
    status = pairs.agg(F.count("*").alias("n_pairs")).withColumn("has_pairs", F.col("n_pairs") > 0)
    if strict:
        checked = F.when(
            ~F.col("has_pairs"), F.raise_error(F.lit("no label has both endpoints scored"))
        ).otherwise(F.col("has_pairs"))
        status = status.withColumn("has_pairs", checked)
    return status


def pair_tasks(rows: DataFrame, keys: Sequence[str], pairs_per_task: int = PAIRS_PER_TASK) -> int:
    """Tasks for :func:`ordered_pairs`: one for every ``pairs_per_task`` pairs, and no fewer than
    ``spark.sql.shuffle.partitions``. Runs one folded count of the keys; other columns are not read."""
    n_rows = F.col("_n").cast("double")
    per_group = keyed(rows, keys).groupBy(*keys).agg(F.count("*").alias("_n"))
    n_pairs = per_group.agg(F.sum(n_rows * (n_rows - 1) / 2)).first()[0] or 0.0
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(n_pairs / pairs_per_task))


def ordered_pairs(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    carry: Sequence[str],
    on: Column | None = None,
    block_rows: int = PAIR_BLOCK_ROWS,
    n_tasks: int | None = None,
) -> DataFrame:
    """Every two rows of a group, the earlier by ``order`` as ``_a`` and the later as ``_b``.

    The pairs themselves are the wanted output (a judge has to see each one), so the work is that
    of the output, and a group of n rows gives n * n / 2 of them. Groups are dealt by hash into about
    n / ``block_rows`` blocks and joined block against block, each cell being its own join key: no
    key ever holds more than about ``block_rows`` rows a side, and a group of one block is one cell.
    Group sizes come from one folded count of the keys. The number of tasks has to stand in the plan: it
    is ``n_tasks`` or else comes from :func:`pair_tasks`, a job that runs when the plan is made. ``order`` must tell the rows of a group apart
    and is never NULL in a pair. ``on`` is a condition over the ``_a`` / ``_b`` columns. Carry narrow columns
    only: a row is copied to every cell of its block.
    """
    columns = list(dict.fromkeys([*order, *carry]))
    rows = keyed(rows, [*keys, *order]).select(*keys, *columns)
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias("_blocks"))
    blocked = rows.join(sizes, list(keys)).withColumn(
        "_block", F.pmod(F.xxhash64(*order), F.col("_blocks")).cast("int")
    )
    every = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))

    # Cells are a few MB but may hold millions of pairs: a stated number of partitions keeps AQE from
    # putting them together, and a merge join from running where the rows of a prompt already are.
    n_tasks = n_tasks or pair_tasks(rows, keys)

    def side(df: DataFrame, suffix: str) -> DataFrame:
        renamed = [F.col(c).alias(f"{c}_{suffix}") for c in columns]
        return df.select(*keys, "_from", "_to", *renamed).repartition(n_tasks, *keys, "_from", "_to")

    # Rows of block i take part as _a in the cells (i, *) and as _b in the cells (*, i).
    first = side(blocked.withColumn("_to", every).withColumn("_from", F.col("_block")), "a")
    second = side(blocked.withColumn("_from", every).withColumn("_to", F.col("_block")), "b")
    condition = F.struct(*[F.col(f"{c}_a").alias(c) for c in order]) < F.struct(
        *[F.col(f"{c}_b").alias(c) for c in order]
    )
    if on is not None:
        condition = condition & on
    return first.join(second.hint("merge"), [*keys, "_from", "_to"]).where(condition).drop("_from", "_to")


def rank_pairs(
    scores: DataFrame, block_rows: int = PAIR_BLOCK_ROWS, n_tasks: int | None = None
) -> DataFrame:
    """Every pair of a prompt with different ranks, the better-ranked response as chosen.

    For looking at pairs. The metrics count them without forming them (``rank_counts``). ``n_tasks``
    as in :func:`ordered_pairs`.
    """
    pairs = ordered_pairs(
        scores,
        PAIR_KEY,
        ["output_id"],
        ["category", "rank", "reward"],
        on=F.col("rank_a") != F.col("rank_b"),
        block_rows=block_rows,
        n_tasks=n_tasks,
    )
    a_better = F.col("rank_a") < F.col("rank_b")

    def pick(column: str, better: bool) -> Column:
        first, second = (f"{column}_a", f"{column}_b") if better else (f"{column}_b", f"{column}_a")
        return F.when(a_better, F.col(first)).otherwise(F.col(second))

    return pairs.select(
        *PAIR_KEY,
        F.col("category_a").alias("category"),
        pick("output_id", True).alias("chosen_id"),
        pick("output_id", False).alias("rejected_id"),
        pick("reward", True).alias("chosen_reward"),
        pick("reward", False).alias("rejected_reward"),
    )


def judge_pairs(
    responses: DataFrame,
    keys: Sequence[str],
    block_rows: int = PAIR_BLOCK_ROWS,
    n_tasks: int | None = None,
) -> DataFrame:
    """Every pair of a prompt with different ranks, with both texts, in rank-map order.

    ``responses`` has ``keys, rank_pos, response_id, rank, output, category, question``; ids are
    unique in a prompt. Equal places (of merged rank maps) follow the ids. Ids and ranks are paired
    first; the texts join afterwards, on (keys, id). ``n_tasks`` as in :func:`ordered_pairs`.
    """
    ranked = responses.where(F.col("rank").isNotNull())
    pairs = ordered_pairs(
        ranked,
        keys,
        ["rank_pos", "response_id"],
        ["rank"],
        on=F.col("rank_a") != F.col("rank_b"),
        block_rows=block_rows,
        n_tasks=n_tasks,
    ).select(
        *keys,
        F.col("response_id_a").alias("id_a"),
        F.col("response_id_b").alias("id_b"),
        F.when(F.col("rank_a") < F.col("rank_b"), F.lit("A"))
        .otherwise(F.lit("B"))
        .alias("preference"),
    )
    texts = keyed(ranked, [*keys, "response_id"])
    first = texts.select(
        *keys, F.col("response_id").alias("id_a"), F.col("output").alias("answer_a"), "category", "question"
    )
    second = texts.select(*keys, F.col("response_id").alias("id_b"), F.col("output").alias("answer_b"))
    return (
        pairs.join(first, [*keys, "id_a"])
        .join(second, [*keys, "id_b"])
        .select(*keys, "category", "question", "id_a", "id_b", "answer_a", "answer_b", "preference")
    )


def coin(key: Column) -> Column:
    """A fair coin fixed by ``key``: first hex digit of its md5 below 8."""
    return F.substring(content_id(key), 1, 1) < "8"


def swap_positions(pairs: DataFrame, key: Column) -> DataFrame:
    """Exchange the two answers and flip the gold preference where the coin of ``key`` says so."""
    flip = coin(key)

    def exchange(name: str) -> dict[str, Column]:
        a, b = F.col(f"{name}_a"), F.col(f"{name}_b")
        return {
            f"{name}_a": F.when(flip, b).otherwise(a),
            f"{name}_b": F.when(flip, a).otherwise(b),
        }

    flipped = F.when(F.col("preference") == "A", F.lit("B")).otherwise(F.lit("A"))
    changes = {"preference": F.when(flip, flipped).otherwise(F.col("preference"))}
    for name in ("answer", "id"):
        if f"{name}_a" in pairs.columns:
            changes.update(exchange(name))
    # ``key`` may name the very columns that change: all changes read the old row.
    return pairs.withColumns(changes)
